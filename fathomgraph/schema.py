"""Schemas of the input files."""

from __future__ import annotations

from pyspark.sql import types as T

PREPRINT = T.StructType([
    T.StructField("categories", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("versions", T.ArrayType(T.StructType([T.StructField("created", T.StringType())]))),
])

YEAR_COUNTS = T.ArrayType(T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("cited_by_count", T.LongType()),
]))

CITED_PAPER = T.StructType([
    T.StructField("paper_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("abstract_inverted_index", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))),
    T.StructField("publication_date", T.StringType()),
    T.StructField("cited_by_count", T.LongType()),
    T.StructField("counts_by_year", YEAR_COUNTS),
])

ENTITY = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("entity_name", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("start_pos", T.IntegerType()),
    T.StructField("end_pos", T.IntegerType()),
])

#: Annotated documents mix numbers and labels in one inner array; read as text and cast by ``spans.typed_documents``.
ANNOTATED = T.StructType([
    T.StructField("doc", T.LongType()),
    T.StructField("sentences", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("ner", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
    T.StructField("relations", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
    T.StructField("predicted_ner", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
])
