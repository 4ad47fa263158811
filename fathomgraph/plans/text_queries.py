"""Queries A to D, L and N: files, texts, dictionary matching, entities, incremental ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import dates, text
from ..operators import anchors, cooccur, entities, match
from ..session import durable, shared_path
from ..sources import readers, records, sinks
from ..streaming.ingest import file_report, ingest_new_files
from . import inputs as i
from .inputs import C_COLUMNS, YEARS
from .registry import cte, query

# -- files ---------------------------------------------------------------------------------------------------------

_CATEGORIES = {"en": "cs.CL", "de": "cs.CL cs.LG", "fr": "cs.LG", "es": "cs.AI"}
cte(
    "preprints",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'cs.CL' WHEN 'de' THEN 'cs.CL cs.LG' WHEN 'fr' THEN 'cs.LG' ELSE 'cs.AI' END AS categories, title, abstract, "
    "CAST(date_diff('day', DATE '1990-01-01', DATE '2000-01-01' + CAST(doc_id % 5000 AS INTEGER)) AS INTEGER) AS time FROM texts", "texts",
)


def _preprint_files(spark, d) -> str:
    """The documents as preprint JSON lines."""
    path = shared_path(spark, "preprints")
    table = F.create_map(*[F.lit(x) for pair in _CATEGORIES.items() for x in pair])
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 5000).cast("int"))
    i.texts(spark, d).select(
        F.element_at(table, F.col("lang")).alias("categories"), "title", "abstract",
        F.array(F.struct(F.concat(F.date_format(day, "EEE, d MMM yyyy"), F.lit(" 09:30:00 GMT")).alias("created"))).alias("versions"),
    ).write.json(path)
    return path


@query("a1_preprints_of_category", "SELECT categories, title, abstract, time FROM preprints WHERE categories = 'cs.CL'", "preprints")
def _(spark, d):
    return readers.read_preprints(spark, _preprint_files(spark, d), "cs.CL")


@query("a2_all_preprints", "SELECT 'arxiv' AS source, title, abstract, time FROM preprints", "preprints")
def _(spark, d):
    return readers.read_all_preprints(spark, _preprint_files(spark, d))


def _cited_files(spark, d) -> str:
    """The papers as gz JSON lines below updated_date folders (one per month)."""
    path = shared_path(spark, "cited")
    orders = i.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("paper_id"), F.to_date("o_orderdate").alias("_day"), F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("abstract"),
    )
    rows = orders.join(i.papers_with_counts(spark, d), "paper_id").select(
        "paper_id", "title", "abstract", F.col("_day").cast("string").alias("publication_date"), F.col("ct").alias("cited_by_count"),
        "counts_by_year", F.trunc("_day", "month").alias("updated_date"),
    )
    rows.repartition("updated_date").write.partitionBy("updated_date").option("compression", "gzip").json(path)
    return path


@query("a3_cited_papers", "SELECT paper_id, o_orderpriority AS title, time, ct AS cited_by_count FROM papers JOIN orders ON o_orderkey = paper_id", "papers")
def _(spark, d):
    rows = readers.valid_papers(readers.read_cited_papers(spark, _cited_files(spark, d), parts=8))
    return rows.select("paper_id", "title", "time", "cited_by_count")


@query(
    "a4_cited_papers_of_dates",
    "SELECT paper_id, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS updated_date, ct AS cited_by_count FROM papers JOIN orders ON o_orderkey = paper_id "
    "WHERE date_trunc('month', CAST(o_orderdate AS DATE)) BETWEEN DATE '1996-03-15' AND DATE '1998-09-01'", "papers",
)
def _(spark, d):
    return readers.read_cited_papers(spark, _cited_files(spark, d), "1996-03-15", "1998-09-01").select("paper_id", "updated_date", "cited_by_count")


# Some lines are damaged by rule, to give the malformed-row policy work on every kind of fault.
_FAULT = "CASE WHEN o_orderkey % 11 = 3 THEN 'json' WHEN o_orderkey % 13 = 5 THEN 'nodate' WHEN o_orderkey % 17 = 7 THEN 'baddate' WHEN o_orderkey % 19 = 2 THEN 'text' ELSE 'none' END"


def _raw_lines(spark, d) -> str:
    path = shared_path(spark, "lines")
    rows = i.table(spark, d, "orders").select(
        F.expr(_FAULT).alias("f"), F.trunc(F.to_date("o_orderdate"), "year").alias("updated_date"), F.col("o_orderkey").alias("paper_id"),
        F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_orderpriority").alias("title"),
    )
    record = F.struct(
        "paper_id", F.when(F.col("f") == "text", " ").otherwise(F.col("title")).alias("title"),
        F.when(F.col("f") == "baddate", "1997-02-30").when(F.col("f") != "nodate", F.col("day")).alias("publication_date"),
    )
    line = F.to_json(record)
    broken = F.concat(F.lit("{"), line)
    rows.select(F.when(F.col("f") == "json", broken).otherwise(line).alias("value"), "updated_date").write.partitionBy("updated_date").text(path)
    return path


@query(
    "a6_ingest_report",
    "SELECT CAST(date_trunc('year', CAST(o_orderdate AS DATE)) AS DATE) AS part, count(*) FILTER (f = 'none') AS processed, count(*) FILTER (f <> 'none') AS skipped, "
    "count(*) FILTER (f = 'json') AS skipped_json, count(*) FILTER (f IN ('nodate', 'baddate')) AS skipped_date, count(*) FILTER (f = 'text') AS skipped_text "
    f"FROM (SELECT *, {_FAULT} AS f FROM orders) GROUP BY 1",
)
def _(spark, d):
    return readers.ingest_report(readers.read_cited_papers(spark, _raw_lines(spark, d)), "updated_date")


cte("dictionary_lines", "SELECT concept_id, CAST(2 * concept_id + 1 AS INTEGER) AS line_no, concept FROM dictionary", "dictionary")


def _dictionary_file(spark, d) -> str:
    """The dictionary as one text file, a blank line before every concept."""
    path = shared_path(spark, "dictionary")
    lines = i.dictionary(spark, d).coalesce(1).sortWithinPartitions("concept_id")
    lines.select(F.concat(F.lit(" \n  "), "concept", F.lit(" ")).alias("value")).write.text(path)
    return path


@query("a7_dictionary_file", "SELECT * FROM dictionary_lines", "dictionary_lines")
def _(spark, d):
    return readers.read_dictionary(spark, _dictionary_file(spark, d))


def _paper_table(spark, d) -> str:
    path = shared_path(spark, "papers")
    i.papers(spark, d).write.parquet(path)
    return path


@query("a8_year_columns", "SELECT paper_id, time, c1996, c1997, c1998 FROM papers", "papers")
def _(spark, d):
    return readers.scan_years(spark, _paper_table(spark, d), ["paper_id", "time"], 1996, 1998)


@query(
    "a9_narrow_scan",
    "SELECT l_orderkey::INTEGER AS l_orderkey, l_linenumber, round(CAST(CAST(l_extendedprice AS REAL) AS DOUBLE), 3) AS price FROM lineitem",
)
def _(spark, d):
    rows = readers.scan_narrow(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice").cast("double"), 3).alias("price"))


@query("a10_csv_scan", "SELECT * FROM entities", "entities")
def _(spark, d):
    path = shared_path(spark, "entities")
    rows = i.entities(spark, d)
    sinks.write_csv(rows.toDF(*[f" {c} " for c in rows.columns]), path)
    return readers.read_csv(spark, path, schema.ENTITY, ["utf-8", "latin-1"])


@query("a11_json_array_scan", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, d):
    path = shared_path(spark, "arrays")
    rows = i.table(spark, d, "conversations").repartition(8, "conv_id")
    sinks.write_json_arrays(rows, path)
    return readers.read_json_arrays(spark, path, rows.schema)


@query("a10_quoted_csv_by_splits", "SELECT doc_id, lang, text FROM documents WHERE text <> ''")
def _(spark, d):
    """Fields with line breaks and quotes, read by as many tasks as the files have splits."""
    path = shared_path(spark, "quoted")
    rows = i.table(spark, d, "documents").select("doc_id", "lang", "text").filter("text <> ''")
    rows.write.options(header=True, quoteAll=True, escape='"').csv(path)
    return records.read_quoted_csv(spark, path, rows.schema)


@query("a11_json_lists_by_splits", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, d):
    path = shared_path(spark, "lists")
    rows = i.table(spark, d, "conversations")
    sinks.write_json_arrays(rows, path)
    return records.read_json_lists(spark, path, rows.schema)


_ROUND_TRIP = "SELECT '{f}' AS format, doc_id, entity_name, start_pos FROM entities"


@query("a12_sinks", " UNION ALL ".join(_ROUND_TRIP.format(f=f) for f in ("gzip", "snappy", "csv", "tsv", "jsonl")), "entities")
def _(spark, d):
    rows = i.entities(spark, d)
    root = shared_path(spark, "sinks")
    sinks.write_parquet(rows, f"{root}/gzip", "gzip")
    sinks.write_parquet(rows, f"{root}/snappy", "snappy")
    sinks.write_csv(rows, f"{root}/csv")
    sinks.write_tsv(rows, f"{root}/tsv")
    sinks.write_jsonl(rows, f"{root}/jsonl")
    back = {
        "gzip": spark.read.parquet(f"{root}/gzip"), "snappy": spark.read.parquet(f"{root}/snappy"),
        "csv": readers.read_csv(spark, f"{root}/csv", schema.ENTITY),
        "tsv": readers.read_csv(spark, f"{root}/tsv", schema.ENTITY, sep="\t"),
        "jsonl": spark.read.schema(schema.ENTITY).json(f"{root}/jsonl"),
    }
    tagged = [df.select(F.lit(f).alias("format"), "doc_id", "entity_name", "start_pos") for f, df in back.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


@query("a14_compaction", "SELECT paper_id, time, ct FROM papers", "papers")
def _(spark, d):
    many, few = shared_path(spark, "parts"), shared_path(spark, "compact")
    i.papers(spark, d).select("paper_id", "time", "ct").repartition(16, "paper_id").write.parquet(many)
    sinks.compact(spark, many, few)
    return spark.read.parquet(few)


_EDGE_COLUMNS = "paper_id, v1, v2, time, ct"


@query("a15_union_of_graphs", f"SELECT {_EDGE_COLUMNS}, c2001, CASE WHEN time <= 3000 THEN 0 ELSE c2000 END AS c2000 FROM edges", "edges")
def _(spark, d):
    edges = i.edges(spark, d)
    early = edges.filter("time <= 3000").select("paper_id", "v1", "v2", "time", "ct", "c2001")
    late = edges.filter("time > 3000").select("paper_id", "v1", "v2", "time", "ct", "c2000", "c2001")
    return sinks.union_graphs(early, late)


@query("a16_graph_report", "SELECT (SELECT count(*) FROM edges) AS edge_rows, count(DISTINCT v) AS vertices FROM (SELECT unnest([v1, v2]) AS v FROM edges)", "edges")
def _(spark, d):
    return sinks.graph_report(i.dated_pairs(spark, d))


# -- texts ---------------------------------------------------------------------------------------------------------


@query("b1_day_offset", "SELECT paper_id, time FROM papers", "papers")
def _(spark, d):
    return i.table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), dates.day_offset(F.to_date("o_orderdate")).alias("time"))


@query("b2_abstract_from_index", "SELECT doc_id, text AS abstract FROM documents")
def _(spark, d):
    docs = i.table(spark, d, "documents").select("doc_id", "text")
    # Texts are shuffled once, by document; both groupings of their words keep that partitioning.
    docs = docs.repartition(i.document_tasks(spark, d), "doc_id")
    words = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    # The index is built by grouping per (document, word) first, so that a frequent word is spread over documents.
    places = words.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("positions"))
    index = places.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "positions"))).alias("index"))
    return index.select("doc_id", text.paper_abstract(F.col("index"), F.lit(None).cast("string")).alias("abstract"))


def _replace_sql(column: str, pairs) -> str:
    def quoted(s: str) -> str:
        return "chr(10)" if s == "\n" else "'" + s.replace("'", "''") + "'"

    return reduce(lambda sql, p: f"replace({sql}, {quoted(p[0])}, {quoted(p[1])})", pairs, column)


_LOWER = "lower(title || ' ' || abstract)"
cte("clean", f"SELECT doc_id, source, lang, {_replace_sql(_LOWER, text.REPLACE_FULL)} AS clean FROM texts", "texts")


def _clean(spark, d):
    return i.texts(spark, d).select("doc_id", "source", "lang", text.paper_text(F.col("title"), F.col("abstract")).alias("clean"))


@query("b3_clean_full", "SELECT doc_id, clean FROM clean", "clean")
def _(spark, d):
    return _clean(spark, d).select("doc_id", "clean")


@query("b3_clean_short", "SELECT doc_id, " + _replace_sql(f"regexp_replace({_LOWER}, '^\\s+|\\s+$', '', 'g')", text.REPLACE_SHORT) + " AS clean FROM texts", "texts")
def _(spark, d):
    return i.texts(spark, d).select("doc_id", text.paper_text(F.col("title"), F.col("abstract"), text.REPLACE_SHORT, strip=True).alias("clean"))


@query("b3_clean_three", f"SELECT doc_id, {_replace_sql(_LOWER, text.REPLACE_THREE)} AS clean FROM texts", "texts")
def _(spark, d):
    return i.texts(spark, d).select("doc_id", text.paper_text(F.col("title"), F.col("abstract"), text.REPLACE_THREE).alias("clean"))


@query(
    "b4_missing_parts",
    "SELECT doc_id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS clean FROM (SELECT doc_id, CASE WHEN lang <> 'fr' THEN title END AS title, CASE WHEN lang <> 'es' THEN abstract END AS abstract FROM texts)",
    "texts",
)
def _(spark, d):
    title, abstract = F.when(F.col("lang") != "fr", F.col("title")), F.when(F.col("lang") != "es", F.col("abstract"))
    return i.texts(spark, d).select("doc_id", text.paper_text(title, abstract, []).alias("clean"))


_META = "SELECT 'corpus' AS source, title, abstract, CAST(length(text) % 7 AS INTEGER) AS time FROM texts"


@query("b5_metadata_union", f"SELECT DISTINCT * FROM ({_META}) UNION ALL SELECT 'arxiv', title, abstract, time FROM preprints", "texts", "preprints")
def _(spark, d):
    first = i.texts(spark, d).select(F.lit("corpus").alias("source"), "title", "abstract", (F.length("text") % 7).cast("int").alias("time"))
    return first.dropDuplicates().unionByName(readers.read_all_preprints(spark, _preprint_files(spark, d)))


# -- dictionary matching -------------------------------------------------------------------------------------------

cte("hits", "SELECT doc_id, source, concept_id, concept FROM clean JOIN dictionary ON contains(clean, concept)", "clean", "dictionary")


def _dictionary(spark, d):
    return match.clean_dictionary(i.dictionary(spark, d))


@query("c1_concepts_in_papers", "SELECT doc_id, concept FROM hits", "hits")
def _(spark, d):
    return match.mentions(_clean(spark, d), _dictionary(spark, d), "doc_id", "clean").select("doc_id", "concept")


@query("c2_merged_concepts", "SELECT DISTINCT concept FROM hits", "hits")
def _(spark, d):
    texts, words = _clean(spark, d), durable(_dictionary(spark, d), "dictionary")
    chunks = [match.mentions(texts.filter(F.col("lang") == lang), words, "doc_id", "clean") for lang in ("en", "de", "fr", "es")]
    return match.merge_hits(chunks)


@query("c3_concept_ids", "SELECT doc_id, concept_id FROM hits", "hits")
def _(spark, d):
    return match.mentions(_clean(spark, d), _dictionary(spark, d), "doc_id", "clean").select("doc_id", "concept_id")


@query("c3_rare_anchor_ids", "SELECT doc_id, concept_id FROM hits", "hits")
def _(spark, d):
    """The same hits, looked up by the rarest gram of each concept."""
    return anchors.anchored_occurrences(_clean(spark, d), _dictionary(spark, d), "doc_id", "clean").select("doc_id", "concept_id").distinct()


_BOUND = "[ ,.;:!?()\\[\\]{{}}\"''\\-\\n\\t\\r]".replace("{{", "{").replace("}}", "}")
_CHARS = "' ,.;:!?()[]{}\"''-' || chr(10) || chr(9) || chr(13)"
cte(
    "whole_words",
    f"SELECT DISTINCT doc_id, word AS concept FROM (SELECT doc_id, unnest(string_split(translate(title || ' ' || abstract, {_CHARS}, repeat('|', 19)), '|')) AS word FROM texts) "
    "SEMI JOIN dictionary ON word = concept UNION ALL "
    f"SELECT doc_id, concept FROM texts JOIN (SELECT * FROM dictionary WHERE contains(concept, ' ')) ON contains(title || ' ' || abstract, concept) "
    f"WHERE regexp_matches(title || ' ' || abstract, '(^|{_BOUND})' || concept || '($|{_BOUND})')", "texts", "dictionary",
)
cte("frequency", "SELECT concept, count(*) AS df FROM whole_words GROUP BY concept", "whole_words")


def _frequency(spark, d):
    docs = i.texts(spark, d).select("doc_id", F.concat("title", F.lit(" "), "abstract").alias("body"))
    return match.document_frequency(docs, i.dictionary(spark, d), "doc_id", "body")


@query("c5_document_frequency", "SELECT concept, df FROM frequency", "frequency")
def _(spark, d):
    return _frequency(spark, d)


# -- dictionary refinement -----------------------------------------------------------------------------------------

# Rules on words of the part table, shaped like the default word lists.
_RULES = {
    "any": ["bolt", "new"], "any5": ["economy"], "any3": ["hot"], "any2": ["rod"], "start": ["small"], "end": ["ring"],
    "start2": ["red"], "end2": ["plate"], "forbidden": ["d w", "t an"],
}
cte("phrases", "SELECT DISTINCT unnest([lower(p_name), lower(p_name || ' ' || p_type), lower(p_type || ' ' || p_name || ' part'), lower(p_name || ' for ' || p_type || ' use')]) AS concept FROM part")
cte("flags", (
    "SELECT concept, len(list_intersect(w, ['bolt', 'new'])) > 0 AS by_any, (len(w) < 5 AND list_contains(w, 'economy')) OR (len(w) <= 3 AND list_contains(w, 'hot')) "
    "OR (len(w) = 2 AND list_contains(w, 'rod')) AS by_length, w[1] = 'small' OR w[-1] = 'ring' OR (len(w) = 2 AND (w[1] = 'red' OR w[-1] = 'plate')) AS by_ends, "
    "contains(concept, 'd w') OR contains(concept, 't an') AS by_forbidden FROM (SELECT concept, string_split(concept, ' ') AS w FROM phrases)"
), "phrases")


def _phrases(spark, d):
    name, kind = F.col("p_name"), F.col("p_type")
    forms = F.array(
        F.lower(name), F.lower(F.concat_ws(" ", name, kind)), F.lower(F.concat_ws(" ", kind, name, F.lit("part"))),
        F.lower(F.concat_ws(" ", name, F.lit("for"), kind, F.lit("use"))),
    )
    return i.table(spark, d, "part").select(F.explode(forms).alias("concept")).distinct()


for _id, _flag in (("d1_any_word", "any"), ("d2_by_length", "by_length"), ("d3_first_and_last_word", "ends"), ("d4_forbidden_strings", "forbidden")):
    def _one(spark, d, flag=_flag):
        return _phrases(spark, d).select("concept", match.rule_flags(F.col("concept"), _RULES)[flag].alias("removed"))

    _column = {"any": "by_any", "by_length": "by_length", "ends": "by_ends", "forbidden": "by_forbidden"}[_flag]
    query(_id, f"SELECT concept, {_column} AS removed FROM flags", "flags")(_one)


@query("d5_refined_dictionary", "SELECT concept FROM flags WHERE NOT (by_any OR by_length OR by_ends OR by_forbidden)", "flags")
def _(spark, d):
    return match.refine_dictionary(_phrases(spark, d), rules=_RULES)


@query(
    "d5_refinement_report",
    "SELECT count(*) AS total, count(*) FILTER (NOT (by_any OR by_length OR by_ends OR by_forbidden)) AS kept, count(*) FILTER (by_any OR by_length OR by_ends OR by_forbidden) AS removed FROM flags", "flags",
)
def _(spark, d):
    return match.refinement_report(_phrases(spark, d), rules=_RULES)


def _listed(name: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in match.DEFAULT_RULES[name]) + "]::VARCHAR[]"


_has = {n: f"len(list_intersect(w, {_listed(n)})) > 0" for n in ("any", "any5", "any3", "any2")}
_at = {n: f"list_contains({_listed(n)}, w[{1 if 'start' in n else -1}])" for n in ("start", "end", "start2", "end2")}


@query(
    "d5_default_rules",
    f"SELECT concept FROM (SELECT concept, string_split(concept, ' ') AS w FROM (SELECT concept FROM dictionary UNION SELECT concept FROM phrases)) WHERE NOT ({_has['any']} "
    f"OR (len(w) < 5 AND {_has['any5']}) OR (len(w) <= 3 AND {_has['any3']}) OR (len(w) = 2 AND {_has['any2']}) OR {_at['start']} OR {_at['end']} "
    f"OR (len(w) = 2 AND ({_at['start2']} OR {_at['end2']})) OR " + " OR ".join(f"contains(concept, '{f}')" for f in match.DEFAULT_RULES["forbidden"]) + ")",
    "dictionary", "phrases",
)
def _(spark, d):
    """The default lists on the words of the texts and the phrases."""
    return match.refine_dictionary(i.dictionary(spark, d).select("concept").union(_phrases(spark, d)).distinct())


# -- entities ------------------------------------------------------------------------------------------------------

_PLURAL = (
    "CASE WHEN n NOT LIKE '%s' THEN false WHEN n LIKE '%ss' THEN false WHEN upper(n[:-2]) = n[:-2] AND lower(n[:-2]) <> n[:-2] THEN true "
    "WHEN regexp_matches(n, '[0-9]') THEN false ELSE true END"
)
cte(
    "plurals",
    "SELECT *, CASE WHEN NOT plural THEN n WHEN n LIKE '%ies' THEN n[:-4] || 'y' WHEN n LIKE '%es' THEN n[:-3] ELSE n[:-2] END AS singular "
    f"FROM (SELECT *, {_PLURAL} AS plural FROM (SELECT *, entity_name AS n FROM entities))", "entities",
)


@query(
    "l1_first_per_name", "SELECT doc_id, entity_name, entity_type, start_pos, end_pos FROM (SELECT *, row_number() OVER (PARTITION BY lower(entity_name) ORDER BY start_pos) AS k FROM entities) WHERE k = 1", "entities",
)
def _(spark, d):
    return entities.first_per_name(i.entities(spark, d), "entity_name", "start_pos")


@query(
    "l2_drop_parentheses",
    "SELECT * FROM (SELECT doc_id, trim(regexp_replace(trim(entity_name), '\\s*\\([^)]*\\)', '', 'g')) AS entity_name, entity_type, start_pos, end_pos FROM entities) WHERE entity_name <> ''", "entities",
)
def _(spark, d):
    return entities.drop_parentheses(i.entities(spark, d), "entity_name")


@query("l3_plural_names", "SELECT doc_id, entity_name, plural FROM plurals", "plurals")
def _(spark, d):
    return entities.plural_report(i.entities(spark, d), "entity_name").select("doc_id", "entity_name", "plural")


@query("l4_singular_names", "SELECT doc_id, entity_name, singular FROM plurals", "plurals")
def _(spark, d):
    return entities.plural_report(i.entities(spark, d), "entity_name").select("doc_id", "entity_name", "singular")


@query("l5_drop_plurals", "SELECT doc_id, entity_name FROM plurals WHERE NOT (plural AND singular IN (SELECT entity_name FROM entities))", "plurals", "entities")
def _(spark, d):
    return entities.drop_plurals(i.entities(spark, d), "entity_name").select("doc_id", "entity_name")


@query(
    "l6_drop_noise",
    "SELECT * FROM (SELECT doc_id, trim(regexp_replace(translate(entity_name, '~\"$%\\/', ''), '\\s+', ' ', 'g')) AS entity_name, entity_type FROM entities) WHERE entity_name <> ''", "entities",
)
def _(spark, d):
    return entities.drop_noise(i.entities(spark, d), "entity_name").select("doc_id", "entity_name", "entity_type")


@query(
    "l7_frequency_table",
    "SELECT concept, df, round(df * 100.0::DOUBLE / sum(df) OVER (), 4) AS percentage, round(CAST(sum(df) OVER (ORDER BY df DESC, concept ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 100.0::DOUBLE / sum(df) OVER (), 4) AS cumulative FROM frequency",
    "frequency",
)
def _(spark, d):
    return entities.frequency_table(_frequency(spark, d))


# -- incremental ingest --------------------------------------------------------------------------------------------


def _ingest(spark, d):
    """Clean texts as JSON part files per language, taken in by two runs of the stream; (input rows, stored mentions)."""
    root = shared_path(spark, "stream")
    clean = _clean(spark, d).select("doc_id", "clean", "lang")
    words = durable(_dictionary(spark, d), "dictionary")
    fields = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("clean", T.StringType())])

    def matched(batch):
        files = batch.select("doc_id", F.element_at(F.split("file", "/"), -2).alias("file"))
        return match.mentions(batch, words, "doc_id", "clean").join(files, "doc_id")

    def run():
        ingest_new_files(spark, f"{root}/in/*", fields, f"{root}/out", f"{root}/checkpoint", matched)

    clean.filter(F.col("lang").isin("en", "de")).write.partitionBy("lang").json(f"{root}/in")
    run()
    clean.filter(~F.coalesce(F.col("lang"), F.lit("")).isin("en", "de")).write.mode("append").partitionBy("lang").json(f"{root}/in")
    run()
    run()
    return clean.withColumn("file", F.concat(F.lit("lang="), "lang")), spark.read.parquet(f"{root}/out").drop("batch")


@query("n1_incremental_mentions", "SELECT doc_id, concept_id, concept FROM hits", "hits")
def _(spark, d):
    return _ingest(spark, d)[1].select("doc_id", "concept_id", "concept")


@query(
    "n2_file_report",
    "SELECT 'lang=' || c.lang AS file, count(DISTINCT c.doc_id) AS processed, count(DISTINCT h.doc_id) AS matched_rows, count(h.doc_id) AS matched FROM clean c LEFT JOIN hits h USING (doc_id) GROUP BY c.lang", "clean", "hits",
)
def _(spark, d):
    return file_report(*_ingest(spark, d), "doc_id")
