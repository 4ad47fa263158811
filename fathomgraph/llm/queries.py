"""The registered queries of the numbered operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, blocks, jaccard, licenses, mixing, packing, phrases, pii, pivots, planes, quality, secrets, warc
from .common import table
from .tokens import vocabulary_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query
def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


@query
def op5_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.read_token_digests(planes.write_token_files(table(spark, sf_dir, "documents"), vocabulary_path()))


def _joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op4_pivot_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op6_perplexity_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"))


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(
        "doc_id", *[_count("base", k) for k in pii.BASE_KINDS], F.sha2(_joined_spans(F.col("base")), 256).alias("base_sha256"),
        _joined_spans(F.concat(plain("base"), plain("added"))).alias("spans"),
    )


@query
def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", *[_count("spans", k) for k in secrets.KINDS[:3]], F.sha2(_joined_spans(base), 256).alias("base_sha256"),
        _joined_spans(F.col("spans")).alias("spans"),
    )


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


@query
def op10_archive_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


@query
def op11_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract_pages(table(spark, sf_dir, "pages"))


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.score_alignments(table(spark, sf_dir, "documents"), *alignment.vocabulary_paths())


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES["op10_archive_conversion"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM m"""

ORACLES["op4_pivot_near_duplicates"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98
),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
roots AS (SELECT vec_id, min(other) AS root FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(r.root, e.vec_id)) AS component_id,
    e.vec_id = least(e.vec_id, coalesce(r.root, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c USING (vec_id) LEFT JOIN roots r USING (vec_id)"""


ORACLES["op13_phrase_collocations"] = r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
p AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\n\x0B\x0C\r]+')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws[i:i + k - 1] AS ph, k FROM o, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws)),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
f AS (SELECT lang, ph, k, count(*) AS f FROM g GROUP BY lang, ph, k HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE k > 1),
inner_parts AS (
    SELECT lang, ph[i:i + s - 1] AS ph, max(f) AS outer_f
    FROM (SELECT lang, ph, f, k, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT lang, ph, f, k, unnest(range(2, k)) AS s FROM c WHERE k > 2))
    GROUP BY 1, 2
),
kept AS (SELECT c.* FROM c LEFT JOIN inner_parts USING (lang, ph) WHERE outer_f IS NULL OR 100::HUGEINT * outer_f < 80::HUGEINT * f),
cuts AS (SELECT lang, ph, f AS a, k, unnest(range(1, k)) AS cut FROM kept),
scored AS (
    SELECT cuts.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.ph = cuts.ph[1:cuts.cut] JOIN f y ON y.lang = cuts.lang AND y.ph = cuts.ph[cuts.cut + 1:cuts.k]
),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) AS low FROM scored),
named AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM best WHERE low = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
