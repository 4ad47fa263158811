"""Queries M: annotated documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import BRACKET_TOKENS
from ..operators import spans
from ..session import durable
from . import inputs as i
from .inputs import DIRECTED, SYMMETRIC, r9
from .registry import cte, query

_ENDS = "doc, sent, s1, e1, s2, e2"


@query("m1_sentences", "SELECT doc, sent, \"offset\", doc_tokens, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS words FROM sents", "sents")
def _(spark, d):
    return i.sentence_rows(spark, d).select(
        "doc", "sent", "offset", "doc_tokens", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("words")
    )


@query(
    "m2_unescaped_brackets",
    "SELECT doc, sent, array_to_string(list_transform(tokens, lambda t: CASE t WHEN 'the' THEN '(' WHEN 'of' THEN ')' WHEN 'in' THEN '[' WHEN 'and' THEN '{' ELSE t END), ' ') AS words FROM lines", "lines",
)
def _(spark, d):
    codes = dict(zip(("the", "of", "in", "and"), ("-LRB-", "-RRB-", "-LSB-", "-LCB-")))
    assert all(c in BRACKET_TOKENS for c in codes.values())
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    docs = i.annotated(spark, d).withColumn(
        "sentences", F.transform("sentences", lambda s: F.transform(s, lambda t: F.coalesce(F.try_element_at(table, t), t)))
    )
    return spans.sentences(docs).select("doc", "sent", F.array_join("tokens", " ").alias("words"))


cte(
    "candidates",
    "SELECT doc, sent, CAST(s AS INTEGER) AS s, CAST(unnest(range(s, least(s + 12, \"offset\" + len(tokens)))) AS INTEGER) AS e FROM "
    "(SELECT *, unnest(range(\"offset\", \"offset\" + len(tokens))) AS s FROM sents)", "sents",
)


@query(
    "m3_candidate_spans",
    "SELECT doc, sent, count(*) AS spans, count(label) AS gold, CAST(sum(s * 31 + e) AS BIGINT) AS checksum FROM candidates LEFT JOIN gold USING (doc, sent, s, e) GROUP BY doc, sent", "candidates", "gold",
)
def _(spark, d):
    labelled = spans.label_spans(i.sentence_rows(spark, d), i.gold(spark, d), 12)
    return labelled.groupBy("doc", "sent").agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(F.col("label") != "NIL").alias("gold"), F.sum(F.col("s") * 31 + F.col("e")).alias("checksum")
    )


_BUDGET = 64


@query(
    "m4_context_window",
    "SELECT doc, sent, CAST(CASE WHEN n >= {b} THEN 0 WHEN l < r THEN least(l, h) ELSE least(l, {b} - least(r, h) - n) END AS INTEGER) AS left_context, "
    "CAST(CASE WHEN n >= {b} THEN 0 WHEN l < r THEN least(r, {b} - least(l, h) - n) ELSE least(r, h) END AS INTEGER) AS right_context "
    "FROM (SELECT doc, sent, len(tokens) AS n, \"offset\" AS l, doc_tokens - \"offset\" - len(tokens) AS r, ({b} - len(tokens)) // 2 AS h FROM sents)".format(b=_BUDGET), "sents",
)
def _(spark, d):
    return spans.context_window(i.sentence_rows(spark, d), _BUDGET)


_CLASSES = "['" + "','".join(spans.relation_classes(SYMMETRIC, DIRECTED)) + "']"
_SYMS = "('" + "','".join(SYMMETRIC[1:]) + "')"
cte(
    "expanded",
    f"SELECT *, CAST(list_position({_CLASSES}, label) - 1 AS INTEGER) AS label_id FROM (SELECT {_ENDS}, label, false AS added FROM relations UNION ALL "
    f"SELECT doc, sent, s2, e2, s1, e1, CASE WHEN label IN {_SYMS} THEN label ELSE label || '^-1' END, true FROM relations)", "relations",
)


@query("m5_expanded_relations", "SELECT * FROM expanded", "expanded")
def _(spark, d):
    return spans.expand_relations(i.gold_relations(spark, d), SYMMETRIC, DIRECTED)


@query(
    "m6_entity_pairs",
    "SELECT a.doc, a.sent, coalesce(label_id, 0) AS label_id, count(*) AS pairs FROM gold a JOIN gold b ON a.doc = b.doc AND a.sent = b.sent LEFT JOIN expanded x "
    "ON x.doc = a.doc AND x.sent = a.sent AND x.s1 = a.s AND x.e1 = a.e AND x.s2 = b.s AND x.e2 = b.e GROUP BY ALL", "gold", "expanded",
)
def _(spark, d):
    expanded = spans.expand_relations(i.gold_relations(spark, d), SYMMETRIC, DIRECTED)
    return spans.entity_pairs(i.gold(spark, d), expanded).groupBy("doc", "sent", "label_id").agg(F.count(F.lit(1)).alias("pairs"))


_ORDER = "ORDER BY score DESC, s, e, label"


@query(
    "m7_pruned_spans",
    f"SELECT doc, sent, s, e, label, round(score, 9) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc, sent {_ORDER}) AS INTEGER) AS place FROM spans) "
    "JOIN (SELECT doc, sent, len(tokens) AS n FROM sents) USING (doc, sent) WHERE place <= least(greatest(ceil(n * 0.5::DOUBLE), 3), 18)", "spans", "sents",
)
def _(spark, d):
    pruned = spans.prune_spans(i.scored_spans(spark, d), i.sentence_rows(spark, d))
    return pruned.withColumn("score", r9(F.col("score")))


def _greedy(name: str, group: str) -> None:
    """Fragments of the greedy selection: one recursion step per place in the score order of a group."""
    on = " AND ".join(f"g.{c} = r.{c}" for c in group.split(", "))
    cte(f"{name}_order", f"SELECT *, row_number() OVER (PARTITION BY {group} {_ORDER}) AS k, count(*) OVER (PARTITION BY {group}) AS n FROM spans", "spans")
    cols = ", ".join(f"r.{c}" for c in group.split(", "))
    cte(
        f"{name}_walk",
        f"SELECT {group}, k, n, [{{'s': s, 'e': e, 'label': label, 'score': score}}] AS kept FROM {name}_order WHERE k = 1 UNION ALL "
        f"SELECT {cols}, r.k, r.n, CASE WHEN len(list_filter(g.kept, lambda x: x.s <= r.e AND r.s <= x.e)) = 0 "
        f"THEN list_append(g.kept, {{'s': r.s, 'e': r.e, 'label': r.label, 'score': r.score}}) ELSE g.kept END FROM {name}_walk g JOIN {name}_order r ON {on} AND r.k = g.k + 1",
        f"{name}_order",
    )
    cte(f"{name}", f"SELECT doc, sent, x.s AS s, x.e AS e, x.label AS label, x.score AS score FROM (SELECT doc, sent, unnest(kept) AS x FROM {name}_walk WHERE k = n)", f"{name}_walk")


_greedy("greedy_same", "doc, sent, label")
_greedy("greedy_any", "doc, sent")


@query("m8_suppressed_same_label", "SELECT doc, sent, s, e, label, round(score, 9) AS score FROM greedy_same", "greedy_same", recursive=True)
def _(spark, d):
    return spans.suppress_overlaps(i.scored_spans(spark, d)).withColumn("score", r9(F.col("score")))


@query("m8_suppressed_in_rounds", "SELECT doc, sent, s, e, label, round(score, 9) AS score FROM greedy_any", "greedy_any", recursive=True)
def _(spark, d):
    return spans.suppress_in_rounds(i.scored_spans(spark, d), same_label=False).withColumn("score", r9(F.col("score")))


@query("m8_suppressed_any_label", "SELECT doc, sent, s, e, label, round(score, 9) AS score FROM greedy_any", "greedy_any", recursive=True)
def _(spark, d):
    return spans.suppress_overlaps(i.scored_spans(spark, d), same_label=False).withColumn("score", r9(F.col("score")))


_NSYM, _NDIR = len(SYMMETRIC), len(DIRECTED)
_LABELS = "['" + "','".join([*SYMMETRIC, *DIRECTED]) + "']"
cte(
    "summed",
    f"SELECT a.doc, a.sent, a.s1, a.e1, a.s2, a.e2, list_transform(range(1, {_NSYM + 2 * _NDIR + 1}), lambda k: a.logp[k] + b.logp[CASE WHEN k <= {_NSYM} THEN k "
    f"WHEN k <= {_NSYM + _NDIR} THEN k + {_NDIR} ELSE k - {_NDIR} END]) AS v FROM logits a JOIN logits b ON a.doc = b.doc AND a.sent = b.sent "
    "AND a.s1 = b.s2 AND a.e1 = b.e2 AND a.s2 = b.s1 AND a.e2 = b.e1 WHERE a.s1 < a.s2", "logits",
)
cte(
    "decoded",
    "SELECT doc, sent, " + ", ".join(f"CASE WHEN k >= {_NSYM + _NDIR} THEN {b} ELSE {a} END AS {a}" for a, b in (("s1", "s2"), ("e1", "e2"), ("s2", "s1"), ("e2", "e1")))
    + f", ({_LABELS})[CASE WHEN k >= {_NSYM + _NDIR} THEN k - {_NDIR} ELSE k END + 1] AS label, score FROM "
    "(SELECT *, list_max(v) AS score, list_position(v, list_max(v)) - 1 AS k FROM summed) WHERE k > 0", "summed",
)


def _decoded(spark, d):
    return spans.decode_relations(i.relation_logits(spark, d), SYMMETRIC, DIRECTED)


@query("m9_decoded_relations", f"SELECT {_ENDS}, label, score FROM decoded", "decoded")
def _(spark, d):
    return _decoded(spark, d)


def _decoded_pairs(spark, d):
    """(predicted entities within the span budget, decoded relations of all their pairs)."""
    pruned = durable(spans.prune_spans(i.scored_spans(spark, d), i.sentence_rows(spark, d)), "pruned")
    return pruned, spans.decode_relations(i.pair_logits(pruned, both=True), SYMMETRIC, DIRECTED)


@query("m9_decoded_relations_all_pairs")
def _(spark, d):
    """All pairs of a sentence, as the reference scores them; m9_decoded_relations and its twin stop at 3 tokens."""
    return _decoded_pairs(spark, d)[1]


def _prf_sql(cor: str, pred: str, gold: str, prefix: str) -> str:
    return (
        f"round({cor} / {pred}::DOUBLE, 9) AS {prefix}precision, round({cor} / {gold}::DOUBLE, 9) AS {prefix}recall, "
        f"round(CASE WHEN {cor} > 0 THEN 2 * ({cor} / {pred}::DOUBLE) * ({cor} / {gold}::DOUBLE) / (({cor} / {pred}::DOUBLE) + ({cor} / {gold}::DOUBLE)) ELSE 0 END, 9) AS {prefix}f1"
    )


@query(
    "m10_entity_scores",
    f"SELECT {_prf_sql('c', 'p', 'g', '')}, {_prf_sql('ca', 'pa', 'g', 'all_')} FROM (SELECT (SELECT count(*) FROM gold) AS g, (SELECT count(*) FROM greedy_same) AS p, "
    "(SELECT count(*) FROM greedy_same SEMI JOIN gold USING (doc, sent, s, e, label)) AS c, (SELECT count(*) FROM spans) AS pa, "
    "(SELECT count(*) FROM spans SEMI JOIN gold USING (doc, sent, s, e, label)) AS ca)", "gold", "spans", "greedy_same", recursive=True,
)
def _(spark, d):
    df = spans.entity_scores(i.scored_spans(spark, d), i.gold(spark, d))
    return df.select(*[r9(F.col(c)).alias(c) for c in df.columns])


cte("full_gold", f"SELECT {_ENDS}, label FROM relations UNION SELECT doc, sent, s2, e2, s1, e1, label FROM relations WHERE label IN {_SYMS}", "relations")


def _typed(table: str, ents: str) -> str:
    return (
        f"SELECT t.*, coalesce(a.label, 'NIL') AS type1, coalesce(b.label, 'NIL') AS type2 FROM {table} t LEFT JOIN {ents} a ON a.doc = t.doc AND a.sent = t.sent AND a.s = t.s1 AND a.e = t.e1 "
        f"LEFT JOIN {ents} b ON b.doc = t.doc AND b.sent = t.sent AND b.s = t.s2 AND b.e = t.e2"
    )


cte("typed_decoded", _typed("decoded", "spans"), "decoded", "spans")
cte("typed_gold", _typed("full_gold", "gold"), "full_gold", "gold")


@query(
    "m11_relation_scores",
    f"SELECT {_prf_sql('c', 'p', 'g', '')}, {_prf_sql('ct', 'p', 'g', 'typed_')} FROM (SELECT (SELECT count(*) FROM relations) AS g, (SELECT count(*) FROM decoded) AS p, "
    "(SELECT count(*) FROM typed_decoded SEMI JOIN typed_gold USING (doc, sent, s1, e1, s2, e2, label)) AS c, "
    "(SELECT count(*) FROM typed_decoded SEMI JOIN typed_gold USING (doc, sent, s1, e1, s2, e2, label, type1, type2)) AS ct)", "relations", "decoded", "typed_decoded", "typed_gold",
)
def _(spark, d):
    df = spans.relation_scores(_decoded(spark, d), i.gold_relations(spark, d), i.scored_spans(spark, d), i.gold(spark, d), SYMMETRIC[1:])
    return df.select(*[r9(F.col(c)).alias(c) for c in df.columns])


@query("m11_relation_scores_all_pairs")
def _(spark, d):
    pruned, decoded = _decoded_pairs(spark, d)
    df = spans.relation_scores(decoded, i.gold_relations(spark, d), pruned, i.gold(spark, d), SYMMETRIC[1:])
    return df.select(*[r9(F.col(c)).alias(c) for c in df.columns])


@query(
    "m12_folded_predictions",
    "SELECT doc, sent, coalesce(string_agg(s || '-' || e || '-' || label, ' ' ORDER BY s, e, label), '') AS predicted FROM sents LEFT JOIN spans USING (doc, sent) GROUP BY doc, sent", "sents", "spans",
)
def _(spark, d):
    folded = spans.fold_predictions(i.sentence_rows(spark, d), i.scored_spans(spark, d))
    text = F.transform("predicted", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"), x["label"]))
    return folded.select("doc", "sent", F.array_join(text, " ").alias("predicted"))


@query(
    "m13_label_inventory",
    "SELECT label, CAST(list_position(['NIL', 'Method', 'OtherScientificTerm', 'Task', 'Generic', 'Material', 'Metric'], label) - 1 AS INTEGER) AS label_id, count(*) AS used FROM gold GROUP BY label", "gold",
)
def _(spark, d):
    ids = spans.label_table(spark, ["scierc"]).filter("kind = 'entity'").select("label", "label_id")
    return i.gold(spark, d).join(F.broadcast(ids), "label").groupBy("label", "label_id").agg(F.count(F.lit(1)).alias("used"))
