"""Relations over all pairs of a sentence, against plain loops."""

import random
from collections import Counter

from fathomgraph.operators import spans
from fathomgraph.plans import inputs as i


def test_relations_of_all_pairs_of_a_sentence(spark):
    n_sym, n_dir = len(i.SYMMETRIC), len(i.DIRECTED)
    classes = n_sym + 2 * n_dir
    held = [(0, 0, s, s + s % 2) for s in (0, 1, 5, 12, 30)] + [(0, 1, 40, 41), (0, 1, 77, 77), (1, 0, 3, 4)]
    logits = i.pair_logits(spark.createDataFrame(held, "doc long, sent int, s int, e int"))
    ordered = {(a[:2], a[2:], b[2:]) for a in held for b in held if a[:2] == b[:2] and a != b}
    rows = logits.collect()
    assert len(rows) == 22 and {((r.doc, r.sent), (r.s1, r.e1), (r.s2, r.e2)) for r in rows} == ordered

    def score(s1, s2, k):
        return (s1 * 31 + s2 * 17 + k * 7 + s1 * k) % 101

    def reverse(k):
        return k if k < n_sym else k + n_dir if k < n_sym + n_dir else k - n_dir

    want = set()
    for sent, a, b in ordered:
        if a < b:
            total = [score(a[0], b[0], k) + score(b[0], a[0], reverse(k)) for k in range(classes)]
            k = total.index(max(total))
            if k:
                ends = (*b, *a) if k >= n_sym + n_dir else (*a, *b)
                want.add((*sent, *ends, [*i.SYMMETRIC, *i.DIRECTED][k - n_dir if k >= n_sym + n_dir else k], float(max(total))))
    got = spans.decode_relations(logits, i.SYMMETRIC, i.DIRECTED).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(abs(r.s1 - r.s2) > 3 for r in got)


def test_both_directions_in_a_row_decode_like_all_ordered_pairs(spark):
    """Repeated entities, nulls and entities with the same start; no row is sorted or shuffled to meet its reverse."""
    rng = random.Random(3)
    held = [(d, k, s, s + rng.randrange(3), "a") for d in range(3) for k in range(3) for s in rng.sample(range(40), 7)]
    held += held[:5] + held[:2] + [(0, 0, held[0][2], held[0][3] + 1, "b"), (None, 0, 1, 1, "a"), (None, 0, 2, 2, "a"), (1, None, 1, 1, "a"), (1, None, 4, 4, "a")]
    held += [(2, 2, None, 5, "a"), (2, 2, 6, None, "b")]
    ents = spark.createDataFrame(held, "doc long, sent int, s int, e int, label string")
    plain = spans.decode_relations(i.pair_logits(ents), i.SYMMETRIC, i.DIRECTED)
    met = spans.decode_relations(i.pair_logits(ents, both=True), i.SYMMETRIC, i.DIRECTED)
    assert met.schema == plain.schema or [f.dataType for f in met.schema] == [f.dataType for f in plain.schema]
    want = Counter(map(tuple, plain.collect()))
    assert Counter(map(tuple, met.collect())) == want and max(want.values()) >= 16
    text = met._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "Sort [" not in text


def test_relations_are_not_sorted_to_be_scored(spark):
    """Entities with the same ends give several types; each pair of types counts once."""
    ents = [(0, 0, 1, 1, "a"), (0, 0, 1, 1, "b"), (0, 0, 2, 2, None), (0, 1, 4, 4, "a"), (0, 1, None, 4, "a")]
    other = [(0, 0, 1, 1, "b"), (0, 0, 2, 2, "NIL"), (0, 1, 4, 4, "a")]
    names = "doc long, sent int, s int, e int, label string"
    gold = spark.createDataFrame([(0, 0, 1, 1, 2, 2, "PART-OF"), (0, 1, 4, 4, 6, 6, "COMPARE"), (0, 0, 1, 1, 2, 2, "PART-OF")], "doc long, sent int, s1 int, e1 int, s2 int, e2 int, label string")
    predicted = spark.createDataFrame([(0, 0, 1, 1, 2, 2, "PART-OF"), (0, 1, 6, 6, 4, 4, "COMPARE"), (0, 1, 6, 6, 4, 4, "PART-OF"), (5, 0, 1, 1, 2, 2, "PART-OF")], gold.schema)
    row = spans.relation_scores(predicted, gold, spark.createDataFrame(ents, names), spark.createDataFrame(other, names), ["COMPARE"]).first()
    # five rows of types: two of the first prediction, of which (b, NIL) is gold's
    assert (row.precision, row.recall, row.typed_precision, row.typed_recall) == (3 / 5, 1.0, 2 / 5, 2 / 3)
    plan = spans.with_end_types(predicted, spark.createDataFrame(ents, names))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    none = spans.relation_scores(predicted.limit(0), gold, spark.createDataFrame(ents, names), spark.createDataFrame(other, names), ["COMPARE"]).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)
