"""Steps that stay within a sentence, against plain loops on rows with repeated and missing keys."""

import random
from collections import Counter

import pytest

from fathomgraph.operators import evaluate, optimality, spans
from fathomgraph.plans import inputs as i

ENTS = "doc long, sent int, s int, e int, label string"


def _exchanges(df, *words):
    """Shuffles that move rows with one of the words in the partitioning."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and any(w in line for w in words)]


def _bag(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def held():
    random.seed(3)
    rows = [(random.choice([0, 1, 2, None]), random.randint(0, 1), s := random.randint(0, 150), s + random.randint(0, 1), random.choice("ab")) for _ in range(60)]
    return rows + rows[:6]


def test_labels_of_candidates_meet_cells_only(spark, held):
    sents = [(0, 0, 0, 160), (0, 1, 60, 70), (1, 0, 3, 1), (1, 1, 5, 0), (2, 0, 127, 3), (None, 0, 0, 150), (2, 0, 127, 3)]
    df = spark.createDataFrame([(d, k, o, ["x"] * n) for d, k, o, n in sents], "doc long, sent int, offset int, tokens array<string>")
    got = spans.label_spans(df, spark.createDataFrame(held, ENTS), 4)
    want = Counter()
    for d, k, o, n in sents:
        for s in range(o, o + n):
            for e in range(s, min(s + 4, o + n)):
                labels = [x[4] for x in held if x[:4] == (d, k, s, e) and d is not None] or ["NIL"]
                want.update((d, k, s, e, label) for label in labels)
    assert _bag(got) == want and any(x[4] != "NIL" for x in want)
    assert _bag(spans.candidate_spans(df, 4)) == Counter((d, k, s, e) for d, k, o, n in sents for s in range(o, o + n) for e in range(s, min(s + 4, o + n)))
    assert not _exchanges(got, " s#", " e#", "s#", "e#L")  # spans themselves are not shuffled


def test_entity_pairs_and_expanded_relations(spark, held):
    relations = [(d, k, a, a + 1, b, b + 1, x) for d, k, a, b, x in ((0, 0, 1, 5, "COMPARE"), (0, 0, 5, 1, "PART-OF"), (0, 0, 2, 2, "PART-OF"), (1, 0, 3, 4, "USED-FOR"), (None, 0, 1, 2, "COMPARE"))]
    relations.append(relations[3])
    df = spark.createDataFrame(relations, "doc long, sent int, s1 int, e1 int, s2 int, e2 int, label string")
    expanded = spans.expand_relations(df, i.SYMMETRIC, i.DIRECTED)
    turn = lambda r: (*r[:2], *r[4:6], *r[2:4])
    have = {r[:6] for r in relations if r[0] is not None}
    classes = spans.relation_classes(i.SYMMETRIC, i.DIRECTED)
    want = [(*r, False) for r in relations] + [(*turn(r), r[6] if r[6] in i.SYMMETRIC else r[6] + "^-1", True) for r in relations if turn(r) not in have]
    want = Counter((*r, classes.index(r[6])) for r in want)
    assert _bag(expanded) == want
    ents = held + [(0, 0, s, s + 1, "a") for s in (1, 5, 2)] + [(1, 0, 4, 5, "a"), (1, 0, 3, 4, "b")]
    got = spans.entity_pairs(spark.createDataFrame(ents, ENTS), expanded)
    pairs = Counter()
    for a in ents:
        for b in ents:
            if a[:2] == b[:2] and a[0] is not None:
                ids = [x[8] for x in want.elements() if x[:6] == (*a[:4], *b[2:4])] or [0]
                pairs.update((*a[:4], *b[2:4], x) for x in ids)
    assert _bag(got) == pairs and any(x[6] for x in pairs)


def test_decoded_pairs_and_their_types_are_not_shuffled(spark, held):
    pruned = spark.createDataFrame(held, ENTS)
    decoded = spans.decode_relations(i.pair_logits(pruned), i.SYMMETRIC, i.DIRECTED)
    assert not _exchanges(decoded, "_a#", "s1#")
    typed = spans.with_end_types(decoded, pruned)
    assert not _exchanges(typed, "_a#", "s1#", "s2#")
    labels = lambda d, k, s, e: [x[4] for x in held if x[:4] == (d, k, s, e)] or ["NIL"]
    rows = decoded.collect()
    want = Counter((*r, t, u) for r in map(tuple, rows) for t in labels(*r[:4]) for u in labels(*r[:2], *r[4:6]))
    assert rows and _bag(typed) == want


def test_relations_near_each_other_meet_in_one_shuffle(spark, held):
    got = i._with_following(spark.createDataFrame(held, ENTS), 3, 4)
    want = Counter((*a[:4], *b[2:4]) for a in held for b in held if a[:2] == b[:2] and a[0] is not None and 1 <= b[2] - a[2] <= 3)
    assert len(_exchanges(got, "doc")) == 1 and want and _bag(got) == want


def test_scores_are_counted_in_one_pass(spark):
    gold = spark.createDataFrame([(0, 0, 1, 1, 2, 2, "COMPARE"), (0, 0, 4, 4, 6, 6, "PART-OF")], "doc long, sent int, s1 int, e1 int, s2 int, e2 int, label string")
    predicted = spark.createDataFrame([(0, 0, 2, 2, 1, 1, "COMPARE", 1.0), (0, 0, 4, 4, 6, 6, "PART-OF", 1.0), (1, 0, 4, 4, 6, 6, "PART-OF", 1.0)], gold.schema.simpleString()[7:-1].replace(":", " ") + ", score double")
    ents = spark.createDataFrame([(0, 0, 1, 1, "a"), (0, 0, 2, 2, "b"), (0, 0, 4, 4, "a")], ENTS)
    other = spark.createDataFrame([(0, 0, 1, 1, "a"), (0, 0, 2, 2, "b"), (0, 0, 4, 4, "b")], ENTS)
    row = spans.relation_scores(predicted, gold, ents, other, ["COMPARE"]).first()
    assert (row.precision, row.recall, row.typed_precision, row.typed_recall) == (2 / 3, 1.0, 1 / 3, 0.5)


def test_no_rows_fit_no_model(spark):
    rows = spark.createDataFrame([], "x double, label int")
    model, score = evaluate.fit_impact(rows, ["x"], maxIter=5)
    assert model is None and score(rows).schema["score"].dataType.simpleString() == "double" and score(rows).isEmpty()
    slopes = optimality.impact_gradient(rows, ["x"], "label", [None], None, 0.01).collect()
    assert [tuple(r) for r in slopes] == [("(intercept)", None, None), ("x", None, None)]
