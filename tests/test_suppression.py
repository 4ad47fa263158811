"""Suppression in rounds equals the fold over one array, and long lines end."""

import random
import time

import pytest
from fathomgraph.operators import spans

SPANS = "doc int, sent int, s int, e int, label string, score double"


def rows(seed, n=400, levels=8):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.randrange(60)
        out.append((rng.randrange(3), rng.randrange(2), s, s + rng.randrange(20), rng.choice("AB"), rng.randrange(levels) / levels))
    return out + out[:20]


@pytest.mark.parametrize("seed,same_label,window,rounds", [(1, True, 16, 6), (2, False, 4, 1), (3, False, 16, 0), (4, True, 64, 20)])
def test_equals_the_fold(spark, seed, same_label, window, rounds):
    df = spark.createDataFrame(rows(seed), SPANS)
    want = sorted(map(tuple, spans.suppress_overlaps(df, same_label).collect()))
    got = spans.suppress_in_rounds(df, same_label, window, rounds)
    assert sorted(map(tuple, got.collect())) == want


def test_a_line_of_many_tokens_and_a_chain(spark):
    rng = random.Random(9)
    n = 100_000
    line = [(0, 0, s, s + rng.randrange(8), rng.choice("AB"), rng.random()) for s in range(n)]
    chain = [(1, 0, s, s + 1, "A", -float(s)) for s in range(20_000)]  # each beats the next: every other one stays
    start = time.time()
    got = spans.suppress_in_rounds(spark.createDataFrame(line + chain, SPANS), same_label=False).collect()
    assert time.time() - start < 240
    assert sorted(r["s"] for r in got if r["doc"] == 1) == list(range(0, 20_000, 2))
    ends = sorted((r["s"], r["e"]) for r in got if r["doc"] == 0)
    assert all(b[0] > a[1] for a, b in zip(ends, ends[1:])) and len(ends) > n / 10


def test_empty(spark):
    assert spans.suppress_in_rounds(spark.createDataFrame([], SPANS)).collect() == []
