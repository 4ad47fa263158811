"""Operator 9 against brute force."""

import random

import numpy as np
import pytest
from util import WORD, awkward, documents, empty

from fathomgraph.llm import jaccard
from fathomgraph.llm.components import components


def shingle_set(text, n=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute(rows, percent=80):
    """{id: (size, component)} by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[k] = f"new{rng.randrange(10**6)}"
        elif kind == 1 and len(words) > 2:
            del words[k]
        else:
            words.insert(k, f"put{rng.randrange(10**6)}")
    return words


def corpus(seed, groups=25):
    """Groups of copies with few edits, chains of edits, short texts, and a passage that many texts share."""
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 6, 8, 10, 12, 14, 18, 25, 40, 80, 200]))
        if rng.random() < 0.4:
            base = base[: len(base) // 3] + passage + base[len(base) // 3 :]
        now = base
        for _ in range(rng.randrange(1, 9)):
            now = edited(rng, now if rng.random() < 0.5 else base, rng.choice([0, 0, 1, 1, 2, 4]) * (1 + len(base) // 100))
            rows.append(" ".join(now) if rng.random() < 0.8 else "\n".join(w.upper() for w in now))
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_BUCKETS", 4)


@pytest.mark.parametrize("seed,percent", [(1, 80), (2, 80), (3, 60)])
def test_equals_brute_force(spark, seed, percent):
    rows = corpus(seed)
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    assert result(jaccard.jaccard_groups(docs, percent)) == brute(rows, percent)


@pytest.mark.parametrize("boundary", [0, 6, 12])
def test_equals_brute_force_at_any_boundary(spark, boundary, monkeypatch):
    monkeypatch.setattr(jaccard, "choose_boundary", lambda sizes, percent: boundary)
    rng = random.Random(boundary)
    base = [[f"b{g}w{k}" for k in range(rng.randrange(4, 20))] for g in range(12)]
    rows = list(enumerate([" ".join(edited(rng, b, rng.randrange(3))) for b in base for _ in range(6)], 1))
    assert result(jaccard.jaccard_groups(documents(spark, [(i, t, "en", "s") for i, t in rows]))) == brute(rows)


def test_links_through_lists_longer_than_short(spark, monkeypatch):
    """Many texts share most of a passage without linking; those that link among them are found all the same."""
    monkeypatch.setattr(jaccard, "SHORT", 4)
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for g in range(8):
        own = [f"g{g}w{k}" for k in range(rng.choice([6, 9, 12]))]
        rows += [" ".join(passage + own), " ".join(passage + own[:-1] + [f"g{g}z"])]
    rows = list(enumerate(rows, 1))
    assert result(jaccard.jaccard_groups(documents(spark, [(i, t, "en", "s") for i, t in rows]))) == brute(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = jaccard.jaccard_groups(docs).collect()
    assert len(rows) == docs.count()
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert got[None, 1] is None and got[1, 7] == 1 and got[2, 7] == 1 and got[3, 0] == 3 and got[4, 0] == 4 and got[5, 0] == 5
    assert got[8, 1] == 8 and got[9, 1] == 8
    assert jaccard.jaccard_groups(empty(spark)).count() == 0


def test_large_group_of_near_copies_makes_few_pairs(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(edited(rng, base, 1)), "en", "s") for i in range(600)]
    got = result(jaccard.jaccard_groups(documents(spark, rows)))
    assert {c for _, c in got.values()} == {0}


def test_boundary_weighs_subsets_against_prefixes():
    assert jaccard.choose_boundary({}, 80) == 0
    few = jaccard.choose_boundary({k: 100 for k in range(1, 60)}, 80)
    assert 4 <= few < 20
    assert jaccard.least_overlap(5, 4, 80) == 4 and jaccard.prefix_length(10, 80) == 3 and list(jaccard.partner_sizes(5, 80)) == [4, 5, 6]


def test_shingles_by_words(spark):
    def of(text):
        return jaccard.shingles(np.frombuffer(text.encode(), dtype=np.uint8))

    assert len(of("a b c d e f")) == 2 and len(of("a b a b a b a b a b")) == 2 and len(of("A\tb")) == 1 and (of("A\tb") == of("a  B ")).all()
    assert len(of("")) == 0 and len(of(" \n")) == 0 and (of("a b") != of("ab")).all() and (of("a b") != of("a b")).all()


def test_components_of_chains_stars_and_cycles(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(201, 202), (202, 203), (203, 201), (300, 300)] + [(39, 500)]
    links += [(None, 4), (4, None), (2, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 1 for k in range(1, 40)) and got[500] == 1 and got[203] == 201 and 300 not in got
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    root = {k: k for k in range(300)}
    for _ in range(300):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: root[k] for a, b in links if a != b for k in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
