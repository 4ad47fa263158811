import random
import re
from collections import Counter

import pytest
from util import awkward, documents, empty

from fathomgraph.llm import phrases


def plain(rows, least, top=2000):
    """Counts of all runs by loops, in whole numbers."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    out = []
    held = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in held.items():
        longer = [f for (l2, q), f in held.items() if l2 == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * f >= 80 * a for f in longer):
            continue
        cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)
        out.append((lang, " ".join(p), a, l, r, totals[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, k, *o[1:]) for k, o in enumerate(own[:top], 1)]
    return sorted(ranked)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["Ünï", "日本", "A", "B"]
    fixed = ["the Quick brown fox", "of the", "new york city hall", "a a a a"]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(0, 25)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", ":"]))
        rows.append((k, "".join(parts), rng.choice(["en", "en", "fr", None]), "s"))
    return rows


@pytest.mark.parametrize("least,shards", [(4, 10), (7, 3), (30, 10), (5, 1)])
def test_equals_counts_by_loops(spark, monkeypatch, least, shards):
    monkeypatch.setattr(phrases, "MIN_COUNT", least)
    monkeypatch.setattr(phrases, "SHARDS", shards)
    rows = corpus(least)
    want = plain([(t, lang) for _, t, lang, _ in rows], least)
    assert want and got(phrases.collocations(documents(spark, rows).repartition(6))) == want


def test_small_slices_and_a_full_map_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MIN_COUNT", 5)
    monkeypatch.setattr(phrases, "HELD_WORDS", 50)
    monkeypatch.setattr(phrases, "SLICE", 200)
    monkeypatch.setattr(phrases, "MAP_BITS", 64)  # full at once, so that it lets everything through
    rows = corpus(9)
    assert got(phrases.collocations(documents(spark, rows).repartition(3), top=11)) == plain([(t, lang) for _, t, lang, _ in rows], 5, top=11)


def test_awkward_repeated_and_empty_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MIN_COUNT", 2)
    docs = awkward(spark)
    assert got(phrases.collocations(docs)) == plain([(r["text"], r["lang"]) for r in docs.collect()], 2)
    assert got(phrases.collocations(empty(spark))) == []


def test_lowered_support_prunes_before_the_union(spark, monkeypatch):
    """Pairs that occur once or twice in a shard are never counted globally, unless other shards make them frequent."""
    rows = [(k, f"rare{k} pair{k} common words", "en", "s") for k in range(400)]
    mined = []
    real = phrases._candidates
    monkeypatch.setattr(phrases, "_candidates", lambda m: mined.append((m.count(), real(m).count())) or real(m))
    assert [r[2] for r in got(phrases.collocations(documents(spark, rows).repartition(5)))] == ["common words"]
    assert mined[0][1] <= 2  # of the runs of frequent words
