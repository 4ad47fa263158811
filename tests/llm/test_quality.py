"""Operator 6: base figures against plain Python, the model against a plain Kneser-Ney, bands."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from util import WORD, awkward, documents, empty

from fathomgraph.llm import quality


def brute_figures(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = set()
    for k in range(len(words) - 4):
        if windows[tuple(words[k : k + 5])] > 1:
            covered |= set(range(k, k + 5))
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.mark.parametrize("text", ["", "a", " a  b\n\nb\n b\n", "x y z w v x y z w v", "a a a a a a a", "é ñ# *ü|\x0b<>\x85 \xa0日本", "one two\none two\none two\n", "a b c d e f a b c d e g a b c d e"])
def test_base_figures(text):
    assert quality.base_figures(text, np.frombuffer(text.encode(), dtype=np.uint8)) == brute_figures(text)


def test_base_figures_of_random_texts():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "a b ", "#"]) for _ in range(rng.randrange(120)))
        assert quality.base_figures(text, np.frombuffer(text.encode(), dtype=np.uint8)) == brute_figures(text)


def plain_model(texts):
    """Modified Kneser-Ney over symbol classes, by dictionaries."""
    top = Counter()
    for t in texts:
        s = [0] * (quality.ORDER - 1) + quality.symbols(t).tolist()
        top.update(tuple(s[k : k + quality.ORDER]) for k in range(len(s) - quality.ORDER + 1))
    levels = {quality.ORDER: top}
    for k in range(quality.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts, totals, freed = {}, {}, {}
    for k, grams in levels.items():
        t = Counter(grams.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else None
        d = {c: min(max(c - (c + 1) * y * t[c + 1] / t[c] if t[c] and y is not None else 0.5 * c, 0.1 * c), 0.95 * c) for c in (1, 2, 3)}
        cuts[k] = lambda n, d=d: d[min(n, 3)]
        totals[k], freed[k] = defaultdict(int), defaultdict(float)
        for g, n in grams.items():
            totals[k][g[:-1]] += n
            freed[k][g[:-1]] += cuts[k](n)

    def p(g):
        if not g:
            return 1 / quality.SYMBOLS
        k = len(g)
        if not totals[k][g[:-1]]:
            return p(g[1:])
        n = levels[k][g]
        return max(n - cuts[k](n), 0) / totals[k][g[:-1]] + freed[k][g[:-1]] / totals[k][g[:-1]] * p(g[1:]) if n else freed[k][g[:-1]] / totals[k][g[:-1]] * p(g[1:])

    return p


def mean_nll(p, text):
    s = [0] * (quality.ORDER - 1) + quality.symbols(text).tolist()
    return -sum(math.log(p(tuple(s[k : k + quality.ORDER]))) for k in range(len(s) - quality.ORDER + 1)) / len(quality.symbols(text))


def sentences(seed, n, syllables):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    return [" ".join(word() for _ in range(rng.randint(30, 120))) + "." for _ in range(n)]


EN, DE = ["th", "er", "an", "on", "re", "he", "in", "ed"], ["ung", "sch", "ein", "ich", "ver", "ge"]


def test_model_equals_a_plain_one(spark):
    texts = sentences(1, 30, EN)
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    model = quality.load_model(quality.train(docs), "x656e")
    p = plain_model(texts)
    for text in [*texts[:3], "never Seen !! xyzzy 42", "qq"]:
        logs = model.log_probabilities(quality.grams(text))
        assert -float(logs.astype(np.float64).mean()) == pytest.approx(mean_nll(p, text), rel=1e-4)
    every = [int(c) for c in range(quality.SYMBOLS)]  # a distribution after any context
    for context in ("the", "zz", ""):
        start = int(quality.grams(context)[-1]) if context else 0
        codes = np.array([((start << quality.BITS) & ((1 << quality.BITS * quality.ORDER) - 1)) | c for c in every], dtype=np.uint32)
        assert np.exp(model.log_probabilities(codes)).sum() == pytest.approx(1, abs=1e-3)


def test_bands_reject_strange_texts_and_keep_the_rest(spark):
    texts = [("en", t) for t in sentences(2, 150, EN)] + [("de", t) for t in sentences(3, 60, DE)]
    rng = random.Random(6)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0+/", k=7)) for _ in range(150))
    odd = [("en", noise), ("en", " ".join(f"{'thethe'[: 1 + k % 5]}" + "e" * (k + 3) for k in range(60))), ("de", "a " * 12 + "b c d e f g")]
    rows = [(k, t, lang, "s") for k, (lang, t) in enumerate(texts + odd)]
    got = {r["doc_id"]: r for r in quality.score_documents(documents(spark, rows)).collect()}
    assert all(got[k]["kept"] for k in range(len(texts)))
    high, low = got[len(texts)], got[len(texts) + 1]
    assert not high["base_failed"] and high["perplexity"] > high["upper"] and not high["kept"]
    assert not low["base_failed"] and low["perplexity"] < low["lower"] and not low["kept"]
    for k, text, _, _ in rows:
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_figures(text)


def test_a_copy_group_of_a_third_of_all_rows_moves_nothing(spark):
    clean = [("en", t) for t in sentences(2, 150, EN)] + [("de", t) for t in sentences(3, 60, DE)]
    rng = random.Random(8)
    rows = list(clean)
    for lang, syllables, n in (("en", EN, 75), ("de", DE, 30)):
        one = sentences(9, 1, syllables)[0].split(" ")
        near = [one[:k] + [rng.choice(one)] + one[k + 1 :] for k in (rng.randrange(len(one)) for _ in range(n))]
        rows += [(lang, " ".join(one))] * n + [(lang, " ".join(x)) for x in near]
    documented = documents(spark, [(k, t, lang, "s") for k, (lang, t) in enumerate(rows)])
    got = {r["doc_id"]: r for r in quality.score_documents(documented).collect()}
    assert len(got) == len(rows) and [k for k in range(len(clean)) if not got[k]["kept"]] == []
    alone = {r["doc_id"]: r for r in quality.score_documents(documents(spark, [(k, t, lang, "s") for k, (lang, t) in enumerate(clean)])).collect()}
    for k in (0, 150):
        assert got[k]["upper"] / got[k]["lower"] == pytest.approx(alone[k]["upper"] / alone[k]["lower"], rel=0.5)


def test_exact_copies_leave_the_counts(spark):
    texts = sentences(5, 20, EN)
    once = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]).select("lang", "text")
    again = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts + texts[:1] * 10)]).select("lang", "text")
    assert sorted(map(tuple, quality.gram_counts(once).collect())) == sorted(map(tuple, quality.gram_counts(again).collect()))


def test_rare_languages_are_judged(spark):
    texts = [("en", t) for t in sentences(2, 150, EN)] + [("de", t) for t in sentences(3, 60, DE)] + [("xx", t) for t in sentences(4, 5, EN)] + [(None, t) for t in sentences(7, 5, DE)]
    rng = random.Random(6)
    noise = [" ".join("".join(rng.choices("bcdfgjklmpqvwxyz0+/", k=7)) for _ in range(150)) for _ in range(2)]
    rows = [(k, t, lang, "s") for k, (lang, t) in enumerate([*texts, ("xx", noise[0]), (None, noise[1])])]
    got = {r["doc_id"]: r for r in quality.score_documents(documents(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[k]["kept"] for k in range(len(texts)))
    for k in (len(texts), len(texts) + 1):
        assert not got[k]["base_failed"] and got[k]["perplexity"] > got[k]["upper"] and not got[k]["kept"]


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = quality.score_documents(docs).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r for r in rows}
    assert got[3]["n_words"] == 0 and got[3]["base_failed"] and not got[3]["kept"] and got[1]["kept"] and not got[1]["base_failed"]
    assert got[6]["n_words"] == 30_000 and got[None]["base_failed"]
    assert quality.score_documents(empty(spark)).count() == 0
