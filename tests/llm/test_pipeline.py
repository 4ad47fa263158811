"""The pipeline: each stage's decisions take effect, and the columns stay."""

import random

import corpus_pipeline as pipeline
from fathomgraph.llm import mixing
from util import WORD, awkward, documents, empty

KEY = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=40))


def corpus(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices(["the", "re", "an", "on", "st", "er", "ing", "al"], k=rng.randint(1, 3))) for _ in range(500)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(30, 150))), "en", f"s{k % 3}") for k in range(60)]
    near = rows[5][1].split()
    near[3] = "changed"
    rows += [(100, rows[0][1], "en", "s1"), (101, " ".join(near * 1), "en", "s2"), (102, "too short", "en", "s0"), (103, "again " * 50, "en", "s0"), (104, rows[7][1] + f" token={KEY} end", "en", "s1")]
    rows += [(105, None, "en", "s0"), (106, " ".join(rng.choices(vocabulary, k=90)) + f" key {KEY} end", None, None), (None, " ".join(rng.choices(vocabulary, k=50)), "en", "s1")]
    return documents(spark, rows)


def test_stages_one_after_the_other(spark):
    docs = corpus(spark)
    good = pipeline.quality_rules(spark, docs, "")
    assert good.columns == docs.columns
    ids = sorted((r["doc_id"] for r in good.collect()), key=str)
    assert len(ids) == docs.count() - 3 and not {102, 103, 105} & set(ids)

    single = pipeline.near_copies(spark, good, "")
    left = {r["doc_id"] for r in single.collect()}
    assert single.columns == docs.columns and single.count() == len(left) and {0, 7, None, 106} <= left and not {100} & left
    assert (5 in left) and len(ids) - len(left) in (1, 2, 3)

    clean = pipeline.secret_scan(spark, single, "")
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == docs.columns and KEY not in "".join(t or "" for t in text.values()) and "[secret]" in text[106]
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())

    mixed = pipeline.source_mix(spark, clean, "")
    assert mixed.columns == docs.columns
    taken = {}
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(WORD.findall(r["text"]))
    for r in mixing.mix_sources(clean).select("source", "target").distinct().collect():
        assert abs(taken[r["source"]] - r["target"]) <= max(3, 0.02 * r["target"])

    packed = pipeline.pack(spark, mixed, "").collect()
    assert sum(len(r["ids"]) for r in packed) > 0 and {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed.collect()}


def test_run_of_awkward_rows_and_of_none(spark, tmp_path):
    awkward(spark).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "a")).count() > 0
    empty(spark).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "b")).count() == 0
    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "source mixing", "packing"]


def test_near_copies_of_an_id_with_two_texts(spark):
    """An exact copy goes although its id has another text too, which stays."""
    one, two = " ".join(f"w{k}" for k in range(30)), " ".join(f"v{k}" for k in range(30))
    docs = documents(spark, [(2, one, "en", "a"), (5, one, "en", "a"), (5, two, "en", "a"), (7, two, "en", "a"), (None, one, "en", "a"), (8, None, "en", "a")])
    kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in pipeline.near_copies(spark, docs, "").collect()))
    assert kept == [(0, one), (2, one), (5, two), (8, "")]
