"""Operators 2, 3 and 5: mixing, packing, plane files."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from util import WORD, awkward, documents, empty

from fathomgraph.llm import mixing, packing, planes
from fathomgraph.llm.tokens import WordEncoder, vocabulary_path

PATH = vocabulary_path()


@pytest.fixture(scope="module")
def encode():
    whole = WordEncoder(PATH, independent=False)
    return lambda text: np.frombuffer(whole.encode([text])[0], dtype=whole.dtype).tolist()


def test_words_alone_give_the_ids_of_whole_texts(encode):
    texts = ["The END. the end, End.. A.B. 10. x9, 'S. don'T, (ok), J\u030c. end.,", "<|EndOfText|> UP. up", "It's a test's tést. Á x́ İstanbul ΣΑΣ 12 3.4 <|x|>", "a\x01b \x01 c", "", None, "don't  stop\x1cnow ok", "日本 語 😀!? <|endoftext|> z"]
    one = WordEncoder(PATH)
    for _ in range(2):  # the second time from what is remembered
        assert [np.frombuffer(x, dtype=one.dtype).tolist() for x in one.encode(texts)] == [encode(t) for t in texts]


def test_tokenizers_of_another_kind_are_read_whole():
    import json

    from fathomgraph.llm.alignment import vocabulary_paths
    from fathomgraph.llm.tokens import splits_at_white_space

    other = WordEncoder(vocabulary_paths()[0])
    assert not other.independent and not other.known_split
    text = "two  spaces, and\nlines. "
    assert np.frombuffer(other.encode([text])[0], dtype=other.dtype).tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids
    spec = json.loads(WordEncoder(PATH).tokenizer.to_str())
    assert splits_at_white_space(spec)
    assert not splits_at_white_space({**spec, "normalizer": {"type": "Strip"}}) and not splits_at_white_space({**spec, "pre_tokenizer": None})


def test_remembered_words_are_bounded(encode, monkeypatch):
    from fathomgraph.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED_WORDS", 5)
    one = WordEncoder(PATH)
    texts = [f"word{k} other{k} same" for k in range(20)]
    assert [np.frombuffer(x, dtype=one.dtype).tolist() for x in one.encode(texts[:9]) + one.encode(texts[9:])] == [encode(t) for t in texts]
    assert sum(len(t[0]) for t in one.known) <= 5


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files_round_trip(spark, encode, kind):
    docs = awkward(spark)
    files = planes.write_token_files(docs, PATH, kind=kind, block=1000)
    back = planes.read_token_files(files).orderBy("start").collect()
    ids = [r["doc_id"] for r in back]
    assert ids == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(encode(r["text"]) + [1])
    at = 0
    for r in back:
        assert r["start"] == at and r["ids"] in texts[r["doc_id"]]
        at += len(r["ids"])
    digests = {r["start"]: r for r in planes.read_token_digests(files).collect()}
    for r in back:
        assert digests[r["start"]]["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and digests[r["start"]]["n_tokens"] == len(r["ids"])


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1001])
def test_planes_transpose_back(kind, width, n):
    ids = np.random.default_rng(n).integers(0, 1 << (8 * width - 1), n).astype(f"<u{width}")
    parts = planes.to_planes(ids, kind, width)
    assert len(parts) == (width if kind == "byte" else 8 * width) and (planes.from_planes(parts, n, kind, width) == ids).all()


def test_a_cut_file_is_refused(spark, tmp_path):
    import pyarrow as pa

    planes.write_token_files(awkward(spark), PATH, folder=str(tmp_path / "x"))
    path = next((tmp_path / "x").glob("*.planes"))
    path.write_bytes(path.read_bytes()[:-3])
    with pytest.raises(ValueError):
        list(planes.read_documents(pa.OSFile(str(path))))


def test_plane_files_of_an_empty_table(spark):
    files = planes.write_token_files(empty(spark), PATH)
    assert files.count() == 0 and planes.read_token_digests(files).count() == 0


def check_packing(docs, pieces, encode, capacity=2048):
    rows = pieces.collect()
    assert all(r["capacity"] == capacity or r["capacity"] & (r["capacity"] - 1) == 0 for r in rows)
    sequences, parts = defaultdict(list), defaultdict(int)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for held in sequences.values():  # gapless, and no padding at all
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += len(r["ids"]) // 4
        assert at == held[0]["capacity"]
    wanted = defaultdict(int)
    for r in docs.collect():
        ids = encode(r["text"]) + [1]
        for k, x in enumerate(ids):
            wanted[r["doc_id"], k, x] += 1
    for r in rows:
        for k, x in enumerate(np.frombuffer(r["ids"], "<u4").tolist()):
            parts[r["doc_id"], r["start"] + k, x] += 1
    assert parts == wanted


def test_packing_holds_each_id_once(spark, encode):
    docs = awkward(spark)
    check_packing(docs, packing.pack_documents(docs, PATH), encode)
    check_packing(docs, packing.pack_documents(docs, PATH, capacity=128, shard_chars=20_000), encode, 128)


def test_shards_stay_bounded_under_one_key(spark, encode):
    text = " ".join(f"word{k}" for k in range(40))
    distinct = [(key, f"{k} {text}", "en", "s") for key in (None, 7) for k in range(200)]
    repeated = [(key, text, "en", "s") for key in (None, 8) for _ in range(200)]
    docs = documents(spark, distinct + repeated).repartition(4)
    pieces = packing.pack_documents(docs, PATH, capacity=128, shard_chars=20_000)
    check_packing(docs, pieces, encode, 128)
    sizes = pieces.groupBy(F.shiftright("sequence_id", 32)).agg(F.sum(F.octet_length("ids") / 4).alias("n")).toPandas()["n"]
    assert len(sizes) >= 10 and sizes.max() < 2 * sizes.mean()


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(empty(spark), PATH).count() == 0


def plain_place(lengths, capacity, linear, quadratic):
    """The dealt rule by a loop over all sequences: the longest piece left goes where it is cheapest among those with room."""
    whole, rest = divmod(sum(lengths), capacity)
    sizes = [capacity] * whole + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
    room, costs, pieces = list(sizes), [0.0] * len(sizes), [[] for _ in sizes]
    todo = sorted((-n, k, 0) for k, n in enumerate(lengths))
    while todo:
        n, k, start = todo.pop(0)
        n = -n
        fits = [s for s in range(len(sizes)) if room[s] >= n]
        if fits:
            s, put = min(fits, key=lambda s: (costs[s], s)), n
        else:
            s = max(range(len(sizes)), key=lambda s: (room[s], -s))
            put = room[s]
            todo = sorted([*todo, (put - n, k, start + put)])
        pieces[s].append((k, start, put))
        room[s] -= put
        costs[s] += linear * put + quadratic * put * put
    return sizes, pieces


def test_place_takes_the_cheapest_sequence_with_room():
    sizes, pieces = packing.place([6, 5, 4, 3, 2], 10, 1.0, 0.1)
    assert sizes == [10, 10] and [[n for _, _, n in p] for p in pieces] == [[6, 3, 1], [5, 4, 1]]
    assert packing.place([9, 9, 9], 10, 1.0, 0.1)[0] == [10, 10, 4, 2, 1]
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = sorted(rng.integers(1, 40, size=rng.integers(1, 40)).tolist(), reverse=True)
        assert packing.place(lengths, 40, 1.0, 0.05) == plain_place(lengths, 40, 1.0, 0.05)


def level_targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight; what exceeds the cap is shared again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, rest, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        share = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= cap * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
        open_ -= over
    return out


def mixable(spark, n=400):
    rows = [(k, " ".join(["w"] * (1 + k * k * 31 % 173)), "en", None if k % 13 == 0 else f"s{min(k % 7, 3)}") for k in range(n)]
    return documents(spark, [*rows, (n, None, "en", "s0"), (n, None, "en", "s0"), (n + 1, "", "en", "empty"), (n + 2, "a b c", "en", "tiny")])


def test_mix_meets_its_targets(spark):
    docs = mixable(spark)
    rows = mixing.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    wanted = level_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]])
    assert len(rows) == docs.count()
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= max(0.002 * target, 3)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    key = lambda r: (r["doc_id"], r["source"] or "", r["copies"])
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_rates_are_tilted_by_size(spark):
    """The rates solve the dual: one tilt per source, cut at the cap."""
    rows = [r for r in mixing.mix_sources(mixable(spark)).collect() if r["size"]]
    free = {r["source"] for r in rows if r["target"] < 2.999 * r["source_size"]} - {"tiny"}  # a source at its cap repeats everything
    assert len(free) >= 2
    for source in free:
        tilts = [np.log(r["rate"]) / r["size"] for r in rows if r["source"] == source and r["rate"] < 2.999]
        assert tilts and np.ptp(tilts) < 1e-5
        expected = sum(r["rate"] * r["size"] for r in rows if r["source"] == source)
        assert expected == pytest.approx(next(r["target"] for r in rows if r["source"] == source), rel=1e-4)


def test_mixed_documents_repeat_rows(spark):
    docs = mixable(spark, 60)
    counts = {(r["doc_id"], r["source"]): r["n"] for r in mixing.mix_sources(docs).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {(r["doc_id"], r["source"]): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    assert got == {k: n for k, n in counts.items() if n}


def test_mix_of_empty_and_wordless_tables(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0
    rows = mixing.mix_sources(documents(spark, [(1, None, "en", "a"), (2, " ", "en", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_folding_and_marks_where_they_are_delicate(encode):
    """Composed letters, special tokens in any case, marks after digits, letters and other marks, in one column."""
    texts = ["H̱ ẖ İ İx", "<|ENDOFTEXT|> a<|endoftext|>b", "Ends. 3, x., (y). é. é, A.B. a.", "WORD word Word WORD, word.", ".", ", .", "it's IT'S", "\x01 a\x01b", "Σ ΟΣ."]
    for order in (texts, texts[::-1], texts * 2):
        one = WordEncoder(PATH)
        assert [np.frombuffer(x, dtype=one.dtype).tolist() for x in one.encode(order)] == [encode(t) for t in order]
