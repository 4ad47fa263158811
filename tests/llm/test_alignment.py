import hashlib
from collections import Counter

import pytest
from util import awkward, documents, empty

from fathomgraph.llm import alignment

PATHS = alignment.vocabulary_paths()


def plain(rows):
    """Whole texts, encoded at once, groups from the sets of ends, all pairs by loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    alphabet = alignment._byte_alphabet()
    out, held = [], Counter()
    for doc_id, text in rows:
        want = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(x)) for x in ids_a]
        pieces = [b.id_to_piece(x) for x in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(ids_b, pieces)]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            out.append([doc_id, 0, 0, 0, "", []])
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at, places = 0, []
            for p in parts:
                at += len(p)
                places.append(at)
            ends.append(places)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for stop in common:
            one, two = [], []
            while i < len(ids_a) and ends[0][i] <= stop:
                one.append(ids_a[i])
                i += 1
            while j < len(ids_b) and ends[1][j] <= stop:
                two.append(ids_b[j])
                j += 1
            groups.append((one, two))
        links = [(x, y) for one, two in groups for x in one for y in two]
        held.update(set(links))
        written = ";".join(f"{','.join(map(str, one))}|{','.join(map(str, two))}" for one, two in groups)
        out.append([doc_id, len(ids_a), len(ids_b), len(groups), hashlib.sha256(written.encode()).hexdigest(), links])
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(d, n_a, n_b, n_g, len(links), sha, sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links)) for d, n_a, n_b, n_g, sha, links in out]


def got(df):
    return [tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()]


def text_order(rows):
    return sorted(rows, key=repr)


TEXTS = [
    "plain words, twice: plain words", "two  spaces   and\ttabs \n lines\n\nend ", " leading", "trailing  ", "a b 　 c  d", "日本語のテキスト です", "😀 😀😀 x",
    "<|endoftext|> and <s> </s> <0x41>", "has ▁ inside", "\x00 \x1c x \x85 y\r\nz", "ﬁ é é", "1234567890 12,5 'll don't", "x" * 3000, " ", "\n", "ab" * 2500 + " " + "é" * 700,
]


@pytest.mark.parametrize("bound", [alignment.BROADCAST_PAIRS, 0])
def test_equals_whole_texts_by_loops(spark, bound):
    rows = [(k, t, "en", "s") for k, t in enumerate(TEXTS)] + [(3, TEXTS[0], "en", "s"), (None, "no id", "en", None), (40, None, None, None), (41, "", None, None)]
    docs = documents(spark, rows)
    assert text_order(got(alignment.score_alignments(docs, *PATHS, broadcast_pairs=bound))) == text_order(plain([r[:2] for r in rows]))


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert text_order(got(alignment.score_alignments(docs, *PATHS))) == text_order(plain(rows))
    assert got(alignment.score_alignments(empty(spark), *PATHS)) == []
    assert got(alignment.score_alignments(empty(spark), *PATHS, broadcast_pairs=-1)) == []


def test_forgetting_and_wide_groups_change_nothing(monkeypatch):
    texts = ["some words here", None, "ab" * 40 + " zz", "some other words"]
    want = alignment.Chunks(*PATHS).documents(texts)
    monkeypatch.setattr(alignment, "REMEMBERED_CHUNKS", 1)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 0)
    short = alignment.Chunks(*PATHS)
    for _ in range(2):
        have = short.documents(texts)
        for x, y in zip(want, have):
            assert list(map(str, x)) == list(map(str, y))


def test_uncut_texts_give_the_same(monkeypatch):
    whole = alignment.Chunks(*PATHS)
    assert whole.cuts
    whole.cuts = False
    cut = alignment.Chunks(*PATHS)
    for x, y in zip(whole.documents(TEXTS), cut.documents(TEXTS)):
        assert list(map(str, x)) == list(map(str, y))
