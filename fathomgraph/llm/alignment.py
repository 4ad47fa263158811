"""Alignment of two tokenizers by interval coalescing, and how often their ids meet over the corpus.

Both tokenizers read a space and the text. Tokens of both are intervals of bytes; sorted by start, a group ends where the
next start reaches the running maximum of the ends, which is where tokens of both end together. Within a group every A
token is linked with every B token.

Neither tokenizer has a token that goes from a character other than white space into a space (for A this follows from its
way of splitting, for B it is read off its pieces), so texts are cut there, each distinct chunk of a slice of texts is
encoded and coalesced once, and a text is the sum of its chunks. A worker remembers a bounded number of chunks. A B model
with pieces across words makes every text one chunk.

The documents' distinct id pairs are written once, their numbers of documents summed by Spark. A counted pair table of at
most ``BROADCAST_PAIRS`` rows is broadcast to score the links; a larger one is joined, with the pairs of the documents
dealt over ``SALTS`` copies of it, as one pair may be in every document.

Defined results: texts that are null, empty, or not restored byte by byte by both tokenizers have zeros and an empty digest;
strings of special tokens are plain text; repeated rows and ids are counted and returned once each; an empty table gives
no rows; of the input only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import public_columns, text_slices, tidy

#: Chunks a worker remembers, and the characters of all of them.
REMEMBERED_CHUNKS = 200_000
REMEMBERED_CHARS = 24_000_000
#: A pair table is broadcast up to this many counted rows of 17 bytes.
BROADCAST_PAIRS = 2_000_000
SALTS = 16
#: Groups with more links are counted by distinct ids, so that a long group never becomes all its pairs.
WIDE_GROUP = 4096


def _byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Chunks:
    """Encoded and coalesced chunks, in flat arrays; ``number`` gives a chunk's place."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        self.n_a, self.n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = [b""] * self.n_a
        for token, k in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[k] = bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.size_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        # Cuts before a space are safe if no piece goes on with one, and A is the byte-level kind with its usual way of splitting.
        spec = json.loads(self.a.to_str())
        usual = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True) and not spec.get("normalizer")
        self.cuts = bool(usual) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.text: list[str] = []  # groups as written in the digest
        self.sums = np.zeros((0, 4), dtype=np.int64)  # tokens of A, of B, groups, links
        self.whole = np.zeros(0, dtype=bool)  # restored by both
        self.first = np.zeros(1, dtype=np.int64)  # where a chunk's pairs begin
        self.codes = np.zeros(0, dtype=np.int64)
        self.times = np.zeros(0, dtype=np.int64)

    def parts(self, text: str) -> list[str]:
        """Chunks of a space and the text, each without its leading space."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if parts[-1] and all(p and not p[-1].isspace() for p in set(parts[:-1])):
            return parts
        out: list[str] = []
        held: list[str] = []
        for p in parts:
            held.append(p)
            if p and not p[-1].isspace():
                out.append(" ".join(held))
                held = []
        if held:  # white space at the end of the text stays with what is before it
            out[-1:] = [" ".join([*out[-1:], *held])]
        return out

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks, many in one call where both tokenizers restore them."""
        groups: list[list[str]] = [[]]
        size = 0
        for chunk in chunks:
            groups[-1].append(chunk)
            size += len(chunk)
            if size > 20_000 or not self.cuts or not chunk or chunk[-1].isspace():  # nothing may follow the white space at the end of a text
                groups.append([])
                size = 0
        sums, whole, counts, codes, times = [], [], [], [], []
        for group in filter(None, groups):
            found = self._encode(group)
            for one in [found] if found is not None else [self._encode([c], alone=True) for c in group]:
                sums.append(one[0])
                whole.append(one[1])
                counts.append(one[2])
                codes.append(one[3])
                times.append(one[4])
                self.text.extend(one[5])
        for chunk in chunks:
            self.number[chunk] = len(self.number)
            self.chars += len(chunk)
        self.sums = np.concatenate([self.sums, *sums])
        self.whole = np.concatenate([self.whole, *whole])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(counts))])
        self.codes = np.concatenate([self.codes, *codes])
        self.times = np.concatenate([self.times, *times])

    def _encode(self, chunks: list[str], alone: bool = False):
        joined = " ".join(chunks)
        ids_a = np.array(self.a.encode(" " + joined, add_special_tokens=False).ids, dtype=np.int64)
        ids_b = np.array(self.b.encode(joined, num_threads=1), dtype=np.int64)
        want = (" " + joined).encode("utf-8", "replace")
        same = b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == want and b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) == want
        if not same:
            if not alone:
                return None
            none = np.zeros(0, dtype=np.int64)
            return np.zeros((1, 4), dtype=np.int64), np.zeros(1, dtype=bool), np.zeros(1, dtype=np.int64), none, none, [""]
        return self._coalesce(chunks, ids_a, ids_b)

    def _coalesce(self, chunks: list[str], ids_a: np.ndarray, ids_b: np.ndarray):
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        start = np.concatenate([ends_a - self.size_a[ids_a], ends_b - self.size_b[ids_b]])
        end = np.concatenate([ends_a, ends_b])
        order = np.lexsort((end, start))
        reach = np.maximum.accumulate(end[order])
        breaks = np.ones(len(order), dtype=bool)
        breaks[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(breaks) - 1
        g_a, g_b = group[: len(ids_a)], group[len(ids_a) :]
        n_groups = int(group.max()) + 1
        begins = start[order][breaks]
        lengths = np.array([len(c.encode("utf-8", "replace")) + 1 for c in chunks], dtype=np.int64)
        chunk_of = np.searchsorted(np.cumsum(lengths), begins, side="right")
        per_a, per_b = np.bincount(g_a, minlength=n_groups), np.bincount(g_b, minlength=n_groups)
        links = per_a * per_b
        sums = np.stack([np.bincount(chunk_of, weights=x, minlength=len(chunks)) for x in (per_a, per_b, np.ones(n_groups), links)], axis=1).astype(np.int64)
        first_a, first_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        # Pairs of the narrow groups: each A token with the B tokens of its group.
        narrow = links <= WIDE_GROUP
        own = np.where(narrow[g_a], per_b[g_a], 0)
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first_b[g_a], own)
        code = np.repeat(ids_a, own) * self.n_b + ids_b[at]
        where = np.repeat(chunk_of[g_a], own)
        times = np.ones(len(code), dtype=np.int64)
        for g in np.flatnonzero(~narrow):
            one, n_one = np.unique(ids_a[first_a[g] : first_a[g] + per_a[g]], return_counts=True)
            two, n_two = np.unique(ids_b[first_b[g] : first_b[g] + per_b[g]], return_counts=True)
            code = np.concatenate([code, (one[:, None] * self.n_b + two[None, :]).ravel()])
            times = np.concatenate([times, (n_one[:, None] * n_two[None, :]).ravel()])
            where = np.concatenate([where, np.full(len(one) * len(two), chunk_of[g])])
        by_chunk = np.argsort(where, kind="stable")
        written_a, written_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        edge_a, edge_b = [*first_a.tolist(), len(ids_a)], [*first_b.tolist(), len(ids_b)]
        text: list[list[str]] = [[] for _ in chunks]
        for g, c in enumerate(chunk_of.tolist()):
            text[c].append(f"{','.join(written_a[edge_a[g]:edge_a[g + 1]])}|{','.join(written_b[edge_b[g]:edge_b[g + 1]])}")
        counts = np.bincount(where, minlength=len(chunks))
        return sums, np.ones(len(chunks), dtype=bool), counts, code[by_chunk], times[by_chunk], [";".join(t) for t in text]

    def documents(self, texts: list[str | None]):
        """For each text: its four sums, digest, and its distinct pairs (code, links) in order of code."""
        if len(self.number) > REMEMBERED_CHUNKS or self.chars > REMEMBERED_CHARS:
            self.forget()
        split = [self.parts(t) if t else [] for t in texts]
        new = {c for parts in split for c in parts}.difference(self.number)
        if new:
            self.learn(sorted(new))
        places = [list(map(self.number.__getitem__, parts)) for parts in split]
        sizes = np.array([len(p) for p in places], dtype=np.int64)
        flat = np.array([k for p in places for k in p], dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        good = np.ones(len(texts), dtype=bool)
        good[doc[~self.whole[flat]]] = False
        good &= sizes > 0
        keep = good[doc]
        flat, doc = flat[keep], doc[keep]
        sums = np.stack([np.bincount(doc, weights=self.sums[flat, k], minlength=len(texts)) for k in range(4)], axis=1).astype(np.int64)
        digests = [hashlib.sha256(";".join(map(self.text.__getitem__, p)).encode()).hexdigest() if ok else "" for p, ok in zip(places, good.tolist())]
        # Distinct chunks of a document, then their pairs, then distinct pairs.
        key, n = np.unique(doc * len(self.number) + flat, return_counts=True)
        doc, chunk = key // max(1, len(self.number)), key % max(1, len(self.number))
        count = self.first[chunk + 1] - self.first[chunk]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[chunk], count)
        pair = np.repeat(doc, count) * (self.n_a * self.n_b) + self.codes[at]
        times = self.times[at] * np.repeat(n, count)
        order = np.argsort(pair, kind="stable")
        pair, times = pair[order], times[order]
        head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, dtype=np.int64)
        times = np.add.reduceat(times, head) if len(head) else times
        pair = pair[head]
        edges = np.searchsorted(pair // (self.n_a * self.n_b), np.arange(len(texts) + 1))
        return sums, digests, pair % (self.n_a * self.n_b), times, edges


@lru_cache(maxsize=1)
def _chunks(path_a: str, path_b: str) -> Chunks:
    return Chunks(path_a, path_b)


def _blobs(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize
    data = pa.py_buffer(values.tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int64)), data]).cast(pa.binary())


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary"


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: counts, digest, and its distinct pairs, as little-endian numbers ``a * n_b + b`` and links (8 and 4 bytes each)."""
    docs = public_columns(docs, doc_id="doc_id", text="text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2_000_000):
            sums, digests, codes, times, edges = _chunks(path_a, path_b).documents(batch.column("text").to_pylist())
            columns = [batch.column("doc_id").cast(pa.int64()), *[pa.array(sums[:, k]) for k in range(4)], pa.array(digests, pa.string())]
            columns += [_blobs(codes.astype("<i8"), edges), _blobs(times.astype("<u4"), edges)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ALIGNED.split(", ")])

    return docs.mapInArrow(tidy(run), _ALIGNED)


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a binary column and where each row's begin."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = b"" if data is None else data
    width = np.dtype(kind).itemsize
    values = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].copy().view(kind) if len(data) else np.zeros(0, dtype=kind)
    return values, (offsets - offsets[0]) // width


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def combined() -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["pair", "n"])

    for batch in batches:
        held.append(_values(batch.column("pairs"), "<i8")[0])
        size += len(held[-1])
        if size > 4_000_000:
            yield combined()
            held, size = [], 0
    if size:
        yield combined()


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, a, n, best): documents that hold a pair linked, and whether no pair of its A id is in more."""
    n = aligned.select("pairs").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = durable(n.withColumn("a", F.expr(f"pair div {n_b}")), "pairs")
    top = n.groupBy("a").agg(F.max("n").alias("top"))
    return n.join(top, "a").select("pair", "a", "n", (F.col("n") == F.col("top")).alias("best"))


def _scored_by_broadcast(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    table = pairs.select("pair", "n", "best").orderBy("pair").toArrow().combine_chunks()
    held = aligned.sparkSession.sparkContext.broadcast([table.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])
    kept = [c for c in aligned.columns if c not in ("pairs", "links")]
    schema = aligned.select(*kept).schema.add("n_best", "long").add("count_sum", "long")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                codes, edges = _values(batch.column("pairs"), "<i8")
                links, _ = _values(batch.column("links"), "<u4")
                at = np.searchsorted(pair, codes)
                links = links.astype(np.int64)
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])
                columns = [batch.column(c) for c in kept]
                columns += [pa.array(total(np.where(best[at], links, 0))), pa.array(total(links * n[at]))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "n_best", "count_sum"])

    return aligned.mapInArrow(score, schema)


def _spread_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            batch = whole.slice(k, 500)
            codes, edges = _values(batch.column("pairs"), "<i8")
            links, _ = _values(batch.column("links"), "<u4")
            row = np.repeat(batch.column("row").to_numpy(), np.diff(edges))
            salt = (row % SALTS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(salt), pa.array(codes), pa.array(links.astype(np.int64))], ["row", "salt", "pair", "links"])


def _scored_by_join(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    rows = durable(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    spread = rows.select("row", "pairs", "links").mapInArrow(_spread_pairs, "row long, salt int, pair long, links long")
    copies = pairs.select("pair", "n", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    scored = spread.join(copies, ["pair", "salt"])
    scored = scored.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    out = rows.drop("pairs", "links").join(scored, "row", "left").drop("row")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})


def score_alignments(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    aligned = durable(align_documents(docs, path_a, path_b), "aligned")
    pairs = durable(pair_counts(aligned, n_b), "pairs")
    if pairs.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        return _scored_by_broadcast(aligned, pairs)
    return _scored_by_join(aligned, pairs)


def vocabulary_paths() -> tuple[str, str]:
    """The tokenizer files of the registered query; operators take any paths."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
