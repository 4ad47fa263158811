"""Operator 8: secrets by fixed forms, and by two character Markov models.

One model has the transitions of random strings, the other those of ordinary identifiers. A run of at least
``MIN_RUN`` key characters outside the fixed forms is a secret if the log-likelihood ratio of the two exceeds
``MIN_RATIO``, the logarithm of the odds against a run being a secret.

The models are trained from labelled samples: values that the fixed forms find, and random strings of the usual key
alphabets, against identifiers joined from words, and words of the corpus that are ``ORDINARY`` in form. The words and values
come from about ``SAMPLE_DOCS`` documents (all, if there are fewer), chosen by hash of the id; only transition counts
(at most 2 * N * N rows) reach the driver. Scanning covers all documents and whole texts.

Cases: a null or empty text has no spans; a null id is kept; repeated rows are scanned each; an empty table trains on the
built-in samples alone and gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import public_columns, text_slices, tidy

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What counts as an ordinary word of the corpus: lower case but for capitals that begin a part.
ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Z]?[a-z]{2,}[+/_=-]?)+(?![A-Za-z0-9+/_=-])")
MIN_RUN = 16
MIN_RATIO = float(np.log(1e4))
MIN_DISTINCT = 8
SAMPLE_DOCS = 2000

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
N = len(ALPHABET) + 1  # 0 stands for the start
_CLASS = bytes((ALPHABET.find(chr(c)) + 1) if c < 128 else 0 for c in range(256))
_COMMON_WORDS = (
    "get set user name list item index value count total start end open close read write file path data node tree key map "
    "next last first page view model test error load save update delete create check parse build render event handler "
    "config option client server request response message queue thread buffer string number format version default "
    "current parent child element attribute property session account order customer product price date time"
).split()

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed forms, by start, then kind as listed."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if RUN.search(text):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _classes(run: str) -> np.ndarray:
    return np.frombuffer(b"\0" + run.encode("ascii").translate(_CLASS), dtype=np.uint8)


def count_transitions(runs: list[str]) -> np.ndarray:
    out = np.zeros(N * N, dtype=np.int64)
    for run in runs:
        c = _classes(run).astype(np.int64)
        out += np.bincount(c[:-1] * N + c[1:], minlength=N * N)
    return out.reshape(N, N)


def built_in_samples(seed: int = 0, each: int = 1500) -> tuple[list[str], list[str]]:
    """Random strings of key alphabets, and identifiers in camel, snake and kebab case: (random, ordinary)."""
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", ALPHABET[:62], ALPHABET[26:62], ALPHABET[:64]]
    keys = ["".join(rng.choices(a, k=rng.randint(16, 48))) for a in alphabets for _ in range(each // len(alphabets))]
    names = []
    for _ in range(each):
        words = rng.choices(_COMMON_WORDS, k=rng.randint(2, 5))
        style = rng.randrange(4)
        if style == 0:
            names.append(words[0] + "".join(w.capitalize() for w in words[1:]))
        else:
            names.append("_-/"[style - 1].join(words) + rng.choice(["", "", "2", "10"]))
    return keys, names


class MarkovPair:
    """Log ratio of each transition, random strings against ordinary ones."""

    def __init__(self, keys: np.ndarray, names: np.ndarray, smooth: float = 0.5):
        logs = []
        for counts in (keys, names):
            counts = counts + smooth
            logs.append(np.log(counts / counts.sum(axis=1, keepdims=True)))
        self.ratio = (logs[0] - logs[1]).astype(np.float64)

    def score(self, run: str) -> float:
        c = _classes(run)
        return float(self.ratio[c[:-1], c[1:]].sum())


def scan(text: str, model: MarkovPair) -> list[Span]:
    """Base spans, then the runs outside them that the models call random; by start, then kind as listed."""
    found = base_spans(text)
    covered = [(s, e) for _, s, e in found]
    for m in RUN.finditer(text):
        start, end = m.span()
        if any(s < end and start < e for s, e in covered):
            continue
        run = m.group()
        if len(set(run)) >= MIN_DISTINCT and model.score(run) > MIN_RATIO:
            found.append(("markov", start, end))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {k: np.zeros((N, N), dtype=np.int64) for k in ("keys", "names")}
    for batch in text_slices(batches, "text"):
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            spans = base_spans(text)
            keys = [ASSIGN.match(text, s).group(2).replace(".", "") if kind == "assign" else text[s:e] for kind, s, e in spans]
            names, at = [], 0
            for _, s, e in [*spans, ("", len(text), len(text))]:
                names += [w for w in ORDINARY.findall(text, at, max(at, s)) if len(w) >= 8]
                at = max(at, e)
            total["keys"] += count_transitions(keys)
            total["names"] += count_transitions(names)
    for kind, counts in total.items():
        pair = np.flatnonzero(counts.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(pair), pa.string()), pa.array(pair.astype(np.int32)), pa.array(counts.reshape(-1)[pair])], names=["kind", "pair", "n"])


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> MarkovPair:
    rows = public_columns(docs, doc_id=doc_id, text=text)
    every = max(1, -(-rows.count() // sample_docs))
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    counts = some.mapInArrow(_sample_counts, "kind string, pair int, n bigint").groupBy("kind", "pair").agg(F.sum("n").alias("n"))
    keys, names = (count_transitions(s) for s in built_in_samples())
    for kind, pair, n in counts.collect():  # at most 2 * N * N rows
        (keys if kind == "keys" else names).reshape(-1)[pair] += n
    return MarkovPair(keys, names)


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with each span, or group of overlapping spans, replaced."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, model: MarkovPair | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans: array of (kind, start, end, value)), code points, end exclusive; one row per document."""
    model = model or train(docs, text, doc_id)
    rows = public_columns(docs, doc_id=doc_id, text=text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = []
            for t in batch.column("text").to_pylist():
                found.append([{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in scan(t, model)] if t else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return rows.mapInArrow(tidy(run), "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, value: string>>")


def redact_secrets(docs: DataFrame, model: MarkovPair | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all secrets in the text replaced; other columns stay as they are."""
    model = model or train(docs, text, doc_id)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            texts = [redacted(t, scan(t, model)) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)
