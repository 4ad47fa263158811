"""What several operators share: inputs, files in the shared folder, hashing of words in numpy.

``public_columns`` takes just the columns that an operator needs, by position of their name, so further columns of the
input (whatever they are called) never meet the operator's own.
"""

from __future__ import annotations

import ctypes
import functools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_columns(df: DataFrame, **named: str) -> DataFrame:
    """Select ``new=old`` columns only."""
    return df.select(*[df[old].alias(new) for new, old in named.items()])


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def open_output(folder: str, suffix: str):
    """A new file below ``folder`` (any address that pyarrow knows; a plain path is local and shared). Returns (path, stream).

    The name is unique, so a retried or doubled task never writes to a file of another attempt.
    """
    fs, base = _file_system(folder)
    fs.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder.rstrip('/')}/{name}", fs.open_output_stream(f"{base.rstrip('/')}/{name}", compression=None)


def open_input(path: str):
    fs, base = _file_system(path)
    return fs.open_input_file(base)


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def tidy(run):
    """Wrap a function over Arrow batches: memory that a task leaves free goes back to the system when it ends.

    Python workers live on between tasks and stages; without this, each keeps the most it ever needed.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    """Give free pages of the allocators back; where the C library has no such call, only Arrow's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice have about ``most`` bytes (one text may have more)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        slot = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            for k, base in enumerate((_ODD, _ODD_INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in UTF-8 bytes."""
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[data]
    turn = np.diff(word)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: a polynomial over the bytes, from prefix sums, scrambled."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def window_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(words) - n + 1
    with np.errstate(over="ignore"):
        out = np.zeros(size, dtype=np.uint64)
        for k in range(n):
            out = out * _ODD + mix(words[k : k + size] + np.uint64(k + 1) * _GOLD)
        return mix(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def text_bytes(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each text without copying; null gives None."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k, ok in enumerate(valid):
        yield data[offsets[k] : offsets[k + 1]] if ok else None
