"""Token ids of whole texts by the ``tokenizers`` library, column by column, with ids of words kept between texts.

Where the tokenizer's own file says that white space is dropped and that no token crosses it (``splits_at_white_space``), a
text's ids are the ids of its words in turn: the words of a slice of texts are found and hashed in numpy, each distinct word
is encoded once by the library, and the ids are gathered by their numbers. A worker remembers a bounded number of words by
64-bit hashes in sorted arrays. For other tokenizers every text is encoded whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import lower_ascii, word_bounds, word_hashes

#: Words a Python worker remembers, about 35 bytes each; further words are encoded again in each slice.
REMEMBERED_WORDS = 1_500_000
RECENT_WORDS = 200_000

_SENTINEL = "\x01"

# Fixed value: how the word tokenizer's file splits texts. Letters, single digits and runs of other marks are apart.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Texts in which folding letters of ASCII could change more than case: combining marks, and what may be a special token.
_DELICATE = r"<\||[\x{0300}-\x{036F}]"
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*b".,"]] = True


def splits_at_white_space(spec: dict) -> bool:
    """Does a tokenizer's description (its JSON) drop white space, and split as ``_WORD_SPLIT`` does?

    Its normalizers may compose characters, fold white space to spaces, and lower-case; none of them joins what white space
    separates, or a letter or digit of ASCII and a mark after it.
    """
    normalizer = spec.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in steps)
    before = spec.get("pre_tokenizer") or {}
    first = (before.get("pretokenizers") or [before])[0]
    split = first.get("type") == "Split" and first.get("pattern") == {"Regex": _WORD_SPLIT} and first.get("behavior") == "Removed" and first.get("invert")
    return bool(plain and split)


class WordEncoder:
    """Ids as little-endian numbers of the narrowest type that holds the vocabulary.

    ``independent`` words: read off the tokenizer's file unless it is given. Strings of special tokens inside a text are read
    by the library as it does by default (as the token).
    """

    def __init__(self, path: str, independent: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known_split = splits_at_white_space(json.loads(self.tokenizer.to_str()))
        self.independent = self.known_split if independent is None else independent
        self.known = [self._empty(), self._empty()]  # hash, begin and number of ids of words: most of them, and recent ones
        self.flat = np.zeros(0, dtype=self.dtype)
        mark = self.tokenizer.encode(_SENTINEL, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has; many words go to the library as one text."""
        out: list[np.ndarray] = [np.zeros(0, dtype=self.dtype)]
        sizes = np.zeros(len(words), dtype=np.int64)
        k = 0
        while k < len(words):
            some = words[k : k + 2000]
            ids = self._ids(f" {_SENTINEL} ".join(some)) if self.mark is not None else None
            cuts = np.flatnonzero(ids == self.mark) if ids is not None else []
            if len(cuts) == len(some) - 1 and not any(_SENTINEL in w for w in some):
                sizes[k : k + len(some)] = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
                out.append(np.delete(ids, cuts))
            else:  # a word that merges with the mark, or holds it: one by one
                alone = [self._ids(w) for w in some]
                sizes[k : k + len(some)] = [len(x) for x in alone]
                out += alone
            k += len(some)
        return np.concatenate(out), sizes

    def _words_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of a column, starts and ends of its words, and the first word of each text.

        Letters of ASCII are folded to lower case, as the tokenizer folds them, except in texts where that could change a
        composed letter or a special token. A full stop or comma after letters and digits of ASCII is a word of its own.
        """
        import pyarrow.compute as pc

        joined = pc.binary_join_element_wise(texts, *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
        offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
        data = np.frombuffer(joined.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not self.known_split:
            starts, ends = word_bounds(data)
            return data, starts, ends, np.searchsorted(starts, offsets)
        folded = lower_ascii(data)
        delicate = pc.match_substring_regex(texts, _DELICATE).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(delicate):
            folded[offsets[k] : offsets[k + 1]] = data[offsets[k] : offsets[k + 1]]
        starts, ends = word_bounds(folded)
        if len(starts):
            other = np.zeros(len(folded) + 1, dtype=np.int64)
            np.cumsum(~_ALNUM[folded], out=other[1:])
            marked = np.flatnonzero(_MARK[folded[ends - 1]] & (ends - starts > 1) & (other[ends - 1] == other[starts]))
            starts = np.insert(starts, marked + 1, ends[marked] - 1)
            shorter = ends.copy()
            shorter[marked] -= 1
            ends = np.insert(shorter, marked + 1, ends[marked])
        return folded, starts, ends, np.searchsorted(starts, offsets)

    def _parts(self, hashes: np.ndarray, first: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct word hashes: all ids known or new, and where each word's begin and how many they are."""
        begin, size = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for table in self.known:
            if len(table[0]):
                at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
                hit = table[0][at] == hashes
                begin[hit], size[hit] = table[1][at[hit]], table[2][at[hit]]
        missing = np.flatnonzero(begin < 0)
        if not len(missing):
            return self.flat, begin, size
        held = data.tobytes()
        words = [held[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist())]
        ids, sizes = self._encode_words(words)
        begin[missing] = len(self.flat) + np.cumsum(sizes) - sizes
        size[missing] = sizes
        flat = np.concatenate([self.flat, ids])
        if sum(len(t[0]) for t in self.known) + len(missing) <= REMEMBERED_WORDS:
            self.flat = flat
            self._remember(1, (hashes[missing], begin[missing], size[missing]))
        return flat, begin, size

    def _remember(self, level: int, more: tuple) -> None:
        """Add to the recent words, and these to the others once there are many; both are sorted by hash."""
        table = tuple(np.concatenate([a, b]) for a, b in zip(self.known[level], more))
        order = np.argsort(table[0], kind="stable")
        table = tuple(c[order] for c in table)
        if level == 1 and len(table[0]) > RECENT_WORDS:
            self.known[1] = self._empty()
            self._remember(0, table)
        else:
            self.known[level] = table

    @staticmethod
    def _empty() -> tuple:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts one after another, each text's followed by ``end_id``, and where each text begins.

        Null and empty texts have none but the end id.
        """
        import pyarrow.compute as pc

        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if self.independent:
            data, starts, ends, edges = self._words_of(texts)
            hashes, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            flat, begin, size = self._parts(hashes, first, data, starts, ends)
        else:
            flat, size = self._encode_alone(texts.to_pylist())
            begin, which, edges = np.cumsum(size) - size, np.arange(n), np.arange(n + 1)
        if end_id is not None:  # the end id is one more word of each text
            which = np.insert(which, edges[1:], len(size))
            edges = edges + np.arange(n + 1)
            begin, size = np.append(begin, len(flat)), np.append(size, 1)
            flat = np.append(flat, np.array([end_id], dtype=self.dtype))
        own = size[which]
        done = np.zeros(len(which) + 1, dtype=np.int64)
        np.cumsum(own, out=done[1:])
        ids = flat[np.arange(done[-1]) + np.repeat(begin[which] - done[:-1], own)]
        return ids, done[edges]

    def _encode_alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._ids(t) for t in texts]
        return np.concatenate([np.zeros(0, dtype=self.dtype), *ids]), np.array([len(x) for x in ids], dtype=np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null and empty texts have none."""
        ids, edges = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=2)
def word_encoder(path: str, independent: bool | None = None) -> WordEncoder:
    """One encoder per Python worker and file."""
    return WordEncoder(path, independent)


def encoded(batch: pa.RecordBatch, column: str, encoder: WordEncoder, end_id: int | None) -> list[np.ndarray]:
    """Ids of every text of a batch, with ``end_id`` appended."""
    ids, edges = encoder.encode_column(batch.column(column), end_id)
    return [ids[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]


def vocabulary_path() -> str:
    """The tokenizer file of the registered queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
