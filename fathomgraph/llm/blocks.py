"""Main text of web pages by a recurrent labeller of blocks.

A page is read into its sequence of leaf blocks: runs of text between tags that are not inline. Each block has the hashed
tags, classes and ids of its path, the same of its own element, its hashed words, and a few measures. A bidirectional LSTM
in numpy reads the whole sequence of a page, so that every block is judged with all others of its page in view, and says
whether it belongs to the article. Kept blocks are joined in order.

The model is trained here, in one task of half a minute, on ``TRAIN_PAGES`` generated pages whose blocks are labelled by how
they were made (``sample_page``); the number is the bound of the sample and does not depend on the input. Tasks get the
weights, some hundred kB, and label the pages of their slice in batches of like length.

Defined results: null and empty pages, pages without text and pages without an article have the text ''; text outside any
tag is a block; unclosed tags end with the page, an unclosed script, style, title or text area takes the rest; comments are
markup; repeated rows are returned once each; an empty table gives no rows; of the input only ``page_id``, ``url`` and
``html`` are read.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import public_columns, text_slices

TRAIN_PAGES = 1200
TRAIN_STEPS = 400
BATCH_PAGES = 24
UNITS = 24
PATH_DIMS, OWN_DIMS, WORD_DIMS, MEASURES = 96, 64, 64, 12
DIMS = PATH_DIMS + OWN_DIMS + WORD_DIMS + MEASURES
#: Blocks times padding of a batch of pages that a task labels at once.
BATCH_CELLS = 20_000
#: Words that a task remembers the places of; beyond it begins anew, between pages.
KNOWN_WORDS = 100_000

# Fixed values of the HTML language: elements that do not break a run of text, that have no end tag, that are not shown,
# and that close an open element of the same kind.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
UNSHOWN = frozenset("noscript template select iframe object svg math canvas".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SENTENCE_END = tuple(".!?…。")


class Block:
    __slots__ = ("text", "path", "link", "label")

    def __init__(self, text: str, path: tuple, link: int, label: int | None = None):
        self.text, self.path, self.link, self.label = text, path, link, label


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element adds to a path: its tag, and the words of its class, id and role."""
    if not attributes or not attributes.strip():
        return (f"<{tag}",)
    words = [w for m in _ATTRIBUTE.finditer(attributes) for w in _TOKEN.findall((m.group(1) or m.group(2) or m.group(3) or "").lower())]
    return (f"<{tag}", *dict.fromkeys(words))


#: The path of a block: (names of an element, path of its parent), shared between blocks; None outside any element.
Path = tuple


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, in time linear in its length."""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    opened: Counter = Counter()
    held: list[str] = []
    link = at = 0
    in_link = False
    tags = _TAG
    endless: set[str] = set()

    def flush() -> None:
        nonlocal link
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else None, link))
            held.clear()
        link = 0

    def put(raw: str) -> None:
        nonlocal link
        if raw:
            text = unescape(raw) if "&" in raw else raw
            held.append(text)
            if in_link:
                link += len(text)

    def close(names: frozenset | set, stops: tuple = ()) -> None:
        """Close open elements up to the innermost one of ``names``, if no element of ``stops`` is in between."""
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                for tag, _ in stack[k:]:
                    opened[tag] -= 1
                del stack[k:]
                return
            if stack[k][0] in stops:
                return

    size = len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            put(page[at:])
            break
        put(page[at:start])
        following = page[start + 1 : start + 2]
        if following in ("!", "?"):
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                at = size if stop < 0 else stop + 3
            else:
                stop = page.find(">", start)
                at = size if stop < 0 else stop + 1
            continue
        found = tags.match(page, start) if following.isalpha() or following == "/" else None
        if found is None and tags is _TAG and (following.isalpha() or following == "/") and following.isascii():
            tags = _LOOSE_TAG  # quotes that are never closed: read on without them
            found = _LOOSE_TAG.match(page, start)
        if found is None and tags is _LOOSE_TAG and following.isascii() and following.isalpha():  # nothing ends a tag any more
            put(page[start:])
            break
        if found is None:
            if following == "/":  # an end tag without a name is dropped
                stop = page.find(">", start)
                at = size if stop < 0 else stop + 1
            else:
                put("<")
                at = start + 1
            continue
        at = found.end()
        ending, tag, attributes = found.group(1), found.group(2).lower(), found.group(3)
        if tag in RAW or tag in UNSHOWN:
            if ending or tag in endless or attributes.endswith("/") and tag in UNSHOWN:
                continue
            stop = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            if stop:
                at = stop.end()
            elif tag in RAW:
                break
            else:
                endless.add(tag)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not ending
            continue
        flush()
        if ending:
            if opened[tag]:
                close({tag})
            continue
        if tag in CLOSES_PARAGRAPH:
            close({"p"}, ("td", "th", "div", "li", "blockquote"))
        if tag in SIBLINGS:
            close(set(SIBLINGS[tag].split()), ("ul", "ol", "table", "dl", "menu"))
        if tag in VOID:
            continue
        stack.append((tag, (_names(tag, attributes), stack[-1][1] if stack else None)))
        opened[tag] += 1
    flush()
    return out


@lru_cache(maxsize=20_000)
def _places(name: str, dims: int, base: int) -> tuple[tuple[int, float], ...]:
    """Three signed places of a name in a hashed vector."""
    out = []
    for k in range(3):
        h = crc32(f"{k}:{name}".encode("utf-8", "replace"))
        out.append((base + (h >> 1) % dims, 1.0 if h & 1 else -1.0))
    return tuple(out)


class _Paths:
    """Hashed vectors of paths, of one slice of pages; paths of the same names have one vector."""

    def __init__(self):
        self.known: dict[int, tuple[Path, int]] = {}  # by identity; the path is held, so its identity stays
        self.alike: dict[tuple[int, tuple], int] = {}
        self.vectors = [np.zeros(PATH_DIMS + OWN_DIMS, dtype=np.float32)]  # that of no path

    def vector(self, path: Path) -> np.ndarray:
        todo = []
        while path is not None and id(path) not in self.known:
            todo.append(path)
            path = path[1]
        above = self.known[id(path)][1] if path is not None else 0
        for p in reversed(todo):
            number = self.alike.get((above, p[0]))
            if number is None:
                vector = self.vectors[above].copy()
                vector[PATH_DIMS:] = 0
                for name in p[0]:
                    for place, sign in _places(name, PATH_DIMS, 0):
                        vector[place] += sign
                    for place, sign in _places(name, OWN_DIMS, PATH_DIMS):
                        vector[place] += sign
                np.clip(vector, -3, 3, out=vector)
                number = self.alike[above, p[0]] = len(self.vectors)
                self.vectors.append(vector)
            self.known[id(p)] = (p, number)
            above = number
        return self.vectors[above]


_BEGUN = tuple(crc32(f"{k}:".encode()) for k in range(3))


class _Words(dict):
    """Words by number, with the three hashes of ``_places`` of each; a page's words are added up in numpy."""

    def __init__(self):
        self.hashes = array("I")

    def __missing__(self, word: str) -> int:
        name = word.strip(".,;:!?()[]\"'").encode("utf-8", "replace")
        self.hashes.extend([crc32(name, begun) for begun in _BEGUN])
        self[word] = number = len(self)
        return number

    def vectors(self, texts: list[list[str]]) -> np.ndarray:
        """The signed places of all words of each text, added up."""
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.hashes = array("I")
        counts = np.array([len(words) for words in texts], dtype=np.int64)
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        hashes = np.frombuffer(self.hashes, dtype=np.uint32).reshape(-1, 3)[numbers].astype(np.int64)
        cells = np.repeat(np.arange(len(texts)) * WORD_DIMS, counts)[:, None] + (hashes >> 1) % WORD_DIMS
        signs = np.where(hashes & 1, 1.0, -1.0)
        return np.bincount(cells.ravel(), signs.ravel(), len(texts) * WORD_DIMS).reshape(-1, WORD_DIMS)


def features(page: list[Block], paths: _Paths, known: _Words | None = None) -> np.ndarray:
    """A row of ``DIMS`` numbers for each block."""
    out = np.zeros((len(page), DIMS), dtype=np.float32)
    if not page:
        return out
    words_at, measures_at = PATH_DIMS + OWN_DIMS, PATH_DIMS + OWN_DIMS + WORD_DIMS
    texts = [block.text.lower().split() for block in page]
    weights = 1.0 / np.sqrt([len(words) for words in texts])
    out[:, words_at:measures_at] = (_Words() if known is None else known).vectors(texts) * weights[:, None]
    measures = []
    for k, (block, words) in enumerate(zip(page, texts)):
        out[k, :words_at] = paths.vector(block.path)
        text, n = block.text, len(block.text)
        measures.append((
            len(words), n, block.link / n, text.endswith(_SENTENCE_END), len(words) == 1, "©" in text,
            sum(map(text.count, ",.;:")) / len(words) / 2, text[0].isupper(), text[0].isdigit(), k == 0, k / len(page), len(page),
        ))
    table = np.array(measures, dtype=np.float64)
    for column, scale in ((0, 4), (1, 6), (MEASURES - 1, 5)):
        table[:, column] = np.log1p(table[:, column]) / scale
    out[:, measures_at:] = table
    return out


class Labeller:
    """Weights of a bidirectional LSTM with a logistic output over both states."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = {}
        for way in "fb":
            self.weights[f"{way}x"] = make(DIMS, 4 * UNITS)
            self.weights[f"{way}h"] = make(UNITS, 4 * UNITS)
            bias = np.zeros(4 * UNITS, dtype=np.float32)
            bias[UNITS : 2 * UNITS] = 1  # forget gates begin open
            self.weights[f"{way}c"] = bias
        self.weights["out"] = make(2 * UNITS, 1)
        self.weights["shift"] = np.zeros(1, dtype=np.float32)

    @staticmethod
    def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
        gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * UNITS], -30, 30)))
        return gates[:, :UNITS], gates[:, UNITS : 2 * UNITS], gates[:, 2 * UNITS :], np.tanh(z[:, 3 * UNITS :])

    def _read(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States (steps, pages, units) for ``x`` (steps, pages, dims); padded steps hold the state."""
        steps, pages, _ = x.shape
        z = x.reshape(steps * pages, -1) @ self.weights[f"{way}x"] + self.weights[f"{way}c"]
        z = z.reshape(steps, pages, -1)
        h = c = np.zeros((pages, UNITS), dtype=np.float32)
        out = np.empty((steps, pages, UNITS), dtype=np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            i, f, o, g = self._gates(z[t] + h @ self.weights[f"{way}h"])
            new_c = f * c + i * g
            squashed = np.tanh(new_c)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, i, f, o, g, c, h, squashed, m))
            h, c = m * (o * squashed) + (1 - m) * h, m * new_c + (1 - m) * c
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits (steps, pages)."""
        both = np.concatenate([self._read(x, mask, "f"), self._read(x, mask, "b")], axis=2)
        return (both @ self.weights["out"])[:, :, 0] + self.weights["shift"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss over blocks, and its gradients by backpropagation through both sequences."""
        kept: dict[str, list] = {"f": [], "b": []}
        states = [self._read(x, mask, way, kept[way]) for way in "fb"]
        both = np.concatenate(states, axis=2)
        logits = (both @ self.weights["out"])[:, :, 0] + self.weights["shift"]
        n = mask.sum()
        loss = float(((np.logaddexp(0, logits) - labels * logits) * mask).sum() / n)
        slope = ((1 / (1 + np.exp(-logits)) - labels) * mask / n)[:, :, None]
        grad = {"out": (both * slope).sum(axis=(0, 1))[:, None], "shift": slope.sum(keepdims=False).reshape(1)}
        to_states = slope * self.weights["out"][:, 0]
        for k, way in enumerate("fb"):
            own = to_states[:, :, k * UNITS : (k + 1) * UNITS]
            d_z = np.zeros((*mask.shape, 4 * UNITS), dtype=np.float32)
            d_h = d_c = np.zeros((mask.shape[1], UNITS), dtype=np.float32)
            d_wh = np.zeros_like(self.weights[f"{way}h"])
            for t, i, f, o, g, c, h, squashed, m in reversed(kept[way]):
                d_h = d_h + own[t]
                inner_h, inner_c = d_h * m, d_c * m
                d_cell = inner_c + inner_h * o * (1 - squashed**2)
                d_z[t] = np.concatenate(
                    [d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), inner_h * squashed * o * (1 - o), d_cell * i * (1 - g**2)], axis=1
                )
                d_wh += h.T @ d_z[t]
                d_h = d_z[t] @ self.weights[f"{way}h"].T + d_h * (1 - m)
                d_c = d_cell * f + d_c * (1 - m)
            flat = d_z.reshape(-1, 4 * UNITS)
            grad[f"{way}x"] = x.reshape(-1, DIMS).T @ flat
            grad[f"{way}h"] = d_wh
            grad[f"{way}c"] = flat.sum(axis=0)
        return loss, grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), DIMS), dtype=np.float32)
    mask = np.zeros((steps, len(pages)), dtype=np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


def label_pages(model: Labeller, pages: list[list[Block]], known: _Words | None = None) -> list[np.ndarray]:
    """For each page, which blocks belong to the article; pages of like length are read together."""
    paths, known = _Paths(), _Words() if known is None else known
    kept: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    while order:
        most = max(1, BATCH_CELLS // len(pages[order[-1]]))
        some, order = order[-most:], order[:-most]
        scores = model.scores(*padded([features(pages[k], paths, known) for k in some]))
        for column, k in enumerate(some):
            kept[k] = scores[: len(pages[k]), column] > 0
    return kept


def train(pages: int = TRAIN_PAGES, steps: int = TRAIN_STEPS, seed: int = 7) -> Labeller:
    """Fit by Adam on generated pages."""
    rng = np.random.default_rng(seed)
    paths, known = _Paths(), _Words()
    sample = []
    for _ in range(pages):
        page = labelled(sample_page(rng))
        if page:
            sample.append((features(page, paths, known), np.array([b.label for b in page], dtype=np.float32)))
    model = Labeller(seed)
    first = {k: np.zeros_like(w) for k, w in model.weights.items()}
    second = {k: np.zeros_like(w) for k, w in model.weights.items()}
    for step in range(1, steps + 1):
        some = [sample[k] for k in rng.integers(len(sample), size=BATCH_PAGES)]
        x, mask = padded([s[0] for s in some])
        labels = np.zeros_like(mask)
        for k, s in enumerate(some):
            labels[: len(s[1]), k] = s[1]
        _, grad = model.gradients(x, mask, labels)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        rate = 0.01 * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, g in grad.items():
            g = g * min(1.0, 5 / (norm + 1e-9)) + 1e-4 * model.weights[k] * (not k.endswith("c"))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.weights[k] = (model.weights[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fitted(spark: SparkSession) -> Labeller:
    """The model of the registered query, trained by ``train`` in a task, where numpy has one core and a loss is made good by Spark."""

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train().weights)], pa.binary())], ["weights"])

    model = Labeller()
    model.weights = pickle.loads(spark.range(1, numPartitions=1).mapInArrow(run, "weights binary").first()["weights"])
    return model


def extract_pages(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""
    pages = public_columns(pages, page_id="page_id", url="url", html="html")
    model = model or fitted(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in text_slices(batches, "html", 2_000_000):
            read = [blocks(p) if p else [] for p in batch.column("html").to_pylist()]
            texts = [" ".join(b.text for b, keep in zip(page, kept) if keep) for page, kept in zip(read, label_pages(model, read, known))]
            columns = [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


# ---- generated pages -------------------------------------------------------------------------------------------------

# How sites commonly name the parts of a page, and what such parts commonly say.
PART_NAMES = {
    "header": "header masthead banner top branding site-header page-header logo",
    "nav": "nav menu navigation navbar main-menu topnav breadcrumb breadcrumbs links toc",
    "ad": "ad ads advert advertisement sponsored promo banner-ad adsbox commercial sponsor",
    "notice": "cookie cookies consent notice popup newsletter subscribe alert gdpr paywall",
    "side": "sidebar aside side secondary widget related recommended popular trending more",
    "form": "form search login signup contact-form subscribe-form",
    "share": "share social sharing follow share-buttons",
    "comments": "comments comment discussion replies commentlist responses disqus reader-comments",
    "footer": "footer site-footer bottom copyright legal colophon page-footer",
    "article": "article content post entry main-content article-body story body-text text post-content entry-content main",
}
SAYINGS = {
    "header": "welcome|the daily news|home|log in|sign up|your account|search",
    "nav": "home|about|contact|news|sports|archive|products|blog|help|next|previous|categories|login",
    "ad": "advertisement|buy now|sponsored content|special offer|click here|limited time|learn more|save up to 50%|order today",
    "notice": "we use cookies|accept all|manage preferences|subscribe to our newsletter|sign up for updates|please enable javascript|by continuing you agree",
    "side": "related articles|most read|popular posts|you may also like|recent posts|read more|tags|latest",
    "form": "name|email|submit|send|password|search|your message|required|remember me|phone",
    "share": "share|tweet|facebook|print|email this|follow us|pin it|copy link",
    "comments": "comments|reply|leave a comment|says:|posted by|report|like|3 replies|i agree|thanks for sharing|great post|anonymous",
    "footer": "all rights reserved|privacy policy|terms of use|contact us|sitemap|© 2024|imprint|powered by|© copyright",
}

_SYLLABLES = "ba be bi bo bu da de di do du fa fi fo ga ge go ha he hi ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi wa we za ür ción ñá én tion ing the an er on st ea".split()


def _word(rng) -> str:
    return "".join(_SYLLABLES[k] for k in rng.integers(len(_SYLLABLES), size=rng.integers(1, 5)))


def _sentence(rng, low: int = 2, high: int = 22) -> str:
    words = [_word(rng) + ("," if rng.random() < 0.08 else "") for _ in range(rng.integers(low, high))]
    return " ".join(words).capitalize().rstrip(",") + ("." if rng.random() < 0.9 else "?")


def _prose(rng, most: int = 7) -> str:
    """A paragraph; now and then of one word only, as in lists and headings."""
    if rng.random() < 0.12:
        return _word(rng).capitalize() + rng.choice(["", ".", "."])
    return " ".join(_sentence(rng) for _ in range(rng.integers(1, most)))


def _said(rng, kind: str) -> str:
    sayings = SAYINGS[kind].split("|")
    text = sayings[rng.integers(len(sayings))] if rng.random() < 0.45 else _sentence(rng, 1, 6).rstrip(".?")
    return text.capitalize() if rng.random() < 0.6 else text


class _Maker:
    """Writes a page; ``marks`` collects labels by a running number that each block carries in its text."""

    def __init__(self, rng):
        self.rng = rng
        self.marks: list[int] = []

    def mark(self, text: str, label: int) -> str:
        self.marks.append(label)
        return f"\ue000{len(self.marks) - 1}\ue001{text}"

    def wrap(self, kind: str, inner: str, tags: str = "div section") -> str:
        """An element that is named by its tag, its class, its id, or not at all."""
        rng = self.rng
        names = PART_NAMES[kind].split()
        name = names[rng.integers(len(names))]
        own = {"header": "header", "nav": "nav", "side": "aside", "form": "form", "footer": "footer", "article": "article", "ad": "ins"}.get(kind)
        roll = rng.random()
        if own and roll < 0.45:
            extra = f' class="{name}"' if rng.random() < 0.3 else ""
            return f"<{own}{extra}>{inner}</{own}>"
        choice = tags.split()
        tag = choice[rng.integers(len(choice))]
        attribute = rng.choice(["class", "class", "id"])
        more = f" {_word(rng)}-{rng.integers(99)}" if rng.random() < 0.2 and attribute == "class" else ""
        if roll > 0.97:
            return f"<{tag}>{inner}</{tag}>"
        return f'<{tag} {attribute}="{name}{more}">{inner}</{tag}>'

    def items(self, kind: str) -> str:
        rng = self.rng
        said = [self.mark(_said(rng, kind), 0) for _ in range(rng.integers(1, 8))]
        if rng.random() < 0.6:
            said = [f'<a href="/{_word(rng)}">{s}</a>' for s in said]
        shape = rng.random()
        if shape < 0.6:
            return f"<ul>{''.join(f'<li>{s}</li>' if rng.random() < 0.9 else f'<li>{s}' for s in said)}</ul>"
        return "".join(f"<p>{s}</p>" if shape < 0.8 else f"<div>{s}</div>" for s in said)

    def part(self, kind: str) -> str:
        rng = self.rng
        if kind in ("ad", "notice", "footer") and rng.random() < 0.6:
            text = " ".join([_said(rng, kind), _sentence(rng), _sentence(rng)][rng.integers(2) :]) if rng.random() < 0.7 else _prose(rng, 3)
            if kind == "footer" and rng.random() < 0.5:
                text = f"© {_word(rng)} · {text}"
            return self.wrap(kind, self.mark(text, 0), "div p section")
        if kind == "form":
            fields = "".join(f'<label>{self.mark(_said(rng, "form"), 0)}</label><br><input name="{_word(rng)}"><br>' for _ in range(rng.integers(1, 5)))
            return self.wrap(kind, f"{fields}<button>{self.mark(_said(rng, 'form'), 0)}</button>")
        if kind == "comments":
            heading = f"<h3>{self.mark(_said(rng, 'comments'), 0)}</h3>" if rng.random() < 0.7 else ""
            rows = "".join(
                f'<div class="{rng.choice(["comment", "reply", "c", "item"])}"><p>{self.mark(_said(rng, "comments"), 0)}</p><p>{self.mark(_prose(rng, 4), 0)}</p></div>'
                if rng.random() < 0.6 else f"<p>{self.mark(_prose(rng, 4), 0)}</p>"
                for _ in range(rng.integers(1, 6))
            )
            return self.wrap(kind, heading + rows, "div section ol")
        if kind == "side" and rng.random() < 0.4:
            return self.wrap(kind, f"<h4>{self.mark(_said(rng, 'side'), 0)}</h4>" + "".join(f"<p>{self.mark(_prose(rng, 3), 0)}</p>" for _ in range(rng.integers(1, 4))))
        return self.wrap(kind, self.items(kind))

    def body(self) -> str:
        """The blocks of an article, with what sites put between them."""
        rng = self.rng
        out = []
        if rng.random() < 0.8:
            out.append(f"<h{(h := rng.integers(1, 3))}>{self.mark(_sentence(rng, 1, 10), 1)}</h{h}>")
        for _ in range(rng.integers(1, 16)):
            roll = rng.random()
            if roll < 0.55:
                out.append(f"<p>{self.mark(_prose(rng), 1)}</p>")
            elif roll < 0.68:
                out.append(f"<p><b>{self.mark(_prose(rng, 3), 1)}<br>")  # tags that are never closed
            elif roll < 0.74:
                out.append(f"<h{(h := rng.integers(2, 5))}>{self.mark(_sentence(rng, 1, 7), 1)}</h{h}>")
            elif roll < 0.80:
                out.append(f"<ul>{''.join(f'<li>{self.mark(_prose(rng, 2), 1)}' for _ in range(rng.integers(1, 5)))}</ul>")
            elif roll < 0.84:
                out.append(f"<blockquote>{self.mark(_prose(rng, 3), 1)}</blockquote>")
            elif roll < 0.88:
                out.append(f"<table><tr><td>{self.mark(_prose(rng, 2), 1)}</td><td>{self.mark(_prose(rng, 2), 1)}</td></tr></table>")
            elif roll < 0.92:
                out.append(f"{self.mark(_prose(rng), 1)}<br><br>")
            else:
                out.append(self.part(rng.choice(["ad", "share", "side", "notice", "form"])))
        return "".join(out)


def sample_page(rng) -> tuple[str, list[int]]:
    """A page and the labels of its blocks, numbered within their texts between two private characters."""
    make = _Maker(rng)
    before = [k for k, p in (("notice", 0.2), ("header", 0.4), ("nav", 0.75), ("ad", 0.5), ("side", 0.15), ("form", 0.1)) if rng.random() < p]
    after = [k for k, p in (("share", 0.2), ("side", 0.3), ("form", 0.15), ("comments", 0.35), ("ad", 0.3), ("nav", 0.1), ("notice", 0.15), ("footer", 0.75)) if rng.random() < p]
    if rng.random() < 0.04:
        before, after = [], []
    parts = [make.part(k) for k in before]
    if rng.random() < 0.97:
        article = make.body()
        if rng.random() < 0.15:
            article += make.part("comments")
        roll = rng.random()
        parts.append(article if roll < 0.06 else f"<main>{make.wrap('article', article)}</main>" if roll < 0.2 else make.wrap("article", article, "div section td"))
    parts += [make.part(k) for k in after]
    if rng.random() < 0.3:
        parts = [f'<div class="{rng.choice(["page", "wrap", "container", "wrapper", "site", "layout"])}">', *parts, "</div>"]
    noise = "<style>p{margin:0}</style><script>var t='<p>';</script>" if rng.random() < 0.5 else ""
    return f"<html><head><title>x</title>{noise}</head><body>{''.join(parts)}</body></html>", make.marks


_MARK = re.compile("\ue000(\\d+)\ue001")


def labelled(made: tuple[str, list[int]]) -> list[Block]:
    """Blocks of a generated page with their labels, the marks taken out."""
    out = []
    for block in blocks(made[0]):
        found = _MARK.findall(block.text)
        block.text = _MARK.sub("", block.text).strip()
        if found and block.text:
            block.label = made[1][int(found[0])]
            out.append(block)
    return out
