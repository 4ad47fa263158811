"""Dictionary matching as an equi-join, document frequency, and dictionary refinement.

A text is cut into short pieces that overlap by the length of the longest concept. Every position of a piece has one
prefix (or one per anchor length, if many concepts begin alike); concepts are looked up by the longest anchor they fill,
then compared with the piece. Positions whose prefix begins no concept are dropped by a bit map before they are rows
(``grams.py``). The text itself is never shuffled by the join: a counted, small dictionary is broadcast,
a large one is joined by salted prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_boundary
from ..session import BROADCAST_ROWS
from .grams import gram_map, held_places

SHORTEST_ANCHOR = 4
#: Concepts per prefix on average, above which a longer anchor is added.
LONG_CHAIN = 4
PIECE = 32
SALTS = 16


def clean_dictionary(concepts: DataFrame, text: str = "concept", id_: str = "concept_id") -> DataFrame:
    """Lower-cased, trimmed, no blanks; equal strings keep their smallest id."""
    named = concepts.select(F.col(id_), F.lower(F.trim(text)).alias(text)).filter(F.length(text) > 0)
    return named.groupBy(text).agg(F.min(id_).alias(id_)).select(id_, text)


def _anchor_lengths(dictionary: DataFrame, concept: str) -> list[int]:
    """Prefix lengths to look up: the shortest useful one, doubled while too many concepts share their prefix."""
    shortest = dictionary.agg(F.min(F.length(concept))).first()[0] or 1
    lengths = [max(SHORTEST_ANCHOR, min(shortest, 2 * SHORTEST_ANCHOR))]
    while len(lengths) < 3:
        q = lengths[-1]
        chain = dictionary.filter(F.length(concept) >= 2 * q).agg(
            (F.count(F.lit(1)) / F.nullif(F.count_distinct(F.left(concept, F.lit(q))), F.lit(0))).alias("chain")
        ).first()["chain"]
        if not chain or chain <= LONG_CHAIN:
            break
        lengths.append(2 * q)
    return lengths


def _anchor_length(concept: Column, lengths: Sequence[int]) -> Column:
    n = F.length(concept)
    picked = F.when(n < lengths[0], n)
    for q in sorted(lengths, reverse=True):
        picked = picked.when(n >= q, F.lit(q))
    return picked


def occurrences(
    texts: DataFrame, dictionary: DataFrame, doc: str, text: str, *, whole_words: bool = False,
    concept: str = "concept", concept_id: str = "concept_id", broadcast_rows: int = BROADCAST_ROWS, piece: int = PIECE,
) -> DataFrame:
    """All places where a concept occurs, nested and overlapping ones too: (doc, concept_id, concept, start).

    ``whole_words`` asks for a boundary character or the end of the text on both sides.
    """
    anchors = _anchor_lengths(dictionary, concept)
    anchored = dictionary.select(
        F.col(concept_id), F.col(concept), F.left(concept, _anchor_length(F.col(concept), anchors)).alias("_gram")
    )
    facts = anchored.agg(
        F.max(F.length(concept)).alias("longest"), F.count(F.lit(1)).alias("rows"),
        F.collect_set(F.length("_gram")).alias("lengths"),
    ).first()
    lengths = sorted(facts["lengths"]) or [1]
    # With whole words the text is padded by a blank on both sides, and a window starts one character early.
    pad = 1 if whole_words else 0
    overlap = (facts["longest"] or 1) + 2 * pad - 1
    body = F.concat(F.lit(" "), F.col(text), F.lit(" ")) if whole_words else F.col(text)

    probes = held_places(texts, doc, body, lengths, gram_map(anchored), piece, piece + overlap, pad)

    found = F.substring("_piece", F.col("_at") + 1 + pad, F.length(concept)) == F.col(concept)
    if whole_words:
        before = F.substring("_piece", F.col("_at") + 1, F.lit(1))
        after = F.substring("_piece", F.col("_at") + F.length(concept) + 2, F.lit(1))
        found = found & is_boundary(before) & is_boundary(after)
    if facts["rows"] <= broadcast_rows:
        hits = probes.join(F.broadcast(anchored), "_gram")
    else:
        salted = anchored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = probes.withColumn("_salt", F.pmod(F.xxhash64(doc, "_no", "_at"), F.lit(SALTS)).cast("int")).join(salted, ["_gram", "_salt"])
    return hits.filter(found).select(doc, concept_id, concept, (F.col("_no") * piece + F.col("_at")).alias("start"))


def mentions(texts: DataFrame, dictionary: DataFrame, doc: str, text: str, **options) -> DataFrame:
    """The set of concepts of every text: one row per (doc, concept)."""
    hits = occurrences(texts, dictionary, doc, text, **options)
    return hits.select(doc, "concept_id", "concept").distinct()


def merge_hits(chunks: Sequence[DataFrame], concept: str = "concept") -> DataFrame:
    """Bag union of the hits of all chunks, then the distinct concepts."""
    bag = chunks[0].select(concept)
    for more in chunks[1:]:
        bag = bag.unionByName(more.select(concept))
    return bag.distinct()


def document_frequency(texts: DataFrame, dictionary: DataFrame, doc: str, text: str) -> DataFrame:
    """Number of texts in which the concept stands as whole words (case-sensitive)."""
    return mentions(texts, dictionary, doc, text, whole_words=True).groupBy("concept").agg(F.count(F.lit(1)).alias("df"))


# Words that rule a concept out, by place in the concept and by concept length.
WORDS_ANY = [
    "held", "equal", "dramatic", "slowing", "excited", "occupied", "charged", "moving", "layer", "bi", "argument",
    "intuition", "experiment", "entirely", "essentially", "built", "necessary", "take", "applicable", "employ", "visit",
    "visited", "herein", "facilitates", "varying", "overlapping", "addressed", "issues", "related", "add", "adds",
    "dominant", "preserve", "preserves", "preserved", "stabilizing", "match", "manipulating", "emerging", "processed",
    "data", "continuously", "analytically", "argue", "smoothly", "connect", "connects", "connecting", "software",
    "matlab", "toolbox", "standard", "industrial", "technology", "success", "equipment", "call", "analogous", "sense",
    "persist", "persists", "throughout", "calculated", "useful", "difficult", "proved",
]
WORDS_START = [
    "sophisticated", "precise", "remarkably", "consists", "gradually", "simplified", "complete", "techniques",
    "partially", "presented", "iterative", "simple", "preparation", "clear", "priori", "ae", "substantial", "sending",
    "protecting", "optimized", "optimize", "optimizing", "transmits", "transmit", "transmitting", "transmitted",
    "processing", "pre", "collect", "collected", "measured", "varied", "operating", "algorithms", "algorithm",
    "robustly", "shall", "concept", "packing", "successful", "apparent", "apparently", "readily", "adapted", "todays",
    "imperfect", "seemingly", "seeming", "shelf", "properties", "mechanism", "phenomenon", "behavior", "theorem",
    "procedure", "usual", "form", "later", "calculating", "fundamentally",
]
WORDS_END = [
    "illustrates", "setup", "consisting", "set", "capable", "configuration", "complete", "borrowed", "permit",
    "utilizes", "referred", "refer", "capable", "pave", "stem", "preparation", "scheme", "optimizes", "transmitted",
    "transmit", "operating", "relate", "packed", "packing", "platform", "industry", "adapt", "adapts", "adapted",
    "arrangement", "era", "device", "arrange", "arranged", "content", "procedure", "outlined", "form", "formed",
    "followed", "following", "calculation",
]
WORDS_ANY5 = ["open"]
WORDS_ANY3 = ["driven", "component"]
WORDS_ANY2 = ["probe", "inspired", "technique", "open", "added", "transfer", "connected", "element", "exchange"]
WORDS_START2 = ["doubly", "probe"]
WORDS_END2: list[str] = []
FORBIDDEN = [
    "complete measurement", "exact numerical", "numerical technique", "numerical method", "complete set",
    "pure entangled", "quantum entangled", "high fidelity",
]

DEFAULT_RULES = {
    "any": WORDS_ANY, "any5": WORDS_ANY5, "any3": WORDS_ANY3, "any2": WORDS_ANY2, "start": WORDS_START,
    "end": WORDS_END, "start2": WORDS_START2, "end2": WORDS_END2, "forbidden": FORBIDDEN,
}


def rule_flags(concept: Column, rules: dict[str, Sequence[str]] = DEFAULT_RULES) -> dict[str, Column]:
    """One boolean per rule family: does it rule the concept out?"""
    words = F.split(F.trim(concept), r"\s+")
    count = F.size(words)

    def has(name: str) -> Column:
        listed = rules.get(name) or []
        return F.arrays_overlap(words, F.array(*map(F.lit, listed))) if listed else F.lit(False)

    def word_at(place: int, name: str) -> Column:
        listed = rules.get(name) or []
        return F.element_at(words, place).isin(*listed) if listed else F.lit(False)

    by_length = ((count < 5) & has("any5")) | ((count <= 3) & has("any3")) | ((count == 2) & has("any2"))
    ends = word_at(1, "start") | word_at(-1, "end") | ((count == 2) & (word_at(1, "start2") | word_at(-1, "end2")))
    forbidden = F.lit(False)
    for phrase in rules.get("forbidden") or []:
        forbidden = forbidden | concept.contains(phrase)
    return {"any": has("any"), "by_length": by_length, "ends": ends, "forbidden": forbidden}


def refine_dictionary(concepts: DataFrame, concept: str = "concept", rules: dict[str, Sequence[str]] = DEFAULT_RULES) -> DataFrame:
    """Keep the concepts that no rule removes."""
    flags = rule_flags(F.col(concept), rules)
    return concepts.filter(~(flags["any"] | flags["by_length"] | flags["ends"] | flags["forbidden"]))


def refinement_report(concepts: DataFrame, concept: str = "concept", rules: dict[str, Sequence[str]] = DEFAULT_RULES) -> DataFrame:
    flags = rule_flags(F.col(concept), rules)
    removed = flags["any"] | flags["by_length"] | flags["ends"] | flags["forbidden"]
    return concepts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~removed).alias("kept"), F.count_if(removed).alias("removed")
    )
