"""Dictionary matching by rare anchors: every concept is looked up by its rarest gram, wherever in the concept it lies.

A table of fixed size counts how often grams occur in a share of the texts; it only orders, so any counts give the same hits.
Each concept of at least ``q`` characters is anchored by its rarest gram and the gram's offset, shorter ones by themselves. The
anchors fill a bit map of fixed size; a position of a text whose gram is not in it never becomes a row (``grams.py``), so the
join meets the few positions that can begin an anchor. ``anchor_map`` and ``passing`` are the same for probes that are rows.

Pieces of a text carry ``CONTEXT`` characters on both sides, whatever the longest concept is. A concept is compared with the
context first; one that is longer than its context is then verified on its place in the document, so a single long concept
widens no piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_boundary
from ..session import BROADCAST_ROWS, durable
from .grams import gram_map, held_places
from .match import PIECE, SALTS, SHORTEST_ANCHOR

LONGEST_ANCHOR = 8
#: Characters of a text that a piece holds before and after its positions.
CONTEXT = 32
#: Slots of the table of gram frequencies, and bits of the map of anchors (128 kB).
SLOTS = 1 << 16
MAP_BITS = 1 << 20
#: Share of the texts whose grams are counted.
COUNTED_SHARE = 0.1
#: Stands for what is before and after a text; no text or concept should hold it.
OUTSIDE = "\x00"


def _slot(gram: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(size))


def probe_rows(texts: DataFrame, doc: str, text: str, lengths: list[int], piece: int = PIECE) -> DataFrame:
    """(doc, _no, _piece, _at, _gram): a row for each position of a text and gram length."""
    reach = CONTEXT + max(lengths) + CONTEXT
    edge = F.lit(OUTSIDE * CONTEXT)
    body = F.concat(edge, F.col(text), F.lit(OUTSIDE * (CONTEXT + max(lengths))))
    pattern = f"(?s)(?=(.{{1,{piece + reach}}})).{{1,{piece}}}"
    pieces = texts.select(F.col(doc), F.posexplode(F.regexp_extract_all(body, F.lit(pattern), F.lit(1))).alias("_no", "_piece"))
    last = F.least(F.length("_piece") - CONTEXT, F.lit(piece)) * len(lengths) - 1
    rows = pieces.filter(F.length("_piece") > CONTEXT).select(doc, "_no", "_piece", F.explode(F.sequence(F.lit(0), last)).alias("_k"))
    at = F.floor(F.col("_k") / len(lengths)).cast("int") if len(lengths) > 1 else F.col("_k")
    q = F.element_at(F.array(*map(F.lit, lengths)), F.col("_k") % len(lengths) + 1) if len(lengths) > 1 else F.lit(lengths[0])
    return rows.select(doc, "_no", "_piece", at.alias("_at"), F.substring("_piece", at + 1 + CONTEXT, q).alias("_gram"))


def gram_frequencies(texts: DataFrame, doc: str, text: str, q: int, share: float = COUNTED_SHARE) -> DataFrame:
    """(slot, n): how often the grams of a slot occur in a share of the texts; at most ``SLOTS`` rows."""
    some = texts if share >= 1 else texts.filter(F.pmod(F.xxhash64(doc), F.lit(1000)) < int(share * 1000))
    grams = probe_rows(some, doc, text, [q]).select(_slot(F.col("_gram"), SLOTS).alias("slot"))
    return grams.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


def anchored(dictionary: DataFrame, frequencies: DataFrame, q: int, concept: str = "concept", concept_id: str = "concept_id") -> DataFrame:
    """(concept_id, concept, _gram, _offset): the rarest gram of each concept, the first of equals; a short concept is its own."""
    offsets = F.sequence(F.lit(0), F.greatest(F.length(concept) - q, F.lit(0)))
    grams = dictionary.select(concept_id, concept, F.explode(offsets).alias("_offset"))
    grams = grams.withColumn("_gram", F.substring(concept, F.col("_offset") + 1, F.lit(q)))
    counted = grams.withColumn("slot", _slot(F.col("_gram"), SLOTS)).join(F.broadcast(frequencies), "slot", "left")
    best = counted.groupBy(concept_id, concept).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_offset", "_gram")).alias("best"))
    return best.select(concept_id, concept, "best._gram", "best._offset")


def anchor_map(anchors: DataFrame) -> DataFrame:
    """One row with the bit map of the anchors as an array of ``MAP_BITS / 64`` numbers."""
    at = anchors.select(_slot(F.col("_gram"), MAP_BITS).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    dense = anchors.sparkSession.range(MAP_BITS // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("words"))


def passing(probes: DataFrame, bits: DataFrame) -> DataFrame:
    """Probes whose gram is in the map, which every task gets as a constant."""
    at = _slot(F.col("_gram"), MAP_BITS)
    word = F.get(bits.select("words").scalar(), F.shiftright(at, 6).cast("int"))
    held = probes.withColumns({"_word": word, "_bit": at}).filter("(_word & shiftleft(1L, cast(_bit & 63 as int))) != 0")
    return held.drop("_word", "_bit")


def anchored_occurrences(
    texts: DataFrame, dictionary: DataFrame, doc: str, text: str, *, whole_words: bool = False, concept: str = "concept",
    concept_id: str = "concept_id", broadcast_rows: int = BROADCAST_ROWS, piece: int = PIECE, share: float = COUNTED_SHARE,
) -> DataFrame:
    """The rows of ``match.occurrences``: (doc, concept_id, concept, start), nested and overlapping places too.

    Null texts have no places. ``doc`` must tell the texts apart where a concept is longer than ``CONTEXT``.
    """
    texts = texts.select(doc, text).filter(F.col(text).isNotNull())
    facts = dictionary.agg(F.min(F.length(concept)), F.count(F.lit(1))).first()
    q = max(SHORTEST_ANCHOR, min(facts[0] or 1, LONGEST_ANCHOR))
    keys = durable(anchored(dictionary, gram_frequencies(texts, doc, text, q, share), q, concept, concept_id), "anchors")
    lengths = sorted(r[0] for r in keys.select(F.length("_gram")).distinct().collect()) or [q]  # at most q rows
    body = F.concat(F.lit(OUTSIDE * CONTEXT), F.col(text), F.lit(OUTSIDE * (CONTEXT + max(lengths))))
    probes = held_places(texts, doc, body, lengths, gram_map(keys), piece, piece + CONTEXT + max(lengths) + CONTEXT, CONTEXT)
    size = F.length(concept)
    # What of the concept lies within the context of its anchor.
    left = F.least(F.col("_offset"), F.lit(CONTEXT - 1))
    right = F.least(size - F.col("_offset"), F.lit(CONTEXT + max(lengths) - 1))
    keys = keys.withColumns({"_left": left, "_seen": F.substring(concept, F.col("_offset") - left + 1, left + right), "_long": left + right < size})
    if facts[1] <= broadcast_rows:
        hits = probes.join(F.broadcast(keys), "_gram")
    else:
        salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = probes.withColumn("_salt", F.pmod(F.xxhash64(doc, "_no", "_at"), F.lit(SALTS)).cast("int")).join(salted, ["_gram", "_salt"])
    begin = F.col("_at") + CONTEXT - F.col("_left")  # in the piece, from 0
    found = F.substring("_piece", begin + 1, F.length("_seen")) == F.col("_seen")
    bounded = lambda c: is_boundary(c) | (c == OUTSIDE)
    start = F.col("_no") * piece + F.col("_at") - F.col("_offset")
    if whole_words:
        before, after = F.substring("_piece", begin, F.lit(1)), F.substring("_piece", begin + F.length("_seen") + 1, F.lit(1))
        found = found & (F.col("_long") | bounded(before) & bounded(after))
    seen = hits.filter(found).select(doc, concept_id, concept, start.alias("start"), "_long")
    if not keys.filter("_long").limit(1).count():
        return seen.drop("_long")
    rest = seen.filter("_long").join(texts, doc)
    right_place = F.substring(text, F.col("start") + 1, size) == F.col(concept)
    if whole_words:
        before, after = F.substring(text, F.col("start"), F.lit(1)), F.substring(text, F.col("start") + size + 1, F.lit(1))
        right_place = right_place & ((F.col("start") == 0) | is_boundary(before)) & ((after == "") | is_boundary(after))
    verified = rest.filter((F.col("start") >= 0) & right_place)
    return seen.filter(~F.col("_long")).drop("_long").unionByName(verified.select(doc, concept_id, concept, "start"))
