"""Operator 9: an n-gram Jaccard join by size, with components of its links.

Documents with the same set of shingles are one class, found by a 128-bit fingerprint; only classes are compared.

* Small sets (light) post every subset of a fixed size: for sizes k and l, the sets with a common subset of
  ``ceil(t * (k + l) / (1 + t))`` shingles are exactly the pairs that link.
* Large sets (heavy) post their prefix, the ``k - ceil(t * k) + 1`` first shingles in an order common to all sets, and a
  tenth more; two sets that link share more than a tenth of the smaller one's size of posted shingles, so sets with fewer
  posted shingles that any other set has leave at once. Their inverted lists are scanned for candidates, which are then verified on whole
  sets. The order goes by level of frequency, the frequent last: an array of at most 2**23 levels (the logarithm of how
  often tasks met a shingle's slot). Any array gives the same links; a good one gives short lists.
* The boundary is the size of least estimated cost, from the counts of the set sizes; small sets that may link with large
  ones post a prefix too.

No list is expanded into rows of all its pairs. In rounds, the smallest member of each list that still spans two components,
its hub, is compared with the other members, and leaves the list; members of one component need no comparing. With the hub
leave those of its component whose distance to it is so small that, by the triangle inequality of the Jaccard distance, no
member of another component can link with them. From the second round on, sets that share too few shingles with all others
in the lists leave first, and the hub is the set that shares most. Lists of at most ``SHORT`` members that still span
components after the first round (four times as many in each further round) are finished between their components: signatures
of 1,024 bits, compared inside the join, let through the pairs that can link, and only these become rows and are verified. The rounds end when no list spans two components, so no link between components is lost.

Postings travel as blocks of numbers by hash bucket; frequent shingles are spread over buckets by set as well, so that a
list of any length meets no single task.

Cases: null and empty texts (and texts of white space) have an empty set, link with nothing and are their own component;
rows with a null id link with nothing and have a null component; repeated rows and equal texts are one class, in the
component of its smallest id; texts that share their class's smallest id are taken as one node; an empty table gives no
rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, durable
from .common import lower_ascii, mix, public_columns, text_bytes, text_slices, tidy, window_hashes, word_bounds, word_hashes
from .components import components

SHORT = 32
#: The boundary is looked for up to this size; subsets of larger sets always cost more than their prefix.
LARGEST_LIGHT = 32
SLICE = 8_000_000
BUCKET_CHARS = 16_000_000
LEAST_BUCKETS = 256
#: 64-bit words of a set's bit signature, by which pairs of short lists are told apart before they are verified.
SIGNATURE = 16
#: Slots that tasks met less often, counting slices that met a shingle twice, have level 0.
FREQUENT = 4


def shingles(data: np.ndarray, n: int = 5) -> np.ndarray:
    """The sorted set of shingle hashes of a text in UTF-8; fewer words than ``n`` make one shingle."""
    data = lower_ascii(data)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    words = word_hashes(data, starts, ends)
    if len(words) >= n:
        return np.unique(window_hashes(words, n))
    return mix(window_hashes(words, len(words)) + np.uint64(len(words)))


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        a = mix(found ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
        b = mix(found ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def least_overlap(k: int, l: int, percent: int) -> int:
    """Shingles that sets of sizes k and l must share."""
    return -(-percent * (k + l) // (100 + percent))


def prefix_length(k: int, percent: int) -> int:
    return k - -(-percent * k // 100) + 1


def extra_length(k: int) -> int:
    """Shingles posted beyond the prefix: sets of sizes k and l that link share more than ``extra_length(min(k, l))`` posted ones."""
    return k // 10 if k > 40 else 0


def partner_sizes(k: int, percent: int) -> range:
    return range(-(-percent * k // 100), 100 * k // percent + 1)


def subset_plan(k: int, boundary: int, percent: int) -> list[tuple[int, int]]:
    """(partner size, subset size) of a light set: partners that are light too, and differ from it."""
    return [(l, c) for l in partner_sizes(k, percent) if l <= boundary and ((c := least_overlap(k, l, percent)) < k or l != k) and c <= min(k, l)]


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest light size, of least cost: rows posted, and shingles read to verify a candidate of each posted shingle."""

    def cost(boundary: int) -> float:
        total = 0.0
        for k, n in sizes.items():
            if k <= boundary:
                total += n * sum(math.comb(k, c) for _, c in subset_plan(k, boundary, percent))
            if k > boundary or partner_sizes(k, percent)[-1] > boundary:
                total += n * prefix_length(k, percent) * (1 + 2 * k)
        return total

    return min(range(LARGEST_LIGHT + 1), key=cost)


def _summaries(n: int, slots: int):
    """Class keys of documents, and counts of the slots of shingles that a slice has twice."""
    names = ["doc_id", "text_key", "n_shingles", "hi", "lo", "slot", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(slots, dtype=np.int32)
        for batch in text_slices(batches, "text", SLICE):
            size, hi, lo, seen, sets = [], [], [], set(), []
            for data in text_bytes(batch.column("text")):
                found = shingles(data, n) if data is not None else np.zeros(0, np.uint64)
                key = fingerprint(found)
                size.append(len(found))
                hi.append(key[0])
                lo.append(key[1])
                if key not in seen:
                    seen.add(key)
                    sets.append(found)
            every = np.sort(np.concatenate(sets))
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
            count = np.diff(np.r_[first, len(every)])
            often = count > 1
            np.add.at(times, (every[first[often]] % np.uint64(slots)).astype(np.int64), count[often].astype(np.int32))
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(size, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), none, none], names=names)
        slot = np.flatnonzero(times)
        none = pa.nulls(len(slot), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(slot), pa.array(times[slot].astype(np.int64))], names=names)

    return run


def _postings(n: int, percent: int, boundary: int, levels: np.ndarray, buckets: int):
    slots = np.uint64(len(levels))

    def tokens(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posted tokens of a set, and which of them are frequent."""
        k, out = len(found), []
        if k <= boundary:
            for l, c in subset_plan(k, boundary, percent):
                with np.errstate(over="ignore"):
                    sums = [sum(map(int, some)) & 0xFFFFFFFFFFFFFFFF for some in itertools.combinations(found.tolist(), c)]
                    out.append(mix(np.array(sums, dtype=np.uint64) ^ np.uint64(min(k, l) << 32 | max(k, l))))
        light = np.concatenate(out) if out else np.zeros(0, np.uint64)
        if k > boundary or partner_sizes(k, percent)[-1] > boundary:
            level = levels[(found % slots).astype(np.int64)]
            first = np.argsort(level, kind="stable")[: prefix_length(k, percent) + extra_length(k)]
            return np.concatenate([light, found[first]]), np.r_[np.zeros(len(light), bool), level[first] > 0]
        return light, np.zeros(len(light), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            token, node, often, seen = [], [], [], set()
            for data in text_bytes(batch.column("text")):
                found = shingles(data, n) if data is not None else np.zeros(0, np.uint64)
                if not len(found) or (key := fingerprint(found)) in seen:
                    continue
                seen.add(key)
                posted, common = tokens(found)
                token.append(posted)
                often.append(common)
                node.append(np.full(len(posted), key[0], dtype=np.int64))
            if not token:
                continue
            token, node, often = np.concatenate(token), np.concatenate(node), np.concatenate(often)
            if not len(token):
                continue
            with np.errstate(over="ignore"):
                spread = np.where(often, mix(token ^ mix(node.view(np.uint64))), mix(token))
            bucket = (spread % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            token, node, often, bucket = token[order], node[order], often[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[cuts[1:], len(bucket)]
            columns = [[a[s:e].tobytes() for s, e in zip(cuts, ends)] for a in (token, node, often)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "tokens", "nodes", "often"])

    return run


def _lists(group: pa.Table) -> pa.Table:
    """Postings of a bucket, without the rare tokens that a single set has."""
    token, node, often = (np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=t) for c, t in (("tokens", np.int64), ("nodes", np.int64), ("often", bool)))
    order = np.lexsort((node, token))
    token, node, often = token[order], node[order], often[order]
    fresh = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
    token, node, often = token[fresh], node[fresh], often[fresh]
    same = token[1:] == token[:-1]
    keep = often | np.r_[False, same] | np.r_[same, False]
    return pa.table({"token": token[keep], "node": node[keep]})


def signature(found: np.ndarray) -> np.ndarray:
    """Bits of the low ends of the shingles: a bit that another set lacks is a shingle at least that it lacks."""
    out = np.zeros(SIGNATURE, dtype=np.uint64)
    low = found & np.uint64(64 * SIGNATURE - 1)
    np.bitwise_or.at(out, (low >> np.uint64(6)).astype(np.int64), np.uint64(1) << (low & np.uint64(63)))
    return out.view(np.int64)


_BITS = [f"s{k}" for k in range(SIGNATURE)]
_SETS = "rep bigint, shingles binary, " + ", ".join(f"{c} bigint" for c in _BITS)


def _outside(one: str, two: str) -> Column:
    """How many bits of a signature the other lacks; columns are named ``<one>s0``, ``<two>s0`` and so on."""
    return F.expr(" + ".join(f"bit_count({one}{c} & ~{two}{c})" for c in _BITS))


def _sets(n: int):
    """Sets of the texts whose fingerprint is among the keys of their id, with their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = [shingles(data, n) for data in text_bytes(batch.column("text"))]
            right = [fingerprint(f)[0] in keys for f, keys in zip(found, batch.column("keys").to_pylist())]
            reps = [r for r, ok in zip(batch.column("doc_id").to_pylist(), right) if ok]
            kept = [f for f, ok in zip(found, right) if ok]
            bits = np.stack([signature(f) for f in kept], axis=1) if kept else np.zeros((SIGNATURE, 0), dtype=np.int64)
            columns = [pa.array(reps, pa.int64()), pa.array([f.tobytes() for f in kept], pa.binary()), *map(pa.array, bits)]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "shingles", *_BITS])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, distance = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common))
                distance.append(1 - common / (len(both) - common))
            columns = [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(distance, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "linked", "distance"])

    return run


def _levels(slot_counts: DataFrame, slots: int) -> np.ndarray:
    """Level of each slot, from 0 to 15; at most ``slots / 16`` rows of 16 levels reach the driver."""
    often = slot_counts.groupBy("slot").agg(F.sum("times").alias("times")).filter(F.col("times") >= FREQUENT)
    level = F.least(F.lit(15), F.floor(F.log2("times")) - 1).cast("long")
    placed = often.select((F.col("slot") / 16).cast("int").alias("word"), level.alias("level"), (F.col("slot") % 16 * 4).cast("int").alias("shift"))
    words = placed.groupBy("word").agg(F.bit_or(F.expr("shiftleft(level, shift)")).alias("levels")).toArrow()
    packed = np.zeros(slots // 16, dtype=np.int64)
    packed[words.column("word").to_numpy()] = words.column("levels").to_numpy()
    halves = packed.view(np.uint8)
    return np.stack([halves & 15, halves >> 4], axis=1).reshape(-1)


def jaccard_groups(docs: DataFrame, percent: int = 80, n: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key), one row per document; ``text_key`` is the 64-bit hash of the text, for rows that share an id."""
    rows = public_columns(docs, doc_id=doc_id, text=text)
    n_docs, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    slots = 1 << min(23, max(16, n_docs.bit_length() + 5))
    summary = durable(rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(tidy(_summaries(n, slots)), "doc_id bigint, text_key bigint, n_shingles bigint, hi bigint, lo bigint, slot bigint, times bigint"), "shingle-summaries")
    keyed = summary.filter("slot is null").select("doc_id", "text_key", "n_shingles", "hi", "lo")
    real = keyed.filter("n_shingles > 0 and doc_id is not null")
    classes = durable(real.groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("rep")), "shingle-classes")
    small = classes.filter(F.col("n_shingles") <= 2 * LARGEST_LIGHT).groupBy("n_shingles").agg(F.count(F.lit(1)).alias("n"))
    boundary = choose_boundary({r["n_shingles"]: r["n"] for r in small.collect()}, percent)  # at most 2 * LARGEST_LIGHT rows
    levels = _levels(summary.filter("slot is not null"), slots)

    buckets = max(LEAST_BUCKETS, chars // BUCKET_CHARS)
    posted = rows.filter("doc_id is not null").mapInArrow(tidy(_postings(n, percent, boundary, levels, buckets)), "bucket int, tokens binary, nodes binary, often binary")
    lists = durable(posted.groupBy("bucket").applyInArrow(_lists, "token bigint, node bigint"), "lists")
    by_node = classes.select(F.col("hi").alias("node"), "rep", F.col("n_shingles").alias("size"))
    least_partner = F.ceil(F.col("size") * percent / 100)
    enough = F.when(least_partner > 40, F.floor(least_partner / 10) + 1).otherwise(1)  # extra_length of the least partner, and 1
    shared = durable(lists.groupBy("node").agg(F.count(F.lit(1)).alias("posted")).join(by_node, "node").filter(F.col("posted") >= enough), "posted-counts")
    rows_of = lists.join(shared.select("node", "rep", "size"), "node").select("token", "rep", "size").distinct()
    lists_of = durable(rows_of, "list-rows")
    # lists of the same members say the same: keep one of each
    alike = lists_of.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("h1"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(20)")).alias("h2"))
    kept = alike.filter("n > 1").groupBy("n", "h1", "h2").agg(F.min("token").alias("token")).select("token")
    members = durable(lists_of.join(kept, "token"), "members")
    discard(lists_of)
    discard(lists)

    wanted = members.select("rep").distinct().join(classes.select("rep", "hi"), "rep").groupBy(F.col("rep").alias("doc_id")).agg(F.collect_set("hi").alias("keys"))
    texts = rows.filter("text is not null").join(wanted, "doc_id").withColumn("text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "text_key"])
    sets = durable(texts.select("doc_id", "text", "keys").mapInArrow(tidy(_sets(n)), _SETS), "sets")
    roots = _linked_components(members, sets, percent)

    classes_rooted = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    joined = keyed.join(classes_rooted, ["hi", "lo", "n_shingles"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), "text_key")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(v.as_buffer(), dtype=np.int64) for v in batch.column("shingles")]
        for k in range(0, len(sets), 256):
            some = sets[k : k + 256]
            reps = np.repeat(batch.column("rep").to_numpy()[k : k + 256], [len(x) for x in some])
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.concatenate(some))], names=["rep", "token"])


def _shared(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, shared): how many shingles of a set any other set in the lists has; no overlap can be larger."""
    wanted = lists.select("rep").distinct()
    tokens = durable(sets.select("rep", "shingles").join(wanted, "rep", "left_semi").mapInArrow(_tokens, "rep bigint, token bigint"), "list-shingles")
    common = tokens.groupBy("token").agg((F.min("rep") != F.max("rep")).alias("common")).filter("common").select("token")
    return durable(tokens.join(common, "token").groupBy("rep").agg(F.count(F.lit(1)).alias("shared")), "shared")


def _linked_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components of the links among ``members`` (token, rep, size) of the lists."""
    spark = members.sparkSession
    roots = durable(spark.createDataFrame([], "node bigint, root bigint"), "roots")
    tried = durable(spark.createDataFrame([], "a bigint, b bigint, linked boolean, distance double"), "checked-pairs")
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    needed = lambda k, l: F.ceil(F.lit(percent) * (k + l) / F.lit(100 + percent))
    short = 0
    while True:
        at = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "size", F.coalesce("root", "rep").alias("root"))
        if short:
            mixed = at.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("size").alias("least")).filter("low < high")
            at = durable(at.join(mixed.select("token", "least"), "token"), "mixed-lists")
            if at.isEmpty():
                return roots
            at = at.join(_shared(at, sets), "rep").filter(F.col("shared") >= needed(F.col("size"), F.col("least"))).drop("least")
        else:
            at = at.withColumn("shared", F.col("size"))
        # the hub shares most of its set, so it is near the middle of its copies
        score = F.struct((F.col("shared") / F.col("size")).alias("share"), (-F.col("rep")).alias("no"), "size", "shared")
        heads = at.groupBy("token").agg(F.max(score).alias("hub"), F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
        heads = heads.filter("low < high").select(
            "token", (-F.col("hub.no")).alias("hub"), F.col("hub.size").alias("hub_size"), F.col("hub.shared").alias("hub_shared"), "n"
        )
        open_ = durable(at.join(heads, "token"), "open-lists")
        if open_.isEmpty():
            return roots
        fits = lambda k, l, s, t: F.least(s, t, k, l) >= needed(k, l)
        is_short = F.col("n") <= short
        around = open_.filter(~is_short & (F.col("rep") != F.col("hub")) & fits(F.col("size"), F.col("hub_size"), F.col("shared"), F.col("hub_shared")))
        pairs = around.select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        if short:
            signed = open_.filter(is_short).join(sets.select("rep", *_BITS), "rep")
            named = lambda v, k, s, p, side: [F.col(c).alias(n) for c, n in (("rep", v), ("size", k), ("shared", s), ("root", p), *((b, f"{side}{b}") for b in _BITS))]
            x, y = signed.select("token", *named("a", "k", "s", "p", "x")), signed.select("token", *named("b", "l", "t", "q", "y"))
            # all of it is the condition of the join: what a signature rules out is no row
            enough = needed(F.col("k"), F.col("l"))
            alike = (F.col("k") - _outside("x", "y") >= enough) & (F.col("l") - _outside("y", "x") >= enough)
            across = x.join(y, "token").filter((F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & fits(F.col("k"), F.col("l"), F.col("s"), F.col("t")) & alike)
            pairs = pairs.union(across.select("a", "b"))
        pairs = pairs.distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
        checked = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(_verify(percent)), "a bigint, b bigint, linked boolean, distance double")
        following = durable(tried.union(checked), "checked-pairs")
        discard(tried)
        tried = following
        following = components(tried.filter("linked").select("a", "b"))
        discard(roots)
        roots = following
        following = durable(_left_over(open_.filter(~is_short), tried, roots, percent), "members")
        discard(members, open_)
        members = following
        short = SHORT if not short else 4 * short


def _left_over(lists: DataFrame, tried: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Members (token, rep, size) that may still link with a member of another component, once the hub is compared.

    A member of the hub's component at distance d from the hub is at least ``m - d`` from all members of other
    components, where m is their least distance to the hub; where that is more than a link allows, it leaves.
    """
    known = tried.select(F.col("a").alias("hub"), F.col("b").alias("rep"), "distance")
    now = roots.select(F.col("node").alias("rep"), F.col("root").alias("now"))
    of_hub = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_now"))
    rows = lists.filter(F.col("rep") != F.col("hub")).join(known, ["hub", "rep"], "left").join(now, "rep", "left").join(of_hub, "hub", "left")
    # not compared, as sizes or shared shingles do not suffice: at least this far
    most = F.least("size", "hub_size", "shared", "hub_shared")
    by_size = 1 - most / (F.col("size") + F.col("hub_size") - most)
    rows = rows.select(
        "token", "rep", "size", "distance", F.coalesce("distance", by_size).alias("least"),
        (F.coalesce("now", "rep") == F.coalesce("hub_now", "hub")).alias("same"),
    )
    nearest = rows.filter(~F.col("same")).groupBy("token").agg(F.min("least").alias("nearest"))  # lists of one component end here
    safe = F.col("same") & (F.col("nearest") - F.col("distance") > 1 - percent / 100 + 1e-9)
    return rows.join(nearest, "token").filter(~F.coalesce(safe, F.lit(False))).select("token", "rep", "size")
