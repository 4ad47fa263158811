"""Operator 2: mixing sources to target weights by entropy balancing. DataFrame functions only.

Document i of source s gets the rate ``min(cap, exp(tilt_s * size_i))``: of all rates between 0 and ``cap`` that
give source s its target in words, those of least relative entropy to taking every document once. The tilts solve the
convex dual, whose gradient and Hessian are one row per source, summed by Spark over the distinct (source, size) pairs;
each Newton step is kept inside a bracket of the root, as rates at the cap have no slope.

Rates become copies by cumulative rounding along descending size inside each source, in whole numbers (rates are
multiples of ``1/UNIT``): the taken words of a source miss its target by at most its largest document, plus what the
unit rounds off; the best of several beginnings of the rounding, and one document with a copy more or less, leave a few
words in most cases.

Cases: a null text has size 0 (it takes 0 words, whatever its rate); a null
source is a source of its own, last; repeated rows are documents of their own; a source without words has target 0; an
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import with_running
from ..session import discard, durable
from .common import n_words, public_columns

WEIGHTS = (5, 2, 1)
CAP = 3
#: Rates are whole multiples of 1 / UNIT.
UNIT = 1 << 20
#: Places at which the cumulative rounding may begin.
SHIFTS = 32
TOLERANCE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets of all sources: shares of all words by weight, at most ``cap`` times the source, the excess shared again.

    The result of sharing again until none is above is ``min(cap * size, level * weight)`` with one common level: the
    largest of the levels that follow when the sources of smallest ``cap * size / weight`` stop at their cap.
    Input and windows have one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    everything = Window.partitionBy()
    first = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    after = first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("most").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - stopped) / F.sum("weight").over(after)
    sources = sources.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    capped = F.col("most") <= F.col("level") * F.col("weight")
    return sources.select(
        "source", "source_size", "n_docs", capped.alias("capped"),
        F.when(capped, F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"),
    )


def _rate(tilt: Column, size: Column, cap: int) -> Column:
    return F.exp(F.least(tilt * size, F.lit(math.log(cap))))


def solve_tilts(histogram: DataFrame, sources: DataFrame, cap: int = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``tilt`` (per word) to ``sources``; ``histogram`` has (source, size, n).

    Newton's method on all sources at once until each is within ``tolerance`` of its target. The state has one row per
    source and is written after each step; the driver sees the largest miss.
    """
    log_cap = math.log(cap)
    least = histogram.filter("size > 0").groupBy("source").agg(F.min("size").alias("smallest"))
    state = sources.join(least, sources["source"].eqNullSafe(least["source"]), "left").drop(least["source"])
    up = F.col("target") > F.col("source_size")
    # every rate is at the cap from this tilt on, and no rate is above exp(-low) from that one on
    high = F.when(up, F.lit(log_cap) / F.col("smallest")).otherwise(0.0)
    low = F.when(up, 0.0).otherwise(F.log(F.col("target") / F.col("source_size")) / F.col("smallest"))
    fixed = F.col("capped") | F.col("smallest").isNull()
    state = state.withColumns({"low": low, "high": high, "tilt": F.lit(0.0), "fixed": fixed})
    state = durable(state, "tilts")
    while True:
        h, s = histogram.alias("h"), state.select("source", "tilt").alias("s")
        joined = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source")))
        size, tilt = F.col("h.size").cast("double"), F.col("s.tilt")
        words = F.col("h.n") * size * _rate(tilt, size, cap)
        slope = F.when(tilt * size < log_cap, words * size).otherwise(0.0)
        dual = joined.groupBy(F.col("h.source").alias("source")).agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        d = dual.alias("d")
        step = state.join(d, state["source"].eqNullSafe(F.col("d.source")), "left").drop(F.col("d.source"))
        miss = F.col("words") - F.col("target")
        step = step.withColumns({
            "miss": F.when(F.col("fixed"), 0.0).otherwise(F.abs(miss) / F.col("target")),
            "low": F.when(miss < 0, F.col("tilt")).otherwise(F.col("low")),
            "high": F.when(miss > 0, F.col("tilt")).otherwise(F.col("high")),
            "newton": F.col("tilt") - F.when(F.col("slope") > 0, miss / F.col("slope")),
        })
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        better = F.when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.col("fixed") | (F.col("miss") <= tolerance) | (F.col("high") - F.col("low") <= F.abs(F.col("high")) * 1e-15)
        step = step.withColumn("tilt", F.when(done, F.col("tilt")).otherwise(better)).withColumn("done", done)
        following = durable(step.drop("newton", "words", "slope"), "tilts")
        discard(state)
        state = following.drop("miss", "done")
        if following.filter(~F.col("done")).isEmpty():
            return state.select("source", "source_size", "n_docs", "target", "capped", "tilt")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), one row per document, repeats of rows included.

    Documents without words get the rate 1 unless their source is at its cap.
    """
    sizes = public_columns(docs, doc_id=doc_id, source=source, text=text).select(
        "doc_id", "source", F.xxhash64("text").alias("text_key"), n_words(F.col("text")).alias("size")
    )
    sizes = durable(sizes, "sizes")  # numbers only; the ranges below are found by sampling them
    histogram = durable(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    solved = solve_tilts(histogram, source_targets(sizes, weights, cap), cap)
    rate = F.when(F.col("capped"), F.lit(float(cap))).otherwise(_rate(F.col("tilt"), F.col("size").cast("double"), cap))
    units = F.round(rate * UNIT).cast("long")

    both = histogram.join(solved, histogram["source"].eqNullSafe(solved["source"])).drop(solved["source"])
    totals = both.groupBy("source").agg(F.sum(F.col("n") * units).alias("units"))
    earlier = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # one row per source
    totals = totals.select("source", F.coalesce(F.sum("units").over(earlier), F.lit(0)).cast("long").alias("source_start"))
    plan = durable(solved.join(totals, solved["source"].eqNullSafe(totals["source"])).drop(totals["source"]), "mix-plan")

    rows = sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    rows = durable(rows.select("doc_id", "source", "text_key", "size", "source_size", "target", "source_start", units.alias("units")), "rates")
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_key")]
    placed = durable(with_running(rows, order, ["units"]).withColumn("row", F.monotonically_increasing_id()), "placed")

    def copies(shift: Column) -> Column:
        start = F.col("units_before") - F.col("source_start") + shift
        bits = UNIT.bit_length() - 1
        return F.shiftright(start + F.col("units"), bits) - F.shiftright(start, bits)

    # any shift of the rounding keeps the bound; of SHIFTS of them, each source gets the one that comes nearest its target
    shifts = [k * UNIT // SHIFTS for k in range(SHIFTS)]
    taken = placed.groupBy("source").agg(
        F.first("target").alias("target"), *[F.sum(copies(F.lit(x)) * F.col("size")).alias(f"t{x}") for x in shifts]
    )
    misses = F.array(*[
        F.struct(F.abs(F.col(f"t{x}") - F.col("target")).alias("miss"), F.lit(x).cast("long").alias("shift"), (F.col("target") - F.col(f"t{x}")).alias("short")) for x in shifts
    ])
    best = durable(taken.select("source", F.array_min(misses).alias("b")).select("source", "b.shift", "b.short"), "shifts")
    out = placed.join(best, placed["source"].eqNullSafe(best["source"])).drop(best["source"]).withColumn("copies", copies(F.col("shift")))

    # then one document of each source, of the size that is nearest what is still missing, gets a copy more or less
    change = F.when(F.col("short") > 0, 1).otherwise(-1)
    fits = (F.col("size") > 0) & (F.col("size") < 2 * F.abs("short")) & (F.col("copies") + change).between(0, cap)
    last = out.filter(fits).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.abs("short")).alias("rest"), "row", change.alias("change"))).alias("m"))
    last = durable(last.select(F.col("m.row").alias("row"), F.col("m.change").alias("change")), "last-copies")
    out = out.join(last, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("units") / UNIT).alias("rate"), "copies",
        (F.col("copies") * F.col("size")).alias("taken"), "text_key",
    )


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Rows equal in id, source and text are one row first, with the
    copies of all of them."""
    keys = ["__mix_id", "__mix_source", "__mix_text"]
    plan = mix_sources(docs, weights, cap, doc_id, source, text).groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("mix_copies"))
    plan = plan.filter("mix_copies > 0").toDF("__plan_id", "__plan_source", "__plan_text", "__mix_copies")
    rows = docs.withColumns({"__mix_id": F.col(doc_id), "__mix_source": F.col(source), "__mix_text": F.xxhash64(text)}).dropDuplicates(keys)
    same = F.col("__mix_id").eqNullSafe(F.col("__plan_id")) & F.col("__mix_source").eqNullSafe(F.col("__plan_source")) & F.col("__mix_text").eqNullSafe(F.col("__plan_text"))
    repeated = rows.join(plan, same).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
