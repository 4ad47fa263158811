"""Similarity of two vertices from their degrees, shared neighbours and citation counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR_NAMES = ["shared", "geometric", "cosine", "simpson", "preferential", "dice", "jaccard"]
PAIR_CITATION_NAMES = [
    "sum_c_per_paper", "prod_c_per_paper", "sum_c_m", "sum_ct_m", "sum_delta", "sum_delta_m",
    "min_c", "max_c", "min_ct", "max_ct", "min_delta", "max_delta", "min_num", "max_num",
]


def pair_indices(n: Column, d1: Column, d2: Column) -> dict[str, Column]:
    """Shared-neighbour indices with the zero guards of each formula."""
    n, d1, d2 = (c.cast("double") for c in (n, d1, d2))
    zero = F.lit(0.0)
    either_zero = (d1 == 0) | (d2 == 0)

    def guarded(value: Column) -> Column:
        return F.when(either_zero, zero).otherwise(value)

    geometric = guarded(n * n / F.nullif(d1 * d2, zero))
    union = d1 + d2 - n
    return {
        "shared": n,
        "geometric": geometric,
        "cosine": F.sqrt(geometric),
        "simpson": guarded(n / F.nullif(F.least(d1, d2), zero)),
        "preferential": guarded(d1 * d2),
        "dice": F.when((d1 == 0) & (d2 == 0), zero).otherwise(2 * n / F.nullif(d1 + d2, zero)),
        "jaccard": F.when(union > 0, n / F.nullif(union, zero)).otherwise(zero),
    }


def pair_citations(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Combine the yearly citation columns (c, ct, delta, num and their means) of two vertices."""
    papers = (a["num"] + b["num"]).cast("double")
    zero = F.lit(0.0)

    def per_paper(value: Column) -> Column:
        return F.when(papers == 0, zero).otherwise(value / F.nullif(papers, zero))

    out = {
        "sum_c_per_paper": per_paper((a["c"] + b["c"]).cast("double")),
        "prod_c_per_paper": per_paper(a["c"].cast("double") * b["c"].cast("double")),
        "sum_c_m": a["c_m"] + b["c_m"],
        "sum_ct_m": a["ct_m"] + b["ct_m"],
        "sum_delta": (a["delta"] + b["delta"]).cast("double"),
        "sum_delta_m": a["delta_m"] + b["delta_m"],
    }
    for name in ("c", "ct", "delta", "num"):
        out[f"min_{name}"] = F.least(a[name], b[name]).cast("double")
        out[f"max_{name}"] = F.greatest(a[name], b[name]).cast("double")
    return out
