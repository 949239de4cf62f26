"""Calibration counts and benchmark distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.plans.ordered import GROUP_ROWS, _ranged, group_median, largest_group


def calibration_report(cases: DataFrame, observed: DataFrame) -> DataFrame:
    """TP/FP/FN, degraded and unsupported per (capability, framework).

    ``cases(id, capability, framework, status)``, ``observed(id, hits)``.
    """
    hits = observed.groupBy("id").agg(F.sum("hits").alias("hits"))
    j = cases.join(hits, "id", "left").withColumn("fired", F.coalesce("hits", F.lit(0)) > 0)
    is_ = lambda s: F.col("status") == s
    return j.groupBy("capability", "framework").agg(
        F.count_if(is_("positive") & F.col("fired")).alias("tp"),
        F.count_if(is_("negative") & F.col("fired")).alias("fp"),
        F.count_if(is_("positive") & ~F.col("fired")).alias("fn"),
        F.count_if(is_("degraded")).alias("degraded"),
        F.count_if(is_("unsupported")).alias("unsupported"),
    )


def calibration_budgets(report: DataFrame, budgets: DataFrame) -> DataFrame:
    """Capabilities outside their budget (tp_min, fp_max, fn_max)."""
    j = report.join(budgets, "capability")
    return j.select(
        "capability",
        "framework",
        (
            (F.col("tp") >= F.col("tp_min"))
            & (F.col("fp") <= F.col("fp_max"))
            & (F.col("fn") <= F.col("fn_max"))
        ).alias("within"),
    )


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float], limit: int = GROUP_ROWS
) -> DataFrame:
    """Nearest-rank percentiles: the value at position ceil(p * n) of the sorted group.

    NULLs have no rank on either side of ``limit``.
    """
    df = df.where(F.col(value).isNotNull())
    if largest_group(df, keys) <= limit:
        aggs = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(n) for n, p in at.items()]
        return df.groupBy(*keys).agg(*aggs)
    slim = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    total = slim.groupBy(*keys).agg(F.sum("_k").alias("_t"))
    run = _ranged(slim, keys, [value], {"_r": ("running_sum", "_k")}).join(total, list(keys))
    aggs = []
    for n, p in at.items():
        rank = F.greatest(F.ceil(F.col("_t") * p), F.lit(1))
        aggs.append(F.min(F.when(F.col("_r") >= rank, F.col(value))).alias(n))
    return run.groupBy(*keys).agg(*aggs)


def bench_distribution(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, median, min, max, nearest-rank p90 and IQR, population deviation."""
    flat = samples.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_pop(value).alias("sigma"),
    )
    mid = group_median(samples, keys, value, "median")
    pct = nearest_rank(samples, keys, value, {"q1": 0.25, "q3": 0.75, "p90": 0.9})
    out = flat.join(mid, list(keys)).join(pct, list(keys))
    return out.withColumn("iqr", F.col("q3") - F.col("q1")).drop("q1", "q3")


def bench_gate(samples: DataFrame, key: str, value: str, gate_pct: float = 10.0) -> DataFrame:
    """Median of current against base per fixture; pass when the rise stays within the gate."""
    mid = group_median(samples, [key, "version"], value, "m")
    g = mid.groupBy(key).agg(
        F.max(F.when(F.col("version") == "base", F.col("m"))).alias("base"),
        F.max(F.when(F.col("version") == "current", F.col("m"))).alias("current"),
    )
    delta = (F.col("current") - F.col("base")) / F.col("base") * 100
    return g.withColumn("delta_pct", delta).withColumn("passed", F.col("delta_pct") <= gate_pct)


def interp_percentile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, name: str, limit: int = GROUP_ROWS
) -> DataFrame:
    """Linear interpolation between the two ranks around p * (n - 1); NULLs have no rank."""
    df = df.where(F.col(value).isNotNull())
    if largest_group(df, keys) <= limit:
        return df.groupBy(*keys).agg(F.percentile(value, p).alias(name))
    slim = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    total = slim.groupBy(*keys).agg(F.sum("_k").alias("_t"))
    t = _ranged(slim, keys, [value], {"_r": ("running_sum", "_k")}).join(total, list(keys))
    at = (F.col("_t") - 1) * p
    pick = lambda rank: F.min(F.when(F.col("_r") >= rank + 1, F.col(value)))
    lo, hi = F.floor(at), F.ceil(at)
    g = t.groupBy(*keys).agg(pick(lo).alias("_lo"), pick(hi).alias("_hi"), F.max(at).alias("_at"))
    frac = F.col("_at") - F.floor("_at")
    return g.select(*keys, (F.col("_lo") * (1 - frac) + F.col("_hi") * frac).alias(name))
