"""Ordered analytics that survive hot groups.

A window over a group runs in one task, so a group holding a third of the table would pin
it. ``ordered`` first measures the largest group. Below ``limit`` rows a plain window is
used. Above it the rows are range-partitioned by (group, order) so a hot group spans many
tasks, the window runs inside each range, and the value carried over each range boundary
comes from a table with one row per (range, group).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.plans.session import PART_ROWS, cut, table_partitions

GROUP_ROWS = 2_000_000
# Buckets of keys that are counted to find those with a hot key.
BUCKETS = 65_536


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def grouped(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], parts: int | None = None, hot: int = PART_ROWS
) -> DataFrame:
    """``groupBy(keys).agg(aggs)`` in partitions whose number grows with the table.

    Buckets of keys with more than ``hot`` rows are aggregated apart, where copies combine before
    the shuffle; there are fewer of them than rows / hot. All other rows are dealt by key.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = table_partitions(df) if parts is None else parts
    if parts <= usual:
        return df.groupBy(*keys).agg(*aggs)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    full = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot)
    heavy = [r["_b"] for r in full.collect()]
    rest = df.where(~bucket.isin(heavy)) if heavy else df
    out = rest.repartition(parts, *keys).groupBy(*keys).agg(*aggs)
    if heavy:
        out = out.unionByName(df.where(bucket.isin(heavy)).groupBy(*keys).agg(*aggs))
    return out


def _step(kind: str, col: str | None, w_order, w_run):
    if kind == "row_number":
        return F.row_number().over(w_order)
    if kind == "lag":
        return F.lag(col).over(w_order)
    if kind == "running_sum":
        return F.sum(col).over(w_run)
    if kind == "last_before":
        return F.last(col, ignorenulls=True).over(
            w_order.rowsBetween(Window.unboundedPreceding, -1)
        )
    if kind == "max_before":
        return F.max(col).over(w_order.rowsBetween(Window.unboundedPreceding, -1))
    raise ValueError(kind)


def ordered(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    steps: Mapping[str, tuple[str, str | None]],
    limit: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add ordered columns. ``steps``: name -> (kind, column); kinds are row_number, lag,
    running_sum, last_before (newest non-null) and max_before.

    ``order`` must be a total order inside each group (end it with a unique column).
    ``largest`` passes a group size already measured.
    """
    largest = largest_group(df, group) if largest is None else largest
    if largest <= limit:
        w = Window.partitionBy(*group).orderBy(*order)
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({n: _step(k, c, w, run) for n, (k, c) in steps.items()})
    return _ranged(df, group, order, steps)


def _ranged(df, group, order, steps) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The layout is cut so both readers below see the same range boundaries.
    base = cut(
        df.repartitionByRange(parts, *group, *order).withColumn("_pid", F.spark_partition_id())
    )
    w = Window.partitionBy("_pid", *group).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.withColumns({n: _step(k, c, w, run) for n, (k, c) in steps.items()})
    local = local.withColumn("_first", F.row_number().over(w) == 1)

    key = F.struct(*order)
    aggs: list[Column] = []
    for n, (k, c) in steps.items():
        if k == "row_number":
            aggs.append(F.count(F.lit(1)).alias(f"_{n}"))
        elif k == "running_sum":
            aggs.append(F.sum(c).alias(f"_{n}"))
        elif k == "max_before":
            aggs.append(F.max(c).alias(f"_{n}"))
        elif k == "lag":
            aggs.append(F.max_by(F.struct(F.col(c).alias("v")), key).alias(f"_{n}"))
        else:
            hit = F.when(F.col(c).isNotNull(), key)
            aggs.append(F.max_by(F.struct(F.col(c).alias("v")), hit).alias(f"_{n}"))
    edges = base.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    # At most one row per range for any group.
    we = Window.partitionBy(*group).orderBy("_pid")
    before = we.rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = {"_has": F.sum("_n").over(before)}
    for n, (k, _) in steps.items():
        if k in ("row_number", "running_sum"):
            carry_cols[f"_{n}"] = F.sum(f"_{n}").over(before)
        elif k == "max_before":
            carry_cols[f"_{n}"] = F.max(f"_{n}").over(before)
        elif k == "lag":
            carry_cols[f"_{n}"] = F.lag(f"_{n}").over(we)
        else:
            carry_cols[f"_{n}"] = F.last(f"_{n}", ignorenulls=True).over(before)
    carry = edges.select(
        F.col("_pid").alias("_cpid"),
        *[F.col(g).alias(f"_c_{g}") for g in group],
        *[c.alias(n) for n, c in carry_cols.items()],
    ).where(F.col("_has").isNotNull())
    # Only groups that continue from an earlier range remain: fewer rows than ranges.
    on = reduce(
        lambda a, b: a & b,
        [F.col(g).eqNullSafe(F.col(f"_c_{g}")) for g in group],
        F.col("_pid") == F.col("_cpid"),
    )
    out = local.join(F.broadcast(carry), on, "left")
    final = {}
    for n, (k, _) in steps.items():
        if k in ("row_number", "running_sum"):
            zero = F.lit(0)
            final[n] = F.when(
                F.col(f"_{n}").isNull(), F.col(n)
            ).otherwise(F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"_{n}"), zero))
        elif k == "max_before":
            final[n] = F.greatest(n, f"_{n}")
        elif k == "lag":
            final[n] = F.when(F.col("_first"), F.col(f"_{n}.v")).otherwise(F.col(n))
        else:
            final[n] = F.coalesce(F.col(n), F.col(f"_{n}.v"))
    return out.withColumns(final).select(*df.columns, *steps)


def group_median(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    name: str,
    limit: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Exact median per group; hot groups are ranked across ranges, never gathered."""
    rows = df.where(F.col(value).isNotNull())
    largest = largest_group(rows, group) if largest is None else largest
    if largest <= limit:
        return rows.groupBy(*group).agg(F.median(value).alias(name))
    slim = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_k"))
    total = slim.groupBy(*group).agg(F.sum("_k").alias("_t"))
    run = _ranged(slim, group, [value], {"_r": ("running_sum", "_k")})
    t = run.join(total, list(group))
    lo = F.floor((F.col("_t") + 1) / 2)
    hi = F.floor((F.col("_t") + 2) / 2)
    # A value covers ranks (_r - _k, _r]; the median averages the two middle ranks.
    covers = lambda rank: (rank > F.col("_r") - F.col("_k")) & (rank <= F.col("_r"))
    return t.groupBy(*group).agg(
        (
            (F.max(F.when(covers(lo), F.col(value))) + F.max(F.when(covers(hi), F.col(value))))
            / 2
        ).alias(name)
    )
