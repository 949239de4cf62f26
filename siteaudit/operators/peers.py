"""Row groups of siblings by successors and pointer doubling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteaudit.plans.ordered import GROUP_ROWS, largest_group, ordered
from siteaudit.plans.session import cut

SHARD_ROWS = 200_000


def first_above(values: np.ndarray, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each query the first place at or after ``start`` whose value exceeds ``bound``, else the length.

    A table of maxima over runs of 2^k values lets all queries leap together.
    """
    n = len(values)
    tables = [values]
    while 2 << (len(tables) - 1) <= n:
        last, half = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.maximum(last[:-half], last[half:]))
    at = start.copy()
    for k in range(len(tables) - 1, -1, -1):
        room = at + (1 << k) <= n
        most = tables[k][np.where(room, at, 0)]
        at = np.where(room & ~(most > bound), at + (1 << k), at)
    return at


def successors(top: np.ndarray, bottom: np.ndarray, o_top, o_bottom, after) -> np.ndarray:
    """Place of the first span at or after ``after`` that does not join the group opened by o.

    A later span joins o unless it is empty, or begins below o's middle and has its own middle
    below o's bottom. Spans are sorted by (top, bottom); an o of no height is joined by nothing.
    """
    height = bottom - top
    # An empty span opens a group whatever came before.
    empty = np.where(height > 0, -np.inf, np.inf)
    low = np.searchsorted(top, (o_top + o_bottom) / 2, side="right")
    by_middle = first_above((top + bottom) / 2, np.maximum(after, low), o_bottom)
    by_empty = first_above(empty, after, np.zeros(len(after)))
    out = np.minimum(by_middle, by_empty)
    return np.where(o_bottom - o_top > 0, out, np.minimum(after, len(top)))


def _segments(table: pa.Table, group: list[str]) -> np.ndarray:
    """Starts of the groups in a table sorted by them, and its length."""
    n = len(table)
    change = np.zeros(n, bool)
    change[:1] = True
    for g in group:
        codes = table.column(g).combine_chunks().dictionary_encode()
        codes = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(change), n)


def _next_spans(spans: DataFrame, group: list[str], shard_rows: int) -> DataFrame:
    """``spans`` with ``to_top`` and ``to_bottom``: the span that opens the next group after each.

    Spans lie in shards by (group, top, bottom); a shard answers for its own spans. Spans of a group
    that goes on are asked again in the one or two later shards that can hold the answer, chosen by a
    summary with one row per shard and such a group.
    """
    shards = max(1, -(-spans.count() // shard_rows))
    order = [*group, "top", "bottom"]
    ranged = cut(
        spans.select(*order).repartitionByRange(shards, *order).withColumn("shard", F.spark_partition_id())
    )
    keys = [(g, "ascending") for g in order]
    kinds = {f.name: f.dataType for f in spans.schema}
    fields = [T.StructField(c, kinds[c]) for c in order]
    ends = [T.StructField(c, T.DoubleType()) for c in ("to_top", "to_bottom")]
    out_type = T.StructType([*fields, T.StructField("shard", T.IntegerType()), *ends])

    def answer(spans_: pa.Table, asked: pa.Table, own: bool) -> pa.Table:
        """Successors of ``asked`` among ``spans_``, both sorted by group."""
        top, bottom = (spans_.column(c).to_numpy() for c in ("top", "bottom"))
        found = np.full((2, len(asked)), np.nan)
        starts = _segments(spans_, group)
        where = {}
        if not own:
            names = list(zip(*(spans_.column(g).to_pylist() for g in group), strict=True))
            where = {names[s]: (s, e) for s, e in zip(starts[:-1], starts[1:], strict=True)}
        a_top, a_bottom = (asked.column(c).to_numpy() for c in ("top", "bottom"))
        parts = _segments(asked, group)
        asking = None if own else list(zip(*(asked.column(g).to_pylist() for g in group), strict=True))
        for s, e in zip(parts[:-1], parts[1:], strict=True):
            b, f = (s, e) if own else where.get(asking[s], (0, 0))
            after = np.arange(1, e - s + 1) if own else np.zeros(e - s, np.int64)
            at = successors(top[b:f], bottom[b:f], a_top[s:e], a_bottom[s:e], after)
            hit = at < f - b
            found[0, s:e][hit] = top[b:f][at[hit]]
            found[1, s:e][hit] = bottom[b:f][at[hit]]
        cols = [asked.column(c) for c in [*order, "shard"]]
        null = np.isnan(found)
        return pa.table([*cols, *(pa.array(v, mask=m) for v, m in zip(found, null, strict=True))], names=[f.name for f in out_type])

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by(keys)
        return answer(table, table, True)

    first = cut(ranged.groupBy("shard").applyInArrow(local, out_type))
    middle = (F.col("top") + F.col("bottom")) / 2
    empty = F.col("bottom") <= F.col("top")
    summary = ranged.groupBy(*group, "shard").agg(
        F.min("top").alias("low"), F.max("top").alias("high"),
        F.max(F.when(empty, F.lit(float("inf"))).otherwise(middle)).alias("most"),
    )
    several = Window.partitionBy(*group)
    summary = cut(summary.withColumn("n", F.count(F.lit(1)).over(several)).where("n > 1").drop("n"))
    if not summary.limit(1).count():
        return first.drop("shard")
    # At most the first and the last group of a shard reach beyond it: a row or two for each shard.
    later = F.broadcast(summary.withColumnsRenamed({"shard": "j", **{g: f"s_{g}" for g in group}}))
    open_ = first.where("to_top IS NULL")
    on = F.col("j") > F.col("shard")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"s_{g}"))
    half = (F.col("top") + F.col("bottom")) / 2
    could = (F.col("bottom") <= F.col("top")) | (F.col("most") > F.col("bottom"))
    probes = open_.join(later, on).where(could & ((F.col("high") > half) | (F.col("most") == float("inf")) | (F.col("bottom") <= F.col("top"))))
    whole = (F.col("low") > half) | (F.col("bottom") <= F.col("top"))
    nearest = probes.where(whole).groupBy(*order, "shard").agg(F.min("j").alias("j"))
    partly = probes.where(~whole).select(*order, "shard", "j")
    asked = partly.unionByName(nearest.select(*order, "shard", "j"))
    both = (
        ranged.select(*order, F.col("shard").alias("j"), F.lit(-1).alias("shard"))
        .join(F.broadcast(summary.select(F.col("shard").alias("j")).distinct()), "j", "left_semi")
        .unionByName(asked)
    )

    def probed(table: pa.Table) -> pa.Table:
        own = np.asarray(table.column("shard").to_numpy()) < 0
        table = table.drop_columns(["j"])
        spans_, asked_ = table.filter(pa.array(own)).sort_by(keys), table.filter(pa.array(~own)).sort_by(keys)
        return answer(spans_, asked_, False)

    more = both.groupBy("j").applyInArrow(probed, out_type).where("to_top IS NOT NULL")
    more = cut(
        more.groupBy(*order).agg(F.min(F.struct("to_top", "to_bottom")).alias("to")).select(*order, "to.*")
    )
    close = more.withColumnsRenamed({"to_top": "more_top", "to_bottom": "more_bottom", **{c: f"m_{c}" for c in order}})
    on = F.lit(True)
    for c in order:
        on = on & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    return first.join(close, on, "left").select(
        *order, F.coalesce("to_top", "more_top").alias("to_top"), F.coalesce("to_bottom", "more_bottom").alias("to_bottom")
    )


def _islands(siblings: DataFrame, group: list[str], limit: int) -> DataFrame:
    """(group, top, bottom, n, _marked): distinct spans of the islands with three siblings or more."""
    spans = cut(siblings.groupBy(*group, "top", "bottom").agg(F.count(F.lit(1)).alias("n")))
    largest = largest_group(spans, group)
    low = ordered(spans, group, ["top", "bottom"], {"_low": ("max_before", "bottom")}, limit, largest)
    start = F.struct(F.col("top").alias("t"), F.col("bottom").alias("b"))
    low = low.withColumn("_start", F.when(F.expr("_low IS NULL OR top >= _low"), start))
    held = ordered(low, group, ["top", "bottom"], {"_before": ("last_before", "_start")}, limit, largest)
    held = cut(
        held.select(
            *group, "top", "bottom", "n", F.col("_start").isNotNull().alias("_marked"),
            F.coalesce("_start", "_before").alias("_i"),
        ).select(*group, "top", "bottom", "n", "_marked", F.col("_i.t").alias("_t"), F.col("_i.b").alias("_b"))
    )
    whole = held.groupBy(*group, "_t", "_b").agg(F.sum("n").alias("_all")).where("_all >= 3")
    return cut(held.join(whole, [*group, "_t", "_b"], "left_semi").select(*group, "top", "bottom", "n", "_marked"))


def peer_groups(
    siblings: DataFrame, group: list[str], limit: int = GROUP_ROWS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Row groups: siblings by top edge, a new group when one overlaps the group's first
    member by less than half. Groups of three or more are kept.

    Siblings with equal (top, bottom) act alike, so spans are deduplicated. Each span knows the
    span that would open the next group if it had opened one itself. The openers are what these
    pointers reach from the spans that begin below everything before them; the pointers are
    doubled from round to round, so a run of n groups takes log n rounds. No span list is folded.

    A span that begins below everything before it always opens a group, so groups lie within the
    islands between such spans. Islands of fewer than three siblings are left out at once.
    """
    order = [*group, "top", "bottom"]
    spans = _islands(siblings, group, limit)
    marked = cut(spans.where("_marked").select(*order))
    spans = spans.drop("_marked")
    ahead = cut(_next_spans(spans, group, shard_rows).where("to_top IS NOT NULL"))
    openers = marked
    fresh = marked
    while True:
        reached = openers.join(ahead, order).select(*group, F.col("to_top").alias("top"), F.col("to_bottom").alias("bottom"))
        fresh = cut(reached.distinct().join(openers, order, "left_anti"))
        if not fresh.limit(1).count():
            break
        openers = cut(openers.unionByName(fresh))
        beyond = ahead.select(
            *group, F.col("top").alias("to_top"), F.col("bottom").alias("to_bottom"),
            F.col("to_top").alias("b_top"), F.col("to_bottom").alias("b_bottom"),
        )
        ahead = cut(
            ahead.join(beyond, [*group, "to_top", "to_bottom"]).select(
                *order, F.col("b_top").alias("to_top"), F.col("b_bottom").alias("to_bottom")
            )
        )
    opened = openers.withColumn("_open", F.struct(F.col("top").alias("t0"), F.col("bottom").alias("b0")))
    at = cut(spans.join(opened, order, "left"))
    held = ordered(at, group, ["top", "bottom"], {"_before": ("last_before", "_open")}, limit)
    assigned = cut(held.select(*order, "n", F.coalesce("_open", "_before").alias("g")).select(*order, "n", "g.*"))
    kept = assigned.groupBy(*group, "t0", "b0").agg(F.sum("n").alias("members")).where("members >= 3")
    named = assigned.drop("n").join(kept, [*group, "t0", "b0"])
    return siblings.join(named, order).select(
        *siblings.columns, F.col("t0").alias("group_top"), F.col("b0").alias("group_bottom"), "members"
    )
