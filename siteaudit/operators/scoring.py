"""Aggregates over findings: scores, summaries, work order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.operators.findings import WEIGHTS, choose, requires_resolution
from siteaudit.plans.ordered import grouped, ordered

# Impact and minutes per tier, review dimension caps.
TIER_IMPACT = {"T1": 1, "T2": 3, "T3": 5, "T4": 10}
TIER_EFFORT = {"T1": 2, "T2": 8, "T3": 20, "T4": 45}
REVIEW_CAPS = {"A": 40, "B": 30, "C": 20, "D": 10}
DETERMINISTIC = ["contract", "runtime", "static"]


def score_snapshot(
    findings: DataFrame,
    keys: list[str],
    coverage: Column,
    review: Column | None = None,
    subjects: DataFrame | None = None,
    scanned: Column | None = None,
) -> DataFrame:
    """Slop, objective and blended score per key.

    ``coverage`` (0..1) and ``review`` (0..100 or NULL) are expressions constant per key. With
    ``subjects``, what was scanned, they are read there and a subject without findings has a row.
    Where ``scanned``, a condition on subjects, holds for none of a key's rows, nothing was
    judged: its scores are NULL.
    Rounding is half-even, as in the source of the formula.
    """
    live = requires_resolution(F.col("status"))
    weight = choose(F.col("severity"), WEIGHTS, 10.0) * F.col("confidence")
    review = review if review is not None else F.lit(None).cast("double")
    constant = [
        F.max(F.least(F.greatest(coverage, F.lit(0.0)), F.lit(1.0))).alias("coverage"),
        F.max(review).alias("review"),
    ]
    g = findings.groupBy(*keys).agg(
        F.bround(F.coalesce(F.sum(F.when(live, weight)), F.lit(0.0)), 2).alias("slop"),
        *(constant if subjects is None else []),
        F.coalesce(
            F.bool_or(
                live
                & (F.col("severity") == "critical")
                & F.col("provenance").isin(DETERMINISTIC)
            ),
            F.lit(False),
        ).alias("critical_pending"),
        F.count_if(live).alias("pending"),
    )
    if subjects is not None:
        seen = F.coalesce(F.bool_or(scanned if scanned is not None else F.lit(True)), F.lit(False))
        g = subjects.groupBy(*keys).agg(*constant, seen.alias("_seen")).join(g, keys, "left")
        nothing = {"slop": F.lit(0.0), "critical_pending": F.lit(False), "pending": F.lit(0)}
        g = g.withColumns(
            {c: F.coalesce(c, F.when(F.col("_seen"), v)) for c, v in nothing.items()}
        ).drop("_seen")
    objective = F.when(
        F.col("slop").isNotNull(),
        F.greatest(
            F.lit(0), F.least(F.lit(100), F.bround(100 * F.col("coverage") - F.col("slop")))
        ),
    ).cast("int")
    g = g.withColumn("objective", objective)
    blended = F.when(
        F.col("review").isNotNull() & F.col("objective").isNotNull(),
        F.bround(F.col("objective") * 0.6 + F.col("review") * 0.4),
    ).otherwise(F.col("objective"))
    return g.withColumn(
        "blended",
        F.when(F.col("critical_pending"), F.least(blended, F.col("objective")))
        .otherwise(blended)
        .cast("int"),
    )


def review_score(dims: Column, declared: Column) -> Column:
    """Total of the four dimensions, NULL unless all are present, capped and add up."""
    ok = F.size(dims) == len(REVIEW_CAPS)
    total = F.lit(0.0)
    for key, cap in REVIEW_CAPS.items():
        v = dims[key]
        ok = ok & F.coalesce((v >= 0) & (v <= cap), F.lit(False))
        total = total + v
    return F.when(ok & (declared == total), F.bround(total).cast("int"))


def eligibility(
    scores: DataFrame,
    keys: list[str],
    target: int,
    fresh: Column,
    review_complete: Column,
    review_current: Column,
) -> DataFrame:
    """One row per (key, blocker); ``scores`` comes from ``score_snapshot``."""
    blockers = [
        ("pending_findings", F.col("pending") > 0),
        ("target_score", F.col("blended") < target),
        ("incomplete_qualification", F.col("coverage") < 1),
        ("stale_evidence", ~fresh),
        ("missing_structured_review", ~review_complete),
        ("stale_review", review_complete & ~review_current),
    ]
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in blockers]))
    return scores.select(*keys, F.explode(codes).alias("blocker"))


def status_summary(findings: DataFrame) -> DataFrame:
    live = requires_resolution(F.col("status"))
    done = F.col("status") == "verified_resolved"
    return findings.agg(
        F.count_if(live).alias("actionable"),
        F.count_if(~live & ~done).alias("investigative"),
        F.count_if(done).alias("resolved"),
        F.count(F.lit(1)).alias("found"),
    )


COMPONENT_ROOTS = "src app pages components features lib modules views layouts".split()


def component_key(path: Column) -> Column:
    """Up to three segments from the first well-known folder, else the last two of the parent."""
    parts = F.split(path, "/")
    # One search for the first such segment and two more behind it.
    known = F.regexp_extract(path, rf"(?:^|/)((?:{'|'.join(COMPONENT_ROOTS)})(?=/|\z)(?:/[^/]*){{0,2}})", 1)
    parent = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    tail = F.when(F.size(parent) > 2, F.slice(parent, -2, 2)).otherwise(parent)
    return (
        F.when(known != "", known)
        .when(F.size(parent) == 0, F.lit("root"))
        .otherwise(F.array_join(tail, "/"))
    )


def attack_plan(findings: DataFrame) -> DataFrame:
    """Components by impact, with effort, file count and the three commonest categories."""
    live = findings.where(requires_resolution(F.col("status"))).withColumn(
        "component", component_key(F.col("path"))
    )
    # Distinct files and categories are pre-aggregated so a hot component spreads out.
    by_file = live.groupBy("component", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(choose(F.col("tier"), TIER_IMPACT, 10)).alias("impact"),
        F.sum(choose(F.col("tier"), TIER_EFFORT, 45)).alias("effort"),
    )
    base = by_file.groupBy("component").agg(
        F.sum("n").alias("issues"),
        F.sum("impact").alias("impact"),
        F.sum("effort").alias("effort"),
        F.count(F.lit(1)).alias("files"),
    )
    cats = live.groupBy("component", "category").agg(F.count(F.lit(1)).alias("n"))
    # Categories are a fixed short list, so this array is bounded.
    top = cats.groupBy("component").agg(
        F.array_join(
            F.transform(
                F.slice(
                    F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "category"))), 1, 3
                ),
                lambda s: s["category"],
            ),
            ",",
        ).alias("top_categories")
    )
    return base.join(top, "component")


def ranked_plan(plan: DataFrame, k: int) -> DataFrame:
    """First k components: impact descending, effort ascending."""
    return plan.orderBy(F.desc("impact"), F.asc("effort"), F.asc("component")).limit(k)


def scan_summary(findings: DataFrame) -> DataFrame:
    return (
        findings.groupBy("category")
        .pivot("tier", ["T1", "T2", "T3", "T4"])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def top_files(findings: DataFrame, k: int) -> DataFrame:
    n = findings.groupBy("path").agg(F.count(F.lit(1)).alias("issues"))
    return n.orderBy(F.desc("issues"), F.asc("path")).limit(k)


def category_coverage(findings: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category with the number of distinct rules that fired in it."""
    fired = findings.select("category", "detector_id").distinct()
    n = fired.groupBy("category").agg(F.count(F.lit(1)).alias("rules"))
    return categories.join(n, "category", "left").select(
        "category",
        F.coalesce("rules", F.lit(0)).alias("rules"),
        F.when(F.col("rules").isNull(), "clean").otherwise("issues").alias("verdict"),
    )


def tree_rollup(findings: DataFrame) -> DataFrame:
    """Issue count of every path prefix. Files are counted first, then the folders fan out.

    A file is its own prefix and is in no other row of its kind, so only folders are summed.
    """
    rows = findings.select("path").where("path IS NOT NULL")
    files = grouped(rows, ["path"], [F.count(F.lit(1)).alias("n")])
    parts = F.split("path", "/")
    depth = F.size("parts")
    above = F.explode(F.when(depth > 1, F.sequence(F.lit(1), depth - 1))).alias("depth")
    dirs = (
        files.select("n", parts.alias("parts"))
        .select("n", "parts", above)
        .select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("prefix"), "depth", "n")
        .groupBy("prefix", "depth")
        .agg(F.sum("n").alias("issues"))
    )
    return files.select(
        F.col("path").alias("prefix"), F.size(parts).alias("depth"), F.lit("file").alias("kind"), F.col("n").alias("issues")
    ).unionByName(dirs.select("prefix", "depth", F.lit("dir").alias("kind"), "issues"))


def queue_by_file(findings: DataFrame) -> DataFrame:
    t = {x: F.count_if(F.col("tier") == x) for x in ("T1", "T2", "T3", "T4")}
    return findings.groupBy("path").agg(
        F.count(F.lit(1)).alias("issues"), *[c.alias(k) for k, c in t.items()]
    )


def parent_dir(path: Column) -> Column:
    return F.when(
        path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")
    ).otherwise(F.lit("."))


def select_batch(findings: DataFrame, seq: str, size: int = 15) -> DataFrame:
    """Lowest tier first; the folder of that first issue; at most ``size`` from it."""
    key = F.struct("tier", seq)
    first = findings.agg(F.min_by(parent_dir(F.col("path")), key).alias("dir"))
    return (
        findings.withColumn("dir", parent_dir(F.col("path")))
        .join(F.broadcast(first), "dir", "left_semi")  # one row
        .orderBy("tier", seq)
        .limit(size)
    )


def shard_assign(findings: DataFrame, shards: int) -> DataFrame:
    """Most pressing files first, ``shards * 3`` of them, dealt round-robin; a file stays whole."""
    live = findings.where(requires_resolution(F.col("status")))
    files = live.groupBy("path").agg(F.min("tier").alias("tier"), F.count(F.lit(1)).alias("issues"))
    top = files.orderBy("tier", "path").limit(shards * 3)
    w = Window.orderBy("tier", "path")  # at most shards * 3 rows
    return top.withColumn("shard", ((F.row_number().over(w) - 1) % shards).cast("int"))


def capped_log(entries: DataFrame, keep: int, group: str = "kind", seq: str = "seq") -> DataFrame:
    """Newest ``keep`` rows per kind."""
    newest = entries.withColumn("_rev", -F.col(seq))
    ranked = ordered(newest, [group], ["_rev"], {"_rn": ("row_number", None)})
    return ranked.where(F.col("_rn") <= keep).drop("_rev", "_rn")


def latest_event(events: DataFrame, group: list[str], order: Column) -> DataFrame:
    """Newest row per group, as a max aggregate (copies combine before the shuffle)."""
    rest = [c for c in events.columns if c not in group]
    best = events.groupBy(*group).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(*group, *[f"_b.{c}" for c in rest])


def run_progress(runs: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Trend against the previous run and the change since the first."""
    out = ordered(runs, group, order, {"previous": ("lag", "score")})
    first = runs.groupBy(*group).agg(F.min_by("score", F.struct(*order)).alias("first_score"))
    return out.join(first, group).select(
        *runs.columns,
        "previous",
        F.when(F.col("previous").isNull(), "start")
        .when(F.col("score") > F.col("previous"), "up")
        .when(F.col("score") < F.col("previous"), "down")
        .otherwise("flat")
        .alias("trend"),
        (F.col("score") - F.col("first_score")).alias("delta"),
    )


def run_snapshot(scores: DataFrame, trigger: str, ts: Column) -> DataFrame:
    """Rows to append to the run log, partitioned by date."""
    return scores.select(
        ts.alias("ts"),
        F.to_date(ts).alias("run_date"),
        F.lit(trigger).alias("trigger"),
        F.col("blended").alias("score"),
        "objective",
        "pending",
    )

