"""File inventories, manifests, diagnostics and captures as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.schema import CAPTURE

# Discovery policy.
EXTENSIONS = (
    "astro cjs css htm html js jsx less md mjs sass scss svelte ts tsx vue"
).split()
IGNORED_DIRS = (
    "__pycache__ build coverage dist node_modules out playwright-report vendor"
).split()
ROOT_MARKERS = [
    [".git"],
    (
        "pyproject.toml package.json pnpm-workspace.yaml Cargo.toml go.mod composer.json Gemfile "
        "requirements.txt setup.py setup.cfg"
    ).split(),
]
BACKEND_MARKERS = [
    "@controller",
    "@app.",
    "@router.",
    "@bp.",
    "fastapi(",
    "apirouter(",
    "flask(",
    "blueprint(",
    "express(",
    "fastify",
    ".route(",
    "app.get(",
    "app.post(",
    "app.put(",
    "app.patch(",
    "app.delete(",
    "router.get(",
    "router.post(",
    "router.put(",
    "router.patch(",
    "router.delete(",
]
TEST_DIRS = ["__tests__", "e2e", "test", "tests"]


def read_sources(
    spark: SparkSession,
    folder: str,
    exts: list[str] | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Files under ``folder`` as sources(path, ext, n_bytes, content, sha256, scan_status).

    Every file has a row. One that is not UTF-8 (``undecodable``) or beyond ``max_bytes``
    (``too_large``) has no content; its status tells why nothing was scanned.
    """
    glob = "*.{" + ",".join(exts or EXTENSIONS) + "}"
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(folder)
    )
    text = F.col("content").cast("string")
    status = F.when(~F.is_valid_utf8(text), "undecodable")
    if max_bytes is not None:
        status = status.when(F.col("length") > max_bytes, "too_large")
    status = status.otherwise("scanned")
    return raw.select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"),
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"),
        F.col("length").alias("n_bytes"),
        F.when(status == "scanned", text).alias("content"),
        F.sha2("content", 256).alias("sha256"),
        status.alias("scan_status"),
    )


def source_inventory(
    files: DataFrame,
    exclude_names: list[str] = (),
    exclude_trees: list[str] = (),
    skipped_zones: DataFrame | None = None,
) -> DataFrame:
    """Eligible files: known extension, no hidden or ignored folder, nothing excluded."""
    parts = F.split("path", "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bad = F.exists(
        dirs, lambda p: F.startswith(p, F.lit(".")) | p.isin([*IGNORED_DIRS, *exclude_names])
    )
    for tree in exclude_trees:
        t = tree.strip("/")
        bad = bad | (F.col("path") == t) | F.startswith("path", F.lit(t + "/"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = files.where(ext.isin(EXTENSIONS) & ~bad)
    if skipped_zones is not None:
        out = out.join(skipped_zones.select("path").distinct(), "path", "left_anti")
    return out


def project_root(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Nearest ancestor with a marker; marker groups are tried in order. ``markers(dir, name)``.

    Each file fans out to its ancestors; marker folders are reduced to one row per folder.
    """
    group = F.lit(None).cast("int")
    for i, names in reversed(list(enumerate(ROOT_MARKERS))):
        group = F.when(F.col("name").isin(names), i).otherwise(group)
    marked = markers.groupBy("dir").agg(F.min(group).alias("grp")).where("grp IS NOT NULL")
    parts = F.split("path", "/")
    up = files.select("path", parts.alias("p")).select(
        "path",
        F.posexplode(
            F.transform(
                F.sequence(F.size("p") - 1, F.lit(0), F.lit(-1)),
                lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"),
            )
        ).alias("up", "dir"),
    )
    best = up.join(marked, "dir").groupBy("path").agg(F.min_by("dir", F.struct("grp", "up")).alias("root"))
    own = F.regexp_replace("path", r"/?[^/]*$", "")
    return files.join(best, "path", "left").select(
        *files.columns, F.coalesce("root", own).alias("root")
    )


def source_manifest(sources: DataFrame) -> DataFrame:
    return sources.select("path", F.sha2("content", 256).alias("sha256"))


def is_test_source(path: Column) -> Column:
    p = F.lower(path)
    dirs = F.split(F.regexp_replace(p, r"/?[^/]*$", ""), "/")
    name = F.substring_index(p, "/", -1)
    return (
        F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in TEST_DIRS]))
        | F.startswith(name, F.lit("test_"))
        | F.endswith(name, F.lit("_test.py"))
        | name.contains(".spec.")
        | name.contains(".test.")
    )


def backend_manifest(sources: DataFrame) -> DataFrame:
    """Contract-bearing sources: tests skipped, a cheap marker test before any extraction."""
    low = F.lower("content")
    hit = F.lit(False)
    for m in BACKEND_MARKERS:
        hit = hit | low.contains(m)
    return sources.where(~is_test_source(F.col("path")) & hit).select(
        "path", F.sha2("content", 256).alias("sha256")
    )


# ---- tool output -----------------------------------------------------------------------

TSC = r"^(.+?)\((\d+),(\d+)\):\s+error\s+(TS\d+):\s+(.+)$"
LINT = r"^([^:\n]+?):(\d+):(\d+)(?::\s*|\s+-\s*|\s+)(.+)$"
REPORT = "array<struct<filePath:string,messages:array<struct<line:int,column:int,ruleId:string,message:string>>>>"


def tsc_diagnostics(lines: DataFrame) -> DataFrame:
    """Compiler output, one line per row in ``line_text``."""
    part = lambda i: F.regexp_extract("line_text", TSC, i)
    return lines.where(F.col("line_text").rlike(TSC)).select(
        F.trim(part(1)).alias("path"),
        part(2).cast("int").alias("line"),
        part(3).cast("int").alias("column"),
        part(4).alias("code"),
        F.trim(part(5)).alias("message"),
    )


def lint_text_diagnostics(lines: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("line_text", LINT, i)
    return lines.where(F.col("line_text").rlike(LINT)).select(
        part(1).alias("path"),
        part(2).cast("int").alias("line"),
        part(3).cast("int").alias("column"),
        F.lit("lint").alias("code"),
        F.trim(part(4)).alias("message"),
    )


def lint_json_diagnostics(reports: DataFrame) -> DataFrame:
    """Linter JSON documents in ``doc``: a list of files with messages."""
    rows = reports.select(F.explode(F.from_json("doc", REPORT)).alias("r"))
    return (
        rows.select("r.filePath", F.explode("r.messages").alias("m"))
        .where("filePath IS NOT NULL AND m.message <> ''")
        .select(
            F.col("filePath").alias("path"),
            F.coalesce("m.line", F.lit(0)).alias("line"),
            F.coalesce("m.column", F.lit(0)).alias("column"),
            F.coalesce("m.ruleId", F.lit("lint")).alias("code"),
            F.trim("m.message").alias("message"),
        )
    )


def diagnostic_signature(code: Column, message: Column) -> Column:
    return F.sha2(F.concat(code, F.lit("\0"), F.trim(message)), 256)


# ---- captures --------------------------------------------------------------------------


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CAPTURE).json(folder)


def capture_elements(captures: DataFrame) -> DataFrame:
    """One row per element of a capture, measurement struct in ``m``."""
    return captures.select(
        "capture_id",
        "url",
        "scenario",
        "state",
        "viewport",
        F.posexplode("elements").alias("pos", "e"),
    ).select(
        "capture_id",
        "url",
        "scenario",
        "state",
        "viewport",
        "pos",
        "e.kind",
        "e.tag",
        "e.role",
        "e.name",
        "e.selector",
        F.coalesce("e.order", "pos").alias("ord"),
        F.col("e.bounds.x").alias("x"),
        F.col("e.bounds.y").alias("y"),
        F.col("e.bounds.width").alias("width"),
        F.col("e.bounds.height").alias("height"),
        F.col("e.styles").alias("styles"),
        F.col("e.states").alias("states"),
        F.col("e.measurements").alias("m"),
    )


# ---- sinks -----------------------------------------------------------------------------


def findings_json(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*sorted(findings.columns))).alias("value"))


def annotations(findings: DataFrame) -> DataFrame:
    """CI annotation lines: error for T3 and T4, warning otherwise."""
    level = F.when(F.col("tier").isin("T3", "T4"), "error").otherwise("warning")
    return findings.select(
        F.format_string("::%s file=%s::%s", level, "path", "message").alias("value")
    )


def append_run_log(rows: DataFrame, folder: str) -> None:
    """Append run rows to the log, one partition per date."""
    rows.write.mode("append").partitionBy("run_date").parquet(folder)


GRAPH_VERSION = 1


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("graph_version", F.lit(GRAPH_VERSION)).write.mode("overwrite").parquet(
            f"{folder}/{name}"
        )


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows of another version are refused, not reinterpreted."""
    out = []
    for name in ("nodes", "edges"):
        df = spark.read.parquet(f"{folder}/{name}")
        if df.where(F.col("graph_version") != GRAPH_VERSION).limit(1).count():
            raise ValueError(f"{name}: graph version is not {GRAPH_VERSION}")
        out.append(df.drop("graph_version"))
    return out[0], out[1]
