"""Streaming queries: the file source over the given tables, drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteaudit.plans.session import new_folder
from siteaudit.sources.documents import append_run_log, load_graph, save_graph
from siteaudit.streaming import watch
from siteaudit.workload.derive import FINDINGS, duck, table, view
from siteaudit.workload.q_graph import _FACTS
from siteaudit.workload.q_rules import PAGE_COUNTS
from siteaudit.workload.registry import query


def stream(spark, d, name):
    # As a pattern the path may name one file or a folder of parts.
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}[.]parquet")


@query("watch_scan", f"SELECT path, detector_id, CAST(n AS BIGINT) AS n FROM ({PAGE_COUNTS})")
def _(spark, d):
    at = new_folder(spark)
    src = stream(spark, d, "pages").select(
        F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("path"),
        F.lit("html").alias("ext"),
        F.col("html").alias("content"),
    )
    watch.watch_scan(src, f"{at}/out", f"{at}/state", ["html"]).awaitTermination()
    found = spark.read.parquet(f"{at}/out")
    return found.groupBy("path", "detector_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_queue",
    "SELECT DISTINCT user_id || '|' || event_type AS fingerprint FROM events",
)
def _(spark, d):
    at = new_folder(spark)
    f = stream(spark, d, "events").select(
        F.concat_ws("|", "user_id", "event_type").alias("fingerprint"), F.col("ts").cast("timestamp")
    )
    q = (
        watch.stream_queue(f, "ts", "60 days")
        .writeStream.format("parquet")
        .option("path", f"{at}/out")
        .option("checkpointLocation", f"{at}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("fingerprint")


@query(
    "inventory_changes",
    """SELECT change, count(*) AS n FROM (SELECT CASE WHEN page_id % 5 = 0 THEN 'added' WHEN page_id % 7 = 0 THEN 'deleted' WHEN
 page_id % 3 = 0 THEN 'changed' END AS change FROM pages) WHERE change IS NOT NULL GROUP BY change""",
)
def _(spark, d):
    p = table(spark, d, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("path"), F.sha2("html", 256).alias("sha256"), "page_id"
    )
    later = p.where("page_id % 5 = 0 OR page_id % 7 <> 0").select(
        "path",
        F.when(F.col("page_id") % 3 == 0, F.lit("edited")).otherwise(F.col("sha256")).alias("sha256"),
    )
    out = watch.inventory_changes(p.where("page_id % 5 <> 0").select("path", "sha256"), later)
    return out.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(
    "run_snapshot_append",
    f"""SELECT CAST(t.run_date AS VARCHAR) AS run_date, count(*) AS n FROM {duck(FINDINGS)}, (SELECT unnest([DATE '2024-01-01', DATE
 '2024-01-02']) AS run_date) t GROUP BY 1""",
)
def _(spark, d):
    at = new_folder(spark)
    f = view(spark, d, FINDINGS).select("rid", "tier")
    for day in ("2024-01-01", "2024-01-02"):
        append_run_log(f.withColumn("run_date", F.to_date(F.lit(day))), f"{at}/runs")
    runs = spark.read.parquet(f"{at}/runs")
    return runs.groupBy(F.col("run_date").cast("string").alias("run_date")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "graph_persist",
    f"""SELECT 'nodes' AS part, (SELECT count(*) FROM (SELECT DISTINCT kind, file, name FROM {duck(_FACTS)})) + (SELECT
 count(DISTINCT file) FROM {duck(_FACTS)}) AS n UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT kind, file, name FROM
 {duck(_FACTS)})""",
)
def _(spark, d):
    from siteaudit.operators.graph import build_graph

    at = new_folder(spark)
    save_graph(*build_graph(view(spark, d, _FACTS)), at)
    nodes, edges = load_graph(spark, at)
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n")
    return one(nodes, "nodes").unionAll(one(edges, "edges"))
