"""Re-scan sources as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteaudit.operators.rule_scan import rule_scan


def watch_scan(
    sources: DataFrame, out: str, checkpoint: str, exts: list[str] | None = None, **trigger
) -> StreamingQuery:
    """Scan every micro-batch of ``sources(path, ext, content)`` into ``out``.

    A batch is written to its own folder in overwrite mode, so a batch replayed after a lost
    driver replaces itself instead of adding rows twice.
    """

    def scan(batch: DataFrame, batch_id: int) -> None:
        found = rule_scan(batch, exts=exts)
        found.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        sources.writeStream.foreachBatch(scan)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_queue(findings: DataFrame, ts: str, delay: str = "1 hour") -> DataFrame:
    """Findings once per fingerprint; state older than the watermark is dropped."""
    return findings.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def inventory_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): added, changed or deleted between two inventories (path, sha256)."""
    p = previous.select("path", F.col("sha256").alias("a"))
    c = current.select("path", F.col("sha256").alias("b"))
    change = (
        F.when(F.col("a").isNull(), "added")
        .when(F.col("b").isNull(), "deleted")
        .when(F.col("a") != F.col("b"), "changed")
    )
    return p.join(c, "path", "full_outer").select("path", change.alias("change")).where(
        "change IS NOT NULL"
    )
