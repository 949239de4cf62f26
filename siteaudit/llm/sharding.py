"""Sharding over fixed virtual slots, in DataFrame functions alone.

A record hashes into one of ``SLOTS`` slots for good. A slot with more rows than its share
(one id repeated in a third of the table) is cut into pieces of consecutive rows, so a piece is
small beside a shard. Bytes are summed for each piece, and the map from piece to shard is a
table with a version, stored in a folder: the first version deals the pieces, largest first, to
the shard with the least so far. ``assign`` reads the newest version of its folder, edits it with
``rebalanced`` for today's rows and shards, stores the result as the next version and places rows
by what it stored. An edit moves only what has to go to shards that were added. The map has at
most ``SLOTS`` plus ``4 * shards * PIECES`` rows, whatever the table.

The law that holds is ``bytes``: sizes of shards are near equal. Counts of rows are not evened.

Edges: a null text has no bytes and the checksum of nothing; null ids hash like a value;
repeated rows take a place each; an empty table gives an empty map and no rows; columns other
than ``doc_id`` and ``text`` are not read by ``records``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteaudit.plans.ordered import ordered
from siteaudit.plans.session import cut, new_folder

SLOTS = 8192
SHARDS = 24
PIECES = 64  # pieces a shard is made of, at least, where slots are too large
ROW_BYTES = 8


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, row) of each record; ``row`` tells repeated rows apart."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return (
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
        )
        .withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))
        .withColumn("row", F.monotonically_increasing_id())
    )


def pieces(rows: DataFrame, shards: int = SHARDS, old: DataFrame | None = None) -> DataFrame:
    """``rows`` with the place in the slot, from 0, and the piece of the slot.

    ``share``, the rows of a piece, is that of the ``old`` map where one is given, so that its pieces
    mean the same again.
    """
    most = F.greatest(F.lit(1), F.ceil(F.col("_all") / (shards * PIECES)).cast("long")) * F.lit(4).cast("long")
    share = rows.groupBy().agg(F.count(F.lit(1)).alias("_all")).select(most.alias("share"))
    if old is not None:
        held = old.groupBy().agg(F.max("share").alias("held"))
        share = share.join(F.broadcast(held)).select(F.coalesce("held", "share").alias("share"))
    numbered = ordered(rows, ["vslot"], ["doc_id", "text_crc32", "row"], {"place": ("row_number", None)})
    # A row stays in piece 0 unless its slot holds several shares.
    return (
        numbered.join(F.broadcast(share))
        .withColumn("place", F.col("place").cast("long") - 1)
        .withColumn("piece", F.floor(F.col("place") / F.col("share")).cast("int"))
        .withColumn("place", F.col("place") % F.col("share"))
    )


def totals(dealt: DataFrame) -> DataFrame:
    """(vslot, piece, bytes, rows): partial sums before the shuffle, so hot slots are no burden."""
    return dealt.groupBy("vslot", "piece").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("share").alias("share")
    )


def _placed(chosen: DataFrame, shards: int, version: int) -> DataFrame:
    """A version of the map for ``shards``, with the place in the shard where each piece begins."""
    before = Window.partitionBy("shard").orderBy("vslot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return chosen.select("vslot", "piece", "bytes", "rows", "share", "shard").withColumns(
        {
            "begin": F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long")),
            "shards": F.lit(shards),
            "version": F.lit(version),
        }
    )


def first_map(sums: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1: pieces by falling bytes, each to the shard with the least bytes so far.

    The fold runs over one array of the pieces, whose number does not grow with the table.
    """
    listed = sums.groupBy().agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("bytes"), (-F.col("vslot")).alias("v"), (-F.col("piece")).alias("p"), "rows", "share")),
            asc=False,
        ).alias("all")
    )
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.array().cast("array<int>").alias("picks"),
    )

    def deal(acc, x):
        least = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == least, v + x["bytes"]).otherwise(v)).alias("loads"),
            F.concat(acc["picks"], F.array(least)).alias("picks"),
        )

    picked = listed.select("all", F.aggregate("all", start, deal)["picks"].alias("picks"))
    rows = picked.select(F.explode(F.arrays_zip("all", "picks")).alias("z")).select(
        (-F.col("z.all.v")).alias("vslot"),
        (-F.col("z.all.p")).alias("piece"),
        F.col("z.all.bytes").alias("bytes"),
        F.col("z.all.rows").alias("rows"),
        F.col("z.all.share").alias("share"),
        F.col("z.picks").alias("shard"),
    )
    return _placed(rows, shards, 1)


def rebalanced(old: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """The next version for ``shards``, no fewer than before, from today's sums.

    Pieces that are new go where their slot's first is. Where shards were added, each old shard keeps
    its pieces while they fit its fair share and gives the rest to the new ones; nothing moves
    between old shards, and nothing moves at all where none were added.
    """
    head = old.groupBy().agg(F.max("shards").alias("had"), (F.max("version") + 1).alias("version"))
    first = old.groupBy("vslot").agg(F.min_by("shard", "piece").alias("home"))
    now = (
        sums.join(old.select("vslot", "piece", "shard"), ["vslot", "piece"], "left")
        .join(first, "vslot", "left")
        .join(F.broadcast(head))
        .withColumn("shard", F.coalesce("shard", "home", F.pmod(F.col("vslot"), F.col("had"))))
    )
    so_far = Window.partitionBy("shard").orderBy(F.xxhash64("vslot", "piece"), "vslot", "piece")
    fair = now.groupBy().agg((F.sum("bytes") / shards).alias("fair"))
    added = F.lit(shards) - F.col("had")
    new = F.col("had") + F.pmod(F.xxhash64("piece", "vslot"), F.greatest(added, F.lit(1))).cast("int")
    moved = now.withColumn("upto", F.sum("bytes").over(so_far)).join(F.broadcast(fair)).withColumn(
        "shard", F.when((F.col("upto") > F.col("fair")) & (added > 0), new).otherwise(F.col("shard")).cast("int")
    )
    return _placed(moved, shards, 0).drop("version").join(F.broadcast(head.select("version")))


def store(mapping: DataFrame, folder: str) -> None:
    """Write a version beside the earlier ones; an older version can still be read."""
    mapping.write.partitionBy("version").mode("append").parquet(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest version in the folder, None before the first."""
    try:
        maps = spark.read.parquet(folder)
    except AnalysisException as gone:
        if gone.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    newest = maps.groupBy().agg(F.max("version").alias("version"))
    return maps.join(F.broadcast(newest), "version", "left_semi")


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, piece, shard, slot): slots are gapless from 0 in a shard.

    ``folder`` holds the versions of the map, a new one by default. The same ``slots`` must be used
    throughout, and shards can only be added.
    """
    spark = docs.sparkSession
    folder = folder or f"{new_folder(spark)}/slot_map"
    old = stored(spark, folder)
    if old is not None:
        had = old.groupBy().agg(F.max("shards").alias("had")).first()["had"]
        if had is not None and had > shards:
            raise ValueError(f"the stored map has {had} shards; they can only be added")
        old = None if had is None else old
    dealt = cut(pieces(cut(records(docs, slots)), shards, old))
    sums = totals(dealt)
    store(first_map(sums, shards) if old is None else rebalanced(old, sums, shards), folder)
    mapping = stored(spark, folder)
    if mapping is None:  # nothing to place
        mapping = first_map(sums, shards)
    return dealt.join(F.broadcast(mapping), ["vslot", "piece"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "vslot",
        "piece",
        F.col("shard").cast("int").alias("shard"),
        (F.col("begin") + F.col("place")).cast("long").alias("slot"),
    )
