import zlib

import pytest
from pyspark.sql import functions as F

from siteaudit.llm import sharding as sh

ROWS = [(i, "x" * (i * 37 % 900)) for i in range(400)] + [(None, None), (None, ""), (5, "ñ"), (5, "ñ"), (3, "long " * 5000)]
ROWS += [(9, "one text many times")] * 300


def frame(spark):
    return spark.createDataFrame([(*r, 1, "s") for r in ROWS], "doc_id long, text string, shard int, vslot string")


def test_bytes_are_even_and_slots_gapless(spark):
    got = sh.assign(frame(spark), 6).collect()
    want = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in ROWS)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    sizes, slots = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(sizes) == list(range(6))
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * max(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_slot_is_for_good_and_a_new_shard_takes_rows_only_into_itself(spark, tmp_path):
    dealt = sh.pieces(sh.records(frame(spark)), 6).cache()
    sums = sh.totals(dealt)
    old = sh.first_map(sums, 6).cache()
    new = sh.rebalanced(old, sums, 7).cache()
    both = old.select("vslot", "piece", F.col("shard").alias("was")).join(new, ["vslot", "piece"])
    assert both.count() == old.count() == new.count()
    assert both.where("shard <> was AND shard <> 6").count() == 0
    loads = {r["shard"]: r["b"] for r in new.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert set(loads) == set(range(7)) and loads[6] > 0
    assert {r["version"] for r in new.select("version").distinct().collect()} == {2}
    sh.store(old, str(tmp_path / "map"))
    sh.store(new, str(tmp_path / "map"))
    assert spark.read.parquet(str(tmp_path / "map")).where("version = 1").count() == old.count()


def test_rows_are_placed_by_the_stored_version_and_its_edits(spark, tmp_path):
    at = str(tmp_path / "versions")
    placed = lambda rows, n: [
        ((r["doc_id"], r["text_crc32"]), r["vslot"], r["piece"], r["shard"], r["slot"])
        for r in sh.assign(spark.createDataFrame(rows, "doc_id long, text string"), n, folder=at).collect()
    ]
    first = placed(ROWS, 6)
    assert sorted(placed(ROWS, 6), key=str) == sorted(first, key=str)
    more = ROWS + [(10_000 + i, "y" * (i % 50)) for i in range(300)]
    grown, home = placed(more, 6), {(v, p): s for _, v, p, s, _ in first}
    assert all(home.get((v, p), s) == s for _, v, p, s, _ in grown)
    wider = placed(more, 8)
    home = {(v, p): s for _, v, p, s, _ in grown}
    assert all(s in (home[v, p], 6, 7) for _, v, p, s, _ in wider)
    assert {s for _, _, _, s, _ in wider} == set(range(8))
    for rows, got in ((ROWS, first), (more, grown), (more, wider)):
        assert len(got) == len(rows)
        slots = {}
        for _, _, _, s, x in got:
            slots.setdefault(s, []).append(x)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sorted(r[0] for r in spark.read.parquet(at).select("version").distinct().collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        placed(more, 7)


def test_no_rows(spark):
    assert sh.assign(frame(spark).limit(0)).count() == 0
