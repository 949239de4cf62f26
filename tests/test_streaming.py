"""Streaming queries over tables that are folders of parts."""

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_streams_read_tables_of_many_parts(spark, tmp_path):
    for name in ("pages", "events"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("watch_scan", "stream_queue"):
        want = entry.queries()[name](spark, FOLDER)
        got = entry.queries()[name](spark, str(tmp_path))
        assert sorted(got.collect()) == sorted(want.collect())
        assert want.limit(1).count()
