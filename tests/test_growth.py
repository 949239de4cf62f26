"""Steps whose cost per task must not follow the size of the table."""

import math
import random
from collections import Counter

from pyspark.sql import Row
from pyspark.sql import functions as F

from siteaudit.operators import contracts, design_audit, geometry, graph, peers, scoring
from siteaudit.operators.findings import dedup_findings
from siteaudit.plans import ordered, session


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_grows_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(200_000).selectExpr("id", "uuid() AS u").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(session, "SPREAD_BYTES", 100_000)
    assert session.spread(df).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert session.table_partitions(df) > 2 * spark.sparkContext.defaultParallelism


def test_grouped_with_hot_keys(spark):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id < 90 THEN NULL ELSE 'k' || id % 999 END AS k", "id")
    aggs = [F.count(F.lit(1)).alias("n"), F.max("id").alias("m")]
    want = sorted(map(str, df.groupBy("k").agg(*aggs).collect()))
    out = ordered.grouped(df, ["k"], aggs, parts=40, hot=5_000)
    assert sorted(map(str, out.collect())) == want
    assert "Union" in plan(out)
    assert ordered.grouped(df, ["k"], aggs, parts=40).rdd.getNumPartitions() == 40


def test_tree_rollup_sums_folders_only(spark):
    paths = ["a/b/f.x", "a/b/f.x", "a/b/g.x", "a/f.x", "f.x", "a/b", "a//z", "", None]
    out = scoring.tree_rollup(spark.createDataFrame([(p,) for p in paths], "path string"))
    got = sorted((r.prefix, r.depth, r.kind, r.issues) for r in out.collect())
    assert got == sorted(
        [
            ("a/b/f.x", 3, "file", 2), ("a/b/g.x", 3, "file", 1), ("a/f.x", 2, "file", 1), ("f.x", 1, "file", 1),
            ("a/b", 2, "file", 1), ("a//z", 3, "file", 1), ("", 1, "file", 1),
            ("a", 1, "dir", 6), ("a/b", 2, "dir", 3), ("a/", 2, "dir", 1),
        ]
    )


def test_dedup_findings_in_many_partitions(spark, tmp_path, monkeypatch):
    spark.range(50_000).selectExpr("'k' || id % 20000 AS fingerprint", "id AS ord", "uuid() AS u").coalesce(1).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(session, "SPREAD_BYTES", 20_000)
    out = dedup_findings(spark.read.parquet(f"{tmp_path}/t"), "ord")
    assert out.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert out.agg(F.count(F.lit(1)), F.sum("ord")).first()[:] == (20_000, sum(range(30_000, 50_000)))


def test_component_key(spark):
    paths = ["x/src/a/b/c.x", "src", "src//q", "a/b/c.x", "a.x", "", "my/appx/src2/f", "q/app/src/z/f", "lib/", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(scoring.component_key(F.col("p")).alias("k"))
    want = ["src/a/b", "src", "src//q", "a/b", "root", "root", "appx/src2", "app/src/z", "lib/", None]
    assert [r.k for r in df.collect()] == want
    assert "lambda" not in plan(df)


def test_build_graph_shuffles_parts_not_ids(spark):
    rows = [("c", "f1", "x", 0, "declares"), ("c", "f1", "x", 0, "declares"), ("c", "f1", "x", 0, "uses"), ("file", "f1", "f1", 0, "is"), ("c", "f2", "x", 1, "uses")]
    kind = "kind string, file string, name string, ordinal int, relation string"
    for more in ([], [("c", None, "x", 0, "uses"), ("c", "a\0b", "x", 0, "uses"), ("c", "a", "b\0x", 0, "uses")]):
        nodes, edges = graph.build_graph(spark.createDataFrame(rows + more, kind))
        assert nodes.count() == nodes.select("id").distinct().count() == (4 if not more else 11 - 2)
        assert edges.count() == edges.distinct().count()
    nodes, edges = graph.build_graph(spark.createDataFrame(rows, kind))
    assert edges.count() == 4
    assert "hashpartitioning(id" not in plan(nodes) and "hashpartitioning(source" not in plan(edges)


def test_paint_memo_sorts_by_hash(spark):
    c = lambda v: Row(r=v, g=v, b=v, a=1.0)
    color = "struct<r:double,g:double,b:double,a:double>"
    kind = f"painted boolean, unresolved array<string>, foreground {color}, layers array<{color}>, size double, weight double, disabled boolean, eid int"
    rows = [(i % 5 != 0, [], None if i % 7 == 0 else c(i % 3 / 2), [c(1.0)], 12.0, 400.0, None if i % 4 == 0 else i % 6 == 0, i) for i in range(60)]
    df = spark.createDataFrame(rows, kind)
    key = lambda out: sorted(map(str, out.select("eid", "ratio", "verdict").collect()))
    assert key(design_audit.paint_memo(df)) == key(design_audit.contrast(df))
    assert "xxhash64" in plan(design_audit.paint_memo(df))


def test_differences_are_dealt_by_the_number_of_pairs(spark, monkeypatch):
    pairs = spark.range(4_000).selectExpr("'f' || id AS front_op", "'b' || id % 7 AS back_op")
    params = pairs.selectExpr("front_op AS op_id", "'query' AS location", "'q' AS name", "'form' AS serial", "true AS required")
    media = pairs.selectExpr("front_op AS op_id", "'request' AS side", "'' AS status", "'text/xml' AS media")
    monkeypatch.setattr(session, "PART_ROWS", 100)
    out = contracts.transport_diff(pairs, params, media)
    assert out.rdd.getNumPartitions() == 40
    assert out.where("kind = 'parameter_not_supported' AND field = 'query:q'").count() == 4_000
    assert contracts.first_difference(pairs, [out]).rdd.getNumPartitions() == 40


def test_peer_groups_leave_small_islands_out(spark):
    rows = [("a", f"s{i}", i * 100.0, i * 100.0 + 30) for i in range(50)]
    rows += [("a", f"t{i}", 200.0 + i, 230.0 + i) for i in range(1, 4)] + [("b", "u", 0.0, 5.0), ("b", "v", 1.0, 5.0)]
    df = spark.createDataFrame(rows, "parent string, selector string, top double, bottom double")
    for limit in (10**9, 0):
        assert peers._islands(df, ["parent"], limit).agg(F.sum("n")).first()[0] == 4
        got = {r.selector: (r.group_top, r.members) for r in peers.peer_groups(df, ["parent"], limit).collect()}
        assert got == {s: (200.0, 4) for s in ("s2", "t1", "t2", "t3")}


def shuffled_rows(df):
    """Rows that the finished plan of ``df`` wrote to shuffles, by exchange, where no table is small enough to be sent whole."""
    conf = df.sparkSession.conf
    usual = conf.get("spark.sql.autoBroadcastJoinThreshold")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df.collect()
    finally:
        conf.set("spark.sql.autoBroadcastJoinThreshold", usual)

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        while node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        kids = node.children()
        own = node.metrics().get("shuffleRecordsWritten")
        found = [own.get().value()] if own.isDefined() and "Exchange" in node.getClass().getSimpleName() else []
        return found + [n for i in range(kids.size()) for n in walk(kids.apply(i))]

    return walk(df._jdf.queryExecution().executedPlan())


def boxes(spark, n):
    """Small elements that do not overlap."""
    return spark.range(n).selectExpr(
        "'c' || id % 3 AS capture_id", "'s' || id AS selector", "id AS ord", "'p' || id % 2 AS path",
        "id % 50 * 80D AS left", "floor(id / 50) * 36D AS top", "id % 50 * 80D + 30 AS right",
        "floor(id / 50) * 36D + 30 AS bottom",
    )


def test_text_collision_shuffles_a_row_once(spark):
    df = boxes(spark, 6_000)
    assert 6_000 <= sum(shuffled_rows(geometry.text_collision(df))) < 2 * 6_000


def test_target_spacing_shuffles_a_row_once(spark):
    """Once for each cell that its surroundings touch, and nothing for large targets where none is."""
    df = boxes(spark, 6_000)
    assert 6_000 <= sum(shuffled_rows(geometry.target_spacing(df))) < 3 * 6_000
    # nothing is joined back to the targets
    assert "LeftOuter" not in plan(geometry.target_spacing(df))


def some_boxes(spark):
    rnd = random.Random(21)
    rows = [("c", None, 9, "q", 1.0, 1.0, 9.0, 9.0), ("c", "null", 9, "q", None, 1.0, 9.0, 9.0), (None, "lone", 9, "q", 1.0, 1.0, 9.0, 9.0)]
    for i in range(300):
        x, y = rnd.randrange(-900, 900), rnd.randrange(-900, 900)
        w, h = rnd.choice([(10, 10), (40, 30), (90, 60), (300, 20), (3000, 1), (5000, 5000)])
        rows += [(f"c{i % 2}", f"s{i}", i % 200, f"p{i % 7}", float(x), float(y), float(x + w), float(y + h))] * rnd.choice([1, 1, 1, 2])
    kind = "capture_id string, selector string, ord int, path string, left double, top double, right double, bottom double"
    return rows, spark.createDataFrame(rows, kind)


def test_text_collision_brute_force(spark):
    rows, df = some_boxes(spark)
    want = {}
    for a in rows:
        for b in rows:
            if a[0] and a[0] == b[0] and b[2] > a[2] and a[3] != b[3] and None not in a[4:] + b[4:]:
                w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
                if w > 1 and h > 1 and w * h > 4:
                    want[a[:2]] = max(want.get(a[:2], ()), (w * h, -b[2], b[1]))
    got = {(r.capture_id, r.selector): (r.area, r.colliding) for r in geometry.text_collision(df).collect()}
    assert got == {k: (v[0], v[2]) for k, v in want.items()}


def test_target_spacing_of_every_size_brute_force(spark):
    rows, df = some_boxes(spark)
    out = geometry.target_spacing(df.withColumn("more", F.col("ord") + 1)).collect()
    assert len(out) == len(rows) and all(r.more == r.ord + 1 for r in out)
    got = {(r.capture_id, r.selector): (r.shape_gap, r.nearest) for r in out}
    shapes = Counter((r[0], *r[4:]) for r in rows)
    for a in rows:
        near = []
        for b in rows:
            if not a[0] or a[0] != b[0] or None in a[4:] + b[4:] or (a[4:] == b[4:] and shapes[(b[0], *b[4:])] < 2):
                continue
            cx, cy = (a[4] + a[6]) / 2, (a[5] + a[7]) / 2
            if b[6] - b[4] < 24 or b[7] - b[5] < 24:
                gap = math.hypot(cx - (b[4] + b[6]) / 2, cy - (b[5] + b[7]) / 2) - 24
            else:
                gap = math.hypot(cx - max(b[4], min(cx, b[6])), cy - max(b[5], min(cy, b[7]))) - 12
            near += [(gap, b[1] or "")] if gap < 12 else []
        gap, by = min(near, default=(None, None))
        assert got[a[:2]][1] == by and (gap is None or abs(got[a[:2]][0] - gap) < 0.006), a
