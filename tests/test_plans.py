"""Skew-safe windows and fixpoints against the plain computation."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siteaudit.operators import calibration, design_audit, geometry, graph, peers, scoring
from siteaudit.plans import fixpoint
from siteaudit.plans.ordered import group_median, ordered


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(7)
    rows = [
        (("hot" if i % 3 else f"g{i % 40}"), float(rnd.randrange(60)), i, rnd.choice([None, rnd.random()]))
        for i in range(3000)
    ]
    return spark.createDataFrame(rows, "g string, v double, id int, w double").cache()


def test_ranged_steps_equal_windows(hot):
    steps = {
        "rn": ("row_number", None),
        "prev": ("lag", "w"),
        "run": ("running_sum", "v"),
        "seen": ("last_before", "w"),
        "top": ("max_before", "v"),
    }
    plain = ordered(hot, ["g"], ["v", "id"], steps, limit=10**9)
    ranged = ordered(hot, ["g"], ["v", "id"], steps, limit=0)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, ranged.collect()), key=str)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_medians_and_percentiles(hot, limit):
    rows = hot.select("g", "v").collect()
    by = {}
    for r in rows:
        by.setdefault(r.g, []).append(r.v)
    med = {r.g: r.m for r in group_median(hot, ["g"], "v", "m", limit).collect()}
    assert med == {g: statistics.median(v) for g, v in by.items()}
    near = {r.g: r.p for r in calibration.nearest_rank(hot, ["g"], "v", {"p": 0.9}, limit).collect()}
    assert near == {g: sorted(v)[-(-len(v) * 9 // 10) - 1] for g, v in by.items()}
    inter = {r.g: r.p for r in calibration.interp_percentile(hot, ["g"], "v", 0.9, "p", limit).collect()}
    for g, v in by.items():
        s, at = sorted(v), (len(v) - 1) * 0.9
        lo = int(at)
        hi = min(lo + 1, len(s) - 1)
        assert inter[g] == pytest.approx(s[lo] + (s[hi] - s[lo]) * (at - lo))


def test_rhythm_and_headings_do_not_depend_on_the_plan(spark):
    rnd = random.Random(3)
    rows = [
        ("c", "p", "g", f"h{1 + i % 4}", float(i * 37 + rnd.randrange(30)), 0.0, float(rnd.randrange(5, 30)), i,
         float(rnd.choice([12, 16, 20])), 400.0, f"r{i}")
        for i in range(300)
    ]
    e = spark.createDataFrame(
        rows,
        "capture_id string, parent string, grp string, tag string, y double, x double, height double, "
        "ord int, font_size double, font_weight double, rid string",
    )
    key = lambda df: sorted(r.rid for r in df.collect())
    a = design_audit.spatial_rhythm(e, ["capture_id", "parent", "grp"], "rid", 10**9)
    b = design_audit.spatial_rhythm(e, ["capture_id", "parent", "grp"], "rid", 0)
    assert key(a) == key(b) and key(a)
    a = design_audit.heading_hierarchy(e, ["capture_id", "parent"], ["ord", "rid"], 10**9)
    b = design_audit.heading_hierarchy(e, ["capture_id", "parent"], ["ord", "rid"], 0)
    assert key(a) == key(b) and key(a)


def test_components_and_levels(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 6), (7, 5), (7, 6), (8, 9), (9, 8)]
    e = spark.createDataFrame(edges, "src int, dst int")
    n = spark.createDataFrame([(i,) for i in range(1, 11)], "node int")
    got = {r.node: (r.comp, r.level, r.cyclic) for r in fixpoint.topo_levels(n, e).collect()}
    assert got == {
        1: (1, 0, True), 2: (1, 0, True), 3: (1, 0, True), 4: (4, 1, False), 5: (5, 2, False),
        6: (6, 0, True), 7: (7, 3, False), 8: (8, 0, True), 9: (8, 0, True), 10: (10, 0, False),
    }


def components_by_hand(nodes, edges):
    reach = {n: {n} for n in nodes}
    grown = True
    while grown:
        grown = False
        for a, b in edges:
            for n in nodes:
                if a in reach[n] and b not in reach[n]:
                    reach[n].add(b)
                    grown = True
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def levels_by_hand(nodes, edges, comp):
    dag = {(comp[a], comp[b]) for a, b in edges if comp[a] != comp[b]}
    level = dict.fromkeys(set(comp.values()), 0)
    for _ in nodes:
        for a, b in dag:
            level[a] = max(level[a], level[b] + 1)
    return {n: level[comp[n]] for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_levels_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    nodes = list(range(60))
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45 + 10 * seed)]
    # A ring, a tail into a cycle, a tail out of one and chains between components.
    edges += [(100 + k, 100 + (k + 1) % 9) for k in range(9)] + [(120 + k, 121 + k) for k in range(8)]
    edges += [(128, 100), (105, 140), (140, 141), (141, 142), (142, 107), (142, 150), (150, 151), (151, 152)]
    nodes += [n for e in edges for n in e]
    nodes = sorted(set(nodes))
    comp = components_by_hand(nodes, edges)
    level = levels_by_hand(nodes, edges, comp)
    loop = {a for a, b in edges if a == b}
    size = {c: list(comp.values()).count(c) for c in comp.values()}
    e = spark.createDataFrame(edges, "src int, dst int")
    n = spark.createDataFrame([(i,) for i in nodes], "node int")
    got = {r.node: (r.comp, r.level, r.cyclic) for r in fixpoint.topo_levels(n, e).collect()}
    bad = {comp[x] for x in loop}
    assert got == {x: (comp[x], level[x], size[comp[x]] > 1 or comp[x] in bad) for x in nodes}


def test_a_long_chain_takes_few_rounds(spark):
    """A chain of 10,000 nodes and a ring behind it; walking would take 10,000 rounds."""
    e = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(
        spark.range(3_000).selectExpr("20000 + id AS src", "20000 + (id + 1) % 3000 AS dst")
    ).unionByName(spark.sql("SELECT 10000L AS src, 20005L AS dst"))
    n = spark.range(10_001).withColumnRenamed("id", "node").unionByName(
        spark.range(20_000, 23_000).withColumnRenamed("id", "node")
    )
    got = fixpoint.topo_levels(n, e)
    bad = got.where(
        "CASE WHEN node < 20000 THEN comp <> node OR level <> 10001 - node OR cyclic "
        "ELSE comp <> 20000 OR level <> 0 OR NOT cyclic END"
    )
    assert got.count() == 13_001 and bad.count() == 0


def test_route_match_shapes(spark):
    pats = ["/a/:id", "/a/:id?", "/*", "/a/*", "/a/b", "/:x/b", "/"]
    paths = ["/", "/a", "/a/b", "/a/c", "/a/b/c", "/z"]
    p = spark.createDataFrame([(x,) for x in pats], "pattern string")
    c = spark.createDataFrame([(x,) for x in paths], "path string")
    m = graph.route_match(c, p)
    got = {}
    for r in m.collect():
        got.setdefault(r.path, set()).add(r.pattern)
    assert got["/"] == {"/", "/*"}
    assert got["/a"] == {"/a/:id?", "/*", "/a/*"}
    assert got["/a/b"] == {"/a/:id", "/a/:id?", "/*", "/a/*", "/a/b", "/:x/b"}
    assert got["/a/b/c"] == {"/*", "/a/*"}
    best = {}
    for r in graph.route_specificity(m).collect():
        best.setdefault(r.path, set()).add(r.pattern)
    assert best["/a/b"] == {"/a/b"} and best["/a/b/c"] == {"/a/*"}


def peers_by_hand(rows):
    groups = []
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        if groups:
            f = groups[-1][0]
            size = min(r[3] - r[2], f[3] - f[2])
            if size > 0 and (min(r[3], f[3]) - max(r[2], f[2])) / size >= 0.5:
                groups[-1].append(r)
                continue
        groups.append([r])
    return {r[1]: (g[0][2], len(g)) for g in groups if len(g) >= 3 for r in g}


def test_peer_groups_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for parent, n, wide in (("p", 120, 40), ("q", 90, 6), ("r", 60, 190), ("one", 1, 9), (None, 40, 20)):
        for i in range(n):
            t = rnd.randrange(200)
            # Some spans are empty, some end above their top, many are equal.
            rows.append((parent, f"{parent}{i}", float(t), float(t + rnd.randrange(-1, wide))))
    df = spark.createDataFrame(rows, "parent string, selector string, top double, bottom double")
    want = {}
    for parent in {r[0] for r in rows}:
        want |= peers_by_hand([r for r in rows if r[0] == parent])
    # one shard; then shards that cut through the groups
    for limit, shard_rows in ((10**9, 10**9), (0, 25)):
        out = peers.peer_groups(df.where("parent IS NOT NULL"), ["parent"], limit, shard_rows)
        got = {r.selector: (r.group_top, r.members) for r in out.collect()}
        assert got == {k: v for k, v in want.items() if not k.startswith("None")}


def test_peer_groups_of_a_long_island(spark):
    """One island of 30,000 spans, each overlapping the next: every second one opens a group."""
    df = spark.range(30_000).selectExpr(
        "'p' AS parent", "CAST(id AS STRING) AS selector", "id * 10D AS top", "id * 10D + 14D AS bottom"
    )
    df = df.unionByName(df).unionByName(df)
    out = peers.peer_groups(df, ["parent"], shard_rows=4_000)
    rows = [("p", str(k), k * 10.0, k * 10.0 + 14.0) for k in range(30_000) for _ in range(3)]
    want = peers_by_hand(rows)
    got = out.groupBy("selector").agg(F.min("group_top").alias("t"), F.max("members").alias("m")).collect()
    assert {r.selector: (r.t, r.m) for r in got} == want


def test_target_spacing_brute_force(spark):
    import math

    rnd = random.Random(5)
    rows = []
    for i in range(150):
        x, y = rnd.randrange(400), rnd.randrange(400)
        w, h = rnd.choice([(10, 10), (40, 30), (5000, 5000)] if i % 50 == 0 else [(10, 10), (40, 30)])
        rows.append(("c", f"s{i}", float(x), float(y), float(x + w), float(y + h)))
    rows += [("c", f"dup{i}", 1000.0, 1000.0, 1030.0, 1030.0) for i in range(3)]
    df = spark.createDataFrame(
        rows, "capture_id string, selector string, left double, top double, right double, bottom double"
    )
    got = {r.selector: r for r in geometry.target_spacing(df).collect()}
    for a in rows:
        cx, cy = (a[2] + a[4]) / 2, (a[3] + a[5]) / 2
        best = math.inf
        for b in rows:
            if b[1] == a[1]:
                continue
            if b[4] - b[2] < 24 or b[5] - b[3] < 24:
                gap = math.hypot(cx - (b[2] + b[4]) / 2, cy - (b[3] + b[5]) / 2) - 24
            else:
                nx, ny = max(b[2], min(cx, b[4])), max(b[3], min(cy, b[5]))
                gap = math.hypot(cx - nx, cy - ny) - 12
            best = min(best, gap)
        assert got[a[1]].spacing == ("intersects" if best < 0 else "clear"), a
        if best < 12:
            assert got[a[1]].shape_gap == pytest.approx(best, abs=0.006)


def test_target_spacing_reaches_small_targets_beyond_their_side(spark):
    """Centres 34 px apart: outside the 24 px around a narrow target, yet a gap of 10."""
    rows = [("c", "a", 0.0, 0.0, 2.0, 2.0), ("c", "b", 34.0, 0.0, 36.0, 2.0), ("c", "far", 500.0, 0.0, 502.0, 2.0)]
    # a cell border between the two
    rows = [(c, n, x + 100, y, r + 100, b) for c, n, x, y, r, b in rows]
    df = spark.createDataFrame(
        rows, "capture_id string, selector string, left double, top double, right double, bottom double"
    )
    got = {r.selector: (r.spacing, r.shape_gap, r.nearest) for r in geometry.target_spacing(df).collect()}
    assert got == {"a": ("clear", 10.0, "b"), "b": ("clear", 10.0, "a"), "far": ("clear", None, None)}


def test_cells_of_a_grid_are_not_computed_in_a_filter(spark):
    """Filters pushed down spelled the level of a rectangle out dozens of times."""
    df = spark.range(10).selectExpr(
        "'c' AS capture_id", "id * 3D AS left", "id * 5D AS top", "id * 7D AS right", "id * 9D AS bottom"
    )
    plan = geometry.grid_levels(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "LOG2" in line]


def test_forms_of_pages_that_share_a_script(spark):
    """Every page loads the one script that binds every form: a row for each form, not for each pair."""
    from siteaudit.operators.markup import project_reconcile

    n = 3_000
    pages = spark.range(n).selectExpr(
        "concat('site/p', id, '.html') AS path", "'FORM_NO_SUBMIT_SLOP' AS detector_id",
        """concat('<form id="f', id, '"><script src="s.js"></script>') AS content""",
    )
    scripts = spark.range(n - 5).selectExpr(
        "'site/s.js' AS path",
        """concat('document.getElementById("f', id, '").addEventListener("submit", go)') AS content""",
    )
    out = project_reconcile(pages.select("path", "detector_id"), pages, scripts)
    assert sorted(r.path for r in out.collect()) == [f"site/p{i}.html" for i in range(n - 5, n)]

    def rows(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if name.endswith("QueryStageExec"):
            node = node.plan()
        metric = node.metrics().get("numOutputRows")
        kids = node.children()
        return max([metric.get().value() if metric.isDefined() else 0, *(rows(kids.apply(i)) for i in range(kids.size()))])

    assert rows(out._jdf.queryExecution().executedPlan()) <= 10 * n


def test_peer_deviation_shuffles_members_once(spark):
    import statistics

    rnd = random.Random(8)
    rows = [(f"c{i % 9}", f"s{i}", float(rnd.randrange(3)), 50.0 + rnd.randrange(3)) for i in range(120)]
    df = spark.createDataFrame(rows, "capture_id string, selector string, top double, bottom double")

    def brute(c, s):
        devs = []
        for f in (lambda r: r[2], lambda r: (r[2] + r[3]) / 2, lambda r: r[3]):
            own = next(f(r) for r in rows if r[1] == s)
            rest = [f(r) for r in rows if r[0] == c and r[1] != s]
            if len(rest) >= 2 and max(rest) - min(rest) <= 2:
                devs.append(abs(own - statistics.median(rest)))
        return min(devs, default=0.0)

    want = {r[1]: brute(r[0], r[1]) for r in rows}
    for limit in (1, 1_000):
        out = geometry.peer_deviation(df, ["capture_id"], "selector", limit)
        assert {r.selector: r.deviation for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_rounds_of_a_fixpoint_broadcast_no_table(spark):
    from siteaudit.plans.fixpoint import topo_levels

    edges = spark.range(60).selectExpr("id AS src", "id + 1 + id % 2 AS dst")
    out = topo_levels(edges.select(F.col("src").alias("node")), edges)
    assert out.count()
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_capped_log_keeps_newest(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "kind string, seq int")
    got = sorted((r.kind, r.seq) for r in scoring.capped_log(df, 3).collect())
    assert got == [("a", 6), ("a", 7), ("a", 8), ("b", 1)]
    assert df.withColumn("x", F.row_number().over(Window.partitionBy("kind").orderBy("seq"))).count() == 10


def test_percentiles_ignore_nulls_on_both_sides_of_the_limit(spark):
    from siteaudit.operators.calibration import interp_percentile, nearest_rank

    rows = [("a", float(i)) for i in range(10)] + [("a", None)] * 10
    df = spark.createDataFrame(rows, "k string, v double")
    near = {
        limit: nearest_rank(df, ["k"], "v", {"p90": 0.9}, limit).first()["p90"] for limit in (1, 1000)
    }
    between = {
        limit: interp_percentile(df, ["k"], "v", 0.9, "p", limit).first()["p"] for limit in (1, 1000)
    }
    assert near == {1: 8.0, 1000: 8.0}
    assert {k: round(v, 9) for k, v in between.items()} == {1: 8.1, 1000: 8.1}


RECT = "capture_id string, selector string, left double, top double, right double, bottom double"


def wild_rects(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        side = 2.0 ** rnd.choice([0, 3, 5, 6, 7, 9, 12, 29])
        x, y = rnd.uniform(-300, 900), rnd.uniform(-300, 900)
        rows.append(("c" + str(i % 2), f"s{i}", x, y, x + side * rnd.random(), y + side * rnd.random()))
    inf = float("inf")
    rows += [("c0", "all", -inf, -inf, inf, inf), ("c1", "none", None, 0.0, 5.0, 5.0), ("c0", "point", 5.0, 5.0, 5.0, 5.0)]
    return rows


def test_levels_bound_the_cells_of_a_rectangle(spark):
    df = spark.createDataFrame([("c", "wild", -3.0, 7.0, 1e9, 1e9), *wild_rects(300, 1)], RECT)
    cells = geometry.grid_levels(df).groupBy("selector").count().collect()
    assert max(r["count"] for r in cells) <= 4
    assert {r.selector for r in cells} == {f"s{i}" for i in range(300)} | {"wild", "all", "point"}


@pytest.mark.parametrize("expand", [0, 24])
def test_cell_pairs_hold_every_overlap_once(spark, expand):
    rows = wild_rects(250, 2 + expand)
    df = spark.createDataFrame(rows, RECT)
    side = lambda pre: geometry._as(df, pre, "selector")
    got = [(r.a_selector, r.b_selector) for r in geometry.cell_pairs(side("a_"), side("b_"), expand).collect()]
    assert len(got) == len(set(got))
    want = {
        (a[1], b[1])
        for a in rows
        for b in rows
        if a[0] == b[0] and None not in a and None not in b
        and a[2] - expand <= b[4] and b[2] <= a[4] + expand and a[3] - expand <= b[5] and b[3] <= a[5] + expand
    }
    assert want <= set(got)
    assert not any("none" in p for p in got)


def test_occlusion_brute_force(spark):
    rows = [r for r in wild_rects(120, 9) if None not in r and r[1] != "all"]
    df = spark.createDataFrame([(*r, i % 7) for i, r in enumerate(rows)], RECT + ", z int")
    got = {(r.capture_id, r.selector): (r.occluded_by, r.occluded_fraction)
           for r in geometry.occlusion_candidates(df, df).collect()}
    want = {}
    for a in rows:
        ix, iy = min(2.0, (a[4] - a[2]) / 4), min(2.0, (a[5] - a[3]) / 4)
        pts = [((a[2] + a[4]) / 2, (a[3] + a[5]) / 2)]
        pts += [(x, y) for y in (a[3] + iy, a[5] - iy) for x in (a[2] + ix, a[4] - ix)]
        tops = []
        for x, y in pts:
            over = [(i % 7, b[1]) for i, b in enumerate(rows) if b[0] == a[0] and b[1] != a[1]
                    and b[2] <= x < b[4] and b[3] <= y < b[5]]
            if over:
                tops.append(max(over)[1])
        if tops:
            n, by = max((tops.count(t), t) for t in tops)
            want[a[0], a[1]] = (by, n / 5)
    assert got == want and len(want) > 20


def owner_by_hand(row, modules, selectors, route_sources):
    _, route, selector, tag, hint = row
    if hint is not None and hint in modules:
        return "resolved", 1.0, "runtime:source-hook", hint
    tag = tag and tag.lower()
    special = selector if selector is not None and tag is not None and selector.lower() != tag else None
    here = {p for r, p in route_sources if r == route and r is not None}
    for strength, key in (("exact", selector), ("heuristic", special), ("heuristic", tag)):
        found = {p for p, s, k in selectors if s == key and k == strength and key is not None}
        exact = strength == "exact"
        if len(found) == 1:
            return "resolved", 1.0 if exact else 0.65, f"selector:{'exact' if exact else 'unique-heuristic'}", min(found)
        if found:
            on = found & here
            if len(on) == 1:
                return "resolved", 0.9 if exact else 0.6, f"selector:{strength}+route", min(on)
            return "ambiguous", 0.0, "selector:ambiguous" + ("" if exact else "-heuristic"), None
    if len(here) == 1:
        return "resolved", 0.4, "route:unique-context", min(here)
    if here:
        return "ambiguous", 0.0, "route:ambiguous-context", None
    return "unresolved", 0.0, "source-signature:absent", None


def test_owners_by_hand_with_a_hot_selector(spark):
    rnd = random.Random(8)
    modules = ["f0", "f1"]
    selectors = [
        (f"f{rnd.randrange(9)}", rnd.choice([".a", ".b", ".c", "#d", "div", "nav", ".e"]), rnd.choice(["exact", "heuristic"]))
        for _ in range(18)
    ]
    selectors += selectors[:4] + [(f"f{i}", ".hot", "heuristic") for i in range(40)]
    selectors += [(f"f{i}", s, k) for i in (50, 51) for s, k in ((".x", "exact"), (".y", "heuristic"))]
    routes = [(f"/r{rnd.randrange(8)}", f"f{rnd.randrange(40)}") for _ in range(14)] + [(None, "f3"), ("/x", "f50"), ("/z", "f1")]
    rows = [
        (
            i,
            rnd.choice([f"/r{rnd.randrange(10)}", None]),
            rnd.choice([".a", ".b", ".c", "#d", "div", "NAV", ".e", ".none", "", None]),
            rnd.choice(["div", "NAV", "p", None]),
            rnd.choice(["f0", "", "gone", None, None, None]),
        )
        for i in range(600)
    ]
    rows += [(700 + i, r, s, "p", None) for i, (r, s) in enumerate((r, s) for r in ("/x", "/y", "/z") for s in (".x", ".y", ".none"))]
    rows += [(1000 + i, f"/r{i % 8}", ".hot", "p", None) for i in range(400)] + [(None, "/r1", ".a", "div", None)] * 2
    e = spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "eid int, url_route string, selector string, tag string, hint string, n string, a string"
    )
    m = spark.createDataFrame([(x,) for x in modules + modules], "path string")
    s = spark.createDataFrame(selectors, "path string, selector string, strength string")
    r = spark.createDataFrame(routes, "url_route string, path string")
    got = graph.source_ownership(e, m, s, r)
    assert got.columns == ["eid", "status", "confidence", "rule", "source"]
    want = sorted((str(x[0]), *map(str, owner_by_hand(x, modules, selectors, routes))) for x in rows)
    assert sorted(tuple(map(str, x)) for x in got.collect()) == want
    assert len({x[3] for x in want}) == 10
    assert graph.source_ownership(e.limit(0), m, s, r).count() == 0
    assert graph.source_ownership(e, m.limit(0), s.limit(0), r.limit(0)).count() == len(rows)
