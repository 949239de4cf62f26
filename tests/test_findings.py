"""Finding identity, diff, scores, colour and text functions on literal rows."""

import colorsys
import math

import pytest
from pyspark.sql import functions as F

from siteaudit.functions import text as tx
from siteaudit.functions.color import contrast_ratio, normalize_color, over, rgba_lit
from siteaudit.operators import contracts, findings as fin, scoring
from siteaudit.streaming.watch import stream_queue, watch_scan


def test_fingerprint_identity(spark):
    rows = [("D", "a", 1, 0.5), ("D", "a", 1, 0.5000001), ("D", "a", 2, 0.5), ("E", "a", 1, 0.5)]
    df = spark.createDataFrame(rows, "d string, p string, line int, m double")
    fp = fin.fingerprint(
        F.col("d"),
        source=fin.canonical(df, path=F.col("p"), line=F.col("line")),
        evidence=fin.canonical(df, metric=F.col("m")),
    )
    got = [r.f for r in df.select(fp.alias("f")).collect()]
    assert got[0] == got[1] and len({got[0], got[2], got[3]}) == 3


def test_fingerprint_is_sha_of_sorted_json(spark):
    import hashlib
    import json

    df = spark.createDataFrame([("D", "a.ts", 3)], "d string, p string, line int")
    got = df.select(
        fin.fingerprint(F.col("d"), source=fin.canonical(df, path=F.col("p"), line=F.col("line")))
    ).first()[0]
    doc = {
        "detector_id": "D", "source_anchor": {"path": "a.ts", "line": 3}, "runtime_anchor": {},
        "contract_anchor": {}, "evidence": {},
    }
    want = hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got == want


def test_multiset_diff(spark):
    k = lambda xs: spark.createDataFrame([(x,) for x in xs], "key string")
    got = {(r.key, r.change): r.n for r in fin.finding_diff(k("aabb"), k("aaac")).collect()}
    assert got == {("a", "UNCHANGED"): 2, ("a", "NEW"): 1, ("b", "FIXED"): 2, ("c", "NEW"): 1}


def test_score_example(spark):
    f = spark.createDataFrame(
        [("s", "warning", 1.0, "pending", "static"), ("c", "critical", 1.0, "pending", "static"),
         ("n", "critical", 1.0, "investigate", "static")],
        "k string, severity string, confidence double, status string, provenance string",
    )
    got = {r.k: r for r in scoring.score_snapshot(f, ["k"], F.lit(1.0), F.lit(80.0)).collect()}
    assert (got["s"].slop, got["s"].objective, got["s"].blended) == (10.0, 90, 86)
    assert (got["c"].objective, got["c"].blended) == (70, 70)
    assert (got["n"].slop, got["n"].objective, got["n"].blended) == (0.0, 100, 92)


def test_queue_resolve_is_all_or_nothing(spark):
    q = spark.createDataFrame([("a",), ("b",)], "fingerprint string")
    r = lambda rows: spark.createDataFrame(rows, "fingerprint string, outcome string, evidence_hash string")
    ok = fin.queue_resolve(q, r([("a", "absent", "h")]))
    assert {x.fingerprint: x.state for x in ok.collect()} == {"a": "resolved", "b": "queued"}
    for bad in ([("a", "absent", "h"), ("b", "reproduced", "h")], [("a", "absent", "h"), ("zz", "absent", "h")],
                [("a", "absent", "")]):
        assert {x.state for x in fin.queue_resolve(q, r(bad)).collect()} == {"queued"}


def _lin(v):
    return v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4


@pytest.fixture(scope="module")
def paint(spark):
    texts = [
        "#fff", "#0a0b0c80", "rgb(10, 20, 30)", "rgb(10%, 20%, 30%)", "rgba(1 2 3 / 25%)", "hsl(120, 50%, 25%)",
        "hsla(0.5turn 100% 50% / 0.5)", "oklch(0.5 0.1 90)", "oklab(50% 40% -0.1)", "color(srgb 0.5 0.25 1)",
        "color(srgb-linear 0.5 0.25 1)", "transparent", "currentcolor", "#12", "rgb(1,2)", "blurple",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r.t: r.c for r in df.select("t", normalize_color(F.col("t")).alias("c")).collect()}


def test_colours(paint):
    close = lambda c, w: tuple(c) == pytest.approx(w, abs=1e-9)
    assert close(paint["#fff"], (1, 1, 1, 1))
    assert close(paint["#0a0b0c80"], (*[_lin(v / 255) for v in (10, 11, 12)], 128 / 255))
    assert close(paint["rgb(10, 20, 30)"], (*[_lin(v / 255) for v in (10, 20, 30)], 1))
    assert close(paint["rgb(10%, 20%, 30%)"], (*[_lin(v) for v in (0.1, 0.2, 0.3)], 1))
    assert close(paint["rgba(1 2 3 / 25%)"], (*[_lin(v / 255) for v in (1, 2, 3)], 0.25))
    assert close(paint["hsl(120, 50%, 25%)"], (*[_lin(v) for v in colorsys.hls_to_rgb(1 / 3, 0.25, 0.5)], 1))
    assert close(paint["hsla(0.5turn 100% 50% / 0.5)"], (0, 1, 1, 0.5))
    a, b = 0.1 * math.cos(math.radians(90)), 0.1 * math.sin(math.radians(90))
    l, m, s = ((0.5 + x * a + y * b) ** 3 for x, y in [
        (0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480)])
    red = 4.0767416621 * l - 3.3077115913 * m + 0.2309699292 * s
    assert paint["oklch(0.5 0.1 90)"].r == pytest.approx(red)
    assert paint["oklab(50% 40% -0.1)"].a == 1
    assert close(paint["color(srgb 0.5 0.25 1)"], (_lin(0.5), _lin(0.25), 1, 1))
    assert close(paint["color(srgb-linear 0.5 0.25 1)"], (0.5, 0.25, 1, 1))
    assert close(paint["transparent"], (0, 0, 0, 0))
    for t in ("currentcolor", "#12", "rgb(1,2)", "blurple"):
        assert paint[t] is None


def test_compositing(spark):
    row = spark.range(1).select(
        contrast_ratio(rgba_lit((0, 0, 0, 1)), rgba_lit((1, 1, 1, 1))).alias("k"),
        over(rgba_lit((1, 0, 0, 0.5)), rgba_lit((0, 0, 1, 1))).alias("c"),
    ).first()
    assert row.k == pytest.approx(21) and tuple(row.c) == pytest.approx((0.5, 0, 0.5, 1))


def test_route_spellings(spark):
    same = ["/users/:id", "/users/{id}", "/users/[id]", "/users/$id", "/users/<int:id>", "/users/${user.id}",
            "https://h.example/users/{id}?a=1", "users//:id/"]
    df = spark.createDataFrame([(s,) for s in same], "p string")
    got = df.select(contracts.route_normalize(F.col("p"))["path"]).collect()
    assert {r[0] for r in got} == {"/users/{}"}


def test_schema_diff_order(spark):
    cols = ("op_id string, relation string, status string, field_path string, type string, nullable boolean, "
            "enum string, constraints string, required boolean, incomplete boolean")
    row = lambda op, path, t="string", req=False: (op, "response", "200", path, t, False, "", "", req, False)
    f = spark.createDataFrame(
        [row("f", "", "object"), row("f", "a", "object"), row("f", "a.z", "number"), row("f", "b", "number"),
         row("b", "", "object"), row("b", "a", "object"), row("b", "a.z", "string"), row("b", "b", "string")],
        cols,
    )
    p = spark.createDataFrame([("f", "b")], "front_op string, back_op string")
    r = contracts.schema_diff(p, f, "response").first()
    assert (r.kind, r.field) == ("response_field_type_mismatch", "a.z")


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("isLoading", "loading"), ("not_loading", None), ("hasNoResults", "empty"), ("taskPending", None),
         ("HTTPError", "error"), ("formSaved", "success"), ("é", None)], "v string, want string")
    for r in df.withColumn("got", tx.state_normalize(F.col("v"))).collect():
        assert r.got == r.want, r.v
    t = spark.createDataFrame([("api_key=abc, see https://u:p@h.example/x?t=1 and sk-abcdefghijklmnopqrst",)], "t string")
    s = t.select(tx.redact(F.col("t"))).first()[0]
    assert s == f"api_key={tx.MASK}, see https://h.example/x and {tx.MASK}"


def test_stream_equals_batch(spark, tmp_path):
    from siteaudit.operators.rule_scan import rule_scan

    rows = [(f"{i}.html", "html", "<head></head><video>" * (i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "path string, ext string, content string")
    for i in range(3):
        df.where(F.col("path").substr(1, 1).cast("int") % 3 == i).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    watch_scan(src, str(tmp_path / "out"), str(tmp_path / "state"), ["html"]).awaitTermination()
    got = sorted(r.fingerprint for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.fingerprint for r in rule_scan(df, exts=["html"]).collect())


def test_stream_queue_drops_repeats(spark, tmp_path):
    df = spark.sql("SELECT 'f' || id % 5 AS fingerprint, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id) AS ts FROM range(40)")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = (stream_queue(s, "ts").writeStream.format("memory").queryName("dd").trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "c")).start())
    q.awaitTermination()
    assert spark.table("dd").count() == 5


def test_fingerprint_escapes_the_detector_and_keeps_null(spark):
    import hashlib
    import json

    df = spark.createDataFrame([('a"b\\',), (None,)], "d string")
    got = [r[0] for r in df.select(fin.fingerprint(F.col("d"))).collect()]
    for d, fp in zip(['a"b\\', None], got, strict=True):
        body = {"contract_anchor": {}, "detector_id": d, "evidence": {}, "runtime_anchor": {}, "source_anchor": {}}
        assert fp == hashlib.sha256(json.dumps(body, separators=(",", ":")).encode()).hexdigest()


def test_canonical_hides_noise(spark):
    one = spark.sql("SELECT 1.0D AS a, 1.0000001D AS b, -1E-9D AS z, 1.5F AS f, 7 AS i")
    r = one.select(
        fin.canonical(one, m=F.col("a")),
        fin.canonical(one, m=F.col("b")),
        fin.canonical(one, m=F.col("z"), f=F.col("f"), i=F.col("i")),
        fin.canonical(one, l=F.array("a", "b"), s=F.struct("b", "i"), k=F.create_map(F.lit("x"), F.col("b"))),
    ).first()
    assert r[0] == r[1] == '{"m":1.0}'
    assert r[2] == '{"f":1.5,"i":7,"m":0.0}'
    assert r[3] == '{"k":{"x":1.0},"l":[1.0,1.0],"s":{"b":1.0,"i":7}}'


def test_evidence_policy_takes_the_last_of_equal_keys(spark):
    df = spark.createDataFrame([("measured", "", ["c"])], "basis string, authority string, remediation_constraints array<string>")
    for text, want in (
        ("map('a ', '1', 'a', '2', 'b', '3')", {"a": "2", "b": "3"}),
        ("map('a', '1', ' a', '2', 'a ', '4')", {"a": "4"}),
        ("map(' ', '1')", {}),
        ("CAST(NULL AS map<string,string>)", None),
    ):
        assert fin.evidence_policy(df.withColumn("applicability", F.expr(text))).first()["applicability"] == want


def test_issues_with_one_prefix_keep_apart(spark):
    df = spark.createDataFrame([("p", "x" * 130 + "1"), ("p", "x" * 130 + "2")], "p string, i string")
    none = F.lit(None).cast("int")
    assert df.select(fin.diff_key(F.col("p"), F.col("i"), none, none)).distinct().count() == 2


def test_evidence_policy_keeps_whole_values(spark):
    many = [f"keep {i} " + "x" * 600 for i in range(40)]
    pairs = {f"{i} " + "k" * 100: "v" * 600 for i in range(40)}
    df = spark.createDataFrame(
        [("measured", "WCAG", [*many, " "], pairs)],
        "basis string, authority string, remediation_constraints array<string>, applicability map<string,string>",
    )
    r = fin.evidence_policy(df).first()
    assert r["basis"] == "measured" and r["remediation_constraints"] == many and r["applicability"] == pairs
