"""Finding algebra, scores, order and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteaudit.operators import calibration, findings as fin, rule_scan, scoring
from siteaudit.workload.derive import FINDINGS, PAGES, duck, table, view
from siteaudit.workload.q_rules import PAGE_COUNTS, pages
from siteaudit.workload.registry import query

FX = duck(FINDINGS)
LIVE = "status NOT IN ('informational', 'investigate', 'suppressed', 'verified_resolved')"
W = (
    "CASE severity WHEN 'info' THEN 3.0 WHEN 'warning' THEN 10.0 WHEN 'error' THEN 20.0 "
    "WHEN 'critical' THEN 30.0 ELSE 10.0 END"
)


def fx(spark, d):
    return view(spark, d, FINDINGS)


def n_by(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# Flagship: pages -> findings -> score per page.
@query(
    "score_snapshot",
    f"""WITH c AS (SELECT path, detector_id, n FROM ({PAGE_COUNTS})),
 t AS (SELECT path, sum(n * CASE WHEN detector_id IN ({", ".join(repr(r[0]) for r in
 rule_scan.RULES if r[1] == "T1")}) THEN 3.0 WHEN detector_id IN ({", ".join(repr(r[0]) for r in
 rule_scan.RULES if r[1] == "T3")}) THEN 20.0 ELSE 10.0 END) AS slop, sum(n) AS pending
 FROM c GROUP BY path)
SELECT path, slop, CAST(greatest(0, least(100, round_even(100 - slop, 0))) AS INT) AS objective,
 CAST(greatest(0, least(100, round_even(100 - slop, 0))) AS INT) AS blended,
 CAST(pending AS BIGINT) AS pending FROM (SELECT p.path, coalesce(slop, 0) AS slop, coalesce(pending, 0) AS
 pending FROM (SELECT DISTINCT path FROM {duck(PAGES)}) p LEFT JOIN t USING (path))""",
)
def _(spark, d):
    scanned = pages(spark, d)
    f = rule_scan.rule_scan(scanned, exts=["html"])
    s = scoring.score_snapshot(
        f, ["path"], F.lit(1.0), subjects=scanned, scanned=rule_scan.scan_status() == "scanned"
    )
    return s.select("path", "slop", "objective", "blended", "pending")


_BLEND = f"""
SELECT site, slop, objective, critical_pending, CAST(CASE WHEN critical_pending
 THEN least(b, objective) ELSE b END AS INT) AS blended FROM (SELECT *, CASE WHEN review IS NULL
 THEN objective ELSE round_even(objective * 0.6::DOUBLE + review * 0.4::DOUBLE, 0) END AS b
 FROM (SELECT site, slop, review, critical_pending,
  CAST(greatest(0, least(100, round_even(100 * cov - slop, 0))) AS INT) AS objective FROM (
  SELECT site, round_even(coalesce(sum(CASE WHEN {LIVE} THEN {W} * confidence END), 0), 2) AS slop,
   CAST(max(0.5 + site % 3 * 0.25) AS DOUBLE) AS cov,
   max(CASE WHEN site % 2 = 0 THEN 40.0 + site % 50 END) AS review,
   bool_or({LIVE} AND severity = 'critical' AND provenance IN ('contract', 'runtime', 'static'))
    AS critical_pending
  FROM (SELECT * REPLACE (okey AS site) FROM {FX}) GROUP BY site)))"""


def _blend(spark, d):
    f = fx(spark, d).withColumn("site", F.col("okey"))
    return scoring.score_snapshot(
        f,
        ["site"],
        0.5 + F.col("site") % 3 * 0.25,
        F.when(F.col("site") % 2 == 0, 40.0 + F.col("site") % 50),
    )


@query("fingerprint", f"""
SELECT rid, sha256('{{"contract_anchor":{{}},"detector_id":"' || detector_id ||
 '","evidence":{{"matched_text":"' || message || '","measured":' || CAST(qty / 8E0 AS VARCHAR) || '}},"runtime_anchor":{{}},"source_anchor":{{"column":'
 || col || ',"end":' || (line + qty) || ',"line":' || line || ',"path":"' || path || '","start":'
 || line || '}}}}') AS fingerprint FROM {FX}""")
def _(spark, d):
    # The measured value carries noise, which the address must not see.
    f = fx(spark, d).withColumn("measured", F.expr("qty / 8D + (lno - 3) * 1E-8D"))
    anchor = fin.source_anchor(
        f, F.col("path"), F.col("line"), F.col("col"), F.col("line"), F.col("line") + F.col("qty")
    )
    evidence = fin.canonical(f, matched_text=F.col("message"), measured=F.col("measured"))
    return f.select(
        "rid", fin.fingerprint(F.col("detector_id"), source=anchor, evidence=evidence).alias("fingerprint")
    )


@query("requires_resolution", f"SELECT status, count(*) AS n FROM {FX} WHERE {LIVE} GROUP BY status")
def _(spark, d):
    return n_by(fx(spark, d).where(fin.requires_resolution(F.col("status"))), "status")


_LEGACY = """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS schema_version,
 CASE WHEN o_orderkey % 2 = 1 THEN 'D' || CAST(o_custkey AS VARCHAR(20)) END AS detector_id,
 CASE WHEN o_orderkey % 3 = 0 THEN 'R' || CAST(o_custkey AS VARCHAR(20)) END AS rule_id,
 CASE WHEN o_orderkey % 5 <> 0 THEN 'SCAN-' || CAST(o_orderkey AS VARCHAR(20)) END AS id,
 CASE WHEN o_orderkey % 7 <> 0 THEN 'T' || CAST(1 + o_orderkey % 4 AS VARCHAR(20)) END AS tier,
 'error' AS severity, CASE WHEN o_orderkey % 4 = 0 THEN 0.5E0 END AS confidence,
 'new ' || o_orderpriority AS message, 'old ' || o_orderpriority AS issue,
 CASE WHEN o_orderkey % 9 = 0 THEN 'investigate' END AS status, 'static' AS provenance,
 'n/' || o_orderstatus AS path, 'o/' || o_orderstatus AS file,
 CASE WHEN o_orderkey % 6 = 0 THEN 3 END AS line, CASE WHEN o_orderkey % 8 = 0 THEN 4 END AS "column",
 o_orderkey AS okey FROM {orders}
"""


@query(
    "legacy_upgrade",
    f"""SELECT detector_id, severity, confidence, message, status, provenance, path, line, col,
 count(*) AS n FROM (SELECT CASE WHEN schema_version < 2 THEN coalesce(rule_id, id, 'legacy-finding')
  ELSE detector_id END AS detector_id, CASE WHEN schema_version < 2 THEN CASE coalesce(tier, 'T4')
  WHEN 'T1' THEN 'info' WHEN 'T2' THEN 'warning' WHEN 'T3' THEN 'error' ELSE 'critical' END
  ELSE severity END AS severity, coalesce(confidence, 1.0) AS confidence,
  CASE WHEN schema_version < 2 THEN issue ELSE message END AS message,
  coalesce(status, 'pending') AS status,
  CASE WHEN schema_version < 2 THEN 'manual' ELSE provenance END AS provenance,
  CASE WHEN schema_version < 2 THEN file ELSE path END AS path, coalesce(line, 0) AS line,
  coalesce("column", 0) AS col FROM {duck(_LEGACY)}) GROUP BY ALL""",
)
def _(spark, d):
    up = fin.legacy_upgrade(view(spark, d, _LEGACY.replace('"column"', "`column`")))
    cols = [c for c in up.columns if c not in ("schema_version", "column")]
    return n_by(up.select(*cols, F.col("column").alias("col")), *cols, "col")


@query(
    "evidence_policy",
    """SELECT basis, authority, constraints, app, count(*) AS n FROM (SELECT
 CASE WHEN lower(trim(o_orderstatus || 'easured')) IN ('normative','measured','heuristic','review')
   THEN lower(trim(o_orderstatus || 'easured')) ELSE 'review' END AS basis,
 CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'WCAG ' || o_orderpriority END AS authority,
 CASE WHEN o_orderkey % 2 = 0 THEN 'keep' ELSE 'keep|also' END AS constraints,
 CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'observed' END AS app FROM orders) GROUP BY ALL""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    ok = F.col("o_orderkey")
    src = o.select(
        F.concat(F.lit(" "), "o_orderstatus", F.lit("easured ")).alias("basis"),
        F.when(ok % 3 == 0, "<bad>").otherwise(F.concat(F.lit(" WCAG "), "o_orderpriority")).alias(
            "authority"
        ),
        F.array(F.lit(" keep "), F.lit("  "), F.when(ok % 2 == 0, " ").otherwise("also")).alias(
            "remediation_constraints"
        ),
        F.create_map(
            F.when(ok % 2 == 0, " ").otherwise("status"), F.lit(" observed ")
        ).alias("applicability"),
    )
    p = fin.evidence_policy(src)
    p = p.select(
        "basis",
        "authority",
        F.array_join("remediation_constraints", "|").alias("constraints"),
        F.coalesce(F.col("applicability")["status"], F.lit("")).alias("app"),
    )
    return n_by(p, "basis", "authority", "constraints", "app")


@query(
    "dedup_findings",
    f"""SELECT path, detector_id, rid, status FROM {FX}
 QUALIFY row_number() OVER (PARTITION BY path, detector_id ORDER BY okey DESC, rid DESC) = 1""",
)
def _(spark, d):
    f = fx(spark, d).select(
        F.concat_ws("|", "path", "detector_id").alias("fingerprint"),
        F.struct("okey", "rid").alias("ord"), "path", "detector_id", "rid", "status",
    )
    return fin.dedup_findings(f, "ord").select("path", "detector_id", "rid", "status")


@query(
    "queue_add",
    f"""SELECT count(*) AS added, count(DISTINCT path) AS files FROM (SELECT DISTINCT path, detector_id
 FROM {FX} WHERE okey % 2 = 1 EXCEPT SELECT path, detector_id FROM {FX} WHERE okey % 2 = 0)""",
)
def _(spark, d):
    f = fx(spark, d).withColumn("fingerprint", F.concat_ws("|", "path", "detector_id"))
    cols = ["fingerprint", "path", "rid"]
    new = fin.queue_add(
        f.where("okey % 2 = 0").select(*cols), f.where("okey % 2 = 1").select(*cols), "rid"
    )
    return new.agg(
        F.count(F.lit(1)).alias("added"), F.count_distinct("path").alias("files")
    )


@query(
    "queue_resolve",
    f"""SELECT batch, state, count(*) AS n FROM (SELECT 'good' AS batch, CASE WHEN lno = 3 THEN
 'resolved' ELSE 'queued' END AS state FROM {FX} UNION ALL SELECT 'bad', 'queued' FROM {FX})
 GROUP BY ALL""",
)
def _(spark, d):
    q = fx(spark, d).select(F.col("rid").alias("fingerprint"), "lno", "okey")
    ask = q.where("lno = 3").select(
        "fingerprint", F.lit("absent").alias("outcome"), F.lit("h").alias("evidence_hash")
    )
    # The second batch holds findings still reproduced, so none of it may move.
    bad = q.where("lno = 3").select(
        "fingerprint",
        F.when(F.col("okey") % 50 == 0, "reproduced").otherwise("absent").alias("outcome"),
        F.lit("h").alias("evidence_hash"),
    )
    a = fin.queue_resolve(q, ask).select(F.lit("good").alias("batch"), "state")
    b = fin.queue_resolve(q, bad).select(F.lit("bad").alias("batch"), "state")
    return n_by(a.unionAll(b), "batch", "state")


@query(
    "override_audit",
    f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN lno = 2 AND okey % 3 <> 0
 THEN 'overridden' ELSE status END AS status FROM {FX}) GROUP BY status
 UNION ALL SELECT 'audit rows', count(*) FROM {FX} WHERE lno = 2 AND okey % 3 <> 0""",
)
def _(spark, d):
    q = fx(spark, d).select(F.col("rid").alias("fingerprint"), "status", "lno", "okey")
    over = q.where("lno = 2").select(
        "fingerprint",
        F.when(F.col("okey") % 3 == 0, " ").otherwise("ann").alias("actor"),
        F.lit("agreed").alias("reason"),
    )
    marked, audit = fin.override_audit(q, over)
    return n_by(marked, "status").unionAll(
        audit.agg(F.count(F.lit(1)).alias("n")).select(F.lit("audit rows").alias("status"), "n")
    )


_KEY = "path || '::' || sha256(message) || '::' || line || ':' || col"


def _keyed(f):
    return f.withColumn(
        "key", fin.diff_key(F.col("path"), F.col("message"), F.col("line"), F.col("col"))
    )


def _diff_sql(where: str = "") -> str:
    return f"""SELECT u.c AS change, sum(u.n)::BIGINT AS n, count(*) AS keys FROM (SELECT unnest([
 {{'c': 'UNCHANGED', 'n': least(b, f)}}, {{'c': 'NEW', 'n': f - least(b, f)}},
 {{'c': 'FIXED', 'n': b - least(b, f)}}]) AS u FROM (
 SELECT {_KEY} AS key, count(*) FILTER (okey % 3 <> 0) AS b, count(*) FILTER (okey % 3 <> 1) AS f
 FROM (SELECT * REPLACE (okey % 4 AS okey, 1 AS line, 1 AS col) FROM {FX} {where}) GROUP BY 1))
 WHERE u.n > 0 GROUP BY u.c"""


def _diff_sides(spark, d):
    f = _keyed(fx(spark, d).withColumns({"line": F.lit(1), "col": F.lit(1), "okey": F.col("okey") % 4}))
    return f.where("okey % 3 <> 0"), f.where("okey % 3 <> 1")


def _by_change(df):
    return df.groupBy("change").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"))


@query("finding_diff", _diff_sql())
def _(spark, d):
    return _by_change(fin.finding_diff(*_diff_sides(spark, d)))


@query("diff_scoped", _diff_sql("WHERE partkey % 3 = 1"))
def _(spark, d):
    b, f = _diff_sides(spark, d)
    changed = fx(spark, d).where("partkey % 3 = 1").select("path")
    return _by_change(fin.diff_scoped(b, f, changed))


@query(
    "save_baseline",
    f"SELECT count(*) AS n, count(DISTINCT path) AS files FROM (SELECT okey % 4 AS k, path, partkey "
    f"FROM {FX}) WHERE CASE WHEN partkey % 3 = 1 THEN k % 3 <> 1 ELSE k % 3 <> 0 END",
)
def _(spark, d):
    b, f = _diff_sides(spark, d)
    changed = fx(spark, d).where("partkey % 3 = 1").select("path")
    s = fin.save_baseline(b, f, changed)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files"))


def _verify_sql(keys: str, anchor: str, seen: str = "TRUE", missing: str = "stale_evidence") -> str:
    return f"""WITH o AS (SELECT * FROM {FX} WHERE okey % 2 = 0), w AS (SELECT * FROM {FX}
 WHERE okey % 3 <> 0), e AS (SELECT DISTINCT {keys}, {anchor} FROM w), n AS (SELECT DISTINCT {keys}
 FROM w) SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN NOT ({seen}) THEN '{missing}'
 WHEN ({keys}, {anchor}) IN (SELECT ({keys}, {anchor}) FROM e) THEN 'reproduced'
 WHEN ({keys}) IN (SELECT ({keys}) FROM n) THEN 'stale_anchor' ELSE 'absent' END AS outcome FROM o)
 GROUP BY outcome"""


def _verify(spark, d, keys, anchor, captured=None, ck=None):
    f = fx(spark, d)
    out = fin.verify(f.where("okey % 2 = 0"), f.where("okey % 3 <> 0"), keys, anchor, captured, ck)
    return n_by(out, "outcome")


@query("verify_static", _verify_sql("path, detector_id", "line"))
def _(spark, d):
    return _verify(spark, d, ["path", "detector_id"], "line")


@query("verify_runtime", _verify_sql("site, detector_id", "col", "site % 4 <> 1"))
def _(spark, d):
    cap = fx(spark, d).where("site % 4 <> 1").select("site")
    return _verify(spark, d, ["site", "detector_id"], "col", cap, ["site"])


@query("verify_contract", _verify_sql("partkey, detector_id", "lno"))
def _(spark, d):
    return _verify(spark, d, ["partkey", "detector_id"], "lno")


@query("verify_mechanical", _verify_sql("path, message", "line", "partkey % 5 <> 2"))
def _(spark, d):
    ran = fx(spark, d).where("partkey % 5 <> 2").select("path")
    return _verify(spark, d, ["path", "message"], "line", ran, ["path"])


@query(
    "evidence_hashes",
    f"""WITH m AS (SELECT DISTINCT provenance, path FROM {FX}),
 h AS (SELECT provenance, sha256(path) AS h FROM m)
 SELECT provenance, count(*) AS members, sha256(count(*) || ':' || """
    + " || ':' || ".join(
        f"bit_xor(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)" for i in range(4)
    )
    + ") AS digest FROM h GROUP BY provenance",
)
def _(spark, d):
    m = fx(spark, d).select("provenance", "path").distinct()
    return fin.evidence_digest(m, ["provenance"], F.col("path"))


@query(
    "capture_matrix_digest",
    """SELECT page_id, sha256(to_json(list_sort(list_distinct(list_transform(list_filter(
 regexp_extract_all(html, 'href="/([^"]*)"', 1), lambda r: trim(r, ' ') <> ''), lambda r:
 {'route': trim(r, ' '), 'state': 'default', 'viewport': CASE WHEN length(r) % 2 = 0 THEN 'desktop'
 ELSE 'mobile' END})))) ) AS digest FROM pages""",
)
def _(spark, d):
    p = table(spark, d, "pages")
    caps = F.transform(
        F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)),
        lambda r: F.struct(
            r.alias("route"),
            F.lit("default").alias("state"),
            F.when(F.length(r) % 2 == 0, "desktop").otherwise("mobile").alias("viewport"),
        ),
    )
    return p.select("page_id", fin.capture_matrix_digest(caps).alias("digest"))


@query(
    "manual_id",
    """SELECT doc_id, 'manual-' || left(sha256(source || chr(0) || trim(regexp_replace(text,
 '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') || chr(0) || lang), 16) AS id FROM documents""",
)
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", fin.manual_id(F.col("source"), F.col("text"), F.col("lang")).alias("id")
    )


@query(
    "set_account",
    """WITH e AS (SELECT event_id % 3000 AS id, event_id AS pos FROM events WHERE event_type <> 'error'),
 a AS (SELECT event_id % 3000 AS id, event_id + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS pos
  FROM events WHERE event_type <> 'click'),
 ee AS (SELECT id, count(*) AS ne, min(pos) AS pe FROM e GROUP BY id),
 aa AS (SELECT id, count(*) AS na, min(pos) AS pa FROM a GROUP BY id)
 SELECT account, count(*) AS n FROM (SELECT CASE WHEN na IS NULL THEN 'missing' WHEN ne IS NULL THEN
 'extra' WHEN na > 1 THEN 'duplicate' WHEN pe <> pa THEN 'reordered' ELSE 'verified' END AS account
 FROM ee FULL JOIN aa USING (id)) GROUP BY account""",
)
def _(spark, d):
    e = table(spark, d, "events")
    k = (F.col("event_id") % 3000).alias("id")
    exp = e.where("event_type <> 'error'").select(k, F.col("event_id").alias("pos"))
    act = e.where("event_type <> 'click'").select(
        k, (F.col("event_id") + F.when(F.col("user_id") % 5 == 0, 1).otherwise(0)).alias("pos")
    )
    return n_by(fin.set_account(exp, act), "account")


@query(
    "set_algebra",
    f"""SELECT 'union' AS op, count(*) AS n FROM (SELECT path FROM {FX} WHERE lno = 1 UNION SELECT path
 FROM {FX} WHERE lno = 2) UNION ALL SELECT 'intersect', count(*) FROM (SELECT path FROM {FX} WHERE
 lno = 1 INTERSECT SELECT path FROM {FX} WHERE lno = 2) UNION ALL SELECT 'except', count(*) FROM
 (SELECT path FROM {FX} WHERE lno = 1 EXCEPT SELECT path FROM {FX} WHERE lno = 2)""",
)
def _(spark, d):
    f = fx(spark, d)
    a, b = f.where("lno = 1").select("path"), f.where("lno = 2").select("path")
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for name, df in ops.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionAll(one)
    return out


# ---- aggregates ------------------------------------------------------------------------


@query("blended_score", _BLEND)
def _(spark, d):
    return _blend(spark, d).select("site", "slop", "objective", "critical_pending", "blended")


@query(
    "review_score",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND a <= 40 AND b <= 30 AND c <= 20 AND d <= 10
 AND o_orderkey % 5 <> 0 THEN CAST(a + b + c + d AS INT) END AS score FROM (SELECT o_orderkey,
 o_orderkey % 45 AS a, o_orderkey % 32 AS b, o_orderkey % 22 AS c, o_orderkey % 11 AS d FROM orders)""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    a, b, c, e = [(k % m).cast("double") for m in (45, 32, 22, 11)]
    dims = F.map_filter(
        F.create_map(F.lit("A"), a, F.lit("B"), b, F.lit("C"), c, F.lit("D"), e),
        lambda key, _: ~((k % 7 == 0) & (key == "D")),
    )
    declared = a + b + c + e + F.when(k % 5 == 0, 1.0).otherwise(0.0)
    return table(spark, d, "orders").select(
        "o_orderkey", scoring.review_score(dims, declared).alias("score")
    )


@query(
    "eligibility",
    f"""WITH s AS ({_BLEND}), p AS (SELECT site, count(*) FILTER (WHERE {LIVE}) AS pending FROM
  (SELECT * REPLACE (okey AS site) FROM {FX}) GROUP BY site), x AS (SELECT s.*, pending FROM s JOIN p USING (site))
 SELECT site, blocker FROM (SELECT site, unnest([CASE WHEN pending > 0 THEN 'pending_findings' END,
 CASE WHEN blended < 70 THEN 'target_score' END,
 CASE WHEN 0.5 + site % 3 * 0.25 < 1 THEN 'incomplete_qualification' END,
 CASE WHEN site % 5 = 0 THEN 'stale_evidence' END,
 CASE WHEN site % 4 = 0 THEN 'missing_structured_review' END,
 CASE WHEN site % 4 <> 0 AND site % 4 = 1 THEN 'stale_review' END]) AS blocker FROM x)
 WHERE blocker IS NOT NULL""",
)
def _(spark, d):
    k = F.col("site")
    return scoring.eligibility(
        _blend(spark, d), ["site"], 70, k % 5 != 0, k % 4 != 0, k % 4 != 1
    )


@query(
    "status_summary",
    f"""SELECT count(*) FILTER ({LIVE}) AS actionable, count(*) FILTER (NOT ({LIVE}) AND
 status <> 'verified_resolved') AS investigative, count(*) FILTER (status = 'verified_resolved')
 AS resolved, count(*) AS found FROM {FX}""",
)
def _(spark, d):
    return scoring.status_summary(fx(spark, d))


_COMP = "string_split(path, '/')[1] || '/' || string_split(path, '/')[2] || '/' || string_split(path, '/')[3]"


@query(
    "attack_plan",
    f"""WITH l AS (SELECT *, {_COMP} AS component FROM {FX} WHERE {LIVE}),
 c AS (SELECT component, category, count(*) AS n FROM l GROUP BY ALL),
 t AS (SELECT component, string_agg(category, ',' ORDER BY n DESC, category) AS top_categories FROM
  (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, category) <= 3)
  GROUP BY component)
 SELECT component, count(*) AS issues, CAST(sum(CASE tier WHEN 'T1' THEN 1 WHEN 'T2' THEN 3
 WHEN 'T3' THEN 5 ELSE 10 END) AS BIGINT) AS impact, CAST(sum(CASE tier WHEN 'T1' THEN 2 WHEN 'T2'
 THEN 8 WHEN 'T3' THEN 20 ELSE 45 END) AS BIGINT) AS effort, count(DISTINCT path) AS files,
 any_value(top_categories) AS top_categories FROM l JOIN t USING (component) GROUP BY component
 ORDER BY impact DESC, effort, component LIMIT 25""",
)
def _(spark, d):
    return scoring.ranked_plan(scoring.attack_plan(fx(spark, d)), 25)


@query(
    "scan_summary",
    f"""SELECT category, {", ".join(f"count(*) FILTER (tier = 'T{i}') AS T{i}" for i in (1, 2, 3, 4))}
 FROM {FX} GROUP BY category""",
)
def _(spark, d):
    return scoring.scan_summary(fx(spark, d))


@query(
    "top_files",
    f"SELECT path, count(*) AS issues FROM {FX} GROUP BY path ORDER BY issues DESC, path LIMIT 10",
)
def _(spark, d):
    return scoring.top_files(fx(spark, d), 10)


@query(
    "category_coverage",
    f"""SELECT c.category, coalesce(n, 0) AS rules, CASE WHEN n IS NULL THEN 'clean' ELSE 'issues' END
 AS verdict FROM (SELECT DISTINCT 'area ' || n_regionkey AS category FROM nation UNION ALL
 SELECT DISTINCT category FROM {FX}) c LEFT JOIN (SELECT category, count(DISTINCT detector_id) AS n
 FROM {FX} GROUP BY category) f USING (category)""",
)
def _(spark, d):
    f = fx(spark, d)
    cats = (
        table(spark, d, "nation")
        .select(F.concat(F.lit("area "), "n_regionkey").alias("category"))
        .distinct()
        .unionAll(f.select("category").distinct())
    )
    return scoring.category_coverage(f, cats)


@query(
    "tree_rollup",
    f"""SELECT array_to_string(p[1:k], '/') AS prefix, CAST(k AS INT) AS depth, CASE WHEN k = len(p)
 THEN 'file' ELSE 'dir' END AS kind, count(*) AS issues FROM (SELECT p, unnest(range(1, len(p) + 1))
 AS k FROM (SELECT string_split(path, '/') AS p FROM {FX})) GROUP BY ALL""",
)
def _(spark, d):
    return scoring.tree_rollup(fx(spark, d))


@query(
    "queue_by_file",
    f"""SELECT path, count(*) AS issues, {", ".join(f"count(*) FILTER (tier = 'T{i}') AS T{i}" for i
 in (1, 2, 3, 4))} FROM {FX} GROUP BY path""",
)
def _(spark, d):
    return scoring.queue_by_file(fx(spark, d))


_DIR = "regexp_replace(path, '/[^/]*$', '')"


@query(
    "select_batch",
    f"""SELECT rid, tier, path FROM {FX} WHERE {_DIR} = (SELECT {_DIR} FROM {FX} ORDER BY tier, rid
 LIMIT 1) ORDER BY tier, rid LIMIT 15""",
)
def _(spark, d):
    return scoring.select_batch(fx(spark, d), "rid").select("rid", "tier", "path")


@query(
    "shard_assign",
    f"""SELECT path, tier, issues, CAST((row_number() OVER (ORDER BY tier, path) - 1) % 4 AS INT)
 AS shard FROM (SELECT path, min(tier) AS tier, count(*) AS issues FROM {FX} WHERE {LIVE} GROUP BY
 path ORDER BY tier, path LIMIT 12)""",
)
def _(spark, d):
    return scoring.shard_assign(fx(spark, d), 4)


@query(
    "capped_log",
    """SELECT event_type AS kind, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY
 event_type ORDER BY event_id DESC) <= 50""",
)
def _(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_type").alias("kind"), F.col("event_id").alias("seq")
    )
    return scoring.capped_log(e, 50)


@query(
    "latest_event",
    """SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id
 ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return scoring.latest_event(e, ["user_id"], F.struct("ts", "event_id")).drop("ts")


@query(
    "run_progress",
    """SELECT user_id, event_id, score, lag(score) OVER w AS previous, CASE WHEN lag(score) OVER w IS
 NULL THEN 'start' WHEN score > lag(score) OVER w THEN 'up' WHEN score < lag(score) OVER w THEN 'down'
 ELSE 'flat' END AS trend, score - first_value(score) OVER w AS delta FROM (SELECT user_id, event_id,
 ts, CAST(floor(value) AS BIGINT) % 100 AS score FROM events)
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(spark, d):
    e = table(spark, d, "events").select(
        "user_id", "event_id", "ts", (F.floor("value") % 100).alias("score")
    )
    return scoring.run_progress(e, ["user_id"], ["ts", "event_id"]).drop("ts")


# ---- calibration and benchmarks --------------------------------------------------------

_STATUS = (
    "CASE WHEN doc_id % 11 = 0 THEN 'degraded' WHEN doc_id % 13 = 0 THEN 'unsupported' "
    "WHEN quality = 1 THEN 'positive' ELSE 'negative' END"
)


@query(
    "calibration_report",
    f"""SELECT capability, framework, count(*) FILTER (status = 'positive' AND fired) AS tp,
 count(*) FILTER (status = 'negative' AND fired) AS fp,
 count(*) FILTER (status = 'positive' AND NOT fired) AS fn,
 count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'unsupported')
 AS unsupported FROM (SELECT lang AS capability, source AS framework, {_STATUS} AS status,
 len(regexp_extract_all(text, '[.]')) > 20 AS fired FROM labels JOIN documents USING (doc_id))
 GROUP BY ALL""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    cases = table(spark, d, "labels").join(docs.select("doc_id", "lang", "source"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("capability"),
        F.col("source").alias("framework"),
        F.expr(_STATUS).alias("status"),
    )
    hits = (F.regexp_count("text", F.lit("[.]")) > 20).cast("int").alias("hits")
    return calibration.calibration_report(cases, docs.select(F.col("doc_id").alias("id"), hits))


@query(
    "calibration_budgets",
    f"""SELECT capability, framework, tp >= 1 AND fp <= 2 AND fn <= 3 AS within FROM (SELECT lang AS
 capability, source AS framework, count(*) FILTER (st = 'positive' AND fired) AS tp, count(*) FILTER
 (st = 'negative' AND fired) AS fp, count(*) FILTER (st = 'positive' AND NOT fired) AS fn FROM
 (SELECT lang, source, {_STATUS} AS st, len(regexp_extract_all(text, '[.]')) > 20 AS fired FROM labels
 JOIN documents USING (doc_id)) GROUP BY ALL)""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    cases = table(spark, d, "labels").join(docs.select("doc_id", "lang", "source"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("capability"),
        F.col("source").alias("framework"), F.expr(_STATUS).alias("status"),
    )
    hits = (F.regexp_count("text", F.lit("[.]")) > 20).cast("int").alias("hits")
    rep = calibration.calibration_report(cases, docs.select(F.col("doc_id").alias("id"), hits))
    budgets = docs.select(
        F.col("lang").alias("capability"), F.lit(1).alias("tp_min"), F.lit(2).alias("fp_max"),
        F.lit(3).alias("fn_max"),
    ).distinct()
    return calibration.calibration_budgets(rep, budgets)


@query(
    "bench_distribution",
    """SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, round(stddev_pop(value),
 6) AS sigma, median(value) AS median, quantile_disc(value, 0.9) AS p90, round(quantile_disc(value,
 0.75) - quantile_disc(value, 0.25), 6) AS iqr FROM events GROUP BY event_type""",
)
def _(spark, d):
    out = calibration.bench_distribution(table(spark, d, "events"), ["event_type"], "value")
    return out.withColumns({"sigma": F.round("sigma", 6), "iqr": F.round("iqr", 6)})


@query(
    "bench_gate",
    """SELECT fixture, base, current, round((current - base) / base * 100, 6) AS delta_pct,
 (current - base) / base * 100 <= 10 AS passed FROM (SELECT l_returnflag || l_suppkey AS fixture,
 median(l_quantity) FILTER (l_linestatus = 'O') AS base, median(l_quantity) FILTER
 (l_linestatus <> 'O') AS current FROM lineitem GROUP BY 1)""",
)
def _(spark, d):
    s = table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_suppkey").alias("fixture"),
        F.when(F.col("l_linestatus") == "O", "base").otherwise("current").alias("version"),
        "l_quantity",
    )
    g = calibration.bench_gate(s, "fixture", "l_quantity")
    return g.withColumn("delta_pct", F.round("delta_pct", 6))


@query(
    "interp_percentile",
    """SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem
 GROUP BY l_suppkey""",
)
def _(spark, d):
    out = calibration.interp_percentile(
        table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.9, "p90"
    )
    return out.withColumn("p90", F.round("p90", 4))
