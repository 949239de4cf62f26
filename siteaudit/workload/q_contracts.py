"""Contract reconciliation queries: front-end calls from orders, back-end from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteaudit.operators import contracts as ct
from siteaudit.plans.session import cut
from siteaudit.workload.derive import duck, table, view
from siteaudit.workload.registry import query

S = "CAST({} AS VARCHAR(20))".format

_ROUTES = f"""
SELECT o_orderkey AS k, CASE o_orderkey % 11 WHEN 0 THEN '/u/' || {S('o_custkey')} || '/:id'
 WHEN 1 THEN 'u/{{id}}/x' WHEN 2 THEN '/u/[id]' WHEN 3 THEN '/u//$id/' WHEN 4 THEN '/u/<int:id>?q=1'
 WHEN 5 THEN '/u/$' || '{{user.id}}' WHEN 6 THEN 'https://h.example/u/{{id}}#t' WHEN 7 THEN ''
 WHEN 8 THEN '/u/v-$' || '{{a.b}}-w' WHEN 9 THEN '/u/*' ELSE NULL END AS route FROM {{orders}}
"""


@query(
    "route_normalize",
    f"""SELECT k, CASE k % 11 WHEN 0 THEN '/u/' || c || '/{{}}' WHEN 1 THEN '/u/{{}}/x' WHEN 7 THEN '/'
 WHEN 8 THEN '/u/v-{{}}-w' WHEN 9 THEN '/u/*' WHEN 10 THEN NULL ELSE '/u/{{}}' END AS npath,
 CASE WHEN k % 11 = 5 THEN 'user.id' WHEN k % 11 = 8 THEN 'a.b' WHEN k % 11 IN (7, 9, 10) THEN ''
 ELSE 'id' END AS params, k % 11 IN (9, 10) AS unresolved FROM (SELECT o_orderkey AS k, o_custkey AS c
 FROM orders)""",
)
def _(spark, d):
    r = view(spark, d, _ROUTES).withColumn("r", ct.route_normalize(F.col("route")))
    return r.select(
        "k",
        F.col("r.path").alias("npath"),
        F.array_join("r.params", ",").alias("params"),
        F.col("r.unresolved").alias("unresolved"),
    )


_METHOD = "CASE {} % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END".format
# One row per operation; ``k`` drives everything else.
_OPS = f"""
SELECT 'f' || {S('o_orderkey')} AS op_id, 'frontend' AS side, o_orderkey AS k,
 '/api/r' || {S('o_custkey % 300')} || '/{{}}' AS npath, {_METHOD('o_orderkey')} AS method,
 o_orderkey % 23 = 0 AS dynamic, 1E0 AS confidence, 'public' AS classification,
 o_orderkey % 3 <> 0 AS mutation FROM {{orders}}
UNION ALL SELECT 'b' || {S('c_custkey')}, 'backend', c_custkey,
 '/api/r' || {S('c_custkey % 350')} || '/{{}}', {_METHOD('c_custkey')}, c_custkey % 29 = 0,
 0.5E0 + (c_custkey % 4) / 8E0, CASE WHEN c_custkey % 5 = 0 THEN 'internal' ELSE 'public' END,
 c_custkey % 3 <> 0 FROM {{customer}}
"""
OX = duck(_OPS)
FRONT = f"(SELECT * FROM {OX} WHERE side = 'frontend' AND NOT dynamic)"
BACK = f"(SELECT * FROM {OX} WHERE side = 'backend' AND NOT dynamic)"


def ops(spark, d):
    return view(spark, d, _OPS)


def sides(spark, d):
    o = ct.comparable(ops(spark, d))
    return o.where("side = 'frontend'"), o.where("side = 'backend'")


_PARAMS = f"""
SELECT op_id, 'path' AS location, CASE WHEN side = 'frontend' AND k % 2 = 0 THEN 'key' ELSE 'id' END AS
 name, TRUE AS required, 'simple' AS serial FROM ({_OPS}) o WHERE k % 7 <> 0
UNION ALL SELECT op_id, 'query', 'q' || {S('k % 3')}, k % 2 = 0, CASE WHEN k % 4 = 0 THEN 'form' ELSE
 'deep' END FROM ({_OPS}) o WHERE k % 5 < 3
"""
_MEDIA = f"""
SELECT op_id, 'request' AS side, '' AS status, CASE WHEN k % 6 = 0 THEN 'text/xml' ELSE
 'application/json' END AS media FROM ({_OPS}) o WHERE k % 3 <> 0
UNION ALL SELECT op_id, 'response', {S('200 + k % 2')}, 'application/json' FROM ({_OPS}) o
"""
_FIELDS = f"""
SELECT op_id, 'response' AS relation, '200' AS status, '' AS field_path, 'object' AS type, FALSE AS
 nullable, '' AS enum, '' AS constraints, FALSE AS required, FALSE AS incomplete, k FROM ({_OPS}) o
UNION ALL SELECT op_id, 'response', '200', 'email', CASE WHEN k % 9 = 0 THEN 'number' ELSE 'string' END,
 k % 8 = 0, CASE WHEN k % 10 = 0 THEN 'a|b' ELSE '' END, CASE WHEN k % 11 = 0 THEN 'max:5' ELSE '' END,
 k % 4 = 0, k % 31 = 0, k FROM ({_OPS}) o
UNION ALL SELECT op_id, 'response', '200', 'tags', 'array', FALSE, '', '', FALSE, FALSE, k FROM ({_OPS}) o
 WHERE k % 6 <> 0
UNION ALL SELECT op_id, 'response', '200', 'tags[]', CASE WHEN k % 5 = 0 THEN 'integer' ELSE 'string' END,
 FALSE, '', '', FALSE, FALSE, k FROM ({_OPS}) o WHERE k % 6 <> 0
"""


@query(
    "observation_dedup",
    f"""SELECT side, count(*) AS n FROM (SELECT DISTINCT side, npath, method, confidence, classification
 FROM {OX}) GROUP BY side""",
)
def _(spark, d):
    o = ops(spark, d).select("side", "npath", "method", "confidence", "classification")
    return ct.observation_dedup(o).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query(
    "frontend_observations",
    """SELECT count(*) AS n, count(DISTINCT o_custkey) AS files FROM orders WHERE (o_custkey, o_orderkey %
 20) NOT IN (SELECT (c_custkey, c_custkey % 20) FROM customer WHERE c_custkey % 2 = 0)""",
)
def _(spark, d):
    nodes = table(spark, d, "orders").select(
        F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 20).alias("line")
    )
    sites = table(spark, d, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("file"), (F.col("c_custkey") % 20).alias("line")
    )
    out = ct.frontend_observations(nodes, sites)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


@query(
    "contract_nodes_edges",
    f"""SELECT kind, relation, count(*) AS n FROM (SELECT 'operation' AS kind, 'self' AS relation FROM {OX}
 UNION ALL SELECT unnest(['auth', 'authorization', 'tenant']), 'requires' FROM {OX}
 UNION ALL SELECT 'ui_state', 'renders_state' FROM {OX} WHERE k % 2 = 0
 UNION ALL SELECT 'api_parameter', 'declares_parameter' FROM {duck(_PARAMS)}
 UNION ALL SELECT side || '_media_type', CASE side WHEN 'request' THEN 'accepts_media_type' ELSE
  'returns_media_type' END FROM {duck(_MEDIA)}
 UNION ALL SELECT 'schema_field', relation FROM {duck(_FIELDS)}) GROUP BY ALL""",
)
def _(spark, d):
    o = ops(spark, d).withColumns(
        {
            "auth": F.lit("present"),
            "authorization": F.lit("absent"),
            "tenant": F.lit("unknown"),
            "ui_states": F.expr("CASE WHEN k % 2 = 0 THEN array('loading') ELSE array() END").cast(
                "array<string>"
            ),
        }
    )
    none = o.where("FALSE").select("op_id", F.lit("").alias("name"))
    n = ct.contract_nodes(
        o, view(spark, d, _PARAMS), view(spark, d, _MEDIA), view(spark, d, _FIELDS), none
    )
    return n.groupBy("kind", "relation").agg(F.count(F.lit(1)).alias("n"))


@query("evidence_unknown", f"SELECT op_id FROM {OX} WHERE dynamic")
def _(spark, d):
    return ct.evidence_unknown(ops(spark, d)).select("op_id")


_PAIRS = f"""SELECT npath, method, coalesce(f, 0) AS front, coalesce(b, 0) AS back FROM (SELECT npath,
 method, count(*) AS f FROM {FRONT} GROUP BY ALL) FULL JOIN (SELECT npath, method, count(*) AS b FROM
 {BACK} GROUP BY ALL) USING (npath, method)"""


@query("contract_pairing", _PAIRS)
def _(spark, d):
    return ct.contract_pairing(*sides(spark, d))


@query(
    "only_side",
    f"""SELECT 'frontend_only' AS kind, npath, op_id FROM {FRONT} WHERE npath NOT IN (SELECT npath FROM
 {BACK}) UNION ALL SELECT 'backend_only', npath, op_id FROM {BACK} WHERE classification <> 'internal' AND
 npath NOT IN (SELECT npath FROM {FRONT}) UNION ALL SELECT 'method_mismatch', npath, '' FROM ({_PAIRS})
 GROUP BY npath HAVING sum(front) > 0 AND sum(back) > 0 AND bool_or((front > 0) <> (back > 0))""",
)
def _(spark, d):
    return ct.only_side(*sides(spark, d))


_REL = f"(SELECT op_id FROM {duck(_PARAMS)} UNION ALL SELECT op_id FROM {duck(_MEDIA)})"
_PICK = f"""SELECT npath, method, op_id AS back_op FROM {BACK} LEFT JOIN (SELECT op_id, count(*) AS r FROM
 {_REL} GROUP BY op_id) USING (op_id) QUALIFY row_number() OVER (PARTITION BY npath, method ORDER BY
 coalesce(r, 0) DESC, confidence DESC, op_id DESC) = 1"""


def _picked(spark, d):
    rel = view(spark, d, _PARAMS).select("op_id").unionAll(view(spark, d, _MEDIA).select("op_id"))
    return ct.candidate_pick(sides(spark, d)[1], rel)


@query("candidate_pick", _PICK)
def _(spark, d):
    return _picked(spark, d)


_CONTRA = f"""WITH b AS (SELECT *, CASE k % 41 WHEN 0 THEN 'present' WHEN 1 THEN 'unknown' WHEN 2 THEN
 'contradictory' ELSE 'absent' END AS auth, CASE WHEN k % 2 = 0 THEN 'unknown' ELSE 'present' END AS
 request FROM {BACK}), p AS (SELECT op_id, string_agg(DISTINCT location || name || serial, ',' ORDER BY
 location || name || serial) AS ps FROM {duck(_PARAMS)} GROUP BY op_id)
 SELECT npath, method, CASE WHEN count(DISTINCT ps) > 1 THEN 'api_parameter' ELSE 'auth' END AS axis FROM
 b LEFT JOIN p USING (op_id) GROUP BY npath, method HAVING count(DISTINCT ps) > 1 OR count(DISTINCT CASE
 WHEN auth <> 'unknown' THEN auth END) > 1 OR bool_or(auth = 'contradictory')"""


def _contra(spark, d):
    b = sides(spark, d)[1].withColumns(
        {
            "auth": F.expr(
                "CASE k % 41 WHEN 0 THEN 'present' WHEN 1 THEN 'unknown' WHEN 2 THEN 'contradictory' "
                "ELSE 'absent' END"
            ),
            "request": F.expr("CASE WHEN k % 2 = 0 THEN 'unknown' ELSE 'present' END"),
        }
    )
    members = view(spark, d, _PARAMS).select(
        "op_id", F.concat("location", "name", "serial").alias("member")
    )
    return ct.group_contradiction(
        b, ["request", "api_parameter", "auth"], {"api_parameter": members}
    )


@query("group_contradiction", _CONTRA)
def _(spark, d):
    return _contra(spark, d)


_PX = f"""(SELECT f.op_id AS front_op, back_op, f.k AS fk, CAST(substr(back_op, 2) AS BIGINT) AS bk, mutation
 FROM {FRONT} f JOIN ({_PICK}) USING (npath, method))"""


def _pairs(spark, d):
    # Several difference tables read the pairs; they are narrow, so they are written once.
    front = sides(spark, d)[0]
    return cut(ct.operation_pairs(front, _picked(spark, d), front.where("FALSE")))


_TRANSPORT = f"""WITH p AS (SELECT front_op, back_op FROM {_PX}),
 f AS (SELECT p.*, location, name, serial FROM p JOIN {duck(_PARAMS)} x ON x.op_id = front_op),
 b AS (SELECT p.*, location, name, serial, required FROM p JOIN {duck(_PARAMS)} x ON x.op_id = back_op),
 r AS (SELECT front_op, back_op, any_value(b.name) AS tn FROM f JOIN b USING (front_op, back_op) WHERE
  f.location = 'path' AND b.location = 'path' AND f.name <> b.name GROUP BY ALL),
 f2 AS (SELECT f.front_op, f.back_op, location, CASE WHEN location = 'path' AND tn IS NOT NULL THEN tn ELSE
  name END AS name, serial AS fs FROM f LEFT JOIN r USING (front_op, back_op)),
 j AS (SELECT *, f2.fs IS NOT NULL AS inf, b.serial IS NOT NULL AS inb, (front_op IN (SELECT front_op FROM
  f)) AS af FROM f2 FULL JOIN b USING (front_op, back_op, location, name)),
 k AS (SELECT front_op, back_op, location || ':' || name AS field, 0 AS o, CASE WHEN NOT af THEN CASE WHEN
  required THEN 'required_parameter_evidence_unknown' END WHEN NOT inb THEN 'parameter_not_supported' WHEN
  NOT inf THEN CASE WHEN required THEN 'required_parameter_missing' END WHEN fs <> serial THEN
  'parameter_serialization_mismatch' END AS kind FROM j),
 m AS (SELECT front_op, back_op, CASE WHEN x.side = 'request' THEN '' ELSE x.status END AS field,
  CASE WHEN x.side = 'request' THEN 1 ELSE 2 END AS o, x.side || '_media_type_mismatch' AS kind FROM p JOIN
  {duck(_MEDIA)} x ON x.op_id = front_op WHERE NOT EXISTS (SELECT 1 FROM {duck(_MEDIA)} y WHERE y.op_id =
  back_op AND y.side = x.side AND y.media = x.media AND (x.side = 'request' OR y.status = x.status))),
 u AS (SELECT * FROM k WHERE kind IS NOT NULL UNION ALL SELECT * FROM m)
 SELECT front_op, back_op, kind, field FROM u QUALIFY row_number() OVER (PARTITION BY front_op, back_op
 ORDER BY o, field) = 1"""


@query("transport_diff", _TRANSPORT)
def _(spark, d):
    return ct.transport_diff(_pairs(spark, d), view(spark, d, _PARAMS), view(spark, d, _MEDIA))


_SCHEMA = f"""SELECT front_op, back_op, 'response_' || u.k AS kind, u.f AS field FROM (SELECT front_op,
 back_op, list_filter([
 CASE WHEN (fk % 4 = 0) <> (bk % 4 = 0) THEN {{'k': 'field_required_mismatch', 'f': 'email'}} END,
 CASE WHEN (fk % 6 = 0) <> (bk % 6 = 0) THEN {{'k': 'field_missing', 'f': 'tags'}} END,
 CASE WHEN fk % 31 = 0 OR bk % 31 = 0 THEN {{'k': 'schema_evidence_unknown', 'f': 'email'}} END,
 CASE WHEN (fk % 9 = 0) <> (bk % 9 = 0) THEN {{'k': 'field_type_mismatch', 'f': 'email'}} END,
 CASE WHEN (fk % 8 = 0) <> (bk % 8 = 0) THEN {{'k': 'field_nullability_mismatch', 'f': 'email'}} END,
 CASE WHEN (fk % 10 = 0) <> (bk % 10 = 0) THEN {{'k': 'field_enum_mismatch', 'f': 'email'}} END,
 CASE WHEN (fk % 11 = 0) <> (bk % 11 = 0) THEN {{'k': 'field_validation_mismatch', 'f': 'email'}} END,
 CASE WHEN fk % 6 <> 0 AND bk % 6 <> 0 AND (fk % 5 = 0) <> (bk % 5 = 0) THEN
  {{'k': 'field_type_mismatch', 'f': 'tags[]'}} END], lambda v: v IS NOT NULL)[1] AS u FROM {_PX})
 WHERE u IS NOT NULL"""


@query("schema_diff", _SCHEMA)
def _(spark, d):
    return ct.schema_diff(_pairs(spark, d), view(spark, d, _FIELDS), "response")


_UI_CASE = """CASE WHEN k % 17 = 0 THEN 'contradictory' WHEN k % 13 = 0 THEN 'unknown' WHEN k % 7 = 0 THEN
 'absent' ELSE 'present' END"""
_UI_STATES = "list_filter(['loading', 'error', 'success', 'empty'], lambda s: (k + length(s)) % 4 <> 0)"


def _ui_ops(spark, d):
    return ops(spark, d).where("side = 'frontend'").withColumns(
        {
            "ui_evidence": F.expr(_UI_CASE),
            "ui_states": F.expr(
                "filter(array('loading', 'error', 'success', 'empty'), s -> (k + length(s)) % 4 <> 0)"
            ),
            "ui_required": F.expr("k % 5 <> 0"),
            "response_bearing": F.expr("k % 3 <> 1"),
        }
    )


@query(
    "ui_lifecycle",
    f"""SELECT op_id, kind, missing FROM (SELECT op_id, array_to_string(m, ',') AS missing, CASE WHEN ev =
 'contradictory' THEN 'ui_state_evidence_contradictory' WHEN ev = 'unknown' THEN
 'ui_state_evidence_unknown' WHEN k % 3 <> 1 AND (ev = 'absent' OR len(m) > 0) THEN 'ui_state_missing' END
 AS kind FROM (SELECT *, {_UI_CASE} AS ev, list_filter(CASE WHEN mutation THEN ['error', 'loading',
 'success'] ELSE ['empty', 'error', 'loading', 'success'] END, lambda x: NOT list_contains({_UI_STATES},
 x)) AS m FROM {OX} WHERE side = 'frontend' AND k % 5 <> 0)) WHERE kind IS NOT NULL""",
)
def _(spark, d):
    return ct.ui_lifecycle(_ui_ops(spark, d)).select("op_id", "kind", "missing")


# Evidence axes after transport and schemas, in order, and what their test states derive from.
_AXES = {
    "auth": 19,
    "authorization": 23,
    "tenant": 29,
    "error_envelope": 31,
    "status_set": 37,
    "cache_invalidation": 41,
}
_STATE = "CASE {0} % {1} WHEN 0 THEN 'unknown' WHEN 1 THEN 'contradictory' WHEN 2 THEN 'absent' ELSE 'present' END"


def _state_sql(axis: str) -> str:
    f, b = _STATE.format("fk", _AXES[axis]), _STATE.format("bk", _AXES[axis])
    return f"""CASE WHEN {f} = 'contradictory' OR {b} = 'contradictory' THEN '{axis}_evidence_contradictory'
 WHEN {f} = 'unknown' OR {b} = 'unknown' THEN '{axis}_evidence_unknown' WHEN {f} <> {b} THEN
 '{axis}_mismatch' END"""


def _state_diff(p, axes):
    k = lambda c, m: F.expr(_STATE.format(f"CAST(substr({c}, 2) AS BIGINT)", m))
    return ct.evidence_diff(p, {a: (k("front_op", _AXES[a]), k("back_op", _AXES[a])) for a in axes})


def _auth_diff(spark, d):
    return _state_diff(_pairs(spark, d), ["auth"])


@query(
    "evidence_state_diff",
    f"SELECT kind, count(*) AS n FROM (SELECT {_state_sql('auth')} AS kind FROM {_PX}) WHERE kind IS NOT "
    "NULL GROUP BY kind",
)
def _(spark, d):
    return _auth_diff(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "first_difference",
    f"""WITH t AS ({_TRANSPORT}), s AS ({_SCHEMA}), a AS (SELECT front_op, back_op, coalesce({", ".join(map(_state_sql, _AXES))}) AS
 kind FROM {_PX}) SELECT front_op, back_op, coalesce(t.kind, s.kind, a.kind) AS kind, CASE WHEN t.kind IS
 NOT NULL THEN t.field WHEN s.kind IS NOT NULL THEN s.field ELSE '' END AS field FROM a LEFT JOIN t USING
 (front_op, back_op) LEFT JOIN s USING (front_op, back_op) WHERE coalesce(t.kind, s.kind, a.kind) IS NOT
 NULL""",
)
def _(spark, d):
    p = _pairs(spark, d)
    return ct.first_difference(
        p,
        [
            ct.transport_diff(p, view(spark, d, _PARAMS), view(spark, d, _MEDIA)),
            ct.schema_diff(p, view(spark, d, _FIELDS), "response"),
            _state_diff(p, _AXES),
        ],
    )


_OBL_OPS = f"""
SELECT op_id, CASE k % 6 WHEN 0 THEN '200,409' WHEN 1 THEN '200,429' WHEN 2 THEN '422,400' WHEN 3 THEN
 '503,504' ELSE '200' END AS st, CASE k % 4 WHEN 0 THEN 'Retry-After,X' WHEN 1 THEN 'Idempotency-Key' ELSE
 'X' END AS hd FROM ({_OPS}) o
"""


@query(
    "derive_obligations",
    f"""SELECT op_id, unnest(list_filter([
 CASE WHEN h = 'none' THEN 'concurrency' END, CASE WHEN regexp_matches(st, '409|412') THEN 'conflict' END,
 CASE WHEN contains(hd, 'Idempotency-Key') THEN 'idempotency' END,
 CASE WHEN contains(st, '429') THEN 'rate-limit' END,
 CASE WHEN contains(st, '503') OR contains(hd, 'Retry-After') THEN 'retry' END,
 CASE WHEN regexp_matches(st, '408|504') THEN 'timeout' END,
 CASE WHEN regexp_matches(st, '400|422') THEN 'validation' END], lambda x: x IS NOT NULL)) AS name
 FROM (SELECT *, 'x' AS h FROM {duck(_OBL_OPS)})""",
)
def _(spark, d):
    o = view(spark, d, _OBL_OPS).select(
        "op_id", F.split("st", ",").alias("statuses"), F.split("hd", ",").alias("headers")
    )
    return ct.derive_obligations(o)


_OBL = f"""
SELECT op_id, 'retry' AS name, CASE WHEN k % 7 = 0 THEN 'unknown' ELSE 'present' END AS capability,
 CASE WHEN k % 11 <> 0 THEN k % 5 <> 0 END AS applicable, CASE WHEN k % 3 = 0 THEN 'max:3' ELSE 'max:1' END
 AS attrs, k FROM ({_OPS}) o WHERE k % 4 <> 0
"""


@query(
    "obligation_findings",
    f"""SELECT front_op, back_op, kind, 'retry' AS field FROM (SELECT p.front_op, p.back_op, CASE WHEN b.capability =
 'unknown' OR b.applicable IS NULL THEN 'operation_obligation_evidence_unknown' WHEN b.applicable THEN CASE
 WHEN NOT coalesce(f.capability = 'present' AND f.applicable, FALSE) THEN CASE WHEN f.capability = 'unknown'
 THEN 'operation_obligation_evidence_unknown' ELSE 'operation_obligation_missing' END WHEN f.attrs <>
 b.attrs THEN 'operation_obligation_mismatch' END END AS kind FROM {_PX} p JOIN {duck(_OBL)} b ON b.op_id =
 p.back_op LEFT JOIN {duck(_OBL)} f ON f.op_id = p.front_op) WHERE kind IS NOT NULL""",
)
def _(spark, d):
    return ct.obligation_findings(_pairs(spark, d), view(spark, d, _OBL))


@query(
    "contract_dedup",
    f"""SELECT count(*) FILTER (status <> 'investigate') AS mismatch, count(*) FILTER (status =
 'investigate') AS coverage_gap FROM (SELECT DISTINCT kind, npath, method, CASE WHEN contains(kind,
 'evidence') THEN 'investigate' ELSE 'pending' END AS status FROM (SELECT npath, method,
 {_state_sql('auth')} AS kind FROM (SELECT f.npath, f.method, f.k AS fk, CAST(substr(back_op, 2) AS BIGINT)
 AS bk FROM {FRONT} f JOIN ({_PICK}) USING (npath, method))) WHERE kind IS NOT NULL)""",
)
def _(spark, d):
    f = sides(spark, d)[0].select(F.col("op_id").alias("front_op"), "npath", "method")
    found = _auth_diff(spark, d).join(f, "front_op").withColumn(
        "status", F.when(F.contains("kind", F.lit("evidence")), "investigate").otherwise("pending")
    )
    return ct.contract_counts(ct.contract_dedup(found))
