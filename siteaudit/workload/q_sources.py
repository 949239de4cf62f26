"""Source, sink and fact-extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteaudit.schema import CAPTURE
from siteaudit.operators.contracts import schema_diff
from siteaudit.sources import api_documents as api
from siteaudit.sources import documents as src
from siteaudit.sources import facts
from siteaudit.workload.derive import FILES, FINDINGS, PAGES, duck, lit, table, view
from siteaudit.workload.q_rules import files, pages
from siteaudit.workload.registry import query

S = "CAST({} AS VARCHAR(20))".format


def _n(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


_PATHS = f"""
SELECT CASE l_linenumber WHEN 1 THEN 'src' WHEN 2 THEN 'web/node_modules' WHEN 3 THEN '.cache' WHEN 4 THEN
 'dist' WHEN 5 THEN 'app/old' WHEN 6 THEN 'lib/legacy' ELSE 'pkg' END || '/d' || {S('l_suppkey')} || '/f'
 || {S('l_partkey')} || CASE l_orderkey % 4 WHEN 0 THEN '.tsx' WHEN 1 THEN '.CSS' WHEN 2 THEN '.png' ELSE
 '.html' END AS path FROM {{lineitem}}
"""


@query(
    "source_inventory",
    f"""SELECT path, count(*) AS n FROM {duck(_PATHS)} WHERE regexp_matches(lower(path),
 '\\.(?:tsx|css|html)$') AND NOT regexp_matches(path, '(?:^|/)(?:node_modules|dist|legacy|\\.[^/]*)/') AND
 NOT starts_with(path, 'app/old/') AND path NOT IN (SELECT path FROM {duck(_PATHS)} WHERE contains(path,
 '/d7/')) GROUP BY path""",
)
def _(spark, d):
    p = view(spark, d, _PATHS)
    zones = p.where("path LIKE '%/d7/%'")
    return _n(src.source_inventory(p, ["legacy"], ["app/old"], zones), "path")


_TREE = f"""
SELECT DISTINCT 'w' || {S('l_suppkey % 20')} || '/p' || {S('l_partkey % 7')} || '/s' || {S('l_linenumber')}
 || '/f' || {S('l_orderkey % 50')} || '.ts' AS path FROM {{lineitem}}
"""
_MARKS = f"""
SELECT 'w' || {S('s_suppkey % 20')} AS dir, CASE WHEN s_suppkey % 20 < 6 THEN '.git' ELSE 'README' END AS name
 FROM {{supplier}} UNION ALL SELECT 'w' || {S('s_suppkey % 20')} || '/p' || {S('s_nationkey % 7')},
 CASE WHEN s_nationkey % 2 = 0 THEN 'package.json' ELSE '.git' END FROM {{supplier}}
 UNION ALL SELECT 'w' || {S('s_suppkey % 20')} || '/p' || {S('s_nationkey % 7')} || '/s' ||
 {S('s_suppkey % 8')}, 'go.mod' FROM {{supplier}}
"""


@query(
    "project_root",
    f"""WITH f AS (SELECT path, string_split(path, '/') AS p FROM {duck(_TREE)}), a AS (SELECT path,
 unnest([{{'u': 0, 'd': p[1] || '/' || p[2] || '/' || p[3]}}, {{'u': 1, 'd': p[1] || '/' || p[2]}},
 {{'u': 2, 'd': p[1]}}]) AS x FROM f), m AS (SELECT dir, min(CASE name WHEN '.git' THEN 0 WHEN
 'package.json' THEN 1 WHEN 'go.mod' THEN 1 END) AS g FROM {duck(_MARKS)} GROUP BY dir HAVING g IS NOT NULL),
 b AS (SELECT path, x.d AS dir FROM a JOIN m ON m.dir = a.x.d QUALIFY row_number() OVER (PARTITION BY path
 ORDER BY g, x.u) = 1) SELECT coalesce(b.dir, regexp_replace(f.path, '/[^/]*$', '')) AS root, count(*) AS n
 FROM f LEFT JOIN b USING (path) GROUP BY 1""",
)
def _(spark, d):
    return _n(src.project_root(view(spark, d, _TREE), view(spark, d, _MARKS)), "root")


@query(
    "size_guard",
    f"""SELECT path, octet_length(encode(content)) AS n_bytes FROM (SELECT path, content || CASE WHEN page_id
 % 50 = 0 THEN repeat('x', 1000000) ELSE '' END AS content FROM {duck(PAGES)}) WHERE
 octet_length(encode(content)) <= 1000000""",
)
def _(spark, d):
    from siteaudit.operators.rule_scan import eligible

    p = pages(spark, d).select(
        "path",
        F.when(F.col("page_id") % 50 == 0, F.concat("content", F.expr("repeat('x', 1000000)")))
        .otherwise(F.col("content"))
        .alias("content"),
    )
    return eligible(p).select("path", F.octet_length("content").cast("bigint").alias("n_bytes"))


@query("source_manifest", f"SELECT path, sha256(content) AS sha256 FROM {duck(PAGES)}")
def _(spark, d):
    return src.source_manifest(pages(spark, d))


_CODE = f"""
SELECT CASE c_custkey % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'api/' ELSE 'svc/' END || CASE WHEN c_custkey % 7
 = 0 THEN 'test_' ELSE 'm' END || {S('c_custkey')} || CASE WHEN c_custkey % 2 = 0 THEN '.py' ELSE '.js' END
 AS path, CASE WHEN c_custkey % 2 = 0 THEN 'py' ELSE 'js' END AS ext, c_custkey AS k,
 CASE WHEN c_custkey % 3 = 0 THEN 'print(1)' WHEN c_custkey % 2 = 0 THEN 'router = APIRouter(prefix="/v' ||
 {S('c_nationkey')} || '")' || chr(10) || '@router.get("/items/' || {S('c_custkey')} || '")' || chr(10) ||
 '@app.post("/add")' || chr(10) || 'app.include_router(router, prefix="/api")' ELSE 'router.put("/r' ||
 {S('c_nationkey')} || '", h); app.use("/base", router); axios.get(`/u/$' || '{{id}}`); fetch("/p' ||
 {S('c_custkey')} || '"); ky.post(url)' END AS content FROM {{customer}}
"""


_SERVER_MARKS = """'@controller', '@app.', '@router.', '@bp.', 'fastapi(', 'apirouter(', 'flask(', 'blueprint(', 'express(',
 'fastify', '.route(', 'app.get(', 'app.post(', 'app.put(', 'app.patch(', 'app.delete(', 'router.get(', 'router.post(',
 'router.put(', 'router.patch(', 'router.delete('"""


@query(
    "backend_manifest",
    f"""SELECT path, sha256(content) AS sha256 FROM {duck(_CODE)} WHERE k % 3 <> 0 AND NOT starts_with(path,
 'tests/') AND NOT contains(path, '/test_') AND len(list_filter([{_SERVER_MARKS}],
 lambda m: contains(lower(content), m))) > 0""",
)
def _(spark, d):
    return src.backend_manifest(view(spark, d, _CODE))


@query(
    "route_decl_python_js",
    f"""SELECT path, unnest(CASE WHEN k % 2 = 0 THEN ['GET', 'POST'] ELSE ['PUT'] END) AS method,
 unnest(CASE WHEN k % 2 = 0 THEN ['/api/v' || regexp_extract(content, '/v(\\d+)"', 1) || '/items/' || k,
 '/add'] ELSE ['/base/r' || regexp_extract(content, '/r(\\d+)"', 1)] END) AS route FROM {duck(_CODE)} WHERE k %
 3 <> 0""",
)
def _(spark, d):
    return facts.route_declarations(view(spark, d, _CODE))


@query(
    "script_http_calls",
    f"""SELECT path, unnest(['GET', 'GET', 'POST']) AS method, unnest(['/u/$' || '{{id}}', '/p' || k, '']) AS
 url, unnest([TRUE, FALSE, TRUE]) AS dynamic FROM {duck(_CODE)} WHERE k % 3 <> 0 AND k % 2 = 1""",
)
def _(spark, d):
    c = view(spark, d, _CODE).where("ext = 'js'")
    return facts.script_http_calls(c).select("path", "method", "url", "dynamic")


_TYPES = f"""
SELECT 'm' || {S('o_orderkey')} || '.ts' AS path, 'export interface Order' || {S('o_custkey % 9')} ||
 ' {{ id: number; email?: string; tags: string[]; status: "a" | "b" | null; owner: User }}' ||
 ' fetch("/x" + new URLSearchParams({{ a: "1", b: "' || {S('o_custkey')} || '" }}));' AS content,
 o_custkey AS c FROM {{orders}}
"""


@query(
    "type_contracts",
    f"""SELECT path, 'Order' || c % 9 AS contract, unnest(['id', 'email', 'tags', 'status', 'owner']) AS field,
 unnest(['number', 'string', 'array', 'enum', 'object']) AS type, unnest([FALSE, FALSE, FALSE, TRUE, FALSE])
 AS nullable, unnest([TRUE, FALSE, TRUE, TRUE, TRUE]) AS required FROM {duck(_TYPES)}""",
)
def _(spark, d):
    return facts.type_contracts(view(spark, d, _TYPES))


@query(
    "source_fact_literals",
    f"""SELECT path, '/x' AS url, unnest(['a', 'b']) AS key, unnest(['1', CAST(c AS VARCHAR)]) AS value FROM
 {duck(_TYPES)}""",
)
def _(spark, d):
    return facts.literal_query_params(view(spark, d, _TYPES))


@query(
    "css_tokens",
    f"""SELECT path, unnest(['--brand', '--gap']) AS token, unnest(['#3366ff', '8px']) AS value FROM
 {duck(FILES)} WHERE ext = 'css' AND contains(content, '--brand')""",
)
def _(spark, d):
    return facts.css_tokens(files(spark, d).where("ext = 'css'")).select("path", "token", "value")


@query(
    "responsive_boundaries",
    f"""SELECT width, kinds, count(DISTINCT path) AS sources FROM (SELECT path, 768 AS width, 'media' AS kinds
 FROM {duck(FILES)} WHERE contains(content, '(max-width: 768px)') UNION ALL SELECT path, 1024, 'media' FROM
 {duck(FILES)} WHERE contains(content, '(min-width: 1024px)')) GROUP BY ALL""",
)
def _(spark, d):
    return facts.responsive_boundaries(files(spark, d))


_WIDTHS = f"""
SELECT 's' || {S('o_orderkey')} AS path, '@media (min-width: ' || {S('o_custkey * 7 % 2700')} ||
 'px) {{ a {{ b: c }} }} @container (width > ' || {S('240 + o_orderkey % 90')} || 'px) {{}}' AS content,
 o_custkey * 7 % 2700 AS w, 240 + o_orderkey % 90 AS v FROM {{orders}}
"""


@query(
    "viewport_probes",
    f"""WITH h AS (SELECT path, w AS width, 'media' AS kind FROM {duck(_WIDTHS)} UNION ALL SELECT path, v,
 'container' FROM {duck(_WIDTHS)}), g AS (SELECT width, string_agg(DISTINCT kind, '-' ORDER BY kind) AS kinds
 FROM h WHERE width BETWEEN 240 AND 2560 GROUP BY width), s AS (SELECT * FROM g), p AS (SELECT width, kinds, unnest(['below', 'above']) AS relation,
 unnest([width - 1, width + 1]) AS probe FROM s) SELECT * FROM p WHERE probe BETWEEN 240 AND 2560""",
)
def _(spark, d):
    return facts.viewport_probes(facts.responsive_boundaries(view(spark, d, _WIDTHS)))


@query(
    "site_signals",
    f"""SELECT host, {", ".join(f"CAST(sum(len(regexp_extract_all(lower(content), '{s}'))) AS BIGINT) AS {s}" if
 s != 'table' else "CAST(sum(len(regexp_extract_all(lower(content), 'table'))) AS BIGINT) AS \"table\"" for s in
 facts.SIGNALS)}, CAST(sum(len(regexp_extract_all(content, '@media\\b|\\b(?:sm|md|lg|xl|2xl):'))) AS BIGINT) AS
 responsive FROM {duck(PAGES)} GROUP BY host""",
)
def _(spark, d):
    return facts.site_signals(pages(spark, d), ["host"])


# ---- API documents ---------------------------------------------------------------------

_API = f"""
SELECT 'api' || {S('s_suppkey')} || '.json' AS path, s_suppkey AS k, '{{"openapi":"3.0.0",' || CASE WHEN
 s_suppkey % 4 = 0 THEN '"security":[{{"key":[]}}],' ELSE '' END ||
 '"components":{{"parameters":{{"Page":{{"in":"query","name":"page","required":false}}}}}},"paths":{{"/s/{{id}}":'
 || '{{"parameters":[{{"in":"path","name":"id","required":true}},{{"in":"query","name":"q","required":false}}],'
 || '"get":{{"parameters":[{{"in":"query","name":"q","required":true}},{{"$ref":"#/components/parameters/Page"}}],'
 || '"responses":{{"200":{{"content":{{"application/json":{{"schema":{{"type":"object"}}}}}}}},"404":{{}}}}}},'
 || '"post":{{"security":[],"requestBody":{{"content":{{"application/json":{{}},"text/csv":{{}}}}}},'
 || '"responses":{{"201":{{}}}}}}}},"/n' || {S('s_nationkey')} || '":{{"delete":{{"responses":{{"204":{{}}}}}}}}}}}}'
 AS content, s_nationkey AS nk FROM {{supplier}}
"""


@query(
    "openapi_operations",
    f"""SELECT path, unnest(['GET', 'POST', 'DELETE']) AS method, unnest(['/s/{{}}', '/s/{{}}', '/n' || nk]) AS
 npath, unnest(['path:id:true,query:page:false,query:q:true', 'path:id:true,query:q:false', '']) AS params,
 unnest(['', 'application/json,text/csv', '']) AS request_media, unnest(['application/json', '', '']) AS
 response_media, unnest(['200,404', '201', '204']) AS statuses, unnest([CASE WHEN k % 4 = 0 THEN 'present' ELSE
 'absent' END, 'absent', CASE WHEN k % 4 = 0 THEN 'present' ELSE 'absent' END]) AS auth FROM {duck(_API)}""",
)
def _(spark, d):
    o = api.openapi_operations(view(spark, d, _API))
    p = F.array_join(
        F.array_sort(
            F.transform(
                "params", lambda x: F.concat_ws(":", x["in"], x["name"], x["required"].cast("string"))
            )
        ),
        ",",
    )
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return o.select(
        "path", "method", "npath", p.alias("params"), text("request_media").alias("request_media"),
        text("response_media").alias("response_media"), text("statuses").alias("statuses"), "auth",
    )


# Documents of three kinds: OpenAPI 3 with references, allOf and cycles, Swagger 2, and YAML.
_OPEN3 = """{"openapi":"3.1.0","security":[{"key":[]},{}],"paths":{"/u/{id}":{
 "get":{"responses":{"200":{"$ref":"#/components/responses/Ok"},"404":{"content":{"application/problem+json":
  {"schema":{"$ref":"#/components/schemas/Error"}}}}}},
 "put":{"requestBody":{"content":{"text/csv":{},"application/json":{"schema":{"allOf":[
  {"$ref":"#/components/schemas/User"},
  {"type":"object","required":["note"],"properties":{"note":{"type":"string","maxLength":@N},"name":{"type":"integer"}}}
  ]}}}},"responses":{"204":{}}}}},
 "components":{"responses":{"Ok":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/User"}}}}},
 "schemas":{"Error":{"properties":{"detail":{"type":"string","nullable":true}}},
 "Addr/x":{"type":"object","properties":{"zip":{"type":"string","pattern":"^[0-9]+$"}}},
 "User":{"type":"object","required":["id"],"properties":{@P"id":{"type":"integer","format":"int64"},
 "name":{"type":["string","null"]},"role":{"type":"string","enum":["b","a","b"]},
 "tags":{"type":"array","items":{"type":"string","minLength":1}},
 "address":{"$ref":"#/components/schemas/Addr~1x"}}}}}}"""
_SWAGGER2 = """{"swagger":"2.0","consumes":["application/json"],"produces":["text/xml","application/json"],
 "security":[{"key":[]}],"paths":{"/v":{"parameters":[{"in":"query","name":"q","type":"string"}],"post":{
 "parameters":[{"in":"body","name":"b","schema":{"$ref":"#/definitions/P"}},
 {"in":"query","name":"q","required":true,"collectionFormat":"csv"}],
 "responses":{"201":{"schema":{"type":"array","items":{"$ref":"#/definitions/P"}}}}}}},
 "definitions":{"P":{"type":"object","properties":{"n":{"type":"number","minimum":@N}}}}}"""
_YAML = """openapi: 3.0.0
paths:
  /y/{id}:
    get:
      responses:
        200:
          content:
            application/json:
              schema: {type: array, items: {type: integer, maximum: @N, oneOf: [{type: integer}]}}
"""
_PARENT = """"parent":{"$ref":"#/components/schemas/User"},"""
_SPEC = f"""
SELECT 'spec' || {S('s_suppkey')} || CASE WHEN s_suppkey % 3 = 2 THEN '.yaml' ELSE '.json' END AS path,
 s_suppkey AS k, replace(replace(CASE s_suppkey % 3 WHEN 0 THEN {lit(_OPEN3)} WHEN 1 THEN {lit(_SWAGGER2)}
 ELSE {lit(_YAML)} END, '@N', {S('s_suppkey % 50 + 1')}), '@P', CASE WHEN s_suppkey % 5 = 0 THEN
 {lit(_PARENT)} ELSE '' END) AS content FROM {{supplier}}
"""
# kind of document, operation, relation, status, field, type, nullable, enum, constraints, required and
# 1 if a cycle leaves it incomplete, 2 if it stands there only with a cycle.
_USER = """
 ({0}, '', 'object', FALSE, '', '', FALSE, 1), ({0}, 'id', 'integer', FALSE, '', 'format=int64', TRUE, 0),
 ({0}, 'role', 'string', FALSE, 'a|b', '', FALSE, 0), ({0}, 'tags', 'array', FALSE, '', '', FALSE, 0),
 ({0}, 'tags[]', 'string', FALSE, '', 'minLength=1', FALSE, 0), ({0}, 'address', 'object', FALSE, '', '', FALSE, 0),
 ({0}, 'address.zip', 'string', FALSE, '', 'pattern=^[0-9]+$', FALSE, 0),
 ({0}, 'parent', 'recursive', FALSE, '', '', FALSE, 2)""".format
_EXPECTED = f"""(VALUES {_USER("0, 'GET:/u/{id}', 'response', '200'")},
 (0, 'GET:/u/{{id}}', 'response', '200', 'name', 'string', TRUE, '', '', FALSE, 0),
 {_USER("0, 'PUT:/u/{id}', 'request', ''")},
 (0, 'PUT:/u/{{id}}', 'request', '', 'name', 'integer', FALSE, '', '', FALSE, 0),
 (0, 'PUT:/u/{{id}}', 'request', '', 'note', 'string', FALSE, '', 'maxLength=@N', TRUE, 0),
 (0, 'GET:/u/{{id}}', 'error', '404', '', 'object', FALSE, '', '', FALSE, 0),
 (0, 'GET:/u/{{id}}', 'error', '404', 'detail', 'string', TRUE, '', '', FALSE, 0),
 (1, 'POST:/v', 'request', '', '', 'object', FALSE, '', '', FALSE, 0),
 (1, 'POST:/v', 'request', '', 'n', 'number', FALSE, '', 'minimum=@N', FALSE, 0),
 (1, 'POST:/v', 'response', '201', '', 'array', FALSE, '', '', FALSE, 0),
 (1, 'POST:/v', 'response', '201', '[]', 'object', FALSE, '', '', FALSE, 0),
 (1, 'POST:/v', 'response', '201', '[].n', 'number', FALSE, '', 'minimum=@N', FALSE, 0),
 (2, 'GET:/y/{{id}}', 'response', '200', '', 'array', FALSE, '', '', FALSE, 0),
 (2, 'GET:/y/{{id}}', 'response', '200', '[]', 'integer', FALSE, '', 'maximum=@N', FALSE, 0))
 e(doc, op, relation, status, field_path, type, nullable, enum, constraints, required, mark)"""


@query(
    "openapi_schemas",
    f"""SELECT s.path || ':' || op AS op_id, relation, status, field_path, type, nullable, enum,
 replace(constraints, '@N', CAST(k % 50 + 1 AS VARCHAR)) AS constraints, required, mark > 0 AND k % 5 = 0 AS
 incomplete FROM {duck(_SPEC)} s JOIN {_EXPECTED} ON doc = k % 3 WHERE mark < 2 OR k % 5 = 0""",
)
def _(spark, d):
    return api.Contract(view(spark, d, _SPEC)).fields()


@query(
    "openapi_media",
    f"""SELECT s.path || ':' || op AS op_id, side, status, media FROM {duck(_SPEC)} s JOIN (VALUES
 (0, 'GET:/u/{{id}}', 'response', '200', 'application/json'),
 (0, 'GET:/u/{{id}}', 'response', '404', 'application/problem+json'),
 (0, 'PUT:/u/{{id}}', 'request', '', 'application/json'), (0, 'PUT:/u/{{id}}', 'request', '', 'text/csv'),
 (1, 'POST:/v', 'request', '', 'application/json'), (1, 'POST:/v', 'response', '201', 'application/json'),
 (1, 'POST:/v', 'response', '201', 'text/xml'), (2, 'GET:/y/{{id}}', 'response', '200', 'application/json'))
 e(doc, op, side, status, media) ON doc = k % 3""",
)
def _(spark, d):
    return api.Contract(view(spark, d, _SPEC)).media()


# The client's idea of the same responses; it errs in the type of id and may miss the address.
_CLIENT = f"""
SELECT 'client' || {S('s_suppkey')} AS op_id, 'spec' || {S('s_suppkey')} || '.json:GET:/u/' || chr(123) || 'id' ||
 chr(125) AS back_op, s_suppkey AS k FROM {{supplier}} WHERE s_suppkey % 3 = 0
"""
_CLIENT_FIELDS = """('', 'object', FALSE, '', '', FALSE), ('id', 'integer', FALSE, '', 'format=int64', TRUE),
 ('name', 'string', TRUE, '', '', FALSE), ('role', 'string', FALSE, 'a|b', '', FALSE),
 ('tags', 'array', FALSE, '', '', FALSE), ('tags[]', 'string', FALSE, '', 'minLength=1', FALSE),
 ('address', 'object', FALSE, '', '', FALSE), ('address.zip', 'string', FALSE, '', 'pattern=^[0-9]+$', FALSE)"""


@query(
    "openapi_schema_diff",
    f"""SELECT op_id AS front_op, back_op, CASE WHEN k % 5 = 0 THEN 'response_schema_evidence_unknown' WHEN k % 7 = 0
 THEN 'response_field_missing' ELSE 'response_field_type_mismatch' END AS kind, CASE WHEN k % 5 = 0 THEN '' WHEN
 k % 7 = 0 THEN 'address.zip' ELSE 'id' END AS field FROM {duck(_CLIENT)} WHERE k % 5 = 0 OR k % 7 = 0 OR k % 2 = 0""",
)
def _(spark, d):
    client = view(spark, d, _CLIENT)
    fields = spark.sql(
        "SELECT op_id, 'response' AS relation, '200' AS status, field_path, CASE WHEN field_path = 'id' AND k % 2 = 0 "
        "THEN 'string' ELSE type END AS type, nullable, enum, constraints, required, FALSE AS incomplete FROM {client} "
        f"CROSS JOIN (VALUES {_CLIENT_FIELDS}) v(field_path, type, nullable, enum, constraints, required) "
        "WHERE field_path <> 'address.zip' OR k % 7 <> 0",
        client=client,
    )
    pairs = client.select(F.col("op_id").alias("front_op"), "back_op")
    return schema_diff(pairs, api.Contract(view(spark, d, _SPEC)).fields().unionByName(fields), "response")


# ---- tool output -----------------------------------------------------------------------

_LOG = f"""
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'src/a' || {S('o_custkey')} || '.ts(' || {S('o_orderkey % 90 + 1')} ||
 ',7): error TS' || {S('2000 + o_custkey % 50')} || ': Bad ' || o_orderpriority WHEN 1 THEN './b' ||
 {S('o_custkey')} || '.js:' || {S('o_orderkey % 90 + 1')} || ':3: Unused ' || o_orderstatus ELSE 'Found ' ||
 {S('o_orderkey')} || ' problems' END AS line_text, o_orderkey AS k, o_custkey AS c, o_orderpriority AS p,
 o_orderstatus AS s FROM {{orders}}
"""


@query(
    "diagnostics_ingest",
    f"""SELECT path, line_no, col_no, code, message, sha256(code || chr(0) || message) AS signature FROM (
 SELECT 'src/a' || c || '.ts' AS path, k % 90 + 1 AS line_no, 7 AS col_no, 'TS' || (2000 + c % 50) AS code,
 'Bad ' || p AS message FROM {duck(_LOG)} WHERE k % 4 = 0 UNION ALL SELECT './b' || c || '.js', k % 90 + 1, 3,
 'lint', 'Unused ' || s FROM {duck(_LOG)} WHERE k % 4 = 1 UNION ALL SELECT 'j' || s_suppkey || '.ts', s_nationkey,
 0, 'no-x', 'msg ' || s_nationkey FROM supplier)""",
)
def _(spark, d):
    log = view(spark, d, _LOG)
    js = table(spark, d, "supplier").select(
        F.expr(
            "'[{\"filePath\":\"j' || s_suppkey || '.ts\",\"messages\":[{\"line\":' || s_nationkey || "
            "',\"ruleId\":\"no-x\",\"message\":\"msg ' || s_nationkey || '\"},{\"message\":\"\"}]}]'"
        ).alias("doc")
    )
    # Compiler lines also contain ":" but no path:line:col prefix.
    out = (
        src.tsc_diagnostics(log)
        .unionByName(src.lint_text_diagnostics(log))
        .unionByName(src.lint_json_diagnostics(js))
    )
    return out.select(
        "path",
        F.col("line").alias("line_no"),
        F.col("column").alias("col_no"),
        "code",
        "message",
        src.diagnostic_signature(F.col("code"), F.col("message")).alias("signature"),
    )


@query(
    "runtime_capture_load",
    """SELECT 'c' || o_orderkey AS capture_id, unnest([0, 1]) AS pos, unnest(['#a' || o_custkey, '#b']) AS
 selector, unnest([CAST(o_custkey AS DOUBLE), 5.5]) AS x, unnest([NULL, 12.5]) AS layout FROM orders""",
)
def _(spark, d):
    docs = table(spark, d, "orders").select(
        F.expr(
            "'{\"capture_id\":\"c' || o_orderkey || '\",\"elements\":[{\"selector\":\"#a' || o_custkey || "
            "'\",\"bounds\":{\"x\":' || o_custkey || '}},{\"selector\":\"#b\",\"bounds\":{\"x\":5.5},"
            "\"measurements\":{\"layoutDeviation\":12.5,\"hasText\":true}}]}'"
        ).alias("j")
    )
    caps = docs.select(F.from_json("j", CAPTURE).alias("c")).select("c.*")
    e = src.capture_elements(caps)
    return e.select("capture_id", "pos", "selector", "x", F.col("m.layoutDeviation").alias("layout"))


@query(
    "findings_json",
    f"""SELECT '{{"message":"' || message || '","path":"' || path || '","tier":"' || tier || '"}}' AS value FROM
 {duck(FINDINGS)}""",
)
def _(spark, d):
    return src.findings_json(view(spark, d, FINDINGS).select("path", "message", "tier"))


@query(
    "annotations",
    f"""SELECT '::' || CASE WHEN tier IN ('T3', 'T4') THEN 'error' ELSE 'warning' END || ' file=' || path || '::' ||
 message AS value FROM {duck(FINDINGS)}""",
)
def _(spark, d):
    return src.annotations(view(spark, d, FINDINGS))
