"""Graph, ownership, image, redesign and intent queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteaudit.operators import graph as gr
from siteaudit.operators import images as im
from siteaudit.operators import redesign as rd
from siteaudit.plans.fixpoint import topo_levels
from siteaudit.plans.session import spread
from siteaudit.workload.derive import FINDINGS, PAGES, duck, table, view
from siteaudit.workload.q_contracts import _OBL, _PX, _pairs
from siteaudit.workload.q_rules import pages
from siteaudit.workload.registry import query

S = "CAST({} AS VARCHAR(20))".format


def _n(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# ---- routes ----------------------------------------------------------------------------

_RPATHS = f"""
SELECT DISTINCT CASE o_orderkey % 6 WHEN 0 THEN '/u/' || {S('o_custkey % 40')} WHEN 1 THEN '/u/' ||
 {S('o_custkey % 40')} || '/edit' WHEN 2 THEN '/docs' WHEN 3 THEN '/docs/a/' || {S('o_custkey % 30')} WHEN 4 THEN '/'
 ELSE '/shop/' || {S('o_custkey % 25')} || '/x' END AS path FROM {{orders}}
"""
_PATS = f"""
SELECT DISTINCT CASE s_suppkey % 9 WHEN 0 THEN '/u/:id' WHEN 1 THEN '/u/:id/edit' WHEN 2 THEN '/docs/*' WHEN 3 THEN
 '/docs/:page?' WHEN 4 THEN '/u/' || {S('s_suppkey')} WHEN 5 THEN '/*' WHEN 6 THEN '/shop/:id/:tab' WHEN 7 THEN
 '/shop/' || {S('s_suppkey % 25')} || '/:tab' ELSE '/docs/a/:n' END AS pattern FROM {{supplier}}
"""
_RMATCH = f"""
SELECT path, pattern FROM {duck(_RPATHS)} p JOIN {duck(_PATS)} q ON regexp_matches(path, '^' ||
 CASE WHEN pattern = '/*' THEN '/.*' WHEN pattern = '/docs/*' THEN '/docs(?:/.*)?' WHEN pattern = '/docs/:page?'
 THEN '/docs(?:/[^/]+)?' ELSE regexp_replace(pattern, ':[a-z]+', '[^/]+', 'g') END || '$')"""


@query("route_match", _RMATCH)
def _(spark, d):
    return gr.route_match(view(spark, d, _RPATHS), view(spark, d, _PATS))


@query(
    "route_specificity",
    f"""WITH m AS ({_RMATCH}), s AS (SELECT *, list_filter(string_split(pattern, '/'), lambda x: x <> '') AS g FROM m),
 v AS (SELECT *, len(list_filter(g, lambda x: NOT starts_with(x, ':') AND x <> '*')) AS a,
 len(g) - len(list_filter(g, lambda x: ends_with(x, '?'))) - len(list_filter(g, lambda x: x = '*')) AS b,
 len(g) - len(list_filter(g, lambda x: x = '*')) AS c, -len(list_filter(g, lambda x: ends_with(x, '?'))) AS e,
 -len(list_filter(g, lambda x: x = '*')) AS f FROM s)
 SELECT path, pattern FROM v WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.path = v.path AND o.a >= v.a AND o.b >= v.b
 AND o.c >= v.c AND o.e >= v.e AND o.f >= v.f AND (o.a, o.b, o.c, o.e, o.f) <> (v.a, v.b, v.c, v.e, v.f))""",
)
def _(spark, d):
    return gr.route_specificity(gr.route_match(view(spark, d, _RPATHS), view(spark, d, _PATS)))


# ---- modules ---------------------------------------------------------------------------

_MODS = f"""
SELECT 'src/d' || {S('c_nationkey')} || '/m' || {S('c_custkey')} || CASE c_custkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN
 '.jsx' WHEN 2 THEN '/index.tsx' ELSE '.css' END AS path, c_custkey AS k FROM {{customer}}
"""
_IMPS = f"""
SELECT 'src/d' || {S('n.c_nationkey')} || '/m' || {S('n.c_custkey')} || '.ts' AS path, CASE o_orderkey % 4 WHEN 0
 THEN '../d' || {S('t.c_nationkey')} || '/./m' || {S('t.c_custkey')} WHEN 1 THEN '../../src/d' || {S('t.c_nationkey')}
 || '/m' || {S('t.c_custkey')} || '.css' WHEN 2 THEN 'react' ELSE '../d99/missing' END AS specifier, o_orderkey AS ok,
 n.c_custkey AS nk, t.c_custkey AS tk, t.c_nationkey AS tn FROM {{orders}} JOIN {{customer}} n ON n.c_custkey = o_custkey
 JOIN {{customer}} t ON t.c_custkey = o_orderkey % 700
"""


@query(
    "import_resolve",
    f"""SELECT path, specifier, CASE WHEN ok % 4 = 0 AND tk % 4 <> 3 THEN 'src/d' || tn || '/m' || tk || CASE tk % 4 WHEN
 0 THEN '.ts' WHEN 1 THEN '.jsx' ELSE '/index.tsx' END WHEN ok % 4 = 1 AND tk % 4 = 3 THEN 'src/d' || tn || '/m' || tk ||
 '.css' END AS target FROM {duck(_IMPS)} WHERE ok % 4 <> 2""",
)
def _(spark, d):
    return gr.import_resolve(view(spark, d, _IMPS).select("path", "specifier"), view(spark, d, _MODS))


@query(
    "render_resolve",
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'local' WHEN o_orderkey % 5 = 1 THEN
 'imported' WHEN o_orderkey % 5 = 2 THEN 'external' ELSE 'unresolved' END AS status FROM orders) GROUP BY status""",
)
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.concat(F.lit("m"), "o_orderkey").alias("path"), (F.col("o_orderkey") % 5).alias("c")
    )
    renders = o.select(
        "path", F.when(F.col("c") == 1, "NS.Card").otherwise("Card").alias("binding")
    )
    declared = o.where("c = 0").select("path", F.lit("Card").alias("name"))
    imports = o.where("c IN (1, 2, 3)").select(
        "path",
        F.expr("CASE c WHEN 1 THEN './card' WHEN 2 THEN 'kit' ELSE './gone' END").alias("specifier"),
        F.lit("default").alias("imported"),
        F.expr("CASE c WHEN 1 THEN 'NS' ELSE 'Card' END").alias("local"),
        F.expr("CASE c WHEN 1 THEN 'namespace' ELSE 'default' END").alias("kind"),
    )
    resolved = o.where("c = 1").select(
        "path", F.lit("./card").alias("specifier"), F.lit("card.tsx").alias("target")
    )
    return _n(gr.render_resolve(renders, declared, imports, resolved), "status")


# Chains of re-exports: m0 -> m1 -> ... within blocks of eight, the last one declares.
_EXP = """
SELECT c_custkey AS k, 'm' || CAST(c_custkey AS VARCHAR(20)) AS path, CASE WHEN c_custkey % 8 = 7 THEN NULL ELSE 'm' ||
 CAST(c_custkey + 1 AS VARCHAR(20)) END AS nxt FROM {customer}
"""


@query(
    "export_resolve",
    f"""WITH x AS (SELECT k, path, k - k % 8 + 7 AS last FROM {duck(_EXP)}) SELECT path, 'A' AS name, 'm' || last AS module,
 'A' AS local FROM x WHERE 'm' || last IN (SELECT path FROM {duck(_EXP)}) AND last % 3 <> 0""",
)
def _(spark, d):
    e = view(spark, d, _EXP)
    exports = e.where("nxt IS NOT NULL").select(
        "path", F.lit(0).alias("pos"),
        F.when(F.col("k") % 2 == 0, "*").otherwise("A").alias("exported"),
        F.lit("A").alias("local"), F.col("nxt").alias("target"),
    )
    # A wildcard loop back to the block's first module must not hang the walk.
    loop = e.where("k % 8 = 4").select(
        "path", F.lit(1).alias("pos"), F.lit("*").alias("exported"), F.lit("").alias("local"),
        F.expr("'m' || CAST(k - 4 AS STRING)").alias("target"),
    )
    declared = e.where("k % 8 = 7 AND k % 3 <> 0").select("path", F.lit("A").alias("name"))
    asks = e.select("path", F.lit("A").alias("name"))
    return gr.export_resolve(asks, exports.unionByName(loop), declared)


# Modules render others of their block of twenty; every fortieth is the module of a route.
_LINKS = """
SELECT DISTINCT l_partkey AS a, l_partkey - l_partkey % 20 + l_suppkey % 20 AS b FROM {lineitem}
"""


@query(
    "render_closure",
    f"""WITH RECURSIVE e AS (SELECT * FROM {duck(_LINKS)}), r(route, module) AS (SELECT a, a FROM (SELECT DISTINCT a FROM e
 WHERE a % 40 = 0) UNION SELECT r.route, e.b FROM r JOIN e ON e.a = r.module) SELECT route, module FROM r""",
)
def _(spark, d):
    e = view(spark, d, _LINKS)
    roots = e.where("a % 40 = 0").select(F.col("a").alias("route"), F.col("a").alias("module"))
    return gr.render_closure(roots, e.select(F.col("a").alias("path"), F.col("b").alias("module")))


# Modules depend on lower ones of their block of twelve; some back edges close cycles of up to four.
_DEPS = """
SELECT DISTINCT CASE WHEN o_orderkey % 40 = 0 THEN o_custkey - o_custkey % 4 ELSE o_custkey END AS src, CASE WHEN
 o_orderkey % 40 = 0 THEN o_custkey - o_custkey % 4 + 3 ELSE greatest(o_custkey - o_custkey % 12, o_custkey - 1 -
 o_orderkey % 5) END AS dst FROM {orders}
"""


@query(
    "topo_order",
    f"""WITH RECURSIVE e AS (SELECT * FROM {duck(_DEPS)}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r
 JOIN e ON e.src = r.b), c AS (SELECT n AS node, least(n, coalesce(min(x.b), n)) AS comp FROM (SELECT src AS n FROM e UNION SELECT
 dst FROM e) LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON p.a = q.b AND p.b = q.a) x ON x.a = n GROUP BY n), g AS (SELECT
 DISTINCT s.comp AS src, t.comp AS dst FROM e JOIN c s ON s.node = e.src JOIN c t ON t.node = e.dst WHERE s.comp <> t.comp),
 l(comp, level) AS (SELECT DISTINCT comp, 0 FROM c UNION SELECT g.src, level + 1 FROM l JOIN g ON g.dst = l.comp)
 SELECT node, comp, level, comp IN (SELECT comp FROM c GROUP BY comp HAVING count(*) > 1) OR comp IN (SELECT c.comp FROM e JOIN c
 ON c.node = e.src WHERE e.src = e.dst) AS cyclic FROM c JOIN (SELECT comp, max(level) AS level FROM l GROUP BY comp) USING
 (comp)""",
)
def _(spark, d):
    e = view(spark, d, _DEPS)
    nodes = e.select(F.col("src").alias("node")).unionAll(e.select(F.col("dst").alias("node")))
    return topo_levels(nodes, e)


@query(
    "strong_components",
    f"""WITH RECURSIVE e AS (SELECT * FROM {duck(_DEPS)}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r
 JOIN e ON e.src = r.b) SELECT n AS node, least(n, coalesce(min(x.b), n)) AS comp FROM (SELECT src AS n FROM e UNION SELECT dst
 FROM e) LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON p.a = q.b AND p.b = q.a) x ON x.a = n GROUP BY n""",
)
def _(spark, d):
    from siteaudit.plans.fixpoint import strong_components

    e = view(spark, d, _DEPS)
    nodes = e.select(F.col("src").alias("node")).unionAll(e.select(F.col("dst").alias("node")))
    return strong_components(nodes, e)


# ---- ownership -------------------------------------------------------------------------

_OWN = f"""
SELECT o_orderkey AS eid, '/r' || {S('o_custkey % 50')} AS url_route, o_custkey % 50 AS r, '.s' || {S('o_orderkey % 300')} AS
 selector, o_orderkey % 300 AS s, 'div' AS tag, CASE WHEN o_orderkey % 41 = 0 THEN 'f7' ELSE '' END AS hint FROM {{orders}}
"""
_SELS = f"""
SELECT DISTINCT 'f' || {S('c_custkey % 60')} AS path, '.s' || {S('c_custkey % 200')} AS selector, CASE WHEN c_custkey % 200 <
 90 THEN 'exact' ELSE 'heuristic' END AS strength, c_custkey % 200 AS s FROM {{customer}} WHERE c_custkey % 7 < 4
"""
_RSRC = f"""
SELECT DISTINCT '/r' || {S('s_suppkey % 45')} AS url_route, 'f' || {S('s_nationkey % 60')} AS path FROM {{supplier}}
"""


@query(
    "source_ownership",
    f"""WITH e AS (SELECT * FROM {duck(_OWN)}), x AS (SELECT e.eid, count(*) AS n, min(l.path) AS one, count(r.path) AS rn,
 min(r.path) AS rone, any_value(strength) AS st FROM e JOIN {duck(_SELS)} l USING (selector) LEFT JOIN {duck(_RSRC)} r ON
 r.url_route = e.url_route AND r.path = l.path GROUP BY e.eid), u AS (SELECT url_route, count(*) AS un, min(path) AS uone FROM
 {duck(_RSRC)} GROUP BY url_route)
 SELECT eid, CASE WHEN hint = 'f7' THEN 'f7' WHEN n = 1 THEN one WHEN n > 1 AND rn = 1 THEN rone WHEN n > 1 THEN NULL WHEN un = 1
 THEN uone END AS source, CASE WHEN hint = 'f7' THEN 1.0 WHEN n = 1 THEN CASE st WHEN 'exact' THEN 1.0 ELSE 0.65 END WHEN n > 1
 AND rn = 1 THEN CASE st WHEN 'exact' THEN 0.9 ELSE 0.6 END WHEN n > 1 THEN 0.0 WHEN un = 1 THEN 0.4 ELSE 0.0 END AS confidence
 FROM e LEFT JOIN x USING (eid) LEFT JOIN u USING (url_route)""",
)
def _(spark, d):
    mods = table(spark, d, "region").limit(1).select(F.lit("f7").alias("path"))
    out = gr.source_ownership(
        view(spark, d, _OWN), mods, view(spark, d, _SELS), view(spark, d, _RSRC)
    )
    return out.select("eid", "source", "confidence")


_NODES = f"""
SELECT 'n' || {S('c_custkey')} AS node_id, '/u' || {S('c_custkey % 40')} AS url, CASE WHEN c_custkey % 2 = 0 THEN 'desktop'
 ELSE 'mobile' END AS viewport, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '#s' || {S('c_custkey % 90')} END AS selector,
 c_custkey % 60 AS ord FROM {{customer}}
"""
_ELS = f"""
SELECT o_orderkey AS eid, '/u' || {S('o_custkey % 40')} AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'desktop' ELSE 'mobile' END
 AS viewport, '#s' || {S('o_orderkey % 120')} AS selector, o_orderkey % 70 AS ord FROM {{orders}}
"""


@query(
    "semantic_regions",
    f"""SELECT eid, coalesce((SELECT min(node_id) FROM {duck(_NODES)} n WHERE n.url = e.url AND n.viewport = e.viewport AND
 n.selector = e.selector), (SELECT min(node_id) FROM {duck(_NODES)} n WHERE n.url = e.url AND n.viewport = e.viewport AND n.ord
 = e.ord)) AS node_id FROM {duck(_ELS)} e""",
)
def _(spark, d):
    out = gr.semantic_regions(view(spark, d, _ELS), view(spark, d, _NODES))
    return out.select("eid", "node_id")


# ---- graph tables ----------------------------------------------------------------------

_FACTS = f"""
SELECT CASE l_linenumber % 3 WHEN 0 THEN 'component' WHEN 1 THEN 'action' ELSE 'token' END AS kind, 'f' ||
 {S('l_partkey')} AS file, 'x' || {S('l_suppkey')} AS name, 0 AS ordinal, 'declares' AS relation FROM {{lineitem}}
"""
_NID = "{0} || ':' || sha1({0} || chr(0) || file || chr(0) || {1} || chr(0) || '0')"


@query(
    "build_graph",
    f"""SELECT 'node' AS part, {_NID.format('kind', 'name')} AS id, '' AS target FROM (SELECT DISTINCT kind, file, name FROM
 {duck(_FACTS)}) UNION ALL SELECT 'node', {_NID.format("'file'", 'file')}, '' FROM (SELECT DISTINCT file FROM {duck(_FACTS)})
 UNION ALL SELECT 'edge', {_NID.format("'file'", 'file')}, {_NID.format('kind', 'name')} FROM (SELECT DISTINCT kind, file, name
 FROM {duck(_FACTS)})""",
)
def _(spark, d):
    nodes, edges = gr.build_graph(view(spark, d, _FACTS))
    return nodes.select(F.lit("node").alias("part"), "id", F.lit("").alias("target")).unionAll(
        edges.select(F.lit("edge").alias("part"), F.col("source").alias("id"), "target")
    )


@query(
    "graph_freshness",
    """SELECT FALSE AS fresh, count(*) FILTER (page_id % 10 = 0 OR page_id % 7 = 0) AS changed FROM pages""",
)
def _(spark, d):
    p = pages(spark, d).select("path", "page_id", F.sha2("content", 256).alias("sha256"))
    live = p.where("page_id % 7 <> 0").select(
        "path",
        F.when(F.col("page_id") % 10 == 0, F.lit("edited")).otherwise(F.col("sha256")).alias("sha256"),
    )
    return gr.graph_freshness(p.select("path", "sha256"), live, 1, 1)


@query(
    "retain_runtime",
    """SELECT freshness, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'current' WHEN c_custkey % 5 = 0 THEN 'stale'
 ELSE 'retained' END AS freshness FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0) GROUP BY freshness""",
)
def _(spark, d):
    c = table(spark, d, "customer").select(
        F.concat(F.lit("n"), "c_custkey").alias("id"),
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'runtime_region' ELSE 'component' END").alias("kind"),
        (F.col("c_custkey") % 5).alias("file"), "c_custkey",
    )
    cols = ["id", "kind", "file"]
    out = gr.retain_runtime(
        c.select(*cols), c.where("c_custkey % 3 = 0").select(*cols), c.where("file = 0").select("file")
    )
    return _n(out, "freshness")


_SITE = f"""
SELECT host AS site, count(*) AS pages, sum(length(content) - length(replace(content, '<nav', '<na'))) AS nav,
 sum(length(content) - length(replace(content, '<li', '<l'))) AS actions, sum(length(content) - length(replace(content,
 '<div', '<di'))) AS components, sum(length(content) - length(replace(content, '<article', '<articl'))) AS article,
 sum(length(content) - length(replace(content, '<p>', '<p'))) AS elements FROM ({PAGES}) p GROUP BY host
"""


@query(
    "topology_fingerprint",
    f"""SELECT site, 'editorial' AS topology, 'top-nav' AS navigation, CASE WHEN components >= 12 THEN 'many-small' WHEN
 components >= 4 THEN 'modular' ELSE 'monolith' END AS component_partition, CASE WHEN actions <= 3 THEN 'focused' ELSE
 'distributed' END AS primary_action, 'reading' AS interaction, 'unknown' AS responsive, CASE WHEN elements / pages >= 12 THEN
 'dense' WHEN elements / pages >= 6 THEN 'balanced' ELSE 'sparse' END AS density FROM {duck(_SITE)}""",
)
def _(spark, d):
    s = view(spark, d, _SITE)
    none = ["sidebar", "aside", "form", "table", "chart", "hero", "section", "viewports", "responsive"]
    return gr.topology_fingerprint(s.withColumns({k: F.lit(0) for k in none}))


_CNODES = f"""
SELECT 's' || {S('l_suppkey')} AS site, CASE l_linenumber WHEN 1 THEN 'route' WHEN 2 THEN 'data' WHEN 3 THEN 'action' WHEN 4 THEN
 'state' WHEN 5 THEN 'region' ELSE 'component' END AS kind, CASE WHEN l_linenumber = 5 AND l_partkey % 2 = 0 THEN 'form' ELSE
 'x' || {S('l_partkey % 30')} END AS name FROM {{lineitem}}
"""


@query(
    "preserve_contracts",
    f"""SELECT DISTINCT site, kind || ':' || name AS contract FROM {duck(_CNODES)} WHERE kind IN
 ('route', 'data', 'action', 'state') OR (kind = 'region' AND name = 'form')""",
)
def _(spark, d):
    return gr.preserve_contracts(view(spark, d, _CNODES))


@query(
    "adapter_summary",
    """SELECT 'fw' || l_suppkey AS framework, CASE WHEN bool_or(l_linenumber = 7 AND l_quantity > 48) THEN 'unsupported' WHEN
 bool_or(l_linenumber = 6 AND l_quantity > 48) THEN 'degraded' ELSE 'native' END AS status, count(*) AS files, min(l_quantity /
 64) AS confidence, count(DISTINCT CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 50 END) AS reasons FROM lineitem GROUP BY
 l_suppkey""",
)
def _(spark, d):
    a = table(spark, d, "lineitem").select(
        F.concat(F.lit("fw"), "l_suppkey").alias("framework"),
        F.expr(
            "CASE WHEN l_linenumber = 7 AND l_quantity > 48 THEN 'unsupported' "
            "WHEN l_linenumber = 6 AND l_quantity > 48 THEN 'degraded' ELSE 'native' END"
        ).alias("status"),
        (F.col("l_quantity") / 64).alias("confidence"),
        F.expr("CASE WHEN l_partkey % 3 <> 0 THEN 'r' || l_partkey % 50 ELSE '' END").alias("reason"),
    )
    return gr.adapter_summary(a)


# ---- images, from embedding vectors ----------------------------------------------------


def _image_rows(spark, d):
    e = spread(table(spark, d, "embeddings"))
    base = "CAST(floor(abs(embedding[i]) * 500) AS INT) % 200"
    later = f"{base} + CASE WHEN (i + vec_id) % 7 = 0 THEN 20 WHEN (i + vec_id) % 5 = 0 THEN 5 ELSE 0 END"
    px = lambda x: F.expr(
        f"unhex(array_join(transform(sequence(0, 63), i -> repeat(lpad(hex({x}), 2, '0'), 3)), ''))"
    )
    return e.select(
        F.concat(F.lit("c"), "vec_id").alias("case_id"),
        F.lit(8).alias("before_width"),
        F.lit(8).alias("before_height"),
        px(base).alias("before_rgb"),
        F.lit(8).alias("after_width"),
        F.when(F.col("vec_id") % 50 == 0, 4).otherwise(8).alias("after_height"),
        px(later).alias("after_rgb"),
        F.expr(
            "array(named_struct('id', 'ig', 'kind', 'ignored', 'x', 0.5D, 'y', -3D, 'w', 2D, 'h', 4.2D),"
            "named_struct('id', 'top', 'kind', 'semantic', 'x', 0D, 'y', 0D, 'w', 8D, 'h', 3.5D))"
        ).alias("regions"),
    )


# Pixel (x, y) = (i % 8, i // 8); the ignored rectangle clips to x 0..2, y 0..1.
_PXS = """SELECT 'c' || vec_id AS case_id, i, CASE WHEN (i + vec_id) % 7 = 0 THEN 60 WHEN (i + vec_id) % 5 = 0 THEN 15 ELSE 0 END
 AS delta, i % 8 < 3 AND i // 8 < 2 AS ign FROM embeddings, range(64) r(i) WHERE vec_id % 50 <> 0"""


@query(
    "pixel_delta",
    f"""SELECT case_id, 64 AS total_pixels, count(*) FILTER (delta > 30) AS raw_changed, count(*) FILTER (delta > 30 AND ign) AS
 ignored_changed, count(*) FILTER (delta > 30 AND NOT ign) AS changed, min(i % 8) FILTER (delta > 30 AND NOT ign) || ',' ||
 min(i // 8) FILTER (delta > 30 AND NOT ign) || ',' || (max(i % 8) FILTER (delta > 30 AND NOT ign) + 1) || ',' || (max(i // 8)
 FILTER (delta > 30 AND NOT ign) + 1) AS bbox, round(avg(delta / 3) FILTER (NOT ign), 4) AS mean_delta, round(sqrt(avg((delta /
 3) * (delta / 3)) FILTER (NOT ign)), 4) AS rms_delta, CASE WHEN 100 * count(*) FILTER (delta > 30 AND NOT ign) / 64 < 20 THEN
 'noticeable' ELSE 'broad' END AS band FROM ({_PXS}) GROUP BY case_id""",
)
def _(spark, d):
    out = im.pixel_delta(_image_rows(spark, d), strip=24).where("status = 'ok'")
    return out.select(
        "case_id", F.col("total_pixels").cast("int").alias("total_pixels"), "raw_changed", "ignored_changed",
        "changed", "bbox", F.round("mean_delta", 4).alias("mean_delta"),
        F.round("rms_delta", 4).alias("rms_delta"), "band",
    )


@query(
    "region_delta",
    f"""SELECT case_id, 'top' AS region_id, count(*) FILTER (delta > 30) AS changed, count(*) AS total, round(count(*) FILTER (delta
 > 30) / count(*), 8) AS changed_ratio FROM ({_PXS}) WHERE i // 8 < 4 AND NOT ign GROUP BY case_id""",
)
def _(spark, d):
    return im.region_delta(_image_rows(spark, d), strip=24)


@query(
    "image_pairs",
    "SELECT l_orderkey AS case_id, max(l_quantity) FILTER (l_linestatus = 'O') AS before_width, max(l_quantity) FILTER "
    "(l_linestatus <> 'O') AS after_width FROM lineitem GROUP BY l_orderkey",
)
def _(spark, d):
    i = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.expr("CASE WHEN l_linestatus = 'O' THEN 'before' ELSE 'after' END").alias("side"),
        F.col("l_quantity").alias("width"), F.lit(1).alias("height"),
        F.unhex(F.lit("00")).alias("rgb"),
    )
    return im.image_pairs(i).select("case_id", "before_width", "after_width")


@query(
    "manifest_status",
    """SELECT o_orderkey AS case_id, CASE o_orderkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'stale' WHEN 2 THEN 'stale' WHEN 3 THEN
 'blocked' ELSE 'complete' END AS status, CASE o_orderkey % 6 WHEN 0 THEN 'no-before,no-after' WHEN 1 THEN 'after-changed' WHEN 2
 THEN 'no-after' WHEN 3 THEN 'error:timeout' ELSE '' END AS reasons FROM orders""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    exp = o.select(
        F.col("o_orderkey").alias("case_id"), F.lit("b").alias("before_hash"), F.lit("a").alias("after_hash")
    )
    sto = o.where("o_orderkey % 6 <> 0").select(
        F.col("o_orderkey").alias("case_id"), F.lit("b").alias("before_hash"),
        F.expr("CASE o_orderkey % 6 WHEN 1 THEN 'z' WHEN 2 THEN NULL ELSE 'a' END").alias("after_hash"),
        F.expr("CASE WHEN o_orderkey % 6 = 3 THEN 'timeout' END").alias("error"),
    )
    return im.manifest_status(exp, sto)


# ---- redesign --------------------------------------------------------------------------

_SITES = f"""
SELECT c_custkey AS site, CASE c_custkey % 5 WHEN 0 THEN 'form-flow' WHEN 1 THEN 'data-workspace' WHEN 2 THEN 'sectioned-landing'
 WHEN 3 THEN 'editorial' ELSE 'generic-page' END AS topology, c_custkey % 2 AS form, c_custkey % 3 AS tbl, 0 AS chart,
 c_custkey % 7 AS section, c_nationkey AS actions, c_custkey % 11 AS variance, CASE c_custkey % 4 WHEN 0 THEN 'Submit forms' WHEN
 1 THEN 'expert operator' WHEN 2 THEN 'Inspect data' ELSE 'tell a story' END AS intent, CASE WHEN c_custkey % 2 = 0 THEN 0.75E0
 ELSE 1E0 END AS intent_confidence FROM {{customer}}
"""


def _ranked(spark, d):
    s = view(spark, d, _SITES).withColumnRenamed("tbl", "table")
    return rd.rank_strategies(s, 3)


_RANK = f"""SELECT site, rank, strategy, score FROM (SELECT site, u.s AS strategy, CAST(u.v AS INT) AS score, CAST(row_number()
 OVER (PARTITION BY site ORDER BY u.v DESC, u.i) AS INT) AS rank FROM (SELECT site, unnest([
 {{'i': 0, 's': 'task-flow', 'v': CASE topology WHEN 'form-flow' THEN 8 WHEN 'generic-page' THEN 2 ELSE 0 END + 5 * form + CASE WHEN
  site % 4 = 0 THEN k ELSE 0 END}},
 {{'i': 1, 's': 'object-workspace', 'v': CASE topology WHEN 'data-workspace' THEN 10 WHEN 'generic-page' THEN 3 ELSE 0 END + CASE
  WHEN tbl > 0 THEN 5 ELSE 0 END + CASE WHEN site % 4 = 2 THEN k ELSE 0 END}},
 {{'i': 2, 's': 'editorial-narrative', 'v': CASE topology WHEN 'sectioned-landing' THEN 10 WHEN 'editorial' THEN 9 WHEN
  'generic-page' THEN 4 ELSE 0 END + CASE WHEN section >= 3 THEN 5 ELSE 0 END + CASE WHEN site % 4 = 3 THEN k ELSE 0 END}},
 {{'i': 3, 's': 'spatial-canvas', 'v': CASE topology WHEN 'data-workspace' THEN 5 WHEN 'generic-page' THEN 1 ELSE 0 END +
  greatest(0, variance - 7)}},
 {{'i': 4, 's': 'command-console', 'v': CASE topology WHEN 'data-workspace' THEN 6 WHEN 'generic-page' THEN 4 WHEN 'form-flow' THEN
  2 ELSE 0 END + least(5, actions) + CASE WHEN site % 4 = 1 THEN k ELSE 0 END}}]) AS u FROM (SELECT *,
  round_even(4 * intent_confidence, 0)::INT AS k FROM {duck(_SITES)}))) WHERE rank <= 3"""


@query("rank_strategies", _RANK)
def _(spark, d):
    return _ranked(spark, d)


# No two strategies share a value on any dimension, except topology with itself.
@query(
    "pairwise_distance",
    f"""SELECT a.site, least(a.strategy, b.strategy) AS "left", greatest(a.strategy, b.strategy) AS "right", 100 AS score,
 'topology,navigation,component_partition,primary_action,interaction,responsive,density' AS changed FROM ({_RANK}) a JOIN
 ({_RANK}) b ON a.site = b.site AND a.rank < b.rank""",
)
def _(spark, d):
    return rd.pairwise_distance(rd.with_dimensions(_ranked(spark, d)))


@query(
    "proposal_compare",
    f"""SELECT dimension, count(*) AS n FROM ({_RANK}), (SELECT unnest(['topology', 'navigation', 'component_partition',
 'primary_action', 'interaction', 'responsive', 'density']) AS dimension) GROUP BY dimension""",
)
def _(spark, d):
    out = rd.proposal_compare(rd.with_dimensions(_ranked(spark, d)))
    return _n(out.where("value <> ''"), "dimension")


_PLAN = f"""
SELECT 'f' || {S('o_custkey % 80')} AS file, 'O' || {S('o_custkey % 400')} AS owner, TRUE AS ui_required, CASE WHEN o_orderkey % 61 =
 0 THEN 'unknown' WHEN o_orderkey % 67 = 0 THEN 'maybe' ELSE 'present' END AS lifecycle, CASE WHEN o_orderkey % 3 = 0 THEN 'POST'
 ELSE 'get' END AS method, CASE o_orderkey % 4 WHEN 0 THEN 'isLoading' WHEN 1 THEN 'saveError' WHEN 2 THEN 'formSaved' ELSE
 'isDisabled' END AS st FROM {{orders}}
"""


@query(
    "state_plan",
    f"""WITH p AS (SELECT *, CASE lifecycle WHEN 'unknown' THEN 'unknown' WHEN 'maybe' THEN 'invalid' END AS bad, CASE st WHEN
 'isLoading' THEN 'loading' WHEN 'saveError' THEN 'error' WHEN 'formSaved' THEN 'success' ELSE 'disabled' END AS s FROM
 {duck(_PLAN)}), g AS (SELECT file, owner, CASE WHEN bool_or(bad = 'invalid') THEN 'invalid' WHEN bool_or(bad = 'unknown') THEN
 'unknown' END AS blocker, list(DISTINCT s) FILTER (bad IS NULL) AS ob, bool_or(method = 'POST') FILTER (bad IS NULL) AS mu,
 bool_or(method = 'get') FILTER (bad IS NULL) AS rd FROM p GROUP BY ALL) SELECT file, owner, blocker, CASE WHEN blocker IS NULL THEN
 m ELSE '' END AS missing FROM (SELECT *, array_to_string(list_filter(['loading', 'empty', 'error', 'success', 'disabled',
 'first-run'], lambda x: NOT list_contains(ob, x) AND ((coalesce(mu, FALSE) AND x IN ('loading', 'error', 'success', 'disabled')) OR
 (coalesce(rd, FALSE) AND x IN ('loading', 'empty', 'error', 'success', 'first-run')))), ',') AS m FROM g) WHERE blocker IS NOT
 NULL OR m <> ''""",
)
def _(spark, d):
    p = view(spark, d, _PLAN).withColumns(
        {"ui_states": F.array("st"), "mutation": F.lit(None).cast("boolean")}
    )
    return rd.state_plan(p)


@query(
    "remediation_plan",
    f"""SELECT detector_id, CASE max(CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 WHEN 'error' THEN 2 ELSE 3 END) WHEN 0
 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'critical' END AS severity, count(*) AS findings, count(DISTINCT path)
 AS modules, min(path) AS first_module FROM {duck(FINDINGS)} GROUP BY detector_id""",
)
def _(spark, d):
    return rd.remediation_plan(view(spark, d, FINDINGS))


@query(
    "obligation_plan",
    f"""SELECT field, count(DISTINCT back_op) AS operations, count(DISTINCT file) AS modules FROM (SELECT p.back_op, 'retry' AS field,
 'm' || fk % 70 AS file, CASE WHEN b.capability = 'unknown' OR b.applicable IS NULL THEN 'u' WHEN b.applicable THEN CASE WHEN NOT
 coalesce(f.capability = 'present' AND f.applicable, FALSE) THEN CASE WHEN f.capability = 'unknown' THEN 'u' ELSE 'x' END WHEN
 f.attrs <> b.attrs THEN 'x' END END AS kind FROM {_PX} p JOIN {duck(_OBL)} b ON b.op_id = p.back_op LEFT JOIN {duck(_OBL)} f ON
 f.op_id = p.front_op) WHERE kind = 'x' GROUP BY field""",
)
def _(spark, d):
    from siteaudit.operators.contracts import obligation_findings

    f = obligation_findings(_pairs(spark, d), view(spark, d, _OBL))
    return rd.obligation_plan(
        f.withColumn("file", F.expr("'m' || CAST(substr(front_op, 2) AS BIGINT) % 70"))
    )


@query(
    "contract_blockers",
    f"""SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'No server operation answers this call' WHEN 1 THEN
 'Screen and server use different methods' ELSE 'Contract differs' END || ': ' || CASE WHEN o_custkey % 9 = 0 THEN
 'unknown path' ELSE '/p' || o_custkey % 50 END || '.' AS blocker FROM orders WHERE o_orderkey % 4 <> 3""",
)
def _(spark, d):
    f = table(spark, d, "orders").select(
        F.expr(
            "CASE o_orderkey % 4 WHEN 0 THEN 'frontend_only' WHEN 1 THEN 'method_mismatch' WHEN 2 THEN 'field_missing' "
            "ELSE 'operation_obligation_missing' END"
        ).alias("kind"),
        F.expr("CASE WHEN o_custkey % 9 = 0 THEN '' ELSE '/p' || o_custkey % 50 END").alias("npath"),
    )
    return rd.contract_blockers(f)


@query(
    "preserved_evidence",
    """SELECT contract, coalesce(files, 0) AS files, coalesce(provs, 0) AS provenances, CASE WHEN files IS NULL THEN 'gap' ELSE
 'anchored' END AS status FROM (SELECT DISTINCT 'k' || o_custkey % 300 AS contract FROM orders) LEFT JOIN (SELECT 'k' || c_custkey %
 400 AS contract, count(DISTINCT c_nationkey) AS files, count(DISTINCT c_mktsegment) AS provs FROM customer WHERE c_custkey % 400 >
 40 GROUP BY 1) USING (contract)""",
)
def _(spark, d):
    c = table(spark, d, "orders").select(F.expr("'k' || o_custkey % 300").alias("contract"))
    s = table(spark, d, "customer").where("c_custkey % 400 > 40").select(
        F.expr("'k' || c_custkey % 400").alias("contract"),
        F.col("c_nationkey").alias("file"), F.col("c_mktsegment").alias("provenance"),
    )
    return rd.preserved_evidence(c, s)


_INTENT = f"""
SELECT 'p' || {S('o_custkey % 200')} AS project, CASE o_orderkey % 3 WHEN 0 THEN 'product_goal' WHEN 1 THEN 'audience' ELSE 'genre'
 END AS field, CASE WHEN o_orderkey % 10 = 0 THEN '  ' ELSE ' v' || {S('o_orderkey')} END AS value, CASE o_orderkey % 5 WHEN 0 THEN
 'explicit' WHEN 1 THEN 'mapped' ELSE 'fallback' END AS provenance, o_orderkey AS recorded FROM {{orders}}
"""


@query(
    "intent_merge",
    f"""SELECT project, field, trim(value) AS value, provenance, CASE provenance WHEN 'explicit' THEN 1.0 WHEN 'mapped' THEN 0.75 ELSE
 0.25 END AS confidence FROM {duck(_INTENT)} WHERE trim(value) <> '' QUALIFY row_number() OVER (PARTITION BY project, field ORDER BY
 CASE provenance WHEN 'explicit' THEN 3 WHEN 'mapped' THEN 2 ELSE 1 END DESC, recorded DESC) = 1""",
)
def _(spark, d):
    return rd.intent_merge(view(spark, d, _INTENT), ["project"])
