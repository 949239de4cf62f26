"""Rendered-element queries; elements derive from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteaudit.functions.color import normalize_color, normalize_colors
from siteaudit.operators import design_audit as da
from siteaudit.operators import geometry as geo
from siteaudit.operators import layout_audit as la
from siteaudit.operators import peers
from siteaudit.schema import with_measurements
from siteaudit.workload.derive import ELEMENTS, duck, table, view
from siteaudit.workload.registry import query

EX = duck(ELEMENTS)


def ex(spark, d):
    return view(spark, d, ELEMENTS)


def _n(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _audit(name: str, families: list[str], known: dict[str, str], rules: list[tuple[str, str, str]]):
    """``known``: measurement -> SQL; ``rules``: (code, severity, SQL condition)."""
    cols = ", ".join(f"{e} AS {k}" for k, e in known.items())
    inner = f"(SELECT rid, tag, name, {cols} FROM (SELECT *, 'n' AS name FROM {EX}))"
    hits = ", ".join(
        f"CASE WHEN {c} THEN {{'c': {code}, 's': {sev}}} END" for code, sev, c in rules
    )
    sql = (
        f"SELECT rid, u.c AS code, u.s AS severity FROM (SELECT rid, unnest([{hits}]) AS u "
        f"FROM {inner}) WHERE u IS NOT NULL"
    )

    def run(spark, d):
        e = ex(spark, d).select(
            "rid", "tag", F.lit("n").alias("name"), *[F.expr(x).alias(k) for k, x in known.items()]
        )
        e = with_measurements(e, **{k: F.col(k) for k in known})
        return la.audit(e, families).select("rid", "code", "severity")

    query(name, sql)(run)


Q = "'{}'".format
_audit(
    "alignment",
    ["alignment"],
    {
        "layoutDeviation": "qty / 8",
        "fontBaselineDeviation": "(okey % 9) / 2",
        "fontMismatch": "okey % 10 = 0",
        "isTextFlow": "partkey % 4 <> 0",
    },
    [
        (Q("runtime-layout-misalignment"), Q("warning"), "layoutDeviation > 4"),
        (
            Q("runtime-font-misalignment"),
            Q("warning"),
            "isTextFlow AND (fontBaselineDeviation > 3 OR fontMismatch)",
        ),
    ],
)
_audit(
    "visual_content",
    ["visual_content"],
    {
        "chartBarCount": "okey % 6",
        "chartBarBaselineSpread": "qty / 4",
        "textCollisionCount": "CASE WHEN partkey % 9 = 0 THEN 2 ELSE 0 END",
        "unseparatedTextBoundaryCount": "CASE WHEN suppkey % 7 = 0 THEN lno END",
    },
    [
        (
            Q("runtime-chart-baseline-misalignment"),
            Q("warning"),
            "chartBarCount >= 3 AND chartBarBaselineSpread > 4",
        ),
        (Q("runtime-text-collision"), Q("error"), "textCollisionCount > 0"),
        (
            Q("runtime-text-separation"),
            Q("warning"),
            "coalesce(unseparatedTextBoundaryCount, 0) > 0",
        ),
    ],
)
_UNM = """(clippedByAncestor AND ((coalesce(ancestorClipOverflowInlineStart, 0) > 1 AND NOT
 insideScrollRegionX) OR (coalesce(ancestorClipOverflowBlockEnd, 0) > 1 AND NOT insideScrollRegionY)
 OR NOT (coalesce(ancestorClipOverflowInlineStart, 0) > 1 OR
 coalesce(ancestorClipOverflowBlockEnd, 0) > 1)))"""
_audit(
    "clipping",
    ["clipping"],
    {
        "hasText": "okey % 3 <> 0",
        "overflowX": "CASE WHEN lno % 2 = 0 THEN 'Hidden' ELSE 'visible' END",
        "overflowY": "CASE WHEN lno % 3 = 0 THEN 'clip' ELSE 'auto' END",
        "scrollWidth": "qty * 4",
        "clientWidth": "100",
        "scrollHeight": "qty * 3",
        "clientHeight": "100",
        "containsScrollRegionX": "partkey % 5 = 0",
        "containsScrollRegionY": "partkey % 6 = 0",
        "clippedByAncestor": "suppkey % 4 = 0",
        "ancestorClipOverflowInlineStart": "CASE WHEN okey % 2 = 0 THEN 3 END",
        "ancestorClipOverflowBlockEnd": "CASE WHEN okey % 5 = 0 THEN 2 END",
        "insideScrollRegionX": "okey % 7 = 0",
        "insideScrollRegionY": "okey % 11 = 0",
        "intentionalTruncation": "partkey % 3 = 0",
        "descendantClipped": "partkey % 8 = 0",
    },
    [
        (
            "CASE WHEN intentionalTruncation THEN 'runtime-text-truncated' "
            "ELSE 'runtime-text-clipped' END",
            "CASE WHEN intentionalTruncation THEN 'info' ELSE 'error' END",
            "hasText AND ((NOT containsScrollRegionX AND overflowX = 'Hidden' AND scrollWidth > "
            "clientWidth + 1) OR (NOT containsScrollRegionY AND overflowY = 'clip' AND scrollHeight "
            f"> clientHeight + 1) OR {_UNM})",
        ),
        (
            Q("runtime-component-clipped"),
            Q("error"),
            "(descendantClipped AND NOT (containsScrollRegionX OR containsScrollRegionY)) OR "
            f"({_UNM} AND NOT hasText)",
        ),
    ],
)
_audit(
    "responsive",
    ["responsive"],
    {
        "clientWidth": "qty * 2",
        "scrollWidth": "60",
        "clientHeight": "qty",
        "scrollHeight": "30",
        "isScrollRegionX": "okey % 2 = 0",
        "isScrollRegionY": "okey % 3 = 0",
        "concealedInteractiveDescendantCountX": "CASE WHEN partkey % 2 = 0 THEN partkey % 3 END",
        "concealedInteractiveDescendantCount": "lno % 2",
        "concealedInteractiveDescendantCountY": "suppkey % 2",
        "navigationLinkCount": "CASE WHEN lno > 3 THEN partkey % 20 ELSE 0 END",
        "navigationGroupCount": "okey % 4",
    },
    [
        (
            Q("runtime-interactive-scroll-concealment"),
            Q("error"),
            "(isScrollRegionX AND coalesce(concealedInteractiveDescendantCountX, "
            "concealedInteractiveDescendantCount) > 0 AND clientWidth > 0 AND scrollWidth > "
            "clientWidth + 1) OR (isScrollRegionY AND concealedInteractiveDescendantCountY > 0 AND "
            "navigationLinkCount = 0 AND clientHeight > 0 AND scrollHeight > clientHeight + 1)",
        ),
        (
            Q("runtime-navigation-choice-overload"),
            Q("warning"),
            "navigationLinkCount > 12 AND (isScrollRegionX OR isScrollRegionY) AND "
            "navigationGroupCount < 2",
        ),
    ],
)


@query(
    "focus_obscured",
    f"""SELECT rid FROM {EX} WHERE okey % 3 = 0 AND lno <> 2 AND qty / 100 >= 0.2""",
)
def _(spark, d):
    e = with_measurements(
        ex(spark, d).select("rid", "tag", "okey", "lno", "qty", F.lit("n").alias("name")),
        focusVisibility=F.struct(
            (F.col("okey") % 3 != 0).alias("fullyVisible"),
            F.when(F.col("lno") == 2, " ").otherwise("#bar").alias("occludedBy"),
            (F.col("qty") / 100).alias("occludedFraction"),
        ),
    )
    return la.audit(e, ["focus_obscured"]).select("rid")


@query(
    "responsive_table",
    f"SELECT rid FROM {EX} WHERE okey % 2 = 0 AND lno % 2 = 0 AND partkey % 3 <> 0 AND qty >= 2 "
    "AND tax >= 1",
)
def _(spark, d):
    e = with_measurements(
        ex(spark, d),
        table=F.struct(
            (F.col("okey") % 2 == 0).alias("scrollable"),
            (F.col("lno") % 2 == 1).alias("scrollbarVisible"),
            (F.col("partkey") % 3 == 0).alias("affordance"),
            F.col("qty").alias("rowCount"),
            F.col("tax").cast("double").alias("headerCount"),
        ),
    ).withColumn("name", F.lit("n"))
    return la.audit(e, ["responsive"]).select("rid")


_audit(
    "spacing",
    ["spacing"],
    {
        "hasText": "okey % 4 <> 0",
        "isBoxControl": "lno <= 2",
        "isVisualContainer": "lno = 3",
        "hasVisualSurface": "CASE WHEN partkey % 5 = 0 THEN okey % 2 = 0 END",
        "isScrollRegionX": "CASE WHEN suppkey % 6 = 0 THEN okey % 2 = 0 END",
        "isScrollRegion": "okey % 13 = 0",
        "writingMode": "CASE WHEN partkey % 7 = 0 THEN 'vertical-rl' ELSE 'horizontal-tb' END",
        "textInsetInlineStart": "CASE WHEN okey % 9 <> 0 THEN qty / 4 END",
        "textInsetInlineEnd": "tax",
        "textInsetBlockStart": "qty / 5",
        "textInsetBlockEnd": "disc",
        "textInsetTop": "qty",
        "textInsetRight": "qty / 2",
        "textInsetLeft": "qty / 3",
        "paddingInlineStart": "qty / 3",
        "paddingInlineEnd": "CASE WHEN okey % 8 <> 0 THEN qty / 4 END",
        "paddingLeft": "tax * 2",
        "paddingRight": "tax * 3",
        "paddingTop": "disc",
        "paddingBottom": "CASE WHEN okey % 7 <> 0 THEN disc * 2 END",
    },
    [],
)


def _spacing_sql() -> str:
    from siteaudit.workload.registry import SQL

    whole = "textInsetInlineStart IS NOT NULL"
    x = f"""SELECT *, {whole} AS w, CASE WHEN {whole} THEN textInsetInlineStart ELSE textInsetTop END
 AS i0, CASE WHEN {whole} THEN textInsetInlineEnd ELSE textInsetRight END AS i1,
 CASE WHEN {whole} THEN textInsetBlockStart END AS i2, CASE WHEN {whole} THEN textInsetBlockEnd ELSE
 textInsetLeft END AS i3, coalesce(isScrollRegionX, FALSE) OR (isScrollRegionX IS NULL AND
 isScrollRegion) AS cx, isScrollRegionX IS NULL AND isScrollRegion AS cy, writingMode = 'vertical-rl'
 AS v FROM ({SQL['spacing']})"""
    y = f"""SELECT *, CASE WHEN v THEN cy ELSE cx END AS ci, CASE WHEN v THEN cx ELSE cy END AS cb,
 CASE WHEN paddingInlineEnd IS NOT NULL THEN paddingInlineStart ELSE paddingLeft END AS hs,
 CASE WHEN paddingInlineEnd IS NOT NULL THEN paddingInlineEnd ELSE paddingRight END AS he,
 paddingTop AS vs, paddingBottom AS ve, coalesce(hasVisualSurface, TRUE) AND isVisualContainer AS sf,
 CASE WHEN isBoxControl THEN 6 ELSE 8 END AS vm FROM ({x})"""
    uneven = "abs({0} - {1}) > greatest(4.0, greatest({0}, {1}) * 0.35)"
    return f"""SELECT rid, code, 'warning' AS severity FROM (SELECT rid, unnest([
 CASE WHEN hasText AND (isBoxControl OR isVisualContainer) AND least(CASE WHEN NOT ci THEN i0 END,
  CASE WHEN NOT ci THEN i1 END, CASE WHEN NOT cb THEN i2 END, CASE WHEN NOT cb THEN i3 END) < 4
  THEN 'runtime-text-edge-contact' END,
 CASE WHEN (isBoxControl OR (sf AND NOT ci AND least(i0, i1) < 8)) AND (least(hs, he) < 8 OR
  {uneven.format('hs', 'he')}) THEN 'runtime-horizontal-padding' END,
 CASE WHEN (isBoxControl OR (sf AND NOT cb AND least(i2, i3) < 8)) AND vs IS NOT NULL AND ve IS NOT NULL
  AND (least(vs, ve) < vm OR {uneven.format('vs', 've')}) THEN 'runtime-vertical-padding' END]) AS code
 FROM ({y})) WHERE code IS NOT NULL"""


def _fix_spacing() -> None:
    from siteaudit.workload.registry import SQL

    # The generic form has no conditions for this family; keep its column list, add the rules.
    inner = SQL["spacing"].split("FROM ", 2)[2].rsplit(" WHERE u IS NOT NULL", 1)[0].rsplit(")", 1)[0]
    SQL["spacing"] = f"SELECT * FROM {inner}"
    SQL["spacing"] = _spacing_sql()


_fix_spacing()


@query(
    "line_spacing",
    f"""SELECT rid, u.c AS code, u.s AS severity FROM (SELECT rid, unnest([
 CASE WHEN okey % 2 = 0 AND length(replace(nm, ' ', '')) >= 32 AND lno >= 4 AND
  length(replace(nm, ' ', '')) <= lno * 8 THEN {{'c': 'runtime-pathological-text-wrap', 's': 'error'}} END,
 CASE WHEN partkey % 5 <> 0 AND suppkey % 3 <> 0 AND ((gap < -1 AND r > 0 AND r < 1) OR (r > 0 AND
  r < m)) THEN {{'c': 'runtime-line-spacing', 's': CASE WHEN gap < -1 AND r > 0 AND r < 1 THEN 'error'
  ELSE 'warning' END}} END]) AS u FROM (SELECT *, 'a b' || repeat('word ', CAST(okey % 12 AS INT)) AS nm,
 (qty / 2) / 16 AS r, CASE WHEN disc >= 5 THEN CAST(-disc AS DOUBLE) / 4 END AS gap,
 CASE WHEN tag IN ('h1', 'h2', 'h3') THEN 1.05 ELSE 1.2 END AS m FROM {EX})) WHERE u IS NOT NULL""",
)
def _(spark, d):
    e = ex(spark, d)
    e = e.withColumn(
        "name", F.concat(F.lit("a b"), F.expr("repeat('word ', CAST(okey % 12 AS INT))"))
    )
    e = with_measurements(
        e,
        paintedText=F.col("okey") % 2 == 0,
        lineCount=F.col("lno"),
        fontSize=F.lit(16.0),
        lineHeight=F.col("qty") / 2,
        minimumLineGap=F.when(F.col("disc") >= 5, -F.col("disc") / 4),
        hasText=F.col("partkey") % 5 != 0,
        isMultiline=F.col("suppkey") % 3 != 0,
    )
    return la.audit(e, ["line_spacing"]).select("rid", "code", "severity")


@query(
    "modal_mute",
    f"SELECT count(*) AS n FROM {EX} WHERE qty / 8 > 4 AND okey % 4 <> 0",
)
def _(spark, d):
    e = with_measurements(
        ex(spark, d).withColumn("name", F.lit("n")),
        layoutDeviation=F.col("qty") / 8,
        obscuredByModal=F.when(F.col("okey") % 4 == 0, True),
    )
    return la.audit(e).agg(F.count(F.lit(1)).alias("n"))


@query(
    "clip_suppress",
    f"""WITH c AS (SELECT DISTINCT capture_id, 'b' || partkey % 50 AS sel FROM {EX} WHERE lno = 7 AND
 okey % 3 = 0) SELECT code, count(*) AS n FROM (SELECT CASE WHEN lno = 7 THEN
 'runtime-component-clipped' ELSE 'runtime-text-clipped' END AS code, * FROM {EX} WHERE (lno = 7 AND
 okey % 3 = 0) OR lno = 5) e WHERE NOT (lno = 5 AND EXISTS (SELECT 1 FROM c WHERE c.capture_id =
 e.capture_id AND c.sel = 'b' || okey % 60)) GROUP BY code""",
)
def _(spark, d):
    e = ex(spark, d).where("(lno = 7 AND okey % 3 = 0) OR lno = 5").select(
        "capture_id",
        F.expr("'b' || CASE WHEN lno = 7 THEN partkey % 50 ELSE 1000 + okey END").alias("selector"),
        F.expr(
            "CASE WHEN lno = 7 THEN 'runtime-component-clipped' ELSE 'runtime-text-clipped' END"
        ).alias("code"),
        F.when(F.col("lno") == 5, F.expr("'{\"clipping_ancestor\":\"b' || okey % 60 || '\"}'"))
        .otherwise("{}")
        .alias("metrics"),
    )
    return _n(la.clip_suppress(e), "code")


# ---- design semantics ------------------------------------------------------------------

_STYLE = "color, background, font_size, font_weight, lno AS radius, height"


def _drift_sql(group: str, sig: str, where: str = "TRUE") -> str:
    return f"""WITH e AS (SELECT *, CASE WHEN suppkey % 3 = 0 THEN '' ELSE 'role' || lno % 2 END AS
 palette_role, 'o' || suppkey AS ow, lno AS radius FROM {EX}), s AS (SELECT {group}, {sig},
 count(*) AS n FROM e WHERE {where} GROUP BY ALL), t AS (SELECT {group}, sum(n) AS a, max(n) AS m
 FROM s GROUP BY ALL), k AS (SELECT {group}, count(*) AS ties FROM s JOIN t USING ({group})
 WHERE n = m AND m >= 2 AND a >= 3 GROUP BY ALL HAVING count(*) = 1), md AS (SELECT s.* FROM s JOIN t
 USING ({group}) JOIN k USING ({group}) WHERE n = m)
 SELECT e.rid FROM e JOIN md USING ({group}) WHERE {where.replace('palette', 'e.palette')} AND
 ({', '.join('e.' + c.strip() for c in sig.split(','))}) IS DISTINCT FROM
 ({', '.join('md.' + c.strip() for c in sig.split(','))})"""


def _drift_rows(spark, d):
    e = ex(spark, d)
    return e.select(
        "rid",
        F.expr("'o' || suppkey").alias("owner"),
        "grp",
        F.expr("CASE WHEN suppkey % 3 = 0 THEN '' ELSE 'role' || lno % 2 END").alias("palette_role"),
        "color",
        "background",
        (F.col("font_size") * 0).alias("font_size"),
        F.lit(400.0).alias("font_weight"),
        (F.col("lno") % 2).alias("radius"),
        (F.col("height") * 0).alias("height"),
    )


@query(
    "component_drift",
    _drift_sql("ow, grp, palette_role", "color, background, radius").replace(
        "lno AS radius", "lno % 2 AS radius"
    ),
)
def _(spark, d):
    return da.component_drift(_drift_rows(spark, d)).select("rid")


@query(
    "palette_drift",
    _drift_sql("ow, grp, palette_role", "color, background", "palette_role <> ''"),
)
def _(spark, d):
    return da.palette_drift(_drift_rows(spark, d)).select("rid")


@query(
    "heading_hierarchy",
    f"""WITH h AS (SELECT *, CAST(substr(tag, 2, 1) AS INT) AS lvl FROM {EX} WHERE tag IN ('h1', 'h2',
 'h3')), p AS (SELECT *, {", ".join(f"last_value(CASE WHEN lvl = {k} THEN {{'o': ord, 'r': rid, 's': font_size, 'w': font_weight, 't': tag}} END IGNORE NULLS) OVER (PARTITION BY capture_id, parent ORDER BY ord, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p{k}" for k in (1, 2))} FROM h),
 u AS (SELECT *, list_max(list_filter([CASE WHEN lvl > 1 THEN p1 END, CASE WHEN lvl > 2 THEN p2 END],
 lambda x: x IS NOT NULL)) AS up FROM p)
 SELECT rid, up.t AS parent_heading FROM u WHERE up IS NOT NULL AND (font_size > up.s OR
 (font_size = up.s AND font_weight >= up.w))""",
)
def _(spark, d):
    out = da.heading_hierarchy(ex(spark, d), ["capture_id", "parent"], ["ord", "rid"])
    return out.select("rid", "parent_heading")


@query(
    "spatial_rhythm",
    f"""WITH g AS (SELECT rid, capture_id, parent, grp, y - lag(y + height) OVER (PARTITION BY capture_id,
 parent, grp ORDER BY y, x, ord, rid) AS gap, count(*) OVER (PARTITION BY capture_id, parent, grp) AS n
 FROM {EX}), m AS (SELECT capture_id, parent, grp, median(gap) AS median_gap FROM g GROUP BY ALL)
 SELECT rid, gap, median_gap FROM g JOIN m USING (capture_id, parent, grp) WHERE n >= 4 AND
 median_gap > 0 AND abs(gap - median_gap) > greatest(4.0, abs(median_gap) * 0.25)""",
)
def _(spark, d):
    out = da.spatial_rhythm(ex(spark, d), ["capture_id", "parent", "grp"], "rid")
    return out.select("rid", "gap", "median_gap")


_NAV = """
SELECT o_orderkey, 'nav' || CAST(o_custkey % 97 AS VARCHAR(20)) AS identity, o_orderstatus AS state,
 CASE WHEN o_custkey % 97 % 3 = 0 AND o_orderkey % 2 = 0 THEN '/b,/a,/c'
  WHEN o_custkey % 97 % 5 = 0 AND o_orderkey % 2 = 0 THEN '/a,/b,/d' ELSE '/a,/b,/c' END AS dest
FROM {orders}
"""


@query(
    "navigation_continuity",
    f"""SELECT identity, state, count(*) AS page_count FROM {duck(_NAV)} GROUP BY ALL HAVING count(*) >= 2
 AND count(DISTINCT list_sort(string_split(dest, ','))) = 1 AND count(DISTINCT dest) > 1""",
)
def _(spark, d):
    n = view(spark, d, _NAV).withColumn("destinations", F.split("dest", ","))
    return da.navigation_continuity(n, ["identity", "state"]).select(
        "identity", "state", "page_count"
    )


@query(
    "geometry",
    f"""WITH e AS (SELECT *, 'k' || okey % 200 AS sel, CASE WHEN lno = 1 THEN 'sticky' WHEN lno = 2 THEN
 'fixed' ELSE 'static' END AS pos FROM {EX}), c AS (SELECT capture_id, sel, max(pos) AS cp FROM e
 GROUP BY ALL) SELECT e.rid, unnest(list_filter([
 CASE WHEN disc / 20 > 0.1 AND e.lno <> 5 THEN CASE WHEN cp IN ('sticky', 'fixed') THEN
 'runtime-sticky-occlusion' ELSE 'runtime-element-occluded' END END,
 CASE WHEN (((x < -1 OR x + width > 1025) AND okey % 3 <> 0) OR (pos IN ('fixed', 'sticky') AND
 (y < -1 OR y + height > 20001) AND okey % 5 <> 0)) AND partkey % 4 <> 0 THEN 'runtime-offscreen' END],
 lambda v: v IS NOT NULL)) AS code FROM e LEFT JOIN c ON c.capture_id = e.capture_id AND
 disc / 20 > 0.1 AND c.sel = CASE WHEN e.lno = 5 THEN '' ELSE 'k' || partkey % 300 END""",
)
def _(spark, d):
    e = ex(spark, d)
    e = e.select(
        "rid", "capture_id", "x", "y", "width", "height",
        F.expr("'k' || okey % 200").alias("selector"),
        F.expr("CASE WHEN lno = 1 THEN 'sticky' WHEN lno = 2 THEN 'fixed' ELSE 'static' END").alias(
            "position"
        ),
        F.expr("CASE WHEN lno = 5 THEN '' ELSE 'k' || partkey % 300 END").alias("occluded_by"),
        (F.col("disc") / 20).alias("occluded_fraction"),
        F.expr("okey % 3 = 0").alias("inside_scroll_x"),
        F.expr("okey % 5 = 0").alias("inside_scroll_y"),
        F.expr("partkey % 4 = 0").alias("scroll_region"),
        F.lit(1024).alias("viewport_width"),
        F.lit(20000).alias("viewport_height"),
    )
    return da.geometry(e).select("rid", "code")


@query(
    "targets_focus",
    f"""SELECT rid, unnest(list_filter([
 CASE WHEN partkey % 9 = 0 AND okey % 3 <> 0 AND NOT (okey % 3 = 1 AND partkey % 2 = 0) THEN
  'runtime-dialog-modality' END,
 CASE WHEN live AND small AND NOT ex AND st = 'unresolved' THEN 'runtime-target-spacing-unresolved' END,
 CASE WHEN live AND small AND NOT ex AND st NOT IN ('clear', 'unresolved') THEN 'runtime-target-size' END,
 CASE WHEN live AND foc AND NOT shown THEN 'runtime-focus-visible' END,
 CASE WHEN live AND foc AND shown AND qty < 20 THEN 'runtime-focus-appearance-guidance' END],
 lambda v: v IS NOT NULL)) AS code FROM (SELECT *, lno <= 3 AND okey % 10 <> 0 AS live, width < 24 OR
 height < 24 AS small, partkey % 6 = 0 AS ex, CASE okey % 4 WHEN 0 THEN 'clear' WHEN 1 THEN 'unresolved'
 WHEN 2 THEN 'intersects' ELSE '' END AS st, suppkey % 2 = 0 AS foc, okey % 5 <> 0 AND partkey % 7 <> 0
 AS shown FROM {EX})""",
)
def _(spark, d):
    e = ex(spark, d)
    b = lambda s: F.expr(s)
    e = e.select(
        "rid", "width", "height", "role", "okey", "partkey", "suppkey", "qty",
        F.expr("CASE WHEN lno = 3 THEN 'action' ELSE 'region' END").alias("kind"),
        b("okey % 10 = 0").alias("disabled"),
        b("suppkey % 2 = 0").alias("focused"),
    )
    e = with_measurements(
        e,
        openDialog=b("partkey % 9 = 0"),
        dialogModalIntent=b("okey % 3 <> 0"),
        modalDialog=b("okey % 3 = 1"),
        dialogFocusContained=b("partkey % 2 = 0"),
        targetException=b("CASE WHEN partkey % 6 = 0 THEN 'inline' ELSE 'other' END"),
        targetSpacing=F.struct(
            b(
                "CASE okey % 4 WHEN 0 THEN 'clear' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'intersects' END"
            ).alias("status")
        ),
        focusIndicator=F.struct(
            b("okey % 5 <> 0").alias("visible"),
            F.lit(True).alias("changed"),
            F.lit(True).alias("distinguishable"),
            b("CASE WHEN partkey % 7 = 0 THEN array() ELSE array('outline') END")
            .cast("array<string>")
            .alias("perceptibleProperties"),
            F.col("qty").alias("area"),
            F.lit(20.0).alias("minimum_area"),
        ),
    )
    return da.targets_focus(e).select("rid", "code")


# ---- colour ----------------------------------------------------------------------------

_LIN = "CASE WHEN ({0}) <= 0.04045 THEN ({0}) / 12.92 ELSE pow((({0}) + 0.055) / 1.055, 2.4) END"


def _lin(x: str) -> str:
    return _LIN.format(x)


_COLORS = """
SELECT o_orderkey AS k, CASE o_orderkey % 6
 WHEN 0 THEN 'rgb(' || CAST(o_custkey % 256 AS VARCHAR(20)) || ', 10, 200)'
 WHEN 1 THEN 'RGBA(' || CAST(o_custkey % 256 AS VARCHAR(20)) || ' 10 200 / 50%)'
 WHEN 2 THEN '#0a' || CAST(10 + o_custkey % 90 AS VARCHAR(20)) || 'ff'
 WHEN 3 THEN 'transparent'
 WHEN 4 THEN 'color(srgb-linear 0.25 0.5 ' || CAST((o_custkey % 4) / 4E0 AS VARCHAR(20)) || ')'
 ELSE 'currentcolor' END AS css, o_custkey % 256 AS c, 10 + o_custkey % 90 AS h
FROM {orders}
"""


@query(
    "color_normalize",
    f"""SELECT k, round(CASE k % 6 WHEN 0 THEN {_lin('c / 255')} WHEN 1 THEN {_lin('c / 255')}
 WHEN 2 THEN {_lin('10 / 255')} WHEN 3 THEN 0 WHEN 4 THEN 0.25 END, 6) AS r,
 round(CASE k % 6 WHEN 0 THEN {_lin('10 / 255')} WHEN 1 THEN {_lin('10 / 255')} WHEN 2 THEN
 {_lin("CAST('0x' || h AS INT) / 255")} WHEN 3 THEN 0 WHEN 4 THEN 0.5 END, 6) AS g,
 CASE k % 6 WHEN 1 THEN 0.5 WHEN 3 THEN 0.0 WHEN 5 THEN NULL ELSE 1.0 END AS a FROM {duck(_COLORS)}""",
)
def _(spark, d):
    c = view(spark, d, _COLORS).withColumn("v", normalize_color(F.col("css")))
    return c.select(
        "k", F.round("v.r", 6).alias("r"), F.round("v.g", 6).alias("g"), F.col("v.a").alias("a")
    )


_PAINT = """
SELECT l_orderkey AS ok, l_partkey AS pk, l_linenumber AS ln, l_orderkey % 256 AS fg,
 l_partkey % 256 AS bg, (l_suppkey % 4) / 4E0 AS veil, CAST(12 + l_linenumber * 3 AS DOUBLE) AS size,
 CASE WHEN l_partkey % 2 = 0 THEN 700E0 ELSE 400E0 END AS weight FROM {lineitem}
"""


def _paint(spark, d):
    raw = F.expr(
        "array(CASE WHEN ok % 17 = 0 THEN 'inherit' ELSE 'rgb(' || fg || ',' || fg || ',' || fg || ')' END,"
        "'rgba(255,255,255,' || veil || ')',"
        "CASE WHEN pk % 19 = 0 THEN 'rgba(0,0,0,0.5)' ELSE 'rgb(' || bg || ',0,0)' END)"
    )
    p = view(spark, d, _PAINT).withColumn("c", normalize_colors(raw))
    return p.select(
        F.expr("ok % 11 <> 0").alias("painted"),
        F.expr("CASE WHEN pk % 13 = 0 THEN array('gradient') ELSE array() END")
        .cast("array<string>")
        .alias("unresolved"),
        F.get("c", 0).alias("foreground"),
        F.slice("c", 2, 2).alias("layers"),
        "size",
        "weight",
        F.expr("ok % 5 = 0").alias("disabled"),
    )


_PAINT_SQL = f"""
WITH p AS (SELECT *, {_lin('fg / 255')} AS f, {_lin('bg / 255')} AS b0 FROM {duck(_PAINT)}),
 q AS (SELECT *, veil + b0 * (1 - veil) AS br, veil AS bo, 0.2126 * (veil + b0 * (1 - veil)) +
  0.7874 * veil AS lb FROM p),
 z AS (SELECT *, (greatest(f, lb) + 0.05) / (least(f, lb) + 0.05) AS ratio, CASE WHEN size >= 24 OR
  (weight >= 700 AND size >= 14 * 96 / 72) THEN 3.0 ELSE 4.5 END AS need FROM q)
SELECT CASE WHEN ok % 11 = 0 THEN 'ok' WHEN pk % 13 = 0 THEN 'runtime-color-unresolved:stack' WHEN
 ok % 17 = 0 THEN 'runtime-color-unresolved:missing-normalized-color' WHEN pk % 19 = 0 THEN
 'runtime-color-unresolved:translucent' WHEN ok % 5 = 0 THEN 'ok' WHEN ratio + 1e-9 < need THEN
 'runtime-contrast' ELSE 'ok' END AS verdict, count(*) AS n FROM z GROUP BY 1"""


@query("contrast", _PAINT_SQL)
def _(spark, d):
    out = da.contrast(_paint(spark, d))
    return _n(out.select(F.coalesce("verdict", F.lit("ok")).alias("verdict")), "verdict")


@query("paint_memo", _PAINT_SQL)
def _(spark, d):
    out = da.paint_memo(_paint(spark, d))
    return _n(out.select(F.coalesce("verdict", F.lit("ok")).alias("verdict")), "verdict")


@query(
    "focus_indicator",
    """SELECT perceptible, count(*) AS n FROM (SELECT array_to_string(list_filter([
 CASE WHEN o_orderkey % 2 = 0 THEN 'backgroundColor' END,
 CASE WHEN o_orderkey % 3 = 0 THEN 'borderTopColor' END,
 CASE WHEN o_orderkey % 5 = 0 THEN 'outline' END,
 CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 1 THEN 'boxShadow' END],
 lambda x: x IS NOT NULL), ',') AS perceptible FROM orders) GROUP BY perceptible""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    pairs = {
        "backgroundColor": ("white", "#ffffff", F.when(k % 2 == 0, "#000000").otherwise("#ffffff")),
        "borderTopWidth": ("", "1px", F.lit("1px")),
        "borderTopColor": (
            "",
            "#ffffff",
            # The new border must contrast with the old one over its own background.
            F.when(k % 3 == 0, "#000080").otherwise("#ffffff"),
        ),
        "outlineStyle": ("", "none", F.when(k % 5 == 0, "solid").otherwise("none")),
        "outlineWidth": ("", "0px", F.when(k % 5 == 0, "2px").otherwise("0px")),
        "outlineColor": ("", "#ffffff", F.lit("rgb(0, 0, 128)")),
        "boxShadow": (
            "",
            "none",
            F.when((k % 7 == 0) & (k % 2 == 1), "rgb(0, 0, 0) 0px 0px 2px").otherwise("none"),
        ),
    }
    base = F.create_map(*[x for n, (_, b, _f) in pairs.items() for x in (F.lit(n), F.lit(b))])
    foc = F.create_map(*[x for n, (_, _b, f) in pairs.items() for x in (F.lit(n), f)])
    o = table(spark, d, "orders").select(base.alias("baseline"), foc.alias("focused"))
    out = da.focus_indicator(o)
    return _n(out.select(F.array_join("perceptible", ",").alias("perceptible")), "perceptible")


@query(
    "diagnostic_findings",
    """SELECT severity, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(floor(value) AS
 BIGINT) AS v, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS
 severity FROM events) GROUP BY severity""",
)
def _(spark, d):
    e = table(spark, d, "events").select(
        "user_id", F.floor("value").alias("v"), "event_type",
        F.expr(
            "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END"
        ).alias("severity"),
    )
    out = da.diagnostic_findings(e, ["user_id", "event_type", "v", "severity"])
    return _n(out, "severity")


@query(
    "ownership_groups",
    f"""SELECT owner, grp, count(*) AS members FROM {EX} WHERE lno <> 3 GROUP BY ALL HAVING
 count(*) >= 3""",
)
def _(spark, d):
    e = ex(spark, d).withColumn("owner_confidence", F.when(F.col("lno") == 3, 0.9).otherwise(1.0))
    return da.ownership_groups(e)


@query(
    "semantic_coverage",
    f"""SELECT capture_id, count(*) AS elements, count(*) FILTER (okey % 3 = 0) AS grouped,
 count(*) FILTER (lno % 3 = 0) AS paint_resolved, count(*) FILTER (lno % 3 = 1) AS paint_unresolved,
 count(*) FILTER (lno % 3 = 2) AS unobserved FROM {EX} GROUP BY capture_id""",
)
def _(spark, d):
    e = ex(spark, d).withColumns(
        {
            "grouped": F.expr("okey % 3 = 0"),
            "paint": F.expr("CASE lno % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'unresolved' END"),
        }
    )
    return da.semantic_coverage(e, ["capture_id"])


@query(
    "capture_coverage",
    """SELECT count(*) AS requested, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER
 (o_orderstatus = 'P') AS failed, count(*) FILTER (o_custkey % 9 = 0) AS truncated FROM orders""",
)
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'open' END").alias(
            "status"
        ),
        F.expr("o_custkey % 9 = 0").alias("truncated"),
    )
    return da.capture_coverage(o)


# ---- spatial ---------------------------------------------------------------------------

_RECTS = f"""
SELECT rid AS selector, capture_id, parent, ord, tag, role, lno, okey, grp,
 x AS left_, y AS top_, x + width AS right_, y + height AS bottom_
FROM ({ELEMENTS}) e
"""
RX = (
    f"(SELECT * RENAME (left_ AS \"left\", top_ AS top, right_ AS \"right\", bottom_ AS bottom) "
    f"FROM {duck(_RECTS)})"
)


def rects(spark, d, **how):
    r = view(spark, d, _RECTS, **how)
    for c in ("left", "top", "right", "bottom"):
        r = r.withColumnRenamed(c + "_", c)
    return r


@query(
    "grid_index",
    f"""SELECT capture_id, cx, cy, count(*) AS n FROM (SELECT capture_id, unnest(range(CAST(floor("left" /
 64) AS BIGINT), CAST(floor("right" / 64) AS BIGINT) + 1)) AS cx, y0, y1 FROM (SELECT *,
 CAST(floor(top / 64) AS BIGINT) AS y0, CAST(floor(bottom / 64) AS BIGINT) AS y1 FROM {RX})) t,
 LATERAL (SELECT unnest(range(y0, y1 + 1)) AS cy) GROUP BY ALL""",
)
def _(spark, d):
    return _n(geo.grid_index(rects(spark, d)), "capture_id", "cx", "cy")


@query(
    "grid_levels",
    f"""SELECT capture_id, level, cx, cy, count(*) AS n FROM (SELECT capture_id, level, unnest(range(CAST(floor(
 "left" / s) AS BIGINT), CAST(floor("right" / s) AS BIGINT) + 1)) AS cx, CAST(floor(top / s) AS BIGINT) AS y0,
 CAST(floor(bottom / s) AS BIGINT) AS y1 FROM (SELECT *, 64 * 2 ** level AS s FROM (SELECT *, CAST(CASE WHEN
 greatest("right" - "left", bottom - top) <= 64 THEN 0 WHEN greatest("right" - "left", bottom - top) <= 128 THEN 1
 WHEN greatest("right" - "left", bottom - top) <= 256 THEN 2 END AS INT) AS level FROM {RX}))) t,
 LATERAL (SELECT unnest(range(y0, y1 + 1)) AS cy) GROUP BY ALL""",
)
def _(spark, d):
    return _n(geo.grid_levels(rects(spark, d)), "capture_id", "level", "cx", "cy")




@query(
    "target_spacing",
    f"""WITH t AS (SELECT *, ("left" + "right") / 2 AS mx, (top + bottom) / 2 AS my FROM {RX}),
 p AS (SELECT a.selector, CASE WHEN b."right" - b."left" < 24 OR b.bottom - b.top < 24 THEN
  sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2) - 24 ELSE sqrt((a.mx - greatest(b."left", least(a.mx,
  b."right"))) ** 2 + (a.my - greatest(b.top, least(a.my, b.bottom))) ** 2) - 12 END AS gap FROM t a
  JOIN t b ON a.capture_id = b.capture_id AND a.selector <> b.selector AND b.top < a.bottom + 152 AND
  b.bottom > a.top - 152)
SELECT t.selector, CASE WHEN g < 0 THEN 'intersects' ELSE 'clear' END AS spacing, CASE WHEN g < 12 THEN
 round(g, 2) END AS near_gap FROM t LEFT JOIN (SELECT selector, min(gap) AS g FROM p GROUP BY selector)
 USING (selector)""",
)
def _(spark, d):
    r = rects(spark, d, large=()).select("selector", "capture_id", "left", "top", "right", "bottom")
    out = geo.target_spacing(r)
    return out.select(
        "selector", "spacing", F.when(F.col("shape_gap") < 12, F.col("shape_gap")).alias("near_gap")
    )


@query(
    "text_collision",
    f"""SELECT selector, max(w * h) AS area FROM (SELECT a.selector, least(a."right", b."right") -
 greatest(a."left", b."left") AS w, least(a.bottom, b.bottom) - greatest(a.top, b.top) AS h FROM {RX} a
 JOIN {RX} b ON a.capture_id = b.capture_id AND b.ord > a.ord AND a.parent <> b.parent) WHERE w > 1 AND
 h > 1 GROUP BY selector HAVING max(w * h) > 4""",
)
def _(spark, d):
    # Elements of one parent stand for one DOM branch here.
    r = rects(spark, d, large=()).withColumn("path", F.col("parent"))
    return geo.text_collision(r).select("selector", "area")


@query(
    "occlusion_candidates",
    f"""WITH t AS (SELECT * FROM {RX} WHERE lno = 1), o AS (SELECT *, okey % 10 AS z FROM {RX} WHERE
 lno = 3), i AS (SELECT *, least(2.0, ("right" - "left") / 4) AS ix, least(2.0, (bottom - top) / 4) AS iy
 FROM t), p AS (SELECT selector, capture_id, unnest([{{'x': ("left" + "right") / 2, 'y': (top + bottom) /
 2, 'i': 0}}, {{'x': "left" + ix, 'y': top + iy, 'i': 1}}, {{'x': "right" - ix, 'y': top + iy, 'i': 2}},
 {{'x': "left" + ix, 'y': bottom - iy, 'i': 3}}, {{'x': "right" - ix, 'y': bottom - iy, 'i': 4}}]) AS q
 FROM i), c AS (SELECT p.selector, q.i AS i, o.selector AS cover, z FROM p JOIN o ON p.capture_id =
 o.capture_id AND q.x >= o."left" AND q.x < o."right" AND q.y >= o.top AND q.y < o.bottom
 QUALIFY row_number() OVER (PARTITION BY p.selector, q.i ORDER BY z DESC, o.selector DESC) = 1),
 n AS (SELECT selector, cover, count(*) AS k FROM c GROUP BY ALL)
SELECT selector, max(k) / 5 AS occluded_fraction FROM n GROUP BY selector""",
)
def _(spark, d):
    r = rects(spark, d)
    o = r.where("lno = 3").withColumn("z", F.col("okey") % 10)
    out = geo.occlusion_candidates(r.where("lno = 1"), o)
    return out.select("selector", "occluded_fraction")


@query(
    "peer_groups",
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY capture_id, parent ORDER BY top, bottom) AS r
  FROM (SELECT capture_id, parent, top, bottom, count(*) AS n FROM {RX} GROUP BY ALL)),
 op(capture_id, parent, r) AS (SELECT DISTINCT capture_id, parent, 1::BIGINT FROM s UNION ALL SELECT o.capture_id,
  o.parent, min(t.r) FROM op JOIN s o USING (capture_id, parent, r) JOIN s t ON t.capture_id = o.capture_id AND
  t.parent = o.parent AND t.r > o.r AND NOT coalesce(least(t.bottom - t.top, o.bottom - o.top) > 0 AND
  (least(t.bottom, o.bottom) - t.top) / least(t.bottom - t.top, o.bottom - o.top) >= 0.5, FALSE) GROUP BY ALL),
 a AS (SELECT s.capture_id, s.parent, s.top, s.bottom, s.n, max(op.r) AS o FROM s JOIN op ON op.capture_id =
  s.capture_id AND op.parent = s.parent AND op.r <= s.r GROUP BY ALL),
 k AS (SELECT capture_id, parent, o, sum(n) AS members FROM a GROUP BY ALL HAVING sum(n) >= 3)
 SELECT e.selector, e.capture_id, e.parent, f.top AS group_top, f.bottom AS group_bottom, CAST(k.members AS BIGINT) AS members
 FROM {RX} e JOIN a USING (capture_id, parent, top, bottom) JOIN k USING (capture_id, parent, o)
 JOIN s f ON f.capture_id = e.capture_id AND f.parent = e.parent AND f.r = o""",
)
def _(spark, d):
    g = peers.peer_groups(rects(spark, d), ["capture_id", "parent"])
    return g.select("selector", "capture_id", "parent", "group_top", "group_bottom", "members")


@query(
    "peer_deviation",
    f"""WITH m AS (SELECT selector, capture_id, parent, okey % 40 AS g, CASE WHEN lno = 2 THEN 9.0 ELSE
 CAST(lno % 2 AS DOUBLE) END AS top, 50.0 + lno % 2 AS bottom FROM {RX}), l AS (SELECT selector,
 capture_id, parent, g, unnest([{{'k': 0, 'v': top}}, {{'k': 1, 'v': (top + bottom) / 2}}, {{'k': 2, 'v':
 bottom}}]) AS x FROM m), o AS (SELECT a.selector, a.x.k AS k, a.x.v AS v, (SELECT CASE WHEN
 max(b.x.v) - min(b.x.v) <= 2 AND count(*) >= 2 THEN median(b.x.v) END FROM l b WHERE b.capture_id =
 a.capture_id AND b.parent = a.parent AND b.g = a.g AND b.x.k = a.x.k AND b.selector <> a.selector) AS md
 FROM l a) SELECT selector, coalesce(min(abs(v - md)), 0.0) AS deviation FROM o GROUP BY selector""",
)
def _(spark, d):
    m = rects(spark, d).select(
        "selector", "capture_id", "parent", F.expr("okey % 40").alias("g"),
        F.expr("CASE WHEN lno = 2 THEN 9E0 ELSE CAST(lno % 2 AS DOUBLE) END").alias("top"),
        F.expr("50E0 + lno % 2").alias("bottom"),
    )
    out = geo.peer_deviation(m, ["capture_id", "parent", "g"], "selector")
    return out.select("selector", "deviation")


@query(
    "chart_baseline",
    f"""WITH b AS (SELECT okey, selector, lno * 60.0 AS l, lno * 60.0 + 20 + okey % 3 AS r, top, bottom FROM
 {RX} WHERE bottom - top > 4), g AS (SELECT *, lag(r) OVER (PARTITION BY okey ORDER BY l, selector) AS pr
 FROM b) SELECT okey, count(*) AS bar_count, max(bottom) - min(bottom) AS baseline_spread FROM g GROUP BY
 okey HAVING count(*) >= 3 AND bool_and(pr IS NULL OR l >= pr - 1) AND max(r - l) - min(r - l) <=
 greatest(4.0, min(r - l) * 0.5) AND max(bottom - top) - min(bottom - top) > 4""",
)
def _(spark, d):
    b = rects(spark, d).select(
        "okey", "selector", (F.col("lno") * 60.0).alias("left"),
        (F.col("lno") * 60.0 + 20 + F.col("okey") % 3).alias("right"), "top", "bottom",
    )
    return geo.chart_baseline(b, ["okey"], "selector").drop("height_spread")


@query(
    "sibling_equivalence",
    f"""SELECT capture_id, parent || ':' || tag || ':' || role AS equivalence_group, count(*) AS members,
 CASE WHEN bool_or(grp = 'gR' AND lno = 1) THEN 'horizontal' ELSE 'vertical' END AS axis FROM {RX}
 GROUP BY capture_id, parent, tag, role HAVING count(*) >= 3""",
)
def _(spark, d):
    r = rects(spark, d).withColumn("row_flex", F.expr("grp = 'gR' AND lno = 1"))
    return geo.sibling_equivalence(r)


_FRAGS = """
SELECT o_custkey AS parent, o_orderkey AS ord, CASE o_orderkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'px'
 WHEN 2 THEN '12' WHEN 3 THEN 'word ' WHEN 4 THEN '-dash' ELSE 'abc' END AS raw,
 CAST(o_orderkey % 3 AS DOUBLE) AS off FROM {orders}
"""


@query(
    "adjacent_text",
    f"""WITH f AS (SELECT *, lag(raw) OVER w AS pr, lag(off) OVER w AS po FROM {duck(_FRAGS)} WINDOW w AS
 (PARTITION BY parent ORDER BY ord)) SELECT parent, count(*) AS boundary_count, min(10 + off - 10 - po) AS
 minimum_gap FROM f WHERE pr IS NOT NULL AND trim(raw) <> '' AND trim(pr) <> '' AND
 NOT ends_with(pr, ' ') AND off - po BETWEEN -0.5 AND 1 AND regexp_matches(pr, '[\\p{{L}}\\p{{N}}%]$')
 AND regexp_matches(raw, '^[\\p{{L}}\\p{{N}}]') AND NOT (pr = '12' AND raw = 'px') GROUP BY parent""",
)
def _(spark, d):
    f = view(spark, d, _FRAGS).select(
        "parent", "ord", "raw", (F.col("off") + 10).alias("left"), (F.col("off") + 10).alias("right"),
        F.lit(0.0).alias("top"), F.lit(10.0).alias("bottom"),
    )
    return geo.adjacent_text(f, ["parent"], ["ord"])


@query(
    "group_bounds",
    f"""SELECT capture_id, parent, min("left") AS x, min(top) AS y, max("right") - min("left") AS width,
 max(bottom) - min(top) AS height FROM {RX} GROUP BY ALL""",
)
def _(spark, d):
    return geo.group_bounds(rects(spark, d), ["capture_id", "parent"])
