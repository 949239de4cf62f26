"""Per-element layout audit: thresholds over the measurement struct, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M = "m."


def num(key: str) -> Column:
    return F.coalesce(F.col(M + key), F.lit(0.0))


def raw(key: str) -> Column:
    return F.col(M + key)


def on(key: str) -> Column:
    return F.coalesce(F.col(M + key), F.lit(False))


def off(key: str) -> Column:
    """The flag was captured and is false."""
    return F.coalesce(~F.col(M + key), F.lit(False))


def _hit(cond: Column, code, category: str, severity, **metrics: Column) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    body = F.to_json(F.struct(*[metrics[k].alias(k) for k in sorted(metrics)])) if metrics else F.lit("{}")
    return F.when(
        cond,
        F.struct(
            lift(code).alias("code"),
            F.lit(category).alias("category"),
            lift(severity).alias("severity"),
            body.alias("metrics"),
        ),
    )


def alignment() -> list[Column]:
    dev = num("layoutDeviation")
    flow = ~off("isTextFlow")
    base = F.when(flow, num("fontBaselineDeviation")).otherwise(0.0)
    mixed = flow & on("fontMismatch")
    return [
        _hit(dev > 4, "runtime-layout-misalignment", "layout", "warning", deviation_px=dev),
        _hit(
            (base > 3) | mixed,
            "runtime-font-misalignment",
            "typography",
            "warning",
            baseline_deviation_px=F.when(base > 3, base),
            font_family=F.when(mixed, raw("fontFamily")),
            expected_font_family=F.when(mixed, raw("expectedFontFamily")),
        ),
    ]


def visual_content() -> list[Column]:
    bars, spread = F.floor(num("chartBarCount")), num("chartBarBaselineSpread")
    hits, joins = F.floor(num("textCollisionCount")), F.floor(num("unseparatedTextBoundaryCount"))
    return [
        _hit(
            (bars >= 3) & (spread > 4),
            "runtime-chart-baseline-misalignment",
            "layout",
            "warning",
            bar_count=bars,
            baseline_spread_px=spread,
        ),
        _hit(
            hits != 0,
            "runtime-text-collision",
            "layout",
            "error",
            collision_count=hits,
            max_collision_area_px2=num("maxTextCollisionArea"),
            colliding_selector=raw("collidingTextSelector"),
        ),
        _hit(
            joins != 0,
            "runtime-text-separation",
            "typography",
            "warning",
            boundary_count=joins,
            minimum_gap_px=num("minimumAdjacentTextGap"),
        ),
    ]


def _unmanaged_clip() -> Column:
    ax = (num("ancestorClipOverflowInlineStart") > 1) | (num("ancestorClipOverflowInlineEnd") > 1)
    ay = (num("ancestorClipOverflowBlockStart") > 1) | (num("ancestorClipOverflowBlockEnd") > 1)
    return on("clippedByAncestor") & (
        (ax & ~on("insideScrollRegionX")) | (ay & ~on("insideScrollRegionY")) | ~(ax | ay)
    )


def clipping() -> list[Column]:
    text = on("hasText")

    def cut(axis: str, extent: str) -> Column:
        hides = F.coalesce(F.lower(raw(f"overflow{axis}")).isin("clip", "hidden"), F.lit(False))
        too_big = num(f"scroll{extent}") > num(f"client{extent}") + 1
        return text & ~on(f"containsScrollRegion{axis}") & hides & too_big

    unmanaged = _unmanaged_clip()
    meant = on("intentionalTruncation")
    scrolls = on("containsScrollRegionX") | on("containsScrollRegionY")
    return [
        _hit(
            cut("X", "Width") | cut("Y", "Height") | (text & unmanaged),
            F.when(meant, "runtime-text-truncated").otherwise("runtime-text-clipped"),
            "overflow",
            F.when(meant, "info").otherwise("error"),
            client_width_px=num("clientWidth"),
            scroll_width_px=num("scrollWidth"),
            client_height_px=num("clientHeight"),
            scroll_height_px=num("scrollHeight"),
            clipping_ancestor=raw("clippingAncestorSelector"),
        ),
        _hit(
            (on("descendantClipped") & ~scrolls) | (unmanaged & ~text),
            "runtime-component-clipped",
            "overflow",
            "error",
        ),
    ]


def responsive() -> list[Column]:
    cw, sw, ch, sh = (num(k) for k in ("clientWidth", "scrollWidth", "clientHeight", "scrollHeight"))
    hid_x = F.coalesce(
        raw("concealedInteractiveDescendantCountX"), num("concealedInteractiveDescendantCount")
    )
    hid_y = num("concealedInteractiveDescendantCountY")
    links, groups = num("navigationLinkCount"), num("navigationGroupCount")
    x = on("isScrollRegionX") & (hid_x > 0) & (cw > 0) & (sw > cw + 1)
    y = on("isScrollRegionY") & (hid_y > 0) & (links == 0) & (ch > 0) & (sh > ch + 1)
    t = raw("table")
    flag = lambda k, want: F.coalesce(t[k] == want, F.lit(False))
    return [
        _hit(
            x | y,
            "runtime-interactive-scroll-concealment",
            "responsive",
            "error",
            concealed_action_count=F.when(x, hid_x).otherwise(hid_y),
            ratio=F.bround(F.when(x, sw / cw).otherwise(sh / ch), 2),
        ),
        _hit(
            flag("scrollable", True)
            & flag("scrollbarVisible", False)
            & flag("affordance", False)
            & F.coalesce(t["rowCount"] >= 2, F.lit(False))
            & F.coalesce(t["headerCount"] >= 1, F.lit(False)),
            "runtime-responsive-table-inaccessible",
            "responsive",
            "error",
            header_count=t["headerCount"],
            row_count=t["rowCount"],
        ),
        _hit(
            (links > 12) & (on("isScrollRegionX") | on("isScrollRegionY")) & (groups < 2),
            "runtime-navigation-choice-overload",
            "navigation",
            "warning",
            link_count=links,
            group_count=groups,
        ),
    ]


def focus_obscured() -> list[Column]:
    v = raw("focusVisibility")
    part = F.coalesce(v["occludedFraction"], F.lit(0.0))
    seen = F.coalesce(v["fullyVisible"] == F.lit(False), F.lit(False))
    named = F.coalesce(F.trim(v["occludedBy"]) != "", F.lit(False))
    return [
        _hit(
            seen & named & (part >= 0.2),
            "runtime-focus-obscured",
            "accessibility",
            "error",
            occluded_by=v["occludedBy"],
            occluded_fraction=F.bround(part, 2),
        )
    ]


def _uneven(a: Column, b: Column) -> Column:
    return F.abs(a - b) > F.greatest(F.lit(4.0), F.greatest(a, b) * 0.35)


def _pair(kind: str, logical: tuple[str, str], physical: tuple[str, str]):
    a, b = (raw(f"{kind}{s}") for s in logical)
    c, d = (raw(f"{kind}{s}") for s in physical)
    whole = a.isNotNull() & b.isNotNull()
    return F.when(whole, a).otherwise(c), F.when(whole, b).otherwise(d)


def spacing() -> list[Column]:
    text, box, vis = on("hasText"), on("isBoxControl"), on("isVisualContainer")
    axis_keys = [f"{p}ScrollRegion{a}" for p in ("is", "contains") for a in "XY"]
    by_axis = F.lit(False)
    for k in axis_keys:
        by_axis = by_axis | raw(k).isNotNull()
    legacy = ~by_axis & (on("isScrollRegion") | on("containsScrollRegion"))
    cross = {a: legacy | on(f"isScrollRegion{a}") | on(f"containsScrollRegion{a}") for a in "XY"}
    vertical = F.coalesce(raw("writingMode").rlike("^(?:vertical|sideways)"), F.lit(False))
    cross_inline = F.when(vertical, cross["Y"]).otherwise(cross["X"])
    cross_block = F.when(vertical, cross["X"]).otherwise(cross["Y"])
    logical = [raw(f"textInset{s}") for s in ("InlineStart", "InlineEnd", "BlockStart", "BlockEnd")]
    physical = [raw(f"textInset{s}") for s in ("Top", "Right", "Bottom", "Left")]
    whole = F.lit(True)
    for c in logical:
        whole = whole & c.isNotNull()
    inset = [F.when(whole, a).otherwise(b) for a, b in zip(logical, physical, strict=True)]
    edge = F.array_min(
        F.array(
            *[F.when(~cross_inline, c) for c in inset[:2]],
            *[F.when(~cross_block, c) for c in inset[2:]],
        )
    )
    tight = lambda cs: F.coalesce(F.array_min(F.array(*cs)) < 8, F.lit(False))
    surface = vis & ~off("hasVisualSurface")
    hs, he = _pair("padding", ("InlineStart", "InlineEnd"), ("Left", "Right"))
    vs, ve = _pair("padding", ("BlockStart", "BlockEnd"), ("Top", "Bottom"))
    vmin = F.when(box, 6.0).otherwise(8.0)

    def bad(a, b, least):
        known = a.isNotNull() & b.isNotNull()
        return known & F.coalesce((F.least(a, b) < least) | _uneven(a, b), F.lit(False))

    return [
        _hit(
            text & (box | vis) & ~off("isTextFlow") & F.coalesce(edge < 4, F.lit(False)),
            "runtime-text-edge-contact",
            "spacing",
            "warning",
            minimum_text_inset_px=edge,
        ),
        _hit(
            (box | (surface & ~cross_inline & tight(inset[:2]))) & bad(hs, he, F.lit(8.0)),
            "runtime-horizontal-padding",
            "spacing",
            "warning",
            inline_start_px=hs,
            inline_end_px=he,
        ),
        _hit(
            (box | (surface & ~cross_block & tight(inset[2:]))) & bad(vs, ve, vmin),
            "runtime-vertical-padding",
            "spacing",
            "warning",
            block_start_px=vs,
            block_end_px=ve,
        ),
    ]


def line_spacing() -> list[Column]:
    chars = F.length(F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+", ""))
    lines = F.floor(num("lineCount"))
    size, height, gap = num("fontSize"), num("lineHeight"), raw("minimumLineGap")
    ratio = F.when((height > 0) & (size > 0), height / size).otherwise(0.0)
    least = F.when(F.lower("tag").isin("h1", "h2", "h3", "h4", "h5", "h6"), 1.05).otherwise(1.2)
    overlap = F.coalesce(gap < -1, F.lit(False)) & (ratio > 0) & (ratio < 1)
    live = on("hasText") & on("isMultiline") & ~off("isTextFlow") & (size > 0)
    return [
        _hit(
            on("paintedText") & (chars >= 32) & (lines >= 4) & (chars <= lines * 8),
            "runtime-pathological-text-wrap",
            "typography",
            "error",
            character_count=chars,
            line_count=lines,
        ),
        _hit(
            live & (overlap | ((ratio > 0) & (ratio < least))),
            "runtime-line-spacing",
            "typography",
            F.when(overlap, "error").otherwise("warning"),
            line_height_ratio=F.bround(ratio, 3),
            minimum_ratio=least,
        ),
    ]


FAMILIES = {
    "alignment": alignment,
    "visual_content": visual_content,
    "clipping": clipping,
    "responsive": responsive,
    "focus_obscured": focus_obscured,
    "spacing": spacing,
    "line_spacing": line_spacing,
}


def audit(elements: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Element columns plus code, category, severity, metrics; modal-obscured rows are mute."""
    rows: list[Column] = []
    for name, build in FAMILIES.items():
        if families is None or name in families:
            rows += build()
    live = elements.where(~on("obscuredByModal"))
    keep = [c for c in elements.columns if c != "m"]
    return live.select(*keep, F.explode(F.array_compact(F.array(*rows))).alias("f")).select(
        *keep, "f.*", F.when(F.col("f.severity") == "info", "informational").otherwise("pending").alias("status")
    )


def clip_suppress(findings: DataFrame) -> DataFrame:
    """Drop clipped-text findings whose clipping ancestor is itself reported as clipped."""
    box = (
        findings.where("code = 'runtime-component-clipped'")
        .select("capture_id", F.col("selector").alias("_box"))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    keyed = findings.withColumn(
        "_box",
        F.when(
            F.col("code") == "runtime-text-clipped",
            F.get_json_object("metrics", "$.clipping_ancestor"),
        ),
    )
    out = keyed.join(box, ["capture_id", "_box"], "left").where(F.col("_hit").isNull())
    return out.select(*findings.columns)
