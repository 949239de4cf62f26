"""Design semantics over captured elements: contrast, drift, hierarchy, rhythm, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.functions.color import (
    WHITE,
    contrast_ratio,
    flatten_layers,
    is_large,
    normalize_colors,
    over,
    rgba_lit,
)
from siteaudit.plans.ordered import GROUP_ROWS, group_median, largest_group, ordered
from siteaudit.plans.session import cut

# Fixed values.
INTERACTIVE = (
    "button link textbox checkbox radio combobox menuitem option slider spinbutton switch tab"
).split()
TARGET_EXCEPTIONS = ["inline", "user-agent", "essential", "spacing"]
MIN_TARGET = 24
FOCUS_CONTRAST = 3.0


def judged_paint(elements: DataFrame) -> DataFrame:
    """Adds ``verdict`` (NULL = fine) and ``ratio``, row by row.

    Reads painted, unresolved array<string>, foreground RGBA, layers array<RGBA> (front first),
    size, weight, disabled.
    """
    backdrop = flatten_layers(F.col("layers"))
    ratio = contrast_ratio(over(F.col("foreground"), F.col("_back")), F.col("_back"))
    need = F.when(is_large(F.col("size"), F.col("weight")), 3.0).otherwise(4.5)
    gap = (
        F.when(F.size("unresolved") > 0, "stack")
        .when(F.col("foreground").isNull() | F.col("layers").isNull(), "missing-normalized-color")
        .when(F.exists("layers", lambda c: c.isNull()), "ancestor-color")
        .when(F.size("layers") == 0, "missing-backdrop")
    )
    df = elements.withColumn("_gap", gap).withColumn(
        "_back", F.when(F.col("_gap").isNull(), backdrop)
    )
    df = df.withColumn("_ratio", F.when(F.col("_gap").isNull(), ratio))
    df = df.withColumn("ratio", F.bround("_ratio", 4))
    verdict = (
        F.when(~F.coalesce("painted", F.lit(False)), F.lit(None).cast("string"))
        .when(F.col("_gap").isNotNull(), F.concat(F.lit("runtime-color-unresolved:"), "_gap"))
        .when(F.col("_back.a") < 0.999, "runtime-color-unresolved:translucent")
        .when(F.coalesce("disabled", F.lit(False)), F.lit(None).cast("string"))
        .when(F.col("_ratio") + 1e-9 < need, "runtime-contrast")
    )
    return df.withColumn("verdict", verdict).drop("_gap", "_back", "_ratio")


def paint_memo(elements: DataFrame) -> DataFrame:
    """Contrast on distinct paint signatures only, joined back to the elements."""
    sig = ["painted", "unresolved", "foreground", "layers", "size", "weight", "disabled"]
    # Both readers share the rows, so colours are parsed once; rows meet and are sorted by a hash
    # of the signature, and signatures are compared where hashes are equal.
    paint = F.struct(*sig)
    keyed = cut(elements).withColumns({"_hash": F.xxhash64(paint), "_paint": paint})
    distinct = keyed.select("_hash", "_paint").distinct().select("_hash", "_paint", "_paint.*")
    done = judged_paint(distinct).select("_hash", "_paint", "ratio", "verdict")
    return keyed.join(done, ["_hash", "_paint"]).drop("_hash", "_paint")


def contrast(elements: DataFrame) -> DataFrame:
    """Verdict and ratio of every element, in its row: no shuffle.

    ``paint_memo`` gives the same where few distinct paints stand on many elements.
    """
    return judged_paint(elements)


def _drift(elements: DataFrame, group: list[str], signature: list[str]) -> DataFrame:
    """Rows differing from the one commonest signature of a group of three or more.

    Signatures are counted before anything is grouped, so group size never matters.
    """
    rows = elements.withColumn("_sig", F.struct(*signature))
    counts = rows.groupBy(*group, "_sig").agg(F.count(F.lit(1)).alias("_n"))
    top = counts.groupBy(*group).agg(F.sum("_n").alias("_all"), F.max("_n").alias("_top"))
    modal = (
        counts.join(top, group)
        .where("_n = _top AND _top >= 2 AND _all >= 3")
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_ties"), F.min("_sig").alias("_modal"))
        .where("_ties = 1")
        .select(*group, "_modal")
    )
    return rows.join(modal, group).where("NOT (_sig <=> _modal)").select(*elements.columns)


def component_drift(elements: DataFrame) -> DataFrame:
    """Elements whose style differs from their source-owned peers."""
    return _drift(
        elements,
        ["owner", "grp", "palette_role"],
        ["color", "background", "font_size", "font_weight", "radius", "height"],
    )


def palette_drift(elements: DataFrame) -> DataFrame:
    named = elements.where(F.col("palette_role") != "")
    return _drift(named, ["owner", "grp", "palette_role"], ["color", "background"])


def heading_hierarchy(
    elements: DataFrame, group: list[str], order: list[str], limit: int = GROUP_ROWS
) -> DataFrame:
    """Headings not visually smaller than the nearest preceding higher-level heading."""
    h = elements.where(F.col("tag").rlike("^h[1-6]$")).withColumn(
        "_lvl", F.substring("tag", 2, 1).cast("int")
    )
    h = h.withColumns(
        {
            f"_h{k}": F.when(
                F.col("_lvl") == k,
                F.struct(
                    F.struct(*order).alias("at"), "font_size", "font_weight", F.col("tag").alias("tag")
                ),
            )
            for k in range(1, 6)
        }
    )
    seen = ordered(
        h, group, order, {f"_p{k}": ("last_before", f"_h{k}") for k in range(1, 6)}, limit
    )
    higher = F.array_max(
        F.array_compact(F.array(*[F.when(F.col("_lvl") > k, F.col(f"_p{k}")) for k in range(1, 6)]))
    )
    seen = seen.withColumn("_up", higher)
    bad = (F.col("font_size") > F.col("_up.font_size")) | (
        (F.col("font_size") == F.col("_up.font_size"))
        & (F.col("font_weight") >= F.col("_up.font_weight"))
    )
    return seen.where(F.coalesce(bad, F.lit(False))).select(
        *elements.columns, F.col("_up.tag").alias("parent_heading")
    )


def spatial_rhythm(
    elements: DataFrame, group: list[str], unique: str, limit: int = GROUP_ROWS
) -> DataFrame:
    """Gaps to the previous sibling that stray from the group's median gap."""
    e = elements.withColumn("_bottom", F.col("y") + F.col("height"))
    largest = largest_group(e, group)
    lagged = ordered(
        e, group, ["y", "x", "ord", unique], {"_prev": ("lag", "_bottom")}, limit, largest
    )
    gaps = lagged.withColumn("gap", F.col("y") - F.col("_prev"))
    mid = group_median(gaps, group, "gap", "median_gap", limit, largest)
    size = e.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 4")
    tol = F.greatest(F.lit(4.0), F.abs("median_gap") * 0.25)
    return (
        gaps.join(mid.join(size, group), group)
        .where((F.col("median_gap") > 0) & (F.abs(F.col("gap") - F.col("median_gap")) > tol))
        .select(*elements.columns, "gap", "median_gap")
    )


def navigation_continuity(navs: DataFrame, group: list[str]) -> DataFrame:
    """Groups of captures that list one set of destinations in different orders.

    ``destinations`` is an array; min/max of its text form decide equality, so no group is
    gathered.
    """
    d = F.col("destinations")
    ok = navs.where(
        (F.size(d) >= 2) & (F.size(F.array_distinct(d)) == F.size(d)) & F.forall(d, lambda x: x != "")
    )
    order, as_set = F.to_json(d), F.to_json(F.array_sort(d))
    return (
        ok.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("page_count"),
            F.min(order).alias("_o1"),
            F.max(order).alias("_o2"),
            F.min(as_set).alias("_s1"),
            F.max(as_set).alias("_s2"),
        )
        .where("page_count >= 2 AND _s1 = _s2 AND _o1 <> _o2")
        .select(*group, "page_count", F.col("_o1").alias("first_order"), F.col("_o2").alias("last_order"))
    )


def geometry(elements: DataFrame) -> DataFrame:
    """Occluded and off-screen elements. Reads occluded_by, occluded_fraction, position,
    inside_scroll_x/y, scroll_region, viewport_width/height."""
    cover = elements.select(
        "capture_id", F.col("selector").alias("_sel"), F.col("position").alias("_pos")
    ).groupBy("capture_id", "_sel").agg(F.max("_pos").alias("_pos"))
    asked = F.when(F.col("occluded_fraction") > 0.1, F.col("occluded_by"))
    j = elements.withColumn("_sel", asked).join(cover, ["capture_id", "_sel"], "left")
    right, bottom = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    stuck = F.col("position").isin("fixed", "sticky")
    out_x = ((F.col("x") < -1) | (right > F.col("viewport_width") + 1)) & ~F.col("inside_scroll_x")
    out_y = stuck & ((F.col("y") < -1) | (bottom > F.col("viewport_height") + 1)) & ~F.col(
        "inside_scroll_y"
    )
    hits = F.array_compact(
        F.array(
            F.when(
                F.coalesce(F.col("_sel"), F.lit("")) != "",
                F.when(F.col("_pos").isin("sticky", "fixed"), "runtime-sticky-occlusion").otherwise(
                    "runtime-element-occluded"
                ),
            ),
            F.when((out_x | out_y) & ~F.col("scroll_region"), "runtime-offscreen"),
        )
    )
    return j.select(*elements.columns, F.explode(hits).alias("code"))


def targets_focus(elements: DataFrame) -> DataFrame:
    """Target size, spacing, focus and dialog checks. Reads kind, role, disabled, width, height,
    focused, measurement struct ``m``."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    m = lambda k: F.col(f"m.{k}")
    exempt = F.coalesce(F.trim(m("targetException")).isin(TARGET_EXCEPTIONS), F.lit(False))
    status = F.coalesce(F.trim(m("targetSpacing.status")), F.lit(""))
    small = (F.col("width") < MIN_TARGET) | (F.col("height") < MIN_TARGET)
    live = ((F.col("kind") == "action") | F.col("role").isin(INTERACTIVE)) & ~flag(F.col("disabled"))
    ind = m("focusIndicator")
    shown = (
        flag(ind["visible"])
        & flag(ind["changed"])
        & flag(ind["distinguishable"])
        & flag(F.size(ind["perceptibleProperties"]) > 0)
    )
    weak = flag(ind["minimum_area"] > 0) & (
        F.coalesce(ind["area"], F.lit(0.0)) < ind["minimum_area"]
    )
    focused = live & flag(F.col("focused"))
    codes = F.array_compact(
        F.array(
            F.when(
                flag(m("openDialog"))
                & flag(m("dialogModalIntent"))
                & ~(flag(m("modalDialog")) & flag(m("dialogFocusContained"))),
                "runtime-dialog-modality",
            ),
            F.when(
                live & small & ~exempt & (status == "unresolved"), "runtime-target-spacing-unresolved"
            ),
            F.when(
                live & small & ~exempt & ~status.isin("clear", "unresolved"), "runtime-target-size"
            ),
            F.when(focused & ~shown, "runtime-focus-visible"),
            F.when(focused & shown & weak, "runtime-focus-appearance-guidance"),
        )
    )
    keep = [c for c in elements.columns if c != "m"]
    return elements.select(*keep, F.explode(codes).alias("code"))


def focus_indicator(df: DataFrame) -> DataFrame:
    """Which focus styles changed perceptibly between ``baseline`` and ``focused`` (maps)."""
    b = lambda k: F.col("baseline")[k]
    f = lambda k: F.col("focused")[k]
    sides = ("Top", "Right", "Bottom", "Left")
    keys = ["backgroundColor", *[f"border{s}Color" for s in sides], "outlineColor"]
    found = r"(#[0-9a-fA-F]{3,8}\b|(?:rgba?|hsla?|oklab|oklch|color)\([^)]*\))"
    shadows = lambda c: F.regexp_extract_all(
        F.coalesce(c, F.lit("")), F.lit(found), F.lit(1)
    )
    # All colours of a row are normalised by one expression, then read back by position.
    df = df.withColumns({"_sb": shadows(b("boxShadow")), "_sf": shadows(f("boxShadow"))})
    texts = F.concat(F.array(*[b(k) for k in keys], *[f(k) for k in keys]), "_sb", "_sf")
    df = df.withColumn("_c", normalize_colors(texts))
    n = len(keys)
    old = {k: F.get("_c", i) for i, k in enumerate(keys)}
    new = {k: F.get("_c", n + i) for i, k in enumerate(keys)}
    white = rgba_lit(WHITE)
    px = lambda c: F.coalesce(F.regexp_replace(c, "px$", "").try_cast("double"), F.lit(0.0))
    paint = lambda c, under: F.when(c.isNotNull(), over(c, under))
    df = df.withColumns(
        {"_bb": paint(old["backgroundColor"], white), "_fb": paint(new["backgroundColor"], white)}
    )
    bb, fb = F.coalesce("_bb", white), F.coalesce("_fb", white)
    none = ["none", "hidden"]
    unlined = F.coalesce(b("outlineStyle").isin(none), F.lit(False)) | (px(b("outlineWidth")) <= 0)
    pairs = {"backgroundColor": (F.col("_bb"), F.col("_fb"))}
    for s in sides:
        k = f"border{s}Color"
        pairs[k] = (paint(old[k], bb), paint(new[k], fb))
    pairs["outline"] = (
        F.when(unlined, F.col("_bb")).otherwise(paint(old["outlineColor"], bb)),
        paint(new["outlineColor"], fb),
    )
    rates = F.transform(
        F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pairs.values()]),
        lambda p: F.coalesce(contrast_ratio(p["x"], p["y"]), F.lit(0.0)),
    )
    before = F.slice("_c", F.lit(2 * n + 1), F.size("_sb"))
    before = F.when(F.size("_sb") > 0, F.transform(before, lambda c: over(c, bb))).otherwise(
        F.array("_bb")
    )
    after = F.transform(
        F.slice("_c", F.lit(2 * n + 1) + F.size("_sb"), F.size("_sf")), lambda c: over(c, fb)
    )
    df = df.withColumns({"_r": rates, "_b4": before, "_af": after})
    strong = {k: F.get("_r", i) >= FOCUS_CONTRAST for i, k in enumerate(pairs)}
    differs = lambda k: ~b(k).eqNullSafe(f(k))
    names = [
        F.when(differs("backgroundColor") & strong["backgroundColor"], "backgroundColor")
    ]
    for s in sides:
        k, w = f"border{s}Color", f"border{s}Width"
        changed = (px(f(w)) > 0) & (differs(k) | (px(f(w)) != px(b(w))))
        names.append(F.when(changed & strong[k], k))
    outline = (
        (differs("outlineStyle") | differs("outlineWidth") | differs("outlineColor"))
        & (px(f("outlineWidth")) > 0)
        & ~F.coalesce(f("outlineStyle").isin(none), F.lit(False))
        & strong["outline"]
    )
    names.append(F.when(outline, "outline"))
    shadow = differs("boxShadow") & F.exists(
        "_af",
        lambda x: F.exists(
            "_b4", lambda o: F.coalesce(contrast_ratio(x, o) >= FOCUS_CONTRAST, F.lit(False))
        ),
    )
    names.append(F.when(shadow, "boxShadow"))
    out = df.withColumn("perceptible", F.array_compact(F.array(*names)))
    return out.drop("_bb", "_fb", "_c", "_sb", "_sf", "_r", "_b4", "_af").withColumn(
        "visible", F.size("perceptible") > 0
    )


def ownership_groups(elements: DataFrame) -> DataFrame:
    """Equivalence groups with an exact owner and three or more members."""
    n = (
        elements.where(F.col("owner_confidence") >= 1.0)
        .groupBy("owner", "grp")
        .agg(F.count(F.lit(1)).alias("members"))
    )
    return n.where("members >= 3")


def semantic_coverage(elements: DataFrame, keys: list[str]) -> DataFrame:
    c = lambda cond: F.count_if(cond)
    return elements.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("elements"),
        c(F.col("grouped")).alias("grouped"),
        c(F.col("paint") == "resolved").alias("paint_resolved"),
        c(F.col("paint") == "unresolved").alias("paint_unresolved"),
        c(F.col("paint").isNull()).alias("unobserved"),
    )


def capture_coverage(captures: DataFrame) -> DataFrame:
    return captures.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("truncated")).alias("truncated"),
    )


def diagnostic_findings(diagnostics: DataFrame, identity: list[str]) -> DataFrame:
    """Browser diagnostics as findings, one per identity tuple."""
    return diagnostics.select(*identity).distinct().withColumn(
        "status", F.when(F.col("severity") == "info", "informational").otherwise("pending")
    )
