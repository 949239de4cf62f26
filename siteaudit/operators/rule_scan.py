"""Scan sources with the rule catalog: one narrow pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.functions.regex import fold, java, match_offsets, required_literals
from siteaudit.operators.findings import canonical, fingerprint, severity_of, source_anchor
from siteaudit.operators.rule_catalog import RULES
from siteaudit.operators.rule_checks import CHECKS, NEEDS, REPORTED_AS, dev_proxy_exempt

MAX_BYTES = 1_000_000
# Rules active only above a design-variance setting.
VARIANCE_ABOVE = {"CENTER_BIAS_SLOP": 4}
# Lines a match must span at least; a document with fewer is skipped before the regex.
MIN_LINES = {"TESTIMONIAL_GRID_SLOP": 3, "EMOJI_BULLET_LIST_SLOP": 3}
# Category and the id fragments that select it; the first match wins.
CATEGORY_TOKENS: list[tuple[str, str]] = [
    (
        "accessibility",
        "A11Y ACCESSIB ARIA TABINDEX FOCUS ALT_ LABEL CAPTION SEMANTIC VIEWBOX TOUCH_TARGET "
        "TEXT_SIZE_ADJUST HIDDEN_SCROLLBAR FORCED_COLOR",
    ),
    ("typography", "TYPOGRAPH FONT LINE_HEIGHT TEXT_TRANSFORM"),
    ("color", "COLOR PALETTE GRADIENT CONTRAST BLACK DARK_MODE OPACITY"),
    ("motion", "MOTION ANIMAT TRANSITION BOUNCE AUTOPLAY SCROLL_BEHAVIOR SCROLL_SNAP"),
    (
        "layout",
        "LAYOUT GRID FLEX CENTER DIV_SOUP COLUMN OVERFLOW STICKY Z_INDEX SPACING PADDING PX_ "
        "RESPONSIVE MOBILE VIEWPORT",
    ),
    ("materiality", "MATERIAL RADIUS SHADOW GLASS GLOW BORDER HAIRLINE"),
    ("iconography", "ICON LUCIDE SVG"),
    ("forms", "FORM INPUT SELECT BUTTON AUTOCOMPLETE PLACEHOLDER RESIZE"),
    ("content", "COPY LOREM GENERIC DASHBOARD CARD EMPTY"),
    (
        "security",
        "SECURITY EVAL INNERHTML COOKIE LOCALSTORAGE POSTMESSAGE OPEN_REDIRECT DOCUMENT_WRITE "
        "CROSS_ORIGIN",
    ),
    (
        "performance",
        "PERF LAZY TREE_SHAKING INLINE_OBJECT REFERENCE SETINTERVAL SETTIMEOUT BFCACHE",
    ),
    ("react", "REACT PROP STATE CONTEXT CLASS_COMPONENT FINDDOMNODE FRAGMENT KEY_"),
    ("browser", "BROWSER USER_AGENT VENDOR WEBKIT PROCESS_BROWSER TYPEOF_DOCUMENT"),
    (
        "code-quality",
        "UNUSED DUPLICATE COMMENTED DEBUGGER CONSOLE TERNARY TS_IGNORE NON_NULL UNREACHABLE "
        "ESLINT DEPRECATED",
    ),
]


def rule_category(rule_id: Column) -> Column:
    up = F.upper(rule_id)
    out = F
    for name, tokens in CATEGORY_TOKENS:
        out = out.when(up.rlike("|".join(tokens.split())), F.lit(name))
    return out.otherwise(F.lit("interaction"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _one_of(exts: str) -> str:
    return "ext IN (" + ", ".join(_sql_text(e) for e in exts.split()) + ")"


def _wanted(exts: str, only: list[str] | None) -> bool:
    return only is None or bool(set(exts.split()) & set(only))


def scan_status(max_bytes: int | None = None) -> Column:
    """What becomes of ``content``: scanned, no_text, undecodable or, beyond a guard, too_large."""
    out = F.when(F.col("content").isNull(), "no_text").when(
        ~F.is_valid_utf8("content"), "undecodable"
    )
    if max_bytes is not None:
        out = out.when(F.octet_length("content") > max_bytes, "too_large")
    return out.otherwise("scanned")


def eligible(sources: DataFrame, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Size and encoding guard; runs before any pattern. Without ``max_bytes`` any size passes."""
    return sources.where(scan_status(max_bytes) == "scanned")


def pattern_hits(
    sources: DataFrame,
    variance: int = 8,
    rules: list[str] | None = None,
    exts: list[str] | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """(source columns, rule index) for each pattern rule with at least one match.

    ``exts`` states which file kinds the input holds, so other rules are never planned.
    """
    folded = eligible(sources, max_bytes).withColumn("_low", fold(F.col("content")))
    cases = []
    for i, (rid, _tier, kinds, fl, pattern) in enumerate(RULES):
        if variance <= VARIANCE_ABOVE.get(rid, -1) or (rules is not None and rid not in rules):
            continue
        if not _wanted(kinds, exts):
            continue
        # The literal test is cheap and false for most documents; the regex runs after it.
        lits = required_literals(pattern)
        guard = " OR ".join(f"contains(_low, {_sql_text(x)})" for x in lits or [])
        if rid in MIN_LINES:
            guard = "content LIKE '" + "%\\n" * (MIN_LINES[rid] - 1) + "%'"
        cases.append(
            f"CASE WHEN {_one_of(kinds)} AND {f'({guard})' if guard else 'true'} "
            f"AND content RLIKE {_sql_text(java(pattern, fl))} THEN {i} END"
        )
    hit = F.expr(f"explode(array_compact(array({', '.join(cases)})))") if cases else None
    if hit is None:
        return folded.select(*sources.columns, F.lit(0).alias("rule")).where(F.lit(False))
    return folded.select(*sources.columns, hit.alias("rule"))


def _lookup(values: list[str], index: str) -> Column:
    return F.expr(f"get(array({', '.join(_sql_text(v) for v in values)}), {index})")


def scan_patterns(
    sources: DataFrame,
    variance: int = 8,
    rules: list[str] | None = None,
    exts: list[str] | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per non-overlapping match of each pattern rule, with offsets.

    Digest and lines are computed once a document and rule, before its matches are exploded.
    The outer form keeps the optimiser from testing the array, and so finding it, beforehand.
    """
    hits = pattern_hits(sources, variance, rules, exts, max_bytes)
    pattern = _lookup([java(p, fl) for _, _, _, fl, p in RULES], "rule")
    found = hits.select(
        "path",
        _lookup([r[0] for r in RULES], "rule").alias("detector_id"),
        _lookup([r[1] for r in RULES], "rule").alias("tier"),
        F.sha2("content", 256).alias("source_hash"),
        F.split("content", "\n", -1).alias("_lines"),
        match_offsets(F.col("content"), pattern).alias("_found"),
    )
    return found.select(
        "path", "detector_id", "tier", "source_hash", "_lines", F.explode_outer("_found").alias("m")
    ).where("m IS NOT NULL").select(
        "path",
        "detector_id",
        "tier",
        "source_hash",
        "m.start",
        "m.end",
        "m.line",
        "m.column",
        F.col("m.text").alias("matched_text"),
        F.trim(F.get("_lines", F.col("m.line") - 1)).alias("excerpt"),
    )


def scan_checks(
    sources: DataFrame,
    rules: list[str] | None = None,
    exts: list[str] | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per document failing a predicate rule."""
    rows = []
    for rid, (tier, kinds, build) in CHECKS.items():
        name = REPORTED_AS.get(rid, rid)
        if not _wanted(kinds, exts) or (rules is not None and name not in rules):
            continue
        at = build(F.col("content"))
        gate = F.expr(_one_of(kinds))
        if rid in NEEDS:
            gate = gate & F.contains("_low", F.lit(NEEDS[rid]))
        if rid == "HARDCODED_DEV_URL_SLOP":
            at = F.when(~dev_proxy_exempt(F.col("path"), F.col("content")), at)
        rows.append(
            F.struct(
                F.lit(name).alias("detector_id"),
                F.lit(tier).alias("tier"),
                F.when(gate, at).cast("int").alias("start"),
            )
        )
    none = F.array().cast("array<struct<detector_id:string,tier:string,start:int>>")
    found = F.filter(F.array(*rows) if rows else none, lambda r: r["start"].isNotNull())
    head = F.substring(F.col("content"), F.lit(1), F.col("f.start"))
    bol_text = F.substring_index(head, "\n", -1)
    return (
        eligible(sources, max_bytes)
        .withColumn("_low", fold(F.col("content")))
        .select("path", "content", F.explode_outer(found).alias("f"))
        .where("f IS NOT NULL")
        .select(
            "path",
            "f.detector_id",
            "f.tier",
            F.sha2("content", 256).alias("source_hash"),
            "f.start",
            F.col("f.start").alias("end"),
            (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).alias("line"),
            (F.length(bol_text) + 1).alias("column"),
            F.lit("").alias("matched_text"),
            F.trim(
                F.substring_index(
                    F.substring(
                        F.col("content"),
                        F.col("f.start") - F.length(bol_text) + 1,
                        F.length("content"),
                    ),
                    "\n",
                    1,
                )
            ).alias("excerpt"),
        )
    )


def to_findings(raw: DataFrame) -> DataFrame:
    evidence = canonical(raw, matched_text=F.col("matched_text"))
    anchor = source_anchor(raw, *[F.col(c) for c in ("path", "line", "column", "start", "end")])
    return raw.select(
        "path",
        "detector_id",
        rule_category(F.col("detector_id")).alias("category"),
        "tier",
        severity_of(F.col("tier")).alias("severity"),
        F.lit(1.0).alias("confidence"),
        F.lit("pending").alias("status"),
        F.lit("static").alias("provenance"),
        "line",
        "column",
        "start",
        "end",
        "matched_text",
        "excerpt",
        "source_hash",
        fingerprint(F.col("detector_id"), source=anchor, evidence=evidence).alias("fingerprint"),
    )


def rule_scan(
    sources: DataFrame,
    variance: int = 8,
    rules: list[str] | None = None,
    exts: list[str] | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """All rules over ``sources(path, ext, content, ...)``.

    Valid text of any size is scanned; ``max_bytes`` sets a guard. ``scan_status`` tells what
    a source without findings means.
    """
    raw = scan_patterns(sources, variance, rules, exts, max_bytes).unionByName(
        scan_checks(sources, rules, exts, max_bytes)
    )
    return to_findings(raw)


def registry(spark) -> DataFrame:
    """Rule dimension: id, tier, extensions, category."""
    rows = [(r[0], r[1], r[2]) for r in RULES]
    rows += [(i, t, e) for i, (t, e, _) in CHECKS.items() if i not in REPORTED_AS]
    rows.append(("MISSING_FOCUS_SLOP", "T2", "html jsx svelte tsx vue"))
    df = spark.createDataFrame(rows, "rule_id string, tier string, exts string")
    return df.withColumn("category", rule_category(F.col("rule_id")))
