"""Rule-scan queries over pages and derived source files."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siteaudit.operators import markup, rule_scan
from siteaudit.operators.rule_catalog import RULES
from siteaudit.plans.session import spread
from siteaudit.workload.derive import FILES, FINDINGS, PAGES, duck, lit, view
from siteaudit.workload.registry import query


def pages(spark, d):
    return spread(view(spark, d, PAGES))


def files(spark, d):
    return spread(view(spark, d, FILES))


def re2_ok(p: str) -> bool:
    return not re.search(r"\(\?[=!<]|\\[1-9]|\\x\{|\\u", p)


def _re2(p: str, fl: str) -> str:
    return lit(f"(?{fl}){p}" if fl else p)


def _ext_in(kinds: str) -> str:
    return "ext IN (" + ", ".join(lit(k) for k in kinds.split()) + ")"


def pattern_sql(src: str, ids: list[str], cols: str = "path") -> str:
    """Matches per rule, by DuckDB's own regex engine, over one pass of the sources."""
    rows = [r for r in RULES if r[0] in ids]
    hits = ", ".join(
        f"{{'d': {lit(i)}, 'n': CASE WHEN {_ext_in(k)} THEN "
        f"len(regexp_extract_all(content, {_re2(p, fl)})) ELSE 0 END}}"
        for i, _, k, fl, p in rows
    )
    return (
        f"SELECT {cols}, u.d AS detector_id, u.n AS n FROM (SELECT {cols}, "
        f"unnest([{hits}]) AS u FROM {src} s) WHERE u.n > 0"
    )


RE2 = [r[0] for r in RULES if re2_ok(r[4])]
HTML_RE2 = [r[0] for r in RULES if "html" in r[2].split() and re2_ok(r[4])]

# Page checks written out by hand; rules whose regex DuckDB rejects match nothing here.
_PAGE_CHECKS = f"""
SELECT path, 'MISSING_META_DESCRIPTION_SLOP' AS detector_id, 1 AS n FROM {duck(PAGES)}
 WHERE regexp_matches(content, '(?i)<head\\b')
 AND NOT regexp_matches(content, '(?i)<meta\\s[^>]*name=["'']description["'']')
UNION ALL SELECT path, 'MISSING_FAVICON_SLOP', 1 FROM {duck(PAGES)}
 WHERE regexp_matches(content, '(?i)<head\\b')
 AND NOT regexp_matches(content, '(?i)rel=["''](?:shortcut icon|icon)["'']')
UNION ALL SELECT path, 'SKIP_TO_CONTENT_MISSING_SLOP', 1 FROM {duck(PAGES)}
 WHERE regexp_matches(content, '(?i)<nav\\b') AND regexp_matches(content, '(?i)<main\\b')
 AND NOT regexp_matches(content, '(?i)href=["'']#')
UNION ALL SELECT path, 'DIV_SOUP_SLOP', 1 FROM {duck(PAGES)}
 WHERE len(regexp_extract_all(content, '(?i)<div[\\s>]')) > 20
 AND NOT regexp_matches(content, '(?i)<(?:nav|main|article|section|aside|header|footer)[\\s>]')
"""
PAGE_COUNTS = f"{pattern_sql(duck(PAGES), HTML_RE2)} UNION ALL {_PAGE_CHECKS}"


@query("rule_scan", f"SELECT path, detector_id, CAST(n AS BIGINT) AS n FROM ({PAGE_COUNTS})")
def _(spark, d):
    return (
        rule_scan.rule_scan(pages(spark, d), exts=["html"])
        .groupBy("path", "detector_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "rule_scan_patterns",
    f"SELECT path, detector_id, CAST(n AS BIGINT) AS n FROM ({pattern_sql(duck(FILES), RE2)})",
)
def _(spark, d):
    return (
        rule_scan.scan_patterns(files(spark, d), rules=RE2)
        .groupBy("path", "detector_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _lookaround(rid: str, cond: str, kinds: str) -> str:
    return (
        f"SELECT path, '{rid}' AS detector_id FROM {duck(FILES)} WHERE {_ext_in(kinds)} AND {cond}"
    )


def _tags(p: str, g: int | None = None) -> str:
    return f"regexp_extract_all(content, {lit(p)}{'' if g is None else f', {g}'})"


def _m(x: str, p: str) -> str:
    return f"regexp_matches({x}, {lit(p)})"


def _some(p: str, bad: str, g: int | None = None) -> str:
    return f"len(list_filter({_tags(p, g)}, lambda t: {bad})) > 0"


H, X, S = "html jsx tsx", "jsx tsx", "js ts tsx"
C = "css less scss"


@query(
    "lookaround_rules",
    " UNION ALL ".join(
        [
            _lookaround(
                "IMG_ALT_MISSING_SLOP",
                _some(r"(?i)<img\b[^>]*>", "NOT " + _m("t", r"(?i)\balt=")),
                H,
            ),
            _lookaround(
                "MISSING_LANG_SLOP",
                _some(r"(?i)<html\b[^>]*>", "NOT " + _m("t", r"(?i)\blang=")),
                "html",
            ),
        ]
    ),
)
def _(spark, d):
    ids = ["IMG_ALT_MISSING_SLOP", "MISSING_LANG_SLOP"]
    return (
        rule_scan.scan_patterns(files(spark, d), rules=ids).select("path", "detector_id").distinct()
    )


_OFFS_RULES = ["CONSOLE_LOG_SLOP", "EMPTY_HREF_SLOP", "TODO_FIXME_SLOP", "RAW_COLOR_SLOP"]


def _offsets_sql() -> str:
    out = []
    for i, _, k, fl, p in RULES:
        if i not in _OFFS_RULES:
            continue
        r = _re2(p, fl)
        out.append(
            f"SELECT path, '{i}' AS detector_id, content, unnest(range(1, len(h) + 1)) AS i, h, g "
            f"FROM (SELECT path, content, regexp_extract_all(content, {r}) AS h, "
            f"regexp_split_to_array(content, {r}) AS g FROM {duck(FILES)} WHERE {_ext_in(k)})"
        )
    return f"""
SELECT path, detector_id, CAST(s AS INT) AS start_at, CAST(s + length(m) AS INT) AS end_at,
  CAST(1 + length(pre) - length(replace(pre, chr(10), '')) AS INT) AS line_no,
  CAST(1 + length(string_split(pre, chr(10))[-1]) AS INT) AS col_no, m AS matched_text
FROM (SELECT *, left(content, CAST(s AS INT)) AS pre FROM (
  SELECT path, detector_id, content, h[i] AS m,
   list_sum(list_transform(g[1:i], lambda x: length(x)))
   + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS s
  FROM ({' UNION ALL '.join(out)})))"""


@query("match_offsets", _offsets_sql())
def _(spark, d):
    f = rule_scan.scan_patterns(files(spark, d), rules=_OFFS_RULES)
    return f.select(
        "path",
        "detector_id",
        F.col("start").alias("start_at"),
        F.col("end").alias("end_at"),
        F.col("line").alias("line_no"),
        F.col("column").alias("col_no"),
        "matched_text",
    )


def _case_sql(id_col: str) -> str:
    parts = " ".join(
        f"WHEN regexp_matches(upper({id_col}), '{'|'.join(t.split())}') THEN '{n}'"
        for n, t in rule_scan.CATEGORY_TOKENS
    )
    return f"CASE {parts} ELSE 'interaction' END"


@query(
    "rule_category",
    f"SELECT category, count(*) AS n FROM (SELECT {_case_sql('detector_id')} AS category "
    f"FROM ({PAGE_COUNTS} UNION ALL {pattern_sql(duck(FILES), RE2)})) GROUP BY category",
)
def _(spark, d):
    a = rule_scan.rule_scan(pages(spark, d), exts=["html"]).select("path", "detector_id").distinct()
    b = rule_scan.scan_patterns(files(spark, d), rules=RE2).select("path", "detector_id").distinct()
    return (
        a.unionAll(b)
        .select(rule_scan.rule_category(F.col("detector_id")).alias("category"))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _center(v: int) -> str:
    p = lit(r"(?is)text-center.*mx-auto|mx-auto.*text-center")
    body = (
        "(SELECT 'd' || CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 3 WHEN 0 THEN "
        "'<p class=\"text-center ' || lang || '\">' || text || '</p><b class=\"mx-auto\">' "
        "ELSE '<p class=\"mx-auto\">' || text END AS content FROM documents)"
    )
    return f"SELECT {v} AS dial, path FROM {body} WHERE {v} > 4 AND regexp_matches(content, {p})"


@query("variance_gate", f"{_center(4)} UNION ALL {_center(8)}")
def _(spark, d):
    docs = spread(spark.read.parquet(f"{d}/documents.parquet")).select(
        F.concat(F.lit("d"), "doc_id").alias("path"),
        F.lit("html").alias("ext"),
        F.when(
            F.col("doc_id") % 3 == 0,
            F.concat(
                F.lit('<p class="text-center '), "lang", F.lit('">'), "text",
                F.lit('</p><b class="mx-auto">'),
            ),
        ).otherwise(F.concat(F.lit('<p class="mx-auto">'), "text")).alias("content"),
    )
    runs = [
        rule_scan.scan_patterns(docs, variance=v, rules=["CENTER_BIAS_SLOP"]).select(
            F.lit(v).alias("dial"), "path"
        )
        for v in (4, 8)
    ]
    return runs[0].unionAll(runs[1])


# ---- predicate families ----------------------------------------------------------------

FAMILIES: dict[str, dict[str, tuple[str, str]]] = {
    "presence_absence": {
        "VIDEO_NO_CAPTIONS_SLOP": (
            H, f"{_m('content', '(?i)<video')} AND NOT {_m('content', '(?i)<track')}"
        ),
        "MISSING_META_DESCRIPTION_SLOP": (
            "html",
            "contains(content, '<head') AND NOT contains(content, 'name=\"description\"')",
        ),
        "SKIP_TO_CONTENT_MISSING_SLOP": (
            "html",
            "contains(content, '<nav') AND contains(content, '<main') "
            "AND NOT contains(content, 'href=\"#')",
        ),
        "MISSING_FAVICON_SLOP": (
            "html", "contains(content, '<head') AND NOT contains(content, 'rel=\"icon\"')"
        ),
        "ANCHOR_TARGET_BLANK_SLOP": (
            H,
            "contains(content, 'target=\"_blank\"') AND NOT (contains(content, 'noopener') "
            "AND contains(content, 'noreferrer'))",
        ),
        "SRCSET_MISSING_SLOP": (
            H,
            _some(r"(?i)<img\b[^>]*>", "NOT contains(t, 'src=\"data:')")
            + " AND NOT contains(content, 'srcset=')",
        ),
        "DOCUMENT_COOKIE_SSR_SLOP": (
            S, "contains(content, 'document.cookie') AND NOT contains(content, 'typeof window')"
        ),
        "INNER_HTML_ASSIGN_SLOP": (S, r"contains(content, '.innerHTML =')"),
        "MISSING_LOADING_STATE_SLOP": (
            X, "contains(content, 'useQuery') AND NOT contains(content, 'isLoading')"
        ),
        "CSS_SCROLL_BEHAVIOR_SLOP": (
            C,
            "contains(content, 'scroll-behavior: smooth') "
            "AND NOT contains(content, 'prefers-reduced-motion')",
        ),
    },
    "tag_predicate": {
        "IMG_MISSING_DIMENSIONS_SLOP": (
            H, _some(r"(?i)<img\b[^>]*>", "NOT (contains(t, ' width=') AND contains(t, ' height='))")
        ),
        "PLACEHOLDER_ONLY_INPUT_SLOP": (
            H,
            _some(
                r"(?i)<input\b[^>]*>",
                "contains(t, ' placeholder=') AND NOT contains(t, ' id=') "
                "AND NOT contains(t, 'aria-label')",
            ),
        ),
        "SORTABLE_TABLE_ARIA_SORT_SLOP": (
            H,
            _some(
                r"(?is)<th\b[^>]*>.*?</th>",
                "(contains(t, 'onClick=') OR contains(t, '<button')) "
                "AND NOT contains(t, 'aria-sort')",
            ),
        ),
        "SELECT_NO_LABEL_SLOP": (
            H,
            "contains(content, '<select') AND NOT regexp_matches(substr(content, "
            "greatest(instr(content, '<select') - 200, 1), least(instr(content, '<select') - 1, "
            "200) + 200), '(?i)<label\\b|aria-label=|aria-labelledby=')",
        ),
        "ICON_ONLY_BUTTON_SLOP": (
            X, _some(r"(?i)<button\b[^>]*>\s*<(?:svg|i)\b", "NOT contains(t, 'aria-label=')")
        ),
        "MISSING_ARIA_ROLE_SLOP": (
            H,
            _some(
                r"(?i)<(?:div|span)\s[^>]*on(?:Click|Keydown|Keyup)[^>]*>",
                "NOT contains(t, ' role=')",
            ),
        ),
        "MEDIA_AUTOPLAY_SLOP": (
            H, _some(r"(?i)<(?:video|audio)\b[^>]*", "contains(t, 'autoplay')")
        ),
    },
    "orphaned_label": {
        "ORPHANED_LABEL_SLOP": (
            "html jsx svelte tsx vue",
            _some(
                r"(?s)<label\b[^>]*>[^<]*(?:<input|</label>)",
                "NOT contains(t, '<input') AND NOT (ext <> 'tsx' AND contains(t, ' for='))",
            ),
        ),
    },
    "threshold_rules": {
        "DIV_SOUP_SLOP": (
            "html jsx svelte tsx vue",
            f"len({_tags(r'(?i)<div[\s>]')}) > 20 AND NOT "
            + _m("content", r"(?i)<(?:nav|main|article|section|aside|header|footer)[\s>]"),
        ),
        "ALPHA_COLOR_ABUSE_SLOP": (C, f"len({_tags(r'(?i)(?:rgba|hsla)\s*\(')}) >= 5"),
        "NESTED_TERNARY_SLOP": (
            "js jsx ts tsx", f"len({_tags(r'\?[^:?\n]{0,80}\?')}) >= 2"
        ),
        "FONT_WEIGHT_EXTREMES_SLOP": (
            X,
            "contains(content, 'font-bold') AND contains(content, 'font-normal') AND NOT "
            + _m("content", r"\bfont-medium\b|\bfont-semibold\b"),
        ),
    },
    "css_block_rules": {
        "STICKY_WITHOUT_TOP_SLOP": (
            C, _some(r"(?is)position:\s*sticky[^}]*", "NOT " + _m("t", r"(?i)\btop\s*:|inset\s*:"))
        ),
        "FONT_DISPLAY_MISSING_SLOP": (
            C, _some(r"(?is)@font-face\s*\{[^}]*\}", "NOT contains(t, 'font-display')")
        ),
        "GRID_AUTO_FIT_MISSING_SLOP": (
            C, "contains(content, 'repeat(3,') AND NOT regexp_matches(content, 'auto-fit|auto-fill')"
        ),
        "IMPORTANT_ABUSE_SLOP": (
            C,
            "contains(regexp_replace(content, "
            r"'(?i)@media \(prefers-reduced-motion: reduce\) \{ \* \{[^}]*\} \}', '', 'g'), "
            "'!important')",
        ),
        "FOCUS_OUTLINE_REMOVED_SLOP": (C, _m("content", r"(?i):focus\s*\{[^}]*outline:\s*(?:none|0)\b")),
    },
    "class_conflict": {
        "TAILWIND_FONT_CONFLICT_SLOP": (
            X,
            _some(
                r'className="([^"]+)"',
                "len(list_distinct(regexp_extract_all(t, 'text-(?:xs|sm|base|lg|xl)'))) >= 2",
                1,
            ),
        ),
        "TAILWIND_WEIGHT_CONFLICT_SLOP": (
            X,
            _some(
                r'className="([^"]+)"',
                "len(list_distinct(regexp_extract_all(t, 'font-(?:bold|medium|normal)'))) >= 2",
                1,
            ),
        ),
        "TAILWIND_DISPLAY_CONFLICT_SLOP": (
            X,
            _some(
                r'className="([^"]+)"',
                "list_contains(string_split(t, ' '), 'hidden') "
                "AND list_contains(string_split(t, ' '), 'flex')",
                1,
            ),
        ),
    },
    "react_rules": {
        "DUPLICATE_IMPORT_SLOP": (
            S,
            "len({0}) > len(list_distinct({0}))".format(
                _tags(r"import\s+[^;]+\s+from\s+['\"]([^'\"]+)['\"]", 1)
            ),
        ),
        "MISSING_KEY_PROP_SLOP": (X, "contains(content, '<Row name=')"),
        "FRAMER_NO_REDUCED_MOTION_SLOP": (
            X,
            "contains(content, 'framer-motion') AND regexp_matches(content, '\\bmotion\\.') "
            "AND NOT contains(content, 'useReducedMotion')",
        ),
    },
    "unused_import": {
        "UNUSED_IMPORT": (
            "js jsx ts tsx",
            " OR ".join(
                f"(contains(content, {lit(imp)}) AND "
                f"len(regexp_extract_all(content, '\\b{name}\\b')) <= 1)"
                for imp, name in [
                    ("import React from", "React"),
                    ("import { useState }", "useState"),
                    ("import { motion }", "motion"),
                    ("import { Check, X as Cross }", "Check"),
                    ("import { Check, X as Cross }", "Cross"),
                ]
            ),
        ),
    },
    "unused_state": {
        "UNUSED_STATE": (
            X,
            "contains(content, 'const [open, setOpen] = useState') AND "
            "len(regexp_extract_all(content, '\\bopen\\b')) <= 1",
        ),
    },
    "component_layout": {
        "HERO_HEAVY_SLOP": (X, f"len({_tags('hero|Hero|HERO')}) >= 2"),
        "PRICING_TABLE_SLOP": (
            X,
            "(regexp_matches(content, '(?i)\\b(?:pricing|price|plan|tier|subscription)\\b') AND "
            "len(regexp_extract_all(content, '(?i)\\$\\d+|/mo(?:nth)?\\b|/yr\\b|/year\\b|"
            "\\b(?:free|popular|recommended|enterprise|pro|starter|basic|premium)\\b')) >= 3) "
            "OR (regexp_matches(content, '(?i)\\bfree\\b') "
            "AND regexp_matches(content, '(?i)\\bpro\\b') "
            "AND regexp_matches(content, '(?i)\\benterprise\\b'))",
        ),
    },
    "design_patterns": {
        "CARD_NESTING_SLOP": (
            "html jsx svelte tsx vue", "contains(content, '<div class=\"card\"><div class=\"card\">')"
        ),
        "HARDCODED_COPYRIGHT_YEAR_SLOP": (
            H, "contains(content, '© 2024') AND NOT contains(content, 'getFullYear()')"
        ),
        "ROUND_NUMBER_SLOP": (
            "html jsx svelte tsx vue", "contains(content, '99%') AND ext = 'html'"
        ),
        "HOVER_ONLY_REVEAL_SLOP": (
            "html jsx svelte tsx vue", "contains(content, 'opacity-0 group-hover:opacity-100')"
        ),
    },
    "hover_focus_scroll": {
        "NO_PASSIVE_SCROLL_LISTENER_SLOP": (
            S,
            _some(
                r"""addEventListener\s*\(\s*['"](?:scroll|wheel)['"][^;]*;?""",
                "NOT contains(t, 'passive: true')",
            ),
        ),
        "OUTLINE_NONE_SLOP": (X, "contains(content, 'outline-none')"),
    },
}


def _family(name: str, rules: dict[str, tuple[str, str]]) -> None:
    sql = " UNION ALL ".join(
        f"SELECT path, '{r}' AS detector_id FROM {duck(FILES)} WHERE {_ext_in(k)} AND ({cond})"
        for r, (k, cond) in rules.items()
    )

    def run(spark, d):
        found = rule_scan.scan_checks(files(spark, d), rules=list(rules))
        return found.select("path", "detector_id").distinct()

    query(name, sql)(run)


for _name, _rules in FAMILIES.items():
    _family(_name, _rules)


_PROXY = """
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'app/vite.config.ts' WHEN 1 THEN 'app/playwright.config.ts'
   WHEN 2 THEN 'app/api.ts' ELSE 'lib/vite.config.ts' END || '' AS path,
  o_orderkey AS okey, 'ts' AS ext,
  CASE WHEN o_orderkey % 3 = 0 THEN 'server: { proxy: { a: "http://localhost:' ELSE
   'const x = { b: "http://localhost:' END || CAST(o_custkey AS VARCHAR(20)) || '/" } }' AS content
FROM {orders}
"""


@query(
    "dev_proxy_exempt",
    f"""SELECT path, count(*) AS n FROM {duck(_PROXY)} WHERE NOT (
 contains(path, 'playwright') OR (contains(path, 'vite') AND contains(content, 'proxy: {{')))
 GROUP BY path""",
)
def _(spark, d):
    src = view(spark, d, _PROXY)
    return (
        rule_scan.scan_checks(src, rules=["HARDCODED_DEV_URL_SLOP"])
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---- markup ----------------------------------------------------------------------------

_TAGROWS = f"""
SELECT path, pos, t, starts_with(t, '</') AS closing,
 lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag
FROM (SELECT path, h[i] AS t, i - 1 AS pos FROM (SELECT path, h, unnest(range(1, len(h) + 1)) AS i
 FROM (SELECT path, regexp_extract_all(content, '</?[a-zA-Z][^>]*>') AS h FROM {duck(PAGES)})))
"""
_DELTAS = f"""
SELECT *, CASE WHEN closing THEN -1 WHEN ends_with(t, '/>') OR tag IN ('area','base','br','col',
 'embed','hr','img','input','link','meta','source','track','wbr') THEN 0 ELSE 1 END AS delta
FROM ({_TAGROWS})
"""
_ELEMS = f"""
SELECT path, CAST(pos AS INT) AS pos, tag, closing, delta, CAST(sum(delta) OVER (PARTITION BY path
 ORDER BY pos ROWS UNBOUNDED PRECEDING) - CASE WHEN delta = 1 THEN 1 ELSE 0 END AS BIGINT) AS depth
FROM ({_DELTAS})
"""


@query("html_elements", _ELEMS)
def _(spark, d):
    return markup.html_elements(pages(spark, d)).drop("attrs")


@query(
    "structure_counters",
    f"""WITH e AS ({_ELEMS}), o AS (SELECT * FROM e WHERE NOT closing),
 u AS (SELECT path, depth AS lvl, pos, NULL AS tag, CASE WHEN delta = 1 THEN pos END AS pp FROM o
  UNION ALL SELECT path, depth - 1, pos, tag, NULL FROM o),
 p AS (SELECT path, tag, coalesce(last_value(pp IGNORE NULLS) OVER (PARTITION BY path, lvl
  ORDER BY pos ROWS UNBOUNDED PRECEDING), -1) AS parent FROM u),
 t AS (SELECT path, max(n) AS max_twins FROM (SELECT path, parent, tag, count(*) AS n FROM p
  WHERE tag IS NOT NULL GROUP BY ALL) GROUP BY path)
SELECT path, count(*) FILTER (tag = 'div') AS divs, count(*) FILTER (tag IN ('nav','main','article',
 'section','aside','header','footer')) AS semantic, max(depth) AS max_depth,
 any_value(max_twins) AS max_twins,
 count(*) FILTER (tag = 'div') > 20 AND count(*) FILTER (tag IN ('nav','main','article',
 'section','aside','header','footer')) = 0 AS div_soup,
 any_value(max_twins) >= 4 AS identical_siblings, max(depth) >= 5 AS deep_nesting
FROM o JOIN t USING (path) GROUP BY path""",
)
def _(spark, d):
    return markup.structure_counters(markup.html_elements(pages(spark, d)))


_BTN = f"""
SELECT path, root, CASE WHEN contains(content, 'className="bg-black text-white') THEN 1 ELSE 0 END
 AS u1, CASE WHEN contains(content, 'className="flex hidden') THEN 1 ELSE 0 END AS u2
FROM {duck(FILES)} WHERE ext = 'tsx'"""


@query(
    "interaction_state",
    f"""SELECT path, 0 AS with_state, u1 + u2 AS controls FROM ({_BTN}) WHERE u1 + u2 > 0""",
)
def _(spark, d):
    s = markup.interaction_state(files(spark, d), "focus")
    return s.groupBy("path").agg(
        F.count_if("has_state").cast("int").alias("with_state"),
        F.count(F.lit(1)).cast("int").alias("controls"),
    )


_SEM = """
SELECT 'pkg' || CAST(s_suppkey % 7 AS VARCHAR(20)) AS root,
 'pkg' || CAST(s_suppkey % 7 AS VARCHAR(20)) || '/F' || CAST(s_suppkey AS VARCHAR(20)) AS path,
 CASE WHEN s_suppkey % 4 = 0 THEN 'css' ELSE 'tsx' END AS ext, s_suppkey AS k,
 CASE WHEN s_suppkey % 4 = 0 THEN '.c' || CAST(s_nationkey AS VARCHAR(20))
   || ':focus-visible { x: y } .d:is(.e):hover, .k { a: b }'
  ELSE '<button type="x" className="c' || CAST(s_nationkey AS VARCHAR(20)) || ' big">' END AS content
FROM {supplier}
"""


@query(
    "missing_focus",
    f"""SELECT path FROM {duck(_SEM)} t WHERE ext = 'tsx' AND NOT EXISTS (SELECT 1 FROM
 {duck(_SEM)} c WHERE c.ext = 'css' AND c.root = t.root AND
 regexp_extract(c.content, '^\\.(c\\d+)', 1) = regexp_extract(t.content, 'className="(c\\d+)', 1))""",
)
def _(spark, d):
    return markup.missing_focus(view(spark, d, _SEM))


_FORMS = """
SELECT 'site/p' || CAST(s_suppkey AS VARCHAR(20)) || '.html' AS path, 'FORM_NO_SUBMIT_SLOP'
 AS detector_id, s_suppkey AS k, '<form id="f' || CAST(s_suppkey AS VARCHAR(20)) ||
 '"><script src="s' || CAST(s_suppkey % 10 AS VARCHAR(20)) || '.js"></script>' AS content
FROM {supplier}
"""
_SCRIPTS = """
SELECT 'site/s' || CAST(s_suppkey % 10 AS VARCHAR(20)) || '.js' AS path,
 CASE WHEN s_suppkey % 3 = 0 THEN 'document.getElementById("f' || CAST(s_suppkey AS VARCHAR(20))
  || '").addEventListener("submit", go)'
 WHEN s_suppkey % 3 = 1 THEN 'const f = document.querySelector("#f' || CAST(s_suppkey AS VARCHAR(20))
  || '"); f.addEventListener("submit", go)' ELSE 'noop()' END AS content
FROM {supplier}
"""


@query("project_reconcile", f"SELECT path, detector_id FROM {duck(_FORMS)} WHERE k % 3 = 2")
def _(spark, d):
    f = view(spark, d, _FORMS)
    return markup.project_reconcile(
        f.select("path", "detector_id"), f, view(spark, d, _SCRIPTS)
    )


PATTERNS = ["src/vendor/*", "RULE 7 IN", "f1?.tsx", "s3/"]
_GLOBS = (
    "(regexp_matches(path, 'src/vendor/') OR contains(lower(message), 'rule 7 in') "
    "OR regexp_matches(path, 'f1.\\.tsx') OR contains(path, 's3/'))"
)


@query("suppression", f"SELECT path, count(*) AS n FROM {duck(FINDINGS)} WHERE NOT {_GLOBS} GROUP BY path")
def _(spark, d):
    f = markup.suppress(view(spark, d, FINDINGS), PATTERNS)
    return f.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(
    "suppress_prune",
    f"""SELECT count(*) FILTER (WHERE lno <= 4) AS removed_queue,
 count(*) FILTER (WHERE lno > 2) AS removed_baseline FROM {duck(FINDINGS)} WHERE {_GLOBS}""",
)
def _(spark, d):
    f = view(spark, d, FINDINGS)
    return markup.suppress_prune(f.where("lno <= 4"), f.where("lno > 2"), PATTERNS)


_ZPATH = """
SELECT l_orderkey % 500 AS k, CASE l_linenumber WHEN 1 THEN 'src' WHEN 2 THEN 'node_modules'
 WHEN 3 THEN 'Tests' WHEN 4 THEN 'dist' WHEN 5 THEN 'app' WHEN 6 THEN 'scripts' ELSE 'conf' END
 || '/d' || CAST(l_suppkey AS VARCHAR(20)) || CASE l_orderkey % 4 WHEN 0 THEN '/vite.config.ts'
 WHEN 1 THEN '/run.sh' WHEN 2 THEN '/Page.tsx' ELSE '/layout.css' END AS path FROM {lineitem}
"""
_ZSQL = """CASE WHEN contains(p, 'node_modules') OR contains(p, 'vendor') THEN 'vendor'
 WHEN contains(p, 'test') OR contains(p, 'spec') THEN 'test'
 WHEN contains(p, 'config') THEN 'config'
 WHEN contains(p, 'dist') OR contains(p, 'build') OR contains(p, 'out') OR contains(p, '.next')
  THEN 'generated'
 WHEN ends_with(p, '.sh') OR ends_with(p, '.py') OR contains(p, 'scripts') THEN 'script'
 ELSE 'production' END"""


@query(
    "zone_classify",
    f"""SELECT zone, count(*) AS n FROM (SELECT CASE WHEN path LIKE 'app/d1%' THEN 'vendor'
 ELSE {_ZSQL} END AS zone FROM (SELECT path, lower(path) AS p FROM {duck(_ZPATH)})) GROUP BY zone""",
)
def _(spark, d):
    f = view(spark, d, _ZPATH)
    over = f.where("path LIKE 'app/d1%'").select("path", F.lit("vendor").alias("zone")).distinct()
    return (
        f.join(over, "path", "left")
        .select(markup.zone_of(F.col("path"), F.col("zone")).alias("zone"))
        .groupBy("zone")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "queue_filter",
    f"""SELECT 'T3' AS term, count(*) AS n FROM {duck(FINDINGS)} WHERE tier = 'T3'
 UNION ALL SELECT 'RULE_3', count(*) FROM {duck(FINDINGS)} WHERE contains(detector_id, 'RULE_3')
 UNION ALL SELECT '/f12', count(*) FROM {duck(FINDINGS)} WHERE contains(path, '/f12')""",
)
def _(spark, d):
    f = view(spark, d, FINDINGS)
    out = None
    for term in ("T3", "RULE_3", "/f12"):
        one = markup.queue_filter(f, term).agg(F.count(F.lit(1)).alias("n"))
        one = one.select(F.lit(term).alias("term"), "n")
        out = one if out is None else out.unionAll(one)
    return out
