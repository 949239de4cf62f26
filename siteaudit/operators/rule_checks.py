"""Rules decided by several patterns over one document, as Column predicates.

A check maps (content) to the 0-based offset its finding is anchored at, or NULL when the
document is clean. File-level checks anchor at 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteaudit.functions.regex import java, match_offsets
from siteaudit.operators.rule_catalog import HTML, HTML_SFC, JS_JSX, JSX, MARKUP, SCRIPT, SCRIPT_JSX
from siteaudit.operators.rule_catalog import STYLE, TEMPLATE

Check = Callable[[Column], Column]
CHECKS: dict[str, tuple[str, str, Check]] = {}
# Lower-case literals without which a check cannot fire; tested before its patterns run.
NEEDS: dict[str, str] = {
    "ORPHANED_LABEL_SLOP": "<label",
    "ORPHANED_LABEL_COMPONENT": "<label",
    "SELECT_NO_LABEL_SLOP": "<select",
    "CARD_NESTING_SLOP": "card",
    "ROUND_NUMBER_SLOP": "%",
    "INPUT_IME_ENTER_UNGUARDED_SLOP": "onkeydown",
    "HOVER_ONLY_REVEAL_SLOP": "group-hover:",
    "IMG_MISSING_DIMENSIONS_SLOP": "<img",
    "SRCSET_MISSING_SLOP": "<img",
    "SORTABLE_TABLE_ARIA_SORT_SLOP": "<th",
    "PLACEHOLDER_ONLY_INPUT_SLOP": "placeholder=",
    "MEDIA_AUTOPLAY_SLOP": "autoplay",
    "ANCHOR_TARGET_BLANK_SLOP": "_blank",
    "VIDEO_NO_CAPTIONS_SLOP": "<video",
    "HARDCODED_COPYRIGHT_YEAR_SLOP": "20",
    "SKIP_TO_CONTENT_MISSING_SLOP": "<main",
    "OUTLINE_NONE_SLOP": "outline-none",
    "REDUCED_MOTION_MISSING_SLOP": "animate-",
    "STICKY_WITHOUT_TOP_SLOP": "sticky",
    "FONT_DISPLAY_MISSING_SLOP": "@font-face",
    "IMPORTANT_ABUSE_SLOP": "!important",
    "CSS_IMPORTANT_ANIMATION_SLOP": "!important",
    "MISSING_KEY_PROP_SLOP": ".map",
    "USEEFFECT_EMPTY_DEPS_SLOP": "useeffect",
    "UNUSED_STATE": "usestate",
    "UNUSED_IMPORT": "import",
    "DUPLICATE_IMPORT_SLOP": "import",
    "NO_PASSIVE_SCROLL_LISTENER_SLOP": "addeventlistener",
    "HARDCODED_DEV_URL_SLOP": "http",
    "THREE_EQUAL_COLUMN_SLOP": "grid-cols-3",
    "TAILWIND_FONT_CONFLICT_SLOP": "text-",
    "TAILWIND_WEIGHT_CONFLICT_SLOP": "font-",
}


def has(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group))


def n_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(java(pattern)))


def document(cond: Column) -> Column:
    return F.when(cond, F.lit(0))


def check(rule_id: str, tier: str, exts: str):
    def keep(fn: Check) -> Check:
        CHECKS[rule_id] = (tier, exts, fn)
        return fn

    return keep


# Rule id, tier, extensions, patterns that must occur, patterns that must not.
PRESENT_ABSENT: list[tuple[str, str, str, list[str], list[str]]] = [
    ("VIDEO_NO_CAPTIONS_SLOP", "T2", MARKUP, [r"(?i)<video\b"], [r"(?i)<track\b"]),
    ("FOCUS_OUTLINE_REMOVED_SLOP", "T1", STYLE, [r"(?i):focus\s*\{[^}]*outline:\s*(?:none|0)\b"], []),
    (
        "NO_SELECT_CONTENT_SLOP",
        "T2",
        JSX,
        [
            r"\bselect-none\b",
            r"(?i)<(?!button)(?:[a-z][a-z0-9]*)(?:\s[^>]*)?\bclassName=[^>]*select-none",
        ],
        [],
    ),
    (
        "MISSING_META_DESCRIPTION_SLOP",
        "T2",
        HTML,
        [r"(?i)<head\b"],
        [r"""(?i)<meta\s[^>]*name=["']description["']"""],
    ),
    (
        "SKIP_TO_CONTENT_MISSING_SLOP",
        "T2",
        HTML,
        [r"(?i)<nav\b", r"(?i)<main\b"],
        [r"""(?i)href=["']#"""],
    ),
    (
        "MISSING_FAVICON_SLOP",
        "T2",
        HTML,
        [r"(?i)<head\b"],
        [r"""(?i)rel=["'](?:shortcut icon|icon)["']"""],
    ),
    (
        "CSS_SCROLL_BEHAVIOR_SLOP",
        "T2",
        STYLE,
        [r"(?i)scroll-behavior:\s*smooth"],
        [r"(?i)prefers-reduced-motion"],
    ),
    (
        "GENERIC_FONT_FAMILY_SLOP",
        "T2",
        STYLE,
        [
            r"(?i)font-family:\s*(?:'Inter'|Inter|'Roboto'|Roboto|'Open Sans'|Open Sans"
            r"|'Montserrat'|Montserrat|'Poppins'|Poppins|'Lato'|Lato)"
        ],
        [r"(?i)-apple-system"],
    ),
    (
        "GRID_AUTO_FIT_MISSING_SLOP",
        "T2",
        STYLE,
        [r"(?i)grid-template-columns:\s*repeat\(\s*(?:[2-9]|\d{2,})\s*,"],
        [r"(?i)auto-fit|auto-fill"],
    ),
    (
        "SCROLL_SMOOTH_NO_MOTION_SLOP",
        "T2",
        JSX,
        [r"\bscroll-smooth\b"],
        [r"motion-reduce:scroll-auto"],
    ),
    ("DANGEROUS_HTML_SLOP", "T1", JSX, [r"dangerouslySetInnerHTML"], [r"DOMPurify"]),
    (
        "DOCUMENT_COOKIE_SSR_SLOP",
        "T2",
        SCRIPT,
        [r"\bdocument\.cookie\b"],
        [r"typeof\s+(?:window|document)\s*!=="],
    ),
    ("INNER_HTML_ASSIGN_SLOP", "T1", SCRIPT, [r"\.innerHTML\s*[+]?=\s*"], [r"DOMPurify"]),
    ("NAVIGATOR_SSR_SLOP", "T2", SCRIPT, [r"\bnavigator\.\w+"], [r"typeof\s+window\s*!=="]),
    (
        "POSTMESSAGE_ORIGIN_MISSING_SLOP",
        "T1",
        SCRIPT,
        [r"""addEventListener\s*\(\s*['"]message['"]"""],
        [r"event\.origin|e\.origin"],
    ),
    (
        "LOCALSTORAGE_SSR_SLOP",
        "T2",
        SCRIPT,
        [r"\b(?:localStorage|sessionStorage)\b"],
        [
            r"""typeof\s+window\s*!==\s*["']undefined["']""",
            r"useEffect\s*\(\s*(?:\(\s*\)|[^,)]+)\s*=>\s*\{[^}]*(?:localStorage|sessionStorage)",
        ],
    ),
    (
        "WINDOW_OBJECT_SSR_SLOP",
        "T2",
        SCRIPT,
        [r"\bwindow\.\w+"],
        [
            r"""typeof\s+window\s*!==\s*["']undefined["']""",
            r"useEffect\s*\(\s*(?:\(\s*\)|[^,)]+)\s*=>\s*\{[^}]*window\.",
        ],
    ),
    (
        "FRAMER_NO_REDUCED_MOTION_SLOP",
        "T2",
        JSX,
        [r"""from ['"]framer-motion['"]""", r"\bmotion\."],
        [r"useReducedMotion"],
    ),
    ("LAZY_WITHOUT_SUSPENSE_SLOP", "T2", JS_JSX, [r"(?:React\.)?lazy\s*\("], [r"Suspense"]),
    (
        "MODAL_NO_ARIA_SLOP",
        "T2",
        JSX,
        [
            r"""(?i)<(?:div|section|aside)\b[^>]*(?:className|class)=["'][^"']*"""
            r"(?<![\w-])modal(?![\w-])"
        ],
        [r"(?i)<dialog\b", r"""(?i)role=["']dialog["']"""],
    ),
    (
        "NEXT_IMAGE_RAW_SLOP",
        "T2",
        JSX,
        [r"""from ['"]next/""", r"(?i)<img\b"],
        [r"""from ['"]next/image['"]"""],
    ),
    ("MISSING_LOADING_STATE_SLOP", "T2", JSX, [r"\buseQuery\b"], [r"\bisLoading\b"]),
    (
        "MISSING_ERROR_STATE_SLOP",
        "T2",
        JSX,
        [r"\buseQuery\b", r"\bisLoading\b"],
        [r"\bisError\b|\berror\b"],
    ),
    (
        "FONT_WEIGHT_EXTREMES_SLOP",
        "T2",
        JSX,
        [r"\bfont-bold\b", r"\bfont-normal\b"],
        [r"\bfont-medium\b|\bfont-semibold\b"],
    ),
    ("ACCORDION_FAQ_SLOP", "T2", JSX, [r"(?i)\bAccordion\b", r"(?i)\bFAQ\b"], []),
    (
        "DARK_MODE_TOGGLE_SLOP",
        "T2",
        JSX,
        [r"(?i)(?:ThemeToggle|toggleDarkMode|DarkModeToggle|darkMode)"],
        [r"(?i)prefers-color-scheme"],
    ),
    (
        "HARDCODED_COPYRIGHT_YEAR_SLOP",
        "T2",
        MARKUP,
        [r"(?i)©\s*20\d{2}|&copy;\s*20\d{2}"],
        [r"getFullYear\s*\(\s*\)"],
    ),
]


def _presence(present: list[str], absent: list[str]) -> Check:
    def build(c: Column) -> Column:
        cond = F.lit(True)
        for p in present:
            cond = cond & has(c, p)
        for p in absent:
            cond = cond & ~has(c, p)
        return document(cond)

    return build


for _id, _tier, _exts, _on, _off in PRESENT_ABSENT:
    CHECKS[_id] = (_tier, _exts, _presence(_on, _off))


# ---- one tag (or block) whose own text fails a predicate -------------------------------

def _any(spans: str, bad: Callable[[Column], Column], group: int = 0) -> Check:
    return lambda c: document(F.exists(found(c, spans, group), bad))


CLASS_LIST = r"""(?i)class(?:Name)?=["']([^"']*)["']"""


@check("ANCHOR_TARGET_BLANK_SLOP", "T1", MARKUP)
def _(c):
    safe = has(c, "(?i)noopener") & has(c, "(?i)noreferrer")
    return document(has(c, r"""(?i)target=["']_blank["']""") & ~safe)


CHECKS["IMG_MISSING_DIMENSIONS_SLOP"] = (
    "T2",
    MARKUP,
    _any(
        r"(?i)<img\b[^>]*>",
        lambda t: ~(has(t, r"(?i)\bwidth=") & has(t, r"(?i)\bheight=")),
    ),
)
CHECKS["PLACEHOLDER_ONLY_INPUT_SLOP"] = (
    "T2",
    MARKUP,
    _any(
        r"(?i)<input\b[^>]*>",
        lambda t: has(t, r"(?i)\bplaceholder=")
        & ~has(t, r"(?i)\bid=")
        & ~has(t, r"(?i)\baria-label(?:ledby)?="),
    ),
)
CHECKS["SORTABLE_TABLE_ARIA_SORT_SLOP"] = (
    "T2",
    MARKUP,
    _any(
        r"(?is)<th\b[^>]*>.*?</th>",
        lambda t: (
            has(F.substring_index(t, ">", 1), r"\bonClick\s*=")
            | has(F.regexp_extract(t, r"(?s)^[^>]*>(.*)$", 1), r"(?i)<button\b")
        )
        & ~has(F.substring_index(t, ">", 1), r"\baria-sort\s*="),
    ),
)
CHECKS["OUTLINE_NONE_SLOP"] = (
    "T1",
    JSX,
    _any(
        r"""(?i)class(?:Name)?=["']([^"']*outline-none[^"']*)["']""",
        lambda t: ~t.contains("focus-visible:") & ~t.contains("focus:ring"),
        1,
    ),
)
CHECKS["REDUCED_MOTION_MISSING_SLOP"] = (
    "T2",
    JSX,
    _any(
        r"""(?i)class(?:Name)?=["']([^"']*animate-[^"']*)["']""",
        lambda t: ~t.contains("motion-reduce:"),
        1,
    ),
)
CHECKS["STICKY_WITHOUT_TOP_SLOP"] = (
    "T1",
    STYLE,
    _any(
        r"(?is)position:\s*sticky[^}]*",
        lambda t: ~has(t, r"(?i)(?:\btop|inset-block-start|inset)\s*:"),
    ),
)
CHECKS["FONT_DISPLAY_MISSING_SLOP"] = (
    "T1",
    STYLE,
    _any(r"(?is)@font-face\s*\{([^}]*)\}", lambda t: ~t.contains("font-display"), 1),
)
CHECKS["MEDIA_AUTOPLAY_SLOP"] = (
    "T1",
    MARKUP,
    _any(
        r"(?i)<(?:video|audio)\b([^>]*)",
        lambda t: has(t, r"(?i)\bautoplay\b") & ~has(t, r"(?i)\bmuted\b"),
        1,
    ),
)
CHECKS["ICON_ONLY_BUTTON_SLOP"] = (
    "T1",
    JSX,
    _any(r"(?i)<button\b([^>]*)>\s*<(?:svg|i)\b", lambda t: ~has(t, r"(?i)aria-label="), 1),
)
CHECKS["MISSING_ARIA_ROLE_SLOP"] = (
    "T2",
    MARKUP,
    _any(
        r"(?i)<(?:div|span)\s[^>]*on(?:Click|Keydown|Keyup)[^>]*>",
        lambda t: ~has(t, r"(?i)\brole="),
    ),
)


@check("SRCSET_MISSING_SLOP", "T2", MARKUP)
def _(c):
    plain = F.exists(
        found(c, r"(?i)<img\b[^>]*>"), lambda t: ~has(t, r"""(?i)src=["']data:""")
    )
    return document(plain & ~has(c, r"\bsrcset=|\bsrcSet="))


@check("HOVER_ONLY_REVEAL_SLOP", "T2", TEMPLATE)
def _(c):
    def bad(k):
        shown = F.regexp_extract(
            k, java(r"(?:^|\s)group-hover:(opacity-100|visible|block)\b"), 1
        )
        keyboard = F.lit(False)
        for word in ("opacity-100", "visible", "block"):
            same = rf"(?:^|\s)(?:group-focus|group-focus-within|focus|focus-visible):{word}\b"
            keyboard = keyboard | ((shown == word) & has(k, same))
        hidden = has(k, r"(?:^|\s)(?:hidden|invisible|opacity-0)(?:\s|$)")
        return hidden & (shown != "") & ~keyboard

    return document(F.exists(found(c, CLASS_LIST, 1), bad))


def _context(c: Column, tag: str, before: int, after: int, fine: str) -> Column:
    """Some tag has no ``fine`` match within a character window around its start."""
    spots = match_offsets(c, F.lit(java(tag)))
    return document(
        F.exists(
            spots,
            lambda o: ~has(
                F.substring(
                    c,
                    F.greatest(o["start"] - before, F.lit(0)) + 1,
                    F.least(o["start"], F.lit(before)) + after,
                ),
                fine,
            ),
        )
    )


@check("SELECT_NO_LABEL_SLOP", "T2", MARKUP)
def _(c):
    return _context(c, r"(?i)<select\b[^>]*", 200, 200, r"(?i)<label\b|aria-label=|aria-labelledby=")


@check("ICON_ARIA_MISSING_SLOP", "T2", JSX)
def _(c):
    return _context(
        c, r"(?i)<svg\b[^>]*>|<i\s+class=[^>]+>", 100, 200, r"(?i)aria-(?:label|hidden|labelledby)="
    )


@check("ORPHANED_LABEL_SLOP", "T1", HTML_SFC)
def _(c):
    return _orphan(c, r"(?i)\bfor\s*=")


@check("ORPHANED_LABEL_COMPONENT", "T1", JSX)
def _(c):
    return _orphan(c, r"\bhtmlFor\s*=")


def _orphan(c: Column, tie: str) -> Column:
    spots = match_offsets(c, F.lit(java(r"(?i)<label\b[^>]*>")))

    def bad(o):
        rest = F.substring(c, o["end"] + 1, F.length(c))
        inner = F.when(rest.contains("</label>"), F.substring_index(rest, "</label>", 1))
        nested = F.coalesce(has(inner, r"(?i)<(?:input|select|textarea)\b"), F.lit(False))
        return ~has(o["text"], tie) & ~nested

    return F.get(F.filter(spots, bad), 0)["start"]


# ---- counts ----------------------------------------------------------------------------


@check("DIV_SOUP_SLOP", "T2", TEMPLATE)
def _(c):
    semantic = r"(?i)<(?:nav|main|article|section|aside|header|footer)[\s>]"
    return document((n_of(c, r"(?i)<div[\s>]") > 20) & ~has(c, semantic))


@check("NESTED_TERNARY_SLOP", "T2", SCRIPT_JSX)
def _(c):
    return document(n_of(c, r"\?[^:?\n]{0,80}\?") >= 2)


@check("ALPHA_COLOR_ABUSE_SLOP", "T2", STYLE)
def _(c):
    return document(n_of(c, r"(?i)(?:rgba|hsla)\s*\(") >= 5)


@check("COMMENTED_OUT_CODE", "T1", SCRIPT_JSX)
def _(c):
    dead = (
        r"(?m)^\s*(?://|/\*|\*|\{/\*)\s*(?:<[A-Z]|"
        r"(?:const|let|var|function|import|export|return|if|for|while)\s|"
        r"(?:className|onClick|onChange|style)=|\w+\.\w+\(|"
        r"\}\s*(?:else|catch|finally)|(?:await|async)\s)"
    )
    lines = F.split(c, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]", -1)
    return document(F.size(F.filter(lines, lambda x: has(F.trim(x), dead))) >= 3)


@check("PRICING_TABLE_SLOP", "T3", MARKUP)
def _(c):
    words = ("Free", "Pro", "Enterprise", "Starter", "Basic", "Premium")
    n = sum((has(c, rf"(?i)\b{w}\b").cast("int") for w in words), F.lit(0))
    return document(n >= 3)


@check("THREE_EQUAL_COLUMN_SLOP", "T2", JSX)
def _(c):
    names = found(c, r"""className=["']([^"']+)["']""", 1)
    most = F.array_max(
        F.transform(
            F.array_distinct(names), lambda k: F.size(F.filter(names, lambda x: x == k))
        )
    )
    return document(has(c, r"(?i)grid-cols-3\b") & (most >= 3))


# ---- class conflicts -------------------------------------------------------------------

SIZES = [f"text-{s}" for s in "xs sm base lg xl 2xl 3xl 4xl 5xl 6xl 7xl 8xl 9xl".split()]
WEIGHTS = [
    f"font-{w}"
    for w in "thin extralight light normal medium semibold bold extrabold black".split()
]


def _uses(k: Column, word: str) -> Column:
    return has(k, rf"(?<![a-z-]){word}(?![a-zA-Z0-9-])")


def _two_of(words: list[str]) -> Check:
    def bad(k):
        return sum((_uses(k, w).cast("int") for w in words), F.lit(0)) >= 2

    return _any(r"""(?i)class(?:Name)?=["']([^"']+)["']""", bad, 1)


CHECKS["TAILWIND_FONT_CONFLICT_SLOP"] = ("T1", JSX, _two_of(SIZES))
CHECKS["TAILWIND_WEIGHT_CONFLICT_SLOP"] = ("T1", JSX, _two_of(WEIGHTS))


@check("TAILWIND_DISPLAY_CONFLICT_SLOP", "T1", JSX)
def _(c):
    def bad(k):
        flex, block, grid = _uses(k, "flex"), _uses(k, "block"), _uses(k, "grid")
        return (_uses(k, "hidden") & (flex | block | grid)) | (block & (flex | grid))

    return document(F.exists(found(c, r"""(?i)class(?:Name)?=["']([^"']+)["']""", 1), bad))


# ---- blocks, listeners, hooks ----------------------------------------------------------


def balanced(rest: Column, opener: str, closer: str) -> Column:
    """Prefix of ``rest`` up to the bracket closing its first ``opener``; NULL if unclosed."""
    bits = F.split(rest, rf"(?<=[\{opener}\{closer}])", -1)

    def step(acc, bit):
        depth = (
            acc["depth"]
            + F.when(F.endswith(bit, F.lit(opener)), 1).otherwise(0)
            - F.when(F.endswith(bit, F.lit(closer)), 1).otherwise(0)
        )
        pos = acc["pos"] + F.length(bit)
        closed = (depth == 0) & F.endswith(bit, F.lit(closer))
        return F.struct(
            F.when(acc["end"] > 0, acc["depth"]).otherwise(depth).alias("depth"),
            pos.alias("pos"),
            F.when(acc["end"] > 0, acc["end"]).when(closed, pos).otherwise(0).alias("end"),
        )

    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("end"))
    return F.aggregate(
        bits, zero, step, lambda a: F.when(a["end"] > 0, F.substring(rest, F.lit(1), a["end"]))
    )


MOTION_MEDIA = r"(?i)@media\s*\([^)]*prefers-reduced-motion\s*:\s*reduce[^)]*\)\s*\{"
# Properties a reduced-motion block may force.
MOTION_PROPERTIES = [
    "animation",
    "animation-delay",
    "animation-duration",
    "animation-iteration-count",
    "scroll-behavior",
    "transition",
    "transition-delay",
    "transition-duration",
]


def _motion_spans(c: Column) -> Column:
    """Spans of reduced-motion blocks, from the opening brace to the closing one."""
    spans = F.transform(
        match_offsets(c, F.lit(java(MOTION_MEDIA))),
        lambda o: F.struct(
            (o["end"] - 1).alias("a"),
            (
                o["end"]
                - 2
                + F.length(balanced(F.substring(c, o["end"], F.length(c)), "{", "}"))
            ).alias("b"),
        ),
    )
    return F.filter(spans, lambda s: s["b"].isNotNull())


def _important(pattern: str, exempt_all: bool) -> Check:
    def build(c):
        spans = _motion_spans(c)

        def bad(o):
            inside = F.exists(spans, lambda s: (o["start"] >= s["a"]) & (o["start"] <= s["b"]))
            if exempt_all:
                return ~inside
            prop = F.lower(
                F.regexp_extract(
                    F.substring(c, F.lit(1), o["start"]), java(r"([-\w]+)\s*:\s*[^;{}]*$"), 1
                )
            )
            return ~(inside & prop.isin(MOTION_PROPERTIES))

        return F.get(F.filter(match_offsets(c, F.lit(java(pattern))), bad), 0)["start"]

    return build


CHECKS["IMPORTANT_ABUSE_SLOP"] = ("T2", STYLE, _important(r"(?i)!important", False))
CHECKS["CSS_IMPORTANT_ANIMATION_SLOP"] = (
    "T1",
    STYLE,
    _important(r"(?i)(?:transition|animation):[^;]*!important", True),
)


@check("NO_PASSIVE_SCROLL_LISTENER_SLOP", "T2", SCRIPT)
def _(c):
    call = (
        r"""addEventListener\s*\(\s*['"](?:scroll|touchstart|touchmove|wheel)['"][^;]*;?"""
    )
    return document(
        F.exists(
            found(c, call),
            lambda t: ~has(t, r"(?i)\bpassive\s*:\s*true\b")
            & ~has(t, r"\.preventDefault\s*\("),
        )
    )


@check("INPUT_IME_ENTER_UNGUARDED_SLOP", "T2", TEMPLATE)
def _(c):
    key = r"""\b[A-Za-z_$][\w$]*\.(?:key|code)\s*={2,3}\s*["']Enter["']"""

    def bad(o):
        head = F.substring(c, F.lit(1), o["start"])
        # Text since the nearest <input or <textarea before the comparison.
        near = F.regexp_extract(head, r"(?s)^.*(<(?:input|textarea).*)$", 1)
        after_key = F.substring_index(near, "onKeyDown", -1)
        tail = F.substring(c, o["start"] + 1, F.length(o["text"]) + 300)
        return (
            (near != "")
            & (F.length(near) <= 600)
            & near.contains("onKeyDown")
            & ~after_key.contains("/>")
            & ~F.concat(near, tail).contains("isComposing")
        )

    return document(F.exists(match_offsets(c, F.lit(java(key))), bad))


@check("ROUND_NUMBER_SLOP", "T2", TEMPLATE)
def _(c):
    number = r"(?<!\d)99%(?!\d)|(?<!\d)100%(?!\.\d)|(?<!\d)\d+\.0+%"

    def visible(o):
        head = F.substring(c, F.lit(1), o["start"])
        rest = F.substring(c, o["end"] + 1, F.length(c))
        low = F.lower(head)
        in_text = head.contains(">") & ~F.substring_index(head, ">", -1).contains("<")
        outside = F.lit(True)
        for tag in ("script", "style"):
            opened = low.contains(f"<{tag}")
            since = F.substring_index(low, f"<{tag}", -1)
            outside = outside & (~opened | since.contains(f"</{tag}"))
        return in_text & rest.contains("<") & outside

    return F.get(F.filter(match_offsets(c, F.lit(java(number))), visible), 0)["start"]


@check("MISSING_KEY_PROP_SLOP", "T1", JSX)
def _(c):
    def bad(o):
        rest = F.substring(c, o["end"], F.length(c))
        call = F.coalesce(balanced(rest, "(", ")"), rest)
        return has(call, r"<[A-Z][a-zA-Z]*\b|<[a-z][a-z-]+\b") & ~has(call, r"\bkey=")

    return document(F.exists(match_offsets(c, F.lit(java(r"\.map\s*\("))), bad))


@check("DUPLICATE_IMPORT_SLOP", "T1", SCRIPT)
def _(c):
    mods = found(c, r"""import\s+[^;]+\s+from\s+['"]([^'"]+)['"]""", 1)
    return document(F.size(mods) > F.size(F.array_distinct(mods)))


IMPORT = (
    r"(?m)^import\s+(?:(?:type\s+)?(\w+)(?:\s*,\s*\{([^}]+)\})?|\{([^}]+)\}|\*\s+as\s+(\w+))"
    r"""\s+from\s+["'][^"']+["'];?\s*$"""
)


def import_names(c: Column) -> Column:
    """Local names bound by ES import statements."""

    def clean(part):
        name = F.trim(F.regexp_replace(F.trim(part), r"^type ", ""))
        return F.trim(F.substring_index(name, " as ", -1))

    named = F.flatten(
        F.transform(
            F.concat(found(c, IMPORT, 2), found(c, IMPORT, 3)), lambda g: F.split(g, ",")
        )
    )
    names = F.concat(found(c, IMPORT, 1), found(c, IMPORT, 4), F.transform(named, clean))
    return F.filter(names, lambda n: (n != "") & (n != "type"))


def _count_word(c: Column, word: Column) -> Column:
    return F.regexp_count(c, F.concat(F.lit(r"(?dU)\b\Q"), word, F.lit(r"\E\b")))


@check("UNUSED_IMPORT", "T1", SCRIPT_JSX)
def _(c):
    return document(F.exists(import_names(c), lambda n: _count_word(c, n) <= 1))


@check("UNUSED_STATE", "T2", JSX)
def _(c):
    names = found(c, r"const\s+\[(\w+),\s*set\w+\]\s*=\s*useState", 1)
    return document(F.exists(names, lambda n: _count_word(c, n) <= 1))


# Names an effect may read without declaring them.
STABLE_NAMES = (
    "String Number Boolean Date Math JSON Promise Error Object Array console document "
    "window undefined null true false"
).split()
KEYWORDS = (
    "if else return const let var function async await try catch finally throw new typeof "
    "instanceof void"
).split()


@check("USEEFFECT_EMPTY_DEPS_SLOP", "T2", JSX)
def _(c):
    ident = r"[A-Za-z_$][\w$]*"
    stable = F.concat(
        import_names(c),
        found(c, rf"\[[^,\]]+,\s*({ident})\]\s*=\s*useState", 1),
        found(c, rf"(?m)^(?:export\s+)?const\s+({ident})\s*=", 1),
        F.array(*[F.lit(n) for n in STABLE_NAMES + KEYWORDS]),
    )
    effect = r"(?s)useEffect\s*\(\s*\(\s*\)\s*=>\s*\{(.*?)\}\s*,\s*\[(\s*\]\s*\))?"
    effects = F.arrays_zip(
        found(c, effect, 1).alias("body"), found(c, effect, 2).alias("closed")
    )

    def bad(e):
        body = e["body"]
        bare = F.regexp_replace(body, r"""(?d)'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*\"""", "")
        params = F.concat(
            found(body, rf"(?:\(|,)\s*({ident})\s*(?:\)|,)\s*=>", 1),
            F.flatten(
                F.transform(
                    found(body, r"\(\s*[\[{]([^\]}]+)[\]}]\s*\)\s*=>", 1),
                    lambda d: found(d, rf"\b{ident}\b"),
                )
            ),
        )
        free = F.array_except(
            found(bare, rf"\b{ident}\b"),
            F.concat(
                found(bare, rf"\.\s*({ident})", 1),
                found(body, rf"\b(?:const|let|var)\s+({ident})", 1),
                params,
                stable,
            ),
        )
        return (e["closed"] != "") & (F.length(F.trim(body)) >= 30) & (F.size(free) > 0)

    return document(F.exists(effects, bad))


@check("CARD_NESTING_SLOP", "T2", TEMPLATE)
def _(c):
    return document(nested_cards(c))


# Tags without a closing tag.
VOID_TAGS = "area base br col embed hr img input link meta source track wbr".split()


def nested_cards(c: Column) -> Column:
    """A card tag opened while another card is open: a stack fold over the tag stream."""
    tags = F.transform(
        found(c, r"(?s)</?[A-Za-z][\w.]*\b[^>]*>"),
        lambda t: F.struct(
            F.startswith(t, F.lit("</")).alias("close"),
            F.lower(F.regexp_extract(t, r"^</?([A-Za-z][\w.]*)", 1)).alias("tag"),
            has(t, r"/\s*>$").alias("self"),
            (
                has(t, r"(?i)^<[\w.]*card\b")
                | F.exists(
                    F.split(
                        F.lower(
                            F.regexp_extract(
                                t, r"""(?i)class(?:Name)?=["']([^"']*)["']""", 1
                            )
                        ),
                        r"\s+",
                    ),
                    lambda k: (k == "card") | F.endswith(k, F.lit("-card")),
                )
            ).alias("card"),
        ),
    )

    def step(acc, t):
        stack = acc["stack"]
        # Closing a tag pops down to (and including) its nearest open twin, or everything.
        twin = F.size(stack) - F.array_position(
            F.reverse(F.transform(stack, lambda s: s["tag"])), t["tag"]
        )
        has_twin = F.exists(stack, lambda s: s["tag"] == t["tag"])
        popped = F.when(has_twin, F.slice(stack, F.lit(1), twin.cast("int"))).otherwise(
            F.slice(stack, 1, 0)
        )
        opens = ~t["self"] & ~t["tag"].isin(VOID_TAGS)
        pushed = F.when(
            opens,
            F.concat(stack, F.array(F.struct(t["tag"].alias("tag"), t["card"].alias("card")))),
        ).otherwise(stack)
        hit = ~t["close"] & t["card"] & F.exists(stack, lambda s: s["card"])
        return F.struct(
            F.when(t["close"], popped).otherwise(pushed).alias("stack"),
            (acc["hit"] | hit).alias("hit"),
        )

    zero = F.struct(
        F.array().cast("array<struct<tag:string,card:boolean>>").alias("stack"),
        F.lit(False).alias("hit"),
    )
    return has(c, r"(?i)card") & F.aggregate(tags, zero, step, lambda a: a["hit"])


@check("HARDCODED_DEV_URL_SLOP", "T1", SCRIPT)
def _(c):
    return document(has(c, DEV_URL))


DEV_URL = r"""["']https?://(?:localhost(?::\d+)?|127\.0\.0\.1(?::\d+)?)(?:[/"']|$)"""
# Files whose development URLs may belong to a proxy.
DEV_CONFIGS = [
    f"{tool}.config.{ext}"
    for tool in ("playwright", "vite", "vitest", "webpack")
    for ext in ("js", "ts")
]


def dev_proxy_exempt(path: Column, c: Column) -> Column:
    """Every development URL of the file sits in tool configuration (an open proxy block)."""
    name = F.substring_index(path, "/", -1)

    def in_proxy(o):
        head = F.substring(c, F.lit(1), o["start"])
        block = F.concat(F.lit("{"), F.regexp_extract(head, r"(?s)^.*\bproxy\s*:\s*\{(.*)$", 1))
        return has(head, r"\bproxy\s*:\s*\{") & (
            F.regexp_count(block, F.lit(r"\{")) > F.regexp_count(block, F.lit(r"\}"))
        )

    spots = match_offsets(c, F.lit(java(DEV_URL)))
    return name.isin(DEV_CONFIGS) & (
        F.startswith(name, F.lit("playwright.config.")) | F.forall(spots, in_proxy)
    )


# ---- whole-file layout heuristics (component sources only) -----------------------------


@check("DASHBOARD_LAYOUT_SLOP", "T3", JSX)
def _(c):
    cards = n_of(c, r"(?i)<(?:\w+Card|\w+Stat|\w+Metric|\w+KPI)\b[^>]*>")
    return document(
        (cards >= 4)
        & has(
            c,
            r"(?i)<(?:\w*Chart|\w*Graph|LineChart|BarChart|PieChart|AreaChart|ResponsiveContainer)\b",
        )
    )


@check("FEATURE_GRID_SLOP", "T3", JSX)
def _(c):
    block = (
        r"(?i)<(?:div|section|article|li)\s[^>]*>[\s\S]{30,300}?(?:<\w+Icon|<Icon\b|icon=|<svg\b)"
        r"[\s\S]{10,200}?(?:<h[23456]|<(?:Title|Heading|CardTitle))"
        r"[\s\S]{10,200}?(?:<p\b|<(?:Description|Text|CardDescription))"
    )
    return document(n_of(c, block) >= 3)


@check("PRICING_LAYOUT", "T3", JSX)
def _(c):
    signals = n_of(
        c,
        r"(?i)\$\d+|/mo(?:nth)?\b|/yr\b|/year\b|"
        r"\b(?:free|popular|recommended|enterprise|pro|starter|basic|premium)\b",
    )
    cards = n_of(c, r"(?i)(?:PricingCard|PricingTier|PricingPlan|price-card)")
    context = has(c, r"(?i)\b(?:pricing|price|plan|tier|subscription)\b")
    return document((context & (signals >= 3)) | (cards >= 3))


@check("STATIC_COMPONENT_SLOP", "T2", JSX)
def _(c):
    live = (
        r"(?:onClick|onChange|onSubmit|onPress|onFocus|onBlur|onKeyDown|onMouseEnter|onHover|"
        r"hover:|focus:|active:|useState|useReducer|motion\.|animate)"
    )
    task = r"<(?:a|button|input|select|textarea|summary|form|Route|Routes|Link|NavLink)\b"
    lines = F.regexp_count(c, F.lit(r"\n")) + F.when(~F.endswith(c, F.lit("\n")), 1).otherwise(0)
    return document(~has(c, live) & ~has(c, task) & (n_of(c, r"<[A-Z]\w+") >= 5) & (lines > 50))


@check("HERO_HEAVY_SLOP", "T2", JSX)
def _(c):
    heroes = n_of(c, r"hero|Hero|HERO")
    return document((heroes >= 2) & (n_of(c, r"(?i)<section\b") <= 3))


@check("TESTIMONIAL_LAYOUT", "T2", JSX)
def _(c):
    signal = r"(?i)testimonial|<blockquote\b|\bquote=|\brating=|\bstars?=|avatar.*?(?:name|title)"
    return document(n_of(c, signal) >= 3)


# Checks that report under the id of another rule.
REPORTED_AS = {
    "ORPHANED_LABEL_COMPONENT": "ORPHANED_LABEL_SLOP",
    "PRICING_LAYOUT": "PRICING_TABLE_SLOP",
    "TESTIMONIAL_LAYOUT": "TESTIMONIAL_GRID_SLOP",
}
