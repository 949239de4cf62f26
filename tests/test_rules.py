"""Rule catalog and predicate rules on small literal sources."""

import re

import pytest
from pyspark.sql import functions as F

from siteaudit.functions.regex import fold, java, required_literals
from siteaudit.operators import markup, rule_scan, scoring
from siteaudit.operators.rule_catalog import RULES
from siteaudit.operators.rule_checks import CHECKS, NEEDS, REPORTED_AS
from siteaudit.sources import documents

# rule, extension, text that must be flagged, text that must not.
CASES = [
    ("TYPOGRAPHY_SLOP", "css", "a { font-family: Inter }", "a { font-family: Geist }"),
    ("COLOR_BLACK_SLOP", "css", "a { color: #000000; }", "a { color: #111; }"),
    ("LOREM_IPSUM_SLOP", "html", "<p>Lorem ipsum dolor</p>", "<p>Real words</p>"),
    ("CONSOLE_LOG_SLOP", "ts", "console.log(1)", "logger.info(1)"),
    ("DEBUGGER_STATEMENT_SLOP", "ts", "debugger;", "bug();"),
    ("IMG_ALT_MISSING_SLOP", "html", "<img src='a'>", "<img src='a' alt=''>"),
    ("MISSING_LANG_SLOP", "html", "<html><p>", "<html lang='en'>"),
    ("HSL_COLOR_TOKEN_SLOP", "css", ":root { --a: hsl(1, 2%, 3%); }", ":root { --a: red; }"),
    ("EMOJI_HEAVY_SLOP", "html", "😀 😀 😀 😀 😀 😀 😀", "😀 only"),
    ("STAR_RATING_SLOP", "html", "★★★★★", "★★"),
    ("VIDEO_NO_CAPTIONS_SLOP", "html", "<video>", "<video><track></video>"),
    ("MISSING_FAVICON_SLOP", "html", "<head></head>", '<head><link rel="icon"></head>'),
    ("IMG_MISSING_DIMENSIONS_SLOP", "html", '<img width="1">', '<img width="1" height="1">'),
    ("PLACEHOLDER_ONLY_INPUT_SLOP", "html", '<input placeholder="x">', '<input id="a" placeholder="x">'),
    ("SELECT_NO_LABEL_SLOP", "html", "<select>", "<label>a</label><select>"),
    ("ORPHANED_LABEL_SLOP", "html", "<label>a</label>", "<label>a <input></label>"),
    ("ORPHANED_LABEL_SLOP", "tsx", '<label for="a">a</label>', '<label htmlFor="a">a</label>'),
    ("CARD_NESTING_SLOP", "html", '<div class="card"><p><b class="my-card">', '<div class="card"></div><i class="card">'),
    ("CARD_NESTING_SLOP", "tsx", "<Card><Card /></Card>", "<Card /><Card />"),
    ("ROUND_NUMBER_SLOP", "html", "<p>99% of users</p>", "<style>a{width:100%}</style><p>x</p>"),
    ("STICKY_WITHOUT_TOP_SLOP", "css", "a { position: sticky }", "a { position: sticky; top: 0 }"),
    ("FONT_DISPLAY_MISSING_SLOP", "css", "@font-face { src: x }", "@font-face { font-display: swap }"),
    ("ALPHA_COLOR_ABUSE_SLOP", "css", "rgba(" * 5, "rgba(" * 4),
    (
        "IMPORTANT_ABUSE_SLOP",
        "css",
        "@media (prefers-reduced-motion: reduce) { a { color: red !important } }",
        "@media (prefers-reduced-motion: reduce) { @supports (x: y) { a { transition: none !important } } }",
    ),
    (
        "CSS_IMPORTANT_ANIMATION_SLOP",
        "css",
        "a { animation: x !important }",
        "@media (prefers-reduced-motion: reduce) { a { animation: none !important } }",
    ),
    ("TAILWIND_FONT_CONFLICT_SLOP", "tsx", '<p className="text-sm text-lg">', '<p className="text-sm md:text-lg">x</p>' * 0 + '<p className="text-sm">'),
    ("TAILWIND_DISPLAY_CONFLICT_SLOP", "tsx", '<p className="grid block">', '<p className="grid gap-2">'),
    ("MISSING_KEY_PROP_SLOP", "tsx", "{a.map((x) => (<Row key={b.map((y) => <I />)} />))}", "{a.map((x) => (<Row key={x} />))}"),
    ("DUPLICATE_IMPORT_SLOP", "ts", "import a from 'x';\nimport b from 'x';", "import a from 'x';\nimport b from 'y';"),
    ("UNUSED_IMPORT", "ts", "import { a, type B as C } from 'x';\na()", "import { a } from 'x';\na()"),
    ("UNUSED_STATE", "tsx", "const [v, setV] = useState(1)", "const [v, setV] = useState(1); v"),
    (
        "USEEFFECT_EMPTY_DEPS_SLOP",
        "tsx",
        "useEffect(() => { doSomethingWith(userIdentifier, 'x'); }, [])",
        "const userIdentifier = 1\nconst doSomethingWith = 2\nuseEffect(() => { doSomethingWith(userIdentifier, 'x'); }, [])",
    ),
    ("NESTED_TERNARY_SLOP", "ts", "a ? b ? c : d : e; a ? b ? c : d : e", "a ? b : c"),
    ("COMMENTED_OUT_CODE", "ts", "// const a = 1\n// return b\n/* if (x) */", "// words only\n// return b"),
    ("PRICING_TABLE_SLOP", "html", "Free Pro Enterprise", "Free Pro"),
    ("HARDCODED_COPYRIGHT_YEAR_SLOP", "html", "© 2024", "© {new Date().getFullYear()}"),
    ("THREE_EQUAL_COLUMN_SLOP", "tsx", '<p className="grid-cols-3"><i className="a"/><i className="a"/><i className="a"/>', '<p className="grid-cols-3"><i className="a"/>'),
    ("NO_PASSIVE_SCROLL_LISTENER_SLOP", "ts", "x.addEventListener('scroll', f);", "x.addEventListener('scroll', f, { passive: true });"),
    ("HERO_HEAVY_SLOP", "tsx", "<Hero/><Hero/>", "<Hero/>"),
    ("HARDCODED_DEV_URL_SLOP", "ts", 'const u = "http://localhost:3000/"', 'const u = "https://x.example/"'),
]


def test_catalog_is_whole():
    ids = [r[0] for r in RULES] + [i for i in CHECKS if i not in REPORTED_AS] + ["MISSING_FOCUS_SLOP"]
    assert len(ids) == len(set(ids))
    # 215 catalog rules and the whole-file heuristics that have their own ids.
    heuristics = {"DASHBOARD_LAYOUT_SLOP", "FEATURE_GRID_SLOP", "STATIC_COMPONENT_SLOP", "HERO_HEAVY_SLOP"}
    assert len(set(ids) - heuristics) == 215
    assert set(NEEDS) <= set(CHECKS)


def test_every_case(spark):
    rows = []
    for i, (_, ext, bad, good) in enumerate(CASES):
        rows += [(f"{i}/bad.{ext}", ext, bad), (f"{i}/good.{ext}", ext, good)]
    src = spark.createDataFrame(rows, "path string, ext string, content string")
    got = {(r.path, r.detector_id) for r in rule_scan.rule_scan(src).select("path", "detector_id").collect()}
    for i, (rule, ext, bad, good) in enumerate(CASES):
        assert (f"{i}/bad.{ext}", rule) in got, (rule, bad)
        assert (f"{i}/good.{ext}", rule) not in got, (rule, good)


def test_literal_guards_never_hide_a_match(spark):
    """Scanning with guards equals evaluating every pattern on every source."""
    rows = [(str(i), e, t) for i, (_, e, b, g) in enumerate(CASES) for t in (b, g)]
    src = spark.createDataFrame(rows, "path string, ext string, content string")
    fast = {(r.path, r.content, r.rule) for r in rule_scan.pattern_hits(src).collect()}
    slow = set()
    for i, (_, _, kinds, fl, p) in enumerate(RULES):
        hit = src.where(F.col("ext").isin(kinds.split()) & F.col("content").rlike(java(p, fl)))
        slow |= {(r.path, r.content, i) for r in hit.collect()} if i % 10 == 0 else set()
    assert {x for x in fast if x[2] % 10 == 0} == slow


@pytest.mark.parametrize("pattern,want", [(r"x(?:bar|quux)\d", ["bar", "quux"]), (r"a|b", None), (r"\bclip-text.*?\d", ["clip-text"])])
def test_required_literals(pattern, want):
    assert required_literals(pattern) == want


def test_fold_keeps_caseless_letters(spark):
    r = spark.createDataFrame([("İſ\u212aı",)], "t string").select(fold(F.col("t"))).first()[0]
    assert r == "iski"


def test_offsets_match_python(spark):
    import re

    text = "aa\nb console.log(1)\n\nconsole.log(2) é console.log(3)"
    src = spark.createDataFrame([("a.ts", "ts", text)], "path string, ext string, content string")
    got = rule_scan.scan_patterns(src, rules=["CONSOLE_LOG_SLOP"]).orderBy("start").collect()
    want = list(re.finditer(r"console\.log\(", text))
    assert [r.start for r in got] == [m.start() for m in want]
    assert [(r.line, r.column) for r in got] == [(2, 3), (4, 1), (4, 18)]
    assert got[0].excerpt == "b console.log(1)"


def test_partitioning_does_not_change_findings(spark):
    rows = [(f"{i}.{e}", e, b) for i, (_, e, b, _) in enumerate(CASES)]
    src = spark.createDataFrame(rows, "path string, ext string, content string")
    one = sorted(r.fingerprint for r in rule_scan.rule_scan(src.repartition(1)).collect())
    many = sorted(r.fingerprint for r in rule_scan.rule_scan(src.repartition(8)).collect())
    assert one == many and len(set(one)) > 20


def test_missing_focus_reads_package_styles(spark):
    css = ".btn:focus-visible { x: y } .nested { &:focus { a: b } } a:focus { c: d }"
    rows = [
        ("p", "p/s.css", "css", css),
        ("p", "p/ok.tsx", "tsx", '<button x className="btn">'),
        ("p", "p/nest.tsx", "tsx", '<button x className="nested">'),
        ("p", "p/link.tsx", "tsx", '<a x className="zz">'),
        ("p", "p/bad.tsx", "tsx", '<button x className="zz">'),
        ("q", "q/util.tsx", "tsx", '<button x className="p-4 focus:ring">'),
        ("q", "q/utilbad.tsx", "tsx", '<button x className="p-4">'),
    ]
    src = spark.createDataFrame(rows, "root string, path string, ext string, content string")
    got = {r.path for r in markup.missing_focus(src).collect()}
    assert got == {"p/bad.tsx", "q/utilbad.tsx"}


def test_offsets_of_very_many_matches(spark):
    lines = [f"é{i % 7 * ' '}console.log({i}); console.log()" for i in range(50_000)]
    text = "\n".join(lines)
    df = spark.createDataFrame([("big", "ts", text), ("none", "ts", ""), ("null", "ts", None)],
                               "path string, ext string, content string")
    got = rule_scan.scan_patterns(df, rules=["CONSOLE_LOG_SLOP"]).orderBy("start").collect()
    want = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\bconsole\.log\s*\(", text)]
    assert [(r.start, r.end, r.matched_text) for r in got] == want
    assert len(got) > 90_000
    assert all(r.line == text.count("\n", 0, r.start) + 1 for r in got[::997])
    assert all(r.excerpt == lines[r.line - 1] for r in got)
    assert all(lines[r.line - 1][r.column - 1 :].startswith("console") for r in got[:2000])


def test_large_pages_are_scanned_and_refused_ones_have_no_score(spark):
    fault = "<img src='a.png'>"
    large = "<p>plain words of a page</p>\n" * 70_000 + fault
    rows = [("large", "html", large), ("small", "html", fault), ("clean", "html", "<p>x</p>"), ("none", "html", None)]
    pages = spark.createDataFrame(rows, "path string, ext string, content string")
    bad = pages.where("path = 'small'").select(
        F.lit("bad").alias("path"), "ext", F.expr("CAST(X'3CFF3E' AS STRING)").alias("content")
    )
    pages = pages.unionByName(bad)
    found = rule_scan.rule_scan(pages, rules=["IMG_ALT_MISSING_SLOP"], exts=["html"])
    assert sorted(r.path for r in found.collect()) == ["large", "small"]
    guarded = rule_scan.rule_scan(pages, rules=["IMG_ALT_MISSING_SLOP"], exts=["html"], max_bytes=1_000_000)
    assert [r.path for r in guarded.collect()] == ["small"]
    status = rule_scan.scan_status(1_000_000)
    got = {r.path: r for r in scoring.score_snapshot(
        guarded, ["path"], F.lit(1.0), subjects=pages, scanned=status == "scanned").collect()}
    assert {k for k, r in got.items() if r.slop is None} == {"large", "none", "bad"}
    assert all(got[k].objective is None and got[k].blended is None for k in ("large", "none", "bad"))
    assert got["clean"].slop == 0 and got["clean"].objective == 100 and got["small"].slop > 0
    assert {r.path: r.s for r in pages.select("path", status.alias("s")).collect()} == {
        "large": "too_large", "small": "scanned", "clean": "scanned", "none": "no_text", "bad": "undecodable"}


def test_every_rule_ends_on_a_large_page(spark):
    part = "<div class='card p-4'><img src='a'><button onClick={f}>Go</button> // TODO x\n</div>\n"
    df = spark.createDataFrame([("x", "html", part * 25_000)], "path string, ext string, content string")
    assert rule_scan.rule_scan(df, exts=["html"]).count() > 25_000


def test_files_that_cannot_be_read_keep_a_row(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "b.html").write_bytes(b"<\xff>")
    (tmp_path / "c.html").write_text("y" * 200)
    got = {r.path[-6:]: (r.scan_status, r.content) for r in documents.read_sources(spark, str(tmp_path), max_bytes=100).collect()}
    assert got == {"a.html": ("scanned", "<p>x</p>"), "b.html": ("undecodable", None), "c.html": ("too_large", None)}
