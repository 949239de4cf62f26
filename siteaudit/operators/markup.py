"""Element table of raw markup, and the rules that need it or a second file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.operators.rule_checks import VOID_TAGS, found, has
from siteaudit.plans.session import small

TAG = r"</?[a-zA-Z][^>]*>"


def html_elements(sources: DataFrame) -> DataFrame:
    """(path, pos, tag, closing, attrs, delta, depth), in document order.

    One document is one group, and the size guard bounds a document.
    """
    tags = sources.select(
        "path", F.posexplode(F.regexp_extract_all("content", F.lit(TAG), F.lit(0))).alias("pos", "t")
    )
    name = F.lower(F.regexp_extract("t", r"^</?([a-zA-Z][a-zA-Z0-9-]*)", 1))
    closing = F.startswith("t", F.lit("</"))
    flat = F.endswith("t", F.lit("/>")) | name.isin(VOID_TAGS)
    delta = F.when(closing, -1).when(flat, 0).otherwise(1)
    run = Window.partitionBy("path").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return tags.select(
        "path",
        "pos",
        name.alias("tag"),
        closing.alias("closing"),
        F.regexp_extract("t", r"^</?[a-zA-Z][a-zA-Z0-9-]*\s*([^>]*?)\s*/?>$", 1).alias("attrs"),
        delta.alias("delta"),
    ).withColumn("depth", F.sum("delta").over(run) - F.when(F.col("delta") == 1, 1).otherwise(0))


def element_parents(elements: DataFrame) -> DataFrame:
    """Opening tags with the position of the enclosing one (-1 at the root)."""
    opened = elements.where(~F.col("closing"))
    # A tag is a candidate parent on its own level and a child on the level above.
    as_parent = opened.select(
        "path", F.col("depth").alias("lvl"), "pos", F.lit(None).cast("string").alias("tag"),
        F.when(F.col("delta") == 1, F.col("pos")).alias("ppos"),
    )
    as_child = opened.select(
        "path", (F.col("depth") - 1).alias("lvl"), "pos", "tag", F.lit(None).cast("int").alias("ppos")
    )
    w = Window.partitionBy("path", "lvl").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        as_parent.unionByName(as_child)
        .withColumn("parent", F.coalesce(F.last("ppos", ignorenulls=True).over(w), F.lit(-1)))
        .where("tag IS NOT NULL")
        .select("path", "pos", "tag", "parent", (F.col("lvl") + 1).alias("depth"))
    )


def structure_counters(elements: DataFrame) -> DataFrame:
    """Per document: div and semantic counts, nesting, largest run of same-tag siblings."""
    semantic = "nav main article section aside header footer".split()
    base = elements.where(~F.col("closing")).groupBy("path").agg(
        F.count_if(F.col("tag") == "div").alias("divs"),
        F.count_if(F.col("tag").isin(semantic)).alias("semantic"),
        F.max("depth").alias("max_depth"),
    )
    twins = (
        element_parents(elements)
        .groupBy("path", "parent", "tag")
        .count()
        .groupBy("path")
        .agg(F.max("count").alias("max_twins"))
    )
    return base.join(twins, "path").select(
        "*",
        ((F.col("divs") > 20) & (F.col("semantic") == 0)).alias("div_soup"),
        (F.col("max_twins") >= 4).alias("identical_siblings"),
        (F.col("max_depth") >= 5).alias("deep_nesting"),
    )


# ---- interaction states across files ---------------------------------------------------

# Class prefixes that mark a utility-class author.
UTILITY = (
    r"^(?:[a-z-]+:)*(?:bg-|text-|p[trblxy]?-|m[trblxy]?-|gap-|space-[xy]-|border(?:-|$)|"
    r"rounded(?:-|$)|shadow(?:-|$)|ring(?:-|$)|w-|h-|min-[wh]-|max-[wh]-|grid(?:-|$)|"
    r"flex(?:-|$)|items-|justify-|font-|leading-|tracking-|opacity-|cursor-|"
    r"transition(?:-|$)|duration-|ease-|outline(?:-|$))"
)
STATE_WORDS = {"hover": "hover", "focus": "focus|focus-visible"}
STATE_VARIANTS = {"hover": ["hover:"], "focus": ["focus:", "focus-visible:"]}


def css_states(sources: DataFrame) -> DataFrame:
    """Distinct (root, kind, name, state): classes and tags styled in a state per package."""
    css = sources.where(F.col("ext") == "css")
    out = None
    for state, words in STATE_WORDS.items():
        at = rf":(?:{words})\b"
        cls = (
            r"(?s)(?=\.([A-Za-z_][\w-]*)(?:(?:\[[^\]]+\]|:[\w-]+(?:\([^)]*\))?)*"
            + at
            + r"|\s*\{[^{}]*&"
            + at
            + "))"
        )
        classes = css.select("root", F.explode(found(F.col("content"), cls, 1)).alias("name"))
        sel = css.select("root", F.explode(found(F.col("content"), r"([^{}]+)\{", 1)).alias("s"))
        sel = sel.select("root", F.explode(F.split("s", r",(?![^()]*\))")).alias("s")).where(
            has(F.col("s"), at)
        )
        tags = None
        for tag in ("button", "a"):
            one = sel.where(has(F.col("s"), rf"(?<![\w-]){tag}(?![\w-])")).select(
                "root", F.lit(tag).alias("name")
            )
            tags = one if tags is None else tags.unionAll(one)
        both = classes.withColumn("kind", F.lit("class")).unionByName(
            tags.withColumn("kind", F.lit("tag"))
        )
        both = both.withColumn("state", F.lit(state))
        out = both if out is None else out.unionByName(both)
    return out.distinct()


def controls(sources: DataFrame) -> DataFrame:
    """Buttons and links with a className, one row each."""
    tag = r"""(?i)<(button|a)\s[^>]*className=["']([^"']*)["']"""
    c = F.col("content")
    return sources.select(
        "root",
        "path",
        F.posexplode(F.arrays_zip(found(c, tag, 1).alias("tag"), found(c, tag, 2).alias("k"))).alias(
            "i", "b"
        ),
    ).select("root", "path", "i", F.lower("b.tag").alias("tag"), F.col("b.k").alias("classes"))


def interaction_state(sources: DataFrame, state: str) -> DataFrame:
    """(path, i, tag, classes, has_state): utility tokens first, package CSS otherwise."""
    c = controls(sources)
    tokens = F.split("classes", r"\s+")
    utility = F.exists(tokens, lambda t: t.rlike(UTILITY))
    variant = F.lit(False)
    for v in STATE_VARIANTS[state]:
        variant = variant | F.contains("classes", F.lit(v))
    c = c.withColumns({"utility": utility, "variant": variant})
    css = small(css_states(sources).where(F.col("state") == state).select("root", "kind", "name"))
    asks = F.concat(
        F.array(F.struct(F.lit("tag").alias("kind"), F.col("tag").alias("name"))),
        F.transform(tokens, lambda t: F.struct(F.lit("class").alias("kind"), t.alias("name"))),
    )
    plain = c.where(~F.col("utility")).select(
        "root", "path", "i", "tag", "classes", F.explode(asks).alias("a")
    ).select("root", "path", "i", "tag", "classes", "a.kind", "a.name")
    styled = (
        plain.join(css.withColumn("hit", F.lit(True)), ["root", "kind", "name"], "left")
        .groupBy("path", "i", "tag", "classes")
        .agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("has_state"))
    )
    return styled.unionByName(
        c.where("utility").select("path", "i", "tag", "classes", F.col("variant").alias("has_state"))
    )


def missing_focus(sources: DataFrame) -> DataFrame:
    """Files with a button or link that has no focus treatment."""
    return (
        interaction_state(sources, "focus").where(~F.col("has_state")).select("path").distinct()
    )


# ---- forms bound by linked scripts -----------------------------------------------------


def submit_bindings(scripts: DataFrame) -> DataFrame:
    """Distinct (path, form_id) a script binds a submit listener to."""
    c = F.col("content")
    look = (
        r"""document\.(?:getElementById\(\s*["']|querySelector\(\s*["']#)([^"']+)["']\s*\)"""
    )
    listen = r"""\s*\.\s*addEventListener\(\s*(?:"submit"|'submit')"""
    direct = found(c, "(?i)" + look + listen, 1)
    assign = r"(?i)(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*" + look
    pairs = F.arrays_zip(found(c, assign, 1).alias("v"), found(c, assign, 2).alias("id"))
    later = F.transform(
        F.filter(
            pairs,
            lambda p: F.regexp_count(
                c, F.concat(F.lit(r"(?dUi)\b\Q"), p["v"], F.lit(r"\E" + listen))
            )
            > 0,
        ),
        lambda p: p["id"],
    )
    return scripts.select("path", F.explode(F.concat(direct, later)).alias("form_id")).distinct()


def project_reconcile(findings: DataFrame, pages: DataFrame, scripts: DataFrame) -> DataFrame:
    """Drop form findings of pages whose every form is handled by markup or a script."""
    c = F.col("content")
    forms = pages.select("path", F.explode(found(c, r"(?i)<form\b[^>]*>")).alias("form")).where(
        ~has(F.col("form"), r"(?i)\b(?:action|onsubmit)\s*=")
    )
    forms = forms.select(
        "path", F.regexp_extract("form", r"""(?i)\bid\s*=\s*["']([^"']+)["']""", 1).alias("form_id")
    )
    src = F.transform(
        found(c, r"(?i)<script\b[^>]*>"),
        lambda t: F.regexp_extract(t, r"""(?i)\bsrc\s*=\s*["']([^"']+)["']""", 1),
    )
    folder = F.regexp_replace("path", r"[^/]*$", "")
    links = pages.select("path", folder.alias("dir"), F.explode(src).alias("src")).where(
        (F.col("src") != "") & ~F.col("src").rlike(r"^(?:https?:)?//")
    )
    links = links.select(
        F.col("path").alias("page"),
        F.when(F.startswith("src", F.lit("/")), F.ltrim("src", F.lit("/")))
        .otherwise(F.concat("dir", F.regexp_replace("src", r"^\./", "")))
        .alias("path"),
    ).distinct()
    # Forms meet scripts by the form's own id: a script shared by all pages that binds all their
    # forms never makes a row for each page and form.
    forms = forms.distinct()
    named = forms.where(F.col("form_id") != "").alias("f")
    linked = (
        named.join(links.withColumnRenamed("path", "script"), F.col("f.path") == F.col("page"))
        .select("page", "script", "form_id")
        .join(submit_bindings(scripts).withColumnRenamed("path", "script"), ["script", "form_id"])
        .select(F.col("page").alias("path"), "form_id")
    )
    bound = linked.unionByName(submit_bindings(pages))
    open_pages = (
        forms.join(bound.distinct().withColumn("ok", F.lit(True)), ["path", "form_id"], "left")
        .where(F.col("ok").isNull() | (F.col("form_id") == ""))
        .select("path")
        .distinct()
        .withColumn("open", F.lit(True))
    )
    return (
        findings.join(open_pages, "path", "left")
        .where((F.col("detector_id") != "FORM_NO_SUBMIT_SLOP") | F.col("open"))
        .drop("open")
    )


# ---- suppression, zones, queue views ---------------------------------------------------


def glob_regex(pattern: str) -> str:
    """Regex for a shell glob with * and ?."""
    out = "".join({"*": ".*", "?": "."}.get(ch, "\\Q" + ch + "\\E") for ch in pattern)
    return f"(?s){out}"


def suppressed(path: Column, message: Column, patterns: list[str]) -> Column:
    """Any pattern matches path or message as glob or caseless substring."""
    cond = F.lit(False)
    for p in patterns:
        low = p.lower()
        for c in (path, message):
            cond = cond | c.rlike(glob_regex(p)) | F.lower(c).contains(low)
    return cond


def suppress(findings: DataFrame, patterns: list[str]) -> DataFrame:
    return findings.where(~suppressed(F.col("path"), F.col("message"), patterns))


def suppress_prune(queue: DataFrame, baseline: DataFrame, patterns: list[str]) -> DataFrame:
    """One row: how many queue and baseline entries the patterns remove."""
    both = queue.select("path", "message", F.lit(1).alias("q")).unionAll(
        baseline.select("path", "message", F.lit(0).alias("q"))
    )
    hit = suppressed(F.col("path"), F.col("message"), patterns)
    return both.agg(
        F.count_if(hit & (F.col("q") == 1)).alias("removed_queue"),
        F.count_if(hit & (F.col("q") == 0)).alias("removed_baseline"),
    )


def zone_of(path: Column, override: Column | None = None) -> Column:
    p = F.lower(path)
    ends = lambda *xs: F.lit(False) if not xs else (
        F.endswith(p, F.lit(xs[0])) | ends(*xs[1:])
    )
    zone = (
        F.when(p.contains("node_modules") | p.contains("vendor"), "vendor")
        .when(p.contains("test") | p.contains("spec"), "test")
        .when(ends(".config.js", ".config.ts") | p.contains("config"), "config")
        .when(
            p.contains("dist") | p.contains("build") | p.contains("out") | p.contains(".next"),
            "generated",
        )
        .when(ends(".sh", ".py") | p.contains("scripts"), "script")
        .otherwise("production")
    )
    return zone if override is None else F.coalesce(override, zone)


def queue_filter(findings: DataFrame, term: str) -> DataFrame:
    """Exact tier, or substring of id or path."""
    if term.upper() in ("T1", "T2", "T3", "T4"):
        return findings.where(F.col("tier") == term.upper())
    return findings.where(
        F.contains("detector_id", F.lit(term)) | F.contains("path", F.lit(term))
    )


