"""Facts read out of source text: tokens, calls, routes, types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.functions.regex import java, match_offsets


def _all(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group))


def _rows(df: DataFrame, keys: list[str], **arrays: Column) -> DataFrame:
    z = F.arrays_zip(*[c.alias(n) for n, c in arrays.items()])
    return df.select(*keys, F.posexplode(z).alias("pos", "z")).select(*keys, "pos", "z.*")


def css_tokens(sources: DataFrame) -> DataFrame:
    """Custom properties: (path, pos, token, value)."""
    p = r"(--[A-Za-z0-9_-]+)\s*:\s*([^;}{]+)"
    out = _rows(sources, ["path"], token=_all("content", p, 1), value=_all("content", p, 2))
    return out.withColumn("value", F.trim("value"))


CALL = (
    r"\b(?:fetch|(?:axios|ky|api|http|client)(?:\.(get|post|put|patch|delete|head|options))?)"
    r"""\(\s*(?:(["'`])([^"'`]*)\2|)"""
)


def script_http_calls(sources: DataFrame) -> DataFrame:
    """HTTP call sites; a call without a plain literal URL is ``dynamic``."""
    hits = match_offsets(F.col("content"), F.lit(java(CALL)))
    z = F.arrays_zip(hits.alias("h"), _all("content", CALL, 1).alias("verb"), _all("content", CALL, 3).alias("url"))
    return sources.select("path", F.explode(z).alias("z")).select(
        "path",
        F.col("z.h.line").alias("line"),
        F.upper(F.when(F.col("z.verb") == "", "get").otherwise(F.col("z.verb"))).alias("method"),
        F.col("z.url").alias("url"),
        ((F.col("z.url") == "") | F.col("z.url").contains("${")).alias("dynamic"),
    )


PY_VERB = r"""(?is)@([A-Za-z_$][\w$]*)\.(get|post|put|patch|delete|head|options)\(\s*["']([^"']*)["']"""
JS_VERB = r"""(?is)\b([A-Za-z_$][\w$]*)\.(get|post|put|patch|delete|head|options)\(\s*["'`](/[^"'`]*)["'`]"""
PREFIX = (
    r"""(?s)\b([A-Za-z_$][\w$]*)\s*=\s*(?:APIRouter|Blueprint)\s*\([^)]*?\b(?:url_)?prefix\s*="""
    r"""\s*["']([^"')]*)["'][^)]*\)"""
)
MOUNT = r"""(?s)\.use\(\s*["']([^"']+)["']\s*,\s*([A-Za-z_$][\w$]*)\s*\)"""
INCLUDE = (
    r"""(?s)\.(?:include_router|register_blueprint)\(\s*([A-Za-z_$][\w$]*)[^)]*?\b(?:url_)?prefix\s*="""
    r"""\s*["']([^"')]*)["'][^)]*\)"""
)


def join_routes(*parts: Column) -> Column:
    trimmed = [F.trim(F.coalesce(p, F.lit("")), F.lit("/")) for p in parts]
    return F.concat(
        F.lit("/"), F.array_join(F.filter(F.array(*trimmed), lambda x: x != ""), "/")
    )


# What makes a receiver a router or an application.
CREATED = (
    r"""(?s)\b([A-Za-z_$][\w$]*)\s*=\s*(?:await\s+)?(?:new\s+)?(?:[A-Za-z_$][\w$]*\.)?"""
    r"""(?:FastAPI|APIRouter|Flask|Blueprint|express|Router|fastify|Fastify|Hono)\s*\("""
)
HOST = r"""(?s)\b([A-Za-z_$][\w$]*)\.(?:include_router|register_blueprint|use)\("""


def routers(sources: DataFrame) -> DataFrame:
    """(path, receiver) of the names that a file creates, mounts or mounts others on as routers."""
    found = [
        _rows(sources, ["path"], receiver=_all("content", pattern, group))
        for pattern, group in ((CREATED, 1), (HOST, 1), (MOUNT, 2), (INCLUDE, 1))
    ]
    return reduce(lambda a, b: a.unionByName(b), [f.select("path", "receiver") for f in found]).distinct()


def route_declarations(sources: DataFrame) -> DataFrame:
    """Route decorators and router calls with the prefix of their receiver joined in.

    A call on a name that is no router of its file, such as a client's, declares nothing.
    """
    out = []
    for ext, pattern in (("py", PY_VERB), ("js", JS_VERB)):
        s = sources.where(F.col("ext") == ext if ext == "py" else F.col("ext").isin("js", "ts"))
        out.append(
            _rows(
                s,
                ["path"],
                receiver=_all("content", pattern, 1),
                method=_all("content", pattern, 2),
                route=_all("content", pattern, 3),
            )
        )
    calls = out[0].unionByName(out[1]).join(routers(sources), ["path", "receiver"], "left_semi")

    def prefixes(pattern: str, who: int, what: int, name: str) -> DataFrame:
        df = _rows(
            sources, ["path"], receiver=_all("content", pattern, who), p=_all("content", pattern, what)
        )
        return df.groupBy("path", "receiver").agg(F.max_by("p", "pos").alias(name))

    own = prefixes(PREFIX, 1, 2, "own")
    outer = prefixes(INCLUDE, 1, 2, "outer").unionByName(prefixes(MOUNT, 2, 1, "outer"))
    outer = outer.groupBy("path", "receiver").agg(F.max("outer").alias("outer"))
    j = calls.join(own, ["path", "receiver"], "left").join(outer, ["path", "receiver"], "left")
    return j.select(
        "path", F.upper("method").alias("method"), join_routes(F.col("outer"), F.col("own"), F.col("route")).alias("route")
    )


BLOCK = (
    r"(?s)\b(?:export\s+)?(?:interface\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+[^{]+)?"
    r"|type\s+([A-Za-z_$][\w$]*)\s*=)\s*\{([^{}]*)\}"
)
FIELD = r"""(?:^|[;,\n])\s*(?:readonly\s+)?([A-Za-z_$][\w$]*|["'][^"']+["'])(\?)?\s*:\s*([^;,\n]+)"""


def type_contracts(sources: DataFrame) -> DataFrame:
    """TypeScript interfaces and object types as (path, contract, field, type, nullable, required)."""
    blocks = _rows(
        sources, ["path"], a=_all("content", BLOCK, 1), b=_all("content", BLOCK, 2), body=_all("content", BLOCK, 3)
    )
    f = _rows(
        blocks.withColumn("contract", F.when(F.col("a") != "", F.col("a")).otherwise(F.col("b"))).drop("pos"),
        ["path", "contract"],
        name=_all("body", FIELD, 1),
        opt=_all("body", FIELD, 2),
        t=_all("body", FIELD, 3),
    )
    union = F.transform(F.split("t", r"\|"), lambda x: F.trim(x))
    solid = F.filter(union, lambda x: ~x.isin("null", "undefined"))
    literal = F.forall(solid, lambda x: x.rlike(r"""^(?:'.*'|".*")$""")) & (F.size(solid) > 0)
    one = F.when(F.size(solid) == 1, F.get(solid, 0)).otherwise(F.trim("t"))
    kind = (
        F.when(literal, "enum")
        .when(one.rlike(r"\[\]$|^(?:Array|ReadonlyArray)<.+>$"), "array")
        .when(one.isin("string", "number", "boolean", "object"), one)
        .when(one.isin("unknown", "any"), "unknown")
        .otherwise("object")
    )
    return f.select(
        "path",
        "contract",
        F.regexp_replace("name", r"""^["']|["']$""", "").alias("field"),
        kind.alias("type"),
        F.exists(union, lambda x: x.isin("null", "undefined")).alias("nullable"),
        (F.col("opt") == "").alias("required"),
    )


def literal_query_params(sources: DataFrame) -> DataFrame:
    """``"url" + new URLSearchParams({k: "v"})`` sites with every literal pair."""
    p = r"""(?s)["']([^"']*)["']\s*\+\s*new\s+URLSearchParams\s*\(\s*\{([^{}]*)\}\s*\)"""
    pair = r"""["']?([A-Za-z_$][\w$-]*)["']?\s*:\s*["']([^"']*)["']"""
    c = _rows(sources, ["path"], url=_all("content", p, 1), body=_all("content", p, 2)).drop("pos")
    # Every comma-separated entry must be a literal pair.
    n = F.size(F.filter(F.split("body", ","), lambda x: F.trim(x) != ""))
    c = c.where(F.size(_all("body", pair)) == n)
    return _rows(c, ["path", "url"], key=_all("body", pair, 1), value=_all("body", pair, 2)).drop("pos")


# Words counted as layout signals.
SIGNALS = "card chart drawer grid hero modal sidebar table".split()


def site_signals(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Signal counts per document, summed per key."""
    low = F.lower("content")
    cols = {s: F.regexp_count(low, F.lit(s)) for s in SIGNALS}
    cols["responsive"] = F.regexp_count("content", F.lit(r"@media\b|\b(?:sm|md|lg|xl|2xl):"))
    per = sources.select(*keys, *[c.alias(n) for n, c in cols.items()])
    return per.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in cols])


# ---- viewport probes -------------------------------------------------------------------

BOUNDARY = (
    r"(?i)@(media|container)\b[^{}]{0,500}?\(\s*(?:(?:min-|max-)?(?:width|inline-size)\s*:\s*"
    r"|(?:width|inline-size)\s*(?:<=|>=|<|>)\s*)(\d+)px\s*\)"
)


def responsive_boundaries(sources: DataFrame) -> DataFrame:
    """All breakpoint widths in 240..2560, with kinds and source counts."""
    hits = _rows(
        sources, ["path"], kind=_all("content", BOUNDARY, 1), width=_all("content", BOUNDARY, 2)
    )
    hits = hits.withColumn("width", F.col("width").cast("int")).where("width BETWEEN 240 AND 2560")
    return hits.groupBy("width").agg(
        F.array_join(F.array_sort(F.collect_set(F.lower("kind"))), "-").alias("kinds"),
        F.count_distinct("path").alias("sources"),
    )


def evenly_sampled(boundaries: DataFrame, budget: int = 8) -> DataFrame:
    """``budget`` of the boundaries, spread evenly over their order: a sampling operator.

    At most 2,321 widths reach these windows.
    """
    ranked = boundaries.withColumns(
        {
            "i": F.row_number().over(Window.orderBy("width")) - 1,
            "n": F.count(F.lit(1)).over(Window.partitionBy()),
        }
    )
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(budget - 1)),
        lambda k: F.bround(k * (F.col("n") - 1) / max(budget - 1, 1)).cast("int"),
    )
    return ranked.where(
        (F.col("n") <= budget) | F.array_contains(picks, F.col("i"))
    ).select("width", "kinds", "sources")


def viewport_probes(boundaries: DataFrame) -> DataFrame:
    """One pixel below and above each boundary."""
    probe = F.explode(
        F.array(
            F.struct(F.lit("below").alias("relation"), (F.col("width") - 1).alias("probe")),
            F.struct(F.lit("above").alias("relation"), (F.col("width") + 1).alias("probe")),
        )
    ).alias("p")
    return boundaries.select("width", "kinds", probe).select("width", "kinds", "p.*").where(
        "probe BETWEEN 240 AND 2560"
    )
