"""Search over notes, and routing of findings to guidance."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"


def memory_search(notes: DataFrame, query: str | None, limit: int, text: str = "text", seq: str = "seq"):
    """Best ``limit`` notes: phrase hit, share of query tokens present, newest.

    Without a usable query, the newest ones. A top-k, so every task keeps only ``limit`` rows.
    """
    low = (query or "").lower()
    tokens = sorted(set(re.findall(WORD, low)))
    if not low.strip() or not tokens:
        return notes.orderBy(F.desc(seq)).limit(limit)
    body = F.lower(text)
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    overlap = F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in tokens])))
    return (
        notes.withColumns(
            {
                "phrase": F.contains(body, F.lit(low)).cast("int"),
                "overlap": overlap / len(tokens),
            }
        )
        .where("phrase > 0 OR overlap > 0")
        .orderBy(F.desc("phrase"), F.desc("overlap"), F.desc(seq))
        .limit(limit)
    )


# Guidance keys per rule category.
CATEGORY_CONTEXT = {
    "accessibility": ["accessibility", "a11y", "focus", "semantic"],
    "typography": ["typography", "font", "line-height"],
    "color": ["palette", "gradient", "contrast", "dark"],
    "motion": ["animation", "transition", "bounce"],
    "layout": ["responsive", "grid", "spacing", "viewport"],
    "materiality": ["border", "radius", "shadow", "glassmorphism"],
    "iconography": ["icon", "lucide", "viewbox"],
    "forms": ["form", "input", "button type", "autocomplete"],
    "content": ["copy", "generic", "card", "empty"],
    "security": ["eval(", "document.cookie", "open redirect", "cross-origin data injection"],
    "performance": ["lazy(", "new reference on every render", "setinterval"],
    "react": ["context provider", "class component", "key prop", "usestate initialized with"],
    "browser": ["browser sniffing", "user agent", "vendor prefix"],
    "code-quality": ["unused", "duplicate", "commented", "unreachable"],
    "interaction": ["hover", "loading", "error", "any"],
}


def context_route(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Guidance keys per finding: by rule category, else by keyword in the message.

    ``rules(detector_id, category)`` is the registry; unknown ids fall back to keywords.
    """
    j = findings.join(F.broadcast(rules), "detector_id", "left")  # registry: a few hundred rows
    by_rule = F.lit(None).cast("array<string>")
    for cat, keys in CATEGORY_CONTEXT.items():
        by_rule = F.when(F.col("category") == cat, F.array(*[F.lit(k) for k in keys])).otherwise(by_rule)
    every = [k for keys in CATEGORY_CONTEXT.values() for k in keys]
    body = F.lower("message")
    by_word = F.array_compact(
        F.array(
            *[
                F.when(body.rlike(r"(?<![A-Za-z0-9_])\Q" + k + r"\E(?![A-Za-z0-9_])"), F.lit(k))
                for k in every
            ]
        )
    )
    keys = F.coalesce(by_rule, by_word)
    return j.select(*findings.columns, F.explode(keys).alias("context_key"))
