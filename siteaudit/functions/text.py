"""Scalar text functions: redaction, URLs, lifecycle states, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "[REDACTED SENSITIVE EVIDENCE]"
# Credential token prefixes and the class each one names.
TOKEN = r"(?:sk-|AKIA|ghp_|xoxb-)[A-Za-z0-9_-]{16,}"
TOKEN_CLASS = {
    "sk-": "openai_api_key",
    "AKIA": "aws_access_key",
    "ghp_": "github_token",
    "xoxb-": "slack_bot_token",
}
# Other spellings of secrets.
ASSIGNMENT = (
    r"(?i)\b(authorization|api[_-]?key|access[_-]?token|password|passwd|secret|token)\b"
    r"(\s*[:=]\s*)(?:bearer\s+)?[^\s,;]+"
)
BEARER = r"(?i)\bbearer\s+[^\s,;]+"
URL_IN_TEXT = r"(?i)(https?://)([^\s<>'\"]+)"


def redact_tokens(text: Column) -> Column:
    return F.regexp_replace(text, TOKEN, MASK)


def credential_class(text: Column) -> Column:
    """Class of the first credential token, ``credential`` for none of the known prefixes."""
    token = F.regexp_extract(text, TOKEN, 0)
    out = F
    for prefix, name in TOKEN_CLASS.items():
        out = out.when(F.startswith(token, F.lit(prefix)), F.lit(name))
    return out.otherwise(F.lit("credential"))


def evidence_fingerprint(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def redact(text: Column) -> Column:
    """Scrub embedded URLs, ``key=secret`` pairs, bearer values and known tokens, in that order."""
    # Credentials before @, then query and fragment, of every URL in the text.
    t = F.regexp_replace(text, r"(?i)(https?://)[^\s<>'\"/?#@]*@", "$1")
    t = F.regexp_replace(t, r"(?i)(https?://[^\s<>'\"?#]*)[?#][^\s<>'\"]*", "$1")
    t = F.regexp_replace(t, ASSIGNMENT, "$1$2\\" + MASK)
    t = F.regexp_replace(t, BEARER, "Bearer " + MASK)
    return redact_tokens(t)


def url_sanitize(url: Column) -> Column:
    """Scheme, host, port and path only."""
    ok = url.rlike(r"(?i)^https?://[^/?#@]*@?[^/?#:@]+")
    bare = F.regexp_replace(url, r"^([A-Za-z]+://)[^/?#@]*@", "$1")
    parts = F.regexp_extract(bare, r"^([A-Za-z]+)://([^/?#]*)([^?#]*)", 1)
    host = F.regexp_extract(bare, r"^([A-Za-z]+)://([^/?#]*)([^?#]*)", 2)
    path = F.regexp_extract(bare, r"^([A-Za-z]+)://([^/?#]*)([^?#]*)", 3)
    return F.when(
        ok, F.concat(F.lower(parts), F.lit("://"), F.lower(host), path)
    ).otherwise(redact_tokens(url))


def route_key(url: Column) -> Column:
    """Path without empty segments or trailing slash."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z]+://[^/?#]*)?([^?#]*)", 1)
    return F.concat(
        F.lit("/"), F.array_join(F.filter(F.split(path, "/"), lambda s: s != ""), "/")
    )


# Lifecycle states, their aliases, prefixes some aliases need, and the aliases
# that may end a longer identifier.
STATES = {
    "loading": ["loading", "pending", "submitting", "fetching"],
    "empty": ["empty", "nodata", "noresults"],
    "error": ["error", "failed", "failure"],
    "success": ["success", "saved", "complete", "completed"],
    "disabled": ["disabled", "unavailable"],
    "first-run": ["firstrun", "firstvisit", "onboarding"],
}
ALIAS_PREFIXES = {
    "nodata": "is has show",
    "noresults": "is has show",
    "pending": "is has request query form submit mutation",
    "saved": "is has form save submit mutation",
    "complete": "is has form save submit request mutation",
    "completed": "is has form save submit request mutation",
    "unavailable": "is has form control button action",
    "firstrun": "is has",
    "firstvisit": "is has",
    "onboarding": "is has",
}
SUFFIX_ALIASES = "loading empty submitting fetching error failed failure success disabled".split()
NEGATIONS = "no non not off un without".split()
READ_STATES = ["loading", "empty", "error", "success", "first-run"]
MUTATION_STATES = ["loading", "error", "success", "disabled"]


def state_normalize(value: Column) -> Column:
    """Lifecycle state named by an identifier (camel, snake, kebab), or NULL."""
    spaced = F.regexp_replace(value, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([a-z0-9])([A-Z])", "$1 $2")
    tokens = F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]+"), F.lit(0))
    word = F.array_join(tokens, "")
    last = F.element_at(tokens, -1)
    before = F.when(F.size(tokens) > 1, F.element_at(tokens, -2))
    free = before.isNull() | ~before.isin(NEGATIONS)
    out = F.when(~value.rlike(r"^[\x20-\x7E]*$") | (word == ""), F.lit(None).cast("string"))
    for state, aliases in STATES.items():
        for alias in aliases:
            cond = word == alias
            if alias in ALIAS_PREFIXES:
                cond = cond | word.isin([p + alias for p in ALIAS_PREFIXES[alias].split()])
            elif alias in SUFFIX_ALIASES:
                cond = cond | ((last == alias) & free)
            out = out.when(cond, F.lit(state))
    return out


# Phrases that lower an unstated confidence.
HEDGES = [
    "unsure",
    "might not",
    "could break",
    "not certain",
    "unclear",
    "risky",
    "regression",
    "manual check",
    "verify manually",
]


def confidence_extract(note: Column, stated: Column, verification: Column) -> Column:
    """Stated in the note, else the structured field, else in the output, else from hedging."""

    def number(text: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")

    everything = F.lower(F.concat_ws(" ", note, stated, verification))
    hedged = sum((everything.contains(h).cast("int") for h in HEDGES), F.lit(0))
    guess = F.when(hedged >= 3, 0.5).when(hedged >= 2, 0.7).when(hedged >= 1, 0.85).otherwise(1.0)
    return F.coalesce(
        number(note, r"(?i)CONFIDENCE:\s*(0\.\d+|1\.0|1)"),
        stated.try_cast("double"),
        number(
            verification, r"(?i)(?:confidence|certainty|score)[\s:]*(?:is\s+)?(0\.\d+|1\.0)"
        ),
        guess,
    )


def coverage_band(percent: Column) -> Column:
    return (
        F.when(percent < 0.1, "trace")
        .when(percent < 5, "localized")
        .when(percent < 20, "noticeable")
        .when(percent < 50, "broad")
        .otherwise("extensive")
    )
