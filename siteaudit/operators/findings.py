"""Finding identity and the finding algebra: dedup, queue, diff, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteaudit.plans.ordered import grouped

# tier/severity pairs, score weights, statuses outside the repair queue.
SEVERITY = {"T1": "info", "T2": "warning", "T3": "error", "T4": "critical"}
WEIGHTS = {"info": 3.0, "warning": 10.0, "error": 20.0, "critical": 30.0}
NON_DEFECT = ["informational", "investigate", "suppressed", "verified_resolved"]
EVIDENCE_BASES = ["normative", "measured", "heuristic", "review"]
VOLATILE = ["checked_at", "created_at", "generated_at", "source_hash", "timestamp"]


def choose(col: Column, table: dict, default) -> Column:
    out = F
    for key, value in table.items():
        out = out.when(col == key, F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def severity_of(tier: Column) -> Column:
    return choose(tier, SEVERITY, "warning")


def tier_of(severity: Column) -> Column:
    return choose(severity, {s: t for t, s in SEVERITY.items()}, "T2")


def requires_resolution(status: Column) -> Column:
    return ~status.isin(NON_DEFECT)


def _quiet(c: Column, kind: T.DataType) -> Column:
    """Doubles, also inside arrays, structs and map values, to six places."""
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        # Adding zero turns a negative zero, which noise may leave, into zero.
        return F.round(c.cast("double"), 6) + F.lit(0.0)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _quiet(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _quiet(v, kind.valueType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_quiet(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), inner)
    return c


def canonical(rows: DataFrame, **cols: Column) -> Column:
    """JSON object with sorted keys over columns of ``rows``; callers pass no volatile key.

    Measured values (float and double by the type in ``rows``) are rounded to six places, so
    noise in a measurement gives no new finding.
    """
    kinds = rows.select(*[cols[k].alias(k) for k in sorted(cols)]).schema
    return F.to_json(F.struct(*[_quiet(cols[f.name], f.dataType).alias(f.name) for f in kinds]))


def source_anchor(
    rows: DataFrame, path: Column, line: Column, column: Column, start: Column, end: Column
) -> Column:
    return canonical(rows, path=path, line=line, column=column, start=start, end=end)


def fingerprint(
    detector: Column,
    source: Column | None = None,
    runtime: Column | None = None,
    contract: Column | None = None,
    evidence: Column | None = None,
) -> Column:
    """Content address: detector, three anchors and evidence, nothing volatile."""
    none = F.lit("{}")
    quoted = F.coalesce(F.to_json(F.array(detector.cast("string"))), F.lit("[null]"))
    body = F.concat(
        F.lit('{"contract_anchor":'),
        contract if contract is not None else none,
        F.lit(',"detector_id":'),
        F.substr(quoted, F.lit(2), F.length(quoted) - 2),
        F.lit(',"evidence":'),
        evidence if evidence is not None else none,
        F.lit(',"runtime_anchor":'),
        runtime if runtime is not None else none,
        F.lit(',"source_anchor":'),
        source if source is not None else none,
        F.lit("}"),
    )
    return F.sha2(body, 256)


def manual_id(path: Column, issue: Column, fix: Column) -> Column:
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    unix = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    return F.concat(
        F.lit("manual-"),
        F.substring(F.sha2(F.concat_ws("\0", unix, squeeze(issue), squeeze(fix)), 256), 1, 16),
    )


# ---- evidence policy and legacy documents ----------------------------------------------


def evidence_policy(df: DataFrame) -> DataFrame:
    """Known basis, well-formed authority, applicability (map) and constraints (array) trimmed and whole.

    Of keys that are equal once trimmed, the last in the map's order wins.
    """
    basis = F.lower(F.trim(F.coalesce("basis", F.lit(""))))
    authority = F.trim(F.coalesce("authority", F.lit("")))
    kept = F.filter(F.transform("remediation_constraints", lambda c: F.trim(c)), lambda c: c != "")
    pairs = F.filter(
        F.transform(
            F.map_entries("applicability"),
            lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value")),
        ),
        lambda e: e["key"] != "",
    )
    return df.withColumns(
        {
            "basis": F.when(basis.isin(EVIDENCE_BASES), basis).otherwise("review"),
            "authority": F.when(
                (F.length(authority) <= 160)
                & authority.rlike(r"^[A-Za-z0-9][A-Za-z0-9 .:/_@#()-]*$"),
                authority,
            ).otherwise(""),
            "remediation_constraints": kept,
            "applicability": F.map_from_entries(
                F.filter(
                    pairs,
                    lambda e, i: ~F.exists(
                        F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]
                    ),
                )
            ),
        }
    )


def legacy_upgrade(df: DataFrame) -> DataFrame:
    """Older rows (id, tier, issue, file, line) projected onto the current columns."""
    old = F.col("schema_version") < 2
    pick = lambda new, legacy: F.when(old, legacy).otherwise(F.col(new))
    return df.select(
        F.lit(2).alias("schema_version"),
        pick("detector_id", F.coalesce("rule_id", "id", F.lit("legacy-finding"))).alias(
            "detector_id"
        ),
        pick("severity", severity_of(F.coalesce("tier", F.lit("T4")))).alias("severity"),
        F.coalesce(F.col("confidence"), F.lit(1.0)).alias("confidence"),
        pick("message", F.col("issue")).alias("message"),
        F.coalesce(F.col("status"), F.lit("pending")).alias("status"),
        pick("provenance", F.lit("manual")).alias("provenance"),
        pick("path", F.col("file")).alias("path"),
        F.coalesce(F.col("line"), F.lit(0)).alias("line"),
        F.coalesce(F.col("column"), F.lit(0)).alias("column"),
    )


# ---- dedup and queue -------------------------------------------------------------------


def dedup_findings(df: DataFrame, order: str, key: str = "fingerprint") -> DataFrame:
    """One row per fingerprint, the one with the highest ``order``.

    An aggregate, not a window: copies combine before the shuffle, so a fingerprint that
    holds a third of the rows costs one partial row per task. The partitions grow in number
    with the table, so the sort of a task does not.
    """
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), order)
    return grouped(df, [key], [best.alias("_b")]).select(key, *[f"_b.{c}" for c in rest])


def queue_add(queue: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """Fresh findings whose fingerprint the queue has not seen, once each."""
    return dedup_findings(fresh, order).join(
        queue.select("fingerprint").distinct(), "fingerprint", "left_anti"
    )


def queue_resolve(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """All-or-nothing move to resolved.

    ``requests(fingerprint, outcome, evidence_hash)``; every one must be queued, absent on
    re-check and carry evidence. Returns the queue with a ``state`` column.
    """
    asked = requests.groupBy("fingerprint").agg(
        F.bool_and((F.col("outcome") == "absent") & (F.col("evidence_hash") != "")).alias("ok")
    )
    known = queue.select("fingerprint").distinct().withColumn("known", F.lit(True))
    gate = (
        asked.join(known, "fingerprint", "left")
        .agg(F.bool_and(F.col("ok") & F.coalesce("known", F.lit(False))).alias("pass"))
    )
    marked = queue.join(asked.select("fingerprint", F.lit(True).alias("hit")), "fingerprint", "left")
    one = F.lit(1).alias("_one")
    gated = marked.select("*", one).join(F.broadcast(gate.select("*", one)), "_one")  # one row
    return gated.select(
        *queue.columns,
        F.when(F.coalesce("hit", F.lit(False)) & F.coalesce("pass", F.lit(False)), "resolved")
        .otherwise("queued")
        .alias("state"),
    )


def override_audit(queue: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark overridden findings; audit rows need an actor and a reason."""
    valid = overrides.where((F.trim("actor") != "") & (F.trim("reason") != ""))
    keys = valid.select("fingerprint").distinct().withColumn("_o", F.lit(True))
    marked = queue.join(keys, "fingerprint", "left").select(
        *[c for c in queue.columns if c != "status"],
        F.when(F.col("_o"), "overridden").otherwise(F.col("status")).alias("status"),
    )
    known = queue.select("fingerprint").distinct()
    return marked, valid.join(known, "fingerprint", "left_semi")


# ---- multiset diff ---------------------------------------------------------------------


def diff_key(path: Column, issue: Column, line: Column, column: Column) -> Column:
    where = F.when(
        line.isNotNull() | column.isNotNull(),
        F.concat(
            F.coalesce(line.cast("string"), F.lit("None")),
            F.lit(":"),
            F.coalesce(column.cast("string"), F.lit("None")),
        ),
    ).otherwise("")
    return F.concat(path, F.lit("::"), F.sha2(issue, 256), F.lit("::"), where)


def finding_diff(baseline: DataFrame, fresh: DataFrame, key: str = "key") -> DataFrame:
    """NEW / FIXED / UNCHANGED counts per key, as a multiset.

    Both sides are counted before they meet, so the join sees each key once per side.
    """
    sides = baseline.select(key, F.lit(1).alias("b"), F.lit(0).alias("f")).unionAll(
        fresh.select(key, F.lit(0).alias("b"), F.lit(1).alias("f"))
    )
    n = sides.groupBy(key).agg(F.sum("b").alias("b"), F.sum("f").alias("f"))
    shared = F.least("b", "f")
    return (
        n.select(
            key,
            F.explode(
                F.array(
                    F.struct(F.lit("UNCHANGED").alias("change"), shared.alias("n")),
                    F.struct(F.lit("NEW").alias("change"), (F.col("f") - shared).alias("n")),
                    F.struct(F.lit("FIXED").alias("change"), (F.col("b") - shared).alias("n")),
                )
            ).alias("x"),
        )
        .select(key, "x.change", "x.n")
        .where("n > 0")
    )


def diff_scoped(baseline: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Diff restricted to changed paths. ``changed(path)``."""
    paths = changed.select("path").distinct()
    return finding_diff(
        baseline.join(paths, "path", "left_semi"), fresh.join(paths, "path", "left_semi")
    )


def save_baseline(baseline: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Baseline after a scoped save: untouched paths keep their rows, changed ones are replaced."""
    paths = changed.select("path").distinct()
    return baseline.join(paths, "path", "left_anti").unionByName(
        fresh.join(paths, "path", "left_semi")
    )


# ---- verification ----------------------------------------------------------------------


def verify(
    old: DataFrame,
    fresh: DataFrame,
    keys: list[str],
    anchor: str,
    captured: DataFrame | None = None,
    captured_keys: list[str] | None = None,
    missing: str = "stale_evidence",
) -> DataFrame:
    """reproduced / stale_anchor / absent for each old finding.

    ``keys`` name what a re-check must match (path+detector, page+selector+detector, ...).
    With ``captured`` given, findings whose subject was not re-examined get ``missing``.
    """
    seen = fresh.select(*keys, anchor).distinct()
    exact = seen.withColumn("_exact", F.lit(True))
    near = seen.select(*keys).distinct().withColumn("_near", F.lit(True))
    out = old.join(exact, [*keys, anchor], "left").join(near, keys, "left")
    outcome = (
        F.when(F.col("_exact"), "reproduced").when(F.col("_near"), "stale_anchor").otherwise("absent")
    )
    if captured is not None:
        ck = captured_keys or keys
        out = out.join(captured.select(*ck).distinct().withColumn("_seen", F.lit(True)), ck, "left")
        outcome = F.when(F.col("_seen").isNull(), missing).otherwise(outcome)
    return out.select(*old.columns, outcome.alias("outcome"))


def evidence_digest(df: DataFrame, keys: list[str], member: Column) -> DataFrame:
    """Order-free digest of a set: count and xor of 60-bit words of each member's sha256.

    A constant-size aggregate state, unlike hashing a sorted list, so one class may hold
    any number of members. Members must be distinct within a class.
    """
    h = F.sha2(member, 256)
    word = lambda i: F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("bigint")
    parts = [F.bit_xor(word(i)).cast("string") for i in range(4)]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"),
        F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *parts), 256).alias("digest"),
    )


def capture_matrix_digest(captures: Column) -> Column:
    """Digest of the distinct (route, state, viewport) structs of one review row."""
    clean = F.transform(
        captures,
        lambda c: F.struct(
            F.trim(c["route"]).alias("route"),
            F.trim(c["state"]).alias("state"),
            F.trim(c["viewport"]).alias("viewport"),
        ),
    )
    whole = F.filter(
        clean, lambda c: (c["route"] != "") & (c["state"] != "") & (c["viewport"] != "")
    )
    return F.sha2(F.to_json(F.array_sort(F.array_distinct(whole))), 256)


def set_account(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing, extra, duplicate and reordered members of two positioned lists (pos, id)."""
    e = expected.groupBy("id").agg(F.count(F.lit(1)).alias("ne"), F.min("pos").alias("pe"))
    a = actual.groupBy("id").agg(F.count(F.lit(1)).alias("na"), F.min("pos").alias("pa"))
    j = e.join(a, "id", "full_outer")
    return j.select(
        "id",
        F.when(F.col("na").isNull(), "missing")
        .when(F.col("ne").isNull(), "extra")
        .when(F.col("na") > 1, "duplicate")
        .when(F.col("pe") != F.col("pa"), "reordered")
        .otherwise("verified")
        .alias("account"),
    )
