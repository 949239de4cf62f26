"""Front-end calls against back-end operations.

Tables: operations (one row each), params, media, fields (schemas flattened to field paths)
and obligations, all keyed by op_id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.operators.findings import evidence_digest
from siteaudit.plans.session import partitions

NAME = r"[A-Za-z_$][\w$]*"
# Spellings of a dynamic path segment, and a template expression.
DYNAMIC = rf"^(?::{NAME}|\{{{NAME}\}}|\[\[?(?:\.\.\.)?{NAME}\]?\]|\${NAME}|<(?:[^:>]+:)?{NAME}>)$"
OPENING = r"^(?::|\{|\[\[?(?:\.\.\.)?|\$|<(?:[^:>]+:)?)"
TEMPLATE = rf"\$\{{({NAME}(?:\.{NAME})*)\}}"
METHODS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]


def route_normalize(path: Column) -> Column:
    """struct(path, params, unresolved): comparable shape of a route."""
    p = F.trim(path)
    p = F.when(p == "", "/").otherwise(p)
    local = F.when(
        p.contains("://"), F.regexp_extract(p, r"://[^/?#]*([^?#]*)", 1)
    ).otherwise(F.regexp_extract(p, r"^([^?#]*)", 1))
    segs = F.filter(F.split(local, "/"), lambda s: s != "")

    def shape(s: Column) -> Column:
        dyn = s.rlike(DYNAMIC)
        names = F.regexp_extract_all(s, F.lit(TEMPLATE), F.lit(1))
        return F.struct(
            F.when(dyn, "{}").otherwise(F.regexp_replace(s, TEMPLATE, "{}")).alias("s"),
            F.when(dyn, F.array(F.regexp_extract(F.regexp_replace(s, OPENING, ""), NAME, 0)))
            .otherwise(names)
            .alias("p"),
            (~dyn & (F.size(names) == 0) & s.rlike(r"\$\{|`|\*")).alias("u"),
        )

    shaped = F.transform(segs, shape)
    return F.when(
        path.isNotNull(),
        F.struct(
            F.concat(F.lit("/"), F.array_join(F.transform(shaped, lambda x: x["s"]), "/")).alias("path"),
            F.flatten(F.transform(shaped, lambda x: x["p"])).alias("params"),
            F.exists(shaped, lambda x: x["u"]).alias("unresolved"),
        ),
    ).otherwise(
        F.struct(
            F.lit(None).cast("string").alias("path"),
            F.array().cast("array<string>").alias("params"),
            F.lit(True).alias("unresolved"),
        )
    )


def observation_dedup(observations: DataFrame) -> DataFrame:
    """Drop byte-identical observations; different identities stay apart."""
    return observations.dropDuplicates()


def frontend_observations(data_nodes: DataFrame, backend_sites: DataFrame) -> DataFrame:
    """HTTP data nodes that are not themselves back-end declaration sites."""
    return data_nodes.join(backend_sites.select("file", "line").distinct(), ["file", "line"], "left_anti")


def contract_nodes(
    ops: DataFrame, params: DataFrame, media: DataFrame, fields: DataFrame, obligations: DataFrame
) -> DataFrame:
    """Every contract concept as (op_id, kind, relation, name)."""

    def node(df, kind, relation, name):
        return df.select("op_id", F.lit(kind).alias("kind"), relation.alias("relation"), name.alias("name"))

    op = node(ops, "operation", F.lit("self"), F.concat_ws(" ", "method", "npath"))
    auth = ops.select(
        "op_id",
        F.explode(
            F.create_map(
                *[x for a in ("auth", "authorization", "tenant") for x in (F.lit(a), F.col(a))]
            )
        ).alias("kind", "name"),
    ).select("op_id", "kind", F.lit("requires").alias("relation"), "name")
    ui = ops.select("op_id", F.explode("ui_states").alias("s"))
    return (
        op.unionByName(auth)
        .unionByName(node(ui, "ui_state", F.lit("renders_state"), F.col("s")))
        .unionByName(
            node(params, "api_parameter", F.lit("declares_parameter"), F.concat_ws(":", "location", "name"))
        )
        .unionByName(
            media.select(
                "op_id",
                F.concat("side", F.lit("_media_type")).alias("kind"),
                F.when(F.col("side") == "request", "accepts_media_type")
                .otherwise("returns_media_type")
                .alias("relation"),
                F.col("media").alias("name"),
            )
        )
        .unionByName(node(fields, "schema_field", F.col("relation"), F.col("field_path")))
        .unionByName(
            node(obligations, "operation_obligation", F.lit("requires_behavior"), F.col("name"))
        )
    )


def unresolved(op_prefix: str = "") -> Column:
    c = lambda k: F.col(op_prefix + k)
    return c("dynamic") | c("npath").isNull() | (F.coalesce(c("method"), F.lit("")) == "")


def evidence_unknown(ops: DataFrame) -> DataFrame:
    return ops.where(unresolved())


def comparable(ops: DataFrame) -> DataFrame:
    return ops.where(~unresolved())


def _by_method(ops: DataFrame) -> DataFrame:
    return ops.groupBy("npath", "method").agg(F.count(F.lit(1)).alias("n"))


def contract_pairing(front: DataFrame, back: DataFrame) -> DataFrame:
    """(npath, method) with counts per side; sides are counted before they are joined."""
    f = _by_method(front).withColumnRenamed("n", "front")
    b = _by_method(back).withColumnRenamed("n", "back")
    return f.join(b, ["npath", "method"], "full_outer").na.fill(0, ["front", "back"])


def only_side(front: DataFrame, back: DataFrame) -> DataFrame:
    """frontend_only / backend_only operations (internal ones left out) and method mismatches."""
    fp = front.select("npath").distinct()
    bp = back.select("npath").distinct()
    f_only = front.join(bp, "npath", "left_anti").select(
        F.lit("frontend_only").alias("kind"), "npath", "op_id"
    )
    b_only = (
        back.where("classification <> 'internal'")
        .join(fp, "npath", "left_anti")
        .select(F.lit("backend_only").alias("kind"), "npath", "op_id")
    )
    pairs = contract_pairing(front, back).groupBy("npath").agg(
        F.sum("front").alias("f"),
        F.sum("back").alias("b"),
        F.bool_or((F.col("front") > 0) != (F.col("back") > 0)).alias("uneven"),
    )
    mixed = pairs.where("f > 0 AND b > 0 AND uneven").select(
        F.lit("method_mismatch").alias("kind"), "npath", F.lit("").alias("op_id")
    )
    return f_only.unionByName(b_only).unionByName(mixed)


def candidate_pick(back: DataFrame, relations: DataFrame) -> DataFrame:
    """Richest back-end observation per (npath, method): relations, confidence, id."""
    n = relations.groupBy("op_id").agg(F.count(F.lit(1)).alias("_rel"))
    j = back.join(n, "op_id", "left").withColumn("_rel", F.coalesce("_rel", F.lit(0)))
    rank = F.struct("_rel", "confidence", "op_id")
    return j.groupBy("npath", "method").agg(F.max_by("op_id", rank).alias("back_op"))


def operation_pairs(front: DataFrame, picked: DataFrame, contradictory: DataFrame) -> DataFrame:
    """Each comparable front-end operation with its one back-end candidate."""
    return (
        front.join(picked, ["npath", "method"])
        .join(contradictory.select("npath", "method").distinct(), ["npath", "method"], "left_anti")
        .select(F.col("op_id").alias("front_op"), "back_op")
    )


# ---- contradictions inside one back-end operation --------------------------------------


def group_contradiction(
    back: DataFrame, axes: list[str], shapes: Mapping[str, DataFrame]
) -> DataFrame:
    """First axis on which observations of one (npath, method) disagree.

    ``axes``: evidence-state or value columns, in precedence order; ``shapes``: axis ->
    rows (op_id, member) compared as sets. All comparisons are min <> max of a digest.
    """
    j = back.select("op_id", "npath", "method", *[a for a in axes if a in back.columns])
    for axis, rows in shapes.items():
        dig = evidence_digest(rows.select("op_id", "member").distinct(), ["op_id"], F.col("member"))
        j = j.join(dig.select("op_id", F.col("digest").alias(f"_s_{axis}")), "op_id", "left")
    aggs, order = [], []
    for axis in axes:
        cond = F.lit(False)
        if axis in back.columns:
            v = F.when(F.col(axis) != "unknown", F.col(axis))
            cond = (F.min(v) != F.max(v)) | F.bool_or(F.col(axis) == "contradictory")
        if axis in shapes:
            s = F.col(f"_s_{axis}")
            cond = F.coalesce(cond, F.lit(False)) | F.coalesce(F.min(s) != F.max(s), F.lit(False))
        aggs.append(F.coalesce(cond, F.lit(False)).alias(f"_c_{axis}"))
        order.append(F.when(F.col(f"_c_{axis}"), F.lit(axis)))
    g = j.groupBy("npath", "method").agg(*aggs)
    return g.select("npath", "method", F.coalesce(*order).alias("axis")).where("axis IS NOT NULL")


# ---- pairwise differences: each returns (front_op, back_op, kind, field) ---------------


def _first(rows: DataFrame, rank: Column) -> DataFrame:
    best = F.min_by(F.struct("kind", "field"), rank).alias("_b")
    return rows.groupBy("front_op", "back_op").agg(best).select("front_op", "back_op", "_b.*")


def transport_diff(pairs: DataFrame, params: DataFrame, media: DataFrame) -> DataFrame:
    """Parameters (a lone differing path parameter may be renamed), then media types.

    Both sides' parameters are laid out by pair once; everything after that stays in place. The
    number of partitions grows with the pairs, so the sorts of a task do not.
    """
    key = ["front_op", "back_op"]
    parts = partitions(pairs.sparkSession, pairs.count())

    def side(op: str, front: bool) -> DataFrame:
        return pairs.join(params.withColumnRenamed("op_id", op), op).select(
            *key, "location", "name", "serial", "required", F.lit(front).alias("front")
        )

    rows = side("front_op", True).unionByName(side("back_op", False)).repartition(parts, *key)
    w = Window.partitionBy(*key)
    path = F.col("location") == "path"
    of = lambda front: path & (F.col("front") == front)
    rows = rows.withColumns(
        {
            "_any": F.max("front").over(w),
            "_fn": F.count(F.when(of(True), 1)).over(w),
            "_bn": F.count(F.when(of(False), 1)).over(w),
            "_bname": F.min(F.when(of(False), F.col("name"))).over(w),
        }
    )
    lone = (F.col("_fn") == 1) & (F.col("_bn") == 1) & of(True)
    rows = rows.withColumn("name", F.when(lone, F.col("_bname")).otherwise(F.col("name")))
    is_f = F.col("front")
    j = rows.groupBy(*key, "location", "name").agg(
        F.max("_any").alias("_any"),
        F.max(is_f).alias("inf"),
        F.max(~is_f).alias("inb"),
        F.max(F.when(is_f, F.col("serial"))).alias("fs"),
        F.max(F.when(~is_f, F.col("serial"))).alias("bs"),
        F.coalesce(F.max(F.when(~is_f, F.col("required"))), F.lit(False)).alias("required"),
    )
    kind = (
        F.when(
            ~F.col("_any"), F.when(F.col("required"), "required_parameter_evidence_unknown")
        )
        .when(~F.col("inb"), "parameter_not_supported")
        .when(~F.col("inf"), F.when(F.col("required"), "required_parameter_missing"))
        .when(F.col("fs") != F.col("bs"), "parameter_serialization_mismatch")
    )
    field = F.concat_ws(":", "location", "name")
    p = j.select(*key, kind.alias("kind"), field.alias("field")).where("kind IS NOT NULL")
    p = _first(p, F.col("field")).withColumn("_o", F.lit(0))

    fm = pairs.join(media.withColumnRenamed("op_id", "front_op"), "front_op")
    bm = media.select(
        F.col("op_id").alias("back_op"), "side", "media", F.col("status").alias("bst"), F.lit(True).alias("ok")
    )
    hit = (fm["back_op"] == bm["back_op"]) & (fm["side"] == bm["side"]) & (fm["media"] == bm["media"])
    hit = hit & ((fm["side"] == "request") | fm["status"].eqNullSafe(bm["bst"]))
    bad = fm.join(bm, hit, "left_anti").select(
        *key,
        F.concat("side", F.lit("_media_type_mismatch")).alias("kind"),
        F.when(F.col("side") == "request", "").otherwise(F.col("status")).alias("field"),
        F.when(F.col("side") == "request", 1).otherwise(2).alias("_o"),
    )
    return _first(p.unionByName(bad).repartition(parts, *key), F.struct("_o", "field"))


def _walk_key(path: Column) -> Column:
    """Text key that sorts field paths in depth-first order, array items after properties."""
    parts = F.split(F.replace(path, F.lit("[]"), F.lit(".[]")), r"\.")
    step = lambda s: F.when(s == "[]", "9").otherwise(F.concat(F.lit("8"), s))
    return F.array_join(
        F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.concat(step(s), F.lit("\x01"))), ""
    )


CONSTRAINTS = ["format", "minimum", "maximum", "minLength", "maxLength", "pattern", "minItems", "maxItems"]


def schema_diff(pairs: DataFrame, fields: DataFrame, relation: str) -> DataFrame:
    """First difference of two flattened schemas, in the order a reader would meet it.

    ``fields(op_id, relation, status, field_path, type, nullable, enum, constraints,
    required, incomplete)``; nesting is in the path, so depth needs no recursion.
    """
    f = fields.where(F.col("relation") == relation)
    cols = ["type", "nullable", "enum", "constraints", "required", "incomplete"]
    key = ["front_op", "back_op"]

    def side(op: str, pre: str) -> DataFrame:
        return pairs.join(f.withColumnRenamed("op_id", op), op).select(
            *key, "status", "field_path", *[F.col(c).alias(pre + c) for c in cols],
            F.lit(True).alias(pre + "in"),
        )

    # Partitioned by pair: the join and the choice of the first difference stay in place.
    parts = partitions(pairs.sparkSession, pairs.count())
    dealt = lambda df: df.repartition(parts, *key)
    j = dealt(side("front_op", "f_")).join(
        dealt(side("back_op", "b_")), [*key, "status", "field_path"], "full_outer"
    )
    p = F.col("field_path")
    parent = F.regexp_replace(p, r"(?:\.|^)[^.\[\]]+$|\[\]$", "")
    leaf = F.regexp_extract(p, r"([^.\[\]]+)$", 1)
    at, up = _walk_key(p), _walk_key(parent)
    both = F.col("f_in").isNotNull() & F.col("b_in").isNotNull()
    item = F.endswith(p, F.lit("[]"))
    ne = lambda c: ~F.col("f_" + c).eqNullSafe(F.col("b_" + c))
    checks = [
        (both & (F.col("f_incomplete") | F.col("b_incomplete")), "schema_evidence_unknown", at, "1"),
        (both & (F.col("f_type").isNull() != F.col("b_type").isNull()), "field_type_evidence_unknown", at, "2"),
        (both & (F.col("f_type") != F.col("b_type")), "field_type_mismatch", at, "3"),
        (both & ne("nullable"), "field_nullability_mismatch", at, "4"),
        (both & ne("enum"), "field_enum_mismatch", at, "5"),
        (both & ne("constraints"), "field_validation_mismatch", at, "6"),
        (
            (F.coalesce("f_required", F.lit(False)) != F.coalesce("b_required", F.lit(False))) & ~item,
            "field_required_mismatch",
            F.concat(up, F.lit("7a"), leaf),
            "",
        ),
        (~both & ~item, "field_missing", F.concat(up, F.lit("7b"), leaf), ""),
        (~both & item, "array_items_evidence_unknown", F.concat(up, F.lit("9")), ""),
    ]
    rows = F.array_compact(
        F.array(
            *[
                F.when(
                    cond, F.struct(F.concat(k, F.lit(rank)).alias("k"), F.lit(kind).alias("kind"))
                )
                for cond, kind, k, rank in checks
            ]
        )
    )
    out = j.select(*key, "status", p.alias("field"), F.explode(rows).alias("d")).select(
        *key, "status", "field", "d.*"
    )
    first = _first(out, F.struct("status", "k"))
    return first.withColumn("kind", F.concat(F.lit(f"{relation}_"), "kind"))


def ui_lifecycle(ops: DataFrame) -> DataFrame:
    """Missing loading/error/empty/success states of response-bearing UI operations."""
    need = F.when(
        F.col("mutation"), F.array(*[F.lit(s) for s in ("error", "loading", "success")])
    ).otherwise(F.array(*[F.lit(s) for s in ("empty", "error", "loading", "success")]))
    missing = F.array_except(need, F.coalesce("ui_states", F.array().cast("array<string>")))
    ev = F.col("ui_evidence")
    kind = (
        F.when(ev == "contradictory", "ui_state_evidence_contradictory")
        .when(ev == "unknown", "ui_state_evidence_unknown")
        .when(
            F.col("response_bearing") & ((ev == "absent") | (F.size(missing) > 0)), "ui_state_missing"
        )
    )
    return ops.withColumns({"kind": kind, "missing": F.array_join(missing, ",")}).where(
        F.col("ui_required") & F.col("kind").isNotNull()
    )


def evidence_state_diff(axis: str, front: Column, back: Column) -> Column:
    """Kind of difference between two states of present/absent/unknown/contradictory, or NULL."""
    return (
        F.when((front == "contradictory") | (back == "contradictory"), f"{axis}_evidence_contradictory")
        .when((front == "unknown") | (back == "unknown"), f"{axis}_evidence_unknown")
        .when(front != back, f"{axis}_mismatch")
    )


def evidence_diff(pairs: DataFrame, axes: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """The first axis, in the order given, on which the evidence states of a pair differ.

    States are columns of the pair, so no axis costs a join.
    """
    kind = F.coalesce(*(evidence_state_diff(a, front, back) for a, (front, back) in axes.items()))
    return pairs.select("front_op", "back_op", kind.alias("kind"), F.lit("").alias("field")).where("kind IS NOT NULL")


def first_difference(pairs: DataFrame, by_priority: list[DataFrame]) -> DataFrame:
    """The first of several difference tables that has a row for the pair."""
    out = None
    for i, df in enumerate(by_priority):
        one = df.select("front_op", "back_op", "kind", "field", F.lit(i).alias("_p"))
        out = one if out is None else out.unionByName(one)
    parts = partitions(pairs.sparkSession, pairs.count())
    return _first(out.repartition(parts, "front_op", "back_op"), F.col("_p"))


# ---- obligations -----------------------------------------------------------------------

# Behaviour a status code or header obliges a client to.
OBLIGATION_STATUS = {
    "conflict": ["409", "412"],
    "rate-limit": ["429"],
    "validation": ["400", "422"],
    "timeout": ["408", "504"],
    "retry": ["503"],
}
OBLIGATION_HEADERS = {"retry": ["Retry-After"], "idempotency": ["Idempotency-Key"], "concurrency": ["If-Match"]}


def derive_obligations(ops: DataFrame) -> DataFrame:
    """(op_id, name) implied by declared statuses and headers."""
    names = []
    for name in sorted(set(OBLIGATION_STATUS) | set(OBLIGATION_HEADERS)):
        lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        cond = F.arrays_overlap("statuses", lit(OBLIGATION_STATUS.get(name, [])))
        cond = F.coalesce(cond, F.lit(False)) | F.coalesce(
            F.arrays_overlap("headers", lit(OBLIGATION_HEADERS.get(name, []))), F.lit(False)
        )
        names.append(F.when(cond, F.lit(name)))
    return ops.select("op_id", F.explode(F.array_compact(F.array(*names))).alias("name"))


def obligation_findings(pairs: DataFrame, obligations: DataFrame) -> DataFrame:
    """Missing, different or uncertain client behaviour per applicable back-end obligation."""
    cols = ["name", "capability", "applicable", "attrs"]
    want = pairs.join(
        obligations.select(F.col("op_id").alias("back_op"), *[F.col(c).alias("b_" + c) for c in cols]),
        "back_op",
    )
    have = obligations.select(
        F.col("op_id").alias("front_op"), *[F.col(c).alias("f_" + c) for c in cols]
    ).withColumn("b_name", F.col("f_name"))
    j = want.join(have, ["front_op", "b_name"], "left")
    vague = lambda c: F.coalesce(F.col(c).isin("unknown", "contradictory"), F.lit(False))
    live = (F.col("f_capability") == "present") & F.col("f_applicable")
    kind = F.when(
        vague("b_capability") | F.col("b_applicable").isNull(), "operation_obligation_evidence_unknown"
    ).when(
        (F.col("b_capability") == "present") & F.col("b_applicable"),
        F.when(
            ~F.coalesce(live, F.lit(False)),
            F.when(vague("f_capability"), "operation_obligation_evidence_unknown").otherwise(
                "operation_obligation_missing"
            ),
        ).when(F.col("f_attrs") != F.col("b_attrs"), "operation_obligation_mismatch"),
    )
    return j.select("front_op", "back_op", kind.alias("kind"), F.col("b_name").alias("field")).where(
        "kind IS NOT NULL"
    )


def contract_dedup(findings: DataFrame) -> DataFrame:
    """One finding per cause (kind, anchor, expected, actual, status)."""
    return findings.select("kind", "npath", "method", "field", "status").distinct()


def contract_counts(findings: DataFrame) -> DataFrame:
    gap = F.col("status") == "investigate"
    return findings.agg(
        F.count_if(~gap).alias("mismatch"), F.count_if(gap).alias("coverage_gap")
    )
