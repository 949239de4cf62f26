"""API documents (OpenAPI 3 and Swagger 2, JSON or YAML) as operations, parameters, media and fields.

A document is parsed once to a VARIANT. Its local references are the edges of a graph: each
distinct ``$ref`` of a document is followed once, giving (path, ref, target). Schemas are then
walked breadth first: the frontier holds one row per (operation, relation, status, field) with
its sub-document, a step joins it to the references and explodes allOf members, properties and
items. A reference already met on the way ends a cycle and leaves the schema's evidence
incomplete. The walk costs its frontier a step; there is no limit on depth, properties or size.

Edges: unreadable documents and documents without ``paths`` give no rows; a reference that leads
nowhere leaves a schema of unknown type; chains of references are followed to their end; of several
media types without ``application/json`` the first by name holds the schema; a key that a mapping
repeats makes the document unreadable; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.operators.contracts import CONSTRAINTS, METHODS, route_normalize
from siteaudit.plans.session import cut

_MAP, _ARRAY = "map<string,variant>", "array<variant>"
REF = r'"\$ref":"(#/(?:[^"\\]|\\.)*)"'


def _map(v: Column) -> Column:
    return F.try_variant_get(v, "$", _MAP)


def _at(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def _names(values: Column) -> Column:
    """Distinct strings of an array<variant>, sorted; NULL stays NULL."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(values, lambda x: F.try_variant_get(x, "$", "string")))))


def _yaml_to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json

    import yaml

    def one(text):
        try:
            return json.dumps(yaml.safe_load(text), default=str)
        except (yaml.YAMLError, TypeError, ValueError, RecursionError, AttributeError):
            return None

    for b in batches:
        yield pd.DataFrame({"path": b["path"], "content": b["content"].map(one)})


def parsed(docs: DataFrame) -> DataFrame:
    """(path, doc VARIANT) of every readable document that has a mapping of paths."""
    json_text = F.lower("path").endswith(".json")
    two = docs.select("path", "content")
    text = two.where(json_text).unionByName(
        two.where(~F.coalesce(json_text, F.lit(False)) & F.col("content").isNotNull()).mapInPandas(
            _yaml_to_json, "path string, content string"
        )
    )
    doc = text.select("path", F.try_parse_json("content").alias("doc"))
    return doc.where(_map(_at(F.col("doc"), "paths")).isNotNull())


def references(docs: DataFrame) -> DataFrame:
    """(path, ref, target VARIANT): every distinct local reference of a document, followed once."""
    refs = F.array_distinct(F.regexp_extract_all(F.col("doc").cast("string"), F.lit(REF), F.lit(1)))
    steps = F.transform(
        F.slice(F.split("ref", "/"), F.lit(2), F.size(F.split("ref", "/"))),
        lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")),
    )
    target = F.aggregate(steps, F.col("doc"), lambda at, key: F.try_element_at(_map(at), key))
    found = docs.select("path", "doc", F.explode(refs).alias("ref")).select("path", "ref", target.alias("target"))
    return found.where(_map(F.col("target")).isNotNull())


def _followed(rows: DataFrame, refs: DataFrame, v: str = "v") -> DataFrame:
    """``rows`` with ``v`` replaced by what it refers to, one hop; ``ref`` and ``hit`` say so.

    Rows without a reference meet the join under their operation's key, so they stay spread.
    """
    ref = _at(F.col(v), "$ref", "string")
    r = refs.select(F.col("path").alias("_path"), F.col("ref").alias("_ref"), "target")
    keyed = rows.withColumns({"ref": ref, "_key": F.coalesce(ref, F.concat(F.lit("\0"), F.col("op_id")))})
    joined = keyed.join(r, (F.col("path") == F.col("_path")) & (F.col("_key") == F.col("_ref")), "left")
    return (
        joined.withColumn("hit", F.col("_ref").isNotNull())
        .withColumn(v, F.when(F.col("hit"), F.col("target")).otherwise(F.col(v)))
        .drop("_path", "_ref", "_key", "target")
    )


def _operation_rows(docs: DataFrame) -> DataFrame:
    top = docs.select("path", "doc", F.explode(_map(_at(F.col("doc"), "paths"))).alias("route", "item"))
    ops = top.select(
        "path",
        "route",
        F.explode(_map(F.col("item"))).alias("method", "op"),
        _at(F.col("item"), "parameters", _ARRAY).alias("shared"),
        _at(F.col("doc"), "security").alias("doc_security"),
        _at(F.col("doc"), "consumes", _ARRAY).alias("doc_consumes"),
        _at(F.col("doc"), "produces", _ARRAY).alias("doc_produces"),
        F.coalesce(_at(F.col("doc"), "swagger", "string").startswith("2"), F.lit(False)).alias("swagger"),
    ).where(F.lower("method").isin(METHODS) & _map(F.col("op")).isNotNull())
    npath = route_normalize(F.col("route"))["path"]
    return ops.withColumn("method", F.upper("method")).withColumn("npath", npath).withColumn(
        "op_id", F.concat_ws(":", "path", "method", "route")
    )


def _auth(op: Column, whole: Column) -> Column:
    """present if every alternative names a scheme, absent if none does, unknown if only some do."""
    own = _at(op, "security")
    security = F.try_variant_get(F.when(own.isNotNull(), own).otherwise(whole), "$", _ARRAY)
    given = F.coalesce(own, whole).isNotNull() & ~F.coalesce(F.is_variant_null(F.coalesce(own, whole)), F.lit(False))
    maps = F.array_compact(F.transform(security, _map))
    named, free = F.exists(maps, lambda m: F.size(m) > 0), F.exists(maps, lambda m: F.size(m) == 0)
    return (
        F.when(~given | (F.size(security) == 0), "absent")
        .when(security.isNull(), "unknown")
        .when(named & ~free, "present")
        .when(free & ~named, "absent")
        .otherwise("unknown")
    )


class Contract:
    """The tables of a set of API documents; each is written once and read by the next."""

    def __init__(self, docs: DataFrame):
        tree = cut(parsed(docs))
        self.refs = cut(references(tree))
        self.rows = cut(_operation_rows(tree))
        self.params = cut(self._params())
        self.holders = cut(self._holders())

    def _params(self) -> DataFrame:
        """One row per operation, location and name; the operation's own override inherited ones."""
        none = F.array().cast(_ARRAY)
        own = F.coalesce(_at(F.col("op"), "parameters", _ARRAY), none)
        tagged = lambda values, first: F.transform(
            values, lambda v, i: F.struct((i + first).alias("n"), v.alias("v"))
        )
        every = F.concat(
            tagged(F.coalesce("shared", none), F.lit(0)), tagged(own, F.size(F.coalesce("shared", none)))
        )
        rows = self.rows.select("path", "op_id", F.explode(every).alias("p")).select("path", "op_id", "p.n", "p.v")
        v = F.col("v")
        rows = _followed(rows, self.refs).select(
            "path", "op_id", "n", "v", _at(v, "in", "string").alias("location"), _at(v, "name", "string").alias("name")
        ).where("name <> '' AND location IS NOT NULL")
        last = rows.groupBy("op_id", "location", "name").agg(F.max("n").alias("n"))
        return rows.join(last, ["op_id", "location", "name", "n"])

    def parameters(self) -> DataFrame:
        """op_id, location, name, required, style, explode, serial."""
        v = F.col("v")
        style = F.coalesce(_at(v, "style", "string"), _at(v, "collectionFormat", "string"))
        return self.params.where("location <> 'body'").select(
            "op_id",
            "location",
            "name",
            F.coalesce(_at(v, "required", "boolean"), F.lit(False)).alias("required"),
            style.alias("style"),
            _at(v, "explode", "boolean").alias("explode"),
            F.concat_ws(",", style, _at(v, "explode", "string")).alias("serial"),
        )

    def _holders(self) -> DataFrame:
        """What holds content: request bodies and responses, references followed."""
        op = F.col("op")
        bodies = self.rows.select("path", "op_id", _at(op, "requestBody").alias("v")).where("v IS NOT NULL")
        # Swagger 2 has a body parameter instead; the first by name stands for the body.
        first = self.params.where("location = 'body'").groupBy("op_id").agg(F.min("name").alias("name"))
        in_body = self.params.where("location = 'body'").join(first, ["op_id", "name"]).select("path", "op_id", "v")
        in_body = in_body.join(bodies.select("op_id"), "op_id", "left_anti")
        request = bodies.unionByName(in_body).withColumns({"relation": F.lit("request"), "status": F.lit("")})
        answers = self.rows.select(
            "path", "op_id", F.explode(_map(_at(op, "responses"))).alias("status", "v")
        ).withColumn("relation", F.lit("response"))
        return _followed(request.unionByName(answers), self.refs).drop("ref", "hit").where(_map(F.col("v")).isNotNull())

    def media(self) -> DataFrame:
        """op_id, side, status, media."""
        content = F.map_keys(_map(_at(F.col("v"), "content")))
        h = self.holders.select("op_id", F.col("relation").alias("side"), "status", content.alias("own"))
        op = self.rows.where("swagger").select(
            "op_id",
            *[
                _names(F.coalesce(_at(F.col("op"), key, _ARRAY), F.col(f"doc_{key}"))).alias(key)
                for key in ("consumes", "produces")
            ],
        )
        j = h.join(op, "op_id", "left")
        declared = F.when(F.col("side") == "request", F.col("consumes")).otherwise(F.col("produces"))
        media = F.when(F.size("own") > 0, F.col("own")).otherwise(declared)
        return j.select("op_id", "side", "status", F.explode(media).alias("media")).distinct()

    def operations(self) -> DataFrame:
        """op_id, path, route, npath, method, statuses, auth."""
        return self.rows.select(
            "op_id",
            "path",
            "route",
            "npath",
            "method",
            F.array_sort(F.map_keys(_map(_at(F.col("op"), "responses")))).alias("statuses"),
            _auth(F.col("op"), F.col("doc_security")).alias("auth"),
        )

    def schemas(self) -> DataFrame:
        """(path, op_id, relation, status, v): the root schema of each body and response."""
        v = F.col("v")
        content = _map(_at(v, "content"))
        other = F.array_sort(F.map_keys(F.map_filter(content, lambda _, x: _map(x).isNotNull())))
        plain = F.try_element_at(content, F.lit("application/json"))
        chosen = F.when(_map(plain).isNotNull(), plain).otherwise(F.try_element_at(content, F.get(other, 0)))
        error = F.col("status").startswith("4") | F.col("status").startswith("5") | (F.col("status") == "default")
        relation = (
            F.when(F.col("relation") == "request", "request")
            .when(F.col("status").startswith("2"), "response")
            .when(error, "error")
        )
        return self.holders.select(
            "path", "op_id", relation.alias("relation"), "status",
            F.coalesce(_at(v, "schema"), _at(chosen, "schema")).alias("v"),
        ).where(F.col("relation").isNotNull() & _map(F.col("v")).isNotNull())

    def fields(self) -> DataFrame:
        """Field rows as ``schema_diff`` reads them."""
        return schema_fields(self.schemas(), self.refs)


_FIELD = ["path", "op_id", "relation", "status", "field"]


def _step(open_rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Follow one reference, then tell what a row is: recursive, again, container or plain."""
    met = F.array_contains("seen", F.col("ref"))
    rows = _followed(open_rows, refs)
    v = F.col("v")
    members = _at(v, "allOf", _ARRAY)
    state = (
        F.when(F.col("hit") & met, "recursive")
        .when(F.col("hit") & _at(v, "$ref").isNotNull(), "again")
        .when(members.isNotNull(), "container")
        .otherwise("plain")
    )
    seen = F.when(F.col("hit") & ~met, F.concat("seen", F.array("ref"))).otherwise(F.col("seen"))
    return rows.withColumn("state", state).withColumn("seen", seen).drop("ref", "hit")


def _members(containers: DataFrame) -> DataFrame:
    rest = [c for c in containers.columns if c not in ("v", "nth", "state")]
    member = containers.select(*rest, F.col("nth").alias("_nth"), F.posexplode(_at(F.col("v"), "allOf", _ARRAY)).alias("_k", "v"))
    return member.where(_map(F.col("v")).isNotNull()).select(*rest, "v", F.concat("_nth", F.array("_k")).alias("nth"))


def _shape(rows: DataFrame) -> DataFrame:
    """The field row of a top row (``nth`` empty); members only say that evidence is incomplete."""
    v, plain = F.col("v"), F.col("state") == "plain"
    kinds = F.transform(_at(v, "type", _ARRAY), lambda x: F.try_variant_get(x, "$", "string"))
    listed = F.array_sort(F.filter(kinds, lambda x: x != "null"))
    kind = (
        F.when(F.col("state") == "recursive", "recursive")
        .when(F.col("state") == "container", "object")
        .when(F.size(kinds) >= 0, F.array_join(listed, "|"))
        .when(_at(v, "type", "string").isNotNull(), _at(v, "type", "string"))
        .when(_map(_at(v, "properties")).isNotNull(), "object")
        .otherwise("unknown")
    )
    nullable = F.coalesce(_at(v, "nullable", "boolean"), F.lit(False)) | F.coalesce(
        F.array_contains(kinds, "null"), F.lit(False)
    )
    enum = F.coalesce(F.array_join(_names(_at(v, "enum", _ARRAY)), "|"), F.lit(""))
    limits = F.concat_ws(
        ";", *[F.when(_at(v, c).isNotNull(), F.concat(F.lit(f"{c}="), _at(v, c, "string"))) for c in CONSTRAINTS]
    )
    top = F.size("nth") == 0
    return rows.select(
        *_FIELD,
        "hidden",
        F.when(top, kind).alias("type"),
        F.when(top, plain & nullable).alias("nullable"),
        F.when(top, F.when(plain, enum).otherwise("")).alias("enum"),
        F.when(top, F.when(plain, limits).otherwise("")).alias("constraints"),
        F.when(top, F.col("required")).alias("required"),
        (F.col("state") == "recursive").alias("incomplete"),
    ).where("type IS NOT NULL OR incomplete")


def _children(rows: DataFrame) -> DataFrame:
    """Next frontier: properties (the last allOf member that has one wins), items and variants."""
    v = F.col("v")
    plain = rows.where("state = 'plain'")
    carry = ["path", "op_id", "relation", "status"]
    names = lambda x: F.coalesce(_names(_at(x, "required", _ARRAY)), F.array().cast("array<string>"))
    under = F.when(F.col("field") == "", F.col("key")).otherwise(F.concat_ws(".", "field", "key"))

    def child(df: DataFrame, field: Column, required: Column, hidden: Column) -> DataFrame:
        return df.where(_map(F.col("c")).isNotNull()).select(
            *carry, field.alias("field"), required.alias("required"), hidden.alias("hidden"), "seen",
            F.array().cast("array<int>").alias("nth"), F.col("c").alias("v"),
        )

    props = plain.select(
        *_FIELD, "hidden", "seen", "nth", names(v).alias("names"), F.explode(_map(_at(v, "properties"))).alias("key", "c")
    )
    own = child(props.where(F.size("nth") == 0), under, F.array_contains("names", F.col("key")), F.col("hidden"))
    # Members of one container: the last one's property counts, requiredness adds up.
    shared = props.where((F.size("nth") > 0) & _map(F.col("c")).isNotNull())
    last = shared.groupBy(*_FIELD, "key").agg(F.max("nth").alias("nth"))
    needed = (
        plain.where(F.size("nth") > 0)
        .select(*_FIELD, F.explode(names(v)).alias("key"))
        .distinct()
        .withColumn("need", F.lit(True))
    )
    merged = shared.join(last, [*_FIELD, "key", "nth"]).join(needed, [*_FIELD, "key"], "left")
    merged = child(merged, under, F.coalesce("need", F.lit(False)), F.col("hidden"))
    single = plain.where(F.size("nth") == 0)
    items = child(
        single.withColumn("c", _at(v, "items")), F.concat("field", F.lit("[]")), F.lit(False), F.col("hidden")
    )
    # Alternatives are not compared field by field; a cycle inside one leaves the whole incomplete.
    either = F.concat(
        *[F.coalesce(_at(v, key, _ARRAY), F.array().cast(_ARRAY)) for key in ("oneOf", "anyOf")]
    )
    variants = single.select(*[c for c in single.columns if c != "v"], F.posexplode(either).alias("_k", "c"))
    variants = child(variants, F.concat("field", F.lit("|"), F.col("_k")), F.lit(False), F.lit(True))
    return own.unionByName(merged).unionByName(items).unionByName(variants)


def schema_fields(schemas: DataFrame, refs: DataFrame) -> DataFrame:
    """op_id, relation, status, field_path, type, nullable, enum, constraints, required, incomplete.

    ``schemas(path, op_id, relation, status, v)``. A field's evidence is incomplete if the field
    ends a cycle; the root's is if any field's or alternative's below it is.
    """
    frontier = schemas.select(
        "path", "op_id", "relation", "status", F.lit("").alias("field"), F.lit(False).alias("required"),
        F.lit(False).alias("hidden"), F.array().cast("array<string>").alias("seen"),
        F.array().cast("array<int>").alias("nth"), "v",
    )
    shapes = None
    while True:
        level, open_rows = None, frontier
        while open_rows is not None:
            met = cut(_step(open_rows, refs))
            states = {r["state"] for r in met.select("state").distinct().collect()}
            if level is None and shapes is not None and not states:
                return _gathered(shapes)
            done = met.where("state <> 'again'")
            level = done if level is None else level.unionByName(done)
            more = []
            if "container" in states:
                more.append(_members(met.where("state = 'container'")))
            if "again" in states:
                more.append(met.where("state = 'again'").drop("state"))
            open_rows = reduce(DataFrame.unionByName, more) if more else None
        here = _shape(level)
        shapes = here if shapes is None else shapes.unionByName(here)
        frontier = _children(level)


def _gathered(shapes: DataFrame) -> DataFrame:
    key = ["op_id", "relation", "status"]
    cols = ["type", "nullable", "enum", "constraints", "required", "incomplete"]
    one = shapes.groupBy(*key, F.col("field").alias("field_path"), "hidden").agg(*[F.max(c).alias(c) for c in cols])
    broken = shapes.where("incomplete").select(*key).distinct().withColumn("_broken", F.lit(True))
    return (
        one.where("NOT hidden")
        .join(broken, key, "left")
        .withColumn("incomplete", F.col("incomplete") | ((F.col("field_path") == "") & F.coalesce("_broken", F.lit(False))))
        .select(*key, "field_path", *cols)
    )


def openapi_operations(docs: DataFrame) -> DataFrame:
    """One row per path and method of the API documents in ``content``: parameters, media, statuses, auth."""
    c = Contract(docs)
    params = c.parameters().groupBy("op_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("location").alias("in"), "name", "required", "style", "explode"))).alias("params")
    )
    media = c.media().groupBy("op_id").agg(
        *[
            F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("media")))).alias(f"{side}_media")
            for side in ("request", "response")
        ]
    )
    found = c.operations().join(params, "op_id", "left").join(media, "op_id", "left")
    lists = ("params", "request_media", "response_media")
    return found.withColumns({c: F.coalesce(c, F.array()) for c in lists})
