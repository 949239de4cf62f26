import json

from siteaudit.sources import api_documents as api


def contract(spark, *docs):
    rows = [(p, c if isinstance(c, str) or c is None else json.dumps(c), "x") for p, c in docs]
    return api.Contract(spark.createDataFrame(rows, "path string, content string, doc string"))


def spec(schemas, root, **more):
    content = {"application/json": {"schema": root}}
    return {
        "openapi": "3.1.0",
        "paths": {"/a": {"get": {"responses": {"200": {"content": content}}}}},
        "components": {"schemas": schemas},
    } | more


def fields(c):
    return {
        r["field_path"]: (r["type"], r["nullable"], r["enum"], r["constraints"], r["required"], r["incomplete"])
        for r in c.fields().collect()
    }


def kinds(c):
    return {k: v[0] for k, v in fields(c).items()}


def ref(name):
    return {"$ref": f"#/components/schemas/{name}"}


def test_chains_and_escaped_names(spark):
    schemas = {"A": ref("B"), "B": ref("c~1d~0e"), "c/d~e": {"type": "object", "properties": {"x": {"type": "string"}}}}
    assert kinds(contract(spark, ("a.json", spec(schemas, ref("A"))))) == {"": "object", "x": "string"}


def test_cycles_end_and_leave_the_root_incomplete(spark):
    schemas = {
        "Node": {"type": "object", "properties": {"next": ref("Node"), "kids": {"type": "array", "items": ref("Node")}}},
        "Loop": ref("Loop"),
    }
    got = fields(contract(spark, ("a.json", spec(schemas, ref("Node")))))
    assert {k: v[0] for k, v in got.items()} == {
        "": "object", "next": "recursive", "kids": "array", "kids[]": "recursive",
    }
    assert {k for k, v in got.items() if v[5]} == {"", "next", "kids[]"}
    assert kinds(contract(spark, ("a.json", spec(schemas, ref("Loop"))))) == {"": "recursive"}


def test_nested_members_override_and_add_up(spark):
    def part(required, **props):
        return {"type": "object", "required": required, "properties": props}

    root = {
        "allOf": [
            part(["a"], a={"type": "string"}, b={"type": "object", "properties": {"lost": {"type": "string"}}}),
            {"allOf": [ref("Inner"), part(["c"], c={"type": "integer"})]},
            part([], a={"type": "number"}),
        ],
        "properties": {"ignored": {"type": "string"}},
    }
    inner = part(["b"], b={"type": "object", "properties": {"won": {"type": "string"}}})
    got = fields(contract(spark, ("a.json", spec({"Inner": inner}, root))))
    assert {k: (v[0], v[4]) for k, v in got.items()} == {
        "": ("object", False), "a": ("number", True), "b": ("object", True), "b.won": ("string", False),
        "c": ("integer", True),
    }


def test_alternatives_count_only_for_completeness(spark):
    flat = {"oneOf": [{"type": "string"}, {"type": "object", "properties": {"x": {"type": "string"}}}]}
    got = fields(contract(spark, ("a.json", spec({}, flat))))
    assert got == {"": ("unknown", False, "", "", False, False)}
    deep = {"Node": {"type": "object", "properties": {"v": {"anyOf": [{"type": "null"}, ref("Node")]}}}}
    got = fields(contract(spark, ("a.json", spec(deep, ref("Node")))))
    assert {k: v[5] for k, v in got.items()} == {"": True, "v": False}


def test_dead_references_types_and_limits(spark):
    root = {
        "properties": {
            "dead": ref("Nobody"),
            "many": {"type": ["string", "integer", "null"], "enum": ["x", None, "x", 3]},
            "none": {},
            "limited": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "number", "maximum": 2.5}},
            "not a schema": [1],
        }
    }
    got = fields(contract(spark, ("a.json", spec({}, root))))
    assert got[""][0] == "object" and "not a schema" not in got
    assert got["dead"][0] == "unknown" and got["none"][0] == "unknown"
    assert got["many"] == ("integer|string", True, "3|x", "", False, False)
    assert got["limited"][3] == "minItems=1;maxItems=3" and got["limited[]"][3] == "maximum=2.5"


def test_deep_and_wide_schemas_are_whole(spark):
    deep = {"type": "string"}
    for _ in range(9):
        deep = {"type": "object", "properties": {"d": deep}}
    wide = {f"w{k}": {"type": "string"} for k in range(3_000)}
    assert len(kinds(contract(spark, ("a.json", spec({}, {"properties": {"deep": deep, **wide}}))))) == 3_011


def test_unreadable_documents_and_empty_tables(spark):
    c = contract(spark, ("a.json", "{"), ("b.yaml", "a: [1"), ("c.json", None), ("d.json", "[]"), ("e.json", '{"paths":{}}'), (None, "x: 1"))
    assert c.operations().count() == c.fields().count() == c.media().count() == c.parameters().count() == 0
    empty = contract(spark, ("e.json", '{"paths":{"/a":{"get":{}}}}'))
    assert empty.fields().count() == 0 and empty.operations().first()["auth"] == "absent"


def test_swagger_two(spark):
    doc = {
        "swagger": "2.0",
        "produces": ["application/json"],
        "parameters": {"Body": {"in": "body", "name": "b", "schema": {"$ref": "#/definitions/T"}}},
        "definitions": {"T": {"type": "object", "properties": {"t": {"type": "string", "format": "date"}}}},
        "paths": {
            "/t": {
                "parameters": [{"in": "query", "name": "q", "required": True}, {"in": "header", "name": "h"}],
                "post": {
                    "consumes": ["text/csv", "text/csv", "application/json"],
                    "parameters": [{"$ref": "#/parameters/Body"}, {"in": "query", "name": "q", "collectionFormat": "csv"}],
                    "responses": {"200": {"schema": {"$ref": "#/definitions/T"}}, "500": {}},
                },
            }
        },
    }
    c = contract(spark, ("t.json", doc))
    assert {(r["relation"], r["field_path"], r["type"]) for r in c.fields().collect()} == {
        (s, f, t) for s in ("request", "response") for f, t in (("", "object"), ("t", "string"))
    }
    assert sorted((r["side"], r["status"], r["media"]) for r in c.media().collect()) == [
        ("request", "", "application/json"), ("request", "", "text/csv"),
        ("response", "200", "application/json"), ("response", "500", "application/json"),
    ]
    assert {(r["location"], r["name"], r["required"], r["serial"]) for r in c.parameters().collect()} == {
        ("query", "q", False, "csv"), ("header", "h", False, ""),
    }


def test_auth_of_alternatives(spark):
    cases = {"a": (None, "absent"), "b": ([], "absent"), "c": ([{}], "absent"), "d": ([{"k": []}], "present"),
             "e": ([{}, {"k": []}], "unknown"), "f": ("odd", "unknown")}
    docs = [
        (f"{n}.json", {"paths": {"/x": {"get": {} if s is None else {"security": s}}}} | ({"security": [{"top": []}]} if n == "b" else {}))
        for n, (s, _) in cases.items()
    ]
    got = {r["path"][0]: r["auth"] for r in contract(spark, *docs).operations().collect()}
    assert got == {n: auth for n, (_, auth) in cases.items()}
