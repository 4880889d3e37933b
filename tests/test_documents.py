"""Walks of nested documents and schemas, against plain recursion over the parsed JSON."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from quorate.operators import documents

NODE = {
    "type": "object", "required": ["id"], "additionalProperties": {"type": ["string", "null"]},
    "properties": {
        "id": {"type": "integer", "minimum": 0, "maximum": 9}, "kind": {"enum": ["a", 1, True, None, {"x": [1, 2]}]}, "one": {"const": 1}, "yes": {"const": True}, "list": {"const": [1, {"k": "v"}]},
        "score": {"type": "number", "minimum": 0.5}, "tag": {"oneOf": [{"type": "string", "maxLength": 3}, {"type": "string", "minLength": 2}, {"type": "integer"}]}, "any": {"anyOf": [{"type": "null"}, {"type": "array", "minItems": 2}], "maxItems": 3},
        "pair": {"type": "array", "prefixItems": [{"type": "string", "pattern": "^x"}, {"type": "boolean"}], "items": False}, "set": {"type": "array", "uniqueItems": True, "minItems": 1, "items": {"type": "integer"}},
        "next": {"$ref": "#/$defs/node"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}},
    },
}
SCHEMA = {"$ref": "#/$defs/node", "$defs": {"node": NODE}}


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, int | float) and isinstance(b, int | float):
        return a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return set(a) == set(b) and all(same(a[k], b[k]) for k in a)
    return a == b


def kind(v):
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "integer", float: "number"}[type(v)]


def plain(v, s, path="$"):
    if "$ref" in s:
        return plain(v, NODE, path)
    out = []
    if "const" in s and not same(v, s["const"]):
        out.append(f"{path}: const")
    if "enum" in s and not any(same(v, x) for x in s["enum"]):
        out.append(f"{path}: enum")
    if "oneOf" in s:
        return out + [f"{path}: oneOf"] * (sum(not plain(v, x, path) for x in s["oneOf"]) != 1)
    if "anyOf" in s and all(plain(v, x, path) for x in s["anyOf"]):
        return [*out, f"{path}: anyOf"]
    types = s.get("type", [])
    types = types if isinstance(types, list) else [types]
    if types and kind(v) not in types and not ("number" in types and kind(v) == "integer"):
        return [*out, f"{path}: type"]
    if isinstance(v, dict):
        out += [f"{path}.{k}: required" for k in s.get("required", []) if k not in v]
        for k, x in v.items():
            if k in s.get("properties", {}):
                out += plain(x, s["properties"][k], f"{path}.{k}")
            elif s.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unexpected")
            elif isinstance(s.get("additionalProperties"), dict):
                out += plain(x, s["additionalProperties"], f"{path}.{k}")
    elif isinstance(v, list):
        out += [f"{path}: minItems"] * (len(v) < s.get("minItems", 0)) + [f"{path}: maxItems"] * (len(v) > s.get("maxItems", math.inf))
        out += [f"{path}: uniqueItems"] * bool(s.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in v}) < len(v))
        first = s.get("prefixItems", [])
        for i, x in enumerate(v):
            if i < len(first):
                out += plain(x, first[i], f"{path}[{i}]")
            elif isinstance(s.get("items"), dict):
                out += plain(x, s["items"], f"{path}[{i}]")
        out += [f"{path}: items"] * (s.get("items") is False and len(v) > len(first))
    elif isinstance(v, str):
        out += [f"{path}: minLength"] * (len(v) < s.get("minLength", 0)) + [f"{path}: maxLength"] * (len(v) > s.get("maxLength", math.inf))
        out += [f"{path}: pattern"] * bool("pattern" in s and not re.search(s["pattern"], v))
    elif isinstance(v, int | float) and not isinstance(v, bool):
        out += [f"{path}: minimum"] * (v < s.get("minimum", -math.inf)) + [f"{path}: maximum"] * (v > s.get("maximum", math.inf))
    return out


VALUES = [None, True, False, 0, 1, 9, 10, -1, 1.5, 0.25, "a", "1", "true", "abcd", "", [], [1], [1, 2], [1, 1], [1, {"k": "v"}], ["x", True], ["y", 1, 2], {"x": [1, 2]}, {"x": [1, 2], "y": 0}, [1, 2, 3, 4], {"id": 3}, {"id": 12, "one": "1"}]
DOCS = [v for v in VALUES] + [{"id": 1, k: v} for k in [*NODE["properties"], "other"] for v in VALUES] + [{"id": 1, "next": {"id": 2, "next": {"next": {"id": "4", "kids": [{"id": 5}, {"kids": [{"one": 2}]}]}}}}, {"id": 10**25}, {"id": 1, "kids": [{"id": 1}] * 5 + [7]}]


def test_schema(spark):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "doc int, text string").withColumn("value", F.try_parse_json("text"))
    got = {i: [] for i in range(len(DOCS))}
    for r in documents.check(rows, SCHEMA).collect():
        got[r.doc].append(r.error)
    got = {i: sorted(e) for i, e in got.items()}
    for i, d in enumerate(DOCS):
        assert got[i] == sorted(plain(d, SCHEMA)), d
    assert sum(map(bool, got.values())) > 100


def test_schema_inline(spark):
    flat = {k: v for k, v in NODE.items() if k != "properties"} | {"properties": {k: v for k, v in NODE["properties"].items() if k not in ("next", "kids")}}
    own = [d for d in DOCS if not (isinstance(d, dict) and {"next", "kids"} & set(d))]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(own)], "doc int, text string").withColumn("value", F.try_parse_json("text"))
    got = {r.doc: sorted(r.e) for r in rows.select("doc", documents.schema_errors(flat, F.col("value")).alias("e")).collect()}
    assert all(got[i] == sorted(plain(d, flat)) for i, d in enumerate(own))


def test_constants_have_types(spark):
    rows = spark.createDataFrame([('"1"',), ("1",), ("1.0",), ("true",), (None,)], "t string").withColumn("v", F.try_parse_json("t"))
    ask = lambda s: [r[0] for r in rows.select(F.size(documents.schema_errors(s, F.col("v")))).collect()]
    assert ask({"const": 1}) == [1, 0, 0, 1, 0] and ask({"enum": ["1"]}) == [0, 1, 1, 1, 0] and ask({"const": True}) == [1, 1, 1, 0, 0]


def test_schemas_that_cannot_be_evaluated():
    for bad in ({"not": {}}, {"$ref": "other.json"}, {"$ref": "#/$defs/a", "$defs": {"a": {"anyOf": [{"$ref": "#/$defs/a"}]}}}):
        with pytest.raises(ValueError):
            documents.schema_errors(bad, F.lit(None))


def steps(v, path="$", key=None):
    yield path, key
    if isinstance(v, dict):
        for k, x in v.items():
            yield from steps(x, f"{path}.{k}", k)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from steps(x, f"{path}[{i}]")


def test_walk(spark):
    texts = [(i, json.dumps(d)) for i, d in enumerate(DOCS)] + [(-1, r'{"a": [{"gold": 1}, {"b": {"gold ": "gold"}}]}'), (-2, '{"gold": '), (-3, None)]
    rows = spark.createDataFrame(texts, "doc int, text string").withColumn("value", F.try_parse_json("text"))
    got = sorted((r.doc, r.path, r.key or "") for r in documents.walk(rows).collect() if r.doc >= 0)
    assert got == sorted((i, p, k or "") for i, d in enumerate(DOCS) for p, k in steps(d))
    assert [tuple(r) for r in documents.forbidden(rows, ["gold", "truth"]).collect()] == [(-1, "$.a[0].gold")]
