"""Nested JSON documents: a walk of all their keys and values, a schema interpreter, and what is built on both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.draws import let
from quorate.operators.lineage import cut, spread

_STRINGS = "array<string>"
#: Documents of a task of the schema interpreter, which takes about half a millisecond for one.
TASK_DOCUMENTS = 1 << 12
#: Keywords that the interpreter evaluates; others that only describe are let pass.
KEYWORDS = {"$ref", "const", "enum", "oneOf", "anyOf", "type", "required", "properties", "additionalProperties", "minItems", "maxItems", "uniqueItems", "prefixItems", "items", "minLength", "maxLength", "pattern", "minimum", "maximum"}
SILENT = {"$schema", "$id", "$defs", "definitions", "title", "description", "examples", "default", "$comment"}


def walk(documents: DataFrame, doc: str = "doc", value: str = "value") -> DataFrame:
    """(doc, path, key, pos, kind, value): every value of every document, by rounds of one level each, from $ on.

    Documents are (doc, value), value being a variant; key is null but in objects, pos but in arrays. A null document gives no
    row. A round explodes what the last one has found nested, until nothing is, so that any depth is reached.
    """
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    level = documents.where(F.col(value).isNotNull()).select(F.col(doc).alias("doc"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("pos"), kind(F.col(value)).alias("kind"), F.col(value).alias("value"))
    found = level = cut(level)
    while True:
        nested = level.where(F.col("kind").isin("OBJECT", "ARRAY"))
        if nested.isEmpty():
            return found
        each = nested.select("doc", "path", F.when(F.col("kind") == "OBJECT", F.map_entries(F.try_variant_get("value", "$", "map<string,variant>"))).alias("fields"), F.when(F.col("kind") == "ARRAY", F.try_variant_get("value", "$", "array<variant>")).alias("items"))
        fields = each.where("fields is not null").select("doc", "path", F.explode("fields").alias("f")).select("doc", F.concat("path", F.lit("."), "f.key").alias("path"), F.col("f.key").alias("key"), F.lit(None).cast("int").alias("pos"), F.col("f.value").alias("value"))
        items = each.where("items is not null").select("doc", "path", F.posexplode("items").alias("pos", "value")).select("doc", F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("path"), F.lit(None).cast("string").alias("key"), "pos", "value")
        level = cut(fields.union(items).select("doc", "path", "key", "pos", kind(F.col("value")).alias("kind"), "value"))
        found = found.union(level)


def forbidden(documents: DataFrame, names: Sequence[str], doc: str = "doc", value: str = "value") -> DataFrame:
    """(doc, path): where a document has one of the names as a key, at any depth and however it is written."""
    return walk(documents, doc, value).where(F.col("key").isin(*names)).select("doc", "path")


def _kind(v: Column) -> Column:
    """string, integer, number (one that isn't an integer), boolean, null, object or array."""
    s = F.schema_of_variant(v)
    whole = (s == "BIGINT") | s.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")
    return F.when(whole, "integer").when((s == "DOUBLE") | s.startswith("DECIMAL"), "number").when(s == "VOID", "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").otherwise(F.lower(s))


def equals(v: Column, const) -> Column:
    """Whether a variant is the JSON value: of the same type and, numbers by value, equal in all parts."""
    kind = _kind(v)
    if const is None:
        return kind == "null"
    if isinstance(const, bool):
        return (kind == "boolean") & F.coalesce(F.try_variant_get(v, "$", "boolean") == const, F.lit(False))
    if isinstance(const, str):
        return (kind == "string") & F.coalesce(F.try_variant_get(v, "$", "string") == const, F.lit(False))
    if isinstance(const, int | float):
        number = F.try_variant_get(v, "$", "decimal(38,0)") == F.lit(str(const)).cast("decimal(38,0)") if isinstance(const, int) else F.try_variant_get(v, "$", "double") == const
        exact = F.try_variant_get(v, "$", "double") == float(const)
        return kind.isin("integer", "number") & F.coalesce(number & exact, F.lit(False))
    if isinstance(const, list):
        return (kind == "array") & let(F.try_variant_get(v, "$", "array<variant>"), lambda a: F.coalesce(_all([F.size(a) == len(const), *[equals(F.get(a, F.lit(i)), c) for i, c in enumerate(const)]]), F.lit(False)))
    return (kind == "object") & let(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: F.coalesce(_all([F.size(m) == len(const), *[equals(F.try_element_at(m, F.lit(k)), c) for k, c in const.items()]]), F.lit(False)))


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out &= F.coalesce(p, F.lit(False))
    return out


def _resolve(root: dict, reference: str):
    if not reference.startswith("#/"):
        raise ValueError(f"not a reference within the schema: {reference}")
    at = root
    for part in reference[2:].split("/"):
        at = at[part.replace("~1", "/").replace("~0", "~")]
    return at


def schema_errors(schema: dict, value: Column, depth: int = 8) -> Column:
    """All errors of a variant against a JSON schema, each as `path: keyword`; a null column has none.

    Known are the KEYWORDS; any other that isn't SILENT raises ValueError. const and enum compare type and value, numbers by value. oneOf wants exactly
    one branch without errors and anyOf one at least; a branch's own errors aren't listed, oneOf is the last thing that is looked at, and so
    is a type that isn't met. References are followed into documents `depth` levels deep; what lies deeper isn't looked at, so
    give the depth of the deepest document, which walk() tells. A reference to itself that descends to no other value raises ValueError.
    """
    return F.when(value.isNull(), INLINE.none()).otherwise(let(value, lambda v: _errors(schema, schema, v, F.lit("$"), depth, (), INLINE)))


def check(documents: DataFrame, schema: dict, doc: str = "doc", value: str = "value", depth: int = 4) -> DataFrame:
    """(doc, error): the errors of schema_errors(), a row each, for documents of any depth.

    What a reference leads to is left to the next round, as a row of its own, so that an expression holds one level of
    references and recursion goes as deep as the documents do. Within branches of oneOf and anyOf references are followed `depth` levels.
    """
    own = cut(documents.where(F.col(value).isNotNull()).select(F.col(doc).alias("doc"), F.col(value).alias("value")))
    return checked(spread(own, TASK_DOCUMENTS, "doc"), schema, depth=depth)


def checked(documents: DataFrame, schema: dict, doc: str = "doc", value: str = "value", depth: int = 4) -> DataFrame:
    """check() of documents in the parts that they have."""
    level = documents.where(F.col(value).isNotNull()).select(F.col(doc).alias("doc"), F.lit("$").alias("path"), F.lit("").alias("ref"), F.col(value).alias("value"))
    out, refs = [], {"": schema}
    while True:
        parts = []
        for ref, sub in refs.items():
            while "$ref" in sub:  # one that is a reference itself
                sub = _resolve(schema, sub["$ref"])
            found = _errors(schema, sub, F.col("value"), F.col("path"), depth, (), ROUNDS)
            parts.append(level.where(F.col("ref") == ref).select("doc", F.explode(found).alias("e")).select("doc", "e.*"))
        now = parts[0]
        for more in parts[1:]:
            now = now.union(more)
        now = cut(now)
        out.append(now.where("error is not null").select("doc", "error"))
        level = now.where("error is null").select("doc", "path", "ref", "value")
        refs = {r.ref: _resolve(schema, r.ref) for r in level.select("ref").distinct().collect()}  # references that the schema names
        if not refs:
            break
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    return every


class _Inline:
    """Errors as an array of texts; references are followed at once."""

    follow = True

    def none(self) -> Column:
        return F.array().cast(_STRINGS)

    def error(self, text: Column) -> Column:
        return F.array(text)


class _Rounds:
    """Errors, and references that are still to be followed, as an array of structs."""

    follow = False
    kind = "struct<error: string, path: string, ref: string, value: variant>"

    def none(self) -> Column:
        return F.array().cast(f"array<{self.kind}>")

    def error(self, text: Column) -> Column:
        nothing = F.lit(None).cast("string")
        return F.array(F.struct(text.alias("error"), nothing.alias("path"), nothing.alias("ref"), F.lit(None).cast("variant").alias("value")))

    def reference(self, path: Column, ref: str, v: Column) -> Column:
        return F.array(F.struct(F.lit(None).cast("string").alias("error"), path.alias("path"), F.lit(ref).alias("ref"), v.alias("value")))


INLINE, ROUNDS = _Inline(), _Rounds()


def _one(to, failed: Column, path: Column, word: str) -> Column:
    return F.when(F.coalesce(failed, F.lit(True)), to.error(F.concat(path, F.lit(f": {word}")))).otherwise(to.none())


def _errors(root: dict, s: dict, v: Column, path: Column, depth: int, seen: tuple, to) -> Column:
    if depth < 0:
        return to.none()
    if "$ref" in s and not to.follow:
        return to.reference(path, s["$ref"], v)
    if "$ref" in s:
        if s["$ref"] in seen:
            raise ValueError(f"a reference to itself: {s['$ref']}")
        return _errors(root, _resolve(root, s["$ref"]), v, path, depth, (*seen, s["$ref"]), to)
    if unknown := set(s) - KEYWORDS - SILENT:
        raise ValueError(f"unknown keywords: {sorted(unknown)}")
    same = lambda option: F.size(_errors(root, option, v, path, depth, seen, INLINE)) == 0
    parts = []
    if "const" in s:
        parts.append(_one(to, ~equals(v, s["const"]), path, "const"))
    if "enum" in s:
        either = F.lit(False)
        for option in s["enum"]:
            either |= equals(v, option)
        parts.append(_one(to, ~either, path, "enum"))
    if "oneOf" in s:
        matches = sum((same(option).cast("int") for option in s["oneOf"]), F.lit(0))
        return F.concat(*parts, _one(to, matches != 1, path, "oneOf"))
    rest = _of_kind(root, s, v, path, depth, to)
    kinds = s.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if kinds:
        names = [*kinds, "integer"] if "number" in kinds else kinds
        rest = F.when(_kind(v).isin(*names), rest).otherwise(to.error(F.concat(path, F.lit(": type"))))
    if "anyOf" in s:
        some = F.lit(False)
        for option in s["anyOf"]:
            some |= same(option)
        rest = F.when(some, rest).otherwise(to.error(F.concat(path, F.lit(": anyOf"))))
    return F.concat(*parts, rest)


def _of_kind(root: dict, s: dict, v: Column, path: Column, depth: int, to) -> Column:
    """Errors of the keywords that hold for objects, arrays, strings or numbers only."""
    none = to.none()
    deeper = lambda sub, x, at: let(x, lambda y: _errors(root, sub, y, at, depth - 1 if to.follow else depth, (), to))
    field = lambda k: F.concat(path, F.lit("."), k if isinstance(k, Column) else F.lit(k))
    place = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
    out = none
    known, others = s.get("properties", {}), s.get("additionalProperties")
    if known or s.get("required") or others is False or isinstance(others, dict):

        def fields(m: Column) -> Column:
            parts = [none, *[_one(to, ~F.map_contains_key(m, k), field(k), "required") for k in s.get("required", [])]]
            if depth:
                parts += [F.when(F.map_contains_key(m, k), deeper(sub, F.try_element_at(m, F.lit(k)), field(k))).otherwise(none) for k, sub in known.items()]
            more = F.filter(F.map_entries(m), lambda e: ~e["key"].isin(*known)) if known else F.map_entries(m)
            if others is False:
                parts.append(F.flatten(F.transform(more, lambda e: to.error(F.concat(field(e["key"]), F.lit(": unexpected"))))))
            elif isinstance(others, dict) and depth:
                parts.append(F.flatten(F.transform(more, lambda e: deeper(others, e["value"], field(e["key"])))))
            return F.concat(*parts)

        out = F.when(_kind(v) == "object", let(F.try_variant_get(v, "$", "map<string,variant>"), fields)).otherwise(out)
    prefix, items = s.get("prefixItems", []), s.get("items")
    if {"minItems", "maxItems", "uniqueItems", "prefixItems", "items"} & set(s):

        def elements(a: Column) -> Column:
            parts = [none, *[_one(to, ~ok(F.size(a), s[w]), path, w) for w, ok in (("minItems", lambda x, y: x >= y), ("maxItems", lambda x, y: x <= y)) if w in s]]
            if s.get("uniqueItems"):
                parts.append(_one(to, F.size(F.array_distinct(F.transform(a, lambda x: F.to_json(x)))) != F.size(a), path, "uniqueItems"))
            if depth:
                parts += [F.when(F.size(a) > i, deeper(sub, F.get(a, F.lit(i)), place(F.lit(i)))).otherwise(none) for i, sub in enumerate(prefix)]
            if items is False:
                parts.append(_one(to, F.size(a) > len(prefix), path, "items"))
            elif isinstance(items, dict) and depth:
                tail = F.slice(a, F.lit(len(prefix) + 1), F.greatest(F.size(a) - len(prefix), F.lit(0)))
                parts.append(F.flatten(F.transform(tail, lambda x, i: deeper(items, x, place(i + len(prefix))))))
            return F.concat(*parts)

        out = F.when(_kind(v) == "array", let(F.try_variant_get(v, "$", "array<variant>"), elements)).otherwise(out)
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    texts = {"minLength": lambda y: F.char_length(text) >= y, "maxLength": lambda y: F.char_length(text) <= y, "pattern": lambda y: text.rlike(y)}
    numbers = {"minimum": lambda y: number >= y, "maximum": lambda y: number <= y}
    for kinds, tests in ((["string"], texts), (["integer", "number"], numbers)):
        if own := [_one(to, ~test(s[w]), path, w) for w, test in tests.items() if w in s]:
            out = F.when(_kind(v).isin(*kinds), F.concat(none, *own)).otherwise(out)
    return out
