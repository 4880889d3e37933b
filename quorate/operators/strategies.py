"""Validation of strategy batches: a schema for the documents' form, joins for what stages, lenses and strategies must have together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.operators.documents import TASK_DOCUMENTS, checked
from quorate.operators.lineage import cut, spread

# Fixed values of a strategy batch.
ROLES = ("proposer", "critic", "verifier", "judge", "auditor", "challenger", "juror", "integrator")
SCOPES = ("all", "disputed", "low_margin", "no_consensus")
MODES = ("base_plurality", "agreement_gate", "weighted_plurality")
MOST_CALLS = 15

_ROLE_LIST = {"type": "array", "items": {"enum": list(ROLES)}}
_COUNT = {"type": "integer", "minimum": 0}
SCHEMA = {
    "type": "object", "required": ["strategy_id", "stages", "selector"],
    "properties": {"strategy_id": {"type": "string", "minLength": 1}, "stages": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/stage"}}, "selector": {"$ref": "#/$defs/selector"}},
    "$defs": {
        "stage": {
            "type": "object", "required": ["stage_id", "role", "count", "scope", "lens_ids", "instruction"],
            "properties": {
                "stage_id": {"type": "string", "minLength": 1}, "role": {"enum": list(ROLES)}, "count": {"type": "integer", "minimum": 1, "maximum": MOST_CALLS}, "scope": {"enum": list(SCOPES)}, "reads": {"type": "array", "items": {"type": "string"}},
                "scope_roles": _ROLE_LIST | {"minItems": 1}, "lens_ids": {"type": "array", "items": {"type": "string"}}, "instruction": {"type": "string", "pattern": r"\S"}},
        },
        "selector": {
            "type": "object", "required": ["mode"], "properties": {"mode": {"enum": list(MODES)}, "base_roles": _ROLE_LIST | {"minItems": 1}},
            "anyOf": [
                {"properties": {"mode": {"const": "base_plurality"}}},
                {"properties": {"mode": {"const": "agreement_gate"}, "decision_roles": _ROLE_LIST | {"minItems": 1}, "support_roles": _ROLE_LIST, "min_agree": _COUNT, "min_support": _COUNT}, "required": ["decision_roles"]},
                {"properties": {"mode": {"const": "weighted_plurality"}, "role_weights": {"type": "object", "properties": {r: {"type": "number", "minimum": 5e-324} for r in ROLES}, "additionalProperties": False}}, "required": ["role_weights"]},
            ],
        },
    },
}


def strategy_errors(batch: DataFrame, lenses: DataFrame, doc: str = "doc", value: str = "value", lens: str = "lens_id") -> DataFrame:
    """(doc, error): all errors of a batch of strategies, (doc, variant), each as `path: what`; a valid strategy has no row.

    Besides the schema: stage ids differ within a strategy, a stage reads earlier stages only, has one known lens a call, there is
    a proposer, calls are MOST_CALLS at most, weights aren't empty, and of strategies that share an id only the first by doc
    has it. Parts that the schema refuses are left out of these rules. Lenses are joined, so a catalog may be of any size.
    """
    docs = cut(spread(batch.select(F.col(doc).alias("doc"), F.col(value).alias("value")), TASK_DOCUMENTS, "doc").where("value is not null"))
    got = lambda p, kind: F.try_variant_get("value", p, kind)
    stage = lambda p, kind: F.try_variant_get("stage", p, kind)
    ids = docs.select("doc", got("$.strategy_id", "string").alias("id")).where("id is not null")
    again = ids.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("doc"))).where("n > 1").select("doc", F.lit("$.strategy_id: repeated").alias("error"))
    stages = docs.select("doc", F.posexplode(got("$.stages", "array<variant>")).alias("i", "stage"))
    stages = cut(stages.select("doc", "i", stage("$.stage_id", "string").alias("stage_id"), stage("$.role", "string").alias("role"), stage("$.count", "bigint").alias("count"), stage("$.reads", "array<string>").alias("reads"), stage("$.lens_ids", "array<string>").alias("lens_ids")))
    at = lambda what: F.concat(F.lit("$.stages["), F.col("i").cast("string"), F.lit(f"]{what}"))
    place = lambda name: F.concat(F.lit("$.stages["), F.col("i").cast("string"), F.lit(f"].{name}["), F.col("j").cast("string"))
    first = stages.where("stage_id is not null").groupBy("doc", "stage_id").agg(F.min("i").alias("first"))
    twice = stages.join(first, ["doc", "stage_id"]).where("i > first").select("doc", at(".stage_id: repeated").alias("error"))
    reads = stages.select("doc", "i", F.posexplode("reads").alias("j", "stage_id")).join(first, ["doc", "stage_id"], "left")
    ahead = reads.where("first is null or first >= i").select("doc", F.concat(place("reads"), F.lit("]: not an earlier stage")).alias("error"))
    odd = stages.where("lens_ids is not null and count is not null and size(lens_ids) <> count").select("doc", at(".lens_ids: one per call").alias("error"))
    known = lenses.select(F.col(lens).alias("lens")).distinct()
    unknown = stages.select("doc", "i", F.posexplode("lens_ids").alias("j", "lens")).join(known, "lens", "left_anti").select("doc", F.concat(place("lens_ids"), F.lit("]: unknown lens")).alias("error"))
    own = stages.groupBy("doc").agg(F.count_if(F.col("role") == "proposer").alias("proposers"), F.sum("count").alias("calls")).withColumnRenamed("doc", "of")
    objects = docs.where(F.schema_of_variant("value").startswith("OBJECT")).join(own, F.col("doc") == F.col("of"), "left")
    none = objects.where("coalesce(proposers, 0) = 0").select("doc", F.lit("$.stages: no proposer").alias("error"))
    many = objects.where(F.col("calls") > MOST_CALLS).select("doc", F.lit("$.stages: too many calls").alias("error"))
    empty = docs.where((got("$.selector.mode", "string") == "weighted_plurality") & (F.size(got("$.selector.role_weights", "map<string,variant>")) == 0)).select("doc", F.lit("$.selector.role_weights: empty").alias("error"))
    out = checked(docs, SCHEMA)
    for more in (again, twice, ahead, odd, unknown, none, many, empty):
        out = out.union(more)
    return out
