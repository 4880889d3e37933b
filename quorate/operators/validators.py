"""Validators: each gives an array of errors per record, so that valid records have none and invalid ones say why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions.scalars import canonical_answer


def errors(rules: dict[str, Column]) -> Column:
    """The names of the rules that do not hold; null counts as not."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))


def strict_json(text: Column) -> Column:
    """The text as a variant if it is one JSON value without repeated keys, NaN or anything after it, else null; a BOM and white space around are let pass."""
    clean = F.trim(F.regexp_replace(text, "^﻿", ""))
    whole = clean.rlike(r'^(?s)(\{.*\}|\[.*\]|".*"|-?[0-9.eE+-]+|true|false|null)\z')
    return F.when(whole, F.try_parse_json(clean))


def unwrap(value: Column, names: Sequence[str], kind: str = "array<string>") -> Column:
    """The first of the named fields of a variant that can be read as the kind; else the variant itself if it can."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{n}", kind) for n in names], F.try_variant_get(value, "$", kind))


def item_errors(role: str, size: int = 2) -> Column:
    """Errors of an item of a role: answer, confidence from 0 to 1, and what the role must have besides."""
    rules = {"answer": canonical_answer(F.col("answer"), size).isNotNull() | F.lit(role in ("critic", "verifier")), "confidence": F.col("confidence").between(0, 1)}
    if role in ("critic", "verifier"):
        rules["verdict"] = F.col("verdict").isin("accept", "reject", "unsure")
    if role in ("judge", "synthesizer"):
        rules["choice"] = F.col("choice").rlike(r"^C[0-9]{2}\z")
    return errors(rules)


def document_errors(documents: DataFrame, expected: DataFrame, doc: str, case: str, size: int) -> DataFrame:
    """Per document its number of results and the cases that are missing, extra or repeated."""
    own = documents.groupBy(doc).agg(F.collect_list(case).alias("got"))  # a document's results
    want = expected.groupBy(doc).agg(F.collect_set(case).alias("want"))
    both = want.join(own, doc, "left").withColumn("got", F.coalesce("got", F.expr("filter(want, x -> false)")))
    return both.select(doc, F.size("got").alias("results"), (F.size("got") == size).alias("right_size"), F.size(F.array_except("want", "got")).alias("missing"), F.size(F.array_except("got", "want")).alias("extra"), (F.size("got") - F.size(F.array_distinct("got"))).alias("repeated"))


def attempt_class(timed_out: Column, text: Column, valid: Column) -> Column:
    """Text with substance beats a transport error: valid, malformed or infrastructure failure."""
    has = F.coalesce(F.trim(text) != "", F.lit(False))
    return F.when(has & F.coalesce(valid, F.lit(False)), "semantic_response").when(has, "malformed_output").when(F.coalesce(timed_out, F.lit(False)), "infrastructure_failure").otherwise("infrastructure_failure")


def salvage(items: DataFrame, planned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every planned case with its item if exactly one is valid, else null."""
    n = F.count_if("valid").over(Window.partitionBy(*keys))
    alone = items.withColumn("n", n).where("valid and n = 1").drop("n", "valid")
    return planned.join(alone, list(keys), "left")


def rule_scores(texts: DataFrame, rules: DataFrame, text: str, key: str) -> DataFrame:
    """Per key the rules of which all patterns are found in the text; rules are (rule, pattern), few."""
    pats = rules.groupBy("rule").agg(F.collect_list("pattern").alias("patterns"))
    hit = F.forall("patterns", lambda p: F.regexp_like(F.col(text), p))
    return texts.crossJoin(F.broadcast(pats)).where(hit).select(key, "rule")  # a row per rule
