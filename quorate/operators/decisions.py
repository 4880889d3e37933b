"""Decision rules over panels of proposers, critics, verifiers and judges: conditional aggregates, one row per case.

gate_open is null for rules that have no gate, which is not the same as false. An answer that a rule cannot give is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.operators import votes

#: Roles that must agree for a gate to open, by system; any_of names a role of which one agreeing voter is enough.
SYSTEMS = {
    "judge": {},
    "gated": {"all_of": {"critic": 2, "judge": 1}},
    "dual": {"all_of": {"judge": 2}},
    "verified": {"all_of": {"verifier": 2, "judge": 1}},
    "deliberative": {"all_of": {"judge": 2}, "any_of": "critic"},
}


def check_gate(base_roles: Sequence[str], decision_roles: Sequence[str], min_agree: int, support_roles: Sequence[str], min_support: int, known: Sequence[str]) -> None:
    """Raises ValueError for a declared gate that names unknown roles, has an empty side or asks for nothing."""
    for name, roles in (("base_roles", base_roles), ("decision_roles", decision_roles), ("support_roles", support_roles)):
        if not roles and not (name == "support_roles" and min_support == 0):
            raise ValueError(f"{name} is empty")
        if unknown := sorted(set(roles) - set(known)):
            raise ValueError(f"{name} has unknown roles: {unknown}")
        if len(set(roles)) < len(roles):
            raise ValueError(f"{name} repeats a role")
    if min_agree < 1 or min_support < 0:
        raise ValueError("min_agree is to be 1 at least and min_support 0 at least")


def final_pick(records: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """An explicit final record if there is one, else the last stage's, then the smallest job id."""
    key = F.struct(F.coalesce(F.col("is_final_output"), F.lit(False)).cast("int") * -1, -F.col("stage_index"), F.col("job_id"))
    return records.groupBy(*by).agg(F.min_by(F.struct("answer", "job_id"), key).alias("x")).select(*by, "x.answer", "x.job_id")


def same(role: str, n: int) -> tuple[Column, Column]:
    """Whether a role's voters are n, all with one non-null answer; and that answer."""
    own = F.col("role") == role
    agreed = (F.count_if(own) == n) & (F.count_if(own & F.col("answer").isNotNull()) == n) & (F.min(F.when(own, F.col("answer"))) == F.max(F.when(own, F.col("answer"))))
    return F.coalesce(agreed, F.lit(False)), F.min(F.when(own, F.col("answer")))


def decide(records: DataFrame, system: str, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """(by, plurality, answer, gate_open, override): the agreed answer if the system's gate opens, else the proposers' plurality.

    The system `judge` takes the answer of the judge in the first slot and has no gate.
    """
    by = list(by)
    rule = SYSTEMS[system]
    base = votes.by_mean_confidence(records.where(F.col("role") == "proposer"), by).select(*by, F.col("answer").alias("plurality"))
    if not rule:
        own = records.groupBy(*by).agg(F.min_by(F.when(F.col("role") == "judge", F.col("answer")), F.when(F.col("role") == "judge", F.col("slot"))).alias("agreed"), F.lit(None).cast("boolean").alias("open"))
    else:
        checks = {role: same(role, n) for role, n in rule["all_of"].items()}
        agreed = [a for _, a in checks.values()]
        lists = [F.collect_set(F.when(F.col("role") == rule["any_of"], F.col("answer"))).alias("any")] if "any_of" in rule else []
        own = records.groupBy(*by).agg(*[c.alias(f"ok{i}") for i, (c, _) in enumerate(checks.values())], *[a.alias(f"a{i}") for i, a in enumerate(agreed)], *lists)
        gate = F.lit(True)
        for i in range(len(checks)):
            gate &= F.col(f"ok{i}") & F.coalesce(F.col(f"a{i}") == F.col("a0"), F.lit(False))
        if lists:
            gate &= F.coalesce(F.array_contains("any", F.col("a0")), F.lit(False))
        own = own.select(*by, F.col("a0").alias("agreed"), gate.alias("open"))
    both = own.join(base, by, "left")
    answer = F.when(F.col("open").isNull() | F.col("open"), F.col("agreed")).otherwise(F.col("plurality"))
    return both.select(*by, "plurality", answer.alias("answer"), F.col("open").alias("gate_open"), (~answer.eqNullSafe(F.col("plurality"))).alias("override"))


def decide_all(records: DataFrame, systems: Sequence[str] = tuple(SYSTEMS), by: Sequence[str] = ("case_id",)) -> DataFrame:
    """What decide() gives for several systems, with a column method: the records are aggregated once for all of them."""
    by = list(by)
    base = votes.by_mean_confidence(records.where(F.col("role") == "proposer"), by).select(*by, F.col("answer").alias("plurality"))
    own = lambda r: F.when(F.col("role") == r, F.col("answer"))
    facts = [x for r in ("critic", "verifier", "judge") for x in (F.count_if(F.col("role") == r).alias(f"n_{r}"), F.count_if(own(r).isNotNull()).alias(f"v_{r}"), F.min(own(r)).alias(f"lo_{r}"), F.max(own(r)).alias(f"hi_{r}"))]
    first = F.min_by(own("judge"), F.when(F.col("role") == "judge", F.col("slot"))).alias("first_judge")
    one = records.groupBy(*by).agg(*facts, first, F.collect_set(own("critic")).alias("any_critic"))
    rows = []
    for name in systems:
        rule = SYSTEMS[name]
        agreed, gate = F.col("first_judge"), F.lit(None).cast("boolean")
        if rule:
            roles = list(rule["all_of"])
            agreed, gate = F.col(f"lo_{roles[0]}"), F.lit(True)
            for r, n in rule["all_of"].items():
                gate &= (F.col(f"n_{r}") == n) & (F.col(f"v_{r}") == n) & F.coalesce((F.col(f"lo_{r}") == F.col(f"hi_{r}")) & (F.col(f"lo_{r}") == agreed), F.lit(False))
            if "any_of" in rule:
                gate &= F.coalesce(F.array_contains(f"any_{rule['any_of']}", agreed), F.lit(False))
        rows.append(F.struct(F.lit(name).alias("method"), agreed.alias("agreed"), gate.alias("gate_open")))
    long = one.join(base, by, "left").select(*by, "plurality", F.explode(F.array(*rows)).alias("x")).select(*by, "plurality", "x.*")
    answer = F.when(F.col("gate_open").isNull() | F.col("gate_open"), F.col("agreed")).otherwise(F.col("plurality"))
    return long.select("method", *by, "plurality", answer.alias("answer"), "gate_open", (~answer.eqNullSafe(F.col("plurality"))).alias("override"))


def agreement_gate(records: DataFrame, base_roles: Sequence[str], decision_roles: Sequence[str], min_agree: int, support_roles: Sequence[str], min_support: int, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """A declared gate: the decision roles' plurality replaces the base roles' if enough of them and enough supporters share it."""
    by = list(by)
    base = votes.by_mean_confidence(records.where(F.col("role").isin(*base_roles)), by).select(*by, F.col("answer").alias("plurality"))
    wanted = votes.by_mean_confidence(records.where(F.col("role").isin(*decision_roles)), by).select(*by, F.col("answer").alias("wanted"), F.col("votes").alias("agree"))
    support = records.where(F.col("role").isin(*support_roles)).groupBy(*by, F.col("answer").alias("wanted")).agg(F.count("*").alias("support"))
    cases = records.select(*by).distinct()
    both = cases.join(base, by, "left").join(wanted, by, "left").join(support, [*by, "wanted"], "left")
    is_open = F.col("wanted").isNotNull() & (F.coalesce("agree", F.lit(0)) >= min_agree) & (F.coalesce("support", F.lit(0)) >= min_support)
    return both.select(*by, F.when(is_open, F.col("wanted")).otherwise(F.col("plurality")).alias("answer"), is_open.alias("gate_open"), F.coalesce("agree", F.lit(0)).alias("agree"), F.coalesce("support", F.lit(0)).alias("support"))


def overrides(decided: DataFrame, truth: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """override, useful (wrong before, right after) and harmful (right before, wrong after) per case; null is never right."""
    both = decided.join(truth.select(*by, "truth"), list(by))
    right = lambda c: F.coalesce(F.col(c) == F.col("truth"), F.lit(False))
    return both.select(*by, "override", (~right("plurality") & right("answer")).alias("useful"), (right("plurality") & ~right("answer")).alias("harmful"))


def survivors(predictions: DataFrame) -> DataFrame:
    """Predictions whose first terms equal what was held out, with the terms after them as the answer."""
    h = F.col("holdout_terms")
    kept = predictions.where(F.slice("answer", F.lit(1), h) == F.col("visible_holdout"))
    return kept.withColumn("answer", F.slice("answer", h + 1, F.greatest(F.size("answer") - h, F.lit(0))))


def holdout_policy(alive: DataFrame, base: DataFrame, policy: str, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """The survivors' answer under a policy, the base answer where the policy gives none.

    any: plurality of all; longest: of those with the case's longest holdout; weighted: by holdout length; two: only answers
    of two survivors or more; horizons: only answers verified at both 2 and 3 terms.
    """
    by = list(by)
    if policy == "longest":
        longest = alive.groupBy(*by).agg(F.max("holdout_terms").alias("longest"))
        won = votes.by_mean_confidence(alive.join(longest, by).where("holdout_terms = longest"), by)
    elif policy == "weighted":
        won = votes.by_weight(alive, F.col("holdout_terms").cast("long"), by)
    else:
        won = votes.by_mean_confidence(alive, by)
        if policy == "two":
            won = won.where("votes >= 2")
        if policy == "horizons":
            deep = alive.groupBy(*by, "answer").agg(F.array_sort(F.collect_set("holdout_terms")).alias("h")).where(F.array_contains("h", 2) & F.array_contains("h", 3))
            won = won.join(deep.select(*by, "answer"), [*by, "answer"], "left_semi")
    won = won.select(*by, F.col("answer").alias("won"))
    return base.join(won, by, "left").select(*by, F.coalesce("won", "answer").alias("answer"), F.col("won").isNotNull().alias("verified"))


def oracle(candidates: DataFrame, truth: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Whether any candidate is right."""
    both = truth.select(*by, "truth").join(candidates, list(by), "left")
    return both.groupBy(*by).agg(F.bool_or(F.coalesce(F.col("answer") == F.col("truth"), F.lit(False))).alias("reachable"))


def linear_choice(candidates: DataFrame, weights: Sequence[int], features: str = "features", by: Sequence[str] = ("case_id",)) -> DataFrame:
    """The candidate with the largest weighted sum of its features, then the smallest answer."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    score = F.round(F.aggregate(F.zip_with(w, F.col(features), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 9)
    scored = candidates.withColumn("score", score)
    best = scored.groupBy(*by).agg(F.min_by(F.struct("answer", "score"), F.struct(-F.col("score"), F.col("answer"))).alias("x"))
    return best.select(*by, "x.answer", "x.score")
