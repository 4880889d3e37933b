"""All queries by name, each with its SQL or None."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.operators import scores, votes
from quorate.plans import generated as generated_plans
from quorate.plans import ranks as rank_plans
from quorate.plans import roundtrips as roundtrip_plans
from quorate.plans import scores as score_plans
from quorate.plans import searches as search_plans
from quorate.plans import stats as stat_plans
from quorate.plans import texts as text_plans
from quorate.plans import votes as vote_plans
from quorate.plans.fixtures import panel, truth

QUERIES = vote_plans.QUERIES | score_plans.QUERIES | stat_plans.QUERIES | rank_plans.QUERIES | text_plans.QUERIES | search_plans.QUERIES | generated_plans.QUERIES | roundtrip_plans.QUERIES


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Exact rate by block of the plurality by count, mean confidence and answer."""
    won = votes.by_mean_confidence(panel(spark, d))
    return scores.summary(scores.score_records(won, truth(spark, d)), ["block"])
