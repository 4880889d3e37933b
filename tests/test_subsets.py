"""Votes of sets of members: against the table of all parts, and against plain loops for forty members."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quorate.operators import evolution
from quorate.plans import searches
from quorate.plans.fixtures import panel, truth

DATA = "/root/testdata/sf0.001"
VOTES = "case_id int, member int, answer array<string>, confidence decimal(12,4)"
TRUTH = "case_id int, truth array<string>, block string"


def test_sets_equal_the_table_of_parts(spark):
    votes = panel(spark, DATA).select("case_id", (F.col("l_suppkey") % 8).alias("member"), "answer", "confidence")
    t, sets = truth(spark, DATA), evolution.subsets(spark, 8)
    want = evolution.subset_scores(evolution.submask_votes(votes, t), sets)
    got = evolution.set_scores(votes, t, sets)
    rows = lambda df: {(r.subset, r.size, r.block): (r.exact, r.terms) for r in df.collect() if r.exact or r.terms}
    assert rows(got) == rows(want) and len(rows(got)) > 500


def plain(votes, truths, mask):
    out = defaultdict(lambda: [0, 0])
    by = defaultdict(lambda: defaultdict(list))
    for case, member, answer, c in votes:
        if answer is not None and mask >> member & 1:
            by[case][tuple(answer)].append(c)
    for case, answers in by.items():
        best = min((-len(c), -float(sum(c)) / len(c), a) for a, c in answers.items())[2]
        right, block = truths[case]
        out[block][0] += list(best) == right
        out[block][1] += sum(a == b for a, b in zip(best, right, strict=True))
    return out


def test_forty_members(spark):
    rng = random.Random(11)
    truths = {c: ([str(rng.randrange(3)), str(rng.randrange(3))], "ab"[c % 2]) for c in range(60)}
    votes = [(c, m, None if rng.random() < 0.1 else [str(rng.randrange(3)), str(rng.randrange(3))], Decimal(rng.randrange(0, 10)) / 10) for c in truths for m in rng.sample(range(40), rng.choice([1, 3, 14, 30]))]
    votes += votes[:20]  # a member may vote twice
    sets = evolution.drawn_sets(spark, 40, most=300, seed="t")
    got = evolution.set_scores(spark.createDataFrame(votes, VOTES), spark.createDataFrame([(c, *x) for c, x in truths.items()], TRUTH), sets).collect()
    masks = [r.subset for r in sets.collect()]
    assert len(masks) == len(set(masks)) == 300 and all(m.bit_count() >= 3 for m in masks)
    seen = {(r.subset, r.block): [r.exact, r.terms] for r in got}
    for m in masks:
        want = plain(votes, truths, m)
        assert all(seen.get((m, b), [0, 0]) == want[b] for b in "ab"), m


def test_no_voter_is_dropped(spark):
    one = spark.createDataFrame([(0, 0, ["1"], Decimal(1)), (0, 13, ["2"], Decimal(1)), (0, 14, ["2"], Decimal(1))], VOTES)
    t = spark.createDataFrame([(0, ["2"], "a")], TRUTH)
    with pytest.raises(ValueError, match="0 to 11"):
        evolution.submask_votes(one, t)
    sets = spark.createDataFrame([((1 << 0) | (1 << 13) | (1 << 14), 3)], "subset long, size int")
    assert evolution.set_scores(one, t, sets).first().exact == 1
    with pytest.raises(ValueError, match="0 to 51"):
        evolution.set_scores(one.withColumn("member", F.lit(52)), t, sets)


def test_query_of_forty_lenses(spark):
    got = searches.agg23_forty(spark, DATA)
    assert got.count() == 25_000 and got.where("exact < 0 or weakest_block > exact").count() == 0
