"""Golden cases of scores, labels and precursors."""

import random

import pytest
from pyspark.sql import functions as F

from hazmill.functions import labels as L
from hazmill.functions import scoring as S
from hazmill.operators import precursors as P
from hazmill.operators import reports as A
from hazmill.operators import retrieval as R


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def risk(spark, tier, similar, corpus, families, found, known):
    arr = F.array(*map(F.lit, families)) if families else F.array().cast("array<string>")
    return value(spark, S.risk_score(F.lit(tier), F.lit(similar), F.lit(corpus), arr, F.lit(found), F.lit(known)))


def test_risk_scores(spark):
    r = risk(spark, "CRITICAL", 4, 80, ["lockout_tagout"], 2, 10)
    assert (r["total"], r["tier"]) == (4.10, "MEDIUM")
    r = risk(spark, "CRITICAL", 50, 50, ["general_duty_clause"] * 20, 99, 1)
    assert r["tier"] == "CRITICAL" and all(c["score"] <= 10 for c in r["components"])
    r = risk(spark, "UNKNOWN", 0, 0, [], 0, 0)
    assert (r["total"], r["tier"]) == (1.2, "LOW")
    assert r["components"][2]["explanation"] == "0 regulation families implicated: none."


def test_round2_is_pythons(spark):
    rng = random.Random(3)
    xs = [rng.randrange(0, 100_000) / 1000 for _ in range(3000)] + [2.675, 0.125, 0.375, 1.005, 0.0, 10.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert all(r[1] == round(r[0], 2) for r in df.select("x", S.py_round2(F.col("x"))).collect())


@pytest.mark.parametrize("total,tier", [(9.9, "CRITICAL"), (8.0, "CRITICAL"), (7.99, "HIGH"), (6.0, "HIGH"), (4.0, "MEDIUM"), (3.99, "LOW")])
def test_tiers(spark, total, tier):
    assert value(spark, S.tier_for(F.lit(total))) == tier


def test_severity(spark):
    cases = [
        ("The operator died at the scene.", "CRITICAL"),
        ("Finger amputation followed.", "HIGH"),
        ("He had a laceration.", "MEDIUM"),
        ("It was a near miss.", "LOW"),
        ("No fatalities occurred.", "LOW"),
        ("There were no injuries or fatalities.", "LOW"),
        ("No fatalities, but one worker was hospitalized.", "HIGH"),
        ("No injuries were reported; later he was pronounced dead.", "CRITICAL"),
        ("The meeting went well.", "UNKNOWN"),
    ]
    df = spark.createDataFrame(cases, "t string, want string").select("want", L.classify_severity(F.col("t")).alias("got"))
    assert [r.got for r in df.collect()] == [w for _, w in cases]
    assert value(spark, L.classify_severity(F.lit("nothing"), F.lit(3), F.lit(0))) == "HIGH"


def test_hazard_and_industry(spark):
    assert value(spark, L.detect_hazard_type(F.lit("The atmosphere was not tested and no attendant was posted"))) == "confined_space"
    assert value(spark, L.detect_hazard_type(F.lit("sunny day"))) == "general"
    assert value(spark, L.detect_industry(F.lit("determined pressure " * 9))) == "unknown"
    assert value(spark, L.detect_industry(F.lit("chemical " * 20))) == "chemical"
    assert value(spark, L.detect_industry(F.lit("chemical " * 5 + "warehouse " * 5))) == "unknown"


def test_rank_confidence_and_routes(spark):
    got = [r[0] for r in spark.range(7).select(R.rank_confidence(F.col("id"))).collect()]
    assert got == [0.9, 0.78, 0.66, 0.54, 0.42, 0.3, 0.18]
    assert value(spark, A.route(F.lit(8.0))) == "priority"
    assert value(spark, A.route(F.lit(None).cast("double"))) == "standard"
    assert value(spark, A.route(F.lit(9.0), F.lit("broken"))) == "error"


def test_general_reports_have_general_patterns_twice(spark):
    df = spark.createDataFrame([(1, "the worker was not trained", "general"), (2, "did not verify; not trained", "lockout_tagout")], "analysis_id long, text string, hazard_type string")
    got = P.match_precursors(df).groupBy("analysis_id").count().orderBy("analysis_id").collect()
    assert [r["count"] for r in got] == [2, 2]
    assert value(spark, P.known_precursor_count(F.lit("general"))) == 10


def test_actions(spark):
    df = spark.createDataFrame([(1, "lockout_tagout"), (2, "no such family")], "analysis_id long, hazard_type string")
    rows = A.corrective_actions(df, A.action_table(spark)).orderBy("analysis_id", "place").collect()
    for i, n in ((1, 9), (2, 5)):
        own = [r["urgency"] for r in rows if r["analysis_id"] == i]
        assert len(own) == n and own == sorted(own, key=["IMMEDIATE", "SHORT_TERM", "LONG_TERM"].index)
