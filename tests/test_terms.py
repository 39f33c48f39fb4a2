"""One pass over a text against a search for each term."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazmill.functions import taxonomy as X
from hazmill.functions.labels import pattern_terms
from hazmill.functions.terms import Terms
from hazmill.operators import precursors as P


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200])
def test_every_term_is_found(spark, n):
    rng = np.random.default_rng(n)
    word = lambda size: "".join(rng.choice(list("abé "), size))
    terms = list(dict.fromkeys(word(int(rng.integers(1, 6))) for _ in range(4 * n)))[:n]
    texts = [word(int(rng.integers(0, 60))) for _ in range(60)] * 2 + ["", None, "x" * 100_000 + terms[-1]]
    known = Terms(terms)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("b", known.bits(F.col("t")))
    some = terms[::2]
    for r in df.select("t", known.any("b", some).alias("any"), known.count("b", some).alias("n"), F.array(*[known.any("b", [x]) for x in terms]).alias("each")).collect():
        if r["t"] is None:
            assert r["any"] is None and r["n"] is None
        else:
            assert r["each"] == [x in r["t"] for x in terms] and r["n"] == sum(x in r["t"] for x in some) and r["any"] == (r["n"] > 0)


def test_no_terms_and_empty_ones(spark):
    none = Terms([])
    df = spark.createDataFrame([("a",), (None,)], "t string").withColumn("b", none.bits(F.col("t")))
    assert [(r[0], r[1]) for r in df.select(none.any("b", []), none.count("b", [])).collect()] == [(False, 0), (None, None)]
    with pytest.raises(ValueError):
        Terms(["a", ""])


def test_patterns_of_long_texts_and_in_one_pass(spark):
    keywords = [kw[0] for *_, kw in X.PRECURSORS]
    texts = [("filler " * 5000 + k.upper(),) for k in keywords] + [(None,)]
    df = spark.createDataFrame(texts, "text string")
    got = [r["h"] for r in df.select(P.pattern_hits(F.col("text")).alias("h")).collect()]
    for text, hits in zip(texts[:-1], got, strict=False):
        assert hits == [i for i, (*_, kw) in enumerate(X.PRECURSORS) if any(x in text[0].lower() for x in kw)]
    assert got[-1] == []
    plan = P.with_flags(df.withColumn("analysis_id", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Contains" not in plan and len(pattern_terms(X.PRECURSORS).terms) > 150
