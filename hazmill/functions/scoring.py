"""Risk scores as exact column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazmill.functions.taxonomy import CLAUSE_WEIGHTS

# Tier scores, component weights, scales and thresholds.
SEVERITY_SCORES = {"CRITICAL": 9.5, "HIGH": 7.5, "MEDIUM": 5.0, "LOW": 2.5, "UNKNOWN": 4.0}
WEIGHTS = {"Severity": 0.30, "Frequency": 0.25, "Regulatory": 0.25, "Precursor Density": 0.20}
FREQUENCY_SCALE, REGULATORY_SCALE, DEFAULT_WEIGHT = 25.0, 1.2, 1.0
TIER_FLOORS = [(8.0, "CRITICAL"), (6.0, "HIGH"), (4.0, "MEDIUM")]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows and new columns that are worked out once for a row, however often later ones name them: the optimizer copies nothing past a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def py_round2(x: Column) -> Column:
    """x >= 0 rounded to two places by its exact binary value, half to even.

    The product x * 100 is taken with its error, so that ties are real ties.
    """


    def body(x: Column) -> Column:
        c = x * F.lit(134217729.0)
        hi = c - (c - x)
        lo = x - hi
        p = x * F.lit(100.0)
        e = (hi * F.lit(100.0) - p) + lo * F.lit(100.0)
        fl = F.floor(p).cast("double")
        fr = p - fl
        up = (fr > 0.5) | ((fr == 0.5) & ((e > 0) | ((e == 0) & (fl % 2 == 1))))
        return (fl + up.cast("double")) / F.lit(100.0)

    return let(x, body)


def severity_score(tier: Column) -> Column:
    out = F.lit(SEVERITY_SCORES["UNKNOWN"])
    for name, score in SEVERITY_SCORES.items():
        out = F.when(tier == name, F.lit(score)).otherwise(out)
    return out


def frequency_score(similar: Column, corpus: Column) -> Column:
    return F.least(similar / F.greatest(corpus, F.lit(1)) * F.lit(FREQUENCY_SCALE), F.lit(10.0))


def regulatory_score(families: Column) -> Column:
    """Of an array of violated families, repeats counted."""
    weights = F.create_map(*[F.lit(x) for kv in CLAUSE_WEIGHTS.items() for x in kv])
    total = F.aggregate(families, F.lit(0.0), lambda acc, f: acc + F.coalesce(F.try_element_at(weights, f), F.lit(DEFAULT_WEIGHT)))
    return F.least(total * F.lit(REGULATORY_SCALE), F.lit(10.0))


def precursor_score(found: Column, known: Column) -> Column:
    return F.least(found / F.greatest(known, F.lit(1)) * F.lit(10.0), F.lit(10.0))


def tier_for(total: Column) -> Column:
    out = F.lit("LOW")
    for floor, name in reversed(TIER_FLOORS):
        out = F.when(total >= floor, F.lit(name)).otherwise(out)
    return out


def risk_score(tier: Column, similar: Column, corpus: Column, families: Column, found: Column, known: Column) -> Column:
    """Struct of total, tier, components and explanation; parts are rounded before they are weighed."""
    scores = F.struct(
        py_round2(severity_score(tier)).alias("s"),
        py_round2(frequency_score(similar, corpus)).alias("f"),
        py_round2(regulatory_score(families)).alias("r"),
        py_round2(precursor_score(found, known)).alias("p"),
    )
    reasons = [
        F.concat(F.lit("Classified "), tier, F.lit(" from the report outcome.")),
        F.concat(similar.cast("string"), F.lit(" of "), corpus.cast("string"), F.lit(" indexed historical documents matched.")),
        F.concat(F.size(families).cast("string"), F.lit(" regulation families implicated: "), F.when(F.size(families) > 0, F.array_join(families, ", ")).otherwise("none"), F.lit(".")),
        F.concat(found.cast("string"), F.lit(" of "), known.cast("string"), F.lit(" known precursors for this hazard type are present.")),
    ]

    def whole(x: Column) -> Column:
        total = py_round2(F.lit(0.30) * x["s"] + F.lit(0.25) * x["f"] + F.lit(0.25) * x["r"] + F.lit(0.20) * x["p"])
        return let(F.struct(total.alias("total"), x.alias("x")), told)

    def told(y: Column) -> Column:
        total, x = y["total"], y["x"]
        named = list(zip(WEIGHTS.items(), "sfrp", reasons, strict=True))
        components = F.array(*[F.struct(F.lit(n).alias("name"), x[k].alias("score"), F.lit(w).alias("weight"), why.alias("explanation")) for (n, w), k, why in named])
        shown = F.concat_ws(" ", *[F.concat(F.lit(f"{n} "), x[k].cast("string"), F.lit(f"x{w}.")) for (n, w), k, _ in named])
        why = F.concat(F.lit("Risk "), total.cast("string"), F.lit("/10 ("), tier_for(total), F.lit("). "), shown)
        return F.struct(total.alias("total"), tier_for(total).alias("tier"), components.alias("components"), why.alias("explanation"))

    return let(scores, whole)


def unscored() -> Column:
    """What stands for a score when an analysis failed before it."""
    component = lambda n: F.struct(F.lit(n).alias("name"), F.lit(0.0).alias("score"), F.lit(WEIGHTS[n]).alias("weight"), F.lit("Not computed - analysis failed.").alias("explanation"))
    return F.struct(
        F.lit(0.0).alias("total"),
        F.lit("UNKNOWN").alias("tier"),
        F.array(*[component(n) for n in WEIGHTS]).alias("components"),
        F.lit("Risk score unavailable: the pipeline did not reach the scoring stage.").alias("explanation"),
    )


def reconciles(score: Column, slack: float = 0.01) -> Column:
    """Whether a score's total is what its components say."""
    total = F.aggregate(score["components"], F.lit(0.0), lambda acc, c: acc + c["score"] * c["weight"])
    return F.abs(score["total"] - total) <= slack
