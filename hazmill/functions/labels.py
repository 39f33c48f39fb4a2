"""Labels of a text as column expressions: class, severity, hazard family, industry, warnings."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazmill.functions import taxonomy as X
from hazmill.functions.scoring import let
from hazmill.functions.terms import Terms
from hazmill.functions.text import word_count

# The pattern of negated outcomes.
_OUTCOME = r"(?:fatalit\w*|fatal\w*|death\w*|died|injur\w*|casualt\w*|harm)"
NEGATED = rf"\b(?:no|zero|without|nor)\s+(?:reported\s+|known\s+|serious\s+|other\s+)?{_OUTCOME}(?:\s*(?:,|or|and|nor)\s*{_OUTCOME})*"
MULTI_INJURY, CLASS_MARGIN, MIN_INDUSTRY, INDUSTRY_MARGIN, FEW_WORDS = 3, 2, 5, 1.5, 100


SEVERE = Terms(X.CRITICAL_TERMS, X.HIGH_TERMS, X.MEDIUM_TERMS)
MILD = Terms(X.LOW_TERMS)


def classify_document(text: Column, verdict: Column | None = None, incident: list[str] | None = None, regulatory: list[str] | None = None) -> Column:
    """'incident' or 'regulatory' by distinct terms of the first 20,000 characters; undecided texts take the verdict, if any."""
    one, other = incident or X.INCIDENT_TERMS, regulatory or X.REGULATORY_TERMS
    terms = Terms(one, other)
    found = terms.bits(F.lower(F.substring(text, 1, 20_000)))
    a, b = terms.count(found, one), terms.count(found, other)
    fallback = F.when(a >= b, "incident").otherwise("regulatory")
    if verdict is not None:
        fallback = F.coalesce(verdict, fallback)
    return F.when(F.abs(a - b) >= CLASS_MARGIN, F.when(a > b, "incident").otherwise("regulatory")).otherwise(fallback)


def classify_severity(text: Column, injuries: Column | None = None, fatalities: Column | None = None, verdict: Column | None = None) -> Column:
    """Tier by stated outcomes and counts; negated outcomes do not escalate but count for LOW; else the verdict or UNKNOWN."""
    n, d = (F.coalesce(c, F.lit(0)) if c is not None else F.lit(0) for c in (injuries, fatalities))
    undecided = F.coalesce(verdict, F.lit("UNKNOWN")) if verdict is not None else F.lit("UNKNOWN")
    lowered = F.regexp_replace(F.lower(text), r"\s+", " ")
    stated, whole = SEVERE.bits(F.regexp_replace(lowered, NEGATED, " ")), MILD.bits(lowered)
    return (
        F.when((d > 0) | SEVERE.any(stated, X.CRITICAL_TERMS), "CRITICAL")
        .when((n >= MULTI_INJURY) | SEVERE.any(stated, X.HIGH_TERMS), "HIGH")
        .when((n > 0) | SEVERE.any(stated, X.MEDIUM_TERMS), "MEDIUM")
        .when(MILD.any(whole, X.LOW_TERMS) | lowered.rlike(NEGATED), "LOW")
        .otherwise(undecided)
    )


def detect_hazard_type(text: Column, precursors: list | None = None) -> Column:
    """The family with most patterns in the text, the earlier on ties; 'general' if none."""
    table = precursors or X.PRECURSORS
    terms = pattern_terms(table)
    found = terms.bits(F.lower(text))
    return best_family([F.coalesce(terms.any(found, kw), F.lit(False)) for *_, kw in table], table)


def pattern_terms(precursors: list) -> Terms:
    return Terms(*[kw for *_, kw in precursors])


def best_family(flags: list[Column], table: list) -> Column:
    """The family with most of the flagged patterns, the earlier on ties; 'general' if none."""
    families = [f for f in dict.fromkeys(f for f, *_ in table) if f != "general"]
    score = {f: functools.reduce(operator.add, [flag.cast("int") for flag, (g, *_) in zip(flags, table, strict=True) if g == f], F.lit(0)) for f in families}
    best = F.greatest(F.struct(F.lit(0).alias("n"), F.lit(1).alias("o"), F.lit("general").alias("family")), *[F.struct(score[f].alias("n"), F.lit(-i).alias("o"), F.lit(f).alias("family")) for i, f in enumerate(families)])
    return best["family"]


def industry_counts(text: Column, industries: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Whole-word occurrences of each industry's terms."""
    table = industries or X.INDUSTRIES
    return {name: F.regexp_count(text, F.lit(r"(?i)\b(?:" + "|".join(re.escape(t).replace(r"\ ", " ") for t in terms) + r")\b")) for name, terms in table.items()}


def detect_industry(text: Column, industries: dict[str, list[str]] | None = None) -> Column:
    """The industry named at least five times and half as often again as the next; else 'unknown'."""
    counts = industry_counts(text, industries)
    ranked = F.sort_array(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, n) in enumerate(counts.items())]), asc=False)
    return let(ranked, lambda r: F.when((r[0]["n"] >= MIN_INDUSTRY) & (r[0]["n"] >= r[1]["n"] * INDUSTRY_MARGIN), r[0]["name"]).otherwise("unknown"))


def extraction_confidence(date: Column, location: Column, industry: Column, equipment: Column, narrative: Column, causes: Column, text: Column) -> Column:
    """Share of six fields that are filled, halved for texts of few words."""
    from hazmill.functions.scoring import py_round2

    filled = functools.reduce(operator.add, [(F.coalesce(c, F.lit("")) != "").cast("int") for c in (date, location, industry, narrative)] + [(F.coalesce(F.size(c), F.lit(0)) > 0).cast("int") for c in (equipment, causes)])
    return py_round2(filled / F.lit(6.0) * F.when(word_count(text) < FEW_WORDS, 0.5).otherwise(1.0))


def warnings(text: Column, document_type: Column, confidence: Column) -> Column:
    """Array of what makes the findings doubtful, in order; the wording is fixed."""
    n = word_count(text)
    percent = F.bround(confidence * 100).cast("int").cast("string")
    return F.array_compact(
        F.array(
            F.when(n < FEW_WORDS, F.concat(F.lit("Document is only "), n.cast("string"), F.lit(" words. Findings are low confidence."))),
            F.when(document_type != "incident", F.concat(F.lit("Document classified as '"), document_type, F.lit("'; results may be thin."))),
            F.when(confidence < 0.5, F.concat(F.lit("Only "), percent, F.lit("% of the incident schema could be filled from this document."))),
        )
    )


def incident_query(narrative: Column, causes: Column, equipment: Column, text: Column) -> Column:
    """What is searched for: narrative, causes and equipment, or the text's start."""
    parts = F.filter(F.flatten(F.array(F.array(F.coalesce(narrative, F.lit(""))), F.coalesce(causes, F.array().cast("array<string>")), F.coalesce(equipment, F.array().cast("array<string>")))), lambda p: p != "")
    joined = F.trim(F.array_join(parts, " "))
    return F.when(joined != "", joined).otherwise(F.substring(text, 1, 1000))


def regulatory_query(hazard: Column, narrative: Column, causes: Column, equipment: Column) -> Column:
    none = F.array().cast("array<string>")
    parts = F.concat(F.array(F.replace(hazard, F.lit("_"), F.lit(" ")), F.coalesce(narrative, F.lit(""))), F.coalesce(causes, none), F.coalesce(equipment, none))
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def hazard_text(text: Column, narrative: Column, causes: Column, roots: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.array(text, F.coalesce(narrative, F.lit(""))), F.coalesce(causes, none), F.coalesce(roots, none)), " ")
