"""Precursor patterns of reports and how history bears them out."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazmill.functions import taxonomy as X
from hazmill.functions.labels import best_family, pattern_terms


def precursor_table(spark: SparkSession, precursors: list | None = None) -> DataFrame:
    """family, pattern_order, pattern_name, description, keywords: one short row for each pattern."""
    rows = [(f, i, n, d, kw) for i, (f, n, d, kw) in enumerate(precursors or X.PRECURSORS)]
    return spark.createDataFrame(rows, "family string, pattern_order int, pattern_name string, description string, keywords array<string>")


def pattern_hits(text: Column, precursors: list | None = None) -> Column:
    """Array of pattern orders whose keywords the text has, from one pass over it; texts are not multiplied by patterns."""
    table = precursors or X.PRECURSORS
    terms = pattern_terms(table)
    found = terms.bits(F.lower(text))
    return F.array_compact(F.array(*[F.when(terms.any(found, kw), F.lit(i)) for i, (*_, kw) in enumerate(table)]))


def with_flags(reports: DataFrame, precursors: list | None = None, text: str = "text") -> DataFrame:
    """reports with pattern_flags: for each pattern whether the text has a keyword of it. Made once, it serves families, matches and counts."""
    table = precursors or X.PRECURSORS
    terms = pattern_terms(table)
    found = terms.bits(F.lower(F.col(text)))
    return reports.withColumn("pattern_flags", F.array(*[F.coalesce(terms.any(found, kw), F.lit(False)) for *_, kw in table]))


def flagged_family(flags: Column, precursors: list | None = None) -> Column:
    """As detect_hazard_type."""
    table = precursors or X.PRECURSORS
    return best_family([flags[i] for i in range(len(table))], table)


def flagged_count(flags: Column, hazard: Column, precursors: list | None = None) -> Column:
    """How many rows match_precursors has for the report."""
    table = precursors or X.PRECURSORS
    sizes = {f: sum((flags[i].cast("int") for i, (g, *_) in enumerate(table) if g == f), F.lit(0)) for f in dict.fromkeys(f for f, *_ in table)}
    own = F.lit(0)
    for f, n in sizes.items():
        own = F.when(hazard == f, n).otherwise(own)
    return own + sizes.get("general", F.lit(0))


def match_precursors(reports: DataFrame, precursors: list | None = None) -> DataFrame:
    """analysis_id, part, pattern_order, family, pattern_name, description: patterns of the report's family, then general ones.

    A report of the general family has each general pattern twice, once as its
    family's and once as general, as the count of known patterns has. One scan:
    a report's matches are one array.
    """
    table = precursors or X.PRECURSORS
    flagged = reports if "pattern_flags" in reports.columns else with_flags(reports, table)
    match = lambda part, i: F.struct(F.lit(part).alias("part"), F.lit(i).alias("pattern_order"), *[F.lit(v).alias(c) for c, v in zip(("family", "pattern_name", "description"), table[i][:3], strict=True)])
    own = [F.when(F.col("pattern_flags")[i] & (F.col("hazard_type") == f), match(0, i)) for i, (f, *_) in enumerate(table)]
    general = [F.when(F.col("pattern_flags")[i], match(1, i)) for i, (f, *_) in enumerate(table) if f == "general"]
    return flagged.select("analysis_id", F.explode(F.array_compact(F.array(*own, *general))).alias("m")).select("analysis_id", "m.*")


def corroborate(matches: DataFrame, excerpts: DataFrame, precursors: list | None = None) -> DataFrame:
    """matches with evidence_count, confidence and place; excerpts are (analysis_id, excerpt)."""
    shown = excerpts.select("analysis_id", F.explode(pattern_hits(F.col("excerpt"), precursors)).alias("pattern_order"))
    evidence = shown.groupBy("analysis_id", "pattern_order").agg(F.count("*").cast("int").alias("evidence_count"))
    both = matches.join(evidence, ["analysis_id", "pattern_order"], "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
    order = Window.partitionBy("analysis_id").orderBy(F.desc("evidence_count"), "part", "pattern_order")
    return both.withColumn("confidence", F.least(F.lit(0.55) + F.lit(0.1) * F.col("evidence_count"), F.lit(0.95))).withColumn("place", F.row_number().over(order) - 1)


def corroborated(flags: Column, hazard: Column, evidence: Column, precursors: list | None = None) -> Column:
    """The rows of corroborate(match_precursors) of one report as an array in order; evidence: the pattern orders that its excerpts show, repeats counted."""
    table = precursors or X.PRECURSORS
    of = lambda part, i: F.struct(F.lit(part).alias("part"), F.lit(i).alias("pattern_order"))
    own = [F.when(flags[i] & (hazard == f), of(0, i)) for i, (f, *_) in enumerate(table)]
    general = [F.when(flags[i], of(1, i)) for i, (f, *_) in enumerate(table) if f == "general"]
    count = lambda m: F.size(F.filter(evidence, lambda e: e == m["pattern_order"]))
    ordered = F.array_sort(F.transform(F.array_compact(F.array(*own, *general)), lambda m: F.struct((-count(m)).alias("less"), m["part"].alias("part"), m["pattern_order"].alias("pattern_order"))))
    names, told = (F.array(*[F.lit(row[k]) for row in table]) for k in (1, 2))

    def shown(m: Column, i: Column) -> Column:
        confidence = F.least(F.lit(0.55) + F.lit(0.1) * -m["less"], F.lit(0.95))
        return F.struct(i.alias("place"), F.get(names, m["pattern_order"]).alias("pattern_name"), F.get(told, m["pattern_order"]).alias("description"), confidence.alias("confidence"), (-m["less"]).alias("evidence_count"))

    return F.transform(ordered, shown)


def known_precursor_count(hazard: Column, precursors: list | None = None) -> Column:
    """Patterns of the family and of the general one."""
    sizes: dict[str, int] = {}
    for f, *_ in precursors or X.PRECURSORS:
        sizes[f] = sizes.get(f, 0) + 1
    own = F.lit(0)
    for f, n in sizes.items():
        own = F.when(hazard == f, F.lit(n)).otherwise(own)
    return own + F.lit(sizes.get("general", 0))


def pattern_prevalence(reports: DataFrame, precursors: list | None = None) -> DataFrame:
    """Reports that show each pattern, by industry and over all (industry null), and their share."""
    hits = reports.select("industry", F.explode(pattern_hits(F.col("text"), precursors)).alias("pattern_order"))
    by = hits.rollup("pattern_order", "industry").agg(F.count("*").alias("n_reports"), F.grouping_id().alias("level")).where("pattern_order is not null")
    total = reports.rollup("industry").agg(F.count("*").alias("of_reports"), F.grouping("industry").alias("all"))
    level = F.when(F.col("level") == 1, 1).otherwise(0)
    joined = by.join(total, (level == total["all"]) & by["industry"].eqNullSafe(total["industry"]))
    return joined.select("pattern_order", by["industry"], "n_reports", (F.col("n_reports") / F.col("of_reports")).alias("share"), level.alias("over_all"))


def _levels(rows: DataFrame, precursors: list | None, name: str) -> DataFrame:
    """pattern_order, industry, hazard_type, by_industry, by_hazard, n_<name>, of_<name>: for each level the rows with a pattern, and all of its rows."""
    keys = ["industry", "hazard_type"]
    sets = [[], ["industry"], ["hazard_type"], keys]
    level = [(1 - F.grouping("industry")).cast("int").alias("by_industry"), (1 - F.grouping("hazard_type")).cast("int").alias("by_hazard")]
    flagged = rows.select(*keys, F.explode(F.concat(pattern_hits(F.col("text"), precursors), F.array(F.lit(-1)))).alias("pattern_order"))  # -1: every row
    # a row for each pattern of a text, summed before it is sent
    counted = flagged.groupBy("pattern_order", *keys).agg(F.count("*").alias("n"))
    counted = counted.groupingSets([["pattern_order", *s] for s in sets], "pattern_order", *keys).agg(F.sum("n").alias("n"), *level)
    on = ["by_industry", "by_hazard"]
    total = counted.where("pattern_order = -1").select(F.col("n").alias(f"of_{name}"), *[F.col(c).alias(f"t_{c}") for c in [*keys, *on]])
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in [*keys, *on]]
    found = counted.where("pattern_order >= 0").join(total, functools.reduce(operator.and_, same))
    return found.select("pattern_order", *keys, *on, F.col("n").alias(f"n_{name}"), f"of_{name}")


def prevalence_levels(reports: DataFrame, corpus: DataFrame, precursors: list | None = None) -> DataFrame:
    """How often each pattern is seen in reports and in a corpus, over all, by industry, by hazard_type and by both, and the lift.

    reports and corpus have industry, hazard_type and text. A null industry is a
    group of its own; by_industry and by_hazard say what a row is about. A group
    without the pattern on one side has 0 of none there and no lift; lift is the
    reports' share over the corpus's.
    """
    one, other = _levels(reports, precursors, "reports"), _levels(corpus, precursors, "corpus")
    keys = ["pattern_order", "by_industry", "by_hazard", "industry", "hazard_type"]
    two = other.select(*[F.col(c).alias(f"c_{c}") for c in keys], "n_corpus", "of_corpus")
    both = one.join(two, functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in keys]), "full")
    both = both.select(*[F.when(F.col("n_reports").isNotNull(), F.col(c)).otherwise(F.col(f"c_{c}")).alias(c) for c in keys], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_reports", "of_reports", "n_corpus", "of_corpus")])
    share, base = F.col("n_reports") / F.nullif(F.col("of_reports"), F.lit(0)), F.col("n_corpus") / F.nullif(F.col("of_corpus"), F.lit(0))
    return both.withColumns({"share": share, "corpus_share": base, "lift": share / base})
