"""What the stored analyses say together: pages, dashboards, registers of alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazmill.functions import taxonomy as X

MAX_PAGE, LATEST, SHOWN, BAR_FLOOR = 100, 8, 5, 8


def list_analyses(analyses: DataFrame, page: int = 1, limit: int = 20, severity: str | None = None, industry: str | None = None) -> DataFrame:
    """One page of the complete analyses, newest first, with the total in each row."""
    page, limit = max(page, 1), min(max(limit, 1), MAX_PAGE)
    rows = analyses.where("status = 'complete'")
    if severity:
        rows = rows.where(F.col("severity") == severity)
    if industry:
        rows = rows.where(F.col("industry") == industry)
    total = rows.count()
    return rows.orderBy(F.desc("created_at"), "id").offset((page - 1) * limit).limit(limit).withColumn("total", F.lit(total).cast("long"))


def all_history(analyses: DataFrame) -> DataFrame:
    return analyses.where("status = 'complete'").orderBy(F.desc("created_at"), "id")


def dashboard_stats(analyses: DataFrame) -> DataFrame:
    """total, critical, average_risk (0 if there is none), industries."""
    return analyses.where("status = 'complete'").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.round(F.coalesce(F.avg("risk_total"), F.lit(0.0)), 2).alias("average_risk"),
        F.countDistinct("industry").alias("industries"),
    )


def severity_histogram(analyses: DataFrame) -> DataFrame:
    """severity, n for all tiers, those without analyses too."""
    spark: SparkSession = analyses.sparkSession
    tiers = spark.createDataFrame([(t, i) for i, t in enumerate(X.TIERS)], "severity string, place int")
    counts = analyses.groupBy("severity").agg(F.count("*").alias("n"))
    return F.broadcast(tiers).join(counts, "severity", "left").select("severity", "place", F.coalesce("n", F.lit(0)).alias("n"))


def industry_counts(analyses: DataFrame) -> DataFrame:
    """industry, n, bar: the bar is the share of the largest in percent, at least the floor."""
    named = F.coalesce(F.when(F.col("industry") != "", F.col("industry")), F.lit("Unspecified"))
    counts = analyses.groupBy(named.alias("industry")).agg(F.count("*").alias("n"))
    return counts.withColumn("bar", F.greatest(F.round(100 * F.col("n") / F.max("n").over(Window.partitionBy())), F.lit(float(BAR_FLOOR))))


def alert_register(reports: DataFrame, severity: str | None = None) -> DataFrame:
    """Every alert of every report with its analysis (id, created_at), newest first; an alert's own id is alert_id."""
    fields = [f.name for f in reports.schema["alerts"].dataType.elementType if f.name != "created_at"]
    own = [F.col(f"alert.{f}").alias("alert_id" if f == "id" else f) for f in fields]
    rows = reports.select("id", "created_at", F.posexplode("alerts").alias("place", "alert")).select("id", "created_at", "place", *own)
    if severity:
        rows = rows.where(F.col("severity") == severity)
    return rows.orderBy(F.desc("created_at"), "id", "place")


def recent_alerts(reports: DataFrame, latest: int = LATEST, shown: int = SHOWN) -> DataFrame:
    """The newest alerts among those of the latest analyses."""
    return alert_register(reports.orderBy(F.desc("created_at"), "id").limit(latest)).limit(shown)


def industry_filter_values(analyses: DataFrame, latest: int = MAX_PAGE) -> DataFrame:
    return analyses.orderBy(F.desc("created_at"), "id").limit(latest).where("coalesce(industry, '') <> ''").select("industry").distinct().orderBy("industry")
