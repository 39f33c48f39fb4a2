"""Stored analyses by time, newest first, a page at a time from where the last one ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.operators.history import MAX_PAGE

#: Microseconds of a folder, and the folder of rows without a time.
PERIOD, UNTIMED = 30 * 86_400 * 1_000_000, -(2**31)


def _micros() -> Column:
    return F.unix_micros(F.col("created_at").cast("timestamp"))


def append(rows: DataFrame, path: str) -> None:
    """Adds rows (id, created_at, ...) in folders of thirty days, whatever the session's time zone; within a folder files are ranges of time."""
    period = F.coalesce(F.floor(_micros() / F.lit(PERIOD)), F.lit(UNTIMED)).cast("long")
    laid = rows.withColumn("period", period)
    laid.repartitionByRange("period", "created_at", "id").sortWithinPartitions("period", F.desc("created_at"), "id").write.mode("append").partitionBy("period").parquet(path)


def periods(spark: SparkSession, path: str) -> list[int]:
    """The folders, newest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((int(n.split("=")[1]) for n in names if n.startswith("period=")), reverse=True)


def page(spark: SparkSession, path: str, after: tuple[int | None, int] | None = None, limit: int = 20, severity: str | None = None, industry: str | None = None) -> tuple[DataFrame | None, tuple[int | None, int] | None]:
    """(rows, where they end) of the complete analyses that come after a place; the place is the microseconds and the id of the last row seen.

    Order: newest first, then by id; rows without a time last. Only the folders
    from the place on are read, twice as many each time until the page is full,
    so the n-th page costs what the first does, and an analysis that comes in
    meanwhile moves nothing. The end is None after the last page; the rows are
    None if there is no folder. Rows of one time and id are one place: those that
    a full page leaves out are not seen again.
    """
    limit = min(max(limit, 1), MAX_PAGE)
    folders = periods(spark, path)
    if after is not None:
        first = UNTIMED if after[0] is None else after[0] // PERIOD
        folders = [f for f in folders if f <= first]
    take = 1
    while folders:
        rows = spark.read.option("basePath", path).parquet(*[f"{path}/period={f}" for f in folders[:take]]).where("status = 'complete'").drop("period")
        if after is not None:
            rows = rows.where(_later(*after))
        for name, value in (("severity", severity), ("industry", industry)):
            if value:
                rows = rows.where(F.col(name) == value)
        found = rows.orderBy(F.desc_nulls_last("created_at"), "id").limit(limit)
        # at most a page
        ends = found.select(_micros().alias("at"), "id").collect()
        if len(ends) == limit or take >= len(folders):
            return found, ((ends[-1]["at"], ends[-1]["id"]) if len(ends) == limit else None)
        take *= 2
    return None, None


def _later(micros: int | None, last: int) -> Column:
    if micros is None:
        return F.col("created_at").isNull() & (F.col("id") > last)
    at = F.timestamp_micros(F.lit(micros))
    created = F.col("created_at").cast("timestamp")
    return created.isNull() | (created < at) | ((created == at) & (F.col("id") > last))
