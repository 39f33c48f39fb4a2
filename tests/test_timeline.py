"""Pages by place: those of an ordered list, from few files."""

from datetime import datetime, timedelta

from hazmill.sources import timeline as T

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, created_at timestamp, status string, severity string, industry string"


def test_pages_are_slices_of_the_list(spark, tmp_path):
    path = str(tmp_path / "t")
    assert T.page(spark, path) == (None, None) and T.periods(spark, path) == []
    rows = [(i, None if i % 17 == 0 else T0 + timedelta(days=7 * (i % 40)), "complete" if i % 5 else "processing", ["HIGH", "LOW"][i % 2], "mining") for i in range(200)]
    for k in range(2):
        T.append(spark.createDataFrame(rows[k::2], SCHEMA), path)
    for severity in (None, "HIGH"):
        want = [r for r in rows if r[2] == "complete" and severity in (None, r[3])]
        want = [r[0] for r in sorted(want, key=lambda r: (r[1] is None, -(r[1] or T0).timestamp(), r[0]))]
        got, after = [], None
        while True:
            found, after = T.page(spark, path, after, 23, severity, "mining")
            got += [r["id"] for r in found.collect()]
            if after is None:
                break
        assert got == want


def test_a_page_reads_its_folders_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(4_000).selectExpr("id", "timestamp'2020-01-01' + make_dt_interval(cast(id % 1000 as int)) as created_at", "'complete' as status", "'LOW' as severity", "'' as industry")
    T.append(rows, path)
    every, after = spark.read.parquet(path).inputFiles(), None
    for _ in range(6):
        found, after = T.page(spark, path, after, 100)
        assert found.count() == 100 and len(found.inputFiles()) <= max(4, len(every) // 8)
    first, _ = T.page(spark, path)
    T.append(spark.createDataFrame([(9_999, datetime(2023, 1, 1), "complete", "LOW", "")], SCHEMA), path)
    again, _ = T.page(spark, path)
    assert again.first()["id"] == 9_999
    # a place stays where it was, whatever comes in
    following, _ = T.page(spark, path, after, 100)
    assert following.count() == 100 and following.agg({"created_at": "max"}).first()[0] <= found.agg({"created_at": "min"}).first()[0]
