"""Keyed tables: the last row of each key, few files touched, read and kept."""

import os
import random
from pathlib import Path

import pytest

from hazmill.sources import keyed as K

SCHEMA = "id long, x string, t int"


def files(path):
    return {str(p) for p in Path(path).rglob("*.parquet")}


def test_many_batches_are_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MOST_PIECES", 3)
    path, rng, want, most = str(tmp_path / "t"), random.Random(4), {}, 0
    for i in range(13):
        batch = [(rng.randrange(60), f"{i}:{k}", k) for k in range(8)]
        K.put(spark.createDataFrame([*batch, (None, "lost", 0)], SCHEMA).coalesce(1), path, "id", order="t", buckets=4, grace_s=0)
        want |= {k: x for k, x, _ in batch}
        most = max(most, len(files(path)))
    assert {r["id"]: r["x"] for r in K.read_keyed(spark, path, "id").collect()} == want
    assert K.read_keyed(spark, path, "id").count() == len(want)
    # a bucket has at most three pieces and the one being added; nothing else is kept
    assert most <= 4 * (3 + 1 + 1) and all(len(p) <= 3 for p in K.pieces(spark, path).values())
    some = sorted(want)[0]
    assert [r["x"] for r in K.find(spark, path, "id", [some]).collect()] == [want[some]]
    assert K.find(spark, path, "id", [some, 10**9]).count() == 1


def test_an_addition_touches_its_buckets_and_a_lookup_reads_one_file(spark, tmp_path):
    path = str(tmp_path / "t")
    K.put(spark.range(2_000).selectExpr("id", "cast(id as string) as x", "0 as t"), path, "id", buckets=16)
    before = files(path)
    assert len(before) == 16
    K.put(spark.createDataFrame([(7, "new", 1)], SCHEMA), path, "id")
    assert before < files(path) and len(files(path)) == 17
    other = next(k for k in range(100) if not {p["number"] for p in K.pieces(spark, path)[spark.range(k, k + 1).select(K._bucket("id", 16)).first()[0]]} - {1})
    one = K.find(spark, path, "id", [other])
    assert len(one.inputFiles()) == 1 and one.first()["x"] == str(other)
    assert [r["x"] for r in K.find(spark, path, "id", [7]).collect()] == ["new"]
    assert K.find(spark, path, "id", [10**9]) is None and K.find(spark, path, "id", []) is None
    # a batch that is put again, and an empty one, change nothing
    K.put(spark.createDataFrame([(7, "new", 1)], SCHEMA), path, "id")
    K.put(spark.createDataFrame([], SCHEMA), path, "id")
    assert K.read_keyed(spark, path, "id").count() == 2_000


def test_failed_writers_and_none(spark, tmp_path):
    path = str(tmp_path / "t")
    assert K.read_keyed(spark, path, "id") is None and K.find(spark, path, "id", [1]) is None
    rows = spark.createDataFrame([("a", "1", 0), ("a", "2", 5), ("b", "3", 0)], "id string, x string, t int")
    K.put(rows, path, "id", order="t")
    lost = tmp_path / "t" / "data" / "folder=flost"
    rows.withColumn("bucket", K._bucket("id", 32)).write.partitionBy("bucket").parquet(str(lost))
    (tmp_path / "t" / "_log" / "000000002.json").write_text("")  # a writer between its two steps
    assert {r["id"]: r["x"] for r in K.read_keyed(spark, path, "id").collect()} == {"a": "2", "b": "3"}
    assert K._unfinished(spark, path, 3600) and not K._unfinished(spark, path, 0)
    K.clean(spark, path)
    assert lost.exists()
    os.utime(lost, (0, 0))
    K.clean(spark, path)
    assert not lost.exists() and K.read_keyed(spark, path, "id").count() == 2
    K.put(rows.where("id = 'b'").selectExpr("id", "'4' as x", "9 as t"), path, "id")
    assert {r["id"]: r["x"] for r in K.read_keyed(spark, path, "id").collect()} == {"a": "2", "b": "4"}


@pytest.mark.parametrize("grace_s, kept", [(3600, True), (0, False)])
def test_readers_keep_their_files_for_the_grace(spark, tmp_path, monkeypatch, grace_s, kept):
    monkeypatch.setattr(K, "MOST_PIECES", 2)
    path = str(tmp_path / "t")
    K.put(spark.createDataFrame([(1, "a", 0)], SCHEMA), path, "id", buckets=1, grace_s=grace_s)
    reader = K.read_keyed(spark, path, "id")
    for i in range(2):
        K.put(spark.createDataFrame([(1, f"b{i}", 0)], SCHEMA), path, "id", grace_s=grace_s)
    if kept:
        assert reader.first()["x"] == "a"
    assert (len(files(path)) == 4) is kept and len(K.pieces(spark, path)[0]) == 1
    assert [r["x"] for r in K.read_keyed(spark, path, "id").collect()] == ["b1"]
