"""A table of rows by key, kept in buckets: additions touch their own buckets, a lookup reads its key's bucket.

A batch is a folder with a file for each bucket that it touches, sorted by key,
and an entry of the table's log, which says for each bucket how many rows there
are and between which keys. A bucket read from too many batches is merged, alone,
into a new folder that stands for the batches up to a number; what it replaces is
removed after a time in which readers may still hold it. A batch without an entry
(a writer that failed) is never read and is removed as well; an entry that exists
already is never written over, so two writers get two numbers.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a new table, batches a bucket is read from before it is merged, and seconds until what nobody needs is removed.
BUCKETS, MOST_PIECES, GRACE_S = 32, 8, 3600


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    p, fs = _fs(spark, path)
    return sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)) if fs.exists(p) else []


def _log(spark: SparkSession, path: str) -> dict[int, dict]:
    """The entries by number; one that is still being written is not there yet."""
    out = {}
    for name, _ in _listed(spark, f"{path}/_log"):
        if name.endswith(".json"):
            p, fs = _fs(spark, f"{path}/_log/{name}")
            stream = fs.open(p)
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("\n"):
                out[int(name.split(".")[0])] = json.loads(text)
    return out


def _enter(spark: SparkSession, path: str, entry: dict) -> int:
    number = max((int(n.split(".")[0]) for n, _ in _listed(spark, f"{path}/_log") if n.endswith(".json")), default=0)
    while True:
        number += 1
        p, fs = _fs(spark, f"{path}/_log/{number:09d}.json")
        if fs.exists(p):
            continue
        try:
            stream = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                continue
            raise
        stream.write(bytearray((json.dumps(entry) + "\n").encode()))
        stream.close()
        return number


def _every(log: dict[int, dict]) -> dict[int, list[dict]]:
    """For each bucket all that was written, by rank: its number for a batch; the last number merged, then its own, for a merge."""
    found: dict[int, list[dict]] = {}
    for number, e in log.items():
        for b, (n, lo, hi) in e["buckets"].items():
            found.setdefault(int(b), []).append({"rank": (e.get("upto", number), number), "number": number, "merge": "upto" in e, "folder": e["folder"], "n": n, "lo": lo, "hi": hi})
    return {b: sorted(ps, key=lambda p: p["rank"]) for b, ps in found.items()}


def pieces(spark: SparkSession, path: str) -> dict[int, list[dict]]:
    """For each bucket what it is read from, a later one's rows winning: its last merge and the batches after it."""
    every = _every(_log(spark, path))
    last = {b: max((i for i, p in enumerate(ps) if p["merge"]), default=0) for b, ps in every.items()}
    return {b: ps[last[b] :] for b, ps in every.items()}


def _width(spark: SparkSession, path: str) -> int | None:
    log = _log(spark, path)
    return next(iter(log.values()))["width"] if log else None


def _bucket(key: str, width: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(width)).cast("int")


def _write(rows: DataFrame, path: str, key: str, width: int, **more) -> int | None:
    """Rows with a bucket as a folder of their own and its entry."""
    spark, folder = rows.sparkSession, f"f{uuid.uuid4().hex}"
    rows.repartition(width, "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{path}/data/folder={folder}")
    if not [n for n, _ in _listed(spark, f"{path}/data/folder={folder}") if n.startswith("bucket=")]:
        return None
    zones = spark.read.parquet(f"{path}/data/folder={folder}").groupBy("bucket").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    # at most one row a bucket
    held = {str(r["bucket"]): [r["n"], r["lo"], r["hi"]] for r in zones.collect()}
    return _enter(spark, path, {"folder": folder, "width": width, "buckets": held, **more})


def _newest(spark: SparkSession, path: str, key: str, wanted: list[tuple[int, dict]]) -> DataFrame:
    """The rows of pieces of buckets, of each key those of the last rank; buckets of one piece are not shuffled."""
    many = {b for b, _ in wanted if sum(x == b for x, _ in wanted) > 1}
    read = lambda part: spark.read.option("basePath", f"{path}/data").option("mergeSchema", "true").parquet(*[f"{path}/data/folder={p['folder']}/bucket={b}" for b, p in part])
    single, several = [w for w in wanted if w[0] not in many], [w for w in wanted if w[0] in many]
    out = read(single).drop("bucket", "folder") if single else None
    if several:
        order = sorted({(p["rank"], p["folder"]) for _, p in several})
        ranks = F.broadcast(spark.createDataFrame([(f, i) for i, (_, f) in enumerate(order)], "folder string, __rank int"))
        rows = read(several).join(ranks, "folder")
        last = rows.withColumn("__last", F.max("__rank").over(Window.partitionBy("bucket", key))).where("__rank = __last").drop("bucket", "folder", "__rank", "__last")
        out = last if out is None else out.unionByName(last, allowMissingColumns=True)
    return out


def read_keyed(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """All rows, of each key the latest; None if there are none."""
    wanted = [(b, p) for b, ps in pieces(spark, path).items() for p in ps]
    return _newest(spark, path, key, wanted) if wanted else None


def find(spark: SparkSession, path: str, key: str, values: list) -> DataFrame | None:
    """The latest rows of a few keys, from the files of their buckets whose range of keys holds one; None if no file does."""
    width = _width(spark, path)
    if width is None or not values:
        return None
    asked = spark.createDataFrame([(v,) for v in values], [key]).select(key, _bucket(key, width).alias("b"))
    at: dict[int, list] = {}
    for r in asked.collect():
        at.setdefault(r["b"], []).append(r[key])
    wanted = [(b, p) for b, ps in pieces(spark, path).items() if b in at for p in ps if any(p["lo"] <= v <= p["hi"] for v in at[b])]
    return _newest(spark, path, key, wanted).where(F.col(key).isin(values)) if wanted else None


def put(rows: DataFrame, path: str, key: str, order: str | None = None, buckets: int = BUCKETS, grace_s: float = GRACE_S) -> None:
    """Adds rows, in place of those of the same key; doing it again changes nothing.

    Keys are numbers or strings. Rows without a key are left out; of rows of one
    key the one with the largest order stays (ties, or no order: one chosen by
    its content). The number of buckets is that of the first batch.
    """
    spark = rows.sparkSession
    width = _width(spark, path) or buckets
    first = Window.partitionBy(key).orderBy(*([F.desc(order)] if order else []), F.xxhash64(*rows.columns))
    once = rows.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    _write(once.withColumn("bucket", _bucket(key, width)), path, key, width)
    crowded = {b: ps for b, ps in pieces(spark, path).items() if len(ps) > MOST_PIECES}
    # a number below the merge's may belong to a writer who is not done: its batch would count as merged
    if crowded and not _unfinished(spark, path, grace_s):
        upto = max(p["number"] for ps in crowded.values() for p in ps)
        merged = _newest(spark, path, key, [(b, p) for b, ps in crowded.items() for p in ps])
        _write(merged.withColumn("bucket", _bucket(key, width)), path, key, width, upto=upto)
        clean(spark, path, grace_s)


def _unfinished(spark: SparkSession, path: str, grace_s: float) -> bool:
    log, since = _log(spark, path), (time.time() - grace_s) * 1000
    return any(name.endswith(".json") and int(name.split(".")[0]) not in log and when > since for name, when in _listed(spark, f"{path}/_log"))


def clean(spark: SparkSession, path: str, grace_s: float = GRACE_S) -> None:
    """Removes what was merged, and what failed writers left, once the merge, or the rest, is older than the grace."""
    before = (time.time() - grace_s) * 1000
    log = _log(spark, path)
    written = {int(n.split(".")[0]): when for n, when in _listed(spark, f"{path}/_log") if n.endswith(".json")}
    gone: dict[int, list[int]] = {}
    for b, ps in _every(log).items():
        settled = max((i for i, p in enumerate(ps) if p["merge"] and written[p["number"]] <= before), default=0)
        for p in ps[:settled]:
            gone.setdefault(p["number"], []).append(b)
    old = []
    for number, buckets in gone.items():
        folder = f"{path}/data/folder={log[number]['folder']}"
        old += [f"{path}/_log/{number:09d}.json", folder] if len(buckets) == len(log[number]["buckets"]) else [f"{folder}/bucket={b}" for b in buckets]
    entered = {f"folder={e['folder']}" for e in log.values()}
    old += [f"{path}/data/{name}" for name, when in _listed(spark, f"{path}/data") if name not in entered and grace_s > 0 and when <= before]
    for name in old:
        p, fs = _fs(spark, name)
        fs.delete(p, True)
