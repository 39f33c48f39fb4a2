"""Sharding by sampled splitters, with DataFrame functions only.

A size-weighted sample of keys (hash of the text, doc_id) gives quantile
boundaries; records fall into the ranges between them, ranges that turn out
overfull are subdivided, and the running total of bytes over the ranges cuts
them into shards of nearly equal size (law ``bytes``). Equal texts share a hash
and stand side by side; a group of copies larger than a range is subdivided by
doc_id, and rows that are equal altogether by their place in the written keys,
so no range, and no task, grows with one group. Pieces of ranges hold at most
about PIECE_ROWS rows, however many rows there are.

Nulls and edges: a null text has no bytes and weighs 8; repeated rows are
placed one by one; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazmill.llm.common import cut_lineage

#: Ranges for each shard, sampled keys for each range, and the fill beyond which a range is subdivided.
RANGES_PER_SHARD, SAMPLES_PER_RANGE, OVERFULL = 32, 8, 1.5
#: Rows of a piece of a range, about.
PIECE_ROWS = 500_000


def sized_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32 and the key's hash; the text goes no further."""
    text = docs["text"].cast("string")
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64(text.isNull(), text).alias("text_hash"),
    )


def _below(splitters: list, text_hash: Column, doc_id: Column) -> Column:
    """Number of splitters at or below the key, by binary search."""
    if not splitters:
        return F.lit(0)
    points = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(d).alias("d")) for h, d in splitters])
    key = F.struct(text_hash.alias("h"), F.coalesce(doc_id, F.lit(-(2**63))).alias("d"))
    n, steps = len(splitters), [1 << k for k in reversed(range(len(splitters).bit_length()))]

    def step(at: Column, size: Column) -> Column:
        beyond = (at + size <= n) & (F.get(points, at + size - 1) <= key)
        return at + F.when(beyond, size).otherwise(0)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, seed: int = 17) -> DataFrame:
    """Each row's doc_id, size, text_crc32, law, shard (0 to n_shards - 1) and slot (gapless from 0 in its shard).

    The number of splitters, n_shards * RANGES_PER_SHARD, is fixed, so what the
    driver sees is bounded; within a subdivided range pieces are found by hash,
    as many as its exact size asks for.
    """
    rows = cut_lineage(sized_keys(docs))
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = n_shards * RANGES_PER_SHARD
    # a row is drawn with a chance in proportion to its size; large ones always
    drawn = n_ranges * SAMPLES_PER_RANGE
    unit = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(unit * F.lit(float(max(total, 1))) < F.col("size") * F.lit(float(drawn)))
    weight = F.greatest(F.col("size") * F.lit(float(drawn)) / F.lit(float(max(total, 1))), F.lit(1.0))
    order = Window.orderBy("text_hash", "doc_id")  # over the bounded sample alone
    running = sample.withColumn("w", weight).withColumn("upto", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    step = float(SAMPLES_PER_RANGE)
    marks = running.withColumn("mark", F.floor(F.col("upto") / step)).withColumn("before", F.floor((F.col("upto") - F.col("w")) / step))
    cuts = marks.where("mark > before and doc_id is not null").select("text_hash", "doc_id").distinct().orderBy("text_hash", "doc_id")
    splitters = [(r[0], r[1]) for r in cuts.limit(2 * n_ranges).collect()]

    ranged = rows.withColumn("range", _below(splitters, F.col("text_hash"), F.col("doc_id")).cast("int"))
    full = max(total / n_ranges, 1.0)
    same = lambda c: F.min(F.coalesce(c, F.lit(-1))).eqNullSafe(F.max(F.coalesce(c, F.lit(-1))))
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), same("text_hash").alias("one_text"), same("doc_id").alias("one_id"))
    pieces = sizes.select(
        "range",
        "one_text",
        "one_id",
        F.greatest(F.when(F.col("bytes") > full * OVERFULL, F.ceil(F.col("bytes") / F.lit(full))).otherwise(1), F.ceil(F.col("n") / PIECE_ROWS)).cast("int").alias("n_pieces"),
    )
    by_text, by_id, by_row = F.xxhash64(F.lit(seed), "text_hash"), F.xxhash64(F.lit(seed), "doc_id"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    part = F.pmod(F.when(F.col("one_text") & F.col("one_id"), by_row).when(F.col("one_text"), by_id).otherwise(by_text), F.col("n_pieces")).cast("int")
    placed = cut_lineage(ranged.join(F.broadcast(pieces), "range").withColumn("piece", part).drop("one_text", "one_id", "n_pieces"))

    whole = placed.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(
        "range", "piece", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before")
    )
    own = Window.partitionBy("range", "piece").orderBy("text_hash", "doc_id", "size")
    # as many starts as pieces: about one for each PIECE_ROWS rows
    at = placed.join(F.broadcast(starts) if n_rows <= PIECE_ROWS * 200_000 else starts, ["range", "piece"]).select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("bytes_before") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("byte_at"),
        (F.col("rows_before") + F.row_number().over(own) - 1).alias("row_at"),
    )
    # a record belongs to the shard in which its middle byte falls
    shard = F.least(F.floor((F.col("byte_at") + F.col("size") / 2) * F.lit(n_shards) / F.lit(float(max(total, 1)))), F.lit(n_shards - 1)).cast("int")
    at = cut_lineage(at.withColumn("shard", shard))
    first = at.groupBy("shard").agg(F.min("row_at").alias("first_row"))
    return at.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row_at") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
