"""BM25 over packed postings: segments that grow, block maxima, and an exact threshold pass.

An index is a folder of segments. A segment holds chunks in blocks of at most
BLOCK; a row of its postings is one term in one block, packed, with the largest
impact that the term has there. Adding chunks writes a segment; document
frequencies, lengths and weights are those of all segments together, so a search
over an index that grew is one over an index built at once.

A search goes over the block maxima first, which name for each query the blocks
that could hold its best chunks. The few most promising ones that have a rare term
of it are scored; the k-th best score is a floor. Terms whose largest impacts do
not add up to the floor cannot lift a chunk by themselves: only blocks with one of
the other, opening terms whose maxima reach the floor are scored then. A stop word
thus adds to what other words have found and never brings in a block of its own.
Nothing that belongs to the k best is left out. A block's scores for a bundle of
queries are one product of their weights and its impacts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from hazmill.functions import text as T
from hazmill.operators.best import best_of, top_k
from hazmill.sources.shared import checkpointed, new_folder

K1, B, NEGATIVE_IDF = 1.5, 0.75, 0.25
#: Chunks of a block and bytes of text that a block gathers, at most (one longer text is a block alone); queries of a bundle, about.
BLOCK, BLOCK_BYTES, BUNDLE = 512, 4_000_000, 128
#: The first pass takes a query's rarest terms until they stand in so many chunks for each of the k wanted, and so many blocks that have one.
LEAD, FIRST_BLOCKS = 20, 6
#: Terms of a bundle that are multiplied at once.
SLICE = 4096
#: Scores that differ by less are taken for equal when a chunk is given up.
SLACK = 1e-7

#: Rows of a table up to which it is broadcast to the postings, so that these are not shuffled for it.
MOST_BROADCAST = 200_000

#: Bytes of a lower-cased text to those of its terms, what functions.text.tokenize finds, and spaces.
TERM_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass
class Bm25Index:
    """An index at path; numbers and weights of all its segments."""

    spark: SparkSession
    path: str
    segments: list[int]
    n_chunks: int
    n_tokens: int
    _terms: list = field(default_factory=list)

    @property
    def mean_length(self) -> float:
        return self.n_tokens / max(self.n_chunks, 1)

    @property
    def postings(self) -> DataFrame:
        """segment, block, term, df, most, places, tfs, lens; a row without a term has the block's ids."""
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("segment").isin(self.segments))

    @property
    def terms(self) -> DataFrame:
        """term, df, idf: Okapi weights; a negative one becomes a quarter of the mean over all terms."""
        if not self._terms:
            by_term = checkpointed(self.spark.read.parquet(f"{self.path}/terms").where(F.col("segment").isin(self.segments)).groupBy("term").agg(F.sum("df").alias("df")))
            raw = by_term.withColumn("raw", F.log(F.lit(float(self.n_chunks)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
            mean = raw.agg(F.avg("raw")).first()[0] or 0.0
            self._terms.append(raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(NEGATIVE_IDF * mean)).otherwise(F.col("raw")).alias("idf")))
        return self._terms[0]


def build_bm25(chunks: DataFrame, path: str | None = None) -> Bm25Index:
    """The index of chunks(chunk_id, text), null texts as empty ones; an index at path is replaced. Without a path it lies beside the session's checkpoints."""
    path = path or new_folder(chunks.sparkSession, "bm25")
    _write_segment(chunks, path, 0, "overwrite")
    return load_bm25(chunks.sparkSession, path)


def add_chunks(index: Bm25Index, chunks: DataFrame) -> Bm25Index:
    """The index with more chunks, as a further segment. Ids are not looked up: an id that is added twice is found twice."""
    _write_segment(chunks, index.path, max(index.segments) + 1, "append")
    return load_bm25(index.spark, index.path)


def load_bm25(spark: SparkSession, path: str) -> Bm25Index:
    """The index at path, of the segments that were finished: those whose size is written."""
    sizes = spark.read.parquet(f"{path}/sizes").collect()  # a row for each segment
    return Bm25Index(spark, path, sorted(r.segment for r in sizes), sum(r.n_chunks for r in sizes), sum(r.n_tokens for r in sizes))


def _write_segment(chunks: DataFrame, path: str, number: int, mode: str) -> None:
    _write_rows(chunks, path, number)
    _finish(chunks.sparkSession, path, number, mode)


def _finish(spark: SparkSession, path: str, number: int, mode: str) -> None:
    """Document frequencies of written postings and, last, the size by which readers know the segment."""
    part = f"segment={number}"
    made = spark.read.parquet(f"{path}/postings/{part}")
    made.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).write.mode("overwrite").parquet(f"{path}/terms/{part}")
    sizes = made.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).withColumn("segment", F.lit(number))
    sizes.coalesce(1).write.mode(mode).parquet(f"{path}/sizes")


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema(
        [("block", pa.int64()), ("term", pa.string()), ("ids", pa.list_(kind)), ("df", pa.int64()), ("n_tokens", pa.int64()), ("most", pa.float64()), ("mean", pa.float64()), ("places", pa.binary()), ("tfs", pa.binary()), ("lens", pa.binary())]
    )


def _ddl(kind: DataType) -> str:
    return f"block bigint, term string, ids array<{kind.simpleString()}>, df bigint, n_tokens bigint, most double, mean double, places binary, tfs binary, lens binary"


def _write_rows(chunks: DataFrame, path: str, number: int) -> None:
    kind = chunks.schema["chunk_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            # chunks of like length stand together: their impacts are alike, and so a block's maxima are near to each of them
            sizes = pc.binary_length(batch.column("text").fill_null("")).to_numpy()
            order = np.argsort(sizes, kind="stable")
            # the mean length of the batch is a scale for maxima; blocks are counted one at a time
            tokens = pc.sum(pc.count_substring_regex(batch.column("text").fill_null(""), "[A-Za-z0-9]+")).as_py()
            mean = max((tokens or 0) / max(batch.num_rows, 1), 1.0)
            for a, b in _runs(sizes[order]):
                part = batch.take(pa.array(order[a:b]))
                counted = _counted(part.column("text").fill_null("").to_pylist())
                yield from _block(base + count, mean, part.column("chunk_id"), *counted)
                count += 1

    rows = chunks.select("chunk_id", F.col("text").cast("string").alias("text")).mapInArrow(run, _ddl(kind))
    rows.write.mode("overwrite").parquet(f"{path}/postings/segment={number}")


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """The blocks of a batch, from the sizes of its texts."""
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (i - start == BLOCK or size + n > BLOCK_BYTES):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def _counted(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, and for each posting, by term and place, the term's number, place and count; lengths of all texts)."""
    lists = pc.ascii_split_whitespace(pa.array([t.lower().encode().translate(TERM_BYTES) for t in texts], pa.large_binary()).cast(pa.large_string()))
    flat, place = lists.flatten(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    coded = flat.filter(pa.array(real)).dictionary_encode()
    place = place[real]
    key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(texts) + place, return_counts=True)
    return coded.dictionary.cast(pa.string()), key // len(texts), key % len(texts), tf, np.bincount(place, minlength=len(texts))


def _block(block: int, mean: float, ids: pa.Array, terms: pa.Array, term: np.ndarray, place: np.ndarray, tf: np.ndarray, lens: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row with the ids of a block, and one for each of its terms; most: the term's largest impact here, if chunks are so long on average as mean says."""
    schema = _schema(ids.type)
    yield pa.RecordBatch.from_pydict({"block": [block], "term": [None], "ids": [ids.to_pylist()], "df": [len(ids)], "n_tokens": [int(lens.sum())], "most": [None], "mean": [mean], "places": [None], "tfs": [None], "lens": [lens.astype(np.int64).tobytes()]}, schema=schema)
    if not len(term):
        return
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    n = lens[place]
    most = np.maximum.reduceat(_impact(tf.astype(np.float64), n, mean), first)
    bounds = pa.py_buffer(np.r_[first, len(term)].astype(np.int32) * 4)
    packed = [pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, bounds, pa.py_buffer(x.astype(np.int32))]) for x in (place, tf, n)]
    nothing = pa.nulls(len(first), pa.list_(ids.type))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), block)), terms.take(pa.array(term[first])), nothing, pa.array(np.diff(np.r_[first, len(term)])), pa.array(np.zeros(len(first), np.int64)), pa.array(most), pa.array(np.full(len(first), mean)), *packed], schema=schema)


def merge_segments(index: Bm25Index, path: str) -> Bm25Index:
    """The same index in another folder, as one segment: small blocks become full ones, no text is read.

    Blocks are dealt to groups by hash; within a group those that follow one
    another are put together up to BLOCK chunks.
    """
    kind = index.postings.schema["ids"].dataType.elementType
    mean = max(index.mean_length, 1.0)
    heads = index.postings.where("term is null").select("segment", "block", F.col("df").alias("n"))
    n_heads = heads.count()
    groups = 1 + n_heads // 256
    number = F.pmod(F.xxhash64("segment", "block"), F.lit(groups))
    order = Window.partitionBy("part").orderBy("segment", "block")
    placed = heads.withColumn("part", number).withColumn("before", F.sum("n").over(order) - F.col("n"))
    # a block lies where its first chunk does; what it goes beyond the edge is less than a block
    placed = placed.select("segment", "block", "n", (F.col("part") * (1 << 32) + F.floor(F.col("before") / BLOCK)).alias("into"))
    placed = checkpointed(placed.withColumn("offset", (F.sum("n").over(Window.partitionBy("into").orderBy("segment", "block")) - F.col("n")).cast("int")))

    def run(table: pa.Table) -> pa.Table:
        is_head = pc.is_null(table["term"])
        heads = table.filter(is_head).sort_by("offset").combine_chunks().to_batches()[0]
        rows = table.filter(pc.invert(is_head)).combine_chunks()
        lens = np.concatenate([np.frombuffer(x, np.int64) for x in heads.column("lens").to_pylist()])
        coded = rows["term"].combine_chunks().dictionary_encode()
        (places, at), (tfs, _) = _packed(rows["places"].combine_chunks()), _packed(rows["tfs"].combine_chunks())
        n = np.diff(at)
        each = np.c_[np.repeat(coded.indices.to_numpy().astype(np.int64), n), places + np.repeat(rows["offset"].to_numpy().astype(np.int64), n), tfs]
        each = each[np.lexsort((each[:, 1], each[:, 0]))]
        made = _block(table["into"][0].as_py(), mean, heads.column("ids").flatten(), coded.dictionary, each[:, 0], each[:, 1], each[:, 2], lens)
        return pa.Table.from_batches(list(made))

    moved = index.postings.select("segment", "block", "term", "ids", "n_tokens", "places", "tfs", "lens").join(_sent(placed.select("segment", "block", "into", "offset"), n_heads), ["segment", "block"])
    moved.groupBy("into").applyInArrow(run, _ddl(kind)).write.mode("overwrite").parquet(f"{path}/postings/segment=0")
    _finish(index.spark, path, 0, "overwrite")
    return load_bm25(index.spark, path)


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """rows, broadcast if they are few (n is their number, or more): Spark does not know the size of what is checkpointed."""
    return F.broadcast(rows) if n <= MOST_BROADCAST else rows


def _impact(tf: np.ndarray, n: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))


def _most(mean: float) -> Column:
    """At least the largest impact of a row's postings at this mean length: an impact grows with it, but no faster than in proportion."""
    return F.col("most") * F.greatest(F.lit(1.0), F.lit(mean) / F.col("mean"))


def _wanted(queries: DataFrame, index: Bm25Index) -> DataFrame:
    """query_id, bundle, term, df, weight of the terms that some chunk has."""
    each = queries.select("query_id", F.explode(T.tokenize(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    each = checkpointed(each)
    n = F.lit(1 + queries.select("query_id").distinct().count() // BUNDLE)
    return _sent(each, each.count()).join(index.terms, "term").select("query_id", F.pmod(F.xxhash64(F.col("query_id").cast("string")), n).cast("int").alias("bundle"), "term", "df", (F.col("qtf") * F.col("idf")).alias("weight"))


def _scored(asked: DataFrame, index: Bm25Index, k: int) -> DataFrame:
    """query_id, chunk_id, score of each block's k best of each query; rows without a chunk_id say how many were scored (n).

    asked: query_id, bundle, segment, block, term, weight, floor.
    """
    postings, spark = index.postings, index.spark
    mean = index.mean_length or 1.0
    asked = checkpointed(asked)
    n_asked, terms = asked.count(), checkpointed(asked.select("term").distinct())
    q_kind, c_kind = asked.schema["query_id"].dataType, postings.schema["ids"].dataType.elementType
    out = pa.schema([("query_id", to_arrow_type(q_kind)), ("chunk_id", to_arrow_type(c_kind)), ("score", pa.float64()), ("n", pa.int64())])
    key = ["bundle", "segment", "block"]
    who = asked.groupBy(*key, "term").agg(F.collect_list(F.struct("query_id", "weight", "floor")).alias("who"))
    # of the postings only those of terms that are asked for are shuffled
    rows = postings.where("term is not null").select("segment", "block", "term", "places", "tfs", "lens").join(_sent(terms, terms.count()), "term", "left_semi").join(_sent(who, n_asked), ["segment", "block", "term"])
    heads = _sent(asked.select(*key).distinct(), n_asked).join(postings.where("term is null").select("segment", "block", "ids"), ["segment", "block"])
    rows = rows.select(*key, "term", "places", "tfs", "lens", "who", F.lit(None).cast(postings.schema["ids"].dataType).alias("ids"))
    heads = heads.select(*key, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("term", "places", "tfs", "lens", "who")], "ids")

    def run(table: pa.Table) -> pa.Table:
        is_head = pc.is_null(table["term"])
        ids = table.filter(is_head)["ids"].combine_chunks().flatten()
        own = table.filter(pc.invert(is_head)).combine_chunks()
        flat = {c: _packed(own[c].combine_chunks()) for c in ("places", "tfs", "lens")}
        who = own["who"].combine_chunks()
        whose = np.repeat(np.arange(len(own)), np.diff(who.offsets.to_numpy()))
        query, weight, floor = (who.flatten().field(c) for c in ("query_id", "weight", "floor"))
        coded = query.dictionary_encode()
        number, weight, least = coded.indices.to_numpy(), weight.to_numpy(), np.full(len(coded.dictionary), -np.inf)
        least[number] = floor.to_numpy()
        row = np.repeat(np.arange(len(own)), np.diff(flat["places"][1]))
        impact = _impact(flat["tfs"][0].astype(np.float64), flat["lens"][0], mean)
        score = np.zeros((len(least), len(ids)))
        shared = np.zeros(score.shape, bool)
        for a in range(0, len(own), SLICE):
            b = min(a + SLICE, len(own))
            block, bundle = np.zeros((b - a, len(ids))), np.zeros((len(least), b - a))
            at, of = (row >= a) & (row < b), (whose >= a) & (whose < b)
            block[row[at] - a, flat["places"][0][at]] = impact[at]
            bundle[number[of], whose[of] - a] = weight[of]
            score += bundle @ block
            if (weight > 0).all():
                shared = score > 0
            else:  # a chunk that shares a term is found, whatever the term's weight
                asks = np.zeros(bundle.shape, np.float32)
                asks[number[of], whose[of] - a] = 1
                shared |= asks @ (block > 0).astype(np.float32) > 0
        score[~shared | (score < least[:, None] - SLACK)] = -np.inf
        order_of = np.empty(len(ids), np.int64)
        order_of[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        r, c = best_of(score, order_of, k)
        counts = pa.Table.from_arrays([coded.dictionary.cast(out.types[0]), pa.nulls(len(least), out.types[1]), pa.nulls(len(least), pa.float64()), pa.array(np.full(len(least), len(ids)))], schema=out)
        return pa.concat_tables([counts, pa.Table.from_arrays([coded.dictionary.take(pa.array(r)).cast(out.types[0]), ids.take(pa.array(c)).cast(out.types[1]), pa.array(score[r, c]), pa.nulls(len(r), pa.int64())], schema=out)])

    # few bytes, much work: as many tasks as the session shuffles to, whatever their size
    dealt = rows.unionByName(heads).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key)
    return dealt.groupBy(*key).applyInArrow(run, f"query_id {q_kind.simpleString()}, chunk_id {c_kind.simpleString()}, score double, n bigint")


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit numbers of all rows, where each row's begin, and the end)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 4
    numbers = np.frombuffer(data, np.int32) if data is not None and data.size else np.zeros(0, np.int32)
    return numbers[at[0] : at[-1]], at - at[0]


def _passes(queries: DataFrame, index: Bm25Index, k: int) -> tuple[DataFrame, DataFrame]:
    """(what the first pass scored, what the second did)."""
    wanted = checkpointed(_wanted(queries, index))
    by_rarity = Window.partitionBy("query_id").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(by_rarity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = wanted.withColumn("opens", (before == 0) | (before + F.col("df") <= LEAD * k))
    # block maxima of the terms that are asked for, without their postings
    maxima = index.postings.where("term is not null").select("segment", "block", "term", _most(index.mean_length or 1.0).alias("most"))
    terms = checkpointed(wanted.select("term").distinct())
    maxima = checkpointed(maxima.join(_sent(terms, terms.count()), "term"))
    here = Window.partitionBy("query_id", "segment", "block")
    reach = F.sum(F.greatest(F.col("weight") * F.col("most"), F.lit(0.0))).over(here)
    n_wanted = wanted.count()
    met = maxima.join(_sent(lead, n_wanted), "term").withColumns({"reach": reach, "any": F.max("opens").over(here), "floor": F.lit(float("-inf"))}).where("any")
    first_of = Window.partitionBy("query_id").orderBy(F.desc("reach"), "segment", "block")
    one = met.withColumn("place", F.dense_rank().over(first_of)).where(F.col("place") <= FIRST_BLOCKS)
    wants = ["query_id", "bundle", "segment", "block", "term", "weight", "floor"]
    first = checkpointed(_scored(one.select(wants), index, k))
    floors = top_k(first.where("n is null"), k).where(F.col("rank0") == k - 1).select("query_id", F.col("score").alias("floor"))
    # the weakest terms that together stay below the floor bring in no chunk
    most = maxima.groupBy("term").agg(F.max("most").alias("most"))
    bound = wanted.join(most, "term").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    bound = bound.withColumn("bound", F.greatest(F.col("weight") * F.col("most"), F.lit(0.0)))
    weakest = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = bound.withColumn("opens", ~(F.sum("bound").over(weakest) < F.col("floor") - SLACK)).select("query_id", "bundle", "term", "weight", "opens", "floor")
    two = maxima.join(_sent(bound, n_wanted), "term").withColumns({"reach": reach, "any": F.max("opens").over(here)})
    two = two.where(F.col("any") & (F.col("reach") >= F.col("floor") - SLACK))
    return first, _scored(two.select(wants), index, k)


def bm25_search(queries: DataFrame, index: Bm25Index, k: int = 20) -> DataFrame:
    """query_id, chunk_id, score, rank0 of the best k chunks sharing a term, exactly; repeated query terms count repeatedly, rows of one query_id are one query."""
    return top_k(_passes(queries, index, k)[1].where("n is null").drop("n"), k)


def bm25_work(queries: DataFrame, index: Bm25Index, k: int) -> DataFrame:
    """query_id, n_scored (chunks of the blocks that both passes scored), n_sharing (chunks that share a term with the query)."""
    first, second = _passes(queries, index, k)
    scored = first.unionByName(second).where("n is not null").groupBy("query_id").agg(F.sum("n").alias("n_scored"))
    places = index.postings.where("term is not null").select("segment", "block", "term", "places").join(_wanted(queries, index).select("query_id", "term"), "term")

    def run(table: pa.Table) -> pa.Table:
        n = len(np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in table["places"].to_pylist()])))
        return pa.table({"query_id": table["query_id"].slice(0, 1), "n": [n]})

    kind = queries.schema["query_id"].dataType.simpleString()
    shared = places.groupBy("query_id", "segment", "block").applyInArrow(run, f"query_id {kind}, n bigint").groupBy("query_id").agg(F.sum("n").alias("n_sharing"))
    return shared.join(scored, "query_id", "left").select("query_id", F.coalesce("n_scored", F.lit(0)).alias("n_scored"), "n_sharing")
