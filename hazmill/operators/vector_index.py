"""An inverted file of vectors: trained cells, vectors stored by cell, cells probed until the k best are safe.

The cells are learned from a sample of bounded size; every vector is indexed.
A search goes over the cells twice. The first pass scores the cells nearest to a
query until they hold enough vectors; the k-th best score found is a floor. The
second pass scores every other cell whose bound reaches the floor. By the
triangle inequality the bound of a cell is the product with its centre plus its
radius: with that the result is exact. An approximate search takes the
projection of a cell's vectors on the query for what it is in high dimensions,
nearly normal, and adds so many standard deviations (sureness) instead of the
whole radius.

What a task holds does not grow with the vectors: blocks of at most BLOCK of
them, and the centres, at most MOST_CELLS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.operators.best import Best, in_parts, top_k
from hazmill.sources.shared import checkpointed

#: Vectors that the cells are learned from, at most; cells, at most; vectors of a block, at most; queries of a group, at most.
SAMPLE, MOST_CELLS, BLOCK, GROUP = 20_000, 4096, 1024, 256
#: The first pass scores about so many vectors for each of the k wanted.
FIRST = 8
#: Folders that the cells lie in, side by side: as many as are listed without a job of Spark's.
SHELVES = 32
SURENESS = 3.0
ROUNDS = 8


@dataclass
class VectorIndex:
    """The folder of an index, its centres, and for each cell how many vectors it has and how far they lie."""

    spark: SparkSession
    path: str
    id_type: str
    centres: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray
    spread: np.ndarray
    _read: list = field(default_factory=list)

    @property
    def n(self) -> int:
        return int(self.sizes.sum())

    def blocks(self) -> DataFrame:
        """shelf, cell, n, ids, labels, x, radius, squares: the files as they were when this was first asked for."""
        if not self._read:
            self._read.append(self.spark.read.parquet(f"{self.path}/blocks"))
        return self._read[0]


def cells_for(n: int) -> int:
    """About twice the root of n, so that cells and vectors of a cell grow alike; at least four sampled vectors a cell."""
    return int(max(1, min(2 * n**0.5, MOST_CELLS, min(n, SAMPLE) // 4)))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.zeros(0, np.int64), *((x[a : a + BLOCK] @ centres.T - half).argmax(axis=1) for a in range(0, len(x), BLOCK))])


def train_cells(x: np.ndarray, n_cells: int, seed: int = 0) -> np.ndarray:
    """Centres by rounds of k-means; an empty cell takes the vector that lies farthest from its own centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(n_cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        cell = nearest(x, centres)
        order = np.argsort(cell, kind="stable")
        there, first = np.unique(cell[order], return_index=True)
        centres = centres.copy()
        centres[there] = np.add.reduceat(x[order], first) / np.diff(np.r_[first, len(x)])[:, None]
        empty = np.setdiff1d(np.arange(len(centres)), there)
        centres[empty] = x[np.argsort(((x - centres[cell]) ** 2).sum(axis=1))[::-1][: len(empty)]]
    return centres


def _sound(vectors: DataFrame, label: str | None) -> DataFrame:
    """chunk_id, embedding, label of the vectors whose numbers are all finite."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label")).where(fine & (F.size("embedding") > 0))


def _id_type(rows: DataFrame, key: str) -> str:
    return rows.schema[key].dataType.simpleString()


def build_vector_index(vectors: DataFrame, path: str, label: str | None = None, n_cells: int | None = None) -> VectorIndex:
    """Learns the cells and stores every vector of vectors(chunk_id, embedding) in its own; an index at path is replaced.

    label: a column whose values searches may ask for. Vectors that are null,
    empty or hold null or non-finite numbers are found by no search and are not
    stored. All others must be of one length.
    """
    rows = _sound(vectors, label)
    spark = vectors.sparkSession
    n = rows.count()
    # by hash, so that the sample is the same however the rows are dealt; about twice SAMPLE rows are sorted
    key = F.xxhash64(F.col("chunk_id").cast("string"))
    few = rows.where(F.pmod(key, F.lit(max(1, n // (2 * SAMPLE)))) == 0).orderBy(key, "chunk_id").limit(SAMPLE)
    sample = few.select("embedding").toArrow()["embedding"].combine_chunks()
    if len(set(pc.list_value_length(sample).to_pylist())) > 1:
        raise ValueError("the vectors of an index must be of one length")
    x = sample.flatten().to_numpy().reshape(len(sample), -1) if len(sample) else np.zeros((1, 1))
    centres = train_cells(x, n_cells or cells_for(n))
    kind = _id_type(vectors, "chunk_id")
    spark.createDataFrame([(i, c.tolist(), kind) for i, c in enumerate(centres)], "cell int, centre array<double>, id_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    _blocks(rows, centres, vectors).write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/blocks")
    return load_vector_index(spark, path)


def add_vectors(index: VectorIndex, vectors: DataFrame, label: str | None = None) -> VectorIndex:
    """The index with more vectors: they go to the cells as they are, in blocks of their own, and nothing else is read or written.

    Ids are not looked up: an id that is added twice is found twice.
    """
    _blocks(_sound(vectors, label), index.centres, vectors).write.mode("append").partitionBy("shelf").parquet(f"{index.path}/blocks")
    return load_vector_index(index.spark, index.path)


def merge_blocks(index: VectorIndex, path: str) -> VectorIndex:
    """The same index in another folder, with the small blocks that additions left packed again."""
    blocks = index.blocks()
    flat = blocks.select("cell", F.arrays_zip("ids", "labels").alias("own"), "x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, own, x in pdf.itertuples(index=False):
                v = np.frombuffer(x).reshape(len(own), -1)
                yield pd.DataFrame({"chunk_id": [o["ids"] for o in own], "embedding": list(v), "label": [o["labels"] for o in own], "cell": cell})

    kind = index.id_type
    rows = flat.mapInPandas(run, f"chunk_id {kind}, embedding array<double>, label string, cell int")
    _packed(rows, index.centres, kind).write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/blocks")
    index.spark.read.parquet(f"{index.path}/cells").write.mode("overwrite").parquet(f"{path}/cells")
    return load_vector_index(index.spark, path)


def _blocks(rows: DataFrame, centres: np.ndarray, typed: DataFrame) -> DataFrame:
    dim = centres.shape[1]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                if (pdf["embedding"].str.len() != dim).any():
                    raise ValueError("the vectors of an index must be of one length")
                yield pdf.assign(cell=nearest(np.array(pdf["embedding"].tolist()), centres).astype(np.int32))

    kind = _id_type(typed, "chunk_id")
    return _packed(rows.mapInPandas(assign, f"chunk_id {kind}, embedding array<double>, label string, cell int"), centres, kind)


def _packed(rows: DataFrame, centres: np.ndarray, kind: str) -> DataFrame:
    """cell, n, ids, labels, x, radius, squares: rows of a cell side by side. A cell of many vectors is spread over tasks by its ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            cells = pdf["cell"].to_numpy()
            first = np.flatnonzero(np.r_[len(cells) > 0, cells[1:] != cells[:-1]]) if len(cells) else []
            for a, b in zip(first, [*first[1:], len(pdf)], strict=True):
                last = b == len(pdf)
                stop = a + (b - a) // BLOCK * BLOCK if last else b
                for c in range(a, stop, BLOCK):
                    yield block(pdf.iloc[c : min(c + BLOCK, stop)])
                if last:
                    held = pdf.iloc[stop:b]
        if held is not None and len(held):
            yield block(held)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        x, cell = np.array(pdf["embedding"].tolist()), int(pdf["cell"].iloc[0])
        squares = ((x - centres[cell]) ** 2).sum(axis=1)
        labels = [None if pd.isna(v) else v for v in pdf["label"]]
        return pd.DataFrame({"n": [len(pdf)], "ids": [pdf["chunk_id"].tolist()], "labels": [labels], "x": [x.tobytes()], "radius": [float(np.sqrt(squares.max()))], "squares": [float(squares.sum())], "cell": [cell]})

    spread = rows.repartitionByRange("cell", F.xxhash64("chunk_id")).sortWithinPartitions("cell")
    made = spread.mapInPandas(run, f"n int, ids array<{kind}>, labels array<string>, x binary, radius double, squares double, cell int")
    return made.withColumn("shelf", _shelf(F.col("cell"), len(centres)))


def _shelf(cell: Column, n_cells: int) -> Column:
    return F.floor(cell / -(-n_cells // SHELVES)).cast("int")


def load_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MOST_CELLS
    centres = np.array([r.centre for r in cells], np.float64)
    sizes, radius, squares = np.zeros(len(cells), np.int64), np.zeros(len(cells)), np.zeros(len(cells))
    read = []
    if _has_blocks(spark, path):
        read.append(spark.read.parquet(f"{path}/blocks"))
        for r in read[0].groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("squares").alias("squares")).collect():
            sizes[r.cell], radius[r.cell], squares[r.cell] = r.n, r.radius, r.squares
    # along one direction, of as many as a vector has numbers
    return VectorIndex(spark, path, cells[0].id_type, centres, sizes, radius, np.sqrt(squares / np.maximum(sizes, 1) / centres.shape[1]), read)


def _has_blocks(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/blocks")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(x.getPath().getName().startswith("shelf=") for x in fs.listStatus(p))


def _probed(asked: DataFrame, index: VectorIndex, k: int, sureness: float | None, second: bool) -> DataFrame:
    """asked with cells: a bit for each cell that a pass sends a query to. No query is repeated for its cells.

    asked: query_id, embedding, wanted, share (of all vectors that have what is
    wanted), and floor for the second pass.
    """
    centres, sizes, radius, spread = index.centres, index.sizes, index.radius, index.spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, GROUP):
                part = batch.slice(a, GROUP)
                q = _asked(part.column("embedding"), centres.shape[1])
                near = q @ centres.T
                # first pass: the nearest cells that together hold enough
                order = np.argsort(-near, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                enough = FIRST * k / np.maximum(part.column("share").to_numpy(zero_copy_only=False), 1e-12)
                chosen = np.zeros(near.shape, bool)
                np.put_along_axis(chosen, order, before < enough[:, None], axis=1)
                if second:
                    reach = radius if sureness is None else np.minimum(radius, sureness * spread)
                    bound = near + np.linalg.norm(q, axis=1)[:, None] * reach
                    chosen = ~chosen & (bound >= part.column("floor").to_numpy(zero_copy_only=False)[:, None] - 1e-9)
                bits = np.packbits(chosen & (sizes > 0), axis=1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([x.tobytes() for x in bits], pa.binary())], names=[*names, "cells"])

    names = ["query_id", "embedding", "wanted", *(["floor"] if second else [])]
    return asked.mapInArrow(run, f"query_id {_id_type(asked, 'query_id')}, embedding array<double>, wanted string{', floor double' if second else ''}, cells binary")


def _asked(embeddings: pa.Array, dim: int) -> np.ndarray:
    if (pc.list_value_length(embeddings).to_numpy(zero_copy_only=False) != dim).any():
        raise ValueError("queries must be as long as the vectors of the index")
    return embeddings.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scored(probed: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """query_id, chunk_id, score: of the blocks of the cells that a pass sends queries to, each task's k best of each query that reach its floor."""
    dim, n_cells = index.centres.shape[1], len(index.centres)

    def search(table: pa.Table) -> DataFrame:
        table = table.combine_chunks()
        asked, wanted = table["query_id"].combine_chunks(), np.array([w or "" for w in table["wanted"].to_pylist()], object)
        bits = np.frombuffer(b"".join(table["cells"].to_pylist()), np.uint8).reshape(len(asked), -1)
        cells = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0), count=n_cells)) if len(asked) else np.zeros(0, int)
        floor = table["floor"].to_numpy() if "floor" in table.column_names else None
        x = _asked(table["embedding"].combine_chunks(), dim) if len(asked) else np.zeros((0, dim))
        held = index.spark.sparkContext.broadcast((asked, wanted, x, bits, floor))
        shelves = sorted({int(c) // -(-n_cells // SHELVES) for c in cells})
        blocks = index.blocks().where(F.col("shelf").isin(shelves) & F.col("cell").isin(cells.tolist())).select("cell", "ids", "labels", "x")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, wanted, x, bits, floor = held.value
            best, kind = Best(len(asked), k, floor), None
            for batch in batches:
                kind = batch.schema.field("ids").type.value_type
                for i in range(batch.num_rows):
                    c = batch.column("cell")[i].as_py()
                    sent = np.flatnonzero(bits[:, c >> 3] >> (7 - (c & 7)) & 1)
                    ids, v = batch.column("ids")[i].values.to_numpy(zero_copy_only=False), np.frombuffer(batch.column("x")[i].as_buffer()).reshape(-1, dim)
                    labels = np.array(batch.column("labels")[i].as_py(), object) if (wanted != "").any() else None
                    for a in range(0, len(sent), GROUP):
                        of = sent[a : a + GROUP]
                        score = x[of] @ v.T
                        if labels is not None:
                            score[(wanted[of] != "")[:, None] & (wanted[of][:, None] != labels[None, :])] = -np.inf
                        best.add(of, score, ids)
            if kind is not None:
                yield best.batch(asked, kind)

        return blocks.mapInArrow(run, f"query_id {_id_type(probed, 'query_id')}, chunk_id {index.id_type}, score double")

    return in_parts(probed, lambda n: n * (8 * dim + n_cells // 8 + 64), search)


def _floors(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits, k).where(F.col("rank0") == k - 1).select("query_id", F.col("score").alias("floor"))


def _passes(queries: DataFrame, index: VectorIndex, k: int, sureness: float | None, label: str | None) -> tuple[DataFrame, list[DataFrame]]:
    """(hits, the queries of both passes with their cells)."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    wanted: Column = F.coalesce(F.col(label).cast("string"), F.lit("")) if label else F.lit("")
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), wanted.alias("wanted")).where(fine & (F.size("embedding") > 0))
    if label:
        held = index.blocks().select(F.explode("labels").alias("wanted")).where("wanted is not null").groupBy("wanted").agg((F.count("*") / max(index.n, 1)).alias("share"))
        asked = asked.join(held, "wanted", "left").withColumn("share", F.when(F.col("wanted") == "", 1.0).otherwise(F.coalesce("share", F.lit(1.0))))
    else:
        asked = asked.withColumn("share", F.lit(1.0))
    asked = checkpointed(asked.select("query_id", "embedding", "wanted", "share"))
    one = checkpointed(_probed(asked, index, k, sureness, False))
    first = checkpointed(_scored(one, index, k))
    floors = asked.join(_floors(first, k), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    two = checkpointed(_probed(floors, index, k, sureness, True))
    return first.unionByName(_scored(two, index, k)), [one, two]


def search_vectors(queries: DataFrame, index: VectorIndex, k: int = 20, sureness: float | None = SURENESS, label: str | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank0 of the k vectors with the largest dot product, as good as all of them found.

    sureness: standard deviations by which a cell's vectors may lie nearer to a
    query than its centre; None takes its whole radius and is exact. label: a
    column of queries that holds what the vectors' label must be (null or empty:
    anything). Queries that are null or not finite find nothing; an id of
    queries must stand in one row. There is no distance cut: a query has k hits
    if there are k vectors.
    """
    if not index.n:
        return queries.select("query_id", F.lit(None).cast(index.id_type).alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank0")).where("false")
    return top_k(_passes(queries, index, k, sureness, label)[0], k)


def search_work(queries: DataFrame, index: VectorIndex, k: int = 20, sureness: float | None = SURENESS, label: str | None = None) -> DataFrame:
    """query_id, n_cells, n_scored: the cells that search_vectors probes for each query, and their vectors."""
    _, passes = _passes(queries, index, k, sureness, label)
    sizes = index.sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(sizes)).astype(np.int64) for x in batch.column("cells").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array([int(x.sum()) for x in chosen], pa.int64()), pa.array([int(x @ sizes) for x in chosen], pa.int64())], names=["query_id", "n_cells", "n_scored"])

    rows = passes[0].select("query_id", "cells").unionByName(passes[1].select("query_id", "cells"))
    each = rows.mapInArrow(run, f"query_id {_id_type(rows, 'query_id')}, n_cells long, n_scored long")
    return each.groupBy("query_id").agg(F.sum("n_cells").alias("n_cells"), F.sum("n_scored").alias("n_scored")).where("n_cells > 0")
