"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word: a run of characters other than ASCII white space. The same pattern works in Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(docs: DataFrame) -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def keyed_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns alone, so that other columns cannot clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), *[docs[c] for c in more])


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def put_together(df: DataFrame, rows: int, task: int = 100_000) -> DataFrame:
    """df, of so many rows at most, in as many tasks as they fill."""
    return df.coalesce(1 + rows // task)


def cut_lineage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Checkpoint to the shared folder that the session names in spark.checkpoint.dir.

    rows: about how many there are, if that is known; few rows are not spread
    over more files than they fill.
    """
    if rows is not None:
        df = put_together(df, rows)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; there is no other way to hand over what is written."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: what several readers need, smaller than a checkpoint."""
    to = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


#: Bits of a filter: two MB, whatever it holds; one that fills up lets more through, and never keeps back what it was given.
FILTER_BITS = 1 << 24


def bit_filter(hashes: DataFrame) -> Broadcast:
    """A broadcast filter (FILTER_BITS, packed) of the long column h, of which the low bits count; the driver receives its words alone."""
    slot = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = hashes.groupBy(F.shiftrightunsigned(slot, 15).alias("word")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in words.toLocalIterator():
        out[r.word * 4096 : r.word * 4096 + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each hash."""
    slot = hashes.astype(np.uint64) & np.uint64(FILTER_BITS - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def scan_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], dict]], fields: str) -> DataFrame:
    """doc_id and, for each text (null: empty), the fields that a function gives for a run of texts; make builds it once for each task.

    Ids stay in Arrow: a null among them turns none of the others into a float.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *T.StructType.fromDDL(fields)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = make()
        for batch in batches:
            for a, b in runs(pc.utf8_length(batch.column("text")).to_pylist()):
                found = measure(batch.column("text").slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array(found[f.name], type=f.type) for f in list(arrow)[1:]]], schema=arrow)

    return keyed_texts(docs).mapInArrow(run, schema)


def scan_rows(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch, list], pa.RecordBatch]]) -> DataFrame:
    """docs with each batch of rows as a function of (rows, their texts) leaves it; the columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for batch in batches:
            for a, b in runs(pc.utf8_length(batch.column("text").fill_null("")).to_pylist()):
                part = batch.slice(a, b - a)
                yield change(part, part.column("text").to_pylist())

    return docs.mapInArrow(run, docs.schema)


def chunks(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most so many characters together, or one longer text alone: bounds a task's memory."""
    return runs(list(map(len, texts)), most)


def runs(lengths: list[int], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """As chunks, from the texts' lengths alone."""
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Edges that a task holds at once.
RUN_EDGES = 1_000_000


def reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nodes of some edges in order, the smallest node that each reaches over them)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = lo < hi
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, hi[apart], lo[apart])
        while (root[root] != root).any():
            root = root[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: what their runs of RUN_EDGES connect, with an edge a node at most."""
    held: list[pa.RecordBatch] = []

    def star() -> pa.RecordBatch:
        nodes, roots = reached(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
        held.clear()
        return pa.RecordBatch.from_pydict({"a": nodes, "b": roots})

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= RUN_EDGES:
            yield star()
    if held:
        yield star()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, component being the smallest node.

    Each task first makes stars of its own edges. Up to RUN_EDGES of their edges
    are put together and made stars once more, which are the components; more go
    through rounds. Each round gives every node the smallest label among its
    neighbours' and then follows labels once more (pointer jumping), so that
    stars and chains both shrink fast. Labels meet in a partial aggregation by
    node, so a node of any degree costs each map task one row. Nodes without
    edges are not returned; null ends are ignored.
    """
    named = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    both = cut_lineage(named.mapInArrow(_stars, "a long, b long"))
    size = both.count()
    if size <= RUN_EDGES:
        return both.coalesce(1).mapInArrow(_stars, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("component"))
    both = both.where("a <> b").distinct()
    both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), 2 * size)
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), size)
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        pulled = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("next"))
        # the old label's node hears of the new one too: hooks whole trees together
        hooks = pulled.where("next < label").groupBy(F.col("label").alias("node")).agg(F.min("next").alias("hook"))
        pulled = pulled.join(hooks, "node", "left").select("node", "label", F.least("next", "hook").alias("next"))
        jump = pulled.select(F.col("node").alias("next"), F.col("next").alias("root"))
        new = cut_lineage(pulled.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("root", "next")).alias("next")), size)
        moved = not new.where("next <> label").isEmpty()
        labels = new.select("node", F.col("next").alias("label"))
        if not moved:
            return labels.withColumnRenamed("label", "component")
