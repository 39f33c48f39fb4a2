"""Reading corpora and keeping indexes, graphs and reports as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazmill.functions.text import normalize_text

INDEX_SCHEMA = "chunk_id string, collection string, text string, source_document string, section string, embedding array<float>"


def read_text_corpus(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """doc_id, name, collection, text: the .txt files of a folder, normalised, by name."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return files.select(F.regexp_replace(name, r"\.txt$", "").alias("doc_id"), name.alias("name"), F.lit(collection).alias("collection"), normalize_text(F.col("value")).alias("text")).orderBy("name")


def write_index(chunks: DataFrame, path: str) -> None:
    """Replaces the collections that chunks holds and leaves the others."""
    (chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# A stored table is a folder of numbered versions (v=N) and of a marker for each
# that was finished. A base version holds the whole table, an addition rows that
# replace older ones of the same key. What a crash leaves has no marker and is
# never read, and nothing that is read is moved, so a retry simply adds a version.

#: Additions after which the table is written anew as a base.
COMPACT_AFTER = 20


def _names(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions that make up the table: the last base and what came after it."""
    marks = sorted(n.split(".") for n in _names(spark, f"{path}/_finished") if not n.startswith("."))
    last = max((i for i, (_, kind) in enumerate(marks) if kind == "base"), default=0)
    return [int(n) for n, _ in marks[last:]]


def _add(df: DataFrame, path: str, kind: str) -> None:
    spark = df.sparkSession
    taken = [int(n[2:]) for n in _names(spark, path) if n.startswith("v=")]
    number = max(taken, default=0) + 1
    df.write.parquet(f"{path}/v={number}")
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_finished/{number:09d}.{kind}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, False).close()


def replace_table(df: DataFrame, path: str) -> None:
    """df becomes the table; readers see the old rows or the new ones, whatever fails. df may read the table."""
    _add(df, path, "base")


def read_stored(spark: SparkSession, path: str, key: str | None = None) -> DataFrame | None:
    """The table's rows, of each key the latest; None if nothing is stored."""
    numbers = versions(spark, path)
    if not numbers:
        return None
    if len(numbers) == 1:
        return spark.read.parquet(f"{path}/v={numbers[0]}")
    every = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*[f"{path}/v={n}" for n in numbers])
    newest = every.withColumn("newest", F.max("v").over(Window.partitionBy(key)))
    return newest.where("v = newest").drop("v", "newest")


def upsert(rows: DataFrame, path: str, key: str) -> None:
    """Rows of a new key are added, rows of a known key replace it; doing it again changes nothing. Only the new rows are written, but for a rewrite now and then."""
    spark = rows.sparkSession
    known = versions(spark, path)
    _add(rows, path, "add" if known else "base")
    if len(known) >= COMPACT_AFTER:
        replace_table(read_stored(spark, path, key), path)


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def load_index(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """The collection's chunks; an empty index if there is none or if ids, texts and vectors do not belong together.

    They do if every chunk has all three, no id comes twice, and all vectors are
    of one length.
    """
    empty = spark.createDataFrame([], T._parse_datatype_string(INDEX_SCHEMA))
    if not _exists(spark, path):
        return empty
    chunks = spark.read.parquet(path).where(F.col("collection") == collection)
    missing = F.count_if(F.col("chunk_id").isNull() | F.col("text").isNull() | F.col("embedding").isNull())
    by_id = chunks.groupBy("chunk_id").agg(F.count("*").alias("n"), missing.alias("missing"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"))
    n, gaps, low, high = by_id.agg(F.max("n"), F.sum("missing"), F.min("lo"), F.max("hi")).first()
    return chunks if n == 1 and not gaps and low == high else empty


def corpus_manifest(chunks: DataFrame) -> DataFrame:
    """document_count, chunk_count; at least 1 document, as what divides by it expects."""
    return chunks.agg(F.greatest(F.countDistinct("source_document"), F.lit(1)).alias("document_count"), F.count("*").alias("chunk_count"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    replace_table(nodes, f"{path}/nodes")
    replace_table(edges, f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); empty ones if nothing is stored."""
    nodes, edges = read_stored(spark, f"{path}/nodes"), read_stored(spark, f"{path}/edges")
    if nodes is None or edges is None:
        none = lambda s: spark.createDataFrame([], T._parse_datatype_string(s))
        return none("node_id string, label string, node_type string, industry string, severity string"), none("src string, dst string, relation string, edge_seq int")
    return nodes, edges


def read_node_link_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link JSON file."""
    schema = "nodes array<struct<id:string,label:string,node_type:string,industry:string,severity:string>>, links array<struct<source:string,target:string,relation:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("g"))
    nodes = raw.select(F.explode("g.nodes").alias("n")).select(F.col("n.id").alias("node_id"), "n.label", "n.node_type", "n.industry", "n.severity")
    edges = raw.select(F.posexplode("g.links").alias("edge_seq", "e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.relation", "edge_seq")
    return nodes, edges


def analysis_rows(reports: DataFrame, status: str = "complete") -> DataFrame:
    """Assembled reports as stored rows: keys and summary columns beside the whole report as JSON; errors cut to 1,024 characters."""
    return reports.select(
        "created_at",
        F.col("analysis_id").alias("id"),
        "file_name",
        F.lit(status).alias("status"),
        F.col("severity_indicator").alias("severity"),
        "industry",
        F.col("risk.total").alias("risk_total"),
        F.substring("error", 1, 1024).alias("error"),
        F.to_json(F.struct("*")).alias("report"),
    )


def find_report(spark: SparkSession, path: str, analysis_id: int) -> DataFrame | None:
    """get_report over a table of buckets by id; None if no file may hold it."""
    from hazmill.sources.keyed import find

    rows = find(spark, path, "id", [analysis_id])
    return None if rows is None else get_report(rows, analysis_id)


def get_report(analyses: DataFrame, analysis_id: int) -> DataFrame:
    return analyses.where((F.col("id") == analysis_id) & F.col("report").isNotNull())
