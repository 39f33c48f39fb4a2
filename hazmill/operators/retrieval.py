"""Searching: exact and approximate vector search, BM25 (see postings), rank fusion, compression of hits.

Every function works for a table of queries at once; query_id leads every key.
Orders end with the chunk's id, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazmill.functions import text as T
from hazmill.operators.best import Best, in_parts, top_k
from hazmill.operators.postings import Bm25Index, add_chunks, bm25_search, build_bm25, merge_segments  # noqa: F401
from hazmill.sources.shared import checkpointed, new_folder

RRF_K, CANDIDATES, RELEVANCE = 60, 20, 0.3
#: Rows of a block in exact search, and of one of hashed tokens.
QUERY_BLOCK, DATA_BLOCK, HASHED_BLOCK = 512, 2048, 1024


# -- vectors ---------------------------------------------------------------


def hash_buckets(text: Column, dim: int = 384, digest: str = "crc32") -> Column:
    """For each token its bucket, in text order."""
    if digest == "crc32":
        number = lambda t: F.crc32(F.encode(t, "UTF-8"))
    else:
        number = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long")
    return F.transform(T.tokenize(text), lambda t: (number(t) % dim).cast("int"))


def hash_embed(rows: DataFrame, key: str, dim: int = 384, digest: str = "crc32") -> DataFrame:
    """key, bucket, value: unit vectors of token counts, only their non-zero places."""
    counts = rows.select(key, F.explode(hash_buckets(F.col("text"), dim, digest)).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("value"))


def metadata_filter(wanted: Column, own: Column) -> Column:
    """Holds if nothing is wanted (null or empty) or the row has exactly it."""
    return wanted.isNull() | (wanted.cast("string") == "") | (own == wanted)


def _id_type(rows: DataFrame, key: str) -> str:
    return rows.schema[key].dataType.simpleString()


def matrix(lists: pa.Array, dim: int | None = None) -> np.ndarray:
    """A row for each list of numbers; all must be of one length (dim, if that is given). Null numbers are not finite."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    dim = int(length[0]) if dim is None and len(length) else dim or 0
    if (length != dim).any():
        raise ValueError("vectors that are compared must be of one length")
    return flat.reshape(len(lists), dim)


def _labels(values: pa.Array) -> np.ndarray:
    return np.array([v or "" for v in values.to_pylist()], dtype=object)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, label: str | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank0 of the k vectors with the largest dot product, exactly.

    queries(query_id, embedding) are given to each task, which reads
    vectors(chunk_id, embedding) block by block: a pair of blocks is one matrix
    product, and a task leaves k rows for each query. With a label column on
    both sides only vectors of equal labels meet.
    """
    named = lambda rows, key: rows.where("embedding is not null").select(key, "embedding", (F.col(label).cast("string") if label else F.lit("")).alias("label")).where("label is not null")
    q, v = named(queries, "query_id"), named(vectors, "chunk_id")
    longest = q.agg(F.max(F.size("embedding"))).first()[0] or 0

    def search(table: pa.Table) -> DataFrame:
        asked, wanted, x = table["query_id"].combine_chunks(), np.array(table["label"].to_pylist(), dtype=object), matrix(table["embedding"])
        held = q.sparkSession.sparkContext.broadcast((asked, wanted, x))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, wanted, x = held.value
            best, kind = Best(len(asked), k), None
            for batch in batches:
                kind = batch.schema.field("chunk_id").type
                for a in range(0, batch.num_rows if len(asked) else 0, DATA_BLOCK):
                    part = batch.slice(a, DATA_BLOCK)
                    ids, y, own = part.column("chunk_id").to_numpy(zero_copy_only=False), matrix(part.column("embedding"), x.shape[1]), np.array(part.column("label").to_pylist(), dtype=object)
                    for value in set(own) & set(wanted) if label else ("",):
                        of, at = np.flatnonzero(wanted == value), np.flatnonzero(own == value)
                        for b in range(0, len(of), QUERY_BLOCK):
                            best.add(of[b : b + QUERY_BLOCK], x[of[b : b + QUERY_BLOCK]] @ y[at].T, ids[at])
            if kind is not None:
                yield best.batch(asked, kind)

        return v.mapInArrow(run, f"query_id {_id_type(queries, 'query_id')}, chunk_id {_id_type(vectors, 'chunk_id')}, score double")

    return top_k(in_parts(q, lambda n: n * 8 * longest, search), k)


def approx_dense_search(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, sureness: float = 3.0) -> DataFrame:
    """As dense_search, nearly: through an index of trained cells that is made for this search. Keep a vector_index to search more than once."""
    from hazmill.operators.vector_index import build_vector_index, search_vectors

    return search_vectors(queries, build_vector_index(vectors, new_folder(vectors.sparkSession, "vectors")), k, sureness)


def hashed_search(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES, filters: tuple[str, ...] = (), dim: int = 384, digest: str = "crc32") -> DataFrame:
    """query_id, chunk_id, score, rank0: cosine of hashed token counts, of chunks that share a place with the query.

    Tokens are hashed in the JVM; tasks pack them to blocks of dense vectors,
    which meet the queries as in dense_search. filters names columns that hold,
    in a query, what the chunk's column must be (null or empty: anything).
    """

    def placed(rows: DataFrame, key: str) -> DataFrame:
        places = hash_buckets(F.coalesce(F.col("text"), F.lit("")), dim, digest).alias("places")
        return rows.select(key, places, *[F.col(c).cast("string").alias(c) for c in filters])

    def counted(places: pa.Array) -> np.ndarray:
        n = pc.list_value_length(places).to_numpy(zero_copy_only=False)
        x = np.bincount(np.repeat(np.arange(len(n)), n) * dim + places.flatten().to_numpy(), minlength=len(n) * dim).reshape(-1, dim).astype(np.float64)
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)

    def search(table: pa.Table) -> DataFrame:
        asked, x = table["query_id"].combine_chunks(), counted(table["places"].combine_chunks())
        held = queries.sparkSession.sparkContext.broadcast((asked, x, [_labels(table[c]) for c in filters]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, x, wanted = held.value
            best, kind = Best(len(asked), k), None
            for batch in batches:
                kind = batch.schema.field("chunk_id").type
                for a in range(0, batch.num_rows if len(asked) else 0, HASHED_BLOCK):
                    part = batch.slice(a, HASHED_BLOCK)
                    ids, y, own = part.column("chunk_id").to_numpy(zero_copy_only=False), counted(part.column("places")), [_labels(part.column(c)) for c in filters]
                    for b in range(0, len(asked), QUERY_BLOCK):
                        score = x[b : b + QUERY_BLOCK] @ y.T
                        score[score <= 0] = -np.inf
                        for of, its in zip(wanted, own, strict=True):
                            of = of[b : b + QUERY_BLOCK]
                            score[(of != "")[:, None] & (of[:, None] != its[None, :])] = -np.inf
                        best.add(np.arange(b, b + len(score)), score, ids)
            if kind is not None:
                yield best.batch(asked, kind)

        return placed(chunks, "chunk_id").mapInArrow(run, f"query_id {_id_type(queries, 'query_id')}, chunk_id {_id_type(chunks, 'chunk_id')}, score double")

    return top_k(in_parts(placed(queries, "query_id"), lambda n: n * 8 * dim, search), k)


# -- fusion and what follows -----------------------------------------------


def reciprocal_rank_fusion(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, fused, rank0 from lists (query_id, chunk_id, rank0); ties keep the order of first sight."""
    all_ = None
    for i, ranked in enumerate(lists):
        one = ranked.select("query_id", "chunk_id", "rank0", F.lit(i).alias("list_no"))
        all_ = one if all_ is None else all_.unionByName(one)
    fused = all_.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (F.col("rank0") + k)).alias("fused"), F.min(F.struct("list_no", "rank0")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.round("fused", 12).desc(), "seen")
    return fused.withColumn("rank0", F.row_number().over(order) - 1).select("query_id", "chunk_id", "fused", "rank0")


def candidates(fused: DataFrame, chunks: DataFrame, dense: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """The first hits that have a payload with text, with the dense score or 0 and the chunk's columns."""
    found = fused.join(chunks.where(F.coalesce("text", F.lit("")) != ""), "chunk_id").join(dense.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy("rank0")
    return found.withColumn("rank0", F.row_number().over(order) - 1).where(F.col("rank0") < limit).withColumn("score", F.coalesce("score", F.lit(0.0)))


def fetch_payloads(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of the given chunk_ids."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def rerank(hits: DataFrame, k: int, scores: DataFrame | None = None) -> DataFrame:
    """The best k by a supplied (query_id, chunk_id, score) table, or in the given order."""
    if scores is None:
        order = Window.partitionBy("query_id").orderBy("rank0")
        return hits.withColumn("rank0", F.row_number().over(order) - 1).where(F.col("rank0") < k)
    given = hits.drop("score").join(scores, ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "rank0")
    return given.withColumn("rank0", F.row_number().over(order) - 1).where(F.col("rank0") < k)


def compress(hits: DataFrame, queries: DataFrame, threshold: float = RELEVANCE, dim: int = 384, digest: str = "crc32") -> DataFrame:
    """query_id, chunk_id, text: the sentences near the query, or the nearest one; single sentences stay."""
    cut = hits.select("query_id", "chunk_id", T.split_sentences(F.col("text")).alias("sentences"), T.strip(F.col("text")).alias("whole"))
    rows = cut.select("query_id", "chunk_id", F.posexplode("sentences").alias("place", "sentence"))
    key = rows.select(F.struct("query_id", "chunk_id", "place").alias("s"), F.col("sentence").alias("text"))
    sentence = hash_embed(key, "s", dim, digest).select("s.*", "bucket", "value")
    query = hash_embed(queries, "query_id", dim, digest).withColumnRenamed("value", "q")
    cosine = sentence.join(query, ["query_id", "bucket"]).groupBy("query_id", "chunk_id", "place").agg(F.round(F.sum(F.col("q") * F.col("value")), 9).alias("cosine"))
    scored = rows.join(cosine, ["query_id", "chunk_id", "place"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    by = scored.groupBy("query_id", "chunk_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("cosine") >= threshold, F.struct("place", "sentence")))).alias("kept"),
        F.max(F.struct("cosine", (-F.col("place")).alias("early"), "sentence"))["sentence"].alias("best"),
    )
    text = F.when(F.size("sentences") < 2, F.col("whole")).when(F.size("kept") > 0, F.array_join("kept.sentence", " ")).otherwise(F.col("best"))
    return cut.join(by, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", text.alias("text"))


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 8,
    filters: tuple[str, ...] = (),
    compressed: bool = True,
    scores: DataFrame | None = None,
    index: Bm25Index | None = None,
    digest: str = "crc32",
) -> DataFrame:
    """Both arms, fused, cut to candidates, reranked and compressed: the chunks' columns with query_id, score, rank0.

    filters names columns of queries that hold what a chunk's column of the same
    name must be; they bind the dense arm alone. Queries that are alike are
    searched once, unless scores are supplied for each.
    """
    if scores is None:
        classed = checkpointed(_classed(queries, ("text", *filters)))
        if classed.isEmpty():  # nothing is asked, so no index is made
            return _no_hits(queries, chunks)
        hits = _hybrid_search(classed.where("query_id = asked").drop("asked"), chunks, k, filters, compressed, None, index, digest)
        own = classed.select("query_id", "asked").distinct()
        return hits.withColumnRenamed("query_id", "asked").join(own, "asked").select(*hits.columns)
    return _hybrid_search(queries, chunks, k, filters, compressed, scores, index, digest)


def _no_hits(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    return chunks.limit(0).select("*", F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), *[F.lit(0.0).alias(c) for c in ("fused", "score")], F.lit(0).alias("rank0"))


def _classed(queries: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """queries with asked: the smallest query_id of those alike in columns; an id of several rows asks for itself."""
    rows = queries.withColumn("many", F.count("*").over(Window.partitionBy("query_id")) > 1)
    first = F.min("query_id").over(Window.partitionBy(*columns, "many"))
    return rows.withColumn("asked", F.when(F.col("many"), F.col("query_id")).otherwise(first)).drop("many")


def _hybrid_search(queries: DataFrame, chunks: DataFrame, k: int, filters: tuple[str, ...], compressed: bool, scores: DataFrame | None, index: Bm25Index | None, digest: str) -> DataFrame:
    sparse = bm25_search(queries, index or build_bm25(chunks), CANDIDATES)
    dense = checkpointed(hashed_search(queries, chunks, CANDIDATES, filters, digest=digest))
    hits = rerank(candidates(reciprocal_rank_fusion(dense, sparse), chunks, dense), k, scores)
    if not compressed:
        return hits
    hits = checkpointed(hits)
    return hits.drop("text").join(compress(hits, queries, digest=digest), ["query_id", "chunk_id"])


def hybrid_search_incidents(queries: DataFrame, chunks: DataFrame, k: int = 8, digest: str = "crc32", **more) -> DataFrame:
    """Filtered by industry first; a query left with under half of k hits takes the unfiltered search instead."""
    if queries.isEmpty():
        return _no_hits(queries, chunks)
    more.setdefault("index", build_bm25(chunks))
    filtered = checkpointed(hybrid_search(queries, chunks, k, ("industry",), digest=digest, **more))
    enough = filtered.groupBy("query_id").count().where(F.col("count") >= max(k // 2, 1)).select("query_id")
    # a query without an industry is unfiltered either way
    free = hybrid_search(queries.join(enough, "query_id", "left_anti"), chunks, k, digest=digest, **more)
    return filtered.join(enough, "query_id", "left_semi").unionByName(free)


# -- shapes of results -----------------------------------------------------


def rank_confidence(rank0: Column) -> Column:
    return F.round(F.greatest(F.lit(0.9) - F.lit(0.12) * rank0, F.lit(0.1)), 2)


def to_similar_incident(hits: DataFrame) -> DataFrame:
    """Hits as incidents, with their defaults; missing columns count as null."""
    col = lambda c: F.col(c) if c in hits.columns else F.lit(None).cast("string")
    source = F.coalesce(col("source_document"), F.lit("unknown"))
    return hits.select(
        "query_id",
        "rank0",
        F.col("chunk_id").alias("doc_id"),
        F.coalesce(F.when(col("title") != "", col("title")), source).alias("title"),
        F.coalesce(col("industry"), F.lit("unknown")).alias("industry"),
        F.coalesce(col("severity"), F.lit("UNKNOWN")).alias("severity"),
        rank_confidence(F.col("rank0")).alias("similarity_score"),
        F.col("text").alias("chunk_excerpt"),
        source.alias("source_document"),
        col("incident_date").alias("incident_date"),
        F.filter(F.split(F.coalesce(col("hazard_type"), F.lit("")), ","), lambda t: t != "").alias("hazard_tags"),
    )


def clause_family(name: Column, section: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """The first rule that matches the citation; else the general duty clause."""
    from hazmill.functions.taxonomy import CLAUSE_RULES

    cited = F.concat_ws(" ", name, section)
    out = None
    for regex, family in CLAUSE_RULES if rules is None else rules:
        out = F.when(cited.rlike(regex), family) if out is None else out.when(cited.rlike(regex), family)
    return out.otherwise("general_duty_clause")


def to_clause(hits: DataFrame) -> DataFrame:
    """Hits of a search over regulations as clauses; source_document stays as a column."""
    name = F.coalesce(F.when(F.col("regulation_name") != "", F.col("regulation_name")), F.col("source_document"))
    family = clause_family(name, F.coalesce("section", F.lit("")))
    why = F.concat(F.lit("Retrieved from "), "source_document", F.lit(" as a "), F.replace(family, F.lit("_"), F.lit(" ")), F.lit(" requirement matching the reported hazard."))
    return hits.select(
        "query_id",
        "rank0",
        F.col("chunk_id").alias("clause_id"),
        name.alias("regulation_name"),
        F.coalesce("section", F.lit("")).alias("section"),
        F.col("text").alias("clause_text"),
        rank_confidence(F.col("rank0")).alias("violation_confidence"),
        why.alias("relevance_explanation"),
        family.alias("family"),
        "source_document",
    )


def retrieve_clauses(queries: DataFrame, regulations: DataFrame, k: int = 6, **more) -> DataFrame:
    """Clauses for each query; hazard_type and industry filter the dense arm, and a chunk without one fails it."""
    for c in ("hazard_type", "industry"):
        if c not in regulations.columns:
            regulations = regulations.withColumn(c, F.lit(None).cast("string"))
    return to_clause(hybrid_search(queries, regulations, k, ("hazard_type", "industry"), **more))


def violated_families(clauses: DataFrame, floor: float = 0.35) -> DataFrame:
    """query_id, families: the sorted distinct families of clauses with enough confidence."""
    return clauses.where(F.col("violation_confidence") >= floor).groupBy("query_id").agg(F.array_sort(F.collect_set("family")).alias("families"))


def verbatim_check(clauses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sentences of clauses that their source chunk does not contain."""
    sentence = clauses.select("query_id", "clause_id", F.explode(T.split_sentences(F.col("clause_text"))).alias("sentence"))
    source = chunks.select(F.col("chunk_id").alias("clause_id"), F.col("text").alias("source_text"))
    return sentence.join(source, "clause_id", "left").where(~F.coalesce(F.col("source_text").contains(F.col("sentence")), F.lit(False))).select("query_id", "clause_id", "sentence")
