"""Cutting documents into chunks by sections and shifts of topic."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazmill.functions import labels as L
from hazmill.functions import text as T
from hazmill.functions.scoring import settled
from hazmill.operators.corpus import sections_of
from hazmill.operators.postings import TERM_BYTES
from hazmill.operators.retrieval import hash_embed

THRESHOLD, MIN_WORDS, MAX_WORDS, FRONT = 0.5, 40, 220, 8000
#: Documents whose sentences are hashed at once.
TOGETHER = 64


def adjacent_similarity(sentences: DataFrame, digest: str = "crc32") -> DataFrame:
    """Rows (doc_id, section_no, place, sentence) with sim: the cosine to the sentence before, null for the first."""
    keyed = sentences.select(F.struct("doc_id", "section_no", "place").alias("k"), F.col("sentence").alias("text"))
    v = hash_embed(keyed, "k", digest=digest).select("k.*", "bucket", "value")
    before = v.select("doc_id", "section_no", (F.col("place") + 1).alias("place"), "bucket", F.col("value").alias("other"))
    cosine = v.join(before, ["doc_id", "section_no", "place", "bucket"]).groupBy("doc_id", "section_no", "place").agg(F.sum(F.col("value") * F.col("other")).alias("sim"))
    return sentences.join(cosine, ["doc_id", "section_no", "place"], "left").withColumn("sim", F.when(F.col("place") > 0, F.round(F.coalesce("sim", F.lit(0.0)), 9)))


def similarities(sentences: list[str], digest: str = "crc32", dim: int = 384) -> np.ndarray:
    """As adjacent_similarity for sentences in a row: the cosine of each to the one before, 0 for the first."""
    lists = pc.ascii_split_whitespace(pa.array([s.lower().encode().translate(TERM_BYTES) for s in sentences], pa.large_binary()).cast(pa.large_string()))
    coded, owner = lists.flatten().dictionary_encode(), np.repeat(np.arange(len(sentences)), np.diff(lists.offsets.to_numpy()))
    number = zlib.crc32 if digest == "crc32" else lambda t: int(hashlib.md5(t).hexdigest()[:8], 16)
    buckets = np.array([number(t.encode()) % dim if t else -1 for t in coded.dictionary.to_pylist()], np.int64)
    bucket = buckets[coded.indices.to_numpy()] if len(buckets) else np.zeros(0, np.int64)
    key, n = np.unique((owner * dim + bucket)[bucket >= 0], return_counts=True)
    of = key // dim
    value = n / np.sqrt(np.bincount(of, n.astype(np.float64) ** 2, len(sentences)))[of]
    # the same bucket of the sentence before
    at = np.minimum(np.searchsorted(key, key - dim), len(key) - 1)
    both = key[at] == key - dim
    return np.round(np.bincount(of[both], (value * value[at])[both], len(sentences)), 9)


def _starts(sims: list[float], words: list[int], threshold: float, min_words: int, max_words: int) -> list[int]:
    """The sentences of a section that begin a chunk."""
    starts, held = [], 0
    for i, (sim, n) in enumerate(zip(sims, words, strict=True)):
        if i == 0 or (sim < threshold and held >= min_words) or held >= max_words:
            starts.append(i)
            held = 0
        held += n
    return starts


def _pieces(docs: DataFrame, threshold: float, min_words: int, max_words: int, digest: str) -> DataFrame:
    """docs' columns but text, with idx, section and text of each chunk. A document stays one row until it is cut: nothing is shuffled."""
    kept = [c for c in docs.columns if c != "text"]
    cut = F.transform(sections_of(F.col("text")), lambda s: F.struct(s["heading"].alias("heading"), s["body"].alias("body"), T.split_sentences(s["body"]).alias("sentences")))
    rows = settled(docs.select(*kept, cut.alias("sections")), {"words": F.transform("sections", lambda s: F.transform(s["sentences"], T.word_count))})

    def begin(sentences: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(sentences), TOGETHER):
            some, counts = sentences.iloc[a : a + TOGETHER], words.iloc[a : a + TOGETHER]
            sims, at = similarities([x for d in some for s in d for x in s], digest).tolist(), 0
            for d, n in zip(some, counts, strict=True):
                ends = np.cumsum([at, *map(len, d)]).tolist()
                out.append([_starts(sims[i:j], w.tolist(), threshold, min_words, max_words) for i, j, w in zip(ends, ends[1:], n, strict=False)])
                at = ends[-1]
        return pd.Series(out, index=sentences.index, dtype=object)

    rows = rows.withColumn("starts", F.pandas_udf(begin, "array<array<int>>")("sections.sentences", "words"))

    def texts(s: Column, starts: Column) -> Column:
        until = lambda i: F.coalesce(F.try_element_at(starts, i + 2), F.size(s["sentences"]))
        many = F.transform(starts, lambda f, i: F.array_join(F.slice(s["sentences"], f + 1, until(i) - f), " "))
        return F.transform(F.when(F.size(s["sentences"]) < 2, F.array(s["body"])).otherwise(many), lambda t: F.struct(s["heading"].alias("section"), t.alias("text")))

    pieces = F.flatten(F.zip_with("sections", "starts", texts))
    return rows.select(*kept, F.posexplode(pieces).alias("idx", "p")).select(*kept, "idx", "p.section", "p.text")


def semantic_chunks(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS, digest: str = "crc32") -> DataFrame:
    """doc_id, idx, section, text: a chunk ends before a sentence once it is long enough and the topic shifts, or is full. A section of one sentence stays as it is."""
    return _pieces(docs.select("doc_id", "text"), threshold, min_words, max_words, digest)


def chunk_ids(source: Column, idx: Column, text: Column) -> Column:
    """source::index::first ten hex digits of the text's SHA-1."""
    return F.concat_ws("::", source, idx.cast("string"), F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 10))


def document_metadata(docs: DataFrame) -> DataFrame:
    """docs(name, text) with title, source_document, industry, severity, hazard_type and incident_date."""
    text = F.col("text")
    return docs.withColumns(
        {
            "title": T.document_title(F.col("name")),
            "source_document": F.col("name"),
            "industry": L.detect_industry(text),
            "severity": L.classify_severity(text),
            "hazard_type": L.detect_hazard_type(text),
            "incident_date": T.detect_date(text, FRONT),
        }
    )


def regulation_metadata(docs: DataFrame) -> DataFrame:
    """docs(name, text) with regulation_name, clause_family and hazard_type."""
    from hazmill.operators.retrieval import clause_family

    name = T.document_title(F.col("name"))
    return docs.withColumns({"regulation_name": name, "clause_family": clause_family(name, F.lit("")), "hazard_type": L.detect_hazard_type(F.substring("text", 1, FRONT))})


def index_documents(docs: DataFrame, collection: str, digest: str = "crc32") -> DataFrame:
    """Chunks of docs(doc_id, name, text and labels) with ids, the collection and the document's labels on each."""
    pieces = _pieces(docs, THRESHOLD, MIN_WORDS, MAX_WORDS, digest)
    return pieces.withColumns({"chunk_id": chunk_ids(F.col("name"), F.col("idx"), F.col("text")), "collection": F.lit(collection)})


def attach_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks with the embedding that a table (chunk_id, embedding) has for them."""
    return chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")
