"""BM25 over packed postings against plain scoring of every chunk, and an index that grows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from hazmill.operators import postings as P


def plain(chunks, queries, k):
    docs = [(i, Counter(re.findall("[a-z0-9]+", (t or "").lower()))) for i, t in chunks]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / max(len(docs), 1)
    df = Counter(t for _, c in docs for t in c)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    low = 0.25 * sum(raw.values()) / max(len(raw), 1)
    out = set()
    for q, text in queries:
        asked = Counter(re.findall("[a-z0-9]+", (text or "").lower()))
        scored = []
        for i, c in docs:
            if any(t in c for t in asked):
                dl = sum(c.values())
                s = sum(m * (raw[t] if raw[t] >= 0 else low) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / mean)) for t, m in asked.items() if t in c)
                scored.append((-round(s, 9), i))
        out |= {(q, i, r, round(-s, 4)) for r, (s, i) in enumerate(sorted(scored)[:k])}
    return out


def corpus(n, seed=0, vocab=400, least=0):
    rng = np.random.default_rng(seed)
    words = np.array(["The", "of", "x-1", "É"] + [f"w{i}" for i in range(vocab)])
    p = 1 / (1 + np.arange(len(words)))
    draw = lambda size: " ".join(rng.choice(words, size, p=p / p.sum()))
    return [(int(i), draw(int(rng.integers(least, 90)))) for i in range(n)], [(int(q), draw(9)) for q in range(20)]


def tables(spark, chunks, queries):
    return spark.createDataFrame(chunks, "chunk_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")


def found(df):
    return {(r["query_id"], r["chunk_id"], r["rank0"], round(r["score"], 4)) for r in df.collect()}


@pytest.mark.parametrize(("block", "lead", "bundle", "cut", "k"), [(512, 20, 128, 4096, 10), (7, 1, 3, 5, 4), (64, 0, 128, 1, 10), (50, 10**6, 5, 4096, 25)])
def test_search_is_exact(spark, monkeypatch, block, lead, bundle, cut, k):
    for name, v in (("BLOCK", block), ("LEAD", lead), ("BUNDLE", bundle), ("SLICE", cut)):
        monkeypatch.setattr(P, name, v)
    chunks, queries = corpus(400, block)
    chunks += [(1000 + i, chunks[3][1]) for i in range(30)] + [(2000, None), (2001, "")]
    queries += [(50, None), (51, "nothing known"), (52, "the The THE"), (53, chunks[3][1] * 2)]
    c, q = tables(spark, chunks, queries)
    assert found(P.bm25_search(q, P.build_bm25(c), k)) == plain(chunks, queries, k)


def test_tiny_corpora_with_negative_weights(spark):
    chunks, queries = [(1, "a b"), (2, "a c a"), (3, "a")], [(1, "a"), (2, "a b c"), (3, "c")]
    c, q = tables(spark, chunks, queries)
    assert found(P.bm25_search(q, P.build_bm25(c), 2)) == plain(chunks, queries, 2)
    none = P.build_bm25(c.where("false"))
    assert P.bm25_search(q, none, 2).count() == 0 and none.n_chunks == 0 and none.terms.count() == 0


def test_ten_additions_equal_a_rebuild(spark, tmp_path):
    chunks, queries = corpus(440, 7)
    c, q = tables(spark, chunks, queries)
    index = P.build_bm25(c.where("chunk_id < 40"), str(tmp_path / "grown"))
    for k in range(40, 440, 40):
        index = P.add_chunks(index, c.where(f"chunk_id >= {k} and chunk_id < {k + 40}"))
    whole = P.build_bm25(c, str(tmp_path / "whole"))
    weights = lambda x: {(r["term"], r["df"], round(r["idf"], 9)) for r in x.terms.collect()}
    assert len(index.segments) == 11 and weights(index) == weights(whole)
    want = plain(chunks, queries, 10)
    assert found(P.bm25_search(q, index, 10)) == found(P.bm25_search(q, whole, 10)) == want
    merged = P.merge_segments(index, str(tmp_path / "merged"))
    assert merged.segments == [0] and merged.postings.count() < index.postings.count() and weights(merged) == weights(whole)
    assert found(P.bm25_search(q, merged, 10)) == want == found(P.bm25_search(q, P.load_bm25(spark, merged.path), 10))
    # an index that is built again at the same place has nothing of the old one
    again = P.build_bm25(c.where("chunk_id < 100"), str(tmp_path / "grown"))
    assert again.segments == [0] and found(P.bm25_search(q, again, 10)) == plain(chunks[:100], queries, 10)


def test_an_unfinished_segment_is_not_there(spark, tmp_path):
    chunks, queries = corpus(60, 3)
    c, q = tables(spark, chunks, queries)
    index = P.build_bm25(c.where("chunk_id < 50"), str(tmp_path / "index"))
    P._write_rows(c.where("chunk_id >= 50"), index.path, 1)  # and then the task was lost
    index = P.load_bm25(spark, index.path)
    assert found(P.bm25_search(q, index, 5)) == plain(chunks[:50], queries, 5)
    assert found(P.bm25_search(q, P.add_chunks(index, c.where("chunk_id >= 50")), 5)) == plain(chunks, queries, 5)


def test_stop_words_bring_in_no_block(spark, monkeypatch):
    """Queries of stop words and a few rare words: few of the chunks that share a term are scored."""
    monkeypatch.setattr(P, "BLOCK", 16)
    rng = np.random.default_rng(2)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(8000)]
    chunks = [(i, " ".join([*rng.choice(common, 20), *rng.choice(rare, 10)])) for i in range(4000)]
    queries = [(q, " ".join([*common[:3], *chunks[q][1].split()[-3:]])) for q in range(20)]
    c, q = tables(spark, chunks, queries)
    index = P.build_bm25(c)
    assert found(P.bm25_search(q, index, 3)) == plain(chunks, queries, 3)
    n = P.bm25_work(q, index, 3).agg({"n_scored": "sum", "n_sharing": "sum"}).first()
    assert n["sum(n_sharing)"] > 19 * 4000 and n["sum(n_scored)"] < 0.1 * n["sum(n_sharing)"]
