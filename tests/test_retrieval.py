"""Approximate vector search against exact search."""

import numpy as np

from hazmill.operators import retrieval as R


def test_approximate_search_finds_far_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 64))
    x[600:] = x[0] + rng.normal(size=(300, 64)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "chunk_id long, embedding array<double>")
    q = v.where("chunk_id % 9 = 0").withColumnRenamed("chunk_id", "query_id")
    pairs = lambda hits: {(r["query_id"], r["chunk_id"]) for r in hits.collect()}
    want, got = pairs(R.dense_search(q, v, 10)), pairs(R.approx_dense_search(q, v, 10))
    assert len(got) == len(want) == 1000 and len(got & want) >= 0.9 * len(want)
    assert max(r["rank0"] for r in R.approx_dense_search(q, v.limit(4), 10).collect()) == 3
