"""Search through cells against all products, how much it scores, and an index that grows."""

import numpy as np
import pytest

from hazmill.operators import retrieval as R
from hazmill.operators import vector_index as V


def clustered(n, dim=48, clusters=120, seed=5):
    """Texts as an encoder places them: many topics, each a cloud; a third of all in one."""
    rng = np.random.default_rng(seed)
    topic = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, clusters, n))
    x = rng.normal(size=(clusters, dim))[topic] + rng.normal(size=(n, dim)) * 0.35
    return x / np.linalg.norm(x, axis=1, keepdims=True), topic


def table(spark, x, labels=None):
    rows = [(i, v.tolist(), None if labels is None else str(labels[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>, label string")


def hits(df):
    return {(r["query_id"], r["chunk_id"], r["rank0"], round(r["score"], 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    x, topic = clustered(12_000)
    v = table(spark, x, topic % 3).cache()
    q = v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id").cache()
    return v, q, V.build_vector_index(v, str(tmp_path_factory.mktemp("index") / "all"), "label")


def test_recall_and_work(built):
    v, q, index = built
    want, got = hits(R.dense_search(q, v, 10)), hits(V.search_vectors(q, index, 10))
    assert len(got) == len(want) == 2400 and len(got & want) >= 0.98 * len(want)
    # a topic with a third of all vectors is one cloud, and its own queries must look at much of it; the others score a few cells
    crowd = {r[0] for r in v.where("chunk_id % 50 = 0").select("chunk_id").collect() if built_topic(r[0]) == 0}
    work = {r["query_id"]: r["n_scored"] for r in V.search_work(q, index, 10).collect()}
    others = [n for i, n in work.items() if i not in crowd]
    assert len(work) == 240 and np.mean(others) < 0.03 * 12_000 and np.mean(list(work.values())) < 0.15 * 12_000
    less = [r["n_scored"] for r in V.search_work(q, index, 10, 1.0).collect()]
    assert np.mean(less) < np.mean(list(work.values()))


def built_topic(i):
    return clustered(12_000)[1][i]


def test_a_larger_sureness_finds_more(built):
    v, q, index = built
    want = hits(R.dense_search(q, v, 10))
    found = [len(hits(V.search_vectors(q, index, 10, s)) & want) for s in (0.0, 1.5, None)]
    assert found[0] <= found[1] <= found[2] == len(want)


def test_whole_radius_is_exact_with_labels(spark, built):
    v, q, index = built
    assert hits(V.search_vectors(q, index, 7, None, "label")) == hits(R.dense_search(q, v, 7, label="label"))
    # a label that few have, and one that none has; an empty one asks for nothing
    asked = q.limit(5).selectExpr("query_id", "embedding", "case query_id % 3 when 0 then 'none' when 1 then '' end as label")
    got = {r["query_id"] for r in V.search_vectors(asked, index, 3, None, "label").collect()}
    assert got == {r["query_id"] for r in asked.where("coalesce(label, '') = ''").collect()}


def test_additions_equal_a_rebuild(spark, built, tmp_path):
    v, q, whole = built
    index = V.build_vector_index(v.where("chunk_id < 3000"), str(tmp_path / "grown"), "label")
    for k in range(3000, 12_000, 3000):
        index = V.add_vectors(index, v.where(f"chunk_id >= {k} and chunk_id < {k + 3000}"), "label")
    assert index.n == whole.n == 12_000
    want = hits(V.search_vectors(q, whole, 10, None))
    assert hits(V.search_vectors(q, index, 10, None)) == want
    merged = V.merge_blocks(index, str(tmp_path / "merged"))
    assert merged.n == 12_000 and merged.blocks().count() < index.blocks().count()
    assert hits(V.search_vectors(q, merged, 10, None)) == want == hits(V.search_vectors(q, V.load_vector_index(spark, merged.path), 10, None))


def test_blocks_of_a_crowded_cell_are_bounded(spark, tmp_path, monkeypatch):
    x = np.tile(clustered(40)[0][:1], (3000, 1))
    monkeypatch.setattr(V, "BLOCK", 100)
    index = V.build_vector_index(table(spark, x), str(tmp_path / "one"), n_cells=4)
    sizes = [r["n"] for r in index.blocks().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 100
    got = V.search_vectors(table(spark, x[:1]).withColumnRenamed("chunk_id", "query_id"), index, 5).orderBy("rank0").collect()
    assert [r["chunk_id"] for r in got] == [0, 1, 2, 3, 4]


def test_edges(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [float("nan"), 1.0]), ("d", [None, 1.0]), ("e", []), ("f", [0.0, 1.0]), ("g", [float("inf"), 0.0]), ("h", [0.0, 0.0])]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    index = V.build_vector_index(v, str(tmp_path / "few"))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 0.0])], "query_id int, embedding array<double>")
    got = V.search_vectors(q, index, 9).orderBy("rank0").collect()
    assert [(r["query_id"], r["chunk_id"], r["score"]) for r in got] == [(1, "a", 1.0), (1, "f", 0.0), (1, "h", 0.0)]
    none = V.build_vector_index(v.where("false"), str(tmp_path / "none"))
    assert none.n == 0 and V.search_vectors(q, none).count() == 0
    with pytest.raises(ValueError, match="one length"):
        V.build_vector_index(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "chunk_id long, embedding array<double>"), str(tmp_path / "odd"))


def test_cells_grow_with_the_vectors():
    assert [V.cells_for(n) for n in (0, 3, 500, 2_000, 12_000, 10**9)] == [1, 1, 44, 89, 219, 4096]
