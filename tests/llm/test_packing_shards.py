"""Like tails meet in a shard, and no shard outgrows its bound."""

import numpy as np

from hazmill.llm import packing


def test_like_tails_share_a_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 4000)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(200):
        ids = np.concatenate([rng.integers(0, 50, 60), rng.integers(100, 9000, 40)])
        like = ids.copy()
        like[rng.choice(100, 5, replace=False)] = rng.integers(0, 50, 5)
        rows += [(str(i), 100, [], x.astype("<u2").tobytes()) for i, x in ((2 * k, ids), (2 * k + 1, like))]
    hot = np.arange(20000, 20100).astype("<u2").tobytes()
    rows += [(str(400 + k), 100, [], hot) for k in range(150)] + [("999", 1024, [1], b"")]
    tails = spark.createDataFrame(rows, "doc_id string, doc_tokens long, full_crcs array<long>, tail binary")
    frequency, _, tokens = packing.document_frequencies(tails)
    got = packing.deal(tails, frequency, tokens).toPandas()
    shard = dict(zip(got["doc_id"], got["shard"], strict=True))
    assert len(got) == len(rows) and sorted(shard) == sorted(r[0] for r in rows)
    assert got.groupby("shard")["tail"].apply(lambda t: sum(map(len, t)) // 2).max() <= 8000 and got["shard"].nunique() >= 10
    assert np.mean([shard[str(2 * k)] == shard[str(2 * k + 1)] for k in range(200)]) >= 0.7


def test_all_terms_query():
    # the seed's twenty heaviest terms lead to one neighbour, a lighter one to the other
    seed, near, far = np.arange(30), np.arange(20), np.array([29])
    idf = np.linspace(3, 1, 30).tolist() + [0.0] * (packing.VOCABULARY - 30)
    index = packing.ShardIndex([seed, near, far], np.array(idf), 20.0)
    assert np.concatenate(list(packing.ranked(index.scores([0])[0], np.array([True, False, False])))).tolist() == [1, 2]


def test_neighbours_are_those_of_plain_bm25(monkeypatch):
    monkeypatch.setattr(packing, "NEAR", 10)
    rng = np.random.default_rng(6)
    tails = [np.minimum(rng.zipf(1.3, rng.integers(1, 120)), 5000).astype(np.int64) for _ in range(150)]
    n, mean = len(tails), np.mean([len(t) for t in tails])
    frequency = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=packing.VOCABULARY)
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
    index = packing.ShardIndex(tails, idf, mean)
    assert 0 < index.matrix.shape[1] < len(np.flatnonzero(frequency)) and len(index.docs)
    used = rng.random(n) < 0.2
    for seeds in (list(range(40)), [149]):
        for seed, got in zip(seeds, index.scores(seeds), strict=True):
            want = np.zeros(n)
            for j, tail in enumerate(tails):
                for t in set(tails[seed].tolist()) & set(tail.tolist()) if j != seed else ():
                    tf = np.count_nonzero(tail == t)
                    want[j] += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(tail) / mean))
            assert np.allclose(got, want, rtol=1e-4)
            order = np.concatenate(list(packing.ranked(got, used)))
            assert sorted(order) == np.flatnonzero((want > 0) & ~used).tolist()
            assert (np.diff(want[order]) <= 1e-3).all()
