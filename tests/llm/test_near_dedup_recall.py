"""Links at the stated similarity, and chains that no hub spans."""

import numpy as np
import pytest

from hazmill.llm import near_dedup


def classes(spark, texts, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(rows, **more).collect()}


def changed(rng, words, at):
    out = list(words)
    for i in at:
        out[i] = f"x{rng.integers(1 << 40)}"
    return out


def test_pairs_at_the_threshold_meet(spark):
    rng = np.random.default_rng(11)
    texts, kinds = [], []
    for k in range(160):
        n = (10, 60, 400, 400)[k % 4]
        words = [f"w{rng.integers(1 << 40)}" for _ in range(n)]
        edits = n // 5 if k % 4 < 3 else n // int(rng.integers(5, 11))
        at = np.arange(edits) * (n // edits) if k % 8 < 4 else rng.choice(n, edits, replace=False)
        texts += [" ".join(words), " ".join(changed(rng, words, at))]
        kinds.append(k % 8)
    got = classes(spark, texts)
    met = np.array([got[2 * k] == got[2 * k + 1] for k in range(160)])
    assert all(met[np.array(kinds) == kind].mean() >= 0.9 for kind in range(8))
    assert all(got[i] // 2 == i // 2 for i in got)


def test_wrong_pairs_stay_apart(spark):
    rng = np.random.default_rng(14)
    texts = []
    for _ in range(60):
        words = [f"w{rng.integers(1 << 40)}" for _ in range(100)]
        texts += [" ".join(words), " ".join(changed(rng, words, rng.choice(100, 22, replace=False)))]
    got = classes(spark, texts)
    assert all(got[i] == i for i in got)


def test_clashing_columns_and_kept_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a", 5), (2, text + " more", "b", 6), (2, text + " more", "b", 6), (None, text, "c", 7), (3, None, "d", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, __doc_id int")
    out = near_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["id"], r["__doc_id"]) for r in out.collect()) == [("1", "a", 5), ("3", "d", 8), ("None", "c", 7)]


def test_long_texts_are_aligned_in_narrow_bands():
    rng = np.random.default_rng(15)
    a = rng.integers(0, 50_000, 200_000).astype(np.uint64)
    b = np.delete(a, [5, 100_000])
    b[rng.choice(len(b), 20, replace=False)] = 60_000
    assert near_dedup.banded_distance(a, b, 40_000) == 22


@pytest.mark.parametrize("rounds", [1, 3])
def test_drifting_chains_stay_whole(spark, rounds):
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(3):
        # all share a hundred words in front, and each its other words with its neighbours alone
        words = [f"w{rng.integers(1 << 40)}" for _ in range(200)]
        for step in range(40):
            words = changed(rng, words, 100 + (np.arange(34) + 34 * step) % 100)
            texts.append(" ".join(words))
    order = rng.permutation(len(texts))
    got = classes(spark, [texts[i] for i in order], rounds=rounds)
    of = {int(order[d]): c for d, c in got.items()}
    assert [len({of[i] for i in range(40 * c, 40 * c + 40)}) for c in range(3)] == [1, 1, 1]


def test_blocks_leave_no_pair_out():
    import pandas as pd

    rng = np.random.default_rng(13)
    of = [rng.integers(0, 40, rng.integers(20, 30)).astype(np.uint64) for _ in range(30)]
    of += [np.where(rng.random(len(x)) < 0.15, rng.integers(0, 40, len(x)), x).astype(np.uint64) for x in of]
    pdf = pd.DataFrame({"id": range(60), "n": [len(x) for x in of], "counts": [near_dedup.profile(x) for x in of], "bucket": 1, "own": [np.array([1])] * 60, "group": range(60), "block": [i % 2 for i in range(60)]})
    runs = pd.concat([pdf[pdf["block"].isin(b)].assign(i=b[0], j=b[1]) for b in ((0, 0), (0, 1), (1, 1))], ignore_index=True)
    found = pd.concat(near_dedup._close(0.8)([runs.iloc[:25], runs.iloc[25:90], runs.iloc[90:]]))
    got = set(zip(found["a"], found["b"], strict=True))
    alike = {(a, b) for b in range(60) for a in range(b) if near_dedup.alike(of[a], of[b], 0.8)}
    assert alike and alike <= got and len(got) < 60 * 59 // 2


def test_a_pair_of_several_buckets_is_named_once():
    import pandas as pd

    words = np.arange(30, dtype=np.uint64)
    own = [np.array(x) for x in ([1, 2, 5], [2, 5], [1, 5], [5], [1, 2, 5])]
    rows = pd.DataFrame({"id": range(5), "n": 30, "counts": [near_dedup.profile(words)] * 5, "group": range(5), "block": 0, "i": 0, "j": 0, "own": own})
    runs = pd.concat([rows[[b in x for x in own]].assign(bucket=b) for b in (1, 2, 5)], ignore_index=True)
    found = pd.concat(near_dedup._close(0.8)([runs]))
    assert sorted(zip(found["a"], found["b"], strict=True)) == [(a, b) for a in range(5) for b in range(a + 1, 5)]


def test_a_hub_of_more_pairs_than_a_run(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "RUN_PAIRS", 3)
    rng = np.random.default_rng(16)
    words = [f"w{rng.integers(1 << 40)}" for _ in range(60)]
    texts = [" ".join(words)] + [" ".join(changed(rng, words, [k])) for k in range(40)]
    assert set(classes(spark, texts).values()) == {0}


def test_no_unrelated_text_of_a_repeated_id_is_lost(spark):
    """Ids with several texts keep them; copies elsewhere go, and equal rows become one."""
    a, b, c = (" ".join(f"{x}{i * i % 61}" for i in range(80)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (4, c + " end"), (5, a + " end"), (5, "quite another text of a few words"), (None, c), (6, None), (7, "")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, text_hash int")
    got = sorted(((r["doc_id"], r["text"]) for r in near_dedup.deduplicated(docs).collect()), key=repr)
    want = [(1, a), (1, b), (3, c), (5, a + " end"), (5, "quite another text of a few words"), (None, c), (6, None), (7, "")]
    assert got == sorted(want, key=repr)


def tasks_of(spark, run):
    """(what run gives, the tasks of its jobs)."""
    sc = spark.sparkContext
    sc.setJobGroup(group := f"tasks-{np.random.default_rng().integers(1 << 40)}", "")
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_few_rows_are_few_tasks_whatever_the_shuffle_has(spark):
    """Each table of ids, buckets and links had a task, and files, for each partition of its shuffle."""
    rng = np.random.default_rng(17)
    words = [f"w{rng.integers(1 << 40)}" for _ in range(60)]
    texts = [" ".join(changed(rng, words, [k, k + 1])) for k in range(20)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got, tasks = tasks_of(spark, lambda: classes(spark, texts))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(got.values()) == {0}
    assert tasks < 600


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_components_of_few_and_of_many_edges(spark, monkeypatch, most):
    from hazmill.llm import common

    monkeypatch.setattr(common, "RUN_EDGES", most)
    rng = np.random.default_rng(18)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(90)]
    edges += [(b, a) for a, b in edges[:40]] + [(7, 7), (5000, 5000), (None, 3), (4, None)]
    label = {x: x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    while moved := [(a, b) for a, b in edges if a in label and b in label and label[a] != label[b]]:
        for a, b in moved:
            label[a] = label[b] = min(label[a], label[b])
    rows = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert sorted(tuple(r) for r in common.components(rows).select("node", "component").collect()) == sorted(label.items())


def test_runs_of_a_tasks_edges_are_stars(monkeypatch):
    import pyarrow as pa
    from hazmill.llm import common

    monkeypatch.setattr(common, "RUN_EDGES", 3)
    batches = [pa.RecordBatch.from_pydict({"a": a, "b": b}) for a, b in (([5, 9], [3, 5]), ([7, 20], [9, 21]), ([7], [1]))]
    got = [list(zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)) for x in common._stars(iter(batches))]
    assert got == [[(3, 3), (5, 3), (7, 3), (9, 3), (20, 20), (21, 20)], [(1, 1), (7, 1)]]
