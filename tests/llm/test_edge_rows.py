"""Rows that are easily confused: large ids beside null ones, one doc_id with several texts, clashing names, odd vectors."""

import hashlib
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from hazmill.llm import context_tree, embeddings, licenses, mixing, near_dedup, packing, quality, secrets, sharding, suffix_dedup

BIG = 9007199254740993  # the first whole number that a double cannot hold
TEXT = "some plain words " * 30
IDS = [(BIG, TEXT), (None, TEXT + "a"), (BIG + 2, None)]


@pytest.mark.parametrize(
    "operator",
    [
        secrets.secrets_digest,
        secrets.find_secrets,
        secrets.redact_secrets,
        context_tree.score_documents,
        quality.quality_ledger,
        packing.pack,
        near_dedup.near_duplicate_classes,
        licenses.license_matches,
        sharding.shard_by_bytes,
        suffix_dedup.remove_repeats,
    ],
)
def test_ids_stay_whole(spark, operator):
    docs = spark.createDataFrame(IDS, "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in operator(docs).select("doc_id").collect()} == {BIG, None, BIG + 2}


def test_texts_of_one_id_lose_their_own_bytes_alone(spark):
    rng = np.random.default_rng(3)
    a, b, c = ("".join(map(chr, rng.integers(97, 123, n))) for n in (400, 300, 527))
    rows = [(1, a), (2, a + b), (2, c), (2, c), (3, b[:150] + c)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 400, 0, digest(a)), (2, 700, 400, digest(b)), (2, 527, 0, digest(c)), (2, 527, 0, digest(c)), (3, 677, 677, digest(""))]
    assert got == sorted(want)


def test_vectors_of_every_length(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, float(i // 2)]) for i in range(6)] + [(200, [1.0]), (201, [5.0]), (202, [-5.0]), (203, None)]
    rows += [(300 + i, rows[i][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None}
    links = {i: sum(j != i and len(v) == len(w) and float(v @ w) >= 0.95 for j, w in own.items()) for i, v in own.items()} | {203: 0}
    for few in (5_000, 20):
        monkeypatch.setattr(embeddings, "FEW", few)
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
        assert {i: r["n_links"] for i, r in got.items()} == links
        assert got[100]["component_id"] == got[101]["component_id"] == 100 and not got[101]["kept"] and got[201]["component_id"] == 200 and got[202]["kept"]


def test_components_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(size=(12, 16)) * 0.12 for c in rng.normal(size=(20, 16))])
    got = {r["vec_id"]: (r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, label = u @ u.T >= 0.95, np.arange(len(x))
    for _ in range(len(x)):
        label = np.where(near, label[None, :], len(x)).min(axis=1)
    assert got == {i: (int(c), int(c) == i) for i, c in enumerate(label)}


def test_long_runs_take_linear_time():
    scanner = secrets.Scanner(secrets.RULES)
    began = time.time()
    spans = scanner.spans(["z9" * 500_000 + " https://me:hunter22@host " + "://" * 1000])[0]
    assert time.time() - began < 20
    assert [secrets.RULES[k].kind for _, k, _ in spans] == ["url_password"] and spans[0][2] - spans[0][0] == len("https://me:hunter22@")


@pytest.mark.parametrize("text", ["9http://u:p@h", "a.b+c://u:pp@x y", "x://u:p@q://v:w@", "http://nopass@h", "q://a:b:c@", "Z1a://b:c@d"])
def test_quick_rule_is_the_rule(text):
    import re

    rule = secrets.RULES[-1]
    plain = [m.span() for m in re.finditer(rule.regex, text, re.ASCII)]
    assert [m.span(rule.whole) for m in re.finditer(rule.search, text, re.ASCII)] == plain


def test_mixed_rows_are_what_the_mix_takes(spark):
    rows = [(k % 40, " ".join(["w"] * (k % 13 + 1)), "abc"[k % 3], 5, k) for k in range(200)] + [(None, None, None, 6, 7), (3, "w w", "a", 5, 3), (3, "w w", "a", 5, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __n int, __copies int")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {r["__n"] for r in out.collect()} <= {5, 6}
    size = lambda t: len((t or "").split())
    taken = sum(r["taken"] for r in mixing.mix(docs).collect())
    assert sum(size(r["text"]) for r in out.collect()) == taken > 0
    known = {(r[0], r[1], r[2]) for r in rows}
    assert all((r["doc_id"], r["text"], r["source"]) in known for r in out.collect())


def test_shards_by_many_splitters_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 50)
    rows = [(k, f"text {k} " * (k % 50 + 1)) for k in range(600)] + [(7, "same row " * 20)] * 300 + [(k, "same text " * 20) for k in range(300)] + [(None, None)] * 3
    p = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    by = p.groupby("shard").agg(bytes=("size", "sum"), n=("slot", "size"), top=("slot", "max"), distinct=("slot", "nunique"))
    assert len(p) == len(rows) and len(by) == 24 and (by["top"] + 1 == by["n"]).all() and (by["distinct"] == by["n"]).all()
    assert (by["bytes"] - p["size"].sum() / 24).abs().max() <= p["size"].max()
    same = sorted(p.loc[p["text_crc32"] == zlib.crc32(("same row " * 20).encode()), "shard"].unique())
    assert same == list(range(same[0], same[-1] + 1))


def test_run_on_edges_and_each_stage_decides(spark, tmp_path):
    good = lambda k: " ".join(f"alpha{k}x{i} beta{i % 7} gamma" for i in range(60))
    rows = [(k, good(k), "en", "ab"[k % 2], len(good(k))) for k in range(40)]
    rows += [(100 + k, good(k) + " extra", "en", "b", 9) for k in range(5)]  # near copies
    rows += [(200, "too short", "en", "a", 9), (201, None, None, None, None), (202, good(99) + " password=hunter2hunter2", "en", "c", 9), (None, good(98), "en", "c", 9)]
    rows += [rows[3]] * 3
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = {n: sorted(str(r["doc_id"]) for r in x) for n, x in kept.items()}
    assert not {"200", "201"} & set(ids["quality"]) and len(kept["quality"]) == len(rows) - 2
    assert ids["near_dedup"] == ids["secrets"] == sorted([*map(str, range(40)), "202", "None"])
    assert any("[secret]" in r["text"] for r in kept["secrets"]) and not any("hunter2" in r["text"] for r in kept["secrets"])
    words = {s: sum(len(r["text"].split()) for r in kept["secrets"] if r["source"] == s) for s in "abc"}
    taken = {s: sum(len(r["text"].split()) for r in kept["mixing"] if r["source"] == s) for s in "abc"}
    targets = {r["source"]: r["target"] for r in mixing.mix(spark.read.parquet(f"{tmp_path}/secrets")).collect()}
    assert all(abs(taken[s] - targets[s]) <= 200 and targets[s] <= 2 * words[s] for s in "abc")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(pieces["doc_id"].dropna().astype(int)) <= {*range(40), 202}
    size = pieces.groupby("sequence_id")["length"].sum()
    assert size.max() <= 1024 and (pieces.groupby("sequence_id")["offset"].min() == 0).all()
