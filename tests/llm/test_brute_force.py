"""Operators that SQL cannot express, against plain Python over whole texts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hazmill.llm import context_tree, embeddings, mixing, near_dedup, packing, sharding, suffix_dedup

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    return pd.read_parquet(f"{DIR}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.mark.parametrize("heavy", [2000, 2])
def test_repeats(docs, table, heavy, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    seen, want = set(), {}
    for i, t in zip(table.doc_id, table.text, strict=True):
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (not k or not gone[k - 1]))
        want[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 8))
@settings(max_examples=300, deadline=None)
def test_banded_distance(a, b, most):
    true, got = edit_distance(a, b), near_dedup.banded_distance(np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32), most)
    assert got == true if true <= most else got > most


def test_near_duplicates(docs, table):
    words, n = near_dedup.word_codes(table.text.tolist())
    ends = np.cumsum(n)
    of = [words[e - k : e].astype(np.uint32) for e, k in zip(ends, n, strict=True)]
    parent = list(range(len(of)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(of)):
        for j in range(i):
            if len(of[i]) and len(of[j]) and min(len(of[i]), len(of[j])) >= 0.8 * max(len(of[i]), len(of[j])) and near_dedup.alike(of[i], of[j], 0.8):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {int(d): int(table.doc_id[root(i)]) for i, d in enumerate(table.doc_id)}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("split", [False, True])
def test_context_tree(spark, table, split, monkeypatch):
    part = table.head(12 if split else 60)
    if split:  # small blocks, so that many contexts are split and asked in copies
        monkeypatch.setattr(context_tree, "BLOCK_BYTES", 2_000)
        monkeypatch.setattr(context_tree, "SLICE", 500)
    got = context_tree.score_documents(spark.createDataFrame(part[["doc_id", "text"]])).toPandas().set_index("doc_id")
    depth, held = context_tree.DEPTH, context_tree.held_out

    def steps(t):
        b = [255] * depth + list(lowered(t).encode()) + [255]
        for j in range(depth, len(b)):
            context = tuple(b[j - 1 - k] for k in range(depth))
            for k in range(8):
                yield context, (1 << k) | (b[j] >> (8 - k)), (b[j] >> (7 - k)) & 1

    n = defaultdict(lambda: [0, 0])
    for i, t in zip(part.doc_id, part.text, strict=True):
        if not held(i):
            for c, node, bit in steps(t):
                for d in range(depth + 1):
                    n[c[:d], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    below, weight, half = defaultdict(float), {}, math.log(0.5)
    for c, node in sorted(n, key=lambda k: -len(k[0])):
        own = kt(*n[c, node])
        both = own if len(c) == depth else float(np.logaddexp(half + own, half + below[c, node]))
        weight[c, node] = 1.0 if len(c) == depth else math.exp(half + own - both)
        if c:
            below[c[:-1], node] += both
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lowered(t)), None] for i, t in zip(part.doc_id, part.text, strict=True)}
    count = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    total, distinct = sum(count.values()), len(count)
    for i, t in zip(part.doc_id, part.text, strict=True):
        score = 0.0
        for c, node, bit in steps(t):
            p = None
            for d in range(depth, -1, -1):
                if (c[:d], node) in n:
                    pair = n[c[:d], node]
                    own = (pair[bit] + 0.5) / (sum(pair) + 1)
                    p = own if p is None else weight[c[:d], node] * own + (1 - weight[c[:d], node]) * p
            score += math.log10(0.5 if p is None else p)
        r = got.loc[i]
        assert math.isclose(r.score, score, rel_tol=1e-7)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens[i]), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), total, held(i))


def test_packing_is_a_round_trip(docs, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*e.ids, 0], dtype="<u4") for d, e in zip(table.doc_id, tokenizer.encode_batch(table.text.tolist(), add_special_tokens=False), strict=True)}
    p = packing.pack(docs).toPandas()
    for d, g in p.sort_values("start").groupby("doc_id"):
        assert g["start"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() == len(ids[d]) == g["doc_tokens"].iloc[0]
        assert all(zlib.crc32(ids[d][s : s + n].tobytes()) == c for s, n, c in zip(g["start"], g["length"], g["ids_crc32"], strict=True))
    size = p.groupby("sequence_id")["length"].sum()
    assert size.max() <= packing.WINDOW and size.size * packing.WINDOW - size.sum() < packing.WINDOW
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]]


def test_mix_comes_near_its_targets(docs, table):
    p = mixing.mix(docs).toPandas()
    again = mixing.mix(docs).toPandas()
    key = ["doc_id", "part"]
    assert p.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert math.isclose(p.groupby("source")["target"].first().sum(), 1.5 * p["size"].sum())
    assert (p["taken"] <= 2 * p["size"]).all()
    by = p.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert ((by["taken"] - by["target"]).abs() <= by["largest"]).all()


@given(st.lists(st.integers(1, 3000), min_size=4, max_size=60), st.floats(0.05, 0.95))
@settings(max_examples=100, deadline=None)
def test_flight_keeps_both_totals(sizes, chance):
    z, p = -np.sort(-np.array(sizes)), np.full(len(sizes), chance)
    q = mixing.fly(z, p, np.random.default_rng(1))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs(q @ z - p @ z) < 1e-6 * z.sum()


def test_shards(docs, table):
    p = sharding.shard_by_bytes(docs).toPandas()
    largest = p["size"].max()
    by = p.groupby("shard").agg(bytes=("size", "sum"), n=("slot", "size"), top=("slot", "max"), distinct=("slot", "nunique"))
    assert len(by) == 24 and (by["top"] + 1 == by["n"]).all() and (by["distinct"] == by["n"]).all()
    assert (by["bytes"] - p["size"].sum() / 24).abs().max() <= largest
    want = {d: (len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in zip(table.doc_id, table.text, strict=True)}
    assert {d: (s, c) for d, s, c in zip(p["doc_id"], p["size"], p["text_crc32"], strict=True)} == want


def test_embedding_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 64))
    x = np.concatenate([c + rng.normal(size=(20, 64)) * 0.13 for c in centres] + [rng.normal(size=(400, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    p = embeddings.near_duplicates(df).toPandas().sort_values("vec_id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = p["n_links"].to_numpy()
    assert (got <= true).all() and got.sum() >= 0.9 * true.sum() > 0


@pytest.mark.parametrize("dims, n", [(64, 5_001), (64, 10_000_000), (64, 1_000_000_000), (384, 1_000_000_000)])
def test_planned_tables_find_pairs_at_the_threshold(dims, n):
    """The rotations and tables planned for n vectors, on other vectors than those they were learned and measured on."""
    rng = np.random.default_rng(dims)
    unit = lambda k: embeddings._unit(rng.normal(size=(k, dims)))
    bits = embeddings.key_bits(n, dims)
    models, tables = embeddings.plan_tables(unit(5_000), bits, 0.95, 3)
    x = unit(2_000)
    y = embeddings.mates(x, 0.95, 11)
    assert np.allclose((x * y).sum(axis=1), 0.95)
    met = np.concatenate([embeddings.meet(embeddings.table_keys(x, m, bits), embeddings.table_keys(y, m, bits)) for m in models], axis=1)[:, :tables]
    assert met.any(axis=1).mean() >= 0.95


def test_hard_pairs_among_many_vectors(spark):
    """12,000 vectors, 3,000 of them at a cosine of 0.951 from another one; a length that tables don't serve is compared in all pairs."""
    rng = np.random.default_rng(8)
    x = embeddings._unit(rng.normal(size=(9_000, 48)))
    y = embeddings.mates(x[1:6_000:2][:3_000], 0.951, 5)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    p = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert (p["n_links"] > 0).sum() >= 0.96 * 6_000 and p["n_links"].max() == 1


def test_no_table_plan(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MOST_TABLES", 1)
    rng = np.random.default_rng(9)
    x = embeddings._unit(rng.normal(size=(500, 16)))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, embeddings.mates(x, 0.951, 5)]))]
    p = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert (p["n_links"] >= 1).all()
