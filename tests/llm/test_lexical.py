"""The ten best documents of each item against plain scoring of all."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from hazmill.llm import lexical


def plain(docs, items, k=10):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(i, Counter(cut(t))) for i, t in docs]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    big_n, big_l = len(terms), sum(n for *_, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in terms:
            m = 25 + (75 * n * big_n) // big_l
            s = sum(q * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in Counter(cut(text)).items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def found(spark, docs, items, parts=3, k=10):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, block long, term string").repartition(parts)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, uid long")
    return [tuple(r) for r in lexical.ranked_search(d, i, k).collect()]


def as_set(rows):
    return sorted(rows, key=repr)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    vocab = np.array(["The", "of", "É", "x1"] + [f"word{i}" for i in range(800)])
    p = 1 / (1 + np.arange(len(vocab)))
    return [(int(i), " ".join(rng.choice(vocab, int(rng.integers(0, 120)), p=p / p.sum()))) for i in range(n)], [(int(i), "-".join(rng.choice(vocab, 12, p=p / p.sum()))) for i in range(25)]


@pytest.mark.parametrize("owners", [lexical.OWNERS, (), (3000,), (9000, 6000, 5000, 4000, 3000, 2000, 1000, 500)])
@pytest.mark.parametrize("block", [7, 4096])
def test_best_ten(spark, monkeypatch, owners, block):
    monkeypatch.setattr(lexical, "OWNERS", owners)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "BUNDLE", 6)
    docs, items = corpus(300, 1)
    docs += docs[:40] + [(5, items[0][1]), (None, items[0][1]), (None, items[1][1]), (9007199254740993, items[1][1] * 30), (6, None), (7, ""), (8, "!?")]
    items += [items[0], (99, None), (98, "unknownterm"), (None, "the word1"), (97, "")]
    assert as_set(found(spark, docs, items)) == as_set(plain(docs, items))


def test_ties_of_many_copies(spark):
    docs = [(i, "alpha beta") for i in range(500, 0, -1)] + [(1000 + i, "gamma alpha " + "delta " * i) for i in range(20)]
    items = [(1, "alpha beta"), (2, "gamma gamma delta")]
    assert as_set(found(spark, docs, items)) == as_set(plain(docs, items))


def test_nothing_to_rank(spark):
    assert found(spark, [], [(1, "a")]) == [] == found(spark, [(1, "a")], []) == found(spark, [(1, None)], [(1, "a")])


def test_accumulators_are_few(spark, monkeypatch):
    """What the floors let go is most of what an unbounded pass would carry."""
    docs, items = corpus(2000, 3)
    docs += [(5000 + 20 * i + c, text + " " + text) for i, text in items for c in range(12)]
    carried = []
    cut = lexical.cut_lineage
    def spy(df, *a):
        out = cut(df, *a)
        if "sums" in out.columns:
            carried.append(sum(len(r["sums"]) for r in out.collect()))
        return out
    monkeypatch.setattr(lexical, "cut_lineage", spy)
    assert as_set(found(spark, docs, items)) == as_set(plain(docs, items))
    assert carried[-1] < 0.05 * len(docs) * len(items)
