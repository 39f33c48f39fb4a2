"""Phrases by chunks against a plain count of every place."""

import re
from collections import Counter

import pytest

from hazmill.llm import collocations as C


def plain(rows, least, covered, best):
    f = {}
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        rows = []
        for p, a in cand.items():
            if any(100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:best])]
    return sorted(out)


def mined(spark, rows, least=3, covered=80, best=50):
    docs = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, f long, phrase string")
    return sorted(tuple(r) for r in C.collocations(docs, best, least, covered).collect())


def texts(n, words, seed=1):
    import numpy as np

    rng = np.random.default_rng(seed)
    vocab = ["ab", "Cd", "é", "x|y", "#", "ÄB", "the", "of", "\r", "zz.zz", "q\tq"] + [f"w{i}" for i in range(words)]
    weight = 1 / (1 + np.arange(len(vocab)))
    return [("en" if i % 3 else None, (" " if i % 2 else ", \n ").join(rng.choice(vocab, rng.integers(0, 400), p=weight / weight.sum()))) for i in range(n)]


@pytest.mark.parametrize("trigger", [1, 3, 32, 10**9])
def test_every_place_counts_once(spark, monkeypatch, trigger):
    monkeypatch.setattr(C, "TRIGGER", trigger)
    rows = texts(12, 30)
    rows += rows[:5] + [("en", None), ("de", ""), ("und", "ab cd ab cd ab cd"), ("de", "! . ,"), ("x", "a " * 5000), ("y", "a b c d e f g h " * 300)]
    assert mined(spark, rows) == plain(rows, 3, 80, 50)


def test_a_filter_that_lets_all_through_changes_nothing(spark, monkeypatch):
    rows = texts(8, 60, 2)
    want = mined(spark, rows)
    monkeypatch.setattr(C, "may_hold", lambda bits, hashes: hashes == hashes)
    assert want == mined(spark, rows) == plain(rows, 3, 80, 50)


def test_ties_and_limits(spark):
    rows = [("en", "b a. a b. c d. é f. ") for _ in range(4)]
    got = mined(spark, rows, best=3)
    assert [(r[1], r[2]) for r in got] == [(1, "c d"), (2, "é f"), (3, "a b")] and got == plain(rows, 3, 80, 3)


def test_no_documents(spark):
    assert mined(spark, []) == []


def test_words_of_any_bytes(spark):
    rows = [("en", "\x00a \x1cb\x85c　d \x00a \x1cb\x85c　d")] * 3
    assert mined(spark, rows) == plain(rows, 3, 80, 50)


def test_chunks_are_shared_by_copies(spark):
    text = " ".join(f"w{i * i % 97}" for i in range(3000))
    docs = spark.createDataFrame([("en", text)] * 50 + [("en", "other words before " + text)], "lang string, text string")
    entries = C.parse(docs)
    alone = C.parse(docs.limit(1)).count()
    assert entries.count() <= alone + 2 and entries.groupBy().max("times").first()[0] >= 51
