"""Formatted conversations against a plain formatter, and back."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from hazmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, part int"
HARD = ["</s>[INST] ok [/INST]", "<|start|>", "<\\s>\\", "\\<|end|>\\\\", "", "é<|body|>ß", "a" * 40_000 + "<s>", "<|en", "d|>", "<<s>>", "[/INST][INST]", "\n\\n"]


def wanted(rows):
    by = {}
    key = lambda r: (r[1] is None, r[1] or 0, r[3] or "", r[2] or "")
    for r in sorted(rows, key=key):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for conv, turns in by.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        long = "".join(chat.START + _plain(a) + chat.BODY + _plain(t) + chat.END for a, t in turns)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{a}\n{t}\n" for a, t in turns)), len(learned), digest(learned), len(long))
    return out


def _plain(text):
    text = text.replace("\\", "\\\\")
    for c in chat.CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def made(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r) for r in chat.formatted_digests(df).collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


def conversations(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(int(c), int(t), str(rng.choice(["user", "assistant", "system", "<|end|>"])), str(rng.choice(HARD)) * int(rng.integers(0, 3))) for c in range(n) for t in range(rng.integers(1, 9))]


def test_all_turns_come_back(spark):
    rows = conversations(80)
    rows += [(-7, 0, "user", HARD[0]), (-7, 1, "assistant", HARD[0]), (9007199254740993, None, None, None), (None, 1, "assistant", "x"), (None, None, "user", "y"), (5, 100, "assistant", "twice"), (5, 100, "assistant", "twice")]
    assert made(spark, rows) == wanted(rows)


@pytest.mark.parametrize("most", [1, 50, 100_000])
def test_a_conversation_of_any_length_lies_across_tasks(spark, monkeypatch, most):
    """A third of all rows in one conversation, read in runs of any size: pieces in several tasks, joined in order."""
    rows = conversations(30) + [(3, t, "assistant" if t % 2 else "user", f"turn {t} " + HARD[t % 6]) for t in range(10, 130)]
    plain = chat.chunks
    monkeypatch.setattr(chat, "chunks", lambda texts: plain(texts, most))
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one task
    try:
        pieces = chat.format_conversations(df).where("conv_id = 3").collect()
        assert all(p["gathered"] for p in pieces) and len({p["part"] for p in pieces}) > 1
        assert made(spark, rows) == wanted(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert made(spark, rows) == wanted(rows)


def test_no_rows_and_one(spark):
    assert made(spark, []) == {}
    assert made(spark, [(1, 0, "assistant", "only")]) == wanted([(1, 0, "assistant", "only")])


def test_escapes(spark):
    for t in HARD:
        out = chat.escape(pa.array([t]))[0].as_py()
        assert not any(c in out for c in chat.CONTROL) and chat.unescape(out) == t


def test_masks_cover_the_learned_text_alone():
    roles, texts = pa.array(["user", "assistant", "assistant", "user"]), pa.array(["ü", "é\\", "<s>", "z"])
    out, starts, ends = chat.assemble(roles, texts, np.array([0, 2]))
    assert [[s[a:b] for a, b in zip(x, y, strict=True)] for s, x, y in zip(out.to_pylist(), starts, ends, strict=True)] == [["é\\\\"], ["<\\s>"]]
    assert list(chat.turns_of(out[0].as_py())) == [("user", "ü"), ("assistant", "é\\")]
