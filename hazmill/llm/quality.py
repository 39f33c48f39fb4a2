"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once for each document; the ledger stores the
measurements and one failure bit for each rule. A policy is a named set of
rules: applying it, or asking what dropping one rule would change, reads only
the bits.

Nulls and edges: a null text has no words and fails the length rule; an empty
table gives an empty ledger; repeated rows are judged one by one; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import WORD, scan_rows, scan_texts

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper_words long, n_loud_words long, n_bullet_lines long, n_cut_lines long"

#: A rule's test reads the measures by name: columns of a ledger or arrays of a task, by the same definition.
#: Bit number is the place in this list; new rules go to its end so that old ledgers stay readable.
RULES: list[tuple[str, Callable[[Mapping], object]]] = [
    ("too_few_words", lambda m: m["n_words"] < 50),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbol_heavy", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    ("repeated_lines", lambda m: (m["n_dup_lines"] >= 2) & (10 * m["n_dup_lines"] > 4 * m["n_lines"])),
    ("upper_case", lambda m: 10 * m["n_upper_words"] > 4 * m["n_words"]),
    ("shouting", lambda m: 10 * m["n_loud_words"] > 3 * m["n_words"]),
    ("word_length", lambda m: (m["n_words"] > 0) & ((m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"]))),
    ("bullet_lines", lambda m: (m["n_lines"] > 0) & (10 * m["n_bullet_lines"] > 9 * m["n_lines"])),
    ("cut_lines", lambda m: 10 * m["n_cut_lines"] > 3 * m["n_lines"]),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE_BITS = BIT["too_few_words"] | BIT["repeated_windows"]

#: Versioned policies: the rules that count.
POLICIES: dict[str, int] = {
    "2024-base": BASE_BITS,
    "2025-full": (1 << 7) - 1,
    "2026-lines": (1 << 9) - 1,
}
DEFAULT_POLICY = "2026-lines"

_WORD = re.compile(WORD)
_SPACE = " \t\n\x0b\x0c\r"
#: How lists' lines begin, and how lines that a page cuts off end.
BULLETS, CUT = ("- ", "* ", "\u2022"), ("...", "\u2026")


def _repeats(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, the words that stand in a three-word window found twice or more in it."""
    out = np.zeros(n_docs, dtype=np.int64)
    if len(codes) < 3:
        return out
    wide = int(codes.max()) + 1
    at = np.flatnonzero(doc[2:] == doc[:-2])
    pair = pd.factorize(codes[at] * wide + codes[at + 1])[0].astype(np.int64)
    triple = pd.factorize(pair * wide + codes[at + 2])[0].astype(np.int64)
    own, _ = pd.factorize(triple * n_docs + doc[at])
    twice = at[np.bincount(own)[own] > 1] if len(own) else at
    hit = np.zeros(len(codes), dtype=bool)
    for k in range(3):
        hit[twice + k] = True
    return np.bincount(doc[hit], minlength=n_docs)


def _measure(texts: list[str]) -> dict[str, np.ndarray]:
    words = [_WORD.findall(t) for t in texts]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = [w for ws in words for w in ws]
    doc = np.repeat(np.arange(len(texts)), n)
    count = lambda marks: np.bincount(doc, weights=np.fromiter(marks, dtype=np.float64, count=len(flat)), minlength=len(texts)).astype(np.int64)
    lines = [[x for x in t.split("\n") if x.strip(_SPACE)] for t in texts]
    codes = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64) if flat else np.zeros(0, dtype=np.int64)
    return {
        "n_words": n,
        "word_chars": count(map(len, flat)),
        "n_symbols": np.array([sum(map(t.count, "#*$%&|<>")) for t in texts], dtype=np.int64),
        "n_lines": np.array([len(x) for x in lines], dtype=np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": _repeats(codes, doc, len(texts)),
        "n_upper_words": count(len(w) > 1 and w.isupper() for w in flat),
        "n_loud_words": count(w.endswith("!!") for w in flat),
        "n_bullet_lines": np.array([sum(y.lstrip(_SPACE).startswith(BULLETS) for y in x) for x in lines], dtype=np.int64),
        "n_cut_lines": np.array([sum(y.rstrip(_SPACE).endswith(CUT) for y in x) for x in lines], dtype=np.int64),
    }


def failure_bits() -> Column:
    """One bit for each rule that a ledger row fails."""
    measures = {c.split()[0]: F.col(c.split()[0]) for c in MEASURES.split(", ")}
    bits = F.lit(0).cast("long")
    for name, test in RULES:
        bits = bits.bitwiseOR(F.when(test(measures), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def task_bits(measures: Mapping) -> np.ndarray:
    """failure_bits of a task's measures."""
    return np.bitwise_or.reduce([np.where(test(measures), BIT[name], 0) for name, test in RULES])


def quality_ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and failure_bits: each rule evaluated once for each document."""
    return scan_texts(docs, lambda: _measure, MEASURES).withColumn("failure_bits", failure_bits())


def apply_policy(ledger: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Adds base_failed and kept; the base rules count under every policy."""
    bits = F.col("failure_bits")
    return ledger.withColumns(
        {
            "base_failed": bits.bitwiseAND(F.lit(BASE_BITS)) != 0,
            "kept": bits.bitwiseAND(F.lit(POLICIES[policy] | BASE_BITS)) == 0,
            "policy": F.lit(policy),
        }
    )


def ablations(ledger: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """For each policy and each of its rules: documents kept, and those kept only without the rule.

    The ledger first shrinks to one row for each distinct mask (at most 2 to the
    number of rules), so a rule's effect is a bit test on a few counts.
    """
    cases = [(p, name, mask, BIT[name]) for p, mask in sorted((policies or POLICIES).items()) for name, _ in RULES if mask & BIT[name]]
    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, r, m, b in cases]))
    masks = ledger.groupBy("failure_bits").count()
    cell = masks.select("failure_bits", "count", grid.alias("g")).select("failure_bits", "count", "g.*")
    left = F.col("failure_bits").bitwiseAND(F.col("mask"))
    return cell.groupBy("policy", "rule").agg(
        F.sum("count").alias("n_docs"),
        F.sum(F.when(left == 0, F.col("count")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(left == F.col("bit"), F.col("count")).otherwise(0)).alias("n_only_this_rule"),
        F.sum(F.when(left.bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("n_failing"),
    )


def keep_good(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The rows of docs, unchanged, whose failure bits the policy lets pass; judged in place, without a join.

    A null or empty text has no words and goes; equal rows stay or go alike; an
    empty table stays empty; other columns pass.
    """
    mask = POLICIES[policy] | BASE_BITS

    def keep(rows: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        return rows.filter(pa.array(task_bits(_measure([t or "" for t in texts])) & mask == 0))

    return scan_rows(docs, lambda: keep)
