"""Which of many terms a text contains, in one pass over the text.

All terms are one Aho-Corasick automaton. A text's answer is a row of bits, one
for each term in 64-bit words; what is asked of it (any of these terms, how many
of those) is a mask on the bits inside the JVM. Texts that come again within a
batch are matched once.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=16)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(t, i)
    out.make_automaton()
    return out


class Terms:
    """A set of terms, each a plain string that is not empty; order and repeats do not matter."""

    def __init__(self, *lists: Iterable[str]) -> None:
        self.terms = tuple(dict.fromkeys(t for terms in lists for t in terms))
        self.place = {t: i for i, t in enumerate(self.terms)}
        if "" in self.place:
            raise ValueError("every text contains the empty term")

    def bits(self, text: Column) -> Column:
        """The bits of the terms that text contains as it stands; null for a null text."""
        terms, words = self.terms, max(1, -(-len(self.terms) // 64))

        def match(texts: pd.Series) -> pd.Series:
            codes, distinct = pd.factorize(texts)
            found = np.zeros((len(distinct), words), np.uint64)
            if terms:
                automaton = _automaton(terms)
                for row, t in zip(found, distinct, strict=True):
                    for i in {i for _, i in automaton.iter(t)}:
                        row[i >> 6] |= np.uint64(1 << (i & 63))
            rows = [*found.view(np.int64), None]
            return pd.Series([rows[c] for c in codes], index=texts.index, dtype=object)

        return F.pandas_udf(match, "array<bigint>")(text)

    def _masks(self, terms: Iterable[str]) -> list[tuple[int, int]]:
        masks: dict[int, int] = {}
        for t in terms:
            i = self.place[t]
            masks[i >> 6] = masks.get(i >> 6, 0) | 1 << (i & 63)
        return [(w, m - (1 << 64) if m >> 63 else m) for w, m in sorted(masks.items())] or [(0, 0)]

    def any(self, bits: Column, terms: Iterable[str]) -> Column:
        """Whether the text contains one of terms; null for a null text."""
        return functools.reduce(operator.or_, [F.get(bits, w).bitwiseAND(F.lit(m)) != 0 for w, m in self._masks(terms)])

    def count(self, bits: Column, terms: Iterable[str]) -> Column:
        """How many different ones of terms the text contains; null for a null text."""
        return functools.reduce(operator.add, [F.bit_count(F.get(bits, w).bitwiseAND(F.lit(m))) for w, m in self._masks(terms)])
