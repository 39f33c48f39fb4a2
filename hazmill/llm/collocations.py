"""Phrase collocation mining by prefix-free parsing.

Every text is cut into chunks where its content says so: at word pairs whose hash
is a multiple of TRIGGER. A chunk reaches LONGEST - 1 words into the next one, so
that each phrase lies whole in the chunk in which it begins and is counted there
alone. Equal chunks of copies and shared passages are one entry of a dictionary
with a frequency; phrases are counted in entries, each weighted by its frequency.

Counting goes from short to long: words first; then hashes of word pairs without a
rare word, and of triples of pairs that may be frequent; then, exactly, the phrases
all of whose parts may be frequent. What is
left out on the way cannot be a candidate: a phrase is no more frequent than any
part of it. The filters between the passes have a fixed size and let through what
they are unsure of, so they change the work and never a count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazmill.llm.common import bit_filter, chunks, cut_lineage, may_hold, stored, text_of

LONGEST, LEAST, COVERED, BEST = 4, 30, 80, 2000
#: A word pair in so many begins a chunk.
TRIGGER = 32
#: Characters that a task handles at once.
RUN = 4_000_000

#: Bytes of a text: A-Z lower-cased, what ends a piece to a full stop, a tab to a space. No word has any of these marks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 46 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: The end of a piece; in an entry, what comes before the words it shares with the next chunk; between entries.
_STOP, _SHARED, _END = ".", "?", "!"
_SPACE = pa.scalar(" ", pa.large_string())


class _Tokens:
    """The tokens of a list of strings: at (numbers of distinct ones), first (of each string, and the end), size (bytes of each)."""

    def __init__(self, strings: list[bytes]) -> None:
        lists = pc.ascii_split_whitespace(pa.array(strings, pa.large_binary()).cast(pa.large_string()))
        self.flat = flat = lists.flatten()
        coded = flat.dictionary_encode()
        self.first, self.at, self.words = lists.offsets.to_numpy() - lists.offsets[0].as_py(), coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.size = pc.binary_length(flat).to_numpy()
        self._bytes = self.words.cast(pa.large_binary()).to_pylist()
        self.number = {m: self._bytes.index(m.encode()) if m.encode() in self._bytes else -1 for m in (_STOP, _SHARED, _END)}

    def hashes(self, hash_of: Callable[[bytes], int], kind: type) -> np.ndarray:
        """Of each distinct token."""
        return np.fromiter(map(hash_of, self._bytes), kind, len(self._bytes))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def normal(text: str) -> bytes:
    """Words and, for each end of a piece, a full stop, all apart by spaces."""
    return text.encode().translate(_TABLE).replace(b".", b" . ").strip(b" ")


def _cut(texts: list[bytes]) -> list[list[bytes]]:
    """The chunks of each normal text, none of which is empty."""
    t = _Tokens(texts)
    n, first = len(t.at), t.first
    hashes = t.hashes(xxhash.xxh3_64_intdigest, np.uint64)[t.at]
    begins = np.zeros(n + 1, bool)
    begins[1 : n - 1] = _pair(hashes[1 : n - 1], hashes[2:]) % np.uint64(TRIGGER) == 0 if n > 2 else False
    begins[first] = True
    start = np.flatnonzero(begins)
    # a chunk's next words, up to the end of the piece that its last word stands in and of the text
    stops = np.append(np.flatnonzero(t.at == t.number[_STOP]), n)
    end = start[1:]
    shared = np.minimum(end + LONGEST - 1, np.minimum(stops[np.searchsorted(stops, end - 1)], first[np.searchsorted(first, end)]))
    # bytes of the tokens joined by single spaces
    ends = np.cumsum(t.size + 1) - 1
    place = np.append(0, ends + 1)
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, n], pa.int64()), t.flat), _SPACE)[0].as_buffer().to_pybytes()
    mark = b" " + _SHARED.encode() + b" "
    own = [joined[a:b] for a, b in zip(place[start[:-1]].tolist(), ends[end - 1].tolist(), strict=True)]
    out = [o + mark + joined[a:b] if b > a else o for o, a, b in zip(own, place[end].tolist(), np.where(shared > end, ends[np.minimum(shared, n) - 1], 0).tolist(), strict=True)]
    cuts = np.searchsorted(start, first).tolist()
    return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def parse(docs: DataFrame) -> DataFrame:
    """The dictionary: lang, chunk, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for a, b in chunks(texts, RUN):
                found: dict[tuple, int] = {}
                some = [(lang, t) for lang, t in zip(langs[a:b], map(normal, texts[a:b]), strict=True) if t]
                for (lang, _), cut in zip(some, _cut([t for _, t in some]) if some else [], strict=True):
                    for chunk in cut:
                        key = (lang, chunk)
                        found[key] = found.get(key, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(found.values(), pa.int64())], names=["lang", "chunk", "times"])

    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und"))
    cut = docs.select(lang.alias("lang"), text_of(docs).alias("text")).mapInArrow(run, "lang string, chunk binary, times bigint")
    return stored(cut.groupBy("lang", "chunk").agg(F.sum("times").alias("times")), "chunks")


class _Words:
    """The tokens of entries of one language: numbers, weights, which are words, and where a phrase may begin."""

    def __init__(self, lang: str, entries: list[bytes], times: np.ndarray) -> None:
        end = f" {_END} ".encode()
        t = self.tokens = _Tokens([end.join(entries) + end[:-1]])
        is_shared, is_end = t.at == t.number[_SHARED], t.at == t.number[_END]
        marks = np.cumsum(is_shared)
        before = np.maximum.accumulate(np.where(is_end, marks, 0))
        entry = np.cumsum(is_end) - is_end
        kept = ~is_shared
        self.lang, self.at = lang, t.at[kept]
        self.own, self.times = (marks == np.append(0, before[:-1]))[kept], times[entry[kept]]
        self.is_word = np.ones(len(t.words), bool)
        self.is_word[[i for i in t.number.values() if i >= 0]] = False

    def starts(self, n: int, good: np.ndarray, everywhere: bool = False) -> np.ndarray:
        """Whether n tokens stand at each place, all good (by number); everywhere, or where an entry's own phrases begin."""
        here = good[self.at]
        out = np.ones(len(here), bool) if everywhere else self.own.copy()
        for k in range(n):
            out[: len(out) - k] &= here[k:]
            out[len(out) - k :] = False
        return out

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The n words from each place on."""
        return pc.binary_join_element_wise(*[self.tokens.words.take(pa.array(self.at[at + k])) for k in range(n)], _SPACE).cast(pa.large_binary()).cast(pa.binary())


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys' first places, their sums of times, for each key its number)."""
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.zeros(len(first), np.int64)
    np.add.at(sums, number, times)
    return first, sums, number


def _over(entries: DataFrame, count: Callable[[_Words], pa.RecordBatch], ddl: str) -> DataFrame:
    """What count gives for each language of each run of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rows, times = np.array(batch.column("lang").to_pylist(), object), batch.column("chunk").to_pylist(), batch.column("times").to_numpy()
            for a, b in chunks(rows, RUN):
                for lang in sorted(set(langs[a:b])):
                    of = a + np.flatnonzero(langs[a:b] == lang)
                    yield count(_Words(lang, [rows[i] for i in of], times[of]))

    return entries.mapInArrow(run, ddl)


def word_counts(entries: DataFrame) -> DataFrame:
    """lang, phrase, f of single words."""

    def count(words: _Words) -> pa.RecordBatch:
        at = np.flatnonzero(words.starts(1, words.is_word))
        first, sums, _ = _summed(words.at[at], words.times[at])
        return pa.RecordBatch.from_arrays([pa.array([words.lang] * len(first), pa.string()), words.phrases(at[first], 1), pa.array(sums)], names=["lang", "phrase", "f"])

    return _over(entries, count, "lang string, phrase binary, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def word_key(lang: Column, word: Column) -> Column:
    return F.crc32(F.concat(F.encode(lang, "UTF-8"), F.lit(b"\t"), word))


def phrase_counts(entries: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, f of the phrases of two to LONGEST words with f >= least."""
    often = bit_filter(words.where(F.col("f") >= least).select(word_key(F.col("lang"), F.col("phrase")).alias("h")))

    def frequent(words: _Words) -> np.ndarray:
        seed = crc32(words.lang.encode() + b"\t")
        return words.is_word & may_hold(often.value, words.tokens.hashes(lambda w: crc32(w, seed), np.int64))

    def hashes(words: _Words) -> np.ndarray:
        return words.tokens.hashes(xxhash.xxh3_64_intdigest, np.uint64) + np.uint64(xxhash.xxh3_64_intdigest(words.lang.encode()))

    def places(words: _Words, filters: list[Broadcast]) -> list[np.ndarray]:
        """For n = 2, 3, ... whether n words stand at each place, of an entry's own or not, and may all be frequent by the filters that there are."""
        good = [words.starts(2, frequent(words), everywhere=True)]
        for bits in filters:
            n, last = len(good) + 1, good[-1]
            at = np.flatnonzero(last)
            last[at[~may_hold(bits.value, keys(words, at, n))]] = False
            both = last.copy()
            both[:-1] &= last[1:]
            both[-1:] = False
            good.append(both)
        return good

    def keys(words: _Words, at: np.ndarray, n: int) -> np.ndarray:
        """32-bit hashes of the n words from each place on: all that a filter needs, and half of what 64 bits would cost to send."""
        of = hashes(words)
        out = _pair(of[words.at[at]], of[words.at[at + 1]])
        for k in range(2, n):
            out = _pair(out, of[words.at[at + k]])
        return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def may_be_frequent(n: int, filters: list[Broadcast]) -> Broadcast:
        def count(words: _Words) -> pa.RecordBatch:
            at = np.flatnonzero(places(words, filters)[-1] & words.own)
            h = keys(words, at, n)
            first, sums, _ = _summed(h, words.times[at])
            return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(sums)], names=["h", "f"])

        counted = _over(entries, count, "h int, f bigint").groupBy("h").agg(F.sum("f").alias("f"))
        return bit_filter(counted.where(F.col("f") >= least).select("h"))

    pairs = may_be_frequent(2, [])
    triples = may_be_frequent(3, [pairs])

    def count(words: _Words) -> pa.RecordBatch:
        phrases, sums = [pa.array([], pa.binary())], [np.zeros(0, np.int64)]
        key = words.at.copy()  # of the n words from a place on, dense
        for n, good in enumerate(places(words, [pairs, triples]), 2):
            # what begins an entry's own phrase, or is the start of a longer one
            at = np.flatnonzero(good)
            if not len(at):
                break
            _, number = np.unique((key[at] << 32) | words.at[at + n - 1], return_inverse=True)
            key[at] = number
            mine = at[words.own[at]]
            first, f, _ = _summed(key[mine], words.times[mine])
            phrases.append(words.phrases(mine[first], n))
            sums.append(f)
        phrase = pa.concat_arrays(phrases)
        return pa.RecordBatch.from_arrays([pa.array([words.lang] * len(phrase), pa.string()), phrase, pa.array(np.concatenate(sums))], names=["lang", "phrase", "f"])

    return _over(entries, count, "lang string, phrase binary, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _words_of(phrase: str) -> Column:
    return F.split(phrase, " ")


def _part(begin: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice("w", begin, size), " ")


def collocations(docs: DataFrame, best: int = BEST, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases.

    A null lang is "und", a null text empty; repeated rows count again; doc_id and
    other columns are ignored; no documents give no rows. Equal scores are ordered by a,
    then by the phrase's bytes. Score and containment are computed in decimals.
    """
    entries = parse(docs)
    words = cut_lineage(word_counts(entries))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = stored(phrase_counts(entries, words, least), "phrases")
    text = lambda df: df.select("lang", F.decode("phrase", "UTF-8").alias("phrase"), "f")
    longer = text(found)
    parts = text(words.where(F.col("f") >= least)).unionByName(longer)
    cand = longer.select("lang", "phrase", F.col("f").alias("a"), _words_of("phrase").alias("w"))
    cuts = cand.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("head"), _part(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("score", F.expr("cast(2000000 * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    # what lies inside a candidate of three words or more, with the most frequent of those
    inside = cand.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size"))
    inside = inside.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("begin"))
    inside = inside.select("lang", _part(F.col("begin"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * exact("outer"), F.lit(0)) < covered * exact("a"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
