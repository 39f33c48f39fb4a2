"""Near-duplicate documents by Order MinHash and banded alignment.

Shingles of three lower-cased words are labelled with their occurrence in the
text. Each of several sketches takes the two smallest labelled shingles under
its own hash and keeps them in text order, so that a sketch agrees only where
both content and order do. Documents that share a sketch meet in a bucket;
there the bucket's hub, not every member, is aligned with each other member,
and links hold where the edit similarity in words reaches the threshold.
First each document meets the hub with which it shares most buckets; two further
rounds take other hubs for the buckets that still span several groups, one pair
for two groups; after them every pair of a bucket that lies in two groups is compared, block by
block, so that only pairs without a common bucket go unseen. Counts of words
give a lower bound of the distance, and only pairs within it are aligned.

The threshold is an edit similarity, and edits spread over a text break every
long shingle well above it; three words and 40 sketches are the choice at which
pairs at the threshold still meet (the README has the curve).

Exact copies (the same words) collapse before sketching and cost one row.
Words are compared by 64-bit hashes.

Nulls and edges: documents without words (null or empty texts too) link with
nothing; shorter texts than a shingle are one shingle; doc_id is the identity,
repeated rows are copies; ties go to the smaller doc_id; an empty table gives an
empty result; other columns are ignored (classes) or kept (deduplicated).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import WORD, chunks, components, cut_lineage, keyed_texts, put_together, text_of

SHINGLE, SKETCHES, THRESHOLD, ROUNDS = 3, 40, 0.8, 3
#: Members of a bucket that are compared with as many others at once; counters of a document's words, and how many of them are summed for a first look.
BLOCK, COUNTERS, FOLD = 2000, 4096, 16
#: Pairs up to which their table is broadcast to the words (larger ones are shuffled); pairs of a task; pairs of one member that meet its words at once.
MOST_BROADCAST, TASK_PAIRS, RUN_PAIRS = 200_000, 4_000, 500
#: Smallest values of a sketch that are looked at first.
FEW = 8

_WORD = re.compile(WORD)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit code for each word of all texts in order, words of each text)."""
    words = [_WORD.findall(t.lower()) for t in texts]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.array([w for ws in words for w in ws], dtype=object)
    if not len(flat):
        return np.zeros(0, dtype=np.uint64), n
    codes, names = pd.factorize(flat)
    return pd.util.hash_array(np.asarray(names, dtype=object), categorize=False)[codes], n


def labelled_shingles(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the shingles of all texts in order, each with how many times it came before in its text; its text; shingles of each text)."""
    first_word = np.cumsum(n) - n
    count = np.maximum(n - SHINGLE + 1, 1)
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) - first[doc] + first_word[doc]
    end = (first_word + n)[doc]
    shingle = np.zeros(len(doc), dtype=np.uint64)
    for k in range(SHINGLE):
        inside = at + k < end
        shingle = shingle * _ODD + np.where(inside, words[np.minimum(at + k, len(words) - 1)], np.uint64(k))
    shingle = _mix(shingle)
    order = np.lexsort((shingle, doc))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (shingle[order][1:] != shingle[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    place = np.arange(len(doc))
    occurrence = np.empty(len(doc), dtype=np.uint64)
    occurrence[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return _mix(shingle + occurrence * _ODD), doc, count


def sketch(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One row of SKETCHES values for each text; every text has a word."""
    label, doc, count = labelled_shingles(words, n)
    first = np.cumsum(count) - count
    # about FEW values of a text lie under its limit; a text with fewer than two there is looked at whole
    limit = np.where(count <= 2 * FEW, np.inf, 2.0**64 * FEW / count)
    limit = np.repeat(np.minimum(limit, 2.0**64 - 2048).astype(np.uint64), count)
    limit[np.repeat(count <= 2 * FEW, count)] = np.uint64(2**64 - 1)
    out, texts = np.empty((len(n), SKETCHES), dtype=np.uint64), np.arange(len(n))
    for j in range(SKETCHES):
        v = (label ^ _mix(np.array([j + 1], dtype=np.uint64) * _ODD)) * _ODD
        v ^= v >> np.uint64(32)
        low = np.flatnonzero(v <= limit)
        low = low[np.lexsort((v[low], doc[low]))]
        start = np.searchsorted(doc[low], texts)
        found = np.diff(np.append(start, len(low)))
        enough = found >= np.minimum(count, 2)
        a = low[np.where(enough, start, 0)]
        b = np.where(found > 1, low[np.minimum(start + 1, len(low) - 1)], a)
        for i in np.flatnonzero(~enough):
            least = first[i] + np.argsort(v[first[i] : first[i] + count[i]], kind="stable")[:2]
            a[i], b[i] = least[0], least[-1]
        both = np.where(count == 1, label[a], label[np.minimum(a, b)] * _ODD + label[np.maximum(a, b)])
        out[:, j] = _mix(both + np.full(1, j, dtype=np.uint64) * _MIX)
    return out


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy()
        for a, b in chunks(texts):
            words, n = word_codes(texts[a:b])
            some = n > 0
            ends = np.cumsum(n)
            same = [hashlib.blake2b(words[e - k : e].tobytes(), digest_size=16).digest() for e, k in zip(ends[some], n[some], strict=True)]
            rows = sketch(words, n[some]).view(np.int64) if some.any() else ()
            if some.any():
                yield pd.DataFrame({"doc_id": ids[a:b][some], "same": same, "sketches": list(rows)})


def profile(words: np.ndarray) -> bytes:
    """How many of a text's words fall to each counter, compressed."""
    return zlib.compress(np.minimum(np.bincount((words % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS), 255).astype(np.uint8).tobytes(), 1)


def counters(packed: pd.Series) -> np.ndarray:
    """A row for each profile."""
    return np.frombuffer(b"".join(map(zlib.decompress, packed)), dtype=np.uint8).reshape(len(packed), COUNTERS).astype(np.int16)


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy()
        for a, b in chunks(texts):
            words, n = word_codes(texts[a:b])
            runs = [words[e - k : e] for e, k in zip(np.cumsum(n), n, strict=True)]
            yield pd.DataFrame({"id": ids[a:b], "n": n, "counts": [profile(x) for x in runs], "words": [x.tobytes() for x in runs]})


class Window:
    """Where each word of a sequence stands, seen through a window that moves on by one place at a time."""

    def __init__(self, a: list, wide: int):
        self.places: dict = {}
        for i, c in enumerate(a):
            self.places.setdefault(c, []).append(i)
        self.wide, self.seen = wide, {}

    def bits(self, c, start: int) -> int:
        """A bit for each place of c from start to start + wide - 1; start never falls."""
        places = self.places.get(c)
        if places is None:
            return 0
        bits, base, k = self.seen.get(c, (0, start, 0))
        bits >>= start - base
        while k < len(places) and places[k] < start + self.wide:
            if places[k] >= start:
                bits |= 1 << (places[k] - start)
            k += 1
        self.seen[c] = (bits, start, k)
        return bits


def _within(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most most, else most + 1; only the diagonals within most of the main one are computed.

    Bit-parallel: a column of the band is two integers, a bit for each of its
    rows, and moves on by a row with each column.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if most >= len(a):  # no distance is larger than the longer length
        most = len(a)
    wide = 2 * most + 1
    whole, top = (1 << wide) - 1, 1 << (wide - 1)
    window = Window(a, wide)
    up, down, score, start = whole & ~((1 << most) - 1), 0, most, -most
    steps, edge = len(a) - most, top >> 1
    for j, c in enumerate(b):
        eq = window.bits(c, start)
        start += 1
        same = ((((eq & up) + up) ^ up) | eq | down) & whole
        more, less = down | (whole & ~(same | up)), same & up
        if j < steps:
            score += not same & top
        else:
            score += bool(more & edge) - bool(less & edge)
            edge >>= 1
        if score > 2 * most + len(b) - j:
            return most + 1
        same >>= 1
        up, down = less | (whole & ~(same | more)), same & more
    return min(score, most + 1)


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences, or more than most; narrow bands are tried first."""
    k = min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) == len(b) and (off := int(np.count_nonzero(a != b))) <= 1:
        return off
    differ = np.flatnonzero(a[:k] != b[:k])
    start = int(differ[0]) if len(differ) else k
    a, b = a[start:], b[start:]
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - k :][::-1] != b[len(b) - k :][::-1])
    stop = int(differ[0]) if len(differ) else k
    a, b = a[: len(a) - stop].tolist(), b[: len(b) - stop].tolist()
    if not a or not b:
        return max(len(a), len(b))
    band = max(15, abs(len(a) - len(b)))
    while band < most:
        if (found := _within(a, b, band)) <= band:
            return found
        band *= 4
    return _within(a, b, most)


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Edit similarity, 1 - distance / longer length, at least the threshold."""
    longer = max(len(a), len(b))
    most = int(np.floor((1 - threshold) * longer + 1e-9))
    if len(a) == len(b) and int(np.count_nonzero(a != b)) <= most:
        return True
    return banded_distance(a, b, most) <= most


def _aligned(threshold: float):
    """Rows (a, run, id, words) sorted so that each a comes before those that it is compared with: whether they are alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = whose = None
        for pdf in batches:
            out = []
            for a, i, w in zip(pdf["a"].tolist(), pdf["id"].tolist(), pdf["words"].tolist(), strict=True):
                words = np.frombuffer(w, dtype=np.uint64)
                if i == a:
                    first, whose = words, a
                    continue
                assert whose == a
                out.append((a, i, alike(first, words, threshold)))
            yield pd.DataFrame(out, columns=["a", "b", "linked"]).astype({"linked": bool})

    return run


def _least(off: np.ndarray) -> np.ndarray:
    """The edits that differing counters need at least: each edit raises one counter and lowers one."""
    up = np.maximum(off, 0).sum(axis=1)
    return np.maximum(up, up - off.sum(axis=1))


def _bounded(threshold: float):
    """Of pairs with both sides' counters: those that may be alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 1000):
                part = pdf.iloc[start : start + 1000]
                n, m = part["n_a"].to_numpy(), part["n_b"].to_numpy()
                least = np.maximum(_least(counters(part["counts_a"]) - counters(part["counts_b"])), np.abs(n - m))
                yield part.loc[least <= np.floor((1 - threshold) * np.maximum(n, m) + 1e-9), ["a", "b"]]

    return run


def close_pairs(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Pairs of two groups that may be alike, of the rows of one block or two (i, j): none that is alike is left out.

    A pair that shares a smaller bucket too (of those in the rows' own) is named there alone.
    """
    ids, group, n, block = (pdf[c].to_numpy() for c in ("id", "group", "n", "block"))
    of = np.repeat(np.arange(len(pdf)), pdf["own"].map(len))
    own = np.concatenate(pdf["own"].tolist())
    smaller = own < pdf["bucket"].iloc[0]
    of, own = of[smaller], np.unique(own[smaller], return_inverse=True)[1]
    order = np.argsort(own, kind="stable")
    holders = np.split(of[order], np.flatnonzero(np.diff(own[order])) + 1)
    held = np.split(own, np.searchsorted(of, np.arange(1, len(pdf))))
    counts = counters(pdf["counts"])
    folded = counts.reshape(len(pdf), -1, FOLD).sum(axis=2, dtype=np.int16)
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    later = np.arange(len(pdf))
    out: list[np.ndarray] = [np.zeros((0, 2), dtype=np.int64)]
    for r in np.flatnonzero(block == i):
        most = np.floor((1 - threshold) * np.maximum(n, n[r]) + 1e-9)
        here = (later > r if i == j else block == j) & (group != group[r]) & (np.abs(n - n[r]) <= most)
        for c in held[r]:
            here[holders[c]] = False
        with_ = np.flatnonzero(here)
        for c in (folded, counts):
            with_ = with_[_least(c[with_] - c[r]) <= most[with_]]
        out.append(np.stack([np.minimum(ids[with_], ids[r]), np.maximum(ids[with_], ids[r])], axis=1))
    return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])


def _close(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by bucket and blocks; the last run of a batch may go on in the next
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            new = (pdf[["bucket", "i", "j"]].diff().iloc[1:] != 0).any(axis=1).to_numpy()
            starts = [0, *(np.flatnonzero(new) + 1)]
            found = [close_pairs(pdf.iloc[s:e], threshold) for s, e in zip(starts, starts[1:], strict=False)]
            rest = pdf.iloc[starts[-1] :]
            if found:
                yield pd.concat(found).drop_duplicates()
        if rest is not None and len(rest):
            yield close_pairs(rest, threshold)

    return run


def bounded(pairs: DataFrame, profiles: DataFrame, threshold: float, rows: int) -> DataFrame:
    """a, b: the pairs that may be alike by the counters of both; neither pairs nor profiles have more rows than rows."""
    for s in ("b", "a"):
        pairs = put_together(pairs.join(profiles.select(*[F.col(c).alias(t) for c, t in (("id", s), ("n", f"n_{s}"), ("counts", f"counts_{s}"))]), s), rows, TASK_PAIRS)
    return pairs.mapInPandas(_bounded(threshold), "a long, b long")


def untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    return pairs if tried is None else pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")


def remaining_pairs(met: DataFrame, size: int, groups: DataFrame, profiles: DataFrame, n: int, tried: DataFrame | None, threshold: float) -> DataFrame:
    """a, b: untried pairs of two groups that share a bucket and may be alike; each is named in one bucket, and blocks bound what a task holds. size, n: rows of met and of profiles."""
    inside = put_together(met.join(groups, "id"), size)
    several = cut_lineage(inside.groupBy("bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("m"), F.min("id").alias("a"), F.max("id").alias("b")).where("lo <> hi"), size)
    twos = cut_lineage(untried(put_together(several.where("m = 2").select("a", "b").distinct(), size), tried), size)
    twos = bounded(twos, profiles, threshold, max(n, twos.count()))
    left = cut_lineage(inside.join(several.where("m > 2").select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "bucket"), size)
    # a member's own buckets are at most as many as the sketches
    facts = left.groupBy("id").agg(F.collect_set("bucket").alias("own")).join(profiles, "id")
    placed = left.join(facts, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "group", "n", "counts", "own")
    runs = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return twos.unionByName(untried(runs.mapInPandas(_close(threshold), "a long, b long"), tried)).distinct()


def verified(pairs: DataFrame, n_pairs: int, words: DataFrame, threshold: float) -> DataFrame:
    """a, b, linked: the words of a meet those of up to RUN_PAIRS of its b in one task; a hub goes to as many tasks as it needs."""
    runs = put_together(pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN_PAIRS).alias("runs")), n_pairs)
    dealt = put_together(pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).alias("run"), "b"), n_pairs)
    ends = dealt.select("a", "run", F.col("b").alias("id")).unionByName(put_together(dealt.select("a", "run", F.col("a").alias("id")).distinct(), n_pairs))
    met = words.join(F.broadcast(ends) if n_pairs <= MOST_BROADCAST else ends, "id").select("a", "run", "id", "words")
    tasks = max(8, -(-n_pairs // TASK_PAIRS))
    # a is the smaller of the two ids, so it comes first
    return met.repartition(tasks, "a", "run").sortWithinPartitions("a", "run", "id").mapInPandas(_aligned(threshold), "a long, b long, linked boolean")


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and kept (doc_id is class_id), a row for each row of docs."""
    texts = keyed_texts(docs).where("doc_id is not null")
    sketched = cut_lineage(texts.mapInPandas(_sketched, "doc_id long, same binary, sketches array<long>"))
    # tables of ids and buckets are put together by their rows: as many tasks as a shuffle has partitions would write more files than rows on small inputs
    n = sketched.count()
    size = n * SKETCHES
    exact = cut_lineage(sketched.groupBy("same").agg(F.min("doc_id").alias("rep")), n)
    reps = put_together(exact.join(sketched, (exact["same"] == sketched["same"]) & (exact["rep"] == sketched["doc_id"]), "inner"), size)
    entries = put_together(reps.select(F.col("rep").alias("id"), F.explode("sketches").alias("bucket")).distinct(), size)
    shared = cut_lineage(entries.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket"), size)
    met = cut_lineage(entries.join(shared, "bucket"), size)
    size = met.count()
    met = put_together(met, size)
    candidates = cut_lineage(put_together(met.select("id").distinct(), n))
    coded = cut_lineage(texts.join(candidates, texts["doc_id"] == candidates["id"], "left_semi").dropDuplicates(["doc_id"]).mapInPandas(_coded, "id long, n int, counts binary, words binary"))
    n = candidates.count()
    candidates = put_together(candidates, n)
    coded = put_together(coded, n, TASK_PAIRS)
    words, profiles = coded.select("id", "words"), coded.select("id", "n", "counts")

    groups = candidates.select("id", F.col("id").alias("group"))
    tried = None
    for k in range(rounds + 1):
        if k < rounds:
            # one member of each group in each bucket, and the bucket's hub among them
            inside = put_together(met.join(groups, "id"), size)
            order = F.when(F.lit(k == 0), F.col("id")).otherwise(F.xxhash64(F.lit(k), "id"))
            members = inside.groupBy("bucket", "group").agg(F.min(F.struct(order.alias("o"), "id")).alias("m")) if k else inside.select("bucket", "group", F.struct(order.alias("o"), "id").alias("m"))
            members = cut_lineage(members.select("bucket", "m", "group"), size)
            hubs = cut_lineage(members.groupBy("bucket").agg(F.min(F.struct("m", "group")).alias("hub"), F.count("*").alias("n")).where("n > 1"), size)
            own, hub = F.col("m.id"), F.col("hub.m.id")
            met_hub = put_together(members.join(hubs, "bucket").where(own != hub).select(own.alias("own"), hub.alias("hub"), F.least("group", "hub.group").alias("g"), F.greatest("group", "hub.group").alias("h")), size)
            shares = put_together(met_hub.groupBy("own", "hub", "g", "h").agg(F.count("*").alias("n")), size)
            # at first the hub with which a member shares most, later one pair of members for two groups; what is left comes in later rounds
            best = shares.groupBy(*(("g", "h") if k else ("own",))).agg(F.max(F.struct("n", (-F.col("hub")).alias("early"), F.col("own"))).alias("x"))
            pairs = put_together(best.select(F.least("x.own", -F.col("x.early")).alias("a"), F.greatest("x.own", -F.col("x.early")).alias("b")), size).distinct()
            pairs = cut_lineage(untried(pairs, tried), size)
            pairs = bounded(pairs, profiles, threshold, max(n, pairs.count()))
        else:
            pairs = remaining_pairs(met, size, groups, profiles, n, tried, threshold)
        # their counters are compared in as many tasks as they need; only what is left of them is put together
        pairs = cut_lineage(pairs)
        if not (n_pairs := pairs.count()):
            continue
        pairs = put_together(pairs, n_pairs)
        verdicts = put_together(cut_lineage(verified(pairs, n_pairs, words, threshold)), n_pairs)
        tried = verdicts if tried is None else tried.unionByName(verdicts)
        found = components(tried.where("linked").select("a", "b"))
        groups = cut_lineage(candidates.join(found, candidates["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("group")), n)
    of_exact = exact.join(groups, exact["rep"] == groups["id"], "left").select("same", F.coalesce("group", "rep").alias("class_id"))
    classes = sketched.select("doc_id", "same").join(of_exact, "same").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    class_id = F.coalesce("class_id", "doc_id")
    return rows.join(classes, "doc_id", "left").select("doc_id", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stand for their class, with their columns alone; rows without a doc_id stay.

    Equal rows of one doc_id become one. A doc_id with several different texts
    keeps all of them, since a class says nothing about which of them it means.
    """
    dropped = near_duplicate_classes(docs, threshold).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(text_of(docs)).alias("text_hash"))
    named = rows.where("id is not null")
    several = named.groupBy("id").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo <> hi").select("id")
    kept = named.join(dropped.join(several, "id", "left_anti"), "id", "left_anti").dropDuplicates(["id", "text_hash"])
    return kept.unionByName(rows.where("id is null")).select("row.*")
