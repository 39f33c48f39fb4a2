"""Lexical retrieval packing.

Documents are tokenised; each full window of ids is a sequence of its own, and
what is left, the tail, is packed. Tails are dealt over shards of bounded size
by content: a tail goes where others with the same smallest hash among its
rarest terms go, and such groups that outgrow a shard are split.
A shard holds a BM25 inverted index of its tails (terms are token ids, document
frequencies those of the whole corpus; a query is all of a seed's distinct
terms). Terms that very many tails of the shard have are kept as columns of a
matrix, so that a few seeds at a time are scored by one product; the others have
posting lists. Each seed, longest first, retrieves its unused neighbours, which
greedily fill its window: best first those that fit whole, then a cut of the
best one left. Only a shard's last sequence is padded.

Nulls and edges: a null or empty text is the single end id; equal documents are
packed one by one; a text over many windows spans as many sequences; an empty
table gives an empty result; other columns are ignored. Strings of added
tokens within a text become their ids, as the vocabulary's JSON form has it.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import cut_lineage, scan_texts

WINDOW, END_ID = 1024, 0
#: The vocabulary's added tokens: the JSON form lists them, the rank file does not.
ADDED = {"<|endoftext|>": 50_256}
#: Tail tokens of a shard, ids of the vocabulary, a tail's rarest terms that may place it, and groups of tails for each shard.
SHARD_TOKENS, VOCABULARY, RARE_TERMS, GROUPS = 2_000_000, 50_257, 8, 64
#: BM25's usual constants.
K1, B = 1.2, 0.75

#: Share of a shard's tails from which a term is a column; seeds scored at once; neighbours looked at before all others.
COMMON, SEEDS, NEAR = 0.1, 32, 64

#: doc_id is text on the way, since a null would turn numbers into floats.
_TAILS = "doc_id string, doc_tokens long, full_crcs array<long>, tail binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The byte-level BPE of the vocabulary file; gives the same ids as its JSON form, several times faster."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def token_ids(encoder, text: str) -> np.ndarray:
    return np.append(encoder.encode_to_numpy(text, allowed_special="all"), np.uint32(END_ID))


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenize_tails(docs: DataFrame, path: str | None = None) -> DataFrame:
    """For each document: its tokens, the checksums of its full windows, and the ids of its tail (16 bits each)."""

    def make():
        encoder = _encoder(path or tokenizer_path())

        def cut(text: str) -> tuple[int, list[int], bytes]:
            ids = token_ids(encoder, text)
            full = len(ids) // WINDOW
            return len(ids), [_crc(ids[k * WINDOW : (k + 1) * WINDOW]) for k in range(full)], ids[full * WINDOW :].astype("<u2").tobytes()

        return lambda texts: dict(zip(("doc_tokens", "full_crcs", "tail"), zip(*map(cut, texts), strict=True), strict=True))

    found = scan_texts(docs, make, "doc_tokens long, full_crcs array<long>, tail binary")
    return found.withColumn("doc_id", F.col("doc_id").cast("string"))


def document_frequencies(tails: DataFrame) -> tuple[np.ndarray, int, int]:
    """Tails that hold each id (an array as long as the vocabulary, whatever the corpus), tails, and their tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, tokens = np.zeros(VOCABULARY, dtype=np.int64), 0, 0
        for pdf in batches:
            for tail in pdf["tail"]:
                ids = np.frombuffer(tail, dtype="<u2")
                total[np.unique(ids)] += 1
                n, tokens = n + (len(ids) > 0), tokens + len(ids)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": [*at, -1, -2], "n": [*total[at], n, tokens]})

    found = tails.select("tail").mapInPandas(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by = {r["id"]: r["n"] for r in found}
    out = np.zeros(VOCABULARY, dtype=np.int64)
    for k, v in by.items():
        if k >= 0:
            out[k] = v
    return out, by.get(-1, 0), by.get(-2, 0)


class ShardIndex:
    """An inverted index of one shard's tails with BM25 impacts."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean_length: float):
        length = np.array([len(t) for t in tails], dtype=np.int64)
        self.n = len(tails)
        key, tf = np.unique(np.repeat(np.arange(self.n), length) * VOCABULARY + np.concatenate([np.zeros(0, dtype=np.int64), *[t.astype(np.int64) for t in tails]]), return_counts=True)
        doc, term = np.divmod(key.astype(np.int64), VOCABULARY)
        impact = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean_length, 1.0)))).astype(np.float32)
        held = np.bincount(term, minlength=VOCABULARY)
        column = np.cumsum(common := held > max(COMMON * self.n, 8)) - 1
        # common terms: a matrix with a row for each tail
        at = common[term]
        self.matrix = np.zeros((self.n, int(common.sum())), dtype=np.float32)
        self.matrix[doc[at], column[term[at]]] = impact[at]
        # other terms that several tails have: postings by term, and each tail's terms
        at = ~common[term] & (held[term] > 1)
        doc, term, impact = doc[at], term[at], impact[at]
        self.query_at, self.query_terms = np.searchsorted(doc, np.arange(self.n + 1)), term
        order = np.argsort(term, kind="stable")
        self.docs, self.impacts = doc[order], impact[order]
        self.at = np.searchsorted(term[order], np.arange(VOCABULARY + 1))

    def scores(self, seeds: list[int]) -> np.ndarray:
        """A row for each seed: every tail's score by all of the seed's terms; the seed itself has 0."""
        out = (self.matrix[seeds] > 0).astype(np.float32) @ self.matrix.T
        for row, seed in zip(out, seeds, strict=True):
            runs = [slice(self.at[t], self.at[t + 1]) for t in self.query_terms[self.query_at[seed] : self.query_at[seed + 1]]]
            if runs:
                row += np.bincount(np.concatenate([self.docs[r] for r in runs]), weights=np.concatenate([self.impacts[r] for r in runs]), minlength=self.n)
            row[seed] = 0.0
        return out


def ranked(score: np.ndarray, used: np.ndarray) -> Iterator[np.ndarray]:
    """Unused tails with a score, best first: the NEAR best, then all others."""
    left = np.where(used, 0.0, score)
    found = np.flatnonzero(left)
    if len(found) > NEAR:
        part = np.argpartition(-left[found], NEAR)
        first, rest = np.sort(found[part[:NEAR]]), found[part[NEAR:]]
        yield first[np.argsort(-left[first], kind="stable")]
        found = np.sort(rest)
    yield found[np.argsort(-left[found], kind="stable")]


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, mean_length: float) -> list[list[tuple[int, int, int]]]:
    """Windows of (tail, first id, ids); every id of every tail lies in one of them."""
    index = ShardIndex(tails, idf, mean_length)
    left = np.array([len(t) for t in tails], dtype=np.int64)
    start = np.zeros(len(tails), dtype=np.int64)
    used = left == 0
    order = np.argsort(-left, kind="stable")
    windows, at = [], 0

    def take(j: int, room: int) -> int:
        n = int(min(left[j], room))
        window.append((int(j), int(start[j]), n))
        start[j] += n
        left[j] -= n
        used[j] = left[j] == 0
        return room - n

    scored: dict[int, np.ndarray] = {}
    while at < len(order):
        seed = order[at]
        if used[seed]:
            at += 1
            continue
        window: list[tuple[int, int, int]] = []
        room = take(seed, WINDOW)
        if room:
            if seed not in scored:
                ahead = order[at : at + 4 * SEEDS]
                seeds = [seed, *ahead[~used[ahead]][: SEEDS - 1].tolist()]
                scored = dict(zip(map(int, seeds), index.scores(seeds), strict=True))
            for near in ranked(scored[int(seed)], used):
                for j in near:
                    if left[j] <= room and room:
                        room = take(j, room)
                for j in near if room else ():
                    if not used[j] and room:
                        room = take(j, room)
                if not room:
                    break
            k = at
            while room and k < len(order):
                if not used[order[k]]:
                    room = take(order[k], room)
                k += 1
        windows.append(window)
    return windows


def content_key(ids: np.ndarray, frequency: np.ndarray, other: int) -> int:
    """The smallest hash among the tail's rarest terms that other tails have too; the other number if there is none."""
    terms = np.unique(ids).astype(np.int64)
    terms = terms[frequency[terms] > 1]
    if not len(terms):
        return other
    by_frequency = frequency[terms] * VOCABULARY + terms
    rarest = (np.partition(by_frequency, RARE_TERMS)[:RARE_TERMS] if len(terms) > RARE_TERMS else by_frequency).astype(np.uint64) % np.uint64(VOCABULARY)
    x = (rarest + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return int(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)).min())


def deal(tails: DataFrame, frequency: np.ndarray, tokens: int) -> DataFrame:
    """tails with shard, by content; a shard has at most about two times SHARD_TOKENS."""
    n_groups = GROUPS * max(1, -(-tokens // SHARD_TOKENS))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.frombuffer(t, dtype="<u2") for t in pdf["tail"]]
            keys = [content_key(x, frequency, h) % n_groups for x, h in zip(found, pdf["other"].tolist(), strict=True)]
            yield pdf.assign(group=np.array(keys, dtype=np.int64), n=np.array([len(x) for x in found], dtype=np.int64))

    # the smallest hash is not spread evenly over its range; its remainder is
    # equal rows are told apart by their place in the written tails, so that they can be split too
    other = F.pmod(F.xxhash64(F.lit(5), "doc_id", "doc_tokens", "tail", F.monotonically_increasing_id()), F.lit(1 << 40))
    placed = cut_lineage(tails.withColumn("other", other).mapInPandas(place, f"{_TAILS}, other long, group long, n long"))
    size = np.zeros(n_groups, dtype=np.int64)
    for r in placed.groupBy("group").agg(F.sum("n").alias("n")).collect():
        size[r["group"]] = r["n"]
    # groups over half a shard are split over shards of their own; the others fill shards in turn
    parts = np.where(size > SHARD_TOKENS // 2, -(-size // SHARD_TOKENS), 0)
    filled = np.cumsum(np.where(parts > 0, 0, size)) // SHARD_TOKENS
    first = np.where(parts > 0, filled.max() + 1 + np.cumsum(parts) - parts, filled)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = pdf["group"].to_numpy()
            yield pdf.drop(columns=["other", "group", "n"]).assign(shard=(first[g] + pdf["other"].to_numpy() % np.maximum(parts[g], 1)).astype(np.int32))

    return placed.mapInPandas(shards, f"{_TAILS}, shard int")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All ids of docs in sequences of at most WINDOW ids: one row for each piece of a document."""
    tails = cut_lineage(tokenize_tails(docs, path))
    frequency, n, tokens = document_frequencies(tails)
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
    mean_length = tokens / max(n, 1)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "doc_tokens", "tail"]).reset_index(drop=True)
        ids = [np.frombuffer(t, dtype="<u2") for t in pdf["tail"]]
        doc, n_ids = pdf["doc_id"].tolist(), pdf["doc_tokens"].tolist()
        sequence, rows = int(key[0]) << 32, []
        for d, size, crcs in zip(doc, n_ids, pdf["full_crcs"], strict=True):
            for k, crc in enumerate(crcs):
                rows.append((d, k * WINDOW, WINDOW, int(crc), size, sequence, 0))
                sequence += 1
        for window in pack_shard(ids, idf, mean_length):
            offset = 0
            for j, first, length in window:
                rows.append((doc[j], n_ids[j] // WINDOW * WINDOW + first, length, _crc(ids[j][first : first + length]), n_ids[j], sequence, offset))
                offset += length
            sequence += 1
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])

    pieces = deal(tails, frequency, tokens).groupBy("shard").applyInPandas(run, PIECES.replace("doc_id long", "doc_id string"))
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))
