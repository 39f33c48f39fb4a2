"""Language-model scores by context-tree weighting over bytes.

A text is its UTF-8 bytes, A-Z in lower case, closed by an end byte that UTF-8
never uses. Each byte is eight binary decisions; each decision has, for every
depth of context from none to DEPTH preceding bytes, a node with a
Krichevsky-Trofimov estimate. The weighted probability of a node is half its own
estimate and half the product of its children's; the same weights mix the
estimates of all depths when a byte is scored. A context that training never saw
hands down the estimate of the deepest one that it did.

Counts cover every training text. Work moves in packed rows: a block of
documents gives, for each bucket of contexts, its sorted grams (context and next
byte, at most 48 bits) and their counts; buckets merge them over all blocks,
weigh the subtrees of their contexts, and answer every block with the log
probabilities of its own grams. Buckets grow in number with the blocks. Contexts
of two bytes go to buckets by hash; one that holds more than a bucket's share is
split by the third byte, and the blocks that ask such a part are spread over
copies of it, each for a bucket's share of questions. Shares are estimated from a bounded
sample and only settle who does what: results do not depend on them. Through the
driver pass the nodes of depth 0 and 1, at most 65,535, and those of depth 2
below the split contexts, at most MOST_SPLIT times 255.

Within a bucket one slice of whole subtrees and one of the eight decisions are
in memory at a time.

Nulls and edges: a null text is empty and scores its end alone; a null doc_id
counts as training; repeated rows count repeatedly; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import chunks, cut_lineage, keyed_texts

#: Bytes of context (key layout holds five), bytes of text in a block, and held-out documents: remainder HELD of FOLDS.
DEPTH, BLOCK_BYTES, FOLDS, HELD = 5, 16_000_000, 7, 2
#: Bytes of the sample that shares are estimated from; contexts that are split at most; grams of a slice; partitions at most.
SAMPLE_BYTES, MOST_SPLIT, SLICE, MOST_PARTITIONS = 32_000_000, 1024, 60_000, 20_000
END = 0xFF

_ODD = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_HALF = np.log(0.5)
_PACKED = "kind int, bucket int, salts int, block int, keys binary, vals binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def _pack(x: np.ndarray) -> bytes:
    """Numbers of eight bytes, bytes of like weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(dtype).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


class Stream:
    """Concatenated texts as bytes, each with its end byte, behind DEPTH bytes of padding."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        pad, end = bytes([END]) * DEPTH, bytes([END])
        data = np.frombuffer(b"".join(x for r in raw for x in (pad, r, end)), dtype=np.uint8)
        self.data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.size = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        whole = self.size + DEPTH
        self.first = np.cumsum(self.size) - self.size
        #: places of the bytes to score, text by text
        self.at = np.arange(int(self.size.sum())) + np.repeat(np.arange(1, len(raw) + 1) * DEPTH, self.size)
        self.doc = np.repeat(np.arange(len(raw)), self.size)
        self.whole = whole

    def grams(self) -> np.ndarray:
        """Nearest context byte first, the byte itself last: contexts of depth d share the leading d bytes."""
        key = np.zeros(len(self.at), dtype=np.uint64)
        for k in range(1, DEPTH + 1):
            key = key << np.uint64(8) | self.data[self.at - k].astype(np.uint64)
        return key << np.uint64(8) | self.data[self.at].astype(np.uint64)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each token, its text): the words and, as 0, the end of each text."""
        text = self.data[self.at]
        space = (text == 32) | ((text >= 9) & (text <= 13))
        last = np.cumsum(self.size) - 1
        space[last] = True
        begin = ~space & np.r_[True, space[:-1]]
        head = np.flatnonzero(begin)
        if not len(head):
            return np.zeros(len(last), dtype=np.uint64), np.arange(len(last))
        inside = np.flatnonzero(~space)
        word = np.cumsum(begin)[inside] - 1
        offset = (inside - head[word]).astype(np.uint64)
        # byte and place are mixed together, so the sum depends on order
        value = _mix((text[inside].astype(np.uint64) + np.uint64(1)) * _ODD + offset * _A)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[starts, len(word)]).astype(np.uint64)
        hashed = np.maximum(_mix(np.add.reduceat(value, starts) + size * _ODD), np.uint64(1))
        return np.r_[hashed, np.zeros(len(last), dtype=np.uint64)], np.r_[self.doc[head], np.arange(len(last))]


def _merged(keys: list[np.ndarray], vals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    if len(keys) == 1:
        return keys[0], vals[0]
    k, v = np.concatenate(keys), np.concatenate(vals)
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order]
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, dtype=np.int64)
    return k[head], np.add.reduceat(v, head) if len(head) else v


class Sum:
    """Keys and values gathered piece by piece; merged whenever much has come."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.vals: list[np.ndarray] = []
        self.held = self.base = 0

    def add(self, keys: np.ndarray, vals: np.ndarray) -> None:
        self.keys.append(keys)
        self.vals.append(vals)
        self.held += len(keys)
        if self.held > 2 * self.base + 2_000_000:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        k, v = _merged(self.keys, self.vals)
        self.keys, self.vals, self.held, self.base = [k], [v], len(k), len(k)
        return k, v


def _runs_of(pdf: pd.DataFrame, names: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Neighbouring rows with the same values of the named columns."""
    cols = [pdf[c].to_numpy() for c in names]
    if not len(pdf):
        return
    new = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
    for a, b in zip(new, np.r_[new[1:], len(pdf)], strict=True):
        yield tuple(c[a] for c in cols), pdf.iloc[a:b]


class Plan:
    """Which bucket a gram goes to, and over how many copies of a bucket its questions are spread."""

    def __init__(self, buckets: int, shares: dict[int, float], blocks: int):
        """shares: of contexts of three bytes (the nearest first), of all grams."""
        self.hashed = buckets
        by_two: dict[int, float] = {}
        for c, x in shares.items():
            by_two[c >> 8] = by_two.get(c >> 8, 0.0) + x
        split = sorted((c for c, x in by_two.items() if x * buckets > 1), key=lambda c: (-by_two[c], c))[:MOST_SPLIT]
        self.contexts = np.array(sorted(split), dtype=np.int64)
        self.parts = np.array([min(256, math.ceil(2 * by_two[c] * buckets)) for c in self.contexts], dtype=np.int64)
        self.first = buckets + np.cumsum(self.parts) - self.parts
        load = np.zeros(int(self.parts.sum()))
        place = {int(c): k for k, c in enumerate(self.contexts)}
        for c, x in shares.items():
            if (k := place.get(c >> 8)) is not None:
                load[self.first[k] - buckets + (c & 255) % self.parts[k]] += x
        self.salts = np.clip(np.ceil(load * buckets), 1, max(blocks, 1)).astype(np.int64)
        self.most_salts = int(self.salts.max(initial=1))
        self.buckets = buckets + len(load)

    def of(self, kind: int, keys: np.ndarray) -> np.ndarray:
        part = keys >> np.uint64(8 * (DEPTH - 1)) if kind == 0 else keys
        out = (_mix(part * _ODD + _A) % np.uint64(self.hashed)).astype(np.int64)
        if kind == 0 and len(self.contexts):
            k = np.minimum(np.searchsorted(self.contexts, part.astype(np.int64)), len(self.contexts) - 1)
            inside = self.contexts[k] == part.astype(np.int64)
            third = (keys >> np.uint64(8 * (DEPTH - 2)) & np.uint64(255)).astype(np.int64)
            out = np.where(inside, self.first[k] + third % self.parts[k], out)
        return out

    def salts_of(self, bucket: int) -> int:
        return int(self.salts[bucket - self.hashed]) if bucket >= self.hashed else 1

    def context(self, bucket: int) -> int | None:
        """Which of the split contexts the bucket has a part of."""
        return int(np.searchsorted(self.first, bucket, side="right") - 1) if bucket >= self.hashed else None


def _triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """context, n: how often each three bytes, the nearest first, stand before a byte."""
    held = Sum()
    for pdf in batches:
        texts = pdf["text"].tolist()
        for a, b in chunks(texts):
            keys = Stream(texts[a:b]).grams() >> np.uint64(8 * (DEPTH - 2))
            held.add(*np.unique(keys, return_counts=True))
    keys, n = held.total()
    yield pd.DataFrame({"context": keys.astype(np.int64), "n": n.astype(np.int64)})


def plan(texts: DataFrame, total: int, blocks: int) -> Plan:
    """From a sample of at most about SAMPLE_BYTES, chosen by hash; contexts beyond the MOST_SPLIT * 16 commonest have small shares."""
    chance = min(1.0, SAMPLE_BYTES / max(total, 1))
    sample = texts.where(F.pmod(F.xxhash64(F.lit(29), "doc_id", F.length("text")), F.lit(1 << 20)) < F.lit(int(chance * (1 << 20))))
    counts = sample.select("text").mapInPandas(_triples, "context int, n long").groupBy("context").agg(F.sum("n").alias("n"))
    found = [tuple(r) for r in counts.orderBy(F.desc("n"), "context").limit(MOST_SPLIT * 16).collect()]
    everything = counts.agg(F.sum("n")).first()[0] or 1
    return Plan(max(32, 2 * blocks), {c: n / everything for c, n in found}, blocks)


def _count(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(block: int, sums: list[Sum]) -> pd.DataFrame:
            rows = []
            for kind, s in enumerate(sums):
                keys, vals = s.total()
                of = plan.of(kind, keys)
                order = np.argsort(of, kind="stable")
                heads = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]]) if len(of) else []
                for x, y in zip(heads, [*heads[1:], len(of)], strict=True):
                    at = order[x:y]
                    b = int(of[at[0]])
                    rows.append((kind, b, 1 if kind else plan.salts_of(b), block, _pack_sorted(keys[at]), _pack(vals[at])))
            return pd.DataFrame(rows, columns=["kind", "bucket", "salts", "block", "keys", "vals"])

        block, sums = None, [Sum(), Sum()]
        for pdf in batches:
            for (now,), part in _runs_of(pdf, ["block"]):
                if block is not None and now != block:
                    yield packed(block, sums)
                    sums = [Sum(), Sum()]
                block = now
                texts, train = part["text"].tolist(), ~part["held_out"].to_numpy(dtype=bool)
                for a, b in chunks(texts):
                    s = Stream(texts[a:b])
                    for kind, (keys, doc) in enumerate(((s.grams(), s.doc), s.tokens())):
                        codes, names = pd.factorize(keys)
                        n = np.bincount(codes, weights=train[a:b][doc], minlength=len(names)).astype(np.int64)
                        order = np.argsort(names)
                        sums[kind].add(names[order], n[order])
        if block is not None:
            yield packed(block, sums)

    return run


def _sum_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (kind, bucket): one row for each, with the sums over its rows."""
    now, s = None, Sum()
    for pdf in batches:
        for key, part in _runs_of(pdf, ["kind", "bucket", "salts"]):
            if now is not None and key != now:
                yield _one_row(now, s)
                s = Sum()
            now = key
            for k, v in zip(part["keys"], part["vals"], strict=True):
                s.add(_unpack_sorted(k), _unpack(v, np.int64))
    if now is not None:
        yield _one_row(now, s)


def _one_row(key: tuple, s: Sum) -> pd.DataFrame:
    k, v = s.total()
    return pd.DataFrame({"kind": [key[0]], "bucket": [key[1]], "salts": [key[2]], "block": [-1], "keys": [_pack_sorted(k)], "vals": [_pack(v)]})


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series eight places on."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Depth:
    """The grams of one depth: their keys in order, counts, and each one's place among those a byte shorter."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.place: np.ndarray | None = None

    def shorter(self) -> Depth:
        low = np.uint64(255)
        names, place = np.unique(self.keys >> np.uint64(16) << np.uint64(8) | self.keys & low, return_inverse=True)
        self.place = place.astype(np.int32)
        return Depth(names, np.bincount(place, weights=self.counts, minlength=len(names)).astype(np.int64))


class Nodes:
    """The nodes of one depth for one of the eight decisions: counts, the weighted estimate and the weight of stopping here."""

    def __init__(self, depth: Depth, k: int, below: Nodes | None, place: np.ndarray | None):
        keys = depth.keys
        name = keys >> np.uint64(8) << np.uint64(8) | np.uint64(1 << k) | (keys & np.uint64(255)) >> np.uint64(8 - k)
        new = np.r_[True, name[1:] != name[:-1]]
        self.head = np.flatnonzero(new)
        self.name = name[self.head]
        #: each gram's node
        self.row = (np.cumsum(new) - 1).astype(np.int32)
        bit = (keys >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
        self.n1 = np.add.reduceat(depth.counts * bit, self.head).astype(float)
        self.n0 = np.add.reduceat(depth.counts, self.head) - self.n1
        self.weighted = log_kt(self.n0, self.n1)
        self.stop = np.ones(len(self.head))
        if below is not None:
            # half the node's own estimate, half the product of its children's
            children = np.bincount(self.row[place[below.head]], weights=below.weighted, minlength=len(self.head))
            own = _HALF + self.weighted
            self.weighted = np.logaddexp(own, _HALF + children)
            self.stop = np.exp(own - self.weighted)

    @property
    def one(self) -> np.ndarray:
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1)


def slices(keys: np.ndarray, depth: int) -> Iterator[tuple[int, int]]:
    """Runs of grams of at least SLICE, as far as they go, that end where a context of the depth does."""
    context = keys >> np.uint64(8 * (DEPTH + 1 - depth))
    ends = np.append(np.flatnonzero(context[1:] != context[:-1]) + 1, len(keys)) if len(keys) else []
    start = 0
    for e in ends:
        if e - start >= SLICE or e == len(keys):
            yield start, int(e)
            start = int(e)


def depths(keys: np.ndarray, counts: np.ndarray, least: int) -> list[Depth]:
    """From DEPTH up to the least."""
    out = [Depth(keys, counts)]
    for _ in range(DEPTH - least):
        out.append(out[-1].shorter())
    return out


def decisions(found: list[Depth]) -> Iterator[tuple[int, list[Nodes]]]:
    for k in range(8):
        nodes: list[Nodes] = []
        for i, d in enumerate(found):
            nodes.append(Nodes(d, k, nodes[-1] if i else None, found[i - 1].place if i else None))
        yield k, nodes


def _summaries(plan: Plan):
    """From merged rows, sums of counts and weighted estimates by the node they belong to: by (nearest byte, node), of a split context by (it, node) from 65,536 on; tokens and distinct ones as name -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, bucket, k, v in zip(pdf["kind"], pdf["bucket"], pdf["keys"], pdf["vals"], strict=True):
                keys, counts = _unpack_sorted(k), _unpack(v, np.int64)
                if kind:
                    yield pd.DataFrame({"name": [-1], "n0": [float(counts.sum())], "n1": [float((counts > 0).sum())], "weighted": [0.0]})
                    continue
                context = plan.context(bucket)
                least = 2 if context is None else 3
                for a, b in slices(keys, least):
                    for _, nodes in decisions(depths(keys[a:b], counts[a:b], least)):
                        top = nodes[-1]
                        node = (top.name & np.uint64(255)).astype(np.int64)
                        name = ((context + 256) << 8 | node) if context is not None else ((top.name >> np.uint64(16)).astype(np.int64) << 8 | node)
                        names, place = np.unique(name, return_inverse=True)
                        total = lambda x: np.bincount(place, weights=x, minlength=len(names))  # noqa: E731, B023
                        yield pd.DataFrame({"name": names, "n0": total(top.n0), "n1": total(top.n1), "weighted": total(top.weighted)})

    return run


class Top:
    """What lies above the buckets: by node, by (nearest byte, node) and by (split context, node), the count, the estimate of a one, and the weight of stopping there."""

    def __init__(self, rows: list, contexts: np.ndarray):
        two = np.zeros((3, len(contexts), 256))
        n0, n1, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for name, a, b, w in rows:
            if name >= 65_536:
                two[:, (name >> 8) - 256, name & 255] = a, b, w
            else:
                n0[name >> 8, name & 255], n1[name >> 8, name & 255], below[name >> 8, name & 255] = a, b, w
        own = _HALF + log_kt(two[0], two[1])
        both = np.logaddexp(own, _HALF + two[2])
        for k, c in enumerate(contexts):
            some = two[0, k] + two[1, k] > 0
            n0[c >> 8] += two[0, k]
            n1[c >> 8] += two[1, k]
            below[c >> 8] += np.where(some, both[k], 0.0)
        one = np.logaddexp(_HALF + log_kt(n0, n1), _HALF + below)
        r0, r1 = n0.sum(axis=0), n1.sum(axis=0)
        root = np.logaddexp(_HALF + log_kt(r0, r1), _HALF + one.sum(axis=0))
        self.n = [r0 + r1, n0 + n1, two[0] + two[1]]
        self.one = [(r1 + 0.5) / (r0 + r1 + 1), (n1 + 0.5) / (n0 + n1 + 1), (two[1] + 0.5) / (two[0] + two[1] + 1)]
        self.stop = [np.exp(_HALF + log_kt(r0, r1) - root), np.exp(_HALF + log_kt(n0, n1) - one), np.exp(own - both)]


def log_probabilities(keys: np.ndarray, counts: np.ndarray, top: Top, context: int | None) -> np.ndarray:
    """log10 of each gram's last byte given its context; context: which split one all grams of the bucket have, if any."""
    out = np.zeros(len(keys))
    for a, b in slices(keys, 2 if context is None else 3):
        found = depths(keys[a:b], counts[a:b], 2 if context is None else 3)
        at = [np.arange(b - a, dtype=np.int32)]
        for d in found[:-1]:
            at.append(d.place[at[-1]])
        byte = keys[a:b] & np.uint64(255)
        near = (keys[a:b] >> np.uint64(8 * DEPTH)).astype(np.int64)
        for k, nodes in decisions(found):
            bit = (byte >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
            node = (np.uint64(1 << k) | byte >> np.uint64(8 - k)).astype(np.int64)
            p, seen = np.full(b - a, 0.5), np.zeros(b - a, dtype=bool)
            steps = [(x.n0 + x.n1, x.one, x.stop, x.row[i]) for x, i in zip(nodes, at, strict=True)]
            if context is not None:
                steps.append((top.n[2][context], top.one[2][context], top.stop[2][context], node))
            steps += [(top.n[1], top.one[1], top.stop[1], (near, node)), (top.n[0], top.one[0], top.stop[0], node)]
            for n, one, stop, i in steps:
                own = np.where(bit, one[i], 1 - one[i])
                here = n[i] > 0
                p = np.where(here, np.where(seen, stop[i] * own + (1 - stop[i]) * p, own), p)
                seen |= here
            out[a:b] += np.log10(p)
    return out


def _answer(top: Top, plan: Plan):
    """Rows sorted by (kind, bucket), the merged row (block -1) first: each block's keys with log probability or count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = keys = value = None
        for pdf in batches:
            rows = []
            for kind, bucket, salts, block, k, v in pdf[["kind", "bucket", "salts", "block", "keys", "vals"]].itertuples(index=False):
                if block < 0:
                    now, keys, counts = (kind, bucket), _unpack_sorted(k), _unpack(v, np.int64)
                    value = counts.astype(float) if kind else log_probabilities(keys, counts, top, plan.context(bucket))
                    continue
                assert now == (kind, bucket)
                own = _unpack_sorted(k)
                rows.append((kind, bucket, salts, block, k, _pack(value[np.searchsorted(keys, own)])))
            yield pd.DataFrame(rows, columns=["kind", "bucket", "salts", "block", "keys", "vals"])

    return run


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The answers of all buckets by key; the list is emptied on the way."""
    if not held:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    keys, values = np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])
    held.clear()
    order = np.argsort(keys)
    return keys[order], values[order]


def _score(n_tokens: float, n_distinct: float):
    """Rows sorted by (block, answers first): each document's scores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, tables = None, [[], []], None
        for pdf in batches:
            for (now,), part in _runs_of(pdf, ["block"]):
                if now != block:
                    block, held, tables = now, [[], []], None
                answers = part["kind"].to_numpy() >= 0
                for kind, k, v in part.loc[answers, ["kind", "keys", "vals"]].itertuples(index=False):
                    held[kind].append((_unpack_sorted(k), _unpack(v, np.float64)))
                docs = part[~answers]
                if not len(docs):
                    continue
                if tables is None:
                    tables = [_joined(held[kind]) for kind in range(2)]
                texts = docs["text"].tolist()
                for a, b in chunks(texts):
                    s, size = Stream(texts[a:b]), b - a
                    logp = _looked_up(s.grams(), tables[0])
                    keys, doc = s.tokens()
                    c = _looked_up(keys, tables[1])
                    base = np.log10((c + 1) / (n_tokens + n_distinct + 1))
                    of = docs.iloc[a:b]
                    yield pd.DataFrame(
                        {
                            "doc_id": of["doc_id"].array,  # text: a null would turn numbers into floats
                            "held_out": of["held_out"].array,
                            "n_tokens": np.bincount(doc, minlength=size),
                            "n_known": np.bincount(doc, weights=c > 0, minlength=size).astype(np.int64),
                            "train_tokens": int(n_tokens),
                            "base_score": np.bincount(doc, weights=base, minlength=size),
                            "score": np.bincount(s.doc, weights=logp, minlength=size),
                            "n_bytes": s.size,
                        }
                    )

    return run


def _looked_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    codes, names = pd.factorize(keys)
    return table[1][np.searchsorted(table[0], names)][codes]


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability), bits_per_byte."""
    texts = keyed_texts(docs)
    total = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = int(max(1, -(-total // BLOCK_BYTES)))
    dealing = plan(texts, total, blocks)
    out_of = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS == HELD
    block = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int")
    dealt = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce(out_of, F.lit(False)).alias("held_out"), block.alias("block"))
    by_block, by_bucket = min(blocks, MOST_PARTITIONS), min(dealing.buckets, MOST_PARTITIONS)
    counted = cut_lineage(dealt.repartitionById(by_block, F.col("block") % by_block).sortWithinPartitions("block").mapInPandas(_count(dealing), _PACKED))

    def summed(rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(by_bucket, "kind", "bucket", *by).sortWithinPartitions(*by, "kind", "bucket").mapInPandas(_sum_rows, _PACKED)

    # the rows of a bucket with copies are summed for each copy first
    salted = counted.withColumn("salt", F.pmod("block", "salts"))
    merged = summed(salted, "salt") if dealing.most_salts > 1 else counted
    merged = cut_lineage(summed(merged.select("kind", "bucket", "salts", "block", "keys", "vals")))
    rows = merged.mapInPandas(_summaries(dealing), "name int, n0 double, n1 double, weighted double").groupBy("name").agg(F.sum("n0"), F.sum("n1"), F.sum("weighted")).collect()
    top = Top([tuple(r) for r in rows if r[0] >= 0], dealing.contexts)
    n_tokens, n_distinct = next(((r[1], r[2]) for r in rows if r[0] < 0), (0.0, 0.0))

    asked = merged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).unionByName(salted)
    answers = asked.repartition(by_bucket, "kind", "bucket", "salt").sortWithinPartitions("salt", "kind", "bucket", "block").mapInPandas(_answer(top, dealing), _PACKED)
    none = F.lit(None)
    both = answers.select("block", "kind", "keys", "vals", none.cast("string").alias("doc_id"), none.cast("string").alias("text"), none.cast("boolean").alias("held_out")).unionByName(
        dealt.select("block", F.lit(-1).alias("kind"), none.cast("binary").alias("keys"), none.cast("binary").alias("vals"), "doc_id", "text", "held_out")
    )
    scored = both.repartitionById(by_block, F.col("block") % by_block).sortWithinPartitions("block", F.desc("kind")).mapInPandas(
        _score(float(n_tokens), float(n_distinct)),
        "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long",
    )
    return scored.withColumns({"doc_id": F.col("doc_id").cast("long"), "bits_per_byte": -F.col("score") * F.lit(np.log2(10.0).item()) / F.col("n_bytes")})
