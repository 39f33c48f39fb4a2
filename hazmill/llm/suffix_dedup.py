"""Removal of repeated passages by bucket-pointer refinement.

A byte goes if a string of 100 bytes that covers it also starts earlier, in a
smaller doc_id or earlier in the same document. Suffixes are sorted only as far
as 100 bytes, and only where something can repeat:

1. Initial q-gram buckets. In each window of 100 bytes the q-gram of smallest
   hash is its anchor, so equal windows have equal anchors at equal places. A
   run of windows with one anchor is a row; its bucket is the anchor's q-gram.
2. Rows of a bucket with the same bytes are settled at once: all but the
   earliest go. Buckets left with one row are done.
3. Buckets that hold different rows are refined. Positions start in buckets of
   4-grams and are sorted by (own bucket, bucket of the position 4 further on),
   which gives buckets of 8-grams; the new identifiers are used in turn for 16,
   32, 64 and 100 bytes. Positions alone in a bucket drop out at once. In each
   final bucket all positions but the earliest go.

Copies are first reduced within each map batch, so that a passage costs a
bucket at most one row from each batch. A bucket of very many different rows
is dealt out again by longer grams around the anchor before it is refined.

Nulls and edges: a null text is empty; texts under 100 bytes lose nothing; rows
with a null doc_id neither remove nor lose anything; rows that share a doc_id
and a text are neither earlier than the other; texts that share a doc_id count
as one document where earlier starts are asked for, and each loses its own
bytes alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazmill.llm.common import chunks, cut_lineage, keyed_texts

#: Bytes of a repeated string; bytes of an anchor; rows from which a bucket is dealt out again; windows of a piece then.
LENGTH, GRAM, HEAVY, PIECE = 100, 16, 2_000, 6

_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(0xFFFFFFFF)
_GONE = "doc_id long, part int, start int, n int"
#: Texts of repeated doc_ids up to which their numbers are broadcast; more of them are shuffled.
MOST_BROADCAST = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each place as one number."""
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    out = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        out |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def _content(eight: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start; every length is 8 or more."""
    h = _mix(length.astype(np.uint64))
    for k in range(0, int(length.max(initial=0)), 8):
        at = start + np.minimum(k, length - 8)
        h = np.where(k < length, _mix(h * _A ^ eight[at]), h)
    return h


def anchored_runs(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of concatenated documents: (anchor's hash, hash of the run's bytes, first window, windows, anchor's place)."""
    n, wide = len(data), LENGTH - GRAM + 1
    eight = _words(data, n + 8)
    gram = _mix(eight[:n] * _B + _mix(eight[8 : n + 8]))
    least = np.concatenate([(gram & ~_LOW) | np.arange(n, dtype=np.uint64), np.full(wide, 2**64 - 1, dtype=np.uint64)])
    step = 1
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:n], least[wide - step : wide - step + n])
    ends = np.cumsum(size)
    window = np.flatnonzero(np.arange(n) + LENGTH <= np.repeat(ends, size))
    if not len(window):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    anchor = (least[window] & _LOW).astype(np.int64)
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(window)))
    start = window[head]
    return gram[anchor[head]], _content(eight, start, count + LENGTH - 1), start, count, anchor[head]


def _earliest(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key and place, group's number in that order, whether the row's place is its group's first)."""
    order = np.lexsort((start, doc, *keys))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)[group]
    d, s = doc[order], start[order]
    return order, group, (d == d[first]) & (s == s[first])


def _bytes_of(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return raw, np.frombuffer(b"".join(raw), dtype=np.uint8), np.array([len(x) for x in raw], dtype=np.int64)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (anchor, content, doc_id, part, start, n, rel); those that an earlier equal row of the batch settles have rel -1 and any anchor."""
    for pdf in batches:
        ids, parts, texts = pdf["doc_id"].to_numpy(), pdf["part"].to_numpy(), pdf["text"].tolist()
        for a, b in chunks(texts, 3_000_000):
            _, data, size = _bytes_of(texts[a:b])
            gram, content, start, n, anchor = anchored_runs(data, size)
            if not len(start):
                continue
            row = np.searchsorted(np.cumsum(size), start, side="right")
            doc, part, at = ids[a:b][row], parts[a:b][row], start - (np.cumsum(size) - size)[row]
            order, _, first = _earliest([content, gram], doc, at)
            gone = np.sort(order[~first])
            keep = order[first]
            yield pd.DataFrame({"anchor": gram[keep].view(np.int64), "content": content[keep].view(np.int64), "doc_id": doc[keep], "part": part[keep], "start": at[keep], "n": n[keep], "rel": (anchor - start)[keep]})
            if len(gone):
                # neighbouring runs of a text are one row
                new = np.ones(len(gone), dtype=bool)
                new[1:] = (row[gone][1:] != row[gone][:-1]) | (at[gone][1:] != (at + n)[gone][:-1])
                head = np.flatnonzero(new)
                yield pd.DataFrame({"anchor": gram[gone][head].view(np.int64), "content": 0, "doc_id": doc[gone][head], "part": part[gone][head], "start": at[gone][head], "n": np.add.reduceat(n[gone], head), "rel": -1})


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (anchor, content, doc_id, start): settles equal rows, keeps what differs within an anchor."""
    rest = None
    for pdf in batches:
        done = pdf["rel"].to_numpy() < 0
        if done.any():
            yield pdf.loc[done, ["anchor", "doc_id", "part", "start", "n", "rel"]].assign(heavy=False)
            pdf = pdf[~done]
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = pdf["anchor"].to_numpy()
        # all but the last anchor are complete
        cut = int(np.flatnonzero(last != last[-1])[-1]) + 1 if len(last) and (last != last[-1]).any() else 0
        rest = pdf.iloc[cut:]
        if cut:
            yield _settled(pdf.iloc[:cut])
        elif len(rest) > 500_000:
            # one anchor only: what is settled in it goes now, and one row of each content stays
            out = _settled(rest)
            yield out[out["rel"] < 0]
            rest = rest.drop_duplicates("content", keep="first")
    if rest is not None and len(rest):
        yield _settled(rest)


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of whole anchors: equal rows but the earliest with rel -1, and the rows of anchors with different contents."""
    anchor, content, doc, start = (pdf[c].to_numpy() for c in ("anchor", "content", "doc_id", "start"))
    order, group, first = _earliest([content, anchor], doc, start)
    heads = order[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]
    codes = pd.factorize(anchor[heads])[0]
    variants = np.bincount(codes)[codes]
    at = np.concatenate([order[~first], heads[variants > 1]])
    out = pdf.iloc[at][["anchor", "doc_id", "part", "start", "n", "rel"]]
    n_gone = int(np.count_nonzero(~first))
    rel = out["rel"].to_numpy().copy()
    rel[:n_gone] = -1
    return out.assign(rel=rel, heavy=np.r_[np.zeros(n_gone, dtype=bool), variants[variants > 1] > HEAVY])


def refine(data: np.ndarray, size: np.ndarray, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket-pointer refinement of concatenated rows.

    group numbers the rows' initial buckets, place is each row's start relative
    to its anchor: only windows at the same place of a bucket can be equal.
    Returns (windows in buckets of two or more, their final bucket).
    """
    n = len(data)
    row = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)
    offset = np.arange(n) - (ends - size)[row] + place[row]
    room = ends[row] - np.arange(n)
    pointer = np.full(n + LENGTH, -1, dtype=np.int64)
    eight = _words(data, n) & _LOW

    def buckets(at: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        """New identifiers by sorting; positions alone in their bucket drop out."""
        pointer[:n] = -1
        if not len(at):
            return at
        order = np.lexsort(keys)
        new = np.ones(len(at), dtype=bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        pointer[at[order[many]]] = number[many]
        return np.sort(at[order[many]])

    at = np.flatnonzero(room >= 4)
    at = buckets(at, eight[at].astype(np.int64), (group[row[at]].astype(np.int64) << 16) + offset[at] + LENGTH)
    depth = 4
    while depth < LENGTH:
        ahead = min(depth, LENGTH - depth)
        at = at[room[at] >= depth + ahead]
        at = at[pointer[at + ahead] >= 0]
        own, later = pointer[at].copy(), pointer[at + ahead].copy()
        at = buckets(at, later, own)
        depth += ahead
    return at, pointer[at]


def _refined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket, whole buckets together: the windows that are not their final bucket's first.

    Rows without data are settled already and pass.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["data"].str.len().to_numpy()
        data = np.frombuffer(b"".join(pdf["data"]), dtype=np.uint8)
        group = pd.factorize(pdf["bucket"].to_numpy())[0]
        at, final = refine(data, size, group, pdf["place"].to_numpy())
        row = np.searchsorted(np.cumsum(size), at, side="right")
        doc, part, start = pdf["doc_id"].to_numpy()[row], pdf["part"].to_numpy()[row], pdf["start"].to_numpy()[row] + at - (np.cumsum(size) - size)[row]
        order, _, first = _earliest([final], doc, start)
        gone = order[~first]
        return _joined(doc[gone], part[gone], start[gone])

    rest, held = None, []
    for pdf in batches:
        done = pdf["data"].isna().to_numpy()
        if done.any():
            yield pdf.loc[done, ["doc_id", "part", "start", "n"]]
            pdf = pdf[~done]
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        key = pdf["bucket"].to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if len(key) and (key != key[-1]).any() else 0
        rest = pdf.iloc[cut:]
        for a in range(0, cut, 20_000):
            held.append(pdf.iloc[a : min(a + 20_000, cut)])
        if cut:
            whole = pd.concat(held, ignore_index=True)
            held = []
            bounds = np.flatnonzero(np.r_[True, whole["bucket"].to_numpy()[1:] != whole["bucket"].to_numpy()[:-1]])
            a = 0
            while a < len(whole):
                b = bounds[np.searchsorted(bounds, a + 20_000)] if a + 20_000 <= bounds[-1] else len(whole)
                yield run(whole.iloc[a:b])
                a = b
    if rest is not None and len(rest):
        yield run(rest)


def _joined(doc: np.ndarray, part: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Single windows as rows of consecutive ones."""
    order = np.lexsort((start, part, doc))
    doc, part, start = doc[order], part[order], start[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (start[1:] > start[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.r_[head[1:] - 1, len(doc) - 1][: len(head)]
    return pd.DataFrame({"doc_id": doc[head], "part": part[head], "start": start[head], "n": start[last] - start[head] + 1})


def _payload(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each row that is refined; heavy buckets in pieces keyed by what all of a piece's windows share.

    Settled rows, and all but the earliest of the batch's equal pieces, pass without data.
    """
    for pdf in batches:
        out = []
        for doc_id, part, text, runs in zip(pdf["doc_id"], pdf["part"], pdf["text"], pdf["runs"], strict=True):
            if runs is None or not len(runs):
                continue
            doc = int(doc_id)
            raw = text.encode("utf-8", "surrogatepass")
            for bucket, start, n, rel, heavy in ((x["anchor"], x["start"], x["n"], x["rel"], x["heavy"]) for x in runs):
                if rel < 0:
                    out.append((bucket, doc, part, start, 0, None, n))
                    continue
                if not heavy:
                    out.append((bucket, doc, part, start, -rel, raw[start : start + n + LENGTH - 1], n))
                    continue
                # window w stands rel - w before the anchor; pieces are aligned to the anchor
                w = 0
                while w < n:
                    piece = (rel - w) // PIECE
                    stop = min(n, rel - piece * PIECE + 1)
                    core = raw[start + rel - piece * PIECE : start + rel - (piece + 1) * PIECE + 1 + LENGTH]
                    key = int.from_bytes(hashlib.blake2b(core + bytes([piece]), digest_size=8).digest(), "little", signed=True)
                    out.append((key, doc, part, start + w, w - rel, raw[start + w : start + stop + LENGTH - 1], stop - w))
                    w = stop
        got = pd.DataFrame(out, columns=["bucket", "doc_id", "part", "start", "place", "data", "n"])
        open_ = got["data"].notna().to_numpy()
        yield got[~open_]
        got = got[open_].sort_values(["doc_id", "start"])
        if len(got):
            lead = got.groupby(["bucket", "place", "data"], sort=False)[["doc_id", "start"]].transform("first")
            later = ((lead["doc_id"] != got["doc_id"]) | (lead["start"] != got["start"])).to_numpy()
            yield got.assign(data=got["data"].where(~later, None))


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text, gone in zip(pdf["text"], pdf["gone"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
            upto = -1
            for s, e in sorted((x["start"], x["start"] + x["n"] + LENGTH - 1) for x in gone) if gone is not None else ():
                if s > upto:
                    kept.update(raw[at:s])
                    spans += 1
                    removed += e - s
                elif e > upto:
                    removed += e - upto
                upto = max(upto, e)
                at = upto
            kept.update(raw[at:])
            rows.append((len(raw), removed, spans, kept.hexdigest()))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        out.insert(0, "doc_id", pdf["doc_id"])
        yield out


def numbered(texts: DataFrame) -> DataFrame:
    """texts, and, if rows of a doc_id have several texts, part: each text's number, so that no row stands for another."""
    hashed = texts.withColumn("hash", F.xxhash64("text", F.octet_length("text")))
    several = hashed.where("doc_id is not null").groupBy("doc_id").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("lo <> hi").select("doc_id")
    several = cut_lineage(several)
    n = several.count()
    if not n:
        return texts
    few = n <= MOST_BROADCAST
    distinct = hashed.join(F.broadcast(several) if few else several, "doc_id", "left_semi").select("doc_id", "hash").distinct()
    parts = cut_lineage(distinct.select("doc_id", "hash", F.row_number().over(Window.partitionBy("doc_id").orderBy("hash")).alias("part")))
    few = parts.count() <= MOST_BROADCAST
    return hashed.join(F.broadcast(parts) if few else parts, ["doc_id", "hash"], "left").select("doc_id", "text", F.coalesce("part", F.lit(0)).alias("part"))


def _keys(texts: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "part") if c in texts.columns]


def _parted(rows: DataFrame) -> DataFrame:
    return rows if "part" in rows.columns else rows.withColumn("part", F.lit(0))


def _repeated(texts: DataFrame) -> DataFrame:
    """doc_id, part, start, n of what repeats; texts is (doc_id, text) and part, if need be. One job: no text is shuffled but by its key, once."""
    parts, keys = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8), _keys(texts)
    runs = _parted(texts).where("doc_id is not null").mapInPandas(_runs, "anchor long, content long, doc_id long, part int, start int, n int, rel short")
    ordered = runs.repartition(parts, "anchor").sortWithinPartitions("anchor", "content", "doc_id", "start")
    settled = ordered.mapInPandas(_settle, "anchor long, doc_id long, part int, start int, n int, rel short, heavy boolean")
    by_doc = settled.groupBy(*keys).agg(F.collect_list(F.struct("anchor", "start", "n", "rel", "heavy")).alias("runs"))
    # a left join, as where the bytes are cut out, so that both use one shuffle of the texts
    met = _parted(texts.join(by_doc.hint("merge"), keys, "left")).select(F.col("doc_id").cast("string").alias("doc_id"), "part", "text", "runs")
    payload = met.mapInPandas(_payload, "bucket long, doc_id long, part int, start int, place int, data binary, n int")
    return payload.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(_refined, _GONE)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """doc_id, part, start, n: windows start to start + n - 1 of the text also start earlier; part tells apart the texts of one doc_id."""
    return _repeated(numbered(keyed_texts(docs)))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of docs."""
    texts = numbered(keyed_texts(docs))
    keys = _keys(texts)
    gone = _repeated(texts).groupBy(*keys).agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    # doc_id goes through the tasks as text, since a null would turn numbers into floats
    both = texts.join(gone.hint("merge"), keys, "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "gone")
    return both.mapInPandas(_cut_out, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumn("doc_id", F.col("doc_id").cast("long"))
