"""Ranked lexical search by pipelined term partitioning.

Terms are owned by stages, the rarest by the first. Bundles of items pass the
stages in turn; at each the postings of its owner meet what a bundle carries so
far, sparse accumulators of documents, by cogroup within a block of documents,
and integer contributions are added. After a stage the tenth best sum of an item
so far is a floor: a document whose sum with all that later stages can still add
lies below it is let go, so that the frequent terms of the last stages touch few
documents. Nothing else is dropped, and the ranking is exact.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazmill.llm.common import bit_filter, chunks, cut_lineage, keyed_texts, may_hold, stored

K, B = 10, 75
#: Least weight of a term of each stage but the last: terms of one document in about 1,000, 50 and 5.
OWNERS = (6900, 3900, 1600)
#: Items of a bundle, about; documents and characters of a block, at most (one longer text is a block alone).
BUNDLE, BLOCK, BLOCK_CHARS = 128, 4096, 4_000_000

#: Bytes of a text to those of its terms: A-Z lower-cased, what is no part of a term to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and other code points from U+0080 on, as UTF-8."""
    return text.encode().translate(_TABLE).split()


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    for a, b in chunks(texts, BLOCK_CHARS):
        for c in range(a, b, BLOCK):
            yield c, min(b, c + BLOCK)


def postings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each block of documents a row without a term (doc_ids and lengths of all), and one for each term that wanted(term) may hold.

    block names a run of documents; places count within it. docs and lens of a
    term's row are its documents' places and lengths, tfs its occurrences in each.
    """
    bits = bit_filter(wanted.select(F.crc32("term").alias("h")))
    kinds = pa.schema([("term", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("places", pa.binary()), ("tfs", pa.binary()), ("lens", pa.binary()), ("df", pa.int64()), ("tokens", pa.int64())])

    class Wanted(dict):
        def __missing__(self, term: bytes) -> bool:
            self[term] = known = bool(may_hold(bits.value, np.array([zlib.crc32(term)]))[0])
            return known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Wanted()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _blocks(texts):
                found: dict[bytes, list] = defaultdict(list)
                lens = np.zeros(b - a, np.int64)
                for i, text in enumerate(texts[a:b]):
                    terms = terms_of(text)
                    lens[i] = len(terms)
                    for term, tf in Counter(filter(known.__getitem__, terms)).items():
                        found[term].append((i, tf))
                rows = {k: [] for k in kinds.names}

                def add(*values, rows=rows) -> None:
                    for k, v in zip(rows, values, strict=True):
                        rows[k].append(v)

                add(None, batch.column("doc_id").slice(a, b - a).to_pylist(), None, None, lens.tobytes(), int((lens > 0).sum()), int(lens.sum()))
                for term, pairs in found.items():
                    x = np.array(pairs, np.int64)
                    add(term, None, x[:, 0].astype(np.int32).tobytes(), x[:, 1].tobytes(), lens[x[:, 0]].tobytes(), len(x), 0)
                yield pa.RecordBatch.from_pydict({"term": rows["term"], **{k: rows[k] for k in kinds.names[1:]}}, schema=kinds)

    ddl = "term binary, doc_ids array<bigint>, places binary, tfs binary, lens binary, df bigint, tokens bigint"
    made = keyed_texts(docs).mapInArrow(_numbered(run), f"block bigint, {ddl}")
    return stored(made, "postings")


def _numbered(run):
    """run with a number for each block, the first row of which has no term: the task's partition and a count."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        for k, out in enumerate(run(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), base + k)), *out.columns], names=["block", *out.schema.names])

    return numbered


def contribution(tf: np.ndarray, n: np.ndarray, n_docs: int, n_tokens: int) -> np.ndarray:
    """What an occurrence count adds for each point of weight, in integers."""
    m = 100 - B + (B * n * n_docs) // n_tokens
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _impacts(index: DataFrame, n_docs: int, n_tokens: int) -> DataFrame:
    """term, df, most: the largest contribution of any of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [int(contribution(np.frombuffer(t, np.int64), np.frombuffer(n, np.int64), n_docs, n_tokens).max()) for t, n in zip(batch.column("tfs").to_pylist(), batch.column("lens").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("df"), pa.array(most, pa.int64())], names=["term", "df", "most"])

    each = index.where("term is not null").select("term", "df", "tfs", "lens").mapInArrow(run, "term binary, df bigint, most bigint")
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))


def _asked(items: DataFrame) -> DataFrame:
    """uid, term, qtf of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, term, qtf = [], [], []
            for u, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for t, n in Counter(terms_of(text or "")).items():
                    uid.append(u), term.append(t), qtf.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(term, pa.binary()), pa.array(qtf, pa.int64())], names=["uid", "term", "qtf"])

    return items.select("uid", "text").mapInArrow(run, "uid bigint, term binary, qtf bigint")


STATE = "bundle int, block bigint, uids array<bigint>, places array<int>, sums array<bigint>"
_STATE = pa.schema([("bundle", pa.int32()), ("block", pa.int64()), ("uids", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))])


def _stage(state: DataFrame | None, met: DataFrame, n_docs: int, n_tokens: int) -> DataFrame:
    """The accumulators after a stage. met: (bundle, block, places, tfs, lens, who(uid, weight, need, opens)) of its owner's postings.

    need: the least sum an accumulator of the item must have to stay; opens:
    whether a document may still come in here.
    """
    if state is None:
        state = met.sparkSession.createDataFrame([], STATE)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        key = (right if len(right) else left).slice(0, 1)
        bundle, block = key["bundle"][0].as_py(), key["block"][0].as_py()
        flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *[np.asarray(x, kind) for x in left[c].to_pylist()]])
        uids, places, sums = flat("uids", np.int64), flat("places", np.int64), flat("sums", np.int64)
        rows = right.select(["places", "tfs", "lens", "who"]).to_pylist()
        names = np.unique(np.r_[uids, [w["uid"] for r in rows for w in r["who"]]].astype(np.int64))
        row_of = {u: i for i, u in enumerate(names.tolist())}
        width = 1 + max([-1, *places.tolist(), *[int(np.frombuffer(r["places"], np.int32).max()) for r in rows]])
        total = np.zeros((len(names), width), np.int64)  # a bundle's items by a block's documents
        carried = np.searchsorted(names, uids)
        total[carried, places] = sums
        alive = np.zeros(total.shape, bool)
        alive[carried, places] = True
        need = np.zeros(len(names), np.int64)
        for r in rows:
            at = np.frombuffer(r["places"], np.int32)
            part = contribution(np.frombuffer(r["tfs"], np.int64), np.frombuffer(r["lens"], np.int64), n_docs, n_tokens)
            for w in r["who"]:
                i = row_of[w["uid"]]
                total[i, at] += w["weight"] * part
                need[i] = w["need"]
                if w["opens"]:
                    alive[i, at] = True
        alive &= (total >= need[:, None]) & (total > 0)
        i, j = np.nonzero(alive)
        return pa.Table.from_pydict({"bundle": [bundle], "block": [block], "uids": [names[i]], "places": [j.astype(np.int32)], "sums": [total[i, j]]}, schema=_STATE)

    key = ["bundle", "block"]
    return state.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(add, STATE)


def _best(state: DataFrame, k: int) -> DataFrame:
    """uid, sum: of each item the k largest sums, a block's own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uids, sums in zip(batch.column("uids"), batch.column("sums"), strict=True):
                u, s = uids.values.to_numpy(), sums.values.to_numpy()
                order = np.lexsort((-s, u))
                u, s = u[order], s[order]
                first = np.arange(len(u)) - np.searchsorted(u, u) < k
                yield pa.RecordBatch.from_arrays([pa.array(u[first]), pa.array(s[first])], names=["uid", "sum"])

    each = state.select("uids", "sums").mapInArrow(run, "uid bigint, sum bigint")
    order = Window.partitionBy("uid").orderBy(F.col("sum").desc())
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floors(state: DataFrame, k: int) -> DataFrame:
    """uid, least: the k-th best sum so far, of items that have k."""
    return _best(state, k).where(F.col("rank") == k).select("uid", F.col("sum").alias("least"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents with the highest score above 0.

    Every row of docs is a document, repeated ones and those without doc_id (last
    among equal scores) too; a null text has no terms and is never found. Every
    row of items is ranked, equal ones alike; one without a known term has no rows. Columns beyond
    (doc_id, text) and (item_id, text) are ignored. Without documents or items there are no rows.
    """
    own = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    own = cut_lineage(own.groupBy("item_id", "text").agg(F.count("*").alias("copies")).withColumn("uid", F.monotonically_increasing_id()))
    n_bundles = 1 + own.count() // BUNDLE
    asked = cut_lineage(_asked(own))
    index = postings(docs, asked.select("term"))
    n_docs, n_tokens = index.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if not n_docs:
        return own.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    n, df = F.lit(float(2 * n_docs + 2)), F.col("df").cast("double")
    weight = F.floor(1000 * F.log(n / (2 * df + 1)))
    stage = F.lit(len(OWNERS))
    for s, least in reversed(list(enumerate(OWNERS))):
        stage = F.when(F.col("w") >= least, s).otherwise(stage)
    bundle = F.pmod(F.xxhash64("uid"), F.lit(n_bundles)).cast("int")
    asked = asked.join(_impacts(index, n_docs, n_tokens).withColumn("w", weight), "term")
    asked = cut_lineage(asked.select("uid", bundle.alias("bundle"), "term", (F.col("qtf") * F.col("w")).alias("weight"), (F.col("qtf") * F.col("w") * F.col("most")).alias("most"), stage.alias("stage")).where("weight > 0"))
    state = floors = None
    for s in range(len(OWNERS) + 1):
        here = F.sum(F.when(F.col("stage") == s, F.col("most")).otherwise(0)).alias("here")
        rest = asked.groupBy("uid").agg(here, F.sum(F.when(F.col("stage") > s, F.col("most")).otherwise(0)).alias("rest"))
        rest = rest.withColumn("least", F.lit(0).cast("long")) if floors is None else rest.join(floors, "uid", "left").withColumn("least", F.coalesce("least", F.lit(0)))
        who = asked.where(F.col("stage") == s).join(rest, "uid")
        who = F.struct("uid", "weight", (F.col("least") - F.col("rest")).alias("need"), (F.col("here") + F.col("rest") >= F.col("least")).alias("opens")), who
        # a bundle's items that ask for a term: at most the bundle
        owner = who[1].groupBy("bundle", "term").agg(F.collect_list(who[0]).alias("who"))
        met = index.where("term is not null").join(owner, "term").select("bundle", "block", "places", "tfs", "lens", "who")
        state = cut_lineage(_stage(state, met, n_docs, n_tokens))
        floors = cut_lineage(_floors(state, k))
    held = state.join(index.where("term is null").select("block", "doc_ids"), "block")
    least = {"uid": "bigint", "doc_id": "bigint", "score": "bigint"}

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(len(batch)):
                at = batch.column("places")[c].values
                yield pa.RecordBatch.from_arrays([batch.column("uids")[c].values, batch.column("doc_ids")[c].values.take(at), batch.column("sums")[c].values], names=list(least))

    found = held.select("uids", "places", "sums", "doc_ids").mapInArrow(named, ", ".join(f"{c} {t}" for c, t in least.items()))
    found = found.join(floors, "uid", "left").where(F.col("score") >= F.coalesce("least", F.lit(0)))
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    copy = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return ranked.join(own.select("uid", "item_id", "copies"), "uid").select("item_id", "rank", "doc_id", "score", copy.alias("copy")).drop("copy")
