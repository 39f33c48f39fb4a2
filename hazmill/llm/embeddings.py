"""Near duplicates among embeddings by iterative quantisation.

A rotation learned on a bounded sample turns each vector into balanced binary
codes; the codes are cut into the keys of several Hamming tables; a vector enters
each table under its key and under the near key whose least certain bit is
flipped; vectors that meet in a table's bucket are compared by their original
components. Tables (and rotations, as one code gives few keys) are added until
pairs at the threshold, made from the sample, meet as often as asked. Within a
bucket comparison runs block by block and gives counts and a spanning forest,
never pairs; buckets above the block's size are split into pairs of blocks.
A pair that meets in several buckets is counted in the first alone.

Nulls and edges: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are components of their own; vectors of
different lengths do not link; those of a length that too few have to learn a
rotation from are compared all with all of that length, in blocks, and so are
those whose codes would need too many tables; equal vectors form a class that is compared
once; equal rows count as separate vectors; vec_id is the identity;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import components, cut_lineage

#: Vectors that the rotation is learned from, at most; rows of a block of a bucket, and rows of a bucket that is compared together with others.
SAMPLE, BLOCK, SMALL = 20_000, 256, 12
#: Pairs whose keys are compared at once.
PAIRS = 1 << 14
#: Vectors of a length that no rotation is learned from, at most.
FEW = 400
#: Share of the pairs at the threshold that may miss all tables, as measured on so many made from the sample; tables beyond which all pairs are compared.
MISS, TRIALS, MOST_TABLES = 0.02, 2_000, 128


def fit_itq(x: np.ndarray, seed: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions): the principal directions turned so that signs lose least."""
    mean = x.mean(axis=0)
    c = x - mean
    _, axes = np.linalg.eigh(c.T @ c)
    v = c @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        code = np.where(v @ r >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(v.T @ code)
        r = a @ b
    return mean, axes @ r


def key_bits(n: int, dims: int) -> int:
    """Bits of a key: buckets hold a few random vectors each, entered twice a table."""
    return min(dims, max(8, min(32, math.ceil(math.log2(max(n, 2))) + 1)))


def table_keys(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    """(rows, tables, 2): of each table of a rotation the key, and the key whose least certain bit is flipped."""
    mean, turn = model
    lean = (x - mean) @ turn
    powers = 1 << np.arange(bits, dtype=np.int64)
    cut = lean[:, : lean.shape[1] // bits * bits].reshape(len(x), -1, bits)
    key = (cut >= 0) @ powers
    return np.stack([key, key ^ powers[np.abs(cut).argmin(axis=2)]], axis=2)


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, tables): whether the two keys of each have one in common."""
    return (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3))


def mates(x: np.ndarray, threshold: float, seed: int) -> np.ndarray:
    """For each unit vector one at the threshold's cosine, by turns towards another vector and in any direction; the other vector itself if that is nearer."""
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=x.shape)
    noise /= np.sqrt((noise * noise).sum(axis=1, keepdims=True))
    other = x[rng.permutation(len(x))]
    other = np.where((np.arange(len(x)) % 2 == 0)[:, None] & (other != x).any(axis=1, keepdims=True), other, noise)
    cosine = (x * other).sum(axis=1, keepdims=True)
    away = other - cosine * x
    length = np.sqrt((away * away).sum(axis=1, keepdims=True))
    moved = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * away / np.where(length > 0, length, 1)
    return np.where(cosine < threshold, moved, other)


def plan_tables(sample: np.ndarray, bits: int, threshold: float, seed: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int] | None:
    """(rotations, tables) that pairs at the threshold seldom miss altogether; None if that takes too many tables.

    A quarter of the sample, at most TRIALS vectors, is kept from the rotations for measuring, as the rest lies too well in them.
    """
    apart = max(1, min(TRIALS, len(sample) // 4))
    x = np.resize(sample[:apart], (TRIALS, sample.shape[1]))
    learned = sample[apart:] if len(sample) > 1 else sample
    y = mates(x, threshold, seed)
    missed, models, tables = np.ones(len(x), dtype=bool), [], 0
    while tables < MOST_TABLES:
        models.append(fit_itq(learned, seed + len(models)))
        for met in meet(table_keys(x, models[-1], bits), table_keys(y, models[-1], bits)).T:
            missed &= ~met
            tables += 1
            if tables >= 4 and max(missed[::2].mean(), missed[1::2].mean()) <= MISS:
                return models, tables
    return None


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(models: list[tuple[np.ndarray, np.ndarray]], bits: int, tables: int, dtype: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = np.array(pdf["embedding"].tolist(), dtype=dtype)
            if not len(raw):
                continue
            x = _unit(raw)
            keys = np.concatenate([table_keys(x, m, bits) for m in models], axis=1)[:, :tables]
            yield pd.DataFrame({"id": pdf["id"], "n": pdf["n"], "keys": list(keys.reshape(len(raw), -1)), "vector": [v.tobytes() for v in raw]})

    return run


def _packed(dtype: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "n": pdf["n"], "keys": [[]] * len(pdf), "vector": [np.array(v, dtype=dtype).tobytes() for v in pdf["embedding"]], "dims": pdf["dims"]})

    return run


def _met_before(a: np.ndarray, b: np.ndarray, table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the vectors of each pair share a bucket before (table, key); a and b are their keys, (pairs, tables, 2)."""
    t = np.arange(a.shape[1])[None, :, None]
    before = (t < table[:, None, None]) | ((t == table[:, None, None]) & (a < key[:, None, None]))
    return ((a[:, :, :, None] == b[:, :, None, :]) & before[:, :, :, None]).any(axis=(1, 2, 3))


def _by_table(g: pd.DataFrame) -> np.ndarray:
    keys = np.array(g["keys"].tolist(), dtype=np.int64)
    return keys.reshape(len(g), keys.shape[1] // 2, 2)


def _compare(threshold: float, dtype: str, one_length: bool = True):
    """For each block pair: (id, links, mate) of each member with a link that no earlier bucket has."""

    def links(g: pd.DataFrame) -> pd.DataFrame | None:
        g = g.sort_values("id")
        lo, hi = int(g["lo"].iloc[0]), int(g["hi"].iloc[0])
        x = _unit(np.frombuffer(b"".join(g["vector"]), dtype=dtype).reshape(len(g), -1))
        ids, n, keys, block = g["id"].to_numpy(), g["n"].to_numpy(), _by_table(g), g["block"].to_numpy()
        table, key = g["table"].to_numpy(), g["key"].to_numpy()
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if lo != hi:
            near &= block[:, None] != block[None, :]
        if keys.shape[1]:
            left, right = np.nonzero(np.triu(near))
            for k in range(0, len(left), PAIRS):
                a, b = left[k : k + PAIRS], right[k : k + PAIRS]
                seen = _met_before(keys[a], keys[b], table[a], key[a])
                near[a[seen], b[seen]] = near[b[seen], a[seen]] = False
        some = near.any(axis=1)
        if not some.any():
            return None
        label = np.arange(len(g))
        while True:
            new = np.minimum(label, np.where(near, label[None, :], len(g)).min(axis=1))
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({"id": ids[some], "links": (near @ n)[some], "mate": ids[label][some]})

    def small(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame | None:
        """Many small buckets at once: each row against the row k places on, while that is in the same bucket."""
        x = _unit(np.frombuffer(b"".join(pdf["vector"]), dtype=dtype).reshape(len(pdf), -1))
        ids, n, keys = pdf["id"].to_numpy(), pdf["n"].to_numpy(), _by_table(pdf)
        table, key = pdf["table"].to_numpy(), pdf["key"].to_numpy()
        out = []
        for k in range(1, SMALL):
            a = np.flatnonzero(group[k:] == group[:-k])
            if not len(a):
                break
            b = a + k
            a, b = (y[np.einsum("ij,ij->i", x[a], x[b]) >= threshold] for y in (a, b))
            new = ~_met_before(keys[a], keys[b], table[a], key[a])
            a, b = a[new], b[new]
            out += [pd.DataFrame({"id": ids[a], "links": n[b], "mate": ids[b]}), pd.DataFrame({"id": ids[b], "links": n[a], "mate": ids[b]})]
        return pd.concat(out, ignore_index=True) if out else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rest = ["table", "key", "lo", "hi"], None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            start = np.flatnonzero((pdf[key] != pdf[key].shift()).any(axis=1).to_numpy())
            if not len(start):
                continue
            rest = pdf.iloc[start[-1] :]
            size = np.diff(start)
            whole = (pdf["lo"] == pdf["hi"]).to_numpy()[start[:-1]]
            together = (size > 1) & (size <= SMALL) & whole & one_length
            found = [y for a, m in zip(start[:-1][~together], size[~together], strict=True) if m > 1 and (y := links(pdf.iloc[a : a + m])) is not None]
            number = np.repeat(np.where(together, np.arange(len(size)), -1), size)
            chosen = np.flatnonzero(number >= 0)
            if len(chosen) and (y := small(pdf.iloc[chosen], number[chosen])) is not None:
                found.append(y)
            if found:
                yield pd.concat(found, ignore_index=True)
        if rest is not None and len(rest) > 1 and (y := links(rest)) is not None:
            yield y

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row for each row of vectors(vec_id, embedding)."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("embedding"))
    dtype = "float64" if "double" in rows.schema["embedding"].dataType.simpleString() else "float32"
    sound = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('Infinity')) and exists(embedding, c -> c <> 0)")
    usable = F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False))
    valid = rows.where(usable)
    classes = cut_lineage(valid.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("dims", F.size("embedding")))
    lengths = classes.groupBy("dims").count()
    # lengths that many vectors have: at most one for each FEW classes
    common = [(r["dims"], r["count"]) for r in lengths.where(F.col("count") > FEW).orderBy("dims").collect()]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    planned = {d: _of_many(classes.where(F.col("dims") == d), d, n, parts, threshold, dtype, seed) for d, n in common}
    met = [m for m in planned.values() if m is not None]
    done = [d for d, m in planned.items() if m is not None]
    met.append(_of_few(classes.where(~F.col("dims").isin(done)) if done else classes, lengths, parts, threshold, dtype))
    met = cut_lineage(reduce(DataFrame.unionByName, met))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(met.select(F.col("id").alias("a"), F.col("mate").alias("b")))
    per_class = classes.join(links, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    by_vector = per_class.select("embedding", F.col("id").alias("rep"), "n", "links", "component")
    linked = valid.join(by_vector, "embedding")
    component = F.coalesce("component", "rep")
    out = linked.select("vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    return out.unionByName(rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))


def _dealt(entries: DataFrame, sizes: DataFrame, parts: int) -> DataFrame:
    """entries(table, key, ...) of buckets of two or more, in pairs of blocks (lo, hi), those of a pair together and sorted."""
    split = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = entries.join(sizes.where("m > 1").withColumn("blocks", split).drop("m"), ["table", "key"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")
    keys = ["table", "key", "lo", "hi"]
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys)


def _of_few(classes: DataFrame, lengths: DataFrame, parts: int, threshold: float, dtype: str) -> DataFrame:
    """id, links, mate: every two classes of one length compared."""
    packed = classes.select("id", "n", "embedding", "dims").mapInPandas(_packed(dtype), "id long, n long, keys array<long>, vector binary, dims int")
    entries = packed.withColumn("table", F.lit(0)).withColumn("key", F.col("dims").cast("long")).drop("dims")
    sizes = lengths.select(F.lit(0).alias("table"), F.col("dims").cast("long").alias("key"), F.col("count").alias("m"))
    return _dealt(entries, sizes, parts).mapInPandas(_compare(threshold, dtype, one_length=False), "id long, links long, mate long")


def _of_many(classes: DataFrame, dims: int, n: int, parts: int, threshold: float, dtype: str, seed: int) -> DataFrame | None:
    """id, links, mate: the classes of one length that meet in a table's bucket compared; None if tables don't serve them."""
    chosen = classes.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < F.lit(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))).select("id", "embedding").limit(2 * SAMPLE).toPandas().sort_values("id")
    sample = _unit(np.array(chosen["embedding"].tolist() or [[1.0] * dims], dtype=dtype))
    bits = key_bits(n, dims)
    plan = plan_tables(sample, bits, threshold, seed)
    if plan is None:
        return None
    models, tables = plan
    coded = cut_lineage(classes.select("id", "n", "embedding").mapInPandas(_keys(models, bits, tables, dtype), "id long, n long, keys array<long>, vector binary"))
    placed = lambda *names: coded.select(*names, F.posexplode("keys").alias("place", "key")).withColumn("table", F.floor(F.col("place") / 2).cast("int")).drop("place")
    entries = placed("id", "n", "keys", "vector")
    sizes = placed().groupBy("table", "key").agg(F.count("*").alias("m"))
    return _dealt(entries, sizes, parts).mapInPandas(_compare(threshold, dtype), "id long, links long, mate long")
