"""Mixing sources to target weights by balanced sampling with the cube method.

Sources share a total of words by weight, capped at twice their own size. A
source whose target is p times its size takes every document floor(p) times and
once more with the fractional chance; which ones is settled by the cube method:
chances move along directions that leave the totals of documents and of words
unchanged until they are 0 or 1. The flight runs in salted blocks of bounded
size, the few undecided documents of the blocks fly again together, and so on
until one block a source is left, whose last two documents are landed.

Nulls and edges: a null source is a source of its own, last in order; a null
text has size 0; equal rows are separate documents; an empty table gives an
empty result; other columns are ignored (shares) or kept (mixed documents).
Reruns agree: chances come from the seed, the source's place and the block.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazmill.llm.common import cut_lineage, text_of, word_count

#: Weights by the source's place, repeating; the share of all words that the mix takes; the most copies of a document.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents that one flight handles, and sources up to which their table is broadcast (larger ones are shuffled).
BLOCK, MOST_BROADCAST = 4096, 100_000

_UNIT = "place int, doc_id long, part long, size long, chance double"


def placed(by: DataFrame) -> DataFrame:
    """Adds place: the number of each source in order, null last; sources are sorted in ranges, not in one task."""
    order = F.col("source").asc_nulls_last()
    ranged = cut_lineage(by.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())
    before = dict(zip((p for p, _ in counts), itertools.accumulate([0, *[n for _, n in counts]]), strict=False))
    first = F.lit(0)
    for part, n in before.items():
        first = F.when(F.col("part") == part, n).otherwise(first)
    return ranged.withColumn("place", (first + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1).cast("int")).drop("part")


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, size) rows: source, place, source_size, n_docs, target.

    Water filling: min(cap, level * weight) sums to the share. The level begins
    at an even share by weight; sources above their cap are set to it and the
    excess raises the level for the others, until no more are above.
    """
    by = placed(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    by = cut_lineage(by.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size")))
    total, weights, caps, full = SHARE * (by.agg(F.sum("source_size")).first()[0] or 0), None, 0.0, -1
    level = 0.0
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        now, caps, weights = by.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if now == full or not weights:
            break
        full, level = now, (total - caps) / weights
    target = F.col("cap") if not weights else F.least("cap", F.lit(level) * F.col("weight"))
    return by.select("source", "place", "source_size", "n_docs", target.alias("target"))


def settle_large(z: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """First settles documents above a fiftieth of the open words, all others giving way a little.

    The direction is 1 for the large document and, for every other open one, a
    multiple of p(1 - p) that keeps both totals; a step ends where the first
    chance meets its bound, so each step settles at least one document.
    """
    p = p.copy()
    large = [i for i in np.argsort(-z, kind="stable") if z[i] * 50 > float(np.dot(z, p * (p < 1)))]
    for i in large:
        while 0.0 < p[i] < 1.0:
            w = np.where((p > 0) & (p < 1), p * (1 - p), 0.0)
            w[i] = 0.0
            m = np.array([[w.sum(), np.dot(w, z)], [np.dot(w, z), np.dot(w, z * z)]])
            if np.count_nonzero(w) < 3 or np.linalg.det(m) <= 1e-9 * max(m[0, 0] * m[1, 1], 1e-300):
                return p
            a, b = np.linalg.solve(m, [-1.0, -float(z[i])])
            u = w * (a + b * z)
            u[i] = 1.0
            on = u != 0
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf))
                down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf))
            k_up, k_down = int(np.argmin(up)), int(np.argmin(down))
            step, k = (up[k_up], k_up) if rng.random() * (up[k_up] + down[k_down]) < down[k_down] else (-down[k_down], k_down)
            p[on] += step * u[on]
            p[k] = float(u[k] * step > 0)
            p[p < 1e-9], p[p > 1 - 1e-9] = 0.0, 1.0
    return p


def fly(sizes: np.ndarray, chances: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Chances moved to 0 or 1, all but at most two, with their sum and their sum of sizes unchanged."""
    p, z = settle_large(sizes.astype(float), chances, rng).tolist(), sizes.tolist()
    todo = iter([i for i in range(len(p)) if 0.0 < p[i] < 1.0])
    live = list(itertools.islice(todo, 3))
    draws = iter(())
    while len(live) == 3:
        a, b, c = live
        u = (z[c] - z[b], z[a] - z[c], z[b] - z[a])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = down = float("inf")
        for i, d in zip(live, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, -p[i] / d), min(down, (p[i] - 1) / d)
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(1024).tolist())
            draw = next(draws)
        step = up if draw * (up + down) < down else -down
        for i, d in zip(live, u, strict=True):
            x = p[i] + step * d
            p[i] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        live = [i for i in live if 0.0 < p[i] < 1.0]
        live += list(itertools.islice(todo, 3 - len(live)))
    return np.array(p)


def land(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """The undecided few rounded so that their words come nearest to what is expected of them."""
    p = chances.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    ways = itertools.product((0.0, 1.0), repeat=len(open_))
    best = min(ways, key=lambda w: (abs(float(np.dot(np.array(w) - p[open_], sizes[open_]))), w))
    p[open_] = best
    return p


def _flown(seed: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "part"], ascending=[False, True, True])
        rng = np.random.default_rng([seed, *[zlib.crc32(str(k).encode()) for k in key]])
        p = fly(pdf["size"].to_numpy(), pdf["chance"].to_numpy(), rng)
        return pdf.assign(chance=land(pdf["size"].to_numpy(), p) if last else p)[["place", "doc_id", "part", "size", "chance"]]

    return run


def decide(units: DataFrame, seed: int) -> DataFrame:
    """place, doc_id, part, size, chance with every chance 0 or 1."""
    done: list[DataFrame] = []
    settled = F.col("chance").isin(0.0, 1.0)
    while True:
        many = units.where(~settled).groupBy("place").count().agg(F.max("count")).first()[0] or 0
        if not many:
            done.append(units)
            break
        done.append(units.where(settled))
        last = many <= BLOCK
        # as many blocks for each source as the largest one needs: smaller ones just fly in smaller blocks
        block = F.pmod(F.xxhash64(F.lit(seed + len(done)), "doc_id", "part", "size"), F.lit(-(-many // BLOCK))).cast("long")
        flying = units.where(~settled).select("place", "doc_id", "part", "size", "chance", block.alias("block"))
        units = cut_lineage(flying.groupBy("place", "block").applyInPandas(_flown(seed + len(done), last), _UNIT))
    return reduce(DataFrame.unionByName, done)


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """For each document: doc_id, source, size, part (numbers equal rows), source_size, target, copies, taken."""
    rows = cut_lineage(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(text_of(docs)).alias("size")))
    targets = cut_lineage(source_targets(rows))
    few = targets.count() <= MOST_BROADCAST
    equal = rows.groupBy("source", "doc_id", "size").count()
    units = equal.select("source", "doc_id", "size", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("part"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST))).otherwise(0.0)
    rates = targets.select(F.col("source").alias("own"), "place", rate.alias("rate"))
    placed = units.join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    chance = F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0)
    taken = decide(placed.select("place", "doc_id", "part", "size", chance.alias("chance")), seed)
    copies = (F.floor(F.when(F.col("size") > 0, F.col("rate")).otherwise(F.least("rate", F.lit(1.0)))) + F.col("chance")).cast("long")
    return (
        taken.join(F.broadcast(targets.withColumn("rate", rate)) if few else targets.withColumn("rate", rate), "place")
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "part", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their columns alone.

    Texts are shuffled once, to meet the number of their copies: rows that share
    doc_id, source and size take it by the order of their texts. A null or empty
    text is kept at most once; an empty table stays empty.
    """
    decided = mix(docs, seed).groupBy("doc_id", "source", "size").agg(F.min("copies").alias("least"), F.sum("copies").alias("copies"), F.count("*").alias("n"))
    decided = decided.select(F.struct("doc_id", "source", "size").alias("key"), "least", (F.col("copies") - F.col("n") * F.col("least")).alias("more"), F.col("n").alias("of"))
    own = F.struct(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(text_of(docs)).alias("size"))
    rows = docs.select(F.struct("*").alias("row"), own.alias("key")).join(decided.hint("merge"), "key")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row.text")))
    copies = F.col("least") + F.when(F.col("more") > 0, F.when(F.col("of") == 1, 1).otherwise((place <= F.col("more")).cast("long"))).otherwise(0)
    counted = rows.withColumn("copies", copies).where("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
