"""The causal graph of incidents: nodes (node_id, label, node_type, ...) and edges (src, dst, relation, edge_seq)."""

from __future__ import annotations

import itertools
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazmill.sources.shared import checkpointed

INVOLVED, CAUSED_BY, PRECEDED_BY = "INVOLVED", "CAUSED_BY", "PRECEDED_BY"
CAUSAL, MAX_DEPTH, HUB_DEGREE = (CAUSED_BY, PRECEDED_BY), 6, 8
#: Rows of a walk up to which it is broadcast, and copies of a longer one.
MOST_BROADCAST, COPIES = 100_000, 32
#: Entity types in the order they enter the graph, with the node type and relation they get.
ROLES = [("EQUIPMENT", "equipment", INVOLVED), ("HAZARD", "hazard", INVOLVED), ("UNSAFE_ACT", "cause", CAUSED_BY), ("CONDITION", "cause", CAUSED_BY)]


def node_key(node_type: str | Column, label: Column) -> Column:
    kind = F.lit(node_type) if isinstance(node_type, str) else node_type
    return F.concat(kind, F.lit(":"), F.lower(F.trim(label)))


def build_graph(docs: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of docs(doc_id, title, industry, severity) and entities(doc_id, place, text, entity_type).

    A node has the label seen last, an edge the relation seen last; blank labels are skipped.
    """
    role = reduce(lambda acc, r: acc.when(F.col("entity_type") == r[1][0], F.struct(F.lit(r[0]).alias("order"), F.lit(r[1][1]).alias("node_type"), F.lit(r[1][2]).alias("relation"))), enumerate(ROLES[1:], 1), F.when(F.col("entity_type") == ROLES[0][0], F.struct(F.lit(0).alias("order"), F.lit(ROLES[0][1]).alias("node_type"), F.lit(ROLES[0][2]).alias("relation"))))
    used = entities.withColumn("r", role).where("r is not null and trim(text) <> ''").select("doc_id", F.struct("doc_id", "r.order", "place").alias("seq"), F.trim("text").alias("label"), "r.node_type", "r.relation")
    used = used.withColumn("node_id", node_key(F.col("node_type"), F.col("label")))
    own = docs.select(node_key("incident", F.col("doc_id").cast("string")).alias("node_id"), F.col("title").alias("label"), F.lit("incident").alias("node_type"), "industry", "severity")
    none = F.lit(None).cast("string")
    others = used.groupBy("node_id").agg(F.max_by(F.struct("label", "node_type"), "seq").alias("x")).select("node_id", "x.label", "x.node_type", none.alias("industry"), none.alias("severity"))
    edges = used.select(node_key("incident", F.col("doc_id").cast("string")).alias("src"), F.col("node_id").alias("dst"), "relation", "seq")
    last = edges.groupBy("src", "dst").agg(F.max_by("relation", "seq").alias("relation"), F.min("seq").alias("seq"))
    linked = link_precursors(entities)
    both = last.select("src", "dst", "relation", F.struct("seq.doc_id", "seq.order", "seq.place").alias("seq")).unionByName(linked.select("src", "dst", "relation", F.struct("doc_id", F.lit(9).alias("order"), "place").alias("seq")))
    seq = F.row_number().over(Window.partitionBy("src").orderBy("seq", "dst")) - 1
    return own.unionByName(others), both.withColumn("edge_seq", seq).select("src", "dst", "relation", "edge_seq")


def link_precursors(entities: DataFrame) -> DataFrame:
    """hazard -> condition for every pair of one document: src, dst, relation, doc_id and place of the first."""
    side = lambda kind, name: entities.where((F.col("entity_type") == kind) & (F.trim("text") != "")).select("doc_id", F.col("place").alias(f"{name}_place"), F.col("text").alias(name))
    pair = side("HAZARD", "hazard").join(side("CONDITION", "condition"), "doc_id")
    # the conditions hang under their own kind of key, apart from the nodes of causes
    named = pair.select(node_key("hazard", F.col("hazard")).alias("src"), node_key("condition", F.col("condition")).alias("dst"), F.struct("doc_id", "condition_place").alias("at"))
    return named.groupBy("src", "dst").agg(F.min("at").alias("at")).select("src", "dst", F.lit(PRECEDED_BY).alias("relation"), F.col("at.doc_id").alias("doc_id"), F.col("at.condition_place").alias("place"))


def precursor_edges(reports: DataFrame) -> DataFrame:
    """Of build_graph's edges those that do not begin at an incident, from reports (analysis_id, entities: an array).

    No edge ends at an incident, so a walk from equipment or hazards meets these alone.
    """
    of = lambda kind: F.filter("entities", lambda e: (e["entity_type"] == kind) & (F.trim(e["text"]) != ""))
    pair = lambda h, c: F.struct(node_key("hazard", h["text"]).alias("src"), node_key("condition", c["text"]).alias("dst"), c["place"].alias("place"))
    pairs = F.flatten(F.transform(of("HAZARD"), lambda h: F.transform(of("CONDITION"), lambda c: pair(h, c))))
    # by place first: the least id alone is summed by hashing, a struct would be sorted
    by_place = reports.select("analysis_id", F.inline(pairs)).groupBy("src", "dst", "place").agg(F.min("analysis_id").alias("doc_id"))
    first = by_place.groupBy("src", "dst").agg(F.min(F.struct("doc_id", "place")).alias("at"))
    seq = F.row_number().over(Window.partitionBy("src").orderBy("at", "dst")) - 1
    return first.select("src", "dst", F.lit(PRECEDED_BY).alias("relation"), seq.alias("edge_seq"))


def precursor_chain(edges: DataFrame, starts: DataFrame, nodes: DataFrame | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """start, node_id, depth, place, relation (and label, node_type): a breadth-first walk along causal edges.

    Every level is one join against all edges for all starts together; a node is
    reached once for each start, from the parent met first.
    """
    # read at every level: without a cut each level would derive the edges from the texts again
    causal = checkpointed(edges.where(F.col("relation").isin(*CAUSAL)).select("src", F.col("dst").alias("node_id"), "relation", "edge_seq"))
    level = starts.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"), F.lit("").alias("relation")).distinct()
    level = checkpointed(level)
    seen = level
    for depth in range(1, max_depth + 1):
        step = level.select("start", F.col("node_id").alias("src"), F.col("place").alias("from_place")).join(causal, "src")
        new = step.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti")
        first = new.groupBy("start", "node_id").agg(F.min(F.struct("from_place", "edge_seq", "relation")).alias("via"))
        place = F.row_number().over(Window.partitionBy("start").orderBy("via", "node_id")).cast("long") - 1
        level = first.select("start", "node_id", F.lit(depth).alias("depth"), place.alias("place"), F.col("via.relation").alias("relation"))
        level = checkpointed(level)
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    steps = seen.where("depth > 0")
    if nodes is None:
        return steps
    named = nodes.select("node_id", "label", "node_type")
    return steps.join(named, "node_id", "left").withColumns({"label": F.coalesce("label", "node_id"), "node_type": F.coalesce("node_type", F.lit("unknown"))})


def causal_chain(reports: DataFrame, entities: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """analysis_id, order, label, node_type, relation: the report's causes, then what the graph says of its equipment and hazards.

    reports has analysis_id, causes and equipment (arrays); entities has analysis_id, place, text, entity_type.
    """
    tools = reports.select("analysis_id", F.posexplode("equipment").alias("i", "text")).select("analysis_id", F.lit(1).alias("part"), F.col("i").cast("long").alias("i"), node_key("equipment", F.col("text")).alias("start"))
    hazards = entities.where("entity_type = 'HAZARD'").select("analysis_id", F.lit(2).alias("part"), F.col("place").cast("long").alias("i"), node_key("hazard", F.col("text")).alias("start"))
    starts = checkpointed(tools.unionByName(hazards))
    walk = checkpointed(precursor_chain(edges, starts.select(F.col("start").alias("node_id")).distinct(), nodes))
    return _chained(reports, starts, walk)


def with_causal_chain(reports: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """reports (analysis_id, causes, equipment and entities: arrays) with causal_chain, the rows of causal_chain as an array in order.

    A short walk goes to all tasks and a report keeps its row; a long one meets the reports' starts in a shuffle.
    """
    hazards = F.filter("entities", lambda e: e["entity_type"] == "HAZARD")
    reports = reports.withColumn("starts", F.concat(F.transform("equipment", lambda t: node_key("equipment", t)), F.transform(hazards, lambda e: node_key("hazard", e["text"]))))
    begun = reports.select("analysis_id", F.posexplode("starts").alias("i", "start"))
    walk = checkpointed(precursor_chain(edges, begun.select(F.col("start").alias("node_id")).distinct(), nodes))
    if walk.count() > MOST_BROADCAST:
        chain = _chained(reports, checkpointed(begun.select("analysis_id", F.lit(1).alias("part"), F.col("i").cast("long").alias("i"), "start")), walk)
        listed = chain.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("order", "label", "node_type", "relation"))).alias("causal_chain"))
        empty = F.array().cast(listed.schema["causal_chain"].dataType)
        return reports.drop("starts").join(listed, "analysis_id", "left").withColumn("causal_chain", F.coalesce("causal_chain", empty))
    key = lambda label: F.lower(F.trim(label))
    steps: dict[str, list[tuple]] = {}
    for r in walk.select("start", key(F.col("label")).alias("key"), "label", "node_type", "relation", "depth", "place").orderBy("start", "depth", "place").toLocalIterator():
        steps.setdefault(r["start"], []).append((r["key"], r["label"], r["node_type"], r["relation"]))
    held = reports.sparkSession.sparkContext.broadcast(steps)

    def chained(labels: tuple, keys: tuple, starts: tuple) -> list[dict]:
        own = [(k, label, "cause", CAUSED_BY) for k, label in zip(keys, labels, strict=True)]
        once: dict[str, tuple] = {}
        for step in itertools.chain(own, *[held.value.get(s, ()) for s in starts]):
            once.setdefault(step[0], step)
        return [{"order": i, "label": label, "node_type": kind, "relation": relation} for i, (_, label, kind, relation) in enumerate(once.values())]

    def run(labels: pd.Series, keys: pd.Series, starts: pd.Series) -> pd.Series:
        known: dict[tuple, list[dict]] = {}
        rows = [tuple(map(tuple, r)) for r in zip(labels, keys, starts, strict=True)]
        for r in set(rows):
            known[r] = chained(*r)
        return pd.Series([known[r] for r in rows], index=starts.index, dtype=object)

    causes = F.filter("causes", lambda c: F.trim(c) != "")
    found = F.pandas_udf(run, "array<struct<order: int, label: string, node_type: string, relation: string>>")(causes, F.transform(causes, key), F.col("starts"))
    return reports.withColumn("causal_chain", found).drop("starts")


def _chained(reports: DataFrame, starts: DataFrame, walk: DataFrame) -> DataFrame:
    causes = reports.select("analysis_id", F.posexplode("causes").alias("i", "label")).where("trim(label) <> ''")
    own = causes.select("analysis_id", F.lit(0).alias("part"), F.col("i").cast("long").alias("i"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"), "label", F.lit("cause").alias("node_type"), F.lit(CAUSED_BY).alias("relation"))
    # very many reports share a start, so none of them is sent to its start's task: a short walk goes to all, a long one in copies
    if walk.count() <= MOST_BROADCAST:
        met = starts.join(F.broadcast(walk), "start")
    else:
        met = starts.withColumn("copy", F.pmod(F.xxhash64("analysis_id"), F.lit(COPIES))).join(walk.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long")))), ["start", "copy"])
    walked = met.select("analysis_id", "part", "i", "depth", "place", "label", "node_type", "relation")
    every = own.unionByName(walked).repartition("analysis_id")  # serves both windows
    key = F.lower(F.trim("label"))
    first = Window.partitionBy("analysis_id", key).orderBy("part", "i", "depth", "place")
    once = every.withColumn("n", F.row_number().over(first)).where("n = 1")
    order = F.row_number().over(Window.partitionBy("analysis_id").orderBy("part", "i", "depth", "place")) - 1
    return once.select("analysis_id", order.alias("order"), "label", "node_type", "relation")


def degree_stats(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node_id, in_degree, out_degree, is_hub; with nodes also those without edges."""
    ends = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("node_id", F.lit(0).alias("o"), F.lit(0).alias("i")))
    by = ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return by.withColumn("is_hub", F.col("in_degree") + F.col("out_degree") >= HUB_DEGREE)


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n_nodes")).join(edges.agg(F.count("*").alias("n_edges")))


def layer_violations(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges that point to a higher rank: src, dst, src_rank, dst_rank; ranks is (node_id, rank)."""
    of = lambda side: ranks.select(F.col("node_id").alias(side), F.col("rank").alias(f"{side}_rank"))
    return edges.join(of("src"), "src").join(of("dst"), "dst").where("dst_rank > src_rank").select("src", "dst", "src_rank", "dst_rank")


def weighted_edges(refs: DataFrame, gate: DataFrame | None = None, min_confidence: float = 0.7) -> DataFrame:
    """References (src, dst, kind, confidence) as edges with weight and sorted kinds, only where the gate has the pair."""
    sure = refs.where((F.col("confidence") >= min_confidence) & (F.col("src") != F.col("dst")))
    if gate is not None:
        sure = sure.join(gate.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    return sure.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.array_sort(F.collect_set("kind")).alias("kinds"))
