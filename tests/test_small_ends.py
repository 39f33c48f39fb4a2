"""Labels and vectors on chunks, graphs from files, a recogniser's entities, prevalence by level."""

import json

from hazmill.functions import taxonomy as X
from hazmill.operators import chunks as C
from hazmill.operators import entities as N
from hazmill.operators import precursors as P
from hazmill.sources import store


def test_every_chunk_carries_its_documents_labels(spark):
    docs = spark.createDataFrame([("d1", "a.txt", "One thing happened. Another thing followed. " * 60, "chemical", "HIGH"), ("d2", "b.txt", "Short.", None, "LOW")], "doc_id string, name string, text string, industry string, severity string")
    rows = C.index_documents(docs, "incidents").collect()
    assert {(r["name"], r["industry"], r["severity"], r["collection"]) for r in rows} == {("a.txt", "chemical", "HIGH", "incidents"), ("b.txt", None, "LOW", "incidents")}
    assert len(rows) == len({r["chunk_id"] for r in rows}) > 2


def test_vectors_are_attached_by_chunk(spark):
    chunks = spark.createDataFrame([("c1", "x"), ("c2", "y"), (None, "z")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("c1", [1.0, 2.0], "own"), ("c9", [3.0], "own")], "chunk_id string, embedding array<double>, text string")
    got = {r["text"]: r["embedding"] for r in C.attach_vectors(chunks, vectors).collect()}
    assert got == {"x": [1.0, 2.0], "y": None, "z": None}


def test_node_link_files(spark, tmp_path):
    graph = {"directed": True, "nodes": [{"id": "n1", "label": "Jam", "node_type": "HAZARD"}, {"id": "n2", "label": "Press", "node_type": "EQUIPMENT", "industry": "steel"}], "links": [{"source": "n1", "target": "n2", "relation": "INVOLVED"}, {"source": "n2", "target": "n1", "relation": "CAUSED_BY"}]}
    (tmp_path / "graph.json").write_text(json.dumps(graph, indent=1))
    nodes, edges = store.read_node_link_graph(spark, str(tmp_path / "graph.json"))
    assert [tuple(r) for r in nodes.orderBy("node_id").collect()] == [("n1", "Jam", "HAZARD", None, None), ("n2", "Press", "EQUIPMENT", "steel", None)]
    assert [tuple(r) for r in edges.orderBy("edge_seq").select("src", "dst", "relation", "edge_seq").collect()] == [("n1", "n2", "INVOLVED", 0), ("n2", "n1", "CAUSED_BY", 1)]


def test_entities_of_a_recogniser(spark):
    label, kind = next(iter(N.LABEL_MAP.items()))
    own = N.OWN_LABELS[0] if isinstance(N.OWN_LABELS, list | tuple) else sorted(N.OWN_LABELS)[0]
    rows = spark.createDataFrame([(1, 0, "Acme", label), (1, 1, "press", own), (1, 2, "blue", "COLOUR"), (1, 3, "none", None)], "analysis_id int, place int, text string, label string")
    got = [(r["text"], r["entity_type"], r["confidence"], r["source"]) for r in N.statistical_entities(rows).orderBy("place").collect()]
    assert got == [("Acme", kind, N.STATISTICAL_CONFIDENCE, "statistical"), ("press", own, N.RULE_CONFIDENCE, "statistical")]


def test_prevalence_by_level_and_lift(spark):
    keyword = X.PRECURSORS[0][3][0]
    schema = "industry string, hazard_type string, text string"
    reports = spark.createDataFrame([("a", "h", keyword), ("a", "h", "nothing"), (None, "h", keyword), ("b", "g", None)], schema)
    corpus = spark.createDataFrame([("a", "h", keyword)] + [("a", "h", "nothing")] * 3 + [("c", "g", keyword)], schema)
    got = {(r["by_industry"], r["by_hazard"], r["industry"], r["hazard_type"]): (r["n_reports"], r["of_reports"], r["n_corpus"], r["of_corpus"], r["lift"]) for r in P.prevalence_levels(reports, corpus).where("pattern_order = 0").collect()}
    assert got == {
        (0, 0, None, None): (2, 4, 2, 5, 0.5 / 0.4),
        (1, 0, "a", None): (1, 2, 1, 4, 2.0),
        (1, 0, None, None): (1, 1, 0, 0, None),
        (1, 0, "c", None): (0, 0, 1, 1, None),
        (0, 1, None, "h"): (2, 3, 1, 4, (2 / 3) / 0.25),
        (0, 1, None, "g"): (0, 0, 1, 1, None),
        (1, 1, "a", "h"): (1, 2, 1, 4, 2.0),
        (1, 1, None, "h"): (1, 1, 0, 0, None),
        (1, 1, "c", "g"): (0, 0, 1, 1, None),
    }
