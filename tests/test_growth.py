"""What must not grow: work done twice for a row, rows for each token or pair, what a task holds."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazmill.operators import best as B
from hazmill.operators import chunks as C
from hazmill.operators import entities as N
from hazmill.operators import graph as G
from hazmill.operators import postings as P
from hazmill.operators import reports as A
from hazmill.operators import retrieval as R
from hazmill.operators import vector_index as V
from hazmill.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_label_is_worked_out_once_for_a_report(spark):
    """The hazard family is one greatest(...) over the patterns' flags; later columns name it and do not repeat it (they did 57 times)."""
    assert Path(SMALL).exists()
    assert _plan(QUERIES["stage_summaries"](spark, SMALL)).count("general], struct(n, ") <= 2


def _exchanges(df, key: str) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count(f"hashpartitioning({key}")


def test_actions_are_ordered_by_family_not_by_report(spark):
    """No report is shuffled for its list (two windows shuffled every action of every report)."""
    reports = spark.createDataFrame([(1, "lockout_tagout"), (2, "general"), (3, "unheard_of"), (4, None)], "analysis_id long, hazard_type string")
    got = A.corrective_actions(reports, A.action_table(spark))
    assert _exchanges(got, "analysis_id") == 0
    rows = got.collect()
    of = {k: sorted((r["place"], r["action"]) for r in rows if r["analysis_id"] == k) for k in (1, 2, 3, 4)}
    assert of[2] == of[3] == of[4] and {a for _, a in of[2]} < {a for _, a in of[1]}
    assert all([p for p, _ in v] == list(range(len(v))) for v in of.values())


def test_a_report_stays_one_row_until_its_entities_are_known(spark):
    """No row for a token and no shuffle (there were one for each token and two shuffles); the longest hit wins, then the earlier."""
    table = [("EQUIPMENT", [["press"]]), ("HAZARD", [["press"], ["brake"], ["jam"]]), ("CONDITION", [["jam"], ["cleared"]])]
    rows = [(1, "Press brake jam cleared, PRESS and press. Jam cleared"), (2, None), (3, "brake"), (4, "press-brake jam " + "x " * 9000 + "jam cleared")]
    got = N.dictionary_entities(spark.createDataFrame(rows, "analysis_id long, text string"), table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert [tuple(r)[:4] for r in got.orderBy("analysis_id", "place").collect()] == [(1, 0, "Press brake jam", "HAZARD"), (1, 1, "PRESS", "EQUIPMENT"), (1, 2, "Jam cleared", "CONDITION"), (4, 0, "press", "EQUIPMENT")]


def test_reports_of_one_hazard_do_not_meet_in_one_task(spark, monkeypatch):
    """Starts are never shuffled by their few values (they were); a long walk gives the same as a short one."""
    reports = spark.createDataFrame([(i, ["why"], ["press"]) for i in range(40)], "analysis_id long, causes array<string>, equipment array<string>")
    found = spark.createDataFrame([(i, 0, "fire", "HAZARD") for i in range(40)], "analysis_id long, place int, text string, entity_type string")
    edges = spark.createDataFrame([("hazard:fire", "condition:heat", "PRECEDED_BY", 0), ("hazard:fire", "condition:fuel", "PRECEDED_BY", 1), ("condition:heat", "cause:spark", "CAUSED_BY", 0)], "src string, dst string, relation string, edge_seq int")
    nodes = spark.createDataFrame([("hazard:fire", "fire", "hazard")], "node_id string, label string, node_type string")
    short = G.causal_chain(reports, found, nodes, edges)
    assert _exchanges(short, "start") == 0
    monkeypatch.setattr(G, "MOST_BROADCAST", 0)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(short) == key(G.causal_chain(reports, found, nodes, edges)) and short.count() == 160


def test_a_document_stays_one_row_until_it_is_cut(spark):
    """No row for a token and no shuffle; the fold as over adjacent_similarity (chunks shuffled each token three times)."""
    words = "press guard tank valve crane hoist fire dust".split()
    said = " ".join(f"{words[i * i % 8].title()} {' '.join(words[(i * j) % 8] for j in range(1, 3 + i % 15))}." for i in range(90))
    rows = [(1, f"{said}\n\nSAFETY RULES\n{said}\nEMPTY ONE\n2.1 Next\nOnly this"), (2, None), (3, " \n"), (4, "İK one. Two")]
    docs = spark.createDataFrame([(k, f"n{k}", t) for k, t in rows], "doc_id long, name string, text string")
    got = C.index_documents(docs, "incidents")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    made = got.orderBy("doc_id", "idx").collect()
    by = {k: [(r["section"], r["text"]) for r in made if r["doc_id"] == k] for k, _ in rows}
    assert [s for s, _ in by[1]] == sorted([s for s, _ in by[1]], key=["", "SAFETY RULES", "2.1 Next"].index) and by[1][-1] == ("2.1 Next", "Only this") and not by[2] + by[3] and len(by[4]) == 1
    sentences = [f"{s}." for s in said.rstrip(".").split(". ")]
    listed = spark.createDataFrame([(1, 0, i, s) for i, s in enumerate(sentences)], "doc_id long, section_no int, place int, sentence string")
    sims = [r["sim"] or 0.0 for r in C.adjacent_similarity(listed).orderBy("place").collect()]
    assert np.allclose(C.similarities(sentences), sims, atol=2e-9)
    first = [t for s, t in by[1] if s == ""]
    assert " ".join(first) == said and len(first) > 2


def test_queries_and_chunks_that_are_alike_are_searched_once(spark, monkeypatch):
    """Ninety queries of three texts ask three times (each asked); copies of a chunk beyond the k first are no candidates, and results stay."""
    said = ["press jam cleared", "tank entry attendant", "press guard removed"]
    chunks = spark.createDataFrame([(i, said[i % 3] + (" again" if i == 50 else ""), "a" if i % 2 else "b") for i in range(120)], "chunk_id long, text string, industry string")
    queries = spark.createDataFrame([(i, said[i % 3], None if i % 3 else "a") for i in range(90)] + [(90, None, None), (91, "jam", None), (91, "tank", None)], "query_id long, text string, industry string")
    asked = []
    plain = R._hybrid_search
    monkeypatch.setattr(R, "_hybrid_search", lambda q, *a: asked.append(q.count()) or plain(q, *a))
    got = R.hybrid_search(queries, chunks, 8, ("industry",), compressed=False)
    found = got.orderBy("rank0").collect()
    rows = {k: [(r["rank0"], r["chunk_id"]) for r in found if r["query_id"] == k] for k in range(92)}
    assert asked == [3 + 1 + 2]
    assert all(rows[i] == rows[i % 3] and len(rows[i]) == 8 for i in range(90)) and not rows[90] and rows[91]
    alone = plain(queries.where("query_id = 40"), chunks, 8, ("industry",), False, None, None, "crc32")
    assert rows[40] == [(r["rank0"], r["chunk_id"]) for r in alone.orderBy("rank0").collect()]


def _vectors(spark, n):
    x = np.random.default_rng(3).integers(-2, 3, (n, 6)).astype(float)  # many equal scores
    v = spark.createDataFrame([(i, y.tolist(), str(i % 3)) for i, y in enumerate(x)], "chunk_id long, embedding array<double>, label string").repartition(3)
    return x, v, v.where("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id")


def _hits(df):
    return sorted((r["query_id"], r["rank0"], r["chunk_id"]) for r in df.collect())


def test_exact_search_makes_no_row_for_a_pair_of_blocks(spark, monkeypatch):
    """Vectors are neither joined with queries nor packed by a second Python worker (pairs of blocks came in batches of 64 MB); queries in parts find the same."""
    monkeypatch.setattr(R, "DATA_BLOCK", 32)
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(B, "SPARE", 5)
    x, v, q = _vectors(spark, 300)
    got = R.dense_search(q, v, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapIn") == 1
    best = lambda i, of: sorted(of, key=lambda j: (-(x[i] @ x[j]), j))[:4]
    want = sorted((i, r, j) for i in range(0, 300, 5) for r, j in enumerate(best(i, range(300))))
    assert _hits(got) == want
    labelled = sorted((i, r, j) for i in range(0, 300, 5) for r, j in enumerate(best(i, range(i % 3, 300, 3))))
    assert _hits(R.dense_search(q, v, 4, "label")) == labelled
    monkeypatch.setattr(B, "MOST_HELD", 1000)
    assert _hits(R.dense_search(q, v, 4)) == want
    assert not R.dense_search(q.where("false"), v, 4).count() and not R.dense_search(q, v.where("false"), 4).count()


def test_a_query_is_not_repeated_for_its_cells(spark, tmp_path, monkeypatch):
    """A pass holds a bit for a query and cell (it held the query's vector for each of them)."""
    x, v, q = _vectors(spark, 600)
    index = V.build_vector_index(v, str(tmp_path / "cells"), "label", 24)
    hits, passes = V._passes(q, index, 4, None, None)
    assert [p.count() for p in passes] == [120, 120]
    assert all(len(r["cells"]) == 3 for p in passes for r in p.collect())
    want = _hits(R.dense_search(q, v, 4))
    assert _hits(V.search_vectors(q, index, 4, None)) == want
    monkeypatch.setattr(B, "MOST_HELD", 4000)
    assert _hits(V.search_vectors(q, index, 4, None)) == want
    assert _hits(V.search_vectors(q, index, 4, None, "label")) == _hits(R.dense_search(q, v, 4, "label"))


def test_bm25_blocks_are_written_as_they_are_made(spark, tmp_path, monkeypatch):
    """A block is counted when the one before has gone out (all of a batch were counted first)."""
    monkeypatch.setattr(P, "BLOCK", 4)
    held, plain, block = [], P._counted, P._block
    monkeypatch.setattr(P, "_counted", lambda texts: held.append(1) or plain(texts))
    monkeypatch.setattr(P, "_block", lambda *a: held.append(-1) or block(*a))
    made = []

    class Rows:
        schema = spark.range(1).withColumnRenamed("id", "chunk_id").schema
        write = property(lambda self: self)
        mode = lambda self, m: self
        parquet = lambda self, path: None
        select = lambda self, *c: self

        def mapInArrow(self, run, ddl):
            made.append(run)
            return self

    P._write_rows(Rows(), str(tmp_path), 0)
    monkeypatch.setattr(P, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())}))
    batch = pa.RecordBatch.from_pydict({"chunk_id": list(range(30)), "text": [f"press {i} jam" if i else None for i in range(30)]})
    rows = list(made[0](iter([batch])))
    assert max(np.cumsum(held)) == 1 and held.count(1) == 8
    assert sorted(i for r in rows for ids in r.column("ids").to_pylist() if ids for i in ids) == list(range(30))
    assert sum(n for r in rows for n in r.column("n_tokens").to_pylist()) == 87


def test_a_search_shuffles_only_the_postings_of_its_terms(spark, tmp_path, monkeypatch):
    """The terms asked for are broadcast to the postings (all postings were shuffled for them, and again to be merged); shuffled they give the same."""
    chunks = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} press jam {i}") for i in range(200)], "chunk_id long, text string")
    queries = spark.createDataFrame([(0, "press w3 w3"), (1, "jam 17 w5"), (2, "zqx"), (3, None)], "query_id long, text string")
    index = P.add_chunks(P.build_bm25(chunks.where("chunk_id < 90"), str(tmp_path / "a")), chunks.where("chunk_id >= 90"))
    asked = []
    plain = P._sent
    monkeypatch.setattr(P, "_sent", lambda df, n: asked.append(n) or plain(df, n))
    rows = lambda i: sorted((r["query_id"], r["rank0"], r["chunk_id"], round(r["score"], 9)) for r in P.bm25_search(queries, i, 5).collect())
    found = rows(index)
    assert len(found) == 10 and asked and max(asked) < 1000
    merged = P.merge_segments(index, str(tmp_path / "b"))
    assert rows(merged) == found and merged.n_tokens == index.n_tokens
    monkeypatch.setattr(P, "MOST_BROADCAST", 0)
    assert rows(index) == found == rows(P.merge_segments(index, str(tmp_path / "c")))


def test_a_report_keeps_its_row_through_an_analysis(spark, monkeypatch):
    """Nothing is asked, so no index is made; of two reports of one id neither takes the other's entities or actions."""
    monkeypatch.setattr(R, "build_bm25", lambda chunks: pytest.fail("an index for no query"))
    text = "The conveyor, unguarded, before the fire."
    given = spark.createDataFrame([(1, "a.pdf", text), (1, "b.pdf", text), (2, "c.pdf", None)], "analysis_id long, file_name string, text string")
    chunks = spark.createDataFrame([(1, text, "x.pdf")], "chunk_id long, text string, source_document string").withColumns({c: F.lit(None).cast("string") for c in ("title", "industry", "regulation_name", "section")})
    one, two, none = A.analyze(given, chunks, chunks, searched=F.lit(False)).orderBy("file_name").collect()
    assert one["entities"] == two["entities"] and [e["text"] for e in one["entities"]] == ["conveyor", "unguarded", "fire"] and [e["place"] for e in one["entities"]] == [0, 1, 2]
    assert one["corrective_actions"] == two["corrective_actions"] and [a["place"] for a in one["corrective_actions"]] == list(range(len(one["corrective_actions"])))
    assert [(s["label"], s["node_type"]) for s in one["causal_chain"]] == [("condition:unguarded", "unknown")]
    assert one["similar_incidents"] == one["regulatory_clauses"] == none["entities"] == none["causal_chain"] == []


def test_chains_in_rows_are_those_of_the_table(spark, monkeypatch):
    entities = "array<struct<place: int, text: string, entity_type: string>>"
    rows = [(i, ["No guard", " ", None, "no GUARD "], ["Press", None], [(0, "fire", "HAZARD"), (1, "leak", "CONDITION"), (2, "fall", "HAZARD")][: i % 4]) for i in range(8)]
    reports = spark.createDataFrame(rows, f"analysis_id long, causes array<string>, equipment array<string>, entities {entities}")
    nodes = spark.createDataFrame([("cause:a", "A", "cause"), ("cause:b", "no guard", "cause")], "node_id string, label string, node_type string")
    edges = spark.createDataFrame([("equipment:press", "cause:a", "CAUSED_BY", 0), ("cause:a", "cause:b", "PRECEDED_BY", 0), ("hazard:fire", "cause:a", "CAUSED_BY", 1), ("hazard:fall", "cause:c", "CAUSED_BY", 0)], "src string, dst string, relation string, edge_seq int")
    found = reports.select("analysis_id", F.inline("entities"))
    want = [tuple(r) for r in G.causal_chain(reports, found, nodes, edges).orderBy("analysis_id", "order").collect()]
    for most in (G.MOST_BROADCAST, 0):
        monkeypatch.setattr(G, "MOST_BROADCAST", most)
        got = G.with_causal_chain(reports, nodes, edges).select("analysis_id", F.inline("causal_chain")).orderBy("analysis_id", "order").collect()
        assert [tuple(r) for r in got] == want and len(want) >= 16
    own = G.build_graph(reports.select(F.col("analysis_id").alias("doc_id"), F.lit("t").alias("title"), F.lit("i").alias("industry"), F.lit("s").alias("severity")), found.withColumnRenamed("analysis_id", "doc_id"))[1]
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(G.precursor_edges(reports)) == key(own.where("src not like 'incident:%'")) != []
