"""Whole analyses: what a report holds, what an unfinished one keeps, and the way from a report to the history."""

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hazmill.functions import labels as L
from hazmill.operators import history as H
from hazmill.operators import reports as A
from hazmill.operators import retrieval as R
from hazmill.plans.queries import QUERIES
from hazmill.sources import keyed, store
from hazmill.streaming import updates as U

REPORT = (
    "The incident occurred on 3 May 2024 at the stamping plant. A press operator reached into the hydraulic press to clear a jam while the disconnect was closed. "
    "The crew did not verify isolation and the machine was started without locking out the energy source. The operator died at the scene. "
    "The investigation found that the root cause was that no written procedure existed for the press and the employee was not trained. "
    "Stored energy in the hydraulic accumulator was not released, and the guard removed the week before had not been refitted by the second shift."
)
HISTORY = [
    (1, "Press fatality", "manufacturing", "An employee cleared a jam on a power press without locking out and did not verify zero energy. He was crushed and died.", "press_2019.pdf"),
    (2, "Conveyor amputation", "manufacturing", "A worker reached into a running conveyor; energy not isolated and the guard removed. Amputation of a finger.", "conveyor_2018.pdf"),
    (3, "Tank entry", "chemical", "An entrant went into a tank whose atmosphere was not tested; no attendant was posted.", "tank_2020.pdf"),
    (4, "Restart", "manufacturing", "Another worker restarted the machine during maintenance of the press; no lockout was applied.", "restart_2021.pdf"),
]
RULES = [
    (10, "OSHA 29 CFR 1910.147", "1910.147(c)(4)", "Procedures shall be developed for the control of hazardous energy during maintenance of a machine or press. They shall be used.", "loto.pdf"),
    (11, "OSHA 29 CFR 1910.212", "1910.212(a)(1)", "Guarding of a press shall protect the operator from the point of operation and moving machine parts.", "guards.pdf"),
    (12, "OSHA 29 CFR 1910.146", "1910.146(d)", "The atmosphere of a confined space shall be tested before entry.", "spaces.pdf"),
]


@pytest.fixture(scope="module")
def corpora(spark):
    history = spark.createDataFrame(HISTORY, "chunk_id long, title string, industry string, text string, source_document string")
    rules = spark.createDataFrame(RULES, "chunk_id long, regulation_name string, section string, text string, source_document string")
    return history, rules


@pytest.fixture(scope="module")
def parsed(spark):
    fields = "analysis_id long, incident_date string, location string, industry string, equipment_involved array<string>, sequence_of_events string, immediate_causes array<string>, root_causes array<string>, injury_count int, fatality_count int"
    return spark.createDataFrame([(1, "2024-05-03", "Stamping plant", "manufacturing", ["hydraulic press"], "A press operator reached into the press to clear a jam.", ["did not verify isolation"], ["no written procedure"], 0, 1)], fields)


@pytest.fixture(scope="module")
def reports(spark, corpora, parsed):
    rows = [(1, "press.pdf", REPORT, None), (2, "short.pdf", "A note of no kind.", None), (3, "broken.pdf", REPORT, "pattern_detector: TimeoutError")]
    given = spark.createDataFrame(rows, "analysis_id long, file_name string, text string, error string").withColumn("created_at", F.lit(datetime(2024, 6, 1)))
    return {r["analysis_id"]: r for r in A.analyze(given, *corpora, parsed=parsed, corpus_size=80).collect()}


def test_a_whole_report(reports):
    r = reports[1]
    assert (r["industry"], r["fatality_count"], r["severity_indicator"], r["document_type"]) == ("manufacturing", 1, "CRITICAL", "incident")
    assert "hydraulic press" in r["equipment_involved"] and r["hazard_type"] == "lockout_tagout" and r["extraction_confidence"] == 0.5
    assert "press" in {e["text"].lower() for e in r["entities"]}
    assert {s["title"] for s in r["similar_incidents"]} <= {h[1] for h in HISTORY} and r["similar_incidents"][0]["doc_id"] in {1, 4}
    assert [s["similarity_score"] for s in r["similar_incidents"]] == [round(0.9 - 0.12 * i, 2) for i in range(len(r["similar_incidents"]))]
    assert "Verification step omitted" in {p["pattern_name"] for p in r["precursor_patterns"]}
    known = {i: text for i, _, _, text, _ in RULES}
    sentences = lambda t: re.split(r"(?<=[.!?])\s+", t)
    assert r["regulatory_clauses"] and all(s in known[c["clause_id"]] for c in r["regulatory_clauses"] for s in sentences(c["clause_text"]))
    assert r["regulatory_clauses"][0]["clause_id"] in {10, 11}
    total = sum(c["score"] * c["weight"] for c in r["risk"]["components"])
    assert abs(total - r["risk"]["total"]) <= 0.01 and r["risk"]["components"][0]["score"] == 9.5
    assert r["route"] == ("priority" if r["risk"]["total"] >= 8 else "standard")
    urgencies = [a["urgency"] for a in r["corrective_actions"]]
    assert urgencies == sorted(urgencies, key=["IMMEDIATE", "SHORT_TERM", "LONG_TERM"].index) and "energy control procedure" in r["corrective_actions"][0]["action"]


def test_every_report_is_searched(spark):
    """No report is left without its searches (all but every fiftieth were)."""
    rows = QUERIES["analyze"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 150 and all(r["n_similar_incidents"] == 8 for r in rows)
    assert sum(r["n_regulatory_clauses"] == 6 for r in rows) > 140


def test_reports_that_ask_alike_are_searched_once(spark, corpora, monkeypatch):
    """Each report has what its own query finds, whatever its id: of two reports of one id, or of one without, none is mixed or left out; few queries or many, it is the same."""
    tank, press = HISTORY[2][3], HISTORY[0][3]
    rows = [(1, "a", press, None), (1, "b", tank, None), (None, "c", tank, None), (3, "d", press, None), (4, "e", press, "stopped"), (5, "f", None, None)]
    given = spark.createDataFrame(rows, "analysis_id long, file_name string, text string, error string")
    asked, plain = [], R._hybrid_search
    monkeypatch.setattr(R, "_hybrid_search", lambda q, *a: asked.append(q.count()) or plain(q, *a))
    fields = ("n_similar", "similar_incidents", "regulatory_clauses", "families", "precursor_patterns", "risk")
    found = lambda **more: {r["file_name"]: [r[c] for c in fields] for r in A.analyze(given, *corpora, **more).collect()}
    got = found()
    assert asked[0] == 3 and max(asked) == 3
    assert got["a"] == got["d"] and got["b"] == got["c"] and got["e"][1] == got["f"][1] == []
    assert got["b"][1][0]["doc_id"] == 3 and got["a"][1][0]["doc_id"] == 1 and got["a"][2]
    monkeypatch.setattr(A, "MOST_BROADCAST", 0)
    some = found(searched=F.col("file_name") != "d")
    assert {k: v for k, v in some.items() if k != "d"} == {k: v for k, v in got.items() if k != "d"}
    assert some["d"][:4] == [0, [], [], []]


def test_alerts_have_ids_and_times(reports):
    for r in reports.values():
        (alert,) = r["alerts"]
        assert re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", alert["id"]) and alert["created_at"] == datetime(2024, 6, 1)
    assert len({r["alerts"][0]["id"] for r in reports.values()}) == 3


def test_an_unfinished_report_keeps_what_there_is(reports):
    r = reports[3]
    assert r["route"] == "error" and r["alerts"][0]["title"] == "Analysis incomplete"
    assert r["alerts"][0]["description"].endswith("stopped before finishing: pattern_detector: TimeoutError") and not r["alerts"][0]["precursor_patterns"]
    assert r["warnings"][-1] == "Partial result. pattern_detector: TimeoutError"
    assert (r["risk"]["total"], r["risk"]["tier"]) == (0.0, "UNKNOWN") and all(c["explanation"] == "Not computed - analysis failed." for c in r["risk"]["components"])
    assert r["severity_indicator"] == "CRITICAL" and r["entities"] == r["corrective_actions"] == []


def test_an_unparsed_report(reports):
    r = reports[2]
    assert (r["extraction_confidence"], r["severity_indicator"], r["sequence_of_events"]) == (0.2, "UNKNOWN", "A note of no kind.")
    assert r["warnings"][0] == "Document is only 5 words. Findings are low confidence."


def test_structured_incident_without_a_parser(spark):
    r = A.structured_incident(spark.createDataFrame([(1, "x" * 1500)], "analysis_id long, text string")).first()
    assert (len(r["sequence_of_events"]), r["injury_count"], r["fatality_count"], r["raw_text_length"], r["root_causes"]) == (1000, 0, 0, 1500, [])


def test_generated_actions_for_a_family_without_templates(spark):
    reports = spark.createDataFrame([(1, "unheard_of"), (2, "lockout_tagout")], "analysis_id long, hazard_type string")
    made = [(k, i, "SHORT_TERM", f"Do {i}.", "why", None) for k in (1, 2) for i in range(6)]
    generated = spark.createDataFrame(made, "analysis_id long, seq int, urgency string, action string, rationale string, regulation_reference string")
    got = A.corrective_actions(reports, A.action_table(spark), generated).collect()
    assert sorted(r["action"] for r in got if r["analysis_id"] == 1 and r["action"].startswith("Do ")) == [f"Do {i}." for i in range(4)]
    assert not [r for r in got if r["analysis_id"] == 2 and r["action"].startswith("Do ")]


def test_a_report_is_stored_once_and_comes_back_in_the_history(spark, corpora, tmp_path):
    path, given = str(tmp_path / "stored"), tmp_path / "in"
    schema = "analysis_id long, file_name string, text string"
    spark.createDataFrame([(1, "press.pdf", REPORT)], schema).coalesce(1).write.parquet(str(given))
    for again in range(2):  # the second start finds all done
        stream = spark.readStream.schema(schema).parquet(str(given))
        assert U.streaming_analyze(stream, *corpora, path, str(tmp_path / "checkpoint")).awaitTermination(300) or again
    reports = store.read_stored(spark, path, "analysis_id")
    assert [r["analysis_id"] for r in reports.collect()] == [1]
    rows = store.analysis_rows(reports)
    store.upsert(rows, str(tmp_path / "analyses"), "id")
    analyses = store.read_stored(spark, str(tmp_path / "analyses"), "id")
    (page,) = H.list_analyses(analyses).collect()
    assert (page["id"], page["total"], page["file_name"]) == (1, 1, "press.pdf") and page["created_at"] is not None
    assert json.loads(store.get_report(analyses, 1).first()["report"])["analysis_id"] == 1 and store.get_report(analyses, 2).isEmpty()
    keyed.put(rows, str(tmp_path / "by_key"), "id")
    assert json.loads(store.find_report(spark, str(tmp_path / "by_key"), 1).first()["report"])["analysis_id"] == 1 and store.find_report(spark, str(tmp_path / "by_key"), 2) is None
    (alert,) = H.alert_register(reports.withColumnRenamed("analysis_id", "id").select("id", "created_at", "alerts")).collect()
    assert alert["id"] == 1 and alert["alert_id"] and alert["title"].endswith("/10")


@pytest.mark.parametrize("industry, n", [("chemical", 8), ("manufacturing", 6), ("mining", 6), ("", 6), (None, 6)])
def test_an_industry_narrows_but_never_starves(spark, industry, n):
    """Eight chunks of one industry are used alone; one of another is too few, so all are searched."""
    rows = [(i, "did not verify isolation of energy", "chemical") for i in range(8)] if industry == "chemical" else [(i, "did not verify isolation of energy", "manufacturing" if i == 5 else "other") for i in range(6)]
    rows += [(100, "nothing of the kind", "chemical")] if industry == "chemical" else []
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, industry string")
    asked = spark.createDataFrame([(1, "verify isolation" if industry else "verify", industry)], "query_id long, text string, industry string")
    hits = R.hybrid_search_incidents(asked, chunks, 8, compressed=False).collect()
    assert len(hits) == n and sorted(r["rank0"] for r in hits) == list(range(n))


def test_clauses_of_a_query(spark, corpora):
    asked = spark.createDataFrame([(1, "lockout of hazardous energy for maintenance of a press", "lockout_tagout", "manufacturing")], "query_id long, text string, hazard_type string, industry string")
    clauses = R.retrieve_clauses(asked, corpora[1]).orderBy("rank0").collect()
    assert clauses[0]["clause_id"] == 10 and clauses[0]["family"] == "lockout_tagout" and clauses[0]["violation_confidence"] == 0.9
    assert clauses[0]["relevance_explanation"] == "Retrieved from loto.pdf as a lockout tagout requirement matching the reported hazard."
    assert R.fetch_payloads(spark.createDataFrame([(10,), (10,), (99,)], "chunk_id long"), corpora[1]).count() == 1


def test_hazard_text(spark):
    some = F.array(F.lit("b"), F.lit("c"))
    assert spark.range(1).select(L.hazard_text(F.lit("t"), F.lit(None).cast("string"), some, None or F.lit(None).cast("array<string>")).alias("x")).first()[0] == "t  b c"
