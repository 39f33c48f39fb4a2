"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns, and no rows at all."""

import pytest

import corpus_pipeline
from hazmill.llm import context_tree, embeddings, licenses, mixing, near_dedup, packing, quality, secrets, sharding, suffix_dedup

LONG = " ".join(f"word{i % 977} thing{i % 89}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a", 0, 5, 7),
    (2, "", "en", None, 0, 5, 7),
    (3, "short", "en", "a", 5, 5, 7),
    (3, "short", "en", "a", 5, 5, 7),
    (4, LONG, None, "b", len(LONG), None, None),
    (5, LONG, "en", "b", len(LONG), 1, 1),
    (6, "   \n\t ", "en", "b", 5, 1, 1),
    (7, "naïve café 😀 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" Licensed under CC BY-NC 4.0.", "en", "c", 9, 1, 1),
    (None, "no id here " * 30, "en", "c", 9, 1, 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int"
OPERATORS = {
    "op1": secrets.secrets_digest,
    "op2": context_tree.score_documents,
    "op3": lambda d: quality.apply_policy(quality.quality_ledger(d)),
    "op4": packing.pack,
    "op5": near_dedup.near_duplicate_classes,
    "op6": licenses.license_matches,
    "op7": mixing.mix,
    "op9": sharding.shard_by_bytes,
    "op10": suffix_dedup.remove_repeats,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_its_result(spark, docs, name):
    out = OPERATORS[name](docs).toPandas()
    want = sorted(str(r[0]) for r in ROWS)
    ids = ["None" if x != x or x is None else str(int(x)) for x in out["doc_id"]]
    assert sorted(set(ids)) == sorted(set(want)) if name == "op4" else sorted(ids) == want


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_stages_on_edges(spark, docs):
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, "")
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == docs.columns


def test_quality_stage_keeps_plain_text(spark):
    text = " ".join(f"alpha{i} beta{i} gamma" for i in range(60))
    rows = [(1, text), (2, "SHOUT!! " * 80), (3, "too short"), (4, " ".join(f"w{i}###" for i in range(200))), (5, None)]
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_ablations(spark):
    rows = [(1, "few words"), (2, " ".join(f"alpha{i}" for i in range(80))), (3, "SHOUT!! " * 80)]
    ledger = quality.quality_ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["policy"], r["rule"]): (r["n_kept"], r["n_only_this_rule"], r["n_failing"]) for r in quality.ablations(ledger).collect()}
    assert got["2025-full", "too_few_words"] == (1, 1, 1)
    assert got["2025-full", "shouting"] == (1, 0, 1)


def test_redaction(spark):
    out = secrets.redact_secrets(spark.createDataFrame([(1, "a password: hunter2hunter2 b", 9), (2, None, 3)], "doc_id long, text string, n_chars int")).orderBy("doc_id").collect()
    assert out[0]["text"] == "a [secret] b" and out[0]["n_chars"] == 12 and out[1]["text"] is None


def test_trigram_queries():
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secrets.trigram_query(r"[0-9a-f]+") is True
    assert secrets.trigram_query(r"(?:abc|abd)+x*") == ("or", ("abc", "abd")) or secrets.trigram_query(r"(?:abc|abd)+x*") == ("or", ("abd", "abc"))


def test_licenses(spark):
    rows = [(1, "Text.\nReleased under the MIT License.\nMore."), (2, "This work is licensed under the GNU General Public License, version 2."), (3, "license plates are not licenses"), (4, "Licensed under CC BY-NC-SA 4.0.")]
    got = {r["doc_id"]: [m["license"] for m in r["matches"]] for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["GPL-2.0"], 3: [], 4: ["CC-BY-NC-SA-4.0"]}


def test_embeddings_on_edges(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, one, 5), (2, one, 5), (3, [2.0, 0.0, 0.0, 0.0], 1), (4, [0.0] * 4, 1), (5, None, 1), (6, [float("nan"), 1.0, 0.0, 0.0], 1), (7, [0.0, 1.0, 0.0, 0.0], 1), (8, [1.0, None, 0.0, 0.0], 1), (9, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), **{i: (0, i) for i in range(4, 10)}}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_texts_are_taken_from_arrow_a_run_at_a_time():
    """Runs come from the lengths alone, the same as from the texts (a whole batch became Python texts first)."""
    from hazmill.llm.common import chunks, runs

    texts = ["", "ab", "c" * 9, "", "de", "fgh", "i" * 30]
    assert list(runs([len(t) for t in texts], 6)) == list(chunks(texts, 6)) == [(0, 2), (2, 3), (3, 6), (6, 7)]
    assert not list(runs([]))


def test_counters_are_not_compared_in_one_task(spark, monkeypatch):
    """Pairs were put together before their counters were compared, in one task for up to 100,000 documents."""
    from hazmill.llm import near_dedup

    plans, cut = [], near_dedup.cut_lineage

    def watched(df, rows=None):
        plans.append((rows, df._jdf.queryExecution().analyzed().toString().split("\n")[0]))
        return cut(df, rows)

    monkeypatch.setattr(near_dedup, "cut_lineage", watched)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*words[:20], f"x{i}", *words[20:]])) for i in range(6)], "doc_id long, text string")
    assert {r["class_id"] for r in near_dedup.near_duplicate_classes(docs).collect()} == {0}
    compared = [rows for rows, top in plans if top.startswith("MapInPandas run")]
    assert compared and not any(compared)
