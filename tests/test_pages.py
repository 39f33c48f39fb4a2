"""Pages cleaned one by one."""

from hazmill.operators import corpus


def test_pages_stay_rows_of_their_own(spark):
    rows = [("a", i, f"HEAD\nbody {i}\n  foot ") for i in range(40)] + [("b", 0, "HEAD\nalone"), ("b", 1, None)]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    got = {(r["doc_id"], r["page_no"]): r["text"] for r in corpus.clean_pages(pages).collect()}
    assert got == {**{("a", i): f"body {i}" for i in range(40)}, ("b", 0): "HEAD\nalone", ("b", 1): None}
    joined = {r["doc_id"]: r["text"] for r in corpus.remove_furniture(pages).collect()}
    assert joined == {"a": "\n\n".join(f"body {i}" for i in range(40)), "b": "HEAD\nalone"}


def test_page_budget_passes_on_few_pages(spark):
    pages = spark.createDataFrame([(f"d{i % 2}", i, "x" * 10) for i in range(200)], "doc_id string, page_no int, text string")
    out = corpus.apply_page_budget(pages, 7, 45)
    assert sorted((r["doc_id"], r["page_no"]) for r in out.collect()) == [(d, i) for d in ("d0", "d1") for i in range(int(d[1]), 10, 2)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
