"""Golden cases of text preparation, chunks, entities, graph and search."""

from pyspark.sql import functions as F

from hazmill.functions import text as T
from hazmill.operators import chunks as C
from hazmill.operators import corpus
from hazmill.operators import entities as N
from hazmill.operators import graph as G
from hazmill.operators import retrieval as R


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tokens_and_sentences(spark):
    assert value(spark, T.tokenize(F.lit("LOTO: 29 CFR 1910.147(c)(4)!"))) == "loto 29 cfr 1910 147 c 4".split()
    assert len(value(spark, T.split_sentences(F.lit("One went. Two came! Three stayed?")))) == 3
    assert len(value(spark, T.split_sentences(F.lit("See 29 CFR 1910.147 for this.")))) == 1


def test_normalize(spark):
    assert value(spark, T.normalize_text(F.lit("lock-\nout"))) == "lockout"
    assert value(spark, T.normalize_text(F.lit("a soft\nwrap.\n\n\n\nNext  one\n- item"))) == "a soft wrap.\n\nNext one\n- item"


def test_furniture(spark):
    four = spark.createDataFrame([("d", i, f"ACME REPORT\nBody {i}.\nfooter") for i in range(4)], "doc_id string, page_no int, text string")
    assert {r["line"] for r in corpus.repeated_lines(four).collect()} == {"ACME REPORT", "footer"}
    assert corpus.remove_furniture(four).first()["text"] == "Body 0.\n\nBody 1.\n\nBody 2.\n\nBody 3."
    assert corpus.repeated_lines(four.where("page_no < 2")).count() == 0


def test_sections(spark):
    df = spark.createDataFrame([(1, "preamble\nSAFETY RULES\nbe safe\n1.2 Next Part\nmore\nEMPTY ONE\n"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r["heading"], r["body"]) for r in corpus.split_sections(df).orderBy("section_no").collect()]
    assert got == [("", "preamble"), ("SAFETY RULES", "be safe"), ("1.2 Next Part", "more")]


def greedy(sentences, sims, threshold=0.5, least=40, most=220):
    out, current = [], [sentences[0]]
    for s, sim in zip(sentences[1:], sims, strict=True):
        words = sum(len(x.split()) for x in current)
        if (sim < threshold and words >= least) or words >= most:
            out.append(" ".join(current))
            current = []
        current.append(s)
    return [*out, " ".join(current)]


def test_chunks_are_the_greedy_fold(spark):
    topic = lambda w, n: " ".join(f"{w.capitalize()} {w} number {i} {w} {w} {w} machine." for i in range(n))
    text = topic("press", 12) + " " + topic("tank", 9) + " " + topic("roof", 40)
    df = spark.createDataFrame([(1, text), (2, "Only one sentence"), (3, "")], "doc_id long, text string")
    got = [r["text"] for r in C.semantic_chunks(df).where("doc_id = 1").orderBy("idx").collect()]
    rows = df.where("doc_id = 1").select("doc_id", F.lit(0).alias("section_no"), F.posexplode(T.split_sentences(F.col("text"))).alias("place", "sentence"))
    sims = C.adjacent_similarity(rows).orderBy("place").collect()
    assert got == greedy([r["sentence"] for r in sims], [r["sim"] for r in sims[1:]]) and len(got) > 2
    assert [r["text"] for r in C.semantic_chunks(df).where("doc_id > 1").collect()] == ["Only one sentence"]


def test_entities(spark):
    df = spark.createDataFrame([(1, "The power press jammed near ammonia; he did not verify and the PRESS moved."), (2, None)], "analysis_id long, text string")
    got = [(r["text"], r["entity_type"]) for r in N.dictionary_entities(df).orderBy("place").collect()]
    assert got == [("power press", "EQUIPMENT"), ("ammonia", "CHEMICAL"), ("did not verify", "UNSAFE_ACT"), ("PRESS", "EQUIPMENT")]


def test_merge_discovered(spark):
    reports = spark.createDataFrame([(1, "The press hit a bystander.")], "analysis_id long, text string")
    proposals = spark.createDataFrame([(1, 0, "bystander", "HAZARD"), (1, 1, "laser", "EQUIPMENT"), (1, 2, "Press", "EQUIPMENT"), (1, 3, " ", "HAZARD")], "analysis_id long, place int, text string, entity_type string")
    rows = N.merge_discovered(N.dictionary_entities(reports), proposals, reports).orderBy("place").collect()
    assert [(r["text"], r["confidence"]) for r in rows] == [("press", 0.9), ("bystander", 0.75)]


def test_precursor_chain_bounds_depth_and_cycles(spark):
    edges = [(f"n{i}", f"n{i + 1}", "CAUSED_BY", 0) for i in range(9)] + [("n2", "n0", "PRECEDED_BY", 1), ("n0", "x", "INVOLVED", 1)]
    df = spark.createDataFrame(edges, "src string, dst string, relation string, edge_seq int")
    starts = spark.createDataFrame([("n0",), ("unknown",)], "node_id string")
    got = G.precursor_chain(df, starts).orderBy("depth").collect()
    assert [r["node_id"] for r in got] == [f"n{i}" for i in range(1, 7)]


def test_bm25_candidates_share_a_term(spark):
    chunks = spark.createDataFrame([("c1", "hydraulic press lockout"), ("c2", "ladder fall"), ("c3", "chemical spill"), ("c4", None)], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "hydraulic press lockout"), (2, "xyzzy"), (3, "")], "query_id int, text string")
    hits = R.bm25_search(queries, R.build_bm25(chunks)).collect()
    assert [(r["query_id"], r["chunk_id"]) for r in hits] == [(1, "c1")]


def test_fusion_and_rerank(spark):
    one = spark.createDataFrame([(1, c, i) for i, c in enumerate("abc")], "query_id int, chunk_id string, rank0 int")
    two = spark.createDataFrame([(1, c, i) for i, c in enumerate("cad")], "query_id int, chunk_id string, rank0 int")
    fused = R.reciprocal_rank_fusion(one, two).orderBy("rank0")
    assert [r["chunk_id"] for r in fused.collect()] == ["a", "c", "b", "d"]
    scores = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.96), (1, "c", 0.0)], "query_id int, chunk_id string, score double")
    assert [r["chunk_id"] for r in R.rerank(one.withColumn("score", F.lit(0.0)), 2, scores).orderBy("rank0").collect()] == ["b", "a"]
    assert [r["chunk_id"] for r in R.rerank(one, 2).orderBy("rank0").collect()] == ["a", "b"]
