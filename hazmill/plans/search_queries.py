"""Queries that search: benchmark passages over documents, vectors over vectors, citations over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.functions.taxonomy import CLAUSE_RULES
from hazmill.operators import retrieval as R
from hazmill.operators import vector_index as V
from hazmill.plans.registry import query, table
from hazmill.sources.shared import new_folder


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", "lang")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_BM25 = """
toks as (select doc_id as chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
dl as (select chunk_id, len(t) as dl from toks),
post as (select term, chunk_id, count(*) as tf from (select chunk_id, unnest(t) as term from toks) group by 1, 2),
n as (select count(*)::double as n, avg(dl) as mean from dl),
raw as (select term, count(*) as df, ln((select n from n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from post group by term),
terms as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
q as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark) group by 1, 2),
bm as (select query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (select mean from n)))) as score
  from q join terms using (term) join post using (term) join dl using (chunk_id) group by 1, 2),
sparse as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) - 1 as rank0 from bm)"""


@query("bm25_terms", f"with {_BM25} select term, df, round(idf, 6) as idf from terms")
def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.build_bm25(_docs(spark, sf_dir)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"with {_BM25} select query_id, chunk_id, rank0::int as rank0, round(score, 6) as score from sparse where rank0 < 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.bm25_search(_items(spark, sf_dir), R.build_bm25(_docs(spark, sf_dir)), 10)
    return hits.select("query_id", "chunk_id", "rank0", F.round("score", 6).alias("score"))


_HASH = """
{name}_b as (select {key}, (cast(concat('0x', substr(md5(term), 1, 8)) as bigint) % 384)::int as bucket from (select {id} as {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from {source})),
{name}_n as (select {key}, bucket, count(*) as n from {name}_b group by 1, 2),
{name} as (select {key}, bucket, n / sqrt(sum(n * n) over (partition by {key})) as value from {name}_n)"""
_DENSE = (
    _HASH.format(name="dv", key="chunk_id", id="doc_id", source="documents")
    + ","
    + _HASH.format(name="qv", key="query_id", id="item_id", source="benchmark")
    + """,
dot as (select query_id, chunk_id, sum(qv.value * dv.value) as score from qv join dv using (bucket) group by 1, 2),
dense as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) - 1 as rank0 from dot)"""
)


@query("hash_vectors", "with " + _HASH.format(name="v", key="doc_id", id="doc_id", source="documents") + " select doc_id, count(*) as n_buckets, round(max(value), 6) as largest from v group by doc_id")
def hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.hash_embed(table(spark, sf_dir, "documents"), "doc_id", digest="md5")
    return v.groupBy("doc_id").agg(F.count("*").alias("n_buckets"), F.round(F.max("value"), 6).alias("largest"))


_FUSED = """
lists as (select query_id, chunk_id, rank0, 0 as list_no from dense where rank0 < 20 union all select query_id, chunk_id, rank0, 1 from sparse where rank0 < 20),
fuse as (select query_id, chunk_id, sum(1.0::double / (rank0 + 60)) as fused, min(list_no * 1000 + rank0) as seen from lists group by 1, 2),
fused as (select *, row_number() over (partition by query_id order by round(fused, 12) desc, seen) - 1 as rank0 from fuse)"""


@query(
    "hybrid_hash",
    f"with {_BM25}, {_DENSE}, {_FUSED} select f.query_id, f.chunk_id, f.rank0::int as rank0, round(coalesce(d.score, 0), 6) as score from fused f left join (select * from dense where rank0 < 20) d on d.query_id = f.query_id and d.chunk_id = f.chunk_id where f.rank0 < 8",
)
def hybrid_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.hybrid_search(_items(spark, sf_dir), _docs(spark, sf_dir), 8, compressed=False, digest="md5")
    return hits.select("query_id", "chunk_id", "rank0", F.round("score", 6).alias("score"))


_LANGS = """case b.item_id % 3 when 0 then '' when 1 then 'en' else 'xx' end"""


#: One query in three has a word that no document has, and an industry that none has: it is left with nothing and searches again without the filter.
_ITEMS = "items as (select item_id, case when item_id % 3 = 2 then concat('zqx', item_id) else text end as text from benchmark)"


def _fused_sql(name: str, dense: str) -> str:
    return f"""
{name}_l as (select query_id, chunk_id, rank0, 0 as list_no from {dense} where rank0 < 20 union all select query_id, chunk_id, rank0, 1 from sparse where rank0 < 20),
{name}_f as (select query_id, chunk_id, sum(1.0::double / (rank0 + 60)) as fused, min(list_no * 1000 + rank0) as seen from {name}_l group by 1, 2),
{name} as (select query_id, chunk_id, rank0 from (select *, row_number() over (partition by query_id order by round(fused, 12) desc, seen) - 1 as rank0 from {name}_f) where rank0 < 8)"""


@query(
    "hybrid_incidents",
    f"""with {_ITEMS}, {_BM25.replace('from benchmark', 'from items')}, {_DENSE.replace('from benchmark', 'from items')},
want as (select item_id as query_id, {_LANGS} as industry from benchmark b),
fd as (select dot.query_id, dot.chunk_id, dot.score, row_number() over (partition by dot.query_id order by round(dot.score, 9) desc, dot.chunk_id) - 1 as rank0
  from dot join want using (query_id) join documents d on d.doc_id = dot.chunk_id where industry = '' or industry = d.lang),
{_fused_sql('narrow', 'fd')}, {_fused_sql('wide', 'dense')},
enough as (select query_id from narrow group by 1 having count(*) >= 4),
hits as (select * from narrow where query_id in (select query_id from enough) union all select * from wide where query_id not in (select query_id from enough))
select query_id, chunk_id as doc_id, rank0::int as rank0, round(greatest(0.9 - 0.12 * rank0, 0.1), 2)::double as similarity_score, source as source_document from hits join documents on doc_id = chunk_id""",
)
def hybrid_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    industry = F.when(F.col("query_id") % 3 == 0, "").when(F.col("query_id") % 3 == 1, "en").otherwise("xx")
    text = F.when(F.col("query_id") % 3 == 2, F.concat(F.lit("zqx"), F.col("query_id"))).otherwise(F.col("text"))
    docs = _docs(spark, sf_dir).select("chunk_id", "text", F.col("lang").alias("industry"), F.col("source").alias("source_document"))
    hits = R.hybrid_search_incidents(_items(spark, sf_dir).withColumns({"industry": industry, "text": text}), docs, 8, digest="md5", compressed=False)
    return R.to_similar_incident(hits).select("query_id", "doc_id", "rank0", "similarity_score", "source_document")


@query(
    "compress_hits",
    f"""with {_BM25}, {_DENSE}, top as (select query_id, chunk_id from sparse where rank0 < 5),
cut as (select query_id, chunk_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z("''\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') as ss, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as whole from top join documents on doc_id = chunk_id),
s as (select query_id, chunk_id, unnest(ss) as sentence, generate_subscripts(ss, 1) as place from cut),
sb as (select query_id, chunk_id, place, (cast(concat('0x', substr(md5(term), 1, 8)) as bigint) % 384)::int as bucket from (select query_id, chunk_id, place, unnest(regexp_extract_all(lower(sentence), '[a-z0-9]+')) as term from s)),
sn as (select query_id, chunk_id, place, bucket, count(*) as n from sb group by 1, 2, 3, 4),
sv as (select *, n / sqrt(sum(n * n) over (partition by query_id, chunk_id, place)) as value from sn),
c as (select query_id, chunk_id, place, round(sum(sv.value * qv.value), 9) as cosine from sv join qv using (query_id, bucket) group by 1, 2, 3),
sc as (select s.*, coalesce(cosine, 0) as cosine from s left join c using (query_id, chunk_id, place)),
k as (select query_id, chunk_id, string_agg(sentence, ' ' order by place) filter (cosine >= 0.3) as kept, arg_max(sentence, struct_pack(a := cosine, b := -place)) as best from sc group by 1, 2)
select query_id, chunk_id, md5(case when len(ss) < 2 then whole else coalesce(kept, best) end) as digest from cut left join k using (query_id, chunk_id)""",
)
def compress_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = _items(spark, sf_dir), _docs(spark, sf_dir)
    hits = R.bm25_search(items, R.build_bm25(docs), 5).join(docs, "chunk_id")
    return R.compress(hits, items, digest="md5").select("query_id", "chunk_id", F.md5("text").alias("digest"))


@query("benchmark_recall", f"with {_BM25}, own as (select item_id as query_id, doc_id as chunk_id from benchmark b join documents d on contains(d.text, b.text)) select o.query_id, count(*) as n_docs, count(s.rank0) as n_found from own o left join (select * from sparse where rank0 < 50) s using (query_id, chunk_id) group by 1")
def benchmark_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = _items(spark, sf_dir), _docs(spark, sf_dir)
    # a passage can only stand in documents that have its rarest token run: its tokens at both ends may be cut, those between are whole
    from hazmill.functions import text as T

    def runs(rows: DataFrame, key: str, size: int) -> DataFrame:
        t = T.tokenize(F.col("text"))
        grams = F.transform(F.sequence(F.lit(1), F.size("t") - (size - 1)), lambda i: F.xxhash64(F.slice(F.col("t"), i, size)))
        return rows.select(key, t.alias("t")).where(F.size("t") >= size).select(key, F.explode(F.array_distinct(grams)).alias("gram"))

    size = 5
    grams = runs(items.select("query_id", F.regexp_extract("text", r"(?s)^[A-Za-z0-9]*(.*?)[A-Za-z0-9]*$", 1).alias("text")), "query_id", size)
    of_docs = runs(docs, "chunk_id", size).join(grams.select("gram").distinct(), "gram", "left_semi")
    rare = grams.join(of_docs.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    met = rare.join(of_docs, "gram").select("query_id", "chunk_id").distinct()
    # passages too short for a run meet every document, in blocks of a broadcast of bounded size or by a join
    short = items.join(grams.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.col("text").alias("passage"))
    n_short = short.count()
    if n_short:
        few = docs.select("chunk_id", "text").join(F.broadcast(short) if n_short <= 10_000 else short, F.col("text").contains(F.col("passage"))).select("query_id", "chunk_id")
        met = met.unionByName(few)
    own = met.join(items.withColumnRenamed("text", "passage"), "query_id").join(docs.select("chunk_id", "text"), "chunk_id").where(F.col("text").contains(F.col("passage"))).select("query_id", "chunk_id")
    hits = R.bm25_search(items, R.build_bm25(docs), 50).select("query_id", "chunk_id", "rank0")
    return own.join(hits, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_docs"), F.count("rank0").alias("n_found"))


_KNN = """
q as (select vec_id as query_id, embedding::double[] as e, label from embeddings where vec_id % 50 = 0),
v as (select vec_id as chunk_id, embedding::double[] as e, label from embeddings),
s as (select query_id, chunk_id, list_dot_product(q.e, v.e) as score, q.label = v.label as same from q, v)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label"), e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


@query("knn_topk", f"with {_KNN}, r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) - 1 as rank0 from s) select query_id, chunk_id, rank0::int as rank0, round(score, 6) as score from r where rank0 < 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    return R.dense_search(q, v, 10).select("query_id", "chunk_id", "rank0", F.round("score", 6).alias("score"))


@query("knn_filtered", f"with {_KNN}, r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) - 1 as rank0 from s where same) select query_id, chunk_id, rank0::int as rank0, round(score, 6) as score from r where rank0 < 10")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    return R.dense_search(q, v, 10, label="label").select("query_id", "chunk_id", "rank0", F.round("score", 6).alias("score"))


@query(
    "rrf",
    f"""with {_KNN}, a as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) - 1 as rank0 from s),
b as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) - 1 as rank0 from s where same),
lists as (select query_id, chunk_id, rank0, 0 as list_no from a where rank0 < 20 union all select query_id, chunk_id, rank0, 1 from b where rank0 < 20),
fuse as (select query_id, chunk_id, sum(1.0::double / (rank0 + 60)) as fused, min(list_no * 1000 + rank0) as seen from lists group by 1, 2)
select query_id, chunk_id, round(fused, 9) as fused, (row_number() over (partition by query_id order by round(fused, 12) desc, seen) - 1)::int as rank0 from fuse""",
)
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    return R.reciprocal_rank_fusion(R.dense_search(q, v), R.dense_search(q, v, label="label")).select("query_id", "chunk_id", F.round("fused", 9).alias("fused"), "rank0")


_BEST = "select query_id, chunk_id, rank0::int as rank0, round(score, 6) as score from r where rank0 < 10"
_ALL_KNN = f"with {_KNN}, r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) - 1 as rank0 from s) {_BEST}"
_SAME_KNN = f"with {_KNN}, r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) - 1 as rank0 from s where same) {_BEST}"
#: The vectors of the tables lie in all directions alike, the hardest case for cells; with so many standard deviations none is missed there.
_SURE = 5.0


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", "chunk_id", "rank0", F.round("score", 6).alias("score"))


def _cells(spark: SparkSession, v: DataFrame, label: str | None = None) -> V.VectorIndex:
    return V.build_vector_index(v, new_folder(spark, "vectors"), label)


@query("approx_knn", _ALL_KNN)
def approx_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    return _hits(V.search_vectors(q, _cells(spark, v), 10, _SURE))


@query("cells_knn", _ALL_KNN)
def cells_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly, through cells, by the triangle inequality."""
    q, v = _vectors(spark, sf_dir)
    return _hits(V.search_vectors(q, _cells(spark, v), 10, None))


@query("cells_knn_filtered", _SAME_KNN)
def cells_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    return _hits(V.search_vectors(q, _cells(spark, v, "label"), 10, None, "label"))


@query("approx_recall", "select label::int as label, 10 * count(*) filter (vec_id % 50 = 0) as n_wanted, true as enough from embeddings group by label having n_wanted > 0")
def approx_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the queries' label, whether nine tenths of the ten nearest are found at the usual sureness."""
    q, v = _vectors(spark, sf_dir)
    found = V.search_vectors(q, _cells(spark, v), 10).select("query_id", "chunk_id", F.lit(1).alias("found"))
    both = R.dense_search(q, v, 10).join(found, ["query_id", "chunk_id"], "left").join(q.select("query_id", "label"), "query_id")
    return both.groupBy("label").agg(F.count("*").alias("n_wanted"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))


def _in_ten(rows: DataFrame, key: str) -> list[DataFrame]:
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(10)) == i) for i in range(10)]


@query("grown_vectors", _ALL_KNN)
def grown_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As cells_knn, over an index to which the vectors were added in ten parts."""
    q, v = _vectors(spark, sf_dir)
    first, *more = _in_ten(v, "chunk_id")
    index = _cells(spark, first)
    for part in more:
        index = V.add_vectors(index, part)
    return _hits(V.search_vectors(q, index, 10, None))


@query("grown_bm25", f"with {_BM25} select query_id, chunk_id, rank0::int as rank0, round(score, 6) as score from sparse where rank0 < 10")
def grown_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk, over an index to which the documents were added in ten parts, its segments then merged."""
    first, *more = _in_ten(_docs(spark, sf_dir), "chunk_id")
    index = R.build_bm25(first)
    for part in more:
        index = R.add_chunks(index, part)
    index = R.merge_segments(index, new_folder(spark, "bm25"))
    return _hits(R.bm25_search(_items(spark, sf_dir), index, 10))


#: Citations over parts: a name and a section, from the part's number.
CITED = """select p_partkey, p_partkey % 9 as rank0, p_brand as query_id, concat('OSHA 29 CFR ', case p_partkey % 12 when 0 then '1910.147' when 1 then '1910.146(d)' when 2 then '1910.212' when 3 then '1926.501(b)' when 4 then '1910.132' when 5 then '1910.1200'
 when 6 then '1910.22' when 7 then '1910.303' when 8 then '1910.252' when 9 then '1910.119' when 10 then 'Section 5(a)(1)' else '1904.7' end) as regulation_name, case when p_size % 5 = 0 then '1910.147(c)(4)' else '' end as section from part"""


def _family_sql() -> str:
    cases = " ".join(f"when regexp_matches(concat(regulation_name, ' ', section), '{rx}') then '{f}'" for rx, f in CLAUSE_RULES)
    return f"case {cases} else 'general_duty_clause' end"


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("hazmill_part")
    return spark.sql(CITED.replace("from part", "from hazmill_part"))


@query("clause_family", f"select p_partkey, {_family_sql()} as family from ({CITED})")
def clause_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited(spark, sf_dir).select("p_partkey", R.clause_family(F.col("regulation_name"), F.col("section")).alias("family"))


@query("rank_confidence", f"select p_partkey, round(greatest(0.9 - 0.12 * rank0, 0.1), 2)::double as confidence from ({CITED})")
def rank_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited(spark, sf_dir).select("p_partkey", R.rank_confidence(F.col("rank0")).alias("confidence"))


@query(
    "violated_families",
    f"select query_id, array_to_string(list_sort(list(distinct family)), ',') as families from (select query_id, {_family_sql()} as family from ({CITED}) where round(greatest(0.9 - 0.12 * rank0, 0.1), 2) >= 0.35) group by 1",
)
def violated_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cited(spark, sf_dir).select("query_id", R.rank_confidence(F.col("rank0")).alias("violation_confidence"), R.clause_family(F.col("regulation_name"), F.col("section")).alias("family"))
    return R.violated_families(rows).select("query_id", F.array_join("families", ",").alias("families"))


#: Documents as clauses; one in seven says something that its source does not.
@query(
    "verbatim_check",
    """with c as (select doc_id, source, coalesce(text, '') as text, case when doc_id % 7 = 0 then concat(coalesce(text, ''), ' The inspector of case ', doc_id, ' disagreed.') else coalesce(text, '') end as clause from documents),
s as (select doc_id, source, text, unnest(list_filter(list_transform(string_split(regexp_replace(clause, '([.!?])\\s+([A-Z("''\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')) as sentence from c)
select doc_id as clause_id, source as query_id, md5(sentence) as sentence from s where not contains(text, sentence)""",
)
def verbatim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    said = F.when(F.col("chunk_id") % 7 == 0, F.concat("text", F.lit(" The inspector of case "), "chunk_id", F.lit(" disagreed."))).otherwise(F.col("text"))
    clauses = docs.select(F.col("source").alias("query_id"), F.col("chunk_id").alias("clause_id"), said.alias("clause_text"))
    return R.verbatim_check(clauses, docs).select("clause_id", "query_id", F.md5("sentence").alias("sentence"))
