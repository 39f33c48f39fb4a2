"""Queries over documents and pages: text preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.functions import text as T
from hazmill.operators import chunks as C
from hazmill.operators import corpus
from hazmill.plans.registry import query, table

#: Reports of many pages: a source's documents with a running header and a page number.
PAGES = "select source as doc_id, doc_id as page_no, concat('SAFETY REPORT ', upper(source), chr(10), text, chr(10), '  Page ', cast(doc_id as varchar(20)), '  ') as text from documents"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("SAFETY REPORT "), F.upper("source"), F.lit("\n"), "text", F.lit("\n  Page "), F.col("doc_id").cast("string"), F.lit("  "))
    return docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), text.alias("text"))


_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z("''\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""


@query("sentences", f"select doc_id, len({_SENTENCES})::int as n_sentences, md5(array_to_string({_SENTENCES}, '|')) as digest from documents")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.split_sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("digest"))


@query("tokens_per_doc", "select doc_id, len(t)::int as n_tokens, len(list_distinct(t))::int as n_distinct from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents)")
def tokens_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query("word_counts", r"select source, count(*) as n_docs, sum(len(regexp_extract_all(text, '[^\s]+')))::bigint as n_words from documents group by source")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(T.word_count(F.col("text"))).alias("n_words"))


_NORMALIZE = r"""
with joined as (select doc_id, string_split(regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), chr(10)) as ls from documents),
ls as (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) as i from joined),
nx as (select *, lead(l) over (partition by doc_id order by i) as n from ls),
sep as (select doc_id, i, l, case when n is null then '' when (i = 1 or l <> '') and not regexp_matches(l, '[.!?:;]$') and n <> '' and not regexp_matches(n, '^[\s•\-\d]') then ' ' else chr(10) end as s from nx),
t as (select doc_id, string_agg(l || s, '' order by i) as text from sep group by doc_id)
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as digest from t"""


@query("normalize", _NORMALIZE)
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("digest"))


_HEADING_SQL = r"'^\s*(?:[A-Z][A-Z \-/&]{4,}|\d+(?:\.\d+)*\s+[A-Z].{0,80})\s*$'"
_SECTION_ROWS = rf"""
ls as (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i
            from (select doc_id, concat('OVERVIEW OF ', upper(source), chr(10), text, chr(10), '2.1 Findings', chr(10), lang) as text from documents)),
h as (select *, regexp_matches(l, {_HEADING_SQL}) as hd from ls),
s as (select *, sum(hd::int) over (partition by doc_id order by i) as section_no from h),
g as (select doc_id, section_no, coalesce(max(case when hd then {_STRIP.format('l')} end), '') as heading, {_STRIP.format("coalesce(string_agg(case when not hd then l end, chr(10) order by i), '')")} as body from s group by doc_id, section_no)"""


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with two headings, so that each has two sections at least."""
    text = F.concat(F.lit("OVERVIEW OF "), F.upper("source"), F.lit("\n"), "text", F.lit("\n2.1 Findings\n"), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", "doc_id").alias("name"), text.alias("text"))


@query("sections", f"with {_SECTION_ROWS} select doc_id, section_no::int as section_no, heading, length(body)::int as body_chars from g where body <> ''")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split_sections(headed(spark, sf_dir)).select("doc_id", "section_no", "heading", F.length("body").alias("body_chars"))


#: The fold over a section's sentences as a recursion: piece counts the chunks begun, words those of the open one.
_CHUNKS = rf"""
with recursive {_SECTION_ROWS},
cut as (select doc_id, section_no, heading, body, {_SENTENCES.replace('replace(text', 'replace(body')} as ss from g where body <> ''),
rows as (select doc_id, section_no, unnest(ss) as sentence, generate_subscripts(ss, 1) - 1 as place from cut where len(ss) > 1),
b as (select doc_id, section_no, place, (cast(concat('0x', substr(md5(term), 1, 8)) as bigint) % 384)::int as bucket from (select doc_id, section_no, place, unnest(regexp_extract_all(lower(sentence), '[a-z0-9]+')) as term from rows)),
n as (select doc_id, section_no, place, bucket, count(*) as n from b group by all),
v as (select doc_id, section_no, place, bucket, n / sqrt(sum(n * n) over (partition by doc_id, section_no, place)) as value from n),
near as (select a.doc_id, a.section_no, a.place, sum(a.value * o.value) as sim from v a join v o on a.doc_id = o.doc_id and a.section_no = o.section_no and a.bucket = o.bucket and o.place = a.place - 1 group by all),
sim as materialized (select doc_id, section_no, place, sentence, len(regexp_extract_all(sentence, '[^\s]+')) as words, round(coalesce(sim, 0), 9) < {C.THRESHOLD} as shift from rows left join near using (doc_id, section_no, place)),
f as (select doc_id, section_no, place, 0 as piece, words from sim where place = 0
  union all select doc_id, section_no, place, piece + ends::int, case when ends then 0 else open end + words
  from (select s.doc_id, s.section_no, s.place, s.words, f.piece, f.words as open, (s.shift and f.words >= {C.MIN_WORDS}) or f.words >= {C.MAX_WORDS} as ends from f join sim s on s.doc_id = f.doc_id and s.section_no = f.section_no and s.place = f.place + 1)),
pieces as (select doc_id, section_no, piece, string_agg(sentence, ' ' order by place) as text from f join sim using (doc_id, section_no, place) group by all
  union all select doc_id, section_no, 0, body from cut where len(ss) < 2),
numbered as (select *, row_number() over (partition by doc_id order by section_no, piece) - 1 as idx from pieces)
select doc_id, idx::int as idx, heading as section, concat(source, '-', doc_id, '::', idx, '::', substr(sha1(p.text), 1, 10)) as chunk_id, length(p.text)::int as chars
from numbered p join cut using (doc_id, section_no) join documents using (doc_id)"""


@query("semantic_chunks", _CHUNKS)
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.index_documents(headed(spark, sf_dir), "incidents", digest="md5")
    return out.select("doc_id", "idx", "section", "chunk_id", F.length("text").alias("chars"))


_LINES = f"""
pages as ({PAGES}),
ls as (select distinct doc_id, page_no, {_STRIP.format('l')} as line from (select doc_id, page_no, unnest(string_split(text, chr(10))) as l from pages)),
size as (select doc_id, count(*) as n_pages from pages group by doc_id),
rep as (select doc_id, line, count(*) as n, any_value(n_pages) as n_pages from ls join size using (doc_id) where line <> '' and length(line) < 120 group by doc_id, line having count(*) > 0.5 * any_value(n_pages) and any_value(n_pages) >= 3)"""


@query("furniture_lines", f"with {_LINES} select * from rep")
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.repeated_lines(pages(spark, sf_dir))


@query(
    "remove_furniture",
    f"""with {_LINES},
raw as (select doc_id, page_no, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from pages),
kept as (select raw.doc_id, page_no, string_agg(l, chr(10) order by i) as t from raw where not exists (select 1 from rep where rep.doc_id = raw.doc_id and rep.line = {_STRIP.format('l')}) group by raw.doc_id, page_no)
select doc_id, count(*) as n_pages, md5(string_agg(t, chr(10) || chr(10) order by page_no)) as digest from kept group by doc_id""",
)
def remove_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    counted = p.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    return corpus.remove_furniture(p).join(counted, "doc_id").select("doc_id", "n_pages", F.md5("text").alias("digest"))


@query(
    "page_budget",
    f"""with pages as ({PAGES}), b as (select *, row_number() over w as nth, coalesce(sum(length(text)) over (partition by doc_id order by page_no rows between unbounded preceding and 1 preceding), 0) as before from pages window w as (partition by doc_id order by page_no))
select doc_id, page_no, length(text)::int as chars from b where nth <= 40 and before < 60000""",
)
def page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.apply_page_budget(pages(spark, sf_dir), 40, 60_000).select("doc_id", "page_no", F.length("text").alias("chars"))


@query(
    "readable_documents",
    """with own as (select doc_id, sum(length(text)) as own from documents group by doc_id),
alt as (select doc_id, sum(length(text) * (case when doc_id % 3 = 0 then 2 else 0 end)) as other from documents group by doc_id)
select doc_id, (case when own < 200 and other > own then other else own end)::bigint as chars,
  case when own >= 200 then 'extracted' when other > own then 'alternative' when own > 0 then 'extracted' else 'rejected' end as source from own join alt using (doc_id)""",
)
def readable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    alt = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", "text")).otherwise("").alias("text"))
    return corpus.readable_documents(docs, 200, alt)


@query("dedupe_corpus", "select sha256(text) as sha256, min(concat(source, '-', doc_id)) as name from documents group by 1")
def dedupe_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dedupe_corpus(table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", "doc_id").alias("name"), "text"))


@query(
    "first_date",
    r"""with d as (select o_orderkey, concat('Filed by clerk. The event on ', case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%B %-d, %Y') when o_orderkey % 3 = 1 then strftime(o_orderdate, '%-m/%-d/%Y') else strftime(o_orderdate, '%Y-%m-%d') end, ' was reviewed 2001-01-01.') as t from orders)
select o_orderkey, regexp_extract(t, '\b(?:on\s+)?((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2})\b', 1) as first_date from d""",
)
def first_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    shown = F.when(k == 0, F.date_format(d, "MMMM d, yyyy")).when(k == 1, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    text = F.concat(F.lit("Filed by clerk. The event on "), shown, F.lit(" was reviewed 2001-01-01."))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.detect_date(text).alias("first_date"))


@query(
    "safe_names",
    r"""select p_partkey, trim(substr(trim(regexp_replace(p_name || '/' || p_brand || ' é', '[^A-Za-z0-9 ._-]+', ' ', 'g')), 1, 12)) as name,
 regexp_replace(regexp_replace(regexp_extract(p_type || '/' || p_name || '_' || p_brand || '.pdf', '([^/\\]*)$', 1), '[^A-Za-z0-9 ._-]+', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') as file_name,
 replace(regexp_replace(p_name || '_' || p_size || '.txt', '\.[^.]*$', ''), '_', ' ') as title from part""",
)
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        T.safe_name(F.concat("p_name", F.lit("/"), "p_brand", F.lit(" é")), 12).alias("name"),
        T.safe_filename(F.concat("p_type", F.lit("/"), "p_name", F.lit("_"), "p_brand", F.lit(".pdf"))).alias("file_name"),
        T.document_title(F.concat("p_name", F.lit("_"), "p_size", F.lit(".txt"))).alias("title"),
    )


@query(
    "page_links",
    """with l as (select page_id, unnest(regexp_extract_all(html, 'href="(/[^"/]{3,})"', 1)) as href, generate_subscripts(regexp_extract_all(html, 'href="(/[^"/]{3,})"', 1), 1) - 1 as place from pages)
select page_id, trim(href, '/') as slug, min(place)::int as place from l where trim(href, '/') not in ('and', 'der') group by 1, 2""",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.extract_links(table(spark, sf_dir, "pages"), skip=("and", "der"))


@query(
    "report_links",
    """with l as (select page_id, regexp_extract_all(concat('<a href="', url, '/summary.pdf"><a href="/final-report.PDF?v=', page_id, '"><a href="/recommendation/report.pdf">', html), '(?i)href="([^"]+\\.pdf[^"]*)"', 1) as hs from pages),
f as (select page_id, list_filter(hs, lambda h: not contains(lower(h), '/recommendation')) as hs from l),
b as (select page_id, coalesce(list_filter(hs, lambda h: contains(lower(h), 'report'))[1], hs[1]) as link from f)
select page_id, case when starts_with(link, 'http') then link else 'https://reports.example' || link end as link from b where link is not null""".replace("\\\\", "\\"),
)
def report_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit('<a href="'), "url", F.lit('/summary.pdf"><a href="/final-report.PDF?v='), "page_id", F.lit('"><a href="/recommendation/report.pdf">'), "html")
    return corpus.report_link(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "https://reports.example")
