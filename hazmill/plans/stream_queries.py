"""Queries over events as updates and uploads, and over chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.functions.taxonomy import CLAUSE_RULES
from hazmill.functions.text import DATE
from hazmill.operators import chunks as C
from hazmill.plans import label_queries as LQ
from hazmill.plans.narratives import NARRATIVES, narratives
from hazmill.plans.registry import query, table
from hazmill.sources import store
from hazmill.sources.shared import new_folder
from hazmill.streaming import live
from hazmill.streaming import updates as U

#: Events as stage updates: the user is the analysis, the number a stage (or, for some types, an end), the type a status.
_UP = """up as (select user_id as analysis_id, case event_id % 10 when 0 then 'document_router' when 1 then 'incident_parser' when 2 then 'entity_extractor' when 3 then 'pattern_detector' when 4 then 'regulatory_auditor'
 when 5 then 'risk_scorer' when 6 then 'alert_synthesizer' when 7 then 'priority_alert_synthesizer' when 8 then case when event_type = 'purchase' then 'complete' else 'document_router' end else case when event_type = 'error' then 'error' else 'incident_parser' end end as stage,
 case when event_type = 'purchase' then 'completed' when event_type = 'error' and (event_id % 13 = 0 or event_id % 10 = 9) then 'error' else 'started' end as status, ts, event_id as seq from events)"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(table(spark, sf_dir, "events"))


def staged(e: DataFrame) -> DataFrame:
    """Events, a table or a stream of them, as stage updates."""
    k, kind = F.col("event_id") % 10, F.col("event_type")
    stage = F.when(k == 8, F.when(kind == "purchase", "complete").otherwise(U.STAGES[0])).when(k == 9, F.when(kind == "error", "error").otherwise(U.STAGES[1]))
    stage = stage.otherwise(F.element_at(F.array(*map(F.lit, [*U.STAGES, U.ALSO_LAST])), (F.least(k, F.lit(7)) + 1).cast("int")))
    status = F.when(kind == "purchase", U.COMPLETED).when((kind == "error") & ((F.col("event_id") % 13 == 0) | (k == 9)), U.FAILED).otherwise("started")
    return e.select(F.col("user_id").alias("analysis_id"), stage.alias("stage"), status.alias("status"), "ts", F.col("event_id").alias("seq"))


@query(
    "stage_progress",
    f"""with {_UP} select analysis_id, arg_max(stage, struct_pack(a := ts, b := seq)) as stage, arg_max(status, struct_pack(a := ts, b := seq)) as status,
 count(distinct case when status = 'completed' and stage not in ('complete', 'error') then replace(stage, 'priority_', '') end)::int as n_done, bool_or(stage in ('complete', 'error')) as is_over from up group by 1""",
)
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.stage_progress(updates(spark, sf_dir))


@query(
    "stage_states",
    f"""with {_UP}, st(place, stage) as (values (0, 'document_router'), (1, 'incident_parser'), (2, 'entity_extractor'), (3, 'pattern_detector'), (4, 'regulatory_auditor'), (5, 'risk_scorer'), (6, 'alert_synthesizer')),
l as (select analysis_id, replace(stage, 'priority_', '') as stage, arg_max(status, struct_pack(a := ts, b := seq)) as s from up group by 1, 2)
select a.analysis_id, place, st.stage, case s when 'error' then 'error' when 'completed' then 'complete' when 'started' then 'active' else 'idle' end as state from (select distinct analysis_id from up) a cross join st left join l on l.analysis_id = a.analysis_id and l.stage = st.stage""",
)
def stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.stage_states(updates(spark, sf_dir))


@query(
    "replay",
    f"""with {_UP}, ids as (select distinct c_custkey as analysis_id from customer where c_custkey % 50 = 0),
e as (select analysis_id, min(struct_pack(a := ts, b := seq)) filter (stage in ('complete', 'error')) as till from up group by 1),
o as (select up.*, row_number() over (partition by analysis_id order by ts, seq) - 1 as place from up join e using (analysis_id) where till is null or struct_pack(a := ts, b := seq) <= till)
select analysis_id, stage, status, place::int as place from o where analysis_id in (select analysis_id from ids) union all select analysis_id, 'error', 'error', 0 from ids where analysis_id not in (select analysis_id from up)""",
)
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("analysis_id"))
    return U.replay(updates(spark, sf_dir), asked)


@query(
    "live_replay",
    f"""with {_UP}, m as (select (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 as middle from events), ids as (select distinct c_custkey as analysis_id from customer where c_custkey % 50 = 0),
known as (select distinct analysis_id from up, m where epoch_us(ts) <= middle), e as (select analysis_id, min(struct_pack(a := ts, b := seq)) filter (stage in ('complete', 'error')) as till from up group by 1),
o as (select up.*, row_number() over (partition by analysis_id order by ts, seq) - 1 as place from up join e using (analysis_id) where till is null or struct_pack(a := ts, b := seq) <= till)
select analysis_id, 'reader' as subscriber, place::int as place, stage, status from o where analysis_id in (select analysis_id from ids) and analysis_id in (select analysis_id from known)
union all select analysis_id, 'reader', 0, 'error', 'error' from ids where analysis_id not in (select analysis_id from known)""",
)
def live_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions of a query set of analyses, asked in the middle of the events' time, served by one run of the stream over both tables."""
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = table(s, sf_dir, "events").agg(F.min(micros).alias("first"), F.max(micros).alias("last")).first()
    asked = table(s, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("analysis_id"))
    streamed = lambda name, rows: s.readStream.schema(s.read.parquet(f"{sf_dir}/{name}.parquet").schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir).transform(rows)
    told = streamed("events", staged).join(asked, "analysis_id", "left_semi").withColumn("ts", F.col("ts").cast("timestamp"))
    subscriptions = streamed("customer", lambda c: c.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("analysis_id"), F.lit("reader").alias("subscriber"), F.timestamp_micros(F.lit(((span["first"] or 0) + (span["last"] or 0)) // 2)).alias("ts")))
    folder = new_folder(spark, "live")
    served = live.live_replay(told, subscriptions, timeout_s=10**9)
    served.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(live.OUT).parquet(f"{folder}/rows")


@query(
    "silence_gaps",
    f"""with {_UP}, g as (select analysis_id, seq, epoch_us(lead(ts) over (partition by analysis_id order by ts, seq)) - epoch_us(ts) as gap from up)
select analysis_id, seq, gap / 1e6 as gap_s, floor(least(gap, 36000000000) / 3600000000)::int as n_heartbeats, gap > 36000000000 as timed_out from g where gap > 3600000000""",
)
def silence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.silence_gaps(updates(spark, sf_dir), 3600, 36_000)


@query(
    "rate_limit",
    """with recursive ev as (select user_id as k, event_id as id, ts from events), w as (select k, min(ts) as s from ev group by k union all select w.k, (select min(ev.ts) from ev where ev.k = w.k and ev.ts >= w.s + interval 24 hour) from w where w.s is not null),
a as (select ev.k, ev.id, ev.ts, max(w.s) as s from ev join w on w.k = ev.k and w.s <= ev.ts group by 1, 2, 3), n as (select *, row_number() over (partition by k, s order by ts, id) as n from a)
select k as client_key, id as request_id, n::int as n, n <= 3 as allowed from n""",
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return U.rate_limit(e.select(F.col("user_id").alias("client_key"), F.col("event_id").alias("request_id"), "ts"), 3, 86_400)


@query(
    "result_cache",
    """with recursive ev as (select user_id % 97 as h, event_id as id, ts, event_type <> 'error' as ok from events),
w as (select h, min(ts) as s from ev where ok group by h union all select w.h, (select min(ev.ts) from ev where ev.h = w.h and ok and ev.ts >= w.s + interval 6 hour) from w where w.s is not null),
a as (select ev.*, max(w.s) as s from ev left join w on w.h = ev.h and w.s <= ev.ts group by all), r as (select w.h, w.s, min(ev.id) as rid from w join ev on ev.h = w.h and ev.ts = w.s and ev.ok group by 1, 2)
select a.id as request_id, case when a.s is not null and a.ts < a.s + interval 6 hour then rid else a.id end as analysis_id, a.s is not null and a.ts < a.s + interval 6 hour and a.id <> rid as hit from a left join r on r.h = a.h and r.s = a.s""",
)
def result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = F.sha2(F.encode((F.col("user_id") % 97).cast("string"), "UTF-8"), 256)
    return U.result_cache(e.select(key.alias("content_sha256"), F.col("event_id").alias("request_id"), "ts", (F.col("event_type") != "error").alias("ok")), 6 * 3600)


@query("chunks")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", "doc_id").alias("name"), "lang", "text")
    out = C.index_documents(docs, "incidents")
    return out.select("doc_id", "idx", "section", "chunk_id", "lang", F.length("text").alias("chars"))


@query("chunk_ids", "select doc_id, concat(source, '::', doc_id % 7, '::', substr(sha1(text), 1, 10)) as chunk_id from documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.chunk_ids(F.col("source"), F.col("doc_id") % 7, F.col("text")).alias("chunk_id"))


@query("corpus_manifest", "select greatest(count(distinct source), 1) as document_count, count(*) as chunk_count from documents")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.corpus_manifest(table(spark, sf_dir, "documents").withColumnRenamed("source", "source_document"))


@query("merge_reports", "select o_orderkey as id, o_totalprice as risk_total from orders where o_custkey % 3 <> 0 union all select o_orderkey, -o_totalprice from orders where o_custkey % 3 = 0")
def merge_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("risk_total"), "o_custkey")
    new = old.where("o_custkey % 3 = 0").withColumn("risk_total", -F.col("risk_total"))
    return store.merged(old, new, "id").select("id", "risk_total")


_TITLE_FAMILY = "case " + " ".join(f"when regexp_matches(concat(title, ' '), '{rx}') then '{f}'" for rx, f in CLAUSE_RULES) + " else 'general_duty_clause' end"


@query(
    "document_metadata",
    f"""with n as (select * replace (0 as injuries, 0 as fatalities) from ({NARRATIVES})), {LQ._SEV}, {LQ._HAZ},
c as (select *, {LQ._industry_counts()}, replace(regexp_replace(file_name, '\\.[^.]*$', ''), '_', ' ') as title from hz)
select analysis_id, title, file_name as source_document, {LQ._industry_case()} as industry, severity, hazard_type, regexp_extract(text[:{C.FRONT}], '{DATE}', 1) as incident_date, title as regulation_name, {_TITLE_FAMILY} as clause_family from c""",
)
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = narratives(spark, sf_dir).select("analysis_id", F.col("file_name").alias("name"), "text")
    return C.regulation_metadata(C.document_metadata(n)).drop("text", "name")
