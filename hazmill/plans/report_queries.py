"""Queries over assembled alerts and the history of analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.functions import labels as L
from hazmill.functions import taxonomy as X
from hazmill.operators import history as H
from hazmill.operators import precursors as P
from hazmill.operators import reports as A
from hazmill.plans import label_queries as LQ
from hazmill.plans.graph_queries import _ENT
from hazmill.plans.narratives import NARRATIVES, customer_narratives, narratives
from hazmill.plans.registry import query, table
from hazmill.plans.search_queries import cited
from hazmill.sources import timeline
from hazmill.sources.shared import new_folder

_ALL = f"with {LQ._N}, {LQ._SEV}, {LQ._HAZ}"
_q = lambda s: "'" + s.replace("'", "''") + "'"
_ACTIONS = "(values " + ", ".join(f"({_q(f)}, {i}, {_q(u)}, {_q(a)})" for i, (f, u, a, _, _) in enumerate(X.ACTIONS)) + ") as ac(family, seq, urgency, action)"


@query(
    "actions",
    f"""{_ALL}, e as (select analysis_id, 0 as part, seq, urgency, action from hz join {_ACTIONS} on family = hazard_type union all select analysis_id, 1, seq, urgency, action from hz join {_ACTIONS} on family = 'general'),
o as (select *, row_number() over (partition by analysis_id, lower(trim(action)) order by part, seq) as k from e)
select analysis_id, (row_number() over (partition by analysis_id order by case urgency when 'IMMEDIATE' then 0 when 'SHORT_TERM' then 1 else 2 end, part, seq) - 1)::int as place, urgency, md5(action) as action from o where k = 1""",
)
def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.corrective_actions(LQ._reports(spark, sf_dir), A.action_table(spark))
    return out.select("analysis_id", "place", "urgency", F.md5("action").alias("action"))


_NAMES = "[" + ", ".join(_q(n) for _, n, _, _ in X.PRECURSORS) + "]"
_ALERTS = f"""{_ALL}, {LQ._MATCH}, {LQ._SCORED},
pat as (select analysis_id, string_agg({_NAMES}[pattern_order + 1] || ' (seen in ' || (analysis_id % 3) || ' historical incidents)', ', ' order by part, pattern_order) as shown from m group by 1),
al as (select t.*, coalesce(shown, 'no corroborated precursor patterns') as shown, case when total >= 8 then 'priority' else 'standard' end as route from tiered t left join pat using (analysis_id))"""


@query(
    "alerts",
    _ALERTS
    + """ select analysis_id, route, concat(case when route = 'priority' then 'CRITICAL precursor risk' else tier || ' risk' end, ': ', case when coalesce(industry, '') <> '' then industry else 'Workplace' end, ' incident scored ', total, '/10') as title,
 md5(concat('Risk.', ' Detected precursors: ', shown, '. Applicable standards: ', case when len(fams) > 0 then array_to_string(fams, ', ') else 'no matching clauses retrieved' end, '. Reported outcome: ', injuries, ' injured, ', fatalities, ' fatal.')) as description from al""",
)
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = LQ.scored_reports(spark, sf_dir)
    m = P.match_precursors(r).withColumn("evidence_count", F.col("analysis_id") % 3)
    listed = m.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("part", "pattern_order", "pattern_name", "evidence_count"))).alias("patterns"))
    r = r.join(listed, "analysis_id", "left").withColumn("patterns", F.coalesce("patterns", F.array().cast(listed.schema["patterns"].dataType)))
    way = A.route(F.col("risk.total"))
    return r.withColumn("route", way).select(
        "analysis_id",
        "route",
        A.alert_title(F.col("route"), F.col("risk.tier"), F.col("industry"), F.col("risk.total")).alias("title"),
        F.md5(A.alert_description(F.lit("Risk."), F.col("patterns"), F.col("fams"), F.col("injuries"), F.col("fatalities"))).alias("description"),
    )


@query(
    "surface_patterns",
    "select o_orderkey as analysis_id, case when o_totalprice < 400000 and len(list_filter(e, lambda x: x >= 1)) > 0 then len(list_filter(e, lambda x: x >= 1)) else len(e) end::int as n_shown from (select *, [o_custkey % 2, o_orderkey % 3 - 1, o_custkey % 5 - 3] as e from orders)",
)
def surface_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda e: F.struct(e.alias("evidence_count"))
    o = table(spark, sf_dir, "orders")
    patterns = F.array(one(F.col("o_custkey") % 2), one(F.col("o_orderkey") % 3 - 1), one(F.col("o_custkey") % 5 - 3))
    return o.select(F.col("o_orderkey").alias("analysis_id"), F.size(A.surface_patterns(patterns, A.route(F.col("o_totalprice") / 50_000))).alias("n_shown"))


#: Orders as stored analyses.
_AN = """an as (select o_orderkey as id, concat('report_', o_orderkey, '.pdf') as file_name, case o_orderstatus when 'P' then 'processing' else 'complete' end as status,
 case substr(o_orderpriority, 1, 1) when '1' then 'CRITICAL' when '2' then 'HIGH' when '3' then 'MEDIUM' when '5' then 'LOW' else 'OTHER' end as severity,
 case when o_custkey % 9 = 0 then null else c_mktsegment end as industry, floor(o_totalprice / 5000) / 10 as risk_total, o_orderdate as created_at from orders join customer on c_custkey = o_custkey)"""


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("hazmill_orders")
    table(spark, sf_dir, "customer").createOrReplaceTempView("hazmill_customer")
    return spark.sql("with " + _AN.replace("from orders join customer", "from hazmill_orders join hazmill_customer") + " select * from an")


@query("history_page", f"with {_AN} select id, severity, industry, risk_total, (select count(*) from an where status = 'complete' and severity = 'HIGH') as total from an where status = 'complete' and severity = 'HIGH' order by created_at desc, id limit 20 offset 20")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.list_analyses(analyses(spark, sf_dir), 2, 20, "HIGH").select("id", "severity", "industry", "risk_total", "total")


@query("history_pages", f"with {_AN} select id, severity, industry, risk_total, (row_number() over (order by created_at desc, id) - 1)::int // 50 as page from an where status = 'complete' and severity = 'HIGH' order by created_at desc, id limit 200")
def history_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four pages of fifty from a store laid out by time, each from where the last one ended."""
    path = new_folder(spark, "timeline")
    timeline.append(analyses(spark, sf_dir), path)
    pages, after = [], None
    for i in range(4):
        found, after = timeline.page(spark, path, after, 50, "HIGH")
        if found is None:
            return analyses(spark, sf_dir).limit(0).select("id", "severity", "industry", "risk_total", F.lit(0).alias("page"))
        pages.append(found.select("id", "severity", "industry", "risk_total", F.lit(i).alias("page")))
        if after is None:
            break
    return reduce(DataFrame.unionByName, pages)


@query("all_history", f"with {_AN} select id, created_at, severity from an where status = 'complete'")
def all_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.all_history(analyses(spark, sf_dir)).select("id", "created_at", "severity")


@query("dashboard_stats", f"with {_AN} select count(*) as total, count(*) filter (severity = 'CRITICAL') as critical, round(coalesce(avg(risk_total), 0), 2) as average_risk, count(distinct industry) as industries from an where status = 'complete'")
def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.dashboard_stats(analyses(spark, sf_dir))


@query("severity_histogram", f"with {_AN}, t(severity, place) as (values ('CRITICAL', 0), ('HIGH', 1), ('MEDIUM', 2), ('LOW', 3), ('UNKNOWN', 4)) select t.severity, place, count(an.id) as n from t left join an using (severity) group by 1, 2")
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.severity_histogram(analyses(spark, sf_dir))


@query("industry_counts", f"with {_AN}, c as (select coalesce(nullif(industry, ''), 'Unspecified') as industry, count(*) as n from an group by 1) select industry, n, greatest(round(100 * n / max(n) over ()), 8.0)::double as bar from c")
def industry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.industry_counts(analyses(spark, sf_dir))


def _with_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alert = lambda s, t: F.struct(s.alias("severity"), t.alias("title"))
    both = F.array(alert(F.col("severity"), F.concat("severity", F.lit(" risk"))), alert(F.lit("LOW"), F.concat(F.lit("Follow "), F.col("id").cast("string"))))
    return analyses(spark, sf_dir).where("status = 'complete'").select("id", "created_at", both.alias("alerts"))


_AL = f"with {_AN}, al as (select id, created_at, 0 as place, severity, severity || ' risk' as title from an where status = 'complete' union all select id, created_at, 1, 'LOW', 'Follow ' || id from an where status = 'complete')"


@query("alert_register", f"{_AL} select id, place, title from al where severity = 'LOW'")
def alert_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.alert_register(_with_alerts(spark, sf_dir), "LOW").select("id", "place", "title")


@query("recent_alerts", f"{_AL}, l as (select id from an where status = 'complete' order by created_at desc, id limit 8) select id, place, title from al where id in (select id from l) order by created_at desc, id, place limit 5")
def recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.recent_alerts(_with_alerts(spark, sf_dir)).select("id", "place", "title")


@query("industry_filter_values", f"with {_AN}, l as (select * from an order by created_at desc, id limit 100) select distinct industry from l where coalesce(industry, '') <> ''")
def industry_filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.industry_filter_values(analyses(spark, sf_dir))


def corpora(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All reports of customers as history and part citations as regulations."""
    n = customer_narratives(spark, sf_dir)
    history = n.select(F.col("analysis_id").alias("chunk_id"), "text", F.col("file_name").alias("source_document"), "industry", F.lit(None).cast("string").alias("title"))
    regulations = cited(spark, sf_dir).select(
        F.col("p_partkey").alias("chunk_id"), F.concat_ws(" ", "regulation_name", F.lit("requires lockout, guards, permits and training for machine, tank and scaffold work.")).alias("text"), "regulation_name", "section", F.col("query_id").alias("source_document")
    )
    return history, regulations


@query("analyze")
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports of customers through the whole chain; the corpora are searched for each of them."""
    reports = customer_narratives(spark, sf_dir).select("analysis_id", "file_name", "text")
    r = A.analyze(reports, *corpora(spark, sf_dir))
    return r.select(
        "analysis_id",
        "hazard_type",
        "risk.total",
        "risk.tier",
        F.col("alerts")[0]["title"].alias("title"),
        *[F.size(c).alias(f"n_{c}") for c in ("entities", "similar_incidents", "regulatory_clauses", "causal_chain", "corrective_actions", "warnings")],
    )


_TOLD = f"n as (select * replace (0 as injuries, 0 as fatalities, null::varchar as industry) from ({NARRATIVES}))"
_UNSEARCHED = LQ._SCORED.replace(LQ._VIOLATED, "[]::varchar[]").replace("custkey % 30 as sim_docs", "0 as sim_docs")


@query(
    "analyze_unsearched",
    f"""with {_TOLD}, {LQ._SEV}, {LQ._HAZ}, {LQ._MATCH}, {_UNSEARCHED}, {_ENT}, en as (select analysis_id, count(*) as n from ent where place < 40 group by 1),
dn as (select hazard_type, count(distinct lower(trim(action))) as n from (select distinct hazard_type from hz) join {_ACTIONS} on family in (hazard_type, 'general') group by 1),
k as (select *, {LQ._CLASS} as document_type from (select *, {LQ._count('lower(text)', X.INCIDENT_TERMS)} as a, {LQ._count('lower(text)', X.REGULATORY_TERMS)} as b from tiered))
select k.analysis_id, document_type, severity, k.hazard_type, total, tier, concat(case when total >= 8 then 'CRITICAL precursor risk' else tier || ' risk' end, ': Workplace incident scored ', total, '/10') as title, coalesce(en.n, 0)::int as n_entities, found::int as n_precursor_patterns,
 dn.n::int as n_corrective_actions, ((len(regexp_extract_all(text, '[^\\s]+')) < 100)::int + (document_type <> 'incident')::int + 1)::int as n_warnings from k join dn on dn.hazard_type = k.hazard_type left join en on en.analysis_id = k.analysis_id""",
)
def analyze_unsearched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports of orders through the chain, their query set left empty: what each stage gives without the corpora."""
    reports = narratives(spark, sf_dir).select("analysis_id", "file_name", "text")
    r = A.analyze(reports, *corpora(spark, sf_dir), searched=F.lit(False))
    return r.select(
        "analysis_id",
        "document_type",
        F.col("severity_indicator").alias("severity"),
        "hazard_type",
        "risk.total",
        "risk.tier",
        F.col("alerts")[0]["title"].alias("title"),
        *[F.size(c).alias(f"n_{c}") for c in ("entities", "precursor_patterns", "corrective_actions", "warnings")],
    )


@query(
    "stage_summaries",
    f"""{_ALL}, {LQ._MATCH}, {LQ._SCORED}, r as (select *, {LQ._count('lower(text)', X.INCIDENT_TERMS)} as a, {LQ._count('lower(text)', X.REGULATORY_TERMS)} as b from tiered),
k as (select *, {LQ._CLASS} as document_type, len(regexp_extract_all(text, '\\S+')) as n_words, analysis_id % 4 as n_entities, custkey % 5 + 1 as n_actions from r)
select analysis_id, unnest(range(7))::int as place, unnest(['document_router', 'incident_parser', 'entity_extractor', 'pattern_detector', 'regulatory_auditor', 'risk_scorer', 'alert_synthesizer']) as stage,
 unnest([concat(case document_type when 'incident' then 'Incident report' else 'Regulatory document' end, ' detected (', n_words, ' words)'),
 concat('Parsed ', coalesce(nullif(industry, ''), 'unspecified industry'), ' incident, severity ', severity),
 concat('Found ', n_entities, ' entities; hazard family: ', replace(hazard_type, '_', ' ')),
 concat('Found ', found, ' precursor patterns across ', sim_docs, ' similar historical incidents'),
 case when len(fams) > 0 then concat('Retrieved ', len(fams), ' clauses implicating ', len(fams), ' regulation families') else 'No regulatory clauses matched.' end,
 concat('Risk score ', total, '/10 - ', tier),
 concat('1 alert, ', n_actions, ' actions, ', (n_actions + 1) // 2, ' immediate')]) as message from k""",
)
def stage_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = lambda n: F.array_repeat(F.lit(1), n.cast("int"))
    urgency = lambda i: F.struct(F.when(i % 2 == 0, "IMMEDIATE").otherwise("LONG_TERM").alias("urgency"))
    r = LQ.scored_reports(spark, sf_dir).withColumns(
        {
            "document_type": L.classify_document(F.col("text")),
            "severity_indicator": F.col("severity"),
            "families": F.col("fams"),
            "regulatory_clauses": F.col("fams"),
            "entities": many(F.col("analysis_id") % 4),
            "precursor_patterns": many(F.col("found")),
            "similar_incidents": many(F.col("similar")),
            "alerts": many(F.lit(1)),
            "corrective_actions": F.transform(F.sequence(F.lit(0).cast("long"), F.col("custkey") % 5), urgency),
        }
    )
    return A.stage_summaries(r)
