"""Queries that label, score and corroborate reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.functions import labels as L
from hazmill.functions import scoring as S
from hazmill.functions import taxonomy as X
from hazmill.operators import precursors as P
from hazmill.operators.reports import similar_document_count
from hazmill.plans.narratives import CUSTOMER_NARRATIVES, DOCUMENT_REPORTS, NARRATIVES, customer_narratives, document_reports, narratives
from hazmill.plans.registry import query

_N = f"n as ({NARRATIVES})"
_has = lambda t, terms: "(" + " or ".join(f"contains({t}, '{k}')" for k in terms) + ")"
_count = lambda t, terms: "(" + " + ".join(f"contains({t}, '{k}')::int" for k in terms) + ")"

_CLASS = f"""case when abs(a - b) >= 2 then case when a > b then 'incident' else 'regulatory' end when a >= b then 'incident' else 'regulatory' end"""


@query("doc_class", f"with {_N}, c as (select analysis_id, {_count('lower(text)', X.INCIDENT_TERMS)} as a, {_count('lower(text)', X.REGULATORY_TERMS)} as b from n) select analysis_id, {_CLASS} as document_type from c")
def doc_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives(spark, sf_dir).select("analysis_id", L.classify_document(F.col("text")).alias("document_type"))


_NEG = L.NEGATED.replace("'", "''")
_SEVERITY = f"""case when fatalities > 0 or {_has('st', X.CRITICAL_TERMS)} then 'CRITICAL' when injuries >= 3 or {_has('st', X.HIGH_TERMS)} then 'HIGH'
 when injuries > 0 or {_has('st', X.MEDIUM_TERMS)} then 'MEDIUM' when {_has('lw', X.LOW_TERMS)} or regexp_matches(lw, '{_NEG}') then 'LOW' else 'UNKNOWN' end"""
_SEV = f"sv as (select *, {_SEVERITY} as severity from (select *, regexp_replace(lw, '{_NEG}', ' ', 'g') as st from (select *, regexp_replace(lower(text), '\\s+', ' ', 'g') as lw from n)))"


@query("severity", f"with {_N}, {_SEV} select analysis_id, severity from sv")
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives(spark, sf_dir).select("analysis_id", L.classify_severity(F.col("text"), F.col("injuries"), F.col("fatalities")).alias("severity"))


def _family_scores() -> str:
    fams = [f for f in X.FAMILIES if f != "general"]
    return ", ".join("(" + " + ".join(f"{_has('lower(text)', kw)}::int" for g, _, _, kw in X.PRECURSORS if g == f) + f") as s_{f}" for f in fams)


def _hazard_case() -> str:
    fams = [f for f in X.FAMILIES if f != "general"]
    top = "greatest(" + ", ".join(f"s_{f}" for f in fams) + ")"
    return f"case when {top} = 0 then 'general' " + " ".join(f"when s_{f} = {top} then '{f}'" for f in fams) + " end"


_HAZ = f"hz as (select *, {_hazard_case()} as hazard_type from (select *, {_family_scores()} from sv))"


@query("hazard_type", f"with {_N}, {_SEV}, {_HAZ} select analysis_id, hazard_type from hz")
def hazard_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives(spark, sf_dir).select("analysis_id", L.detect_hazard_type(F.col("text")).alias("hazard_type"))


def _industry_counts() -> str:
    return ", ".join(f"len(regexp_extract_all(text, '(?i)\\b(?:{'|'.join(re.escape(t).replace(chr(92) + ' ', ' ') for t in terms)})\\b')) as i_{name}" for name, terms in X.INDUSTRIES.items())


def _industry_case() -> str:
    names = list(X.INDUSTRIES)
    top = "list_max([" + ", ".join(f"i_{n}" for n in names) + "])"
    second = "list_reverse_sort([" + ", ".join(f"i_{n}" for n in names) + "])[2]"
    return f"case when {top} < 5 or {top} < {second} * 1.5 then 'unknown' " + " ".join(f"when i_{n} = {top} then '{n}'" for n in names) + " end"


@query("industry", f"with {_N}, c as (select analysis_id, {_industry_counts()} from n) select analysis_id, {_industry_case()} as industry from c")
def industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives(spark, sf_dir).select("analysis_id", L.detect_industry(F.col("text")).alias("industry"))


_PROBE_IN, _PROBE_REG = ["tion", "the", "re "], ["ment", "que", "der "]


@query("probe_class", f"with c as (select doc_id, {_count('lower(text[:20000])', _PROBE_IN)} as a, {_count('lower(text[:20000])', _PROBE_REG)} as b from documents) select doc_id, {_CLASS} as document_type from c")
def probe_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", L.classify_document(F.col("text"), incident=_PROBE_IN, regulatory=_PROBE_REG).alias("document_type"))


_ROUND2 = """((floor({x} * 100) + case when {x} * 100 - floor({x} * 100) > 0.5 or ({x} * 100 - floor({x} * 100) = 0.5 and ({e} > 0 or ({e} = 0 and floor({x} * 100)::bigint % 2 = 1))) then 1 else 0 end) / 100)"""


def _round2(x: str) -> str:
    hi = f"(({x}) * 134217729.0::double - (({x}) * 134217729.0::double - ({x})))"
    e = f"(({hi} * 100.0::double - ({x}) * 100.0::double) + (({x}) - {hi}) * 100.0::double)"
    return _ROUND2.format(x=f"(({x})::double)", e=e)


_CONF = "case when o_filled < 0 then 0 else o_filled end"


@query(
    "report_warnings",
    f"""with {_N}, p as (select analysis_id, text, {_count('lower(text)', X.INCIDENT_TERMS)} as a, {_count('lower(text)', X.REGULATORY_TERMS)} as b,
 ((coalesce(industry, '') <> '')::int + (analysis_id % 2 = 0)::int + 2)::double as filled, len(regexp_extract_all(text, '[^\\s]+')) as nw from n),
c as (select *, {_CLASS} as dt, {_round2("filled / 6.0::double * case when nw < 100 then 0.5::double else 1.0::double end")} as conf from p)
select analysis_id, conf as confidence, concat_ws('|', case when nw < 100 then concat('Document is only ', nw, ' words. Findings are low confidence.') end,
 case when dt <> 'incident' then concat('Document classified as ''', dt, '''; results may be thin.') end,
 case when conf < 0.5 then concat('Only ', round_even(conf * 100, 0)::int, '% of the incident schema could be filled from this document.') end) as warnings from c""",
)
def report_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = narratives(spark, sf_dir)
    date = F.when(F.col("analysis_id") % 2 == 0, F.date_format("created_at", "yyyy-MM-dd")).otherwise("")
    some, none = F.array(F.lit("press")), F.array().cast("array<string>")
    conf = L.extraction_confidence(date, F.lit(""), F.col("industry"), some, F.col("event"), none, F.col("text"))
    n = n.withColumn("confidence", conf)
    return n.select("analysis_id", "confidence", F.array_join(L.warnings(F.col("text"), L.classify_document(F.col("text")), F.col("confidence")), "|").alias("warnings"))


def _hits_sql(t: str) -> str:
    return "list_filter([" + ", ".join(f"case when {_has(t, kw)} then {i} end" for i, (_, _, _, kw) in enumerate(X.PRECURSORS)) + "], lambda x: x is not null)"


_FAMILY_OF = "[" + ", ".join(f"'{f}'" for f, *_ in X.PRECURSORS) + "]"
_MATCH = f"""hits as (select analysis_id, hazard_type, unnest({_hits_sql('lower(text)')}) as pattern_order from hz),
m as (select analysis_id, 0 as part, pattern_order from hits where {_FAMILY_OF}[pattern_order + 1] = hazard_type union all select analysis_id, 1, pattern_order from hits where {_FAMILY_OF}[pattern_order + 1] = 'general')"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.with_flags(narratives(spark, sf_dir))
    return S.settled(n, {"hazard_type": P.flagged_family(F.col("pattern_flags")), "severity": L.classify_severity(F.col("text"), F.col("injuries"), F.col("fatalities"))})


@query("precursors", f"with {_N}, {_SEV}, {_HAZ}, {_MATCH} select analysis_id, part, pattern_order::int as pattern_order from m")
def precursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.match_precursors(_reports(spark, sf_dir)).select("analysis_id", "part", "pattern_order")


@query(
    "document_labels",
    f"""with n as ({DOCUMENT_REPORTS}), {_SEV}, {_HAZ},
c as (select *, {_count('lower(text[:20000])', X.INCIDENT_TERMS)} as a, {_count('lower(text[:20000])', X.REGULATORY_TERMS)} as b, {_hits_sql('lower(text)')} as hits from hz)
select analysis_id as doc_id, {_CLASS} as document_type, severity, hazard_type, array_to_string(hits, ',') as patterns from c""",
)
def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label of whole documents."""
    text = F.col("text")
    return document_reports(spark, sf_dir).select(
        F.col("analysis_id").alias("doc_id"),
        L.classify_document(text).alias("document_type"),
        L.classify_severity(text, F.col("injuries"), F.col("fatalities")).alias("severity"),
        L.detect_hazard_type(text).alias("hazard_type"),
        F.array_join(P.pattern_hits(text), ",").alias("patterns"),
    )


#: Excerpts of history: the events of reports of neighbouring numbers.
_EXCERPTS = "ex as (select a.analysis_id, b.event as excerpt from n a join n b on b.analysis_id between a.analysis_id + 1 and a.analysis_id + 4)"


@query(
    "corroborate",
    f"""with {_N}, {_SEV}, {_HAZ}, {_MATCH}, {_EXCERPTS}, eh as (select analysis_id, unnest({_hits_sql('lower(excerpt)')}) as pattern_order from ex),
ev as (select analysis_id, pattern_order, count(*) as evidence from eh group by 1, 2),
j as (select m.*, coalesce(evidence, 0)::int as evidence_count from m left join ev using (analysis_id, pattern_order))
select analysis_id, pattern_order::int as pattern_order, part, evidence_count, round(least(0.55 + 0.1 * evidence_count, 0.95), 6)::double as confidence,
 (row_number() over (partition by analysis_id order by evidence_count desc, part, pattern_order) - 1)::int as place from j""",
)
def corroborate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = narratives(spark, sf_dir)
    step = F.explode(F.sequence(F.lit(1), F.lit(4)))
    excerpts = n.select(F.col("analysis_id").alias("b"), F.col("event").alias("excerpt"), step.alias("d")).select((F.col("b") - F.col("d")).alias("analysis_id"), "excerpt").join(n.select("analysis_id"), "analysis_id", "left_semi")
    out = P.corroborate(P.match_precursors(_reports(spark, sf_dir)), excerpts)
    return out.select("analysis_id", "pattern_order", "part", "evidence_count", F.round("confidence", 6).alias("confidence"), "place")


@query(
    "prevalence",
    f"""with {_N}, h as (select industry, unnest({_hits_sql('lower(text)')})::int as pattern_order from n)
select h.pattern_order, h.industry, count(*) as n_reports, round(count(*) / any_value(t.c), 9) as share, 0 as over_all from h join (select industry, count(*)::double as c from n group by 1) t on h.industry is not distinct from t.industry group by 1, 2
union all select pattern_order, null, count(*), round(count(*) / (select count(*)::double from n), 9), 1 from h group by 1""",
)
def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pattern_prevalence(narratives(spark, sf_dir)).withColumn("share", F.round("share", 9))


def _level_sql(name: str, source: str, n: str) -> str:
    """Reports by level with each pattern, and all of them, counted from the reports themselves."""
    return f"""{name}_n as ({source}), {name}_s as (select *, {_family_scores()} from {name}_n), {name}_h as (select industry, {_hazard_case()} as hazard_type, {_hits_sql('lower(text)')} as hits from {name}_s),
{name}_g as (select l.*, h.hits, case when by_industry = 1 then industry end as industry, case when by_hazard = 1 then hazard_type end as hazard_type from {name}_h h, (values (0, 0), (0, 1), (1, 0), (1, 1)) l(by_industry, by_hazard)),
{name}_t as (select by_industry, by_hazard, industry, hazard_type, count(*) as total from {name}_g group by all),
{name} as (select p.*, total as of_{n} from (select pattern_order, by_industry, by_hazard, industry, hazard_type, count(*) as n_{n} from (select unnest(hits)::int as pattern_order, * exclude (hits) from {name}_g) group by all) p
 join {name}_t t on t.by_industry = p.by_industry and t.by_hazard = p.by_hazard and t.industry is not distinct from p.industry and t.hazard_type is not distinct from p.hazard_type)"""


@query(
    "prevalence_levels",
    f"""with {_level_sql('a', NARRATIVES, 'reports')}, {_level_sql('b', CUSTOMER_NARRATIVES, 'corpus')},
j as (select coalesce(a.pattern_order, b.pattern_order) as pattern_order, coalesce(a.by_industry, b.by_industry) as by_industry, coalesce(a.by_hazard, b.by_hazard) as by_hazard, coalesce(a.industry, b.industry) as industry, coalesce(a.hazard_type, b.hazard_type) as hazard_type,
 coalesce(n_reports, 0) as n_reports, coalesce(of_reports, 0) as of_reports, coalesce(n_corpus, 0) as n_corpus, coalesce(of_corpus, 0) as of_corpus
 from a full join b on a.pattern_order = b.pattern_order and a.by_industry = b.by_industry and a.by_hazard = b.by_hazard and a.industry is not distinct from b.industry and a.hazard_type is not distinct from b.hazard_type)
select *, round(n_reports / nullif(of_reports, 0)::double, 9) as share, round(n_corpus / nullif(of_corpus, 0)::double, 9) as corpus_share, round((n_reports / nullif(of_reports, 0)::double) / (n_corpus / nullif(of_corpus, 0)::double), 6) as lift from j""",
)
def prevalence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports from orders against a corpus from customers."""
    labelled = [rows.withColumn("hazard_type", L.detect_hazard_type(F.col("text"))) for rows in (narratives(spark, sf_dir), customer_narratives(spark, sf_dir))]
    return P.prevalence_levels(*labelled).withColumns({"share": F.round("share", 9), "corpus_share": F.round("corpus_share", 9), "lift": F.round("lift", 6)})


_KNOWN = "case hazard_type " + " ".join(f"when '{f}' then {sum(g == f for g, *_ in X.PRECURSORS)}" for f in X.FAMILIES) + " end + 5"
_FAMS = list(X.CLAUSE_WEIGHTS)
#: Families that a report violates: as many as its number says, from a place that its customer says.
_VIOLATED = "list_transform(range(analysis_id % 4), lambda i: [" + ", ".join(f"'{f}'" for f in _FAMS) + f"][((custkey + i) % {len(_FAMS)})::int + 1])"
_WEIGHT = "case f " + " ".join(f"when '{f}' then {w}::double" for f, w in X.CLAUSE_WEIGHTS.items()) + " else 1.0::double end"
_SCORED = f"""cnt as (select analysis_id, count(*) as found from m group by 1),
base as (select hz.*, coalesce(found, 0) as found, {_KNOWN} as known, custkey % 30 as sim_docs, {_VIOLATED} as fams from hz left join cnt using (analysis_id)),
reg as (select analysis_id, least(sum({_WEIGHT}) * 1.2::double, 10.0::double) as r from (select analysis_id, unnest(fams) as f from base) group by 1),
raw as (select base.*, case severity when 'CRITICAL' then 9.5::double when 'HIGH' then 7.5::double when 'MEDIUM' then 5.0::double when 'LOW' then 2.5::double else 4.0::double end as sc,
 {_round2("least(sim_docs / 80::double * 25.0::double, 10.0::double)")} as fc, {_round2("coalesce(r, 0.0::double)")} as rc, {_round2("least(found / known::double * 10.0::double, 10.0::double)")} as pc
 from base left join reg using (analysis_id)),
scored as (select *, {_round2("0.30::double * sc + 0.25::double * fc + 0.25::double * rc + 0.20::double * pc")} as total from raw),
tiered as (select *, case when total >= 8 then 'CRITICAL' when total >= 6 then 'HIGH' when total >= 4 then 'MEDIUM' else 'LOW' end as tier from scored)"""


def scored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with hazard, severity, found patterns, violated families and the risk struct."""
    r = _reports(spark, sf_dir)
    names = F.array(*map(F.lit, _FAMS))
    n = F.col("analysis_id") % 4
    fams = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(names, ((F.col("custkey") + i) % len(_FAMS) + 1).cast("int")))).otherwise(F.array().cast("array<string>"))
    r = S.settled(r, {"found": P.flagged_count(F.col("pattern_flags"), F.col("hazard_type")).cast("long"), "known": P.known_precursor_count(F.col("hazard_type")), "similar": F.col("custkey") % 30, "fams": fams})
    return r.withColumn("risk", S.risk_score(F.col("severity"), F.col("similar"), F.lit(80), F.col("fams"), F.col("found"), F.col("known")))


@query("risk_score", f"with {_N}, {_SEV}, {_HAZ}, {_MATCH}, {_SCORED} select analysis_id, total, tier, sc as severity_part, fc as frequency_part, rc as regulatory_part, pc as precursor_part from tiered")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("risk.components")
    parts = [c[i]["score"].alias(n) for i, n in enumerate(["severity_part", "frequency_part", "regulatory_part", "precursor_part"])]
    return scored_reports(spark, sf_dir).select("analysis_id", "risk.total", "risk.tier", *parts)


@query(
    "risk_explanations",
    f"""with {_N}, {_SEV}, {_HAZ}, {_MATCH}, {_SCORED} select analysis_id,
 concat('Risk ', total, '/10 (', tier, '). Severity ', sc, 'x0.3. Frequency ', fc, 'x0.25. Regulatory ', rc, 'x0.25. Precursor Density ', pc, 'x0.2.') as explanation,
 concat_ws('|', concat('Classified ', severity, ' from the report outcome.'), concat(sim_docs, ' of 80 indexed historical documents matched.'),
 concat(len(fams), ' regulation families implicated: ', case when len(fams) > 0 then array_to_string(fams, ', ') else 'none' end, '.'), concat(found, ' of ', known, ' known precursors for this hazard type are present.')) as parts from tiered""",
)
def risk_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_reports(spark, sf_dir).select("analysis_id", "risk.explanation", F.array_join("risk.components.explanation", "|").alias("parts"))


@query("risk_tiers", f"with {_N}, {_SEV}, {_HAZ}, {_MATCH}, {_SCORED} select hazard_type, tier, count(*) as n_reports, min(total) as lowest, max(total) as highest from tiered group by 1, 2")
def risk_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scored_reports(spark, sf_dir)
    return r.groupBy("hazard_type", F.col("risk.tier").alias("tier")).agg(F.count("*").alias("n_reports"), F.min("risk.total").alias("lowest"), F.max("risk.total").alias("highest"))


@query("reconcile", f"with {_N}, {_SEV}, {_HAZ}, {_MATCH}, {_SCORED} select abs(total - (0.3::double * sc + 0.25::double * fc + 0.25::double * rc + 0.2::double * pc)) <= 0.01 as reconciles, count(*) as n_reports from tiered group by 1")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_reports(spark, sf_dir).groupBy(S.reconciles(F.col("risk")).alias("reconciles")).agg(F.count("*").alias("n_reports"))


@query("similar_documents", "select o_custkey as custkey, count(distinct case when o_orderkey % 11 <> 0 then o_clerk end) as n from (select o_custkey, o_orderkey, o_orderkey % 40 as o_clerk from orders) group by 1")
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    source = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 40)
    hits = orders.select(F.col("o_custkey").alias("analysis_id"), source.alias("source_document"))
    return similar_document_count(hits).select(F.col("analysis_id").alias("custkey"), F.col("n_similar").alias("n"))


@query(
    "search_texts",
    f"""with {_N}, {_SEV}, {_HAZ} select analysis_id, md5(case when analysis_id % 5 = 0 then text[:1000] else concat_ws(' ', event, cause, 'press') end) as incident_query,
 md5(concat_ws(' ', replace(hazard_type, '_', ' '), event, cause, 'press')) as regulatory_query from hz""",
)
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, none = _reports(spark, sf_dir), F.array().cast("array<string>")
    empty = F.col("analysis_id") % 5 == 0
    event, cause, tool = F.when(empty, "").otherwise(F.col("event")), F.when(empty, none).otherwise(F.array("cause")), F.when(empty, none).otherwise(F.array(F.lit("press")))
    return r.select("analysis_id", F.md5(L.incident_query(event, cause, tool, F.col("text"))).alias("incident_query"), F.md5(L.regulatory_query(F.col("hazard_type"), F.col("event"), F.array("cause"), F.array(F.lit("press")))).alias("regulatory_query"))
