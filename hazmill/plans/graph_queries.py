"""Queries over entities of reports and over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.operators import entities as N
from hazmill.operators import graph as G
from hazmill.plans.narratives import NARRATIVES, narratives
from hazmill.plans.registry import query, table
from hazmill.sources.shared import checkpointed

_PHRASES = "(values " + ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in N.phrases().items()) + ") as ph(phrase, size, label)"
_ENT = f"""tk as (select analysis_id, regexp_extract_all(text[:12000], '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]') as t from n),
fl as (select analysis_id, unnest(t) as w, generate_subscripts(t, 1) - 1 as start from tk),
nx as (select *, lead(w, 1) over d as w2, lead(w, 2) over d as w3 from fl window d as (partition by analysis_id order by start)),
gr as (select analysis_id, start, 1 as size, w as g from nx union all select analysis_id, start, 2, w || ' ' || w2 from nx where w2 is not null union all select analysis_id, start, 3, w || ' ' || w2 || ' ' || w3 from nx where w3 is not null),
ht as (select analysis_id, start, gr.size, g, label from gr join {_PHRASES} on lower(g) = phrase and gr.size = ph.size),
kp as (select * from ht a where not exists (select 1 from ht b where b.analysis_id = a.analysis_id and b.start < a.start + a.size and a.start < b.start + b.size and (b.size > a.size or (b.size = a.size and b.start < a.start)))),
on1 as (select *, row_number() over (partition by analysis_id, lower(g) order by start) as k from kp),
ent as (select analysis_id, (row_number() over (partition by analysis_id order by start) - 1)::int as place, g as text, label as entity_type from on1 where k = 1)"""


@query("entities", f"with n as ({NARRATIVES}), {_ENT} select *, 0.9::double as confidence from ent where place < 40")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.dictionary_entities(narratives(spark, sf_dir)).select("analysis_id", "place", "text", "entity_type", "confidence")


_PROPOSED = "pr as (select analysis_id, (analysis_id % 3)::int as place, case analysis_id % 4 when 0 then ' machine ' when 1 then 'laser beam' when 2 then 'conveyor' else 'worker' end as text from n)"


@query(
    "merge_proposals",
    f"""with n as ({NARRATIVES}), {_ENT}, {_PROPOSED},
c as (select analysis_id, count(*) as k from ent group by 1),
nw as (select pr.analysis_id, trim(pr.text) as text, (coalesce(k, 0))::int as place from pr join n using (analysis_id) left join c using (analysis_id)
 where contains(lower(n.text), lower(trim(pr.text))) and not exists (select 1 from ent where ent.analysis_id = pr.analysis_id and lower(ent.text) = lower(trim(pr.text))))
select analysis_id, place, text, entity_type, 0.9::double as confidence from ent union all select analysis_id, place, text, 'CONDITION', 0.75 from nw""",
)
def merge_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = narratives(spark, sf_dir)
    k = F.col("analysis_id") % 4
    proposed = n.select("analysis_id", (F.col("analysis_id") % 3).cast("int").alias("place"), F.when(k == 0, " machine ").when(k == 1, "laser beam").when(k == 2, "conveyor").otherwise("worker").alias("text"), F.lit("CONDITION").alias("entity_type"))
    return N.merge_discovered(N.dictionary_entities(n), proposed, n).select("analysis_id", "place", "text", "entity_type", "confidence")


@query(
    "verify_entities",
    "with e as (select p_partkey as analysis_id, p_name as text, case p_size % 4 when 0 then 'PRODUCT' when 1 then 'HAZARD' when 2 then 'FAC' else 'DATE' end as label from part) select analysis_id, text, case when label = 'HAZARD' then 'HAZARD' else 'EQUIPMENT' end as entity_type from e where label = 'HAZARD' or (label in ('PRODUCT', 'FAC') and analysis_id % 3 = 0)",
)
def verify_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("analysis_id"), F.lit(0).alias("place"), F.col("p_name").alias("text"), F.when(k == 0, "PRODUCT").when(k == 1, "HAZARD").when(k == 2, "FAC").otherwise("DATE").alias("label"))
    verdicts = rows.where("analysis_id % 3 = 0").select("analysis_id", F.upper("text").alias("text"))
    return N.verify_entities(N.statistical_entities(rows), verdicts).select("analysis_id", "text", "entity_type")


def incident_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = narratives(spark, sf_dir)
    docs = n.select(F.col("analysis_id").alias("doc_id"), F.col("file_name").alias("title"), F.coalesce("industry", F.lit("unknown")).alias("industry"), F.lit("UNKNOWN").alias("severity"))
    found = checkpointed(N.dictionary_entities(n).withColumnRenamed("analysis_id", "doc_id"))
    return docs, found, n


_GRAPH = f"""{_ENT},
us as (select 'incident:' || analysis_id as src, case entity_type when 'EQUIPMENT' then 'equipment:' when 'HAZARD' then 'hazard:' else 'cause:' end || lower(text) as dst, case when entity_type in ('EQUIPMENT', 'HAZARD') then 'INVOLVED' else 'CAUSED_BY' end as relation from ent where entity_type <> 'CHEMICAL'),
ed as (select distinct * from us union select distinct 'hazard:' || lower(h.text), 'condition:' || lower(c.text), 'PRECEDED_BY' from ent h join ent c using (analysis_id) where h.entity_type = 'HAZARD' and c.entity_type = 'CONDITION')"""


@query("graph_edges", f"with n as ({NARRATIVES}), {_GRAPH} select src, dst, relation from ed")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found, _ = incident_graph(spark, sf_dir)
    return G.build_graph(docs, found)[1].select("src", "dst", "relation")


@query("graph_nodes", f"with n as ({NARRATIVES}), {_GRAPH} select 'incident:' || analysis_id as node_id, 'incident' as node_type from n union all select distinct dst, split_part(dst, ':', 1) from us")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found, _ = incident_graph(spark, sf_dir)
    return G.build_graph(docs, found)[0].select("node_id", "node_type")


@query("graph_counts", f"with n as ({NARRATIVES}), {_GRAPH} select (select count(*) from n) + (select count(distinct dst) from us) as n_nodes, count(*) as n_edges from ed")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found, _ = incident_graph(spark, sf_dir)
    return G.graph_counts(*G.build_graph(docs, found))


#: Customers hang on the customer of half their number and on their nation, nations on regions.
_TREE = """ed as (select 'c' || c_custkey as src, 'c' || (c_custkey // 2) as dst, 'CAUSED_BY' as relation, 0 as edge_seq from customer where c_custkey > 0
 union all select 'c' || c_custkey, 'n' || c_nationkey, case when c_custkey % 2 = 0 then 'PRECEDED_BY' else 'INVOLVED' end, 1 from customer union all select 'n' || n_nationkey, 'r' || n_regionkey, 'CAUSED_BY', 0 from nation)"""


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    name = lambda p, col: F.concat(F.lit(p), col.cast("long").cast("string"))
    key = F.col("c_custkey")
    up = c.where("c_custkey > 0").select(name("c", key).alias("src"), name("c", F.floor(key / 2)).alias("dst"), F.lit("CAUSED_BY").alias("relation"), F.lit(0).alias("edge_seq"))
    out = c.select(name("c", key).alias("src"), name("n", F.col("c_nationkey")).alias("dst"), F.when(key % 2 == 0, "PRECEDED_BY").otherwise("INVOLVED").alias("relation"), F.lit(1).alias("edge_seq"))
    top = n.select(name("n", F.col("n_nationkey")).alias("src"), name("r", F.col("n_regionkey")).alias("dst"), F.lit("CAUSED_BY").alias("relation"), F.lit(0).alias("edge_seq"))
    return up.unionByName(out).unionByName(top)


@query(
    "precursor_chain",
    f"""with recursive {_TREE}, ca as (select src, dst from ed where relation in ('CAUSED_BY', 'PRECEDED_BY')),
w as (select 'c' || c_custkey as start, 'c' || c_custkey as node_id, 0 as depth from customer where c_custkey % 50 = 0 union select start, dst, depth + 1 from w join ca on src = node_id where depth < 6)
select start, node_id, min(depth)::int as depth from w group by 1, 2 having min(depth) > 0""",
)
def precursor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"))
    return G.precursor_chain(tree_edges(spark, sf_dir), starts).select("start", "node_id", "depth")


@query("degree", f"with {_TREE}, d as (select src as node_id, 0 as i, 1 as o from ed union all select dst, 1, 0 from ed) select node_id, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree, sum(i) + sum(o) >= 8 as is_hub from d group by 1")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree_stats(tree_edges(spark, sf_dir))


@query("layer_violations", f"with {_TREE}, r as (select 'c' || c_custkey as node_id, c_custkey % 7 as rank from customer) select src, dst, a.rank as src_rank, b.rank as dst_rank from ed join r a on a.node_id = src join r b on b.node_id = dst where b.rank > a.rank")
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), (F.col("c_custkey") % 7).alias("rank"))
    return G.layer_violations(tree_edges(spark, sf_dir), ranks)


@query(
    "weighted_edges",
    "with r as (select l_suppkey as src, l_partkey % 50 as dst, l_shipmode as kind, l_discount * 10 as confidence from (select *, l_returnflag || l_linestatus as l_shipmode from lineitem)) select src, dst, count(*) as weight, array_to_string(list_sort(list(distinct kind)), ',') as kinds from r where confidence >= 0.3 and src <> dst and exists (select 1 from supplier where s_suppkey = src and s_nationkey = dst % 25) group by 1, 2",
)
def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.concat("l_returnflag", "l_linestatus").alias("kind"), (F.col("l_discount") * 10).alias("confidence"))
    gate = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.explode(F.array(F.col("s_nationkey").cast("long"), F.col("s_nationkey").cast("long") + 25)).alias("dst"))
    return G.weighted_edges(refs, gate, 0.3).select("src", "dst", "weight", F.array_join("kinds", ",").alias("kinds"))


@query(
    "causal_chain",
    f"""with n as ({NARRATIVES}), {_GRAPH}, hz as (select analysis_id, place, lower(text) as h from ent where entity_type = 'HAZARD'),
cs as (select distinct split_part(src, ':', 2) as h, dst as label from ed where relation = 'PRECEDED_BY'),
ev as (select analysis_id, 'cause' as node_type, cause as label, 'CAUSED_BY' as relation from n union select distinct hz.analysis_id, 'unknown', cs.label, 'PRECEDED_BY' from hz join cs using (h))
select analysis_id, label, node_type, relation from ev""",
)
def causal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found, n = incident_graph(spark, sf_dir)
    nodes, edges = G.build_graph(docs, found)
    reports = n.select("analysis_id", F.array("cause").alias("causes"), F.array(F.lit("press")).alias("equipment"))
    chain = G.causal_chain(reports, found.withColumnRenamed("doc_id", "analysis_id"), nodes, edges)
    return chain.select("analysis_id", "label", "node_type", "relation")
