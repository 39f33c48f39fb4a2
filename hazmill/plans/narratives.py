"""Reports in safety wording, made from orders by one statement that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EVENTS = [
    "The employee was clearing a jam on the conveyor when a co-worker restarted the machine.",
    "During maintenance the crew worked without locking out the press and energy not isolated.",
    "An entrant went into the storage tank; the atmosphere was not tested and no attendant was posted.",
    "A roofer who was not tied off fell from the scaffold near an unprotected edge.",
    "Corrosion had thinned the pipe, the relief valve was plugged and ammonia escaped from the reactor.",
    "Combustible dust from the grinder ignited; the sprinkler was out of service.",
    "An electrician worked on energized parts of the circuit breaker without face shield and arc flash followed.",
    "A forklift backing into a blind corner struck a pedestrian; no spotter was present.",
    "Welding began with no hot work permit and the fire watch left the area.",
    "The rack was overloaded, leaning and toppled on the loading dock of the warehouse.",
    "29 CFR 1910.147 applies: the employer shall be responsible under this subpart and regulation.",
    "The team met to plan the picnic and nothing else happened.",
    "The hoist carried a suspended load over workers; the damaged hook was not inspected.",
]
_OUTCOMES = [
    "He died at the scene.",
    "No fatalities or injuries occurred, a near miss.",
    "Two workers were hospitalized with burn injuries.",
    "One operator suffered a laceration and lost time.",
    "There was property damage only.",
    "The outcome is not stated.",
    "Without serious injuries, but the tank ruptured; catastrophic loss.",
    "An amputation of two fingers followed.",
    "Zero reported deaths; a fracture was treated.",
    "Nobody was hurt.",
    "Death was confirmed; the victim was pronounced dead.",
]
_CAUSES = [
    "The investigation found the root cause: the worker had not been trained, no training records exist.",
    "A previously cited known issue was ignored under time pressure.",
    "The guard removed from the unguarded mixer was never refitted; poor housekeeping and a spill.",
    "Operators did not follow the procedure and bypassed the interlock defeated weeks before.",
    "Chemical feedstock in the chemical reactor of the refinery; the chemical process unit and polymer catalyst line.",
    "The warehouse forklift, warehouse pallet rack and distribution center loading dock were reviewed.",
    "Inadequate supervision: left alone, the new employee used an unstable ladder.",
]

_case = lambda key, texts: f"case {key} % {len(texts)} " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(texts)) + " end"

#: analysis_id, text, industry, injuries, fatalities, cause, event, created_at, file_name
NARRATIVES = f"""select o_orderkey as analysis_id, concat({_case('o_orderkey', _EVENTS)}, ' ', {_case('o_custkey', _OUTCOMES)}, ' ', {_case('(o_orderkey + o_custkey)', _CAUSES)}) as text,
 case o_custkey % 5 when 0 then 'chemical' when 1 then 'warehousing' when 2 then 'construction' when 3 then '' else null end as industry,
 case when o_orderkey % 7 = 0 then o_custkey % 5 else 0 end as injuries, case when o_orderkey % 101 = 0 then 1 else 0 end as fatalities,
 {_case('o_orderkey', _EVENTS)} as event, {_case('(o_orderkey + o_custkey)', _CAUSES)} as cause,
 o_custkey as custkey, o_orderdate as created_at, concat('report_', o_orderkey, '.pdf') as file_name from orders"""


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("hazmill_orders")
    return spark.sql(NARRATIVES.replace("from orders", "from hazmill_orders"))


#: The same over customers.
CUSTOMER_NARRATIVES = NARRATIVES.replace("from orders", "from (select c_custkey as o_orderkey, cast(c_nationkey as bigint) as o_custkey, timestamp '2024-01-01' as o_orderdate from customer)")


def customer_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same wording over customers: a smaller corpus."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("hazmill_customers")
    rows = "from (select c_custkey as o_orderkey, cast(c_nationkey as bigint) as o_custkey, timestamp '2024-01-01' as o_orderdate from hazmill_customers)"
    return spark.sql(NARRATIVES.replace("from orders", rows))


#: Documents as reports: their whole text and, after it, a report in safety wording, so that what is looked for may stand after any number of words.
DOCUMENT_REPORTS = f"""select r.analysis_id, concat(coalesce(d.text, ''), ' ', r.text) as text, r.industry, r.injuries, r.fatalities from documents d
 join ({NARRATIVES.replace('from orders', "from (select doc_id as o_orderkey, n_chars as o_custkey, timestamp '2024-01-01' as o_orderdate from documents)")}) r on r.analysis_id = d.doc_id"""


def document_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("hazmill_documents")
    return spark.sql(DOCUMENT_REPORTS.replace("from documents", "from hazmill_documents"))
