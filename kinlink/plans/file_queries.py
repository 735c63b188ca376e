"""Queries of file sources, sinks and the checks of submitted lists.

Each writes its files to the shared folder, with missing markers, blanks, repeated and
malformed lines planted, and reads them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink.operators import validation
from kinlink.plans.decision_queries import DECIDED, decided, entities, score_report
from kinlink.plans.registry import SQL, query
from kinlink.plans.text_queries import RECORDS
from kinlink.plans.views import ENTITIES, view
from kinlink.sources import tables
from kinlink.sources.shared import scratch_path

GAPS = f"select entity_id, case when p % 5 = 0 then 'N/A' else business_name end as business_name, case when p % 7 = 0 then '' else business_address end as business_address, country from (select *, cast(split_part(entity_id, '-', 2) as bigint) as p from ({RECORDS}) r0) r1"
READ = f"(select entity_id, nullif(business_name, 'N/A') as business_name, nullif(business_address, '') as business_address, country from ({GAPS}) g)"


def tsv(spark, sf_dir) -> str:
    """Path of the records with gaps, written as a tab-separated table."""
    path = scratch_path(spark, "records.tsv")
    view(spark, sf_dir, GAPS, "part").write.csv(path, sep="\t", header=True, quote="", emptyValue="")
    return path


@query("tsv_records", f"select * from {READ} r")
def tsv_records(spark, sf_dir):
    return tables.read_records(spark, tsv(spark, sf_dir))


@query("tsv_pruned", f"select country, count(*) as n, count(business_name) as named from {READ} r group by country")
def tsv_pruned(spark, sf_dir):
    """A scan of two columns."""
    df = tables.read_records(spark, tsv(spark, sf_dir), ["country", "business_name"])
    return df.groupBy("country").agg(F.count("*").alias("n"), F.count("business_name").alias("named"))


@query("tsv_bounded", f"select least(count(*), 150) as n, least(count(distinct entity_id), 150) as ids from {READ} r")
def tsv_bounded(spark, sf_dir):
    """A bounded scan: which rows it gives is open, how many is not."""
    return tables.read_records(spark, tsv(spark, sf_dir), ["entity_id"], 150).agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("ids"))


@query("country_pools", f"select entity_id, country from {READ} r where entity_id not like 'S1-%' and country in ('US', 'India')")
def country_pools(spark, sf_dir):
    df = tables.read_records(spark, tsv(spark, sf_dir))
    s2, s3 = (df.filter(F.startswith("entity_id", F.lit(s))) for s in ("S2-", "S3-"))
    return tables.pools(s2, s3, ["US", "India"]).select("entity_id", "country")


def lists(spark, sf_dir):
    """(source1_entity_id, matched_entity_ids), one row for each entity."""
    s1 = entities(spark, sf_dir).withColumnRenamed("s1_id", "entity_id")
    return tables.one_row_each(s1, decided(spark, sf_dir).filter("matched"))


@query("truth_file", f"select s1_id, t_id from {DECIDED} d where matched")
def truth_file(spark, sf_dir):
    """Lists with blanks around their ids and an empty id at the end, read back as pairs."""
    path = scratch_path(spark, "truth.tsv")
    loose = lists(spark, sf_dir).withColumn("matched_entity_ids", F.concat(F.replace("matched_entity_ids", F.lit(","), F.lit(" , ")), F.lit(", ")))
    tables.write_lists(loose, path)
    return tables.truth_pairs(tables.read_truth(spark, path))


@query("lists_in_order", f"select row_number() over (order by s1_id desc) - 1 as place, s1_id from ({ENTITIES}) e")
def lists_in_order(spark, sf_dir):
    """One file whose lines follow a given order, here the ids from the last to the first."""
    path = scratch_path(spark, "lists.tsv")
    rows = lists(spark, sf_dir)
    # the key of the order sorts as the ids do, from the last to the first
    order = rows.select("source1_entity_id", F.translate("source1_entity_id", "0123456789", "9876543210").alias("position"))
    width = rows.agg(F.max(F.length("source1_entity_id"))).scalar()
    tables.write_lists(rows, path, order.withColumn("position", F.rpad("position", width, "~")), single_file=True)
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.slice(F.split(F.rtrim("value", F.lit("\n")), "\n"), 2, 2**31 - 1)).alias("place", "line")).select(F.col("place").cast("long"), F.split_part("line", F.lit("\t"), F.lit(1)).alias("s1_id"))


@query("metrics_file", SQL["score_report"])
def metrics_file(spark, sf_dir):
    path = scratch_path(spark, "metrics.json")
    report = score_report(spark, sf_dir)
    tables.write_metrics(report, path)
    return spark.read.schema(report.schema).json(path)


RAW = f"""(select s1_id || case when k % 9 = 0 then ' ' else chr(9) end || coalesce(ids, '') as value, k from (select e.s1_id, cast(substr(e.s1_id, 4) as bigint) as k, ids from ({ENTITIES}) e left join
  (select s1_id, string_agg(case when t_id like '%7' then 'S1-7' when t_id like '%8' then 'P' || t_id else t_id end, ' ,' order by t_id) as ids from {DECIDED} d where matched group by 1) l on l.s1_id = e.s1_id) x)"""


@query(
    "validate_lines",
    f"""with raw as materialized (select value, k from {RAW} a union all select value, k from {RAW} b where k % 9 = 1),
    good as materialized (select split_part(value, chr(9), 1) as s1_id, list_filter(list_transform(string_split(split_part(value, chr(9), 2), ','), lambda c: trim(c)), lambda c: c <> '') as ids from raw where k % 9 <> 0),
    flat as (select s1_id, unnest(ids) as id from good)
    select distinct 'malformed' as rule, cast(null as varchar) as s1_id from raw where k % 9 = 0 union all select 'duplicate_row', s1_id from good group by s1_id having count(*) > 1
    union all select distinct 'duplicate_id', s1_id from good where len(ids) <> len(list_distinct(ids)) union all select distinct 'self_match', s1_id from flat where id like 'S1-%'
    union all select distinct 'wrong_prefix', s1_id from flat where id like 'P%' union all select s.rule, s.s1_id from (select 'missing_s1' as rule, s1_id from ({ENTITIES}) e where s1_id not in (select s1_id from good)) s""",
)
def validate_lines(spark, sf_dir):
    """Raw lines: every ninth entity without a tab, the next one twice, some ids of S1 and some of no source."""
    t = F.col("t_id")
    planted = F.when(F.endswith("t_id", F.lit("7")), "S1-7").when(F.endswith("t_id", F.lit("8")), F.concat(F.lit("P"), t)).otherwise(t)
    of = decided(spark, sf_dir).filter("matched").groupBy("s1_id").agg(F.array_join(F.collect_list(planted), " ,").alias("ids"))
    k = F.substring("s1_id", 4, 20).cast("long")
    rows = entities(spark, sf_dir).join(of, "s1_id", "left").withColumn("k", k)
    rows = rows.select(F.concat("s1_id", F.when(F.col("k") % 9 == 0, " ").otherwise("\t"), F.coalesce("ids", F.lit(""))).alias("value"), "k")
    path = scratch_path(spark, "lines")
    rows.union(rows.filter("k % 9 = 1")).select("value").write.text(path)
    return validation.issues(validation.parsed(spark.read.text(path)), entities(spark, sf_dir))
