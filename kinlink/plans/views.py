"""Record-linkage views of the test tables, as SQL that Spark and DuckDB both read.

``records``: every row of ``part`` as a record of one of three sources; names repeat
across sources, which gives twins and rivals. ``pairs``: every (supplier, part) of
``lineitem`` with a pseudo-probability and a label.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

RECORDS = """
select 'S' || cast(1 + p_partkey % 3 as string) || '-' || cast(p_partkey as string) as entity_id,
  p_name || case p_partkey % 4 when 0 then ' Pvt Ltd' when 1 then ', Inc.' when 2 then ' & Co' else ' W0rks' end as business_name,
  cast(p_size as string) || ' ' || p_type || ' Rd, ' || p_brand || ', No. 00' || cast(p_partkey % 7 as string) as business_address,
  case cast(floor(p_partkey / 3.0) as bigint) % 3 when 0 then 'US' when 1 then 'India' else 'France' end as country
from part
"""

PAIRS = """
select 'C' || cast(l_suppkey % 3 as string) as country, 'S1-' || cast(l_suppkey as string) as s1_id,
  'S' || cast(2 + l_partkey % 2 as string) || '-' || cast(l_partkey as string) as t_id,
  round(max(l_quantity) / 50.0, 4) as p, max(case when l_returnflag = 'R' then 1 else 0 end) as label
from lineitem group by l_suppkey, l_partkey
"""

ENTITIES = "select 'S1-' || cast(s_suppkey as string) as s1_id, 'C' || cast(s_suppkey % 3 as string) as country from supplier"


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run ``sql`` over the named tables of ``sf_dir``."""
    for t in tables:
        sql = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
