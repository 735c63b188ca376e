"""Reading and writing of record tables and id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
#: Texts that count as missing in source tables.
NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_records(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A tab-separated record table, all strings, usual missing markers as null; pruned and bounded if asked for."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", schema=RECORD)
    df = df.select(*[F.when(~F.col(c).isin(*NA), F.col(c)).alias(c) for c in (columns or df.columns)])
    return df.limit(limit) if limit is not None else df


def id_list(text: Column) -> Column:
    """Trimmed, non-blank ids of a comma-joined list; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != "")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, ids) of a ground-truth table; an empty list is a singleton."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", schema=TRUTH)
    return df.select(F.col("source1_entity_id").alias("s1_id"), id_list(F.col("matched_entity_ids")).alias("ids"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1_id, t_id) pairs of (s1_id, ids)."""
    return truth.select("s1_id", F.explode("ids").alias("t_id"))


def uncovered(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """S1 ids that the ground truth leaves out."""
    return s1.select(F.col("entity_id").alias("s1_id")).join(truth.select("s1_id"), "s1_id", "left_anti")


def repeated(truth: DataFrame) -> DataFrame:
    """(s1_id, n) that occur more than once."""
    return truth.groupBy("s1_id").agg(F.count("*").alias("n")).filter("n > 1")


def pools(s2: DataFrame, s3: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """The pool of all targets; ``country`` stays a join key, so nothing loops over countries."""
    both = s2.unionByName(s3)
    return both.filter(F.col("country").isin(*countries)) if countries else both


def one_row_each(s1: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """(source1_entity_id, list) with exactly one row for each S1 record, empty where nothing matched, ids sorted."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("t_id")), ",").alias(column))
    ids = s1.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    return ids.join(lists, F.col("source1_entity_id") == F.col("s1_id"), "left").select("source1_entity_id", F.coalesce(column, F.lit("")).alias(column))


def write_lists(lists: DataFrame, path: str, order: DataFrame | None = None, single_file: bool = False) -> None:
    """Tab-separated with header; in the order of ``order`` (source1_entity_id, position) if given. One file only at the edge."""
    if order is not None:
        lists = lists.join(order, "source1_entity_id").orderBy("position").select(*lists.columns)
    if single_file:
        lists = lists.coalesce(1)
    lists.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def markdown_rows(report: DataFrame, name: str) -> list[str]:
    """A Markdown table row for each scope of a report (driver-side text)."""
    rows = report.orderBy(F.col("country").asc_nulls_last()).collect()
    return [f"| {name} | {r['country'] or 'ALL'} | {r['n_s1']} | {r['macro_f05']:.4f} | {r['singleton_accuracy']:.4f} | {r['matches_macro_f05']:.4f} | {r['recall_ceiling'] or 0:.2%} | {r['avg_candidates']:.1f} |" for r in rows]
