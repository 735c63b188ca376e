"""Deterministic samples: everything is decided by hashes of ids, so reruns and any partitioning agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1): the first 32 bits of the MD5 of the seed and the columns, which any engine can tell."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *columns).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def stratified(df: DataFrame, n: int, by: str = "country", id_col: str = "entity_id", seed: int = 0) -> DataFrame:
    """About n rows, the same share of every stratum (rounded up), those with the smallest hashes.

    No stratum gives more than n rows, so a group limit before the shuffle keeps n of each.
    """
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())
    quota = sizes.withColumn("_q", F.ceil(F.col("_n") * F.least(F.lit(1.0), F.lit(float(n)) / total))).drop("_n")
    place = F.row_number().over(Window.partitionBy(by).orderBy(unit(id_col, seed=seed), id_col))
    first = df.withColumn("_k", place).filter(F.col("_k") <= n)
    return first.join(quota, by).filter(F.col("_k") <= F.col("_q")).drop("_k", "_q")


def drop_rivals(s1: DataFrame, sampled: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """All sampled records, and the others without a random share of them."""
    kept = sampled.select("entity_id").withColumn("_s", F.lit(1))
    return s1.join(kept, "entity_id", "left").filter(F.col("_s").isNotNull() | (unit("entity_id", seed=seed) >= share)).drop("_s")


def sampled_dataset(s1: DataFrame, pool: DataFrame, truth: DataFrame, n: int, distractors: float = 0.03, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(S1, pool, truth pairs): sampled queries, all their targets and a share of the other pool records."""
    chosen = stratified(s1, n, seed=seed)
    pairs = truth.join(chosen.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    needed = pairs.select(F.col("t_id").alias("entity_id")).distinct()
    others = pool.join(needed, "entity_id", "left_anti").filter(unit("entity_id", seed=seed) < distractors)
    return chosen, pool.join(needed, "entity_id", "left_semi").unionByName(others), pairs
