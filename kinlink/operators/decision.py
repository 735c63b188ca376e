"""From probabilities to matches, and their macro F0.5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_owner(df: DataFrame, p: str = "p") -> DataFrame:
    """Adds ``owner``: whether the row is its target's likeliest, ties by query id."""
    order = Window.partitionBy("country", "t_id").orderBy(F.desc(p), "s1_id")
    return df.withColumn("owner", F.row_number().over(order) == 1)


def decide(df: DataFrame, t: float = 0.5, t_top: float = 0.0, rel: float = 0.0, p: str = "p") -> DataFrame:
    """Adds ``matched``: owned, at least t, at least rel times the query's best owned row, which is at least t_top."""
    best = F.max(F.when(F.col("owner"), F.col(p))).over(Window.partitionBy("country", "s1_id"))
    df = df.withColumn("_best", best)
    rule = F.col("owner") & (F.col(p) >= F.lit(t)) & (F.col(p) >= F.lit(rel) * F.col("_best")) & (F.col("_best") >= F.lit(t_top))
    return df.withColumn("matched", F.coalesce(rule, F.lit(False))).drop("_best")


def f05(tp: Column, predicted: Column, true: Column) -> Column:
    """F0.5 of one entity; nothing predicted and nothing true is right."""
    precision, recall = tp / predicted, tp / true
    score = F.lit(1.25).cast("double") * precision * recall / (F.lit(0.25).cast("double") * precision + recall)
    return F.when((predicted == 0) & (true == 0), F.lit(1.0)).when(tp == 0, F.lit(0.0)).otherwise(score)


def entity_scores(entities: DataFrame, predicted: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("s1_id",)) -> DataFrame:
    """(keys, tp, npred, ntrue, f05) of every entity; ``predicted`` and ``truth`` hold (s1_id, t_id) pairs."""
    p = predicted.select("s1_id", "t_id").distinct().withColumn("_p", F.lit(1))
    t = truth.select("s1_id", "t_id").distinct().withColumn("_t", F.lit(1))
    both = p.join(t, ["s1_id", "t_id"], "full").groupBy("s1_id").agg(F.count(F.col("_p") + F.col("_t")).alias("tp"), F.count("_p").alias("npred"), F.count("_t").alias("ntrue"))
    out = entities.select(*keys).join(both, "s1_id", "left").fillna(0, ["tp", "npred", "ntrue"])
    return out.withColumn("f05", f05(F.col("tp"), F.col("npred"), F.col("ntrue")))


def macro(scores: DataFrame, *by: str) -> DataFrame:
    """Macro F0.5 over all entities, singletons and matched ones; without any of them 1 and 0."""
    return (scores.groupBy(*by) if by else scores).agg(
        F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"),
        F.coalesce(F.avg(F.when(F.col("ntrue") == 0, F.col("f05"))), F.lit(1.0)).alias("singleton_accuracy"),
        F.coalesce(F.avg(F.when(F.col("ntrue") > 0, F.col("f05"))), F.lit(0.0)).alias("matches_macro_f05"),
        F.count("*").alias("n_s1"),
    )


def grid() -> list[tuple[float, float, float]]:
    """Thresholds of the search: t from 0.20 by 0.04, t_top and rel from short lists; 0 < t_top < t is left out."""
    return [(round(0.2 + 0.04 * k, 2), top, rel) for k in range(18) for top in (0.0, 0.5, 0.6, 0.7, 0.8, 0.9) for rel in (0.0, 0.3, 0.5, 0.7) if not 0 < top < round(0.2 + 0.04 * k, 2)]


def search(pairs: DataFrame, entities: DataFrame, points: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """(t, t_top, rel, macro_f05) of every grid point, in one pass.

    ``pairs`` has country, s1_id, t_id, p, label; ``entities`` s1_id and n_true. Rows of an
    entity that can count under no point are dropped first, then each entity's owned rows
    meet the points within the row (a constant array), so nothing is crossed.
    """
    points = points or grid()
    at = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(top)).alias("t_top"), F.lit(float(rel)).alias("rel")) for t, top, rel in points])
    owned = one_owner(pairs).filter("owner").groupBy("s1_id").agg(F.collect_list(F.struct("p", "label")).alias("rows"), F.max("p").alias("best"))
    both = entities.join(owned, "s1_id", "left")

    def scored(x: Column) -> Column:
        rows = F.coalesce(F.filter("rows", lambda r: (r["p"] >= x["t"]) & (r["p"] >= x["rel"] * F.col("best")) & (F.col("best") >= x["t_top"])), F.array().cast("array<struct<p:double,label:int>>"))
        tp = F.aggregate(rows, F.lit(0), lambda a, r: a + r["label"])
        return F.struct(x["t"].alias("t"), x["t_top"].alias("t_top"), x["rel"].alias("rel"), f05(tp, F.size(rows), F.col("n_true")).alias("f"))

    return both.select(F.inline(F.transform(at, scored))).groupBy("t", "t_top", "rel").agg(F.avg("f").alias("macro_f05"))


def best_point(searched: DataFrame) -> tuple[float, float, float]:
    """The best grid point; ties go to the smallest thresholds."""
    row = searched.orderBy(F.desc("macro_f05"), "t", "t_top", "rel").first()
    return row["t"], row["t_top"], row["rel"]
