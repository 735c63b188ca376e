"""Mixing sources to target weights by Sainte-Laguë apportionment.

Method. Targets: sources in code-point order (null last) weigh WEIGHTS in turn
and share EPOCHS of all words; a target stops at CAP times its source's size and
the excess is shared again by weight. Blocks of BLOCK words are then allotted to
sources by the highest quotients target / (2k + 1), and each source's words to
groups of its shards and on to the shards by the highest quotients of their sizes,
which gives integer quotas. A shard holds about SHARD_DOCS documents (so a hot source
has many), laid end to end in seeded order; its quota is whole passes over the shard
plus one run of consecutive blocks that starts at a seeded block. A document's share
of that run is plain arithmetic on its offset.

Scale. Sources may be as many as documents: they stay a table, ranked by a sort and
the counts of its partitions; the driver sees sums over them. The level that stops
targets rises by one aggregate a round, and the factor of the quotients is narrowed
by aggregates at PROBES factors at a time, until the seats that are left are few and
go to the highest quotients exactly. Shards of a source are apportioned in groups of
GROUP_SHARDS, so no task holds all shards of a hot source. Texts move once, if at all.

Edge cases: null and empty texts have size 0 and are never taken; a source of
size 0 has target 0; null sources form one source; null ids and repeated rows
are spread and ordered by id and size, equal rows being interchangeable; an empty
table gives an empty result. Reruns agree: nothing depends on row order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.text import carried, unpacked, words_of
from kinlink.sources.shared import materialize

WEIGHTS = (3, 1, 2)
EPOCHS = 1.5
CAP = 2
BLOCK = 16
SHARD_DOCS = 4_096
#: Shards that are apportioned together.
GROUP_SHARDS = 1_024
#: Factors that one aggregate tries, and seats that are few enough to be ranked one by one.
PROBES, FEW = 24, 1_000
SEED = "mix-1"


def sainte_lague(weights: np.ndarray, seats: int) -> np.ndarray:
    """Integer seats by the highest quotients weight / (2k + 1); ties go to the earlier entry."""
    w = np.asarray(weights, dtype=np.float64)
    out = np.zeros(len(w), dtype=np.int64)
    if seats <= 0 or not (w > 0).any():
        return out
    low, high = 0.0, float(seats / w.sum() * 2 + 1 / w[w > 0].min())
    for _ in range(200):  # the largest factor that gives no more seats than there are
        mid = (low + high) / 2
        low, high = (mid, high) if np.floor(w * mid + 0.5).sum() <= seats else (low, mid)
    out = np.floor(w * low + 0.5).astype(np.int64)
    rest = int(seats - out.sum())
    if rest > 0:
        quotient = w / (2 * out + 1)
        for i in np.lexsort((np.arange(len(w)), -quotient))[:rest]:
            out[i] += 1
        # several seats for one entry among the rest are possible only on ties of the factor
    return out


def shared_out(sizes: np.ndarray, words: int) -> np.ndarray:
    """Words for each entry: whole blocks by the highest quotients, none above CAP times its size;
    what is left goes to the first entries with room."""
    sizes = np.asarray(sizes, np.int64)
    most = CAP * sizes
    out = np.minimum(sainte_lague(sizes, words // BLOCK) * BLOCK, most)
    room = most - out
    return out + np.clip(words - out.sum() - np.r_[0, np.cumsum(room)[:-1]], 0, room)


def targets(totals: DataFrame, scope: str = "default") -> tuple[DataFrame, float]:
    """(_source, source_size, docs, rank, target) of every source, and the sum of the targets.

    totals: (_source, source_size, docs).
    """
    by_name = totals.orderBy(F.col("_source").isNull(), "_source").withColumn("_place", F.monotonically_increasing_id())
    by_name = materialize(by_name, "sources", scope)
    part = F.shiftright("_place", 33)
    counts = dict(by_name.groupBy(part.cast("int").alias("p")).count().collect())  # one row a partition
    before = np.cumsum([0, *(counts.get(k, 0) for k in range(max(counts, default=0) + 1))]).tolist()
    rank = F.get(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), part.cast("int")) + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS)).cast("int"))
    df = by_name.withColumn("rank", rank).withColumns({"_weight": weight, "_most": (CAP * F.col("source_size")).cast("double")}).drop("_place")
    words, weights, most = (x or 0 for x in df.agg(F.sum("source_size"), F.sum("_weight"), F.sum("_most")).first())
    left, total, closed = EPOCHS * words, weights, 0
    while total:  # the level left / total only rises, so a source that stops stays so
        full = F.lit(left) * F.col("_weight") / F.lit(total) > F.col("_most")
        n, stopped, gone = (x or 0 for x in df.agg(F.sum(full.cast("bigint")), F.sum(F.when(full, F.col("_most"))), F.sum(F.when(full, F.col("_weight")))).first())
        if n == closed:
            break
        left, total, closed = EPOCHS * words - stopped, weights - gone, n
    share = F.lit(left) * F.col("_weight") / F.lit(total) if total else F.col("_most")
    df = df.withColumn("target", F.least(share, F.col("_most"))).drop("_weight", "_most")
    return df, float(EPOCHS * words if total else most)


def source_blocks(goals: DataFrame, total: float) -> DataFrame:
    """``goals`` with ``_blocks``: blocks of each source by the highest quotients of (target, rank)."""
    seats, n = int(total / BLOCK + 0.5), goals.count()
    if not seats:
        return goals.withColumn("_blocks", F.lit(0).cast("bigint"))
    given = lambda f: F.floor(F.col("target") * F.lit(f) + F.lit(0.5))
    # a factor f gives between f * total - n / 2 and f * total + n / 2 seats
    low, high = max(0.0, (seats - n) / total), (seats + n + 1) / total
    below, above = (x or 0 for x in goals.agg(F.sum(given(low)), F.sum(given(high))).first())
    while above - below > FEW:
        probes = [f for f in np.linspace(low, high, PROBES + 2)[1:-1].tolist() if low < f < high]
        if not probes:  # more equal targets than that: their ties are ranked all the same
            break
        tried = [(low, below), *zip(probes, goals.agg(*[F.sum(given(f)) for f in probes]).first()), (high, above)]
        at = max(k for k, (_, x) in enumerate(tried) if x <= seats)
        if at + 1 == len(tried):
            break
        (low, below), (high, above) = tried[at], tried[at + 1]
    goals = goals.withColumn("_low", given(low))
    more = goals.filter(given(high) > F.col("_low")).select("rank", "target", F.explode(F.sequence(F.col("_low"), given(high) - 1)).alias("k"))
    rest = more.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "rank", "k").limit(int(seats - below))
    rest = rest.groupBy("rank").agg(F.count("*").alias("_more"))
    return goals.join(rest, "rank", "left").withColumn("_blocks", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_low", "_more")


def _quotas(rows: DataFrame, keys: list[str], part: str, size: str, words: str, out: str) -> DataFrame:
    """(keys, part, out): the ``words`` of each group of ``keys`` shared out over its parts by ``size``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(part, kind="stable")
        return pd.DataFrame({**{k: pdf[k] for k in keys}, part: pdf[part], out: shared_out(pdf[size].to_numpy(), int(pdf[words].iloc[0]))})

    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} long" for k in keys), f"{part} long", f"{out} long"]))


def _ordered(df: DataFrame) -> DataFrame:
    """Adds the seeded key of a row, from its id and size."""
    return df.withColumn("_key", F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("size").cast("string"))))


def _apportioned(df: DataFrame, scope: str) -> DataFrame:
    """Adds source_size, target and taken to rows with _id, _source and size."""
    totals = df.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goals, total = targets(totals, scope)
    plan = source_blocks(goals, total).select(
        F.col("_source").alias("_s"),
        "source_size",
        "target",
        F.col("rank").alias("_rank"),
        F.least(F.col("_blocks") * BLOCK, CAP * F.col("source_size")).cast("bigint").alias("_words"),
        F.ceil(F.col("docs") / SHARD_DOCS).cast("bigint").alias("_shards"),
    )
    plan = materialize(plan, "plan", scope)
    df = _ordered(df.join(plan, df["_source"].eqNullSafe(plan["_s"])).drop("_s"))
    df = df.withColumn("_shard", F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint"), F.greatest(F.col("_shards"), F.lit(1))))
    sizes = df.groupBy("_rank", "_shard", "_words").agg(F.sum("size").alias("_size")).withColumn("_group", F.floor(F.col("_shard") / GROUP_SHARDS).cast("bigint"))
    sizes = materialize(sizes, "shards", scope)
    groups = sizes.groupBy("_rank", "_group", "_words").agg(F.sum("_size").alias("_size"))
    groups = _quotas(groups, ["_rank"], "_group", "_size", "_words", "_group_words")
    shards = sizes.drop("_words").join(groups, ["_rank", "_group"])
    shards = shards.join(_quotas(shards, ["_rank", "_group"], "_shard", "_size", "_group_words", "_quota"), ["_rank", "_group", "_shard"])
    # a sort-merge join leaves the rows dealt by shard, as the running sum needs them: they move once
    df = df.drop("_words", "_shards").join(shards.select("_rank", "_shard", "_size", "_quota").hint("merge"), ["_rank", "_shard"])
    run = Window.partitionBy("_rank", "_shard").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_at", F.sum("size").over(run) - F.col("size"))
    size, total = F.col("size"), F.col("_size")
    whole = F.when(total > 0, F.floor(F.col("_quota") / F.greatest(total, F.lit(1)))).otherwise(F.lit(0)).cast("bigint")
    seeded = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce("_source", F.lit("")), F.col("_shard").cast("string"))), 1, 8), 16, 10).cast("bigint")
    df = df.withColumn("_whole", whole)
    df = df.withColumns({"_rest": F.when(total > 0, F.col("_quota") - F.col("_whole") * total).otherwise(F.lit(0)), "_from": F.pmod(seeded, F.greatest(F.ceil(total / BLOCK), F.lit(1))) * BLOCK})
    a, b, start, stop = F.col("_at"), F.col("_at") + size, F.col("_from"), F.col("_from") + F.col("_rest")
    zero = F.lit(0).cast("bigint")
    first = F.greatest(zero, F.least(b, stop, total) - F.greatest(a, start))
    again = F.greatest(zero, F.least(b, stop - total) - a)
    df = df.withColumns({"_first": first, "_again": again, "_head": F.greatest(zero, start - a)})
    return df.withColumn("taken", F.col("_whole") * size + F.col("_first") + F.col("_again"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scope: str = "default") -> DataFrame:
    """(id, size, source_size, target, taken) of every document."""
    df = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.size(words_of(F.col(text_col))).cast("bigint").alias("size"))
    return _apportioned(df, scope).select(F.col("_id").alias(id_col), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scope: str = "default") -> DataFrame:
    """The mix itself: each document once for each whole pass that takes it, and what a
    shard's run of blocks takes of it (nearly always all or nothing; else the taken
    words, space-joined). Columns as in ``docs``."""
    df = carried(docs, _id=F.col(id_col), _source=F.col(source_col), size=F.size(words_of(F.col(text_col))).cast("bigint"))
    df = _apportioned(df, scope).filter("taken > 0")
    part = F.col("_first") + F.col("_again")
    whole = F.col("_whole") + (part == F.col("size")).cast("bigint")
    rows = F.concat(
        F.when(whole > 0, F.array_repeat(F.lit(True), whole.cast("int"))).otherwise(F.array().cast("array<boolean>")),
        F.when((part > 0) & (part < F.col("size")), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")),
    )
    df = df.withColumn("_all", F.explode(rows))
    words = words_of(F.col("_row")[text_col])
    cut = F.concat(F.slice(words, F.lit(1), F.col("_again").cast("int")), F.slice(words, (F.col("_head") + 1).cast("int"), F.col("_first").cast("int")))
    text = F.when(F.col("_all"), F.col("_row")[text_col]).otherwise(F.array_join(cut, " "))
    return unpacked(df.withColumn("_row", F.col("_row").withField(text_col, text)), docs.columns)
