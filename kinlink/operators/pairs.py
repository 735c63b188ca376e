"""Features of candidate pairs, token statistics and rivals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.functions import similarity as S
from kinlink.functions import tokens as K
from kinlink.operators.blocking import twin_groups
from kinlink.operators.context import group_context
from kinlink.sources.shared import materialize

PAIR = ["country", "s1_id", "t_id"]
FIELDS = ("name_norm", "name_core", "name_compact", "addr_norm", "house_number")


#: Rows of a group that meet in one task, and pairs that leave it at once.
ROWS, OUT = 2_048, 1 << 18


def neighbour_similarity(rows: DataFrame, by: list[str], id_col: str, text_col: str, f: Callable[[str, str], float]) -> DataFrame:
    """(a_id, b_id, sim): f, to six digits, of the texts of every two rows of a group, the smaller id first; null where a text is.

    Rows are shuffled, not pairs: large groups are dealt into blocks of about ROWS rows,
    every two blocks meet once, and f runs once for equal pairs of texts (a worker
    remembers ``similarity.KNOWN`` of them).
    """
    full = rows.dropna(subset=[*by, id_col]).select(*by, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("x"))
    n = full.groupBy(*by).agg(F.ceil(F.count("*") / ROWS).alias("n"))
    dealt = full.join(n, by).withColumn("part", F.pmod(F.xxhash64("id"), "n"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    met = met.select(*by, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "x")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(list(batches))
        yield from _block_similarity(block, f)

    return met.groupBy(*by, "i", "j").applyInArrow(similar, "a_id long, b_id long, sim double")


def _block_similarity(block: pa.Table, f: Callable[[str, str], float]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of one block, or of the two blocks i and j."""
    ids, part, own = block["id"].to_numpy(), block["part"].to_numpy(), block["i"][0].as_py() == block["j"][0].as_py()
    coded = block["x"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = np.argsort(ids, kind="stable")
    texts = coded.dictionary.to_pylist()
    ids, part, code = ids[order], part[order], coded.indices.fill_null(len(texts)).to_numpy()[order]  # the last code is null's
    after = np.searchsorted(ids, ids, "right")
    step = max(1, OUT // len(ids))
    sims, done = np.full((len(texts) + 1, len(texts) + 1), np.nan), np.zeros((len(texts) + 1, len(texts) + 1), bool)
    done[-1, :] = done[:, -1] = True
    for start in range(0, len(ids), step):
        a = np.arange(start, min(start + step, len(ids)))
        counts = len(ids) - after[a]
        left = np.repeat(a, counts)
        right = np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(after[a], counts)
        if not own:
            apart = part[left] != part[right]
            left, right = left[apart], right[apart]
        if not len(left):
            continue
        wanted = np.zeros_like(done)
        wanted[code[left], code[right]] = True
        wanted &= ~done
        np.copyto(sims, S.matrix_of(f, texts, wanted), where=wanted)
        done |= wanted
        yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right]), pa.array(sims[code[left], code[right]], from_pandas=True)], names=["a_id", "b_id", "sim"])


def safe_divide(a: Column, b: Column) -> Column:
    """a / b where b is positive, else null."""
    return F.when(b > 0, a / b)


def token_idf(records: DataFrame, field: str, by: str = "country") -> DataFrame:
    """(country, token, df, idf): ln((1 + n) / (1 + df)) + 1 over all records of a country."""
    sizes = records.groupBy(by).agg(F.count("*").alias("n"))
    df = records.select(by, F.explode(F.array_distinct(K.words(F.col(field)))).alias("token")).groupBy(by, "token").agg(F.count("*").alias("df"))
    return df.join(sizes, by).select(by, "token", "df", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def _both(pairs: DataFrame, s1: DataFrame, pool: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    q = s1.select("country", F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"q_{c}") for c in columns])
    t = pool.select("country", F.col("entity_id").alias("t_id"), *[F.col(c).alias(f"t_{c}") for c in columns])
    return pairs.join(q, ["country", "s1_id"]).join(t, ["country", "t_id"])


def _masked(value: Column, a: Column, b: Column) -> Column:
    """Null where either text is empty."""
    return F.when((a != "") & (b != ""), value)


def string_features(df: DataFrame) -> DataFrame:
    """Similarities of names, cores, compact names and addresses of a joined pair table."""
    qn, tn, qc, tc = F.col("q_name_norm"), F.col("t_name_norm"), F.col("q_name_core"), F.col("t_name_core")
    qk, tk, qa, ta = F.col("q_name_compact"), F.col("t_name_compact"), F.col("q_addr_norm"), F.col("t_addr_norm")
    qh, th = F.col("q_house_number"), F.col("t_house_number")
    short, long = F.least(F.length(qn), F.length(tn)), F.greatest(F.length(qn), F.length(tn))
    a_short, a_long = F.least(F.length(qa), F.length(ta)), F.greatest(F.length(qa), F.length(ta))
    return df.withColumns(
        {
            "name_jw": S.jaro_winkler(qn, tn),
            "name_lev": S.levenshtein(qn, tn),
            "name_lcs": S.lcs(qn, tn),
            "name_tset": S.token_set(qn, tn) / 100,
            "name_tsort": S.token_sort(qn, tn) / 100,
            "name_partial": S.partial(qn, tn) / 100,
            "core_jw": _masked(S.jaro_winkler(qc, tc), qc, tc),
            "core_tset": _masked(S.token_set(qc, tc) / 100, qc, tc),
            "core_exact": S.same_text(qc, tc).cast("int"),
            "compact_partial": _masked(S.partial(qk, tk) / 100, qk, tk),
            "compact_ratio": _masked(S.ratio(qk, tk) / 100, qk, tk),
            "compact_exact": S.same_text(qk, tk).cast("int"),
            "addr_jw": _masked(S.jaro_winkler(qa, ta), qa, ta),
            "addr_lcs": _masked(S.lcs(qa, ta), qa, ta),
            "addr_tset": _masked(S.token_set(qa, ta) / 100, qa, ta),
            "addr_tsort": _masked(S.token_sort(qa, ta) / 100, qa, ta),
            "addr_missing": (ta == "").cast("int"),
            "hn_match": house_number_match(qh, th),
            "name_len_ratio": safe_divide(short, long),
            "addr_len_ratio": _masked(safe_divide(a_short, a_long), qa, ta),
            "is_s2": F.startswith("t_id", F.lit("S2-")).cast("int"),
        }
    )


def house_number_match(a: Column, b: Column) -> Column:
    """1 if equal, -1 if different, 0 if either is unknown."""
    return F.when((a == "") | (b == ""), F.lit(0)).when(a == b, F.lit(1)).otherwise(F.lit(-1))


def idf_overlap(pairs: DataFrame, s1: DataFrame, pool: DataFrame, idf: DataFrame, field: str, prefix: str) -> DataFrame:
    """Shared IDF mass of a field's distinct tokens: sum, largest, coverage of and mass missing from either side.

    A record's tokens travel as one list, so a pair stays one row.
    """

    def own(records: DataFrame, id_name: str, name: str) -> DataFrame:
        tokens = records.select("country", F.col("entity_id").alias(id_name), F.explode(F.array_distinct(K.words(F.col(field)))).alias("token"))
        known = tokens.join(idf.select("country", "token", "idf"), ["country", "token"])
        return known.groupBy("country", id_name).agg(F.array_sort(F.collect_list(F.struct("token", "idf"))).alias(name))

    df = pairs.join(own(s1, "s1_id", "_q"), ["country", "s1_id"], "left").join(own(pool, "t_id", "_t"), ["country", "t_id"], "left")
    held = F.filter("_q", lambda x: F.array_contains(F.col("_t.token"), x["token"]))
    df = df.withColumn("_both", F.transform(held, lambda x: x["idf"]))
    mass = lambda c: F.coalesce(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    df = df.withColumns({"_shared": mass(F.col("_both")), "_most": F.coalesce(F.array_max("_both"), F.lit(0.0)), "_mq": mass(F.col("_q.idf")), "_mt": mass(F.col("_t.idf"))})
    df = df.drop("_q", "_t", "_both")
    return df.withColumns(
        {
            f"{prefix}_idf_shared": F.col("_shared"),
            f"{prefix}_idf_max_shared": F.col("_most"),
            f"{prefix}_idf_cov_s1": safe_divide(F.col("_shared"), F.col("_mq")),
            f"{prefix}_idf_cov_t": safe_divide(F.col("_shared"), F.col("_mt")),
            f"{prefix}_idf_miss_s1": F.col("_mq") - F.col("_shared"),
            f"{prefix}_idf_miss_t": F.col("_mt") - F.col("_shared"),
        }
    ).drop("_shared", "_most", "_mq", "_mt")


def set_features(df: DataFrame, q: str = "q_addr_norm", t: str = "t_addr_norm") -> DataFrame:
    """Overlap of distinct address components and number tokens."""
    qc, tc = F.array_distinct(K.components(F.col(q))), F.array_distinct(K.components(F.col(t)))
    qn, tn = F.array_distinct(K.numbers(F.col(q))), F.array_distinct(K.numbers(F.col(t)))
    shared = F.size(F.array_intersect(qc, tc))
    common = F.size(F.array_intersect(qn, tn))
    return df.withColumns(
        {
            "comp_ov_s1": safe_divide(shared, F.size(qc)),
            "comp_ov_t": safe_divide(shared, F.size(tc)),
            "num_jacc": safe_divide(common, F.size(F.array_union(qn, tn))),
            "num_conflict": ((F.size(qn) > 0) & (F.size(tn) > 0) & (common == 0)).cast("int"),
        }
    )


def rival_counts(s1: DataFrame, key: str, name: str, by: str = "country") -> DataFrame:
    """Adds how many other records of the country have the same key; an empty key has none."""
    sizes = F.count("*").over(Window.partitionBy(by, key))
    return s1.withColumn(name, F.when(F.col(key) == "", F.lit(0)).otherwise(sizes - 1).cast("bigint"))


def rival_features(pairs: DataFrame, s1_all: DataFrame, members: int = 21) -> DataFrame:
    """How well the candidate of a pair fits other S1 records that share the query's compact name.

    ``pairs`` has q_name_compact, t_name_norm, t_addr_norm and addr_tset. Groups are cut to
    their first ``members`` by id, the query included.
    """
    counted = rival_counts(rival_counts(s1_all, "name_compact", "n_rival_compact"), "name_key", "n_rival_tokens")
    first = Window.partitionBy("country", "name_compact").orderBy("entity_id")
    group = s1_all.filter("name_compact <> ''").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= members)
    group = group.select("country", F.col("name_compact").alias("q_name_compact"), F.col("entity_id").alias("_rival"), F.col("name_norm").alias("_rn"), F.col("addr_norm").alias("_ra"))
    met = pairs.select(*PAIR, "q_name_compact", "t_name_norm", "t_addr_norm").join(group, ["country", "q_name_compact"]).filter("_rival <> s1_id")
    ta, ra = F.col("t_addr_norm"), F.col("_ra")
    met = met.withColumns({"_n": S.token_set(F.col("t_name_norm"), F.col("_rn")) / 100, "_a": F.when(ta != "", S.token_set(ta, ra) / 100)})
    best = met.groupBy(*PAIR).agg(F.max("_a").alias("rival_addr_best"), F.max("_n").alias("rival_name_best"))
    out = pairs.join(counted.select("country", F.col("entity_id").alias("s1_id"), "n_rival_compact", "n_rival_tokens"), ["country", "s1_id"], "left").join(best, PAIR, "left")
    return out.withColumn("self_minus_rival_addr", F.coalesce("addr_tset", F.lit(0.0)) - F.col("rival_addr_best"))


def build_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame, s1_all: DataFrame | None = None, scope: str = "default") -> DataFrame:
    """All stage-1 columns of candidate pairs: similarities, shared mass, overlaps, twins, rivals and group context.

    The string features are written once; every further block is computed on pair keys and
    joined to them, so that no similarity is computed twice.
    """
    cos = [c for c in pairs.columns if c.startswith("cos_")]
    everyone, keys = s1.unionByName(pool), pairs.select(*PAIR)
    df = materialize(set_features(string_features(_both(pairs, s1, pool, (*FIELDS, "addr_key", "name_key")))), "strings", scope)
    name = idf_overlap(keys, s1, pool, token_idf(everyone, "name_norm"), "name_norm", "name")
    addr = idf_overlap(keys, s1, pool, token_idf(everyone, "addr_norm"), "addr_norm", "addr").drop("addr_idf_shared", "addr_idf_miss_s1", "addr_idf_miss_t")
    twins = twin_groups(pool, "name_compact", 6).select("country", F.col("entity_id").alias("t_id"), F.col("twins").alias("t_compact_twins"))
    blocks = [name, addr]
    if s1_all is not None:
        own = df.select(*PAIR, "q_name_compact", "t_name_norm", "t_addr_norm", "addr_tset")
        blocks.append(rival_features(own, s1_all).drop("q_name_compact", "t_name_norm", "t_addr_norm", "addr_tset"))
    for block in blocks:
        df = df.join(block, PAIR)
    df = df.join(twins, ["country", "t_id"], "left").fillna(1, ["t_compact_twins"])
    each = F.array(*cos)
    df = df.withColumns({"cos_max": F.array_max(each), "cos_mean": F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / len(cos)})
    return group_context(df, ["country", "s1_id"], [*cos[:2], "name_tset", "addr_tset"])


def feature_columns(df: DataFrame, leave: tuple[str, ...] = ("label", "p", "p1", "fold")) -> list[str]:
    """Numeric columns that are neither keys, labels nor texts."""
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, k in df.dtypes if k in kinds and c not in leave and not c.startswith(("_", "q_", "t_id", "s1_id"))]
