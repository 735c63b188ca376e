"""Queries of blocking, pair features and rivals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinlink.functions import similarity as S
from kinlink.functions import tokens as K
from kinlink.operators import blocking, pairs as P
from kinlink.plans import duck, duck_pairs as D
from kinlink.plans.registry import query
from kinlink.plans.text_queries import records
from kinlink.plans.views import table
from kinlink.sources.shared import materialize

VIEWS = (blocking.View("comb", "combined", 10, max_df=0.2), blocking.View("name", "name_norm", 5, max_df=0.2))
RECORDS = duck.records()
SIDED = f"(select *, case when source = 'S1' then 'q' else 't' end as side from {RECORDS} s0)"
COMB, NAME = (duck.scores(duck.weights(SIDED, v.field, v.max_df)) for v in VIEWS)
UNION = f"(select country, s1_id, t_id from {duck.top(COMB, 10)} union select country, s1_id, t_id from {duck.top(NAME, 5)})"
CANDS = f"""(select country, s1_id, t_id, coalesce(c.cos, 0.0) as cos_comb, coalesce(n.cos, 0.0) as cos_name
  from {UNION} u left join {COMB} c using (country, s1_id, t_id) left join {NAME} n using (country, s1_id, t_id))"""


def sides(spark, sf_dir):
    """(S1, pool) of the record view, written once: many joins read it."""
    r = materialize(records(spark, sf_dir), "records")
    return r.filter("source = 'S1'"), r.filter("source <> 'S1'")


def probes(spark, sf_dir):
    """Benchmark items as queries of every language, documents as the pool; whole texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("country"), F.lit("t").alias("side"), F.col("doc_id").cast("string").alias("entity_id"), F.lower("text").alias("text"))
    items = table(spark, sf_dir, "benchmark").select(F.lit("q").alias("side"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("entity_id"), F.lower("text").alias("text"))
    countries = docs.agg(F.collect_set("country")).scalar()  # one row: an item is asked in every language
    return docs.unionByName(items.select(F.explode(countries).alias("country"), "side", "entity_id", "text"))


def probe_weights(spark, sf_dir):
    """(queries, pool) of :func:`probes`; of the pool the tokens that a query holds, the others add nothing to a cosine."""
    w = materialize(blocking.token_weights(probes(spark, sf_dir), BY_TEXT), "weights-text")
    asked = w.filter("side = 'q'")
    held = F.broadcast(asked.select("country", "token").distinct())  # bounded by benchmark, the fixed query set
    return asked, w.filter("side = 't'").join(held, ["country", "token"], "left_semi")


def holders(docs, items):
    """(s1_id, t_id): documents (t_id, text) that hold the whole text of an item (s1_id, item).

    An item is looked up by the rarest of its inner words, which any holder has as words
    of its own, and then verified; items of fewer than three words are all looked for in
    every document.
    """
    words = F.split(F.col("text"), "\\s+")
    of_docs = docs.select("t_id", "text", F.array_distinct(words).alias("words"))
    inner = items.select("s1_id", "item", F.split("item", "\\s+").alias("w")).withColumn("inner", F.when(F.size("w") > 2, F.slice("w", F.lit(2), F.size("w") - 2)))
    asked = inner.filter(F.col("inner").isNotNull()).select("s1_id", "item", F.explode(F.array_distinct("inner")).alias("word"))
    wanted = asked.select("word").distinct()
    counts = of_docs.select(F.explode("words").alias("word")).join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    keyed = asked.join(counts, "word", "left").groupBy("s1_id", "item").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "word")).alias("k")).select("s1_id", "item", F.col("k.word").alias("word"))
    may = of_docs.select("t_id", F.explode("words").alias("word")).join(keyed, "word").select("s1_id", "item", "t_id")
    found = may.join(docs, "t_id").filter(F.contains("text", F.col("item")))
    short = docs.join(inner.filter(F.col("inner").isNull()).select("s1_id", "item"), F.contains("text", F.col("item")))
    return found.select("s1_id", "t_id").union(short.select("s1_id", "t_id"))


PROBES = """(select lang as country, 't' as side, cast(doc_id as string) as entity_id, lower(text) as text from documents
  union all select lang, 'q', 'b' || cast(item_id as string), lower(text) from benchmark, (select distinct lang from documents))"""
BY_TEXT = blocking.View("text", "text", 5, max_df=0.05)


@query("token_idf", f"""with t as (select lang as country, doc_id, unnest(list_distinct({duck.words('lower(text)')})) as token from documents),
  n as (select lang as country, count(*) as n from documents group by 1)
  select country, token, count(*) as df, round(ln((1 + n) / (1 + count(*))) + 1, 6) as idf from t join n using (country) group by country, token, n""")
def token_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("country"), F.lower("text").alias("text"))
    return P.token_idf(docs, "text").withColumn("idf", F.round("idf", 6))


@query("tfidf_weights", f"select country, side, entity_id, token, round(w, 6) as w from {duck.weights(PROBES, 'text', 0.05)}")
def tfidf_weights(spark, sf_dir):
    return blocking.token_weights(probes(spark, sf_dir), BY_TEXT).withColumn("w", F.round("w", 6))


@query("tfidf_topk_join", f"select country, s1_id, t_id, round(cos, 6) as cos from {duck.top(duck.scores(duck.weights(PROBES, 'text', 0.05)), 5)}")
def tfidf_topk_join(spark, sf_dir):
    best = blocking.best_pairs(*probe_weights(spark, sf_dir), BY_TEXT.k)
    return best.withColumn("cos", F.round("cos", 6))


TRUTH = "(select 'b' || cast(item_id as string) as s1_id, cast(doc_id as string) as t_id from benchmark b join documents d on contains(d.text, b.text))"


@query(
    "blocking_recall_at_k",
    f"""with s as (select s1_id, t_id, row_number() over (partition by s1_id order by cos desc, t_id) as r from (select s1_id, t_id, max(cos) as cos from {duck.scores(duck.weights(PROBES, 'text', 0.05))} group by all)),
    t as (select t.*, s.r from (select distinct * from {TRUTH}) t left join s using (s1_id, t_id))
    select k, cast(count(*) filter (r <= k) as bigint) as found, count(*) as wanted, round(count(*) filter (r <= k) / count(*), 6) as recall from t, (values (5), (10), (20), (30), (50), (100)) v(k) group by k""",
)
def blocking_recall_at_k(spark, sf_dir):
    """Truth: documents that hold a benchmark item, the fixed query set against all documents."""
    scores = blocking.best_pairs(*probe_weights(spark, sf_dir), 100).groupBy("s1_id", "t_id").agg(F.max("cos").alias("cos"))
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("cos"), "t_id")))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("s1_id"), F.col("text").alias("item"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("t_id"), "text")
    out = blocking.recall_at(ranked, holders(docs, items).distinct())
    return out.select("k", F.col("found").cast("long").alias("found"), "wanted", F.round("recall", 6).alias("recall"))


@query("view_union_candidates", f"select country, s1_id, t_id, round(cos_comb, 6) as cos_comb, round(cos_name, 6) as cos_name, 0 as expanded from {CANDS}")
def view_union_candidates(spark, sf_dir):
    got = blocking.candidates(*sides(spark, sf_dir), VIEWS)
    return got.withColumns({c: F.round(c, 6) for c in ("cos_comb", "cos_name")})


def _twins(key: str, least: int, source: str) -> str:
    return f"(select country, {key}, entity_id, n as twins from (select *, count(*) over (partition by country, {key}) as n from {source} where length({key}) >= {least}) where n between 2 and 20)"


POOL = f"(select * from {RECORDS} p0 where source <> 'S1')"


@query("twin_groups", f"select country, name_key, entity_id, twins from {_twins('addr_key', 10, POOL).replace('addr_key, entity_id', 'addr_key as name_key, entity_id')}")
def twin_groups(spark, sf_dir):
    _, pool = sides(spark, sf_dir)
    return blocking.twin_groups(pool, "addr_key", 10).withColumnRenamed("addr_key", "name_key")


ANCHORS = f"(select c.country, s1_id, t_id from {UNION} c join {RECORDS} q on q.entity_id = s1_id join {RECORDS} t on t.entity_id = t_id where q.name_core = t.name_core)"
_NEW = " union ".join(f"select a.country, s1_id, o.entity_id as t_id from {ANCHORS} a join {_twins(k, n, POOL)} g on g.entity_id = a.t_id join {_twins(k, n, POOL)} o on o.country = g.country and o.{k} = g.{k}" for k, n in blocking.TWIN_KEYS)


@query(
    "sibling_expansion",
    f"""with known as (select * from {UNION}), fresh as (select * from ({_NEW}) x anti join known using (country, s1_id, t_id))
    select country, s1_id, t_id, 0 as expanded from known union all
    select country, s1_id, t_id, 1 from (select *, row_number() over (partition by country, s1_id order by t_id) as r from fresh) where r <= 20""",
)
def sibling_expansion(spark, sf_dir):
    """Twins of anchors with equal cores."""
    s1, pool = sides(spark, sf_dir)
    got = blocking.candidates(s1, pool, VIEWS)
    q = s1.select(F.col("entity_id").alias("s1_id"), F.col("name_core").alias("_q"))
    t = pool.select(F.col("entity_id").alias("t_id"), F.col("name_core").alias("_t"))
    anchors = got.join(q, "s1_id").join(t, "t_id").filter("_q = _t").select("country", "s1_id", "t_id")
    return blocking.add_twins(got, anchors, pool).select("country", "s1_id", "t_id", "expanded")


SIMILAR = f"""(select country, s1_id, t_id, name_ts, addr_ts from (select country, s1_id, t_id, {D.token_set('q_name_norm', 't_name_norm')} as name_ts, {D.token_set('q_addr_norm', 't_addr_norm')} as addr_ts from {D.joined(CANDS, RECORDS)} j) y)"""
_ALIKE = f"(select * from {SIMILAR} a0 where name_ts >= 90 and addr_ts >= 80)"


@query(
    "sibling_expansion_similar",
    f"""with known as materialized (select * from {CANDS}), anchors as materialized (select * from {_ALIKE}), fresh as (select * from ({_NEW.replace(ANCHORS, 'anchors')}) x anti join known using (country, s1_id, t_id))
    select country, s1_id, t_id, round(cos_comb, 6) as cos_comb, round(cos_name, 6) as cos_name, 0 as expanded from known union all
    select country, s1_id, t_id, 0.0, 0.0, 1 from (select *, row_number() over (partition by country, s1_id order by t_id) as r from fresh) where r <= 20""",
)
def sibling_expansion_similar(spark, sf_dir):
    s1, pool = sides(spark, sf_dir)
    got = blocking.expand_twins(blocking.candidates(s1, pool, VIEWS), s1, pool)
    return got.withColumns({c: F.round(c, 6) for c in ("cos_comb", "cos_name")})


@query(
    "second_hop",
    f"""with known as materialized (select * from {CANDS}), w as materialized (select * from {duck.weights(SIDED, 'combined', VIEWS[0].max_df)} where side = 't'),
    top as materialized (select country, s1_id, t_id from (select *, row_number() over (partition by country, s1_id order by name_ts + addr_ts desc, t_id) as r from {SIMILAR} where name_ts >= 80 or addr_ts >= 80) where r <= 2),
    near as (select country, t_id, n_id from (select a.country, a.entity_id as t_id, b.entity_id as n_id, round(sum(a.w * b.w), 9) as cos from w a join w b using (country, token) where a.entity_id <> b.entity_id and a.entity_id in (select t_id from top) group by all)
      qualify row_number() over (partition by country, t_id order by cos desc, n_id) <= 10),
    fresh as (select distinct top.country, s1_id, n_id as t_id from top join near using (country, t_id)),
    new as (select *, row_number() over (partition by country, s1_id order by t_id) as r from fresh anti join known using (country, s1_id, t_id))
    select country, s1_id, t_id, round(cos_comb, 6) as cos_comb, round(cos_name, 6) as cos_name, 0 as expanded, 0 as hop2 from known union all select country, s1_id, t_id, 0.0, 0.0, 0, 1 from new where r <= 15""",
)
def second_hop(spark, sf_dir):
    """Anchors by token sets; the pool's weights are those of pool and S1 together."""
    s1, pool = sides(spark, sf_dir)
    got = blocking.candidates(s1, pool, VIEWS)
    q = s1.select("country", F.col("entity_id").alias("s1_id"), F.col("name_norm").alias("_qn"), F.col("addr_norm").alias("_qa"))
    t = pool.select("country", F.col("entity_id").alias("t_id"), F.col("name_norm").alias("_tn"), F.col("addr_norm").alias("_ta"))
    alike = got.join(q, ["country", "s1_id"]).join(t, ["country", "t_id"])
    alike = alike.select("country", "s1_id", "t_id", S.token_set(F.col("_qn"), F.col("_tn")).alias("name_ts"), S.token_set(F.col("_qa"), F.col("_ta")).alias("addr_ts"))
    return blocking.second_hop(got, alike, s1, pool, VIEWS[0]).withColumns({c: F.round(c, 6) for c in ("cos_comb", "cos_name")})


NEIGHBOURS = "(select a.p_partkey as a_id, b.p_partkey as b_id, a.p_name || ' ' || a.p_type as a, b.p_name || ' ' || b.p_type as b from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey)"


BRAND = NEIGHBOURS.replace(" and a.p_size = b.p_size", "")


def neighbours(spark, sf_dir, f, by=("p_brand", "p_size")):
    """f of all pairs of parts with equal ``by``; null where either text is."""
    p = table(spark, sf_dir, "part").select("p_partkey", *by, F.concat("p_name", F.lit(" "), "p_type").alias("x"))
    return P.neighbour_similarity(p, list(by), "p_partkey", "x", f)


@query("sim_levenshtein", f"select a_id, b_id, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) as sim from {BRAND}")
def sim_levenshtein(spark, sf_dir):
    return neighbours(spark, sf_dir, S.levenshtein_of, ("p_brand",))


@query("sim_jaro_winkler", f"select a_id, b_id, round({D.jaro_winkler('a', 'b')}, 6) as sim from {BRAND}")
def sim_jaro_winkler(spark, sf_dir):
    return neighbours(spark, sf_dir, S.jaro_winkler_of, ("p_brand",))


def _plain(name, f, sql):
    @query(name, f"select a_id, b_id, round({sql('a', 'b')}, 6) as sim from {NEIGHBOURS}")
    def run(spark, sf_dir):
        return neighbours(spark, sf_dir, f)

    return run


for _name, _f, _sql in (("sim_lcs", S.lcs_of, D.lcs), ("sim_ratio", S.ratio_of, D.ratio), ("sim_token_sort", S.token_sort_of, D.token_sort), ("sim_token_set", S.token_set_of, D.token_set), ("sim_partial", S.partial_of, D.partial)):
    _plain(_name, _f, _sql)


OVERLAP = f"""(with pairs as (select * from {UNION}), rec as (select * from {RECORDS}),
  tok as (select country, entity_id, unnest(list_distinct({duck.words('name_norm')})) as token from rec),
  idf as (select country, token, ln((1 + n) / (1 + count(*))) + 1 as idf from tok join (select country, count(*) as n from rec group by all) using (country) group by country, token, n),
  own as (select entity_id, token, idf from tok join idf using (country, token)),
  mass as (select entity_id, sum(idf) as m from own group by all),
  shared as (select s1_id, t_id, sum(q.idf) as s, max(q.idf) as mx from pairs join own q on q.entity_id = s1_id join own t on t.entity_id = t_id and t.token = q.token group by all)
  select country, s1_id, t_id, round(coalesce(s, 0), 6) as name_idf_shared, round(coalesce(mx, 0), 6) as name_idf_max_shared, round(coalesce(s, 0) / a.m, 6) as name_idf_cov_s1, round(coalesce(s, 0) / b.m, 6) as name_idf_cov_t
  from pairs left join shared using (s1_id, t_id) left join mass a on a.entity_id = s1_id left join mass b on b.entity_id = t_id)"""


@query("idf_overlap", f"select * from {OVERLAP}")
def idf_overlap(spark, sf_dir):
    s1, pool = sides(spark, sf_dir)
    got = blocking.candidates(s1, pool, VIEWS).select("country", "s1_id", "t_id")
    out = P.idf_overlap(got, s1, pool, P.token_idf(s1.unionByName(pool), "name_norm"), "name_norm", "name")
    cols = ["name_idf_shared", "name_idf_max_shared", "name_idf_cov_s1", "name_idf_cov_t"]
    return out.select("country", "s1_id", "t_id", *[F.round(c, 6).alias(c) for c in cols])


SETS = f"""(with x as (select u.*, list_distinct(list_filter(list_transform(string_split(q.addr_norm, ','), lambda c: trim(c)), lambda c: c <> '')) as qc, list_distinct(list_filter(list_transform(string_split(t.addr_norm, ','), lambda c: trim(c)), lambda c: c <> '')) as tc,
   list_distinct(regexp_extract_all(q.addr_norm, '\\b(\\d+[a-z]?)\\b', 1)) as qn, list_distinct(regexp_extract_all(t.addr_norm, '\\b(\\d+[a-z]?)\\b', 1)) as tn, q.house_number as qh, t.house_number as th
   from {UNION} u join {RECORDS} q on q.entity_id = s1_id join {RECORDS} t on t.entity_id = t_id)
  select country, s1_id, t_id, round(len(list_intersect(qc, tc)) / nullif(len(qc), 0), 6) as comp_ov_s1, round(len(list_intersect(qc, tc)) / nullif(len(tc), 0), 6) as comp_ov_t,
   round(len(list_intersect(qn, tn)) / nullif(len(list_distinct(list_concat(qn, tn))), 0), 6) as num_jacc, case when len(qn) > 0 and len(tn) > 0 and len(list_intersect(qn, tn)) = 0 then 1 else 0 end as num_conflict,
   case when qh = '' or th = '' then 0 when qh = th then 1 else -1 end as hn_match from x)"""


@query("set_overlap", f"select * from {SETS}")
def set_overlap(spark, sf_dir):
    s1, pool = sides(spark, sf_dir)
    got = blocking.candidates(s1, pool, VIEWS).select("country", "s1_id", "t_id")
    df = P.set_features(P._both(got, s1, pool, ("addr_norm", "house_number")))
    df = df.withColumn("hn_match", P.house_number_match(F.col("q_house_number"), F.col("t_house_number")))
    return df.select("country", "s1_id", "t_id", *[F.round(c, 6).alias(c) for c in ("comp_ov_s1", "comp_ov_t", "num_jacc")], "num_conflict", "hn_match")


@query("rival_counts", f"select entity_id, count(*) over (partition by country, name_compact) - 1 as n_rival_compact, count(*) over (partition by country, name_key) - 1 as n_rival_tokens from {RECORDS} r where source = 'S1'")
def rival_counts(spark, sf_dir):
    s1, _ = sides(spark, sf_dir)
    return P.rival_counts(P.rival_counts(s1, "name_compact", "n_rival_compact"), "name_key", "n_rival_tokens").select("entity_id", "n_rival_compact", "n_rival_tokens")


#: Stage-1 columns of the views' candidates, in the order of their names.
FEATURES = tuple(sorted(
    "cos_comb cos_name expanded name_jw name_lev name_lcs name_tset name_tsort name_partial core_jw core_tset core_exact compact_partial compact_ratio compact_exact "
    "addr_jw addr_lcs addr_tset addr_tsort addr_missing hn_match name_len_ratio addr_len_ratio is_s2 comp_ov_s1 comp_ov_t num_jacc num_conflict "
    "name_idf_shared name_idf_max_shared name_idf_cov_s1 name_idf_cov_t name_idf_miss_s1 name_idf_miss_t addr_idf_max_shared addr_idf_cov_s1 addr_idf_cov_t "
    "n_rival_compact n_rival_tokens rival_addr_best rival_name_best self_minus_rival_addr t_compact_twins cos_max cos_mean n_cands "
    "cos_comb_rank cos_comb_gap_best cos_comb_gap_second cos_name_rank cos_name_gap_best cos_name_gap_second name_tset_rank name_tset_gap_best name_tset_gap_second addr_tset_rank addr_tset_gap_best addr_tset_gap_second".split()
))


@query("pair_features", f"select country, s1_id, t_id, {', '.join(f'round(cast({c} as double), 6) as {c}' for c in FEATURES)} from {D.features(CANDS, RECORDS)}")
def pair_features(spark, sf_dir):
    """All stage-1 columns, rivals and group context included."""
    s1, pool = sides(spark, sf_dir)
    df = P.build_features(blocking.candidates(s1, pool, VIEWS), s1, pool, s1)
    return df.select("country", "s1_id", "t_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in sorted(P.feature_columns(df))])
