"""Queries of context, decision, evaluation, learning and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink.operators import blocking, context, decision, evaluation, learning, pairs as P, validation
from kinlink.plans import duck, duck_pairs as D
from kinlink.plans.pair_queries import CANDS, COMB, RECORDS, VIEWS, sides
from kinlink.plans.registry import query
from kinlink.plans.text_queries import records
from kinlink.plans.views import ENTITIES, PAIRS, table, view
from kinlink.sources import sampling, synthetic, tables
from kinlink.sources.shared import materialize

T_, TOP, REL = 0.7, 0.9, 0.8
OWNED = f"(select *, row_number() over (partition by country, t_id order by p desc, s1_id) = 1 as owner from ({PAIRS}) p0)"
DECIDED = f"(select *, coalesce(owner and p >= {T_} and p >= {REL} * best and best >= {TOP}, false) as matched from (select *, max(case when owner then p end) over (partition by country, s1_id) as best from {OWNED} o0) o1)"
SCORED = f"""(select e.s1_id, e.country, count(case when matched and label = 1 then 1 end) as tp, count(case when matched then 1 end) as npred, count(case when label = 1 then 1 end) as ntrue
  from ({ENTITIES}) e left join {DECIDED} d on d.s1_id = e.s1_id group by e.s1_id, e.country)"""


def _f(tp: str, said: str, true: str) -> str:
    return f"case when {said} = 0 and {true} = 0 then 1.0 when {tp} = 0 then 0.0 else 1.25 * ({tp} / {said}) * ({tp} / {true}) / (0.25 * ({tp} / {said}) + {tp} / {true}) end"


def pairs(spark, sf_dir):
    return view(spark, sf_dir, PAIRS, "lineitem").withColumn("p", F.col("p").cast("double"))


def entities(spark, sf_dir):
    return view(spark, sf_dir, ENTITIES, "supplier")


def decided(spark, sf_dir):
    return decision.decide(decision.one_owner(pairs(spark, sf_dir)), T_, TOP, REL)


@query(
    "group_context",
    """select o_custkey, o_orderkey, n_cands, rnk as o_totalprice_rank, round(best - v, 4) as gap_best, round(case when v >= best then v - coalesce(second, -1) else v - best end, 4) as gap_second
    from (select o_custkey, o_orderkey, o_totalprice as v, count(*) over w as n_cands, rank() over (partition by o_custkey order by o_totalprice desc) as rnk, max(o_totalprice) over w as best,
      nth_value(o_totalprice, 2) over (partition by o_custkey order by o_totalprice desc, o_orderkey rows between unbounded preceding and unbounded following) as second from orders window w as (partition by o_custkey)) x""",
)
def group_context(spark, sf_dir):
    df = context.group_context(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_totalprice"], "o_orderkey")
    return df.select("o_custkey", "o_orderkey", "n_cands", "o_totalprice_rank", F.round("o_totalprice_gap_best", 4).alias("gap_best"), F.round("o_totalprice_gap_second", 4).alias("gap_second"))


@query("prune_topk", f"select country, s1_id, t_id, p from (select *, row_number() over (partition by country, s1_id order by p desc, t_id) as r from ({PAIRS}) p0) x where r <= 12")
def prune_topk(spark, sf_dir):
    return context.prune(pairs(spark, sf_dir), ["country", "s1_id"], "p", 12).select("country", "s1_id", "t_id", "p")


@query(
    "group_confidence",
    f"""select country, s1_id, t_id, r as p1_rank, round(case when r = 1 then coalesce(second, 0) else best end, 6) as p1_best_other, n_conf, round(sum_p1, 6) as sum_p1, n_conf_s2, n_conf_s3,
      case when t_id like 'S2-%' then n_conf_s2 else n_conf_s3 end - case when p >= 0.5 then 1 else 0 end as n_conf_same_source_other
    from (select *, row_number() over o as r, max(p) over w as best, nth_value(p, 2) over (o rows between unbounded preceding and unbounded following) as second, cast(sum(case when p >= 0.5 then 1 else 0 end) over w as bigint) as n_conf, sum(p) over w as sum_p1,
      cast(sum(case when p >= 0.5 and t_id like 'S2-%' then 1 else 0 end) over w as bigint) as n_conf_s2, cast(sum(case when p >= 0.5 and t_id not like 'S2-%' then 1 else 0 end) over w as bigint) as n_conf_s3
      from ({PAIRS}) p0 window w as (partition by country, s1_id), o as (partition by country, s1_id order by p desc, t_id)) x""",
)
def group_confidence(spark, sf_dir):
    df = context.confidence(pairs(spark, sf_dir), ["country", "s1_id"], "p")
    return df.select("country", "s1_id", "t_id", "p1_rank", F.round("p1_best_other", 6).alias("p1_best_other"), "n_conf", F.round("sum_p1", 6).alias("sum_p1"), "n_conf_s2", "n_conf_s3", "n_conf_same_source_other")


_SIB_REAL = "sib_name_wmax sib_addr_wmax sib_name_conf_max sib_addr_conf_max sib_addrkey_eq_wmax sib_namekey_eq_wmax sib_hn_eq_wmax p1_best_other p1_gap_best_other sum_p1".split()
_SIB_WHOLE = "sib_addr_eq_conf sib_compact_eq_conf sib_name_hi_conf sib_addr_hi_conf sib_addrkey_eq_conf sib_namekey_eq_conf sib_hn_eq_conf sib_hn_conflict_conf p1_rank n_conf n_conf_s2 n_conf_s3 n_conf_same_source_other".split()


@query(
    "sibling_features",
    f"select country, s1_id, t_id, {', '.join(f'round({c}, 6) as {c}' for c in _SIB_REAL)}, {', '.join(f'cast({c} as bigint) as {c}' for c in _SIB_WHOLE)} from {D.siblings(f'(select *, cos_comb as p1 from {D.joined(CANDS, RECORDS)} j)')}",
)
def sibling_features(spark, sf_dir):
    """Stage-2 columns, the combined cosine in the place of the first model's probability."""
    s1, pool = sides(spark, sf_dir)
    df = P._both(blocking.candidates(s1, pool, VIEWS), s1, pool, (*P.FIELDS, "addr_key", "name_key")).withColumn("p1", F.col("cos_comb"))
    out = context.sibling_features(df, ["country", "s1_id"])
    return out.select("country", "s1_id", "t_id", *[F.round(F.col(c), 6).alias(c) for c in _SIB_REAL], *[F.col(c).cast("bigint").alias(c) for c in _SIB_WHOLE])


@query("one_owner", f"select country, s1_id, t_id, p from {OWNED} o where owner")
def one_owner(spark, sf_dir):
    return decision.one_owner(pairs(spark, sf_dir)).filter("owner").select("country", "s1_id", "t_id", "p")


@query("decide", f"select country, s1_id, t_id, p from {DECIDED} d where matched")
def decide(spark, sf_dir):
    return decided(spark, sf_dir).filter("matched").select("country", "s1_id", "t_id", "p")


def _parts(spark, sf_dir):
    d = decided(spark, sf_dir)
    return entities(spark, sf_dir), d, d.filter("matched"), d.filter("label = 1")


@query("entity_f05", f"select s1_id, tp, npred, ntrue, round({_f('tp', 'npred', 'ntrue')}, 6) as f05 from {SCORED} s")
def entity_f05(spark, sf_dir):
    e, _, said, true = _parts(spark, sf_dir)
    return decision.entity_scores(e, said, true).withColumn("f05", F.round("f05", 6))


@query(
    "macro_f05",
    f"""select round(avg(f), 6) as macro_f05, round(coalesce(avg(f) filter (ntrue = 0), 1.0), 6) as singleton_accuracy, round(coalesce(avg(f) filter (ntrue > 0), 0.0), 6) as matches_macro_f05, count(*) as n_s1
    from (select *, {_f('tp', 'npred', 'ntrue')} as f from {SCORED} s) x""",
)
def macro_f05(spark, sf_dir):
    e, _, said, true = _parts(spark, sf_dir)
    out = decision.macro(decision.entity_scores(e, said, true))
    return out.select(*[F.round(c, 6).alias(c) for c in ("macro_f05", "singleton_accuracy", "matches_macro_f05")], "n_s1")


GRID = ", ".join(f"({t}, {top}, {rel})" for t, top, rel in decision.grid())


@query(
    "decision_grid",
    f"""with own as (select s1_id, p, label, max(p) over (partition by s1_id) as best from {OWNED} o where owner), e as (select e.s1_id, count(case when label = 1 then 1 end) as n_true from ({ENTITIES}) e left join ({PAIRS}) q on q.s1_id = e.s1_id group by 1),
    g as (select cast(t as double) as t, cast(top as double) as t_top, cast(rel as double) as rel from (values {GRID}) v(t, top, rel)),
    c as (select g.t, g.t_top, g.rel, e.s1_id, n_true, count(case when p >= t and p >= rel * best and best >= t_top then 1 end) as said, count(case when p >= t and p >= rel * best and best >= t_top and label = 1 then 1 end) as tp
      from g cross join e left join own on own.s1_id = e.s1_id group by all)
    select t, t_top, rel, round(avg({_f('tp', 'said', 'n_true')}), 6) as macro_f05 from c group by t, t_top, rel""",
)
def decision_grid(spark, sf_dir):
    p, e = pairs(spark, sf_dir), entities(spark, sf_dir)
    true = p.groupBy("s1_id").agg(F.sum("label").alias("n_true"))
    e = e.select("s1_id").join(true, "s1_id", "left").fillna(0, ["n_true"])
    return decision.search(p, e).withColumn("macro_f05", F.round("macro_f05", 6))


#: Candidates of the report: a planted blocking that misses every target whose id ends in 3.
SEEN = "t_id not like '%3'"


@query(
    "score_report",
    f"""select country, round(sum(caught) / nullif(sum(ntrue), 0), 6) as recall_ceiling, round(avg(cands), 6) as avg_candidates, max(cands) as max_candidates, round(avg(f), 6) as macro_f05,
      round(coalesce(avg(f) filter (ntrue = 0), 1.0), 6) as singleton_accuracy, round(coalesce(avg(f) filter (ntrue > 0), 0.0), 6) as matches_macro_f05, cast(sum(stray) as bigint) as stray, count(*) as n_s1
    from (select s.*, coalesce(c.n, 0) as cands, coalesce(c.caught, 0) as caught, coalesce(m.n, 0) as stray, {_f('tp', 'npred', 'ntrue')} as f from {SCORED} s
      left join (select s1_id, count(*) as n, sum(label) as caught from ({PAIRS}) p where {SEEN} group by 1) c on c.s1_id = s.s1_id
      left join (select s1_id, count(*) as n from {DECIDED} p where matched and not {SEEN} group by 1) m on m.s1_id = s.s1_id) x group by grouping sets ((country), ())""",
)
def score_report(spark, sf_dir):
    e, cands, said, true = _parts(spark, sf_dir)
    out = evaluation.score_report(e, cands.filter(SEEN), said, true)
    return out.select("country", *[F.round(c, 6).alias(c) for c in ("recall_ceiling", "avg_candidates")], "max_candidates", *[F.round(c, 6).alias(c) for c in ("macro_f05", "singleton_accuracy", "matches_macro_f05")], "stray", "n_s1")


@query("error_buckets", f"select s1_id, t_id, case when label = 1 and not owner then 'never_blocked' when label = 1 and not matched then 'rejected' else 'false' end as bucket from {DECIDED} d where (label = 1 and not matched) or (label = 0 and matched)")
def error_buckets(spark, sf_dir):
    _, all_, said, true = _parts(spark, sf_dir)
    return evaluation.error_buckets(all_.filter("owner"), said, true)


@query(
    "counterfactual_f05",
    f"""with s as (select e.s1_id, e.country, count(case when matched and label = 1 then 1 end) as tp, count(case when matched then 1 end) as said, count(case when label = 1 then 1 end) as tr,
      count(case when label = 1 and owner then 1 end) as orc, count(case when label = 1 and owner and not matched then 1 end) as missed, count(case when label = 0 and matched then 1 end) as wrong from ({ENTITIES}) e left join {DECIDED} d on d.s1_id = e.s1_id group by all)
    select country, round(avg({_f('tp', 'said', 'tr')}), 6) as macro_f05, round(avg({_f('tp', '(said - wrong)', 'tr')}), 6) as no_false_positives, round(avg({_f('(tp + missed)', '(said + missed)', 'tr')}), 6) as no_rejected, round(avg({_f('orc', 'orc', 'tr')}), 6) as oracle
    from s group by grouping sets ((country), ())""",
)
def counterfactual_f05(spark, sf_dir):
    e, all_, said, true = _parts(spark, sf_dir)
    out = evaluation.counterfactual(e, all_.filter("owner"), said, true)
    return out.select("country", *[F.round(c, 6).alias(c) for c in ("macro_f05", "no_false_positives", "no_rejected", "oracle")])


@query("false_owners", f"select case when o.t_id is null then 'none' else 'other_entity' end as owner, count(*) as n from (select s1_id, t_id from {DECIDED} d where matched and label = 0) w left join (select distinct t_id from ({PAIRS}) p where label = 1) o on o.t_id = w.t_id group by 1")
def false_owners(spark, sf_dir):
    _, _, said, true = _parts(spark, sf_dir)
    return evaluation.false_owners(said, true)


@query("key_coverage", f"select count(*) as n, count(o.k) as covered, round(count(o.k) / count(*), 6) as share from (select name_compact from {RECORDS} r where source = 'S2') s left join (select distinct name_compact as k from {RECORDS} r2 where source = 'S1' and name_compact <> '') o on o.k = s.name_compact")
def key_coverage(spark, sf_dir):
    r = records(spark, sf_dir)
    return evaluation.key_coverage(r.filter("source = 'S2'"), r.filter("source = 'S1'")).withColumn("share", F.round("share", 6))


_LINKED = f"(select r.s1_id, r.t_id, r.cos_comb, r.cos_comb >= 0.5 as found from {CANDS} r)"


@query(
    "closure_check",
    f"""with l as (select c.*, p.addr_key as addr_key, p.name_compact as name_compact, p.name_key as name_key from {_LINKED} c join {RECORDS} p on p.entity_id = c.t_id), """
    + "m as (select * from l where not found), f as (select * from l where found) "
    + " union all ".join(f"select '{k}' as key, count(*) as misses, count(case when m.{k} <> '' and exists (select 1 from f where f.s1_id = m.s1_id and f.{k} = m.{k}) then 1 end) as closed from m" for k in ("addr_key", "name_compact", "name_key")),
)
def closure_check(spark, sf_dir):
    s1, pool = sides(spark, sf_dir)
    got = blocking.candidates(s1, pool, VIEWS)
    return evaluation.closure(got.filter("cos_comb < 0.5"), got.filter("cos_comb >= 0.5"), pool)


@query(
    "sibling_anchor_share",
    f"""with c as materialized (select c.*, t.name_norm as tn, t.addr_norm as ta from {CANDS} c join {RECORDS} t on t.entity_id = t_id), met as (select m.s1_id, m.t_id, m.tn, m.ta, f.tn as fn, f.ta as fa from c m left join c f on f.s1_id = m.s1_id and f.cos_comb >= 0.5 where m.cos_comb < 0.5),
    best as materialized (select s1_id, t_id, coalesce(max(case when fn is not null then {D.token_set('tn', 'fn')} end), 0) as n, coalesce(max(case when fa is not null then {D.token_set('ta', 'fa')} end), 0) as a from met group by all)
    select level, round(avg(cast(n >= level as int)), 6) as name_share, round(avg(cast(a >= level as int)), 6) as addr_share from best, (values (90), (95), (100)) v(level) group by level""",
)
def sibling_anchor_share(spark, sf_dir):
    s1, pool = sides(spark, sf_dir)
    got = blocking.candidates(s1, pool, VIEWS)
    out = evaluation.sibling_anchor_share(got.filter("cos_comb < 0.5"), got.filter("cos_comb >= 0.5"), pool)
    return out.select("level", *[F.round(c, 6).alias(c) for c in ("name_share", "addr_share")])


@query("structure_spearman", "select round(corr(a, b), 6) as spearman from (select rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 as a, rank() over (order by o_custkey) + (count(*) over (partition by o_custkey) - 1) / 2.0 as b from orders) x")
def structure_spearman(spark, sf_dir):
    return evaluation.rank_correlation(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey").withColumn("spearman", F.round("spearman", 6))


@query("structure_spans", "select median(span) as median_span, max(span) as max_span, count(*) as groups from (select max(l_partkey) - min(l_partkey) as span from lineitem group by l_suppkey) x")
def structure_spans(spark, sf_dir):
    return evaluation.spans(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@query("structure_monotonic", "select o_custkey, bool_and(ok) as monotonic from (select o_custkey, coalesce(o_orderdate >= lag(o_orderdate) over (partition by o_custkey order by o_orderkey), true) as ok from orders) x group by o_custkey")
def structure_monotonic(spark, sf_dir):
    return evaluation.is_monotonic(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate")


@query("house_number_agreement", f"select round(cos_comb, 1) as level, round(avg(case when q.house_number <> '' and t.house_number <> '' then 1 else 0 end), 6) as both_share, round(avg(case when q.house_number <> '' and t.house_number <> '' then case when q.house_number = t.house_number then 1 else 0 end end), 6) as equal_share from {CANDS} c join {RECORDS} q on q.entity_id = s1_id join {RECORDS} t on t.entity_id = t_id group by 1")
def house_number_agreement(spark, sf_dir):
    s1, pool = sides(spark, sf_dir)
    df = P._both(blocking.candidates(s1, pool, VIEWS), s1, pool, ("house_number",)).withColumn("level", F.round("cos_comb", 1))
    out = evaluation.agreement(df, "q_house_number", "t_house_number", "level")
    return out.select("level", F.round("both_share", 6).alias("both_share"), F.round("equal_share", 6).alias("equal_share"))


@query("similarity_stats")
def similarity_stats(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    return evaluation.similarity_stats(turns, F.col("a"), F.col("b"))


LISTS = f"""(select s1_id, list_sort(list(t_id)) as ids from {DECIDED} d where matched group by s1_id)"""


@query("one_row_each", f"select e.s1_id as source1_entity_id, coalesce(array_to_string(ids, ','), '') as matched_entity_ids from ({ENTITIES}) e left join {LISTS} l on l.s1_id = e.s1_id")
def one_row_each(spark, sf_dir):
    s1 = entities(spark, sf_dir).withColumnRenamed("s1_id", "entity_id")
    return tables.one_row_each(s1, decided(spark, sf_dir).filter("matched"))


@query("truth_coverage", f"select s1_id from ({ENTITIES}) e where s1_id not in (select s1_id from {DECIDED} d where matched and s1_id not like '%7')")
def truth_coverage(spark, sf_dir):
    """A planted truth that leaves out every entity whose id ends in 7."""
    s1 = entities(spark, sf_dir).withColumnRenamed("s1_id", "entity_id")
    return tables.uncovered(s1, decided(spark, sf_dir).filter("matched and s1_id not like '%7'"))


@query("truth_repeated", f"select s1_id, count(*) as n from ({PAIRS}) p where label = 1 group by 1 having count(*) > 1")
def truth_repeated(spark, sf_dir):
    return tables.repeated(pairs(spark, sf_dir).filter("label = 1"))


# lists with planted faults: a customer's orders, some prefixed wrongly, some repeated
FAULTY = """(select 'S1-' || cast(o_custkey as string) as s1_id, case o_orderkey % 5 when 0 then 'S1-' when 1 then 'X-' else 'S2-' end || cast(o_orderkey % 997 as string) as id from orders)"""


@query(
    "validate_rules",
    f"""with f as (select * from {FAULTY}), l as (select s1_id, list(id) as ids from f group by 1)
    select 'duplicate_id' as rule, s1_id from l where len(ids) <> len(list_distinct(ids)) union all select distinct 'self_match', s1_id from f where id like 'S1-%' union all select distinct 'wrong_prefix', s1_id from f where id like 'X-%'
    union all select distinct 'unknown_id', s1_id from f where id like 'S2-%' and cast(substr(id, 4) as bigint) not in (select s_suppkey from supplier)
    union all select 'missing_s1', 'S1-' || cast(s_suppkey as string) from supplier where 'S1-' || cast(s_suppkey as string) not in (select s1_id from l)
    union all select 'unexpected_s1', s1_id from l where cast(substr(s1_id, 4) as bigint) not in (select s_suppkey from supplier)""",
)
def validate_rules(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    prefix = F.when(F.col("o_orderkey") % 5 == 0, "S1-").when(F.col("o_orderkey") % 5 == 1, "X-").otherwise("S2-")
    lists = o.groupBy(F.concat(F.lit("S1-"), F.col("o_custkey").cast("string")).alias("s1_id")).agg(F.collect_list(F.concat(prefix, (F.col("o_orderkey") % 997).cast("string"))).alias("ids"))
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S2-"), F.col("s_suppkey").cast("string")).alias("entity_id"))
    return validation.issues(lists.withColumn("malformed", F.lit(False)), entities(spark, sf_dir), known)


@query("validate_subset", f"select s1_id, len(ids) as n from (select s1_id, list(t_id) as ids from {OWNED} o where label = 1 and not owner group by 1) x")
def validate_subset(spark, sf_dir):
    d = decision.one_owner(pairs(spark, sf_dir))
    lists = lambda df: df.groupBy("s1_id").agg(F.collect_list("t_id").alias("ids"))
    out = validation.outside_candidates(lists(d.filter("label = 1")), lists(d.filter("owner")))
    return out.select("s1_id", F.size("ids").cast("long").alias("n"))


@query("with_labels", f"select country, s1_id, t_id, label from ({PAIRS}) p")
def with_labels(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return learning.with_labels(p.select("country", "s1_id", "t_id"), p.filter("label = 1")).select("country", "s1_id", "t_id", "label")


@query(
    "learn_word_map",
    """with n as (select 'S1-' || cast(a.p_partkey as string) as s1_id, string_split(lower(a.p_name || ' ' || a.p_type), ' ') as own, list_transform(string_split(lower(b.p_name || ' ' || b.p_type), ' '), lambda w: 'é' || w) as pool
      from part a join part b on b.p_partkey = a.p_partkey + 1),
    w as (select unnest(pool) as word, unnest(own) as reading from n where len(own) = len(pool)), c as (select word, reading, count(*) as n, sum(count(*)) over (partition by word) as total from w group by 1, 2)
    select word, reading, n from c where n >= 2 and n >= 0.1 * total qualify row_number() over (partition by word order by n desc, reading) = 1""",
)
def learn_word_map(spark, sf_dir):
    """Each part's name taught by the part before it, its words marked as another script."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("x"))
    s1 = p.select(F.concat(F.lit("S1-"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("x").alias("business_name"))
    marked = F.array_join(F.transform(F.split("x", " "), lambda w: F.concat(F.lit("é"), w)), " ")
    pool = p.select(F.concat(F.lit("S2-"), F.col("p_partkey").cast("string")).alias("entity_id"), marked.alias("business_name"))
    truth = p.select(F.concat(F.lit("S1-"), (F.col("p_partkey") - 1).cast("string")).alias("s1_id"), F.concat(F.lit("S2-"), F.col("p_partkey").cast("string")).alias("t_id"))
    return learning.learn_word_map(s1, pool, truth, script="é", min_share=0.1)


_S1 = f"(select s1_id as entity_id, country from ({ENTITIES}) e0)"


@query("stratified_sample", f"select entity_id, country from {D.stratified(_S1, 60)} s")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(entities(spark, sf_dir).withColumnRenamed("s1_id", "entity_id"), 60)


@query("drop_rivals", f"select entity_id, country from {_S1} e where entity_id in (select entity_id from {D.stratified(_S1, 30)} s) or {D.unit('entity_id')} >= 0.2")
def drop_rivals(spark, sf_dir):
    e = entities(spark, sf_dir).withColumnRenamed("s1_id", "entity_id")
    return sampling.drop_rivals(e, sampling.stratified(e, 30), 0.2).select("entity_id", "country")


@query(
    "sampled_dataset",
    f"""with rec as materialized (select entity_id, source, country from {RECORDS} r), s as materialized (select * from {D.stratified("(select * from rec where source = 'S1')", 200, 42)}),
    needed as materialized (select distinct t_id from {CANDS} c where cos_comb >= 0.9 and s1_id in (select entity_id from s))
    select * from s union all select * from rec where source <> 'S1' and (entity_id in (select t_id from needed) or {D.unit('entity_id', 42)} < 0.03)""",
)
def sampled_dataset(spark, sf_dir):
    s1, pool = sides(spark, sf_dir)
    asked = sampling.stratified(s1, 200, seed=42)  # only their pairs are needed; weights are those of all records
    truth = blocking.candidates(s1, pool, VIEWS, asked=asked).filter("cos_comb >= 0.9").select("s1_id", "t_id")
    chosen, needed, _ = sampling.sampled_dataset(s1, pool, truth, 200)
    return chosen.unionByName(needed).select("entity_id", "source", "country")


@query("synthetic_dataset")
def synthetic_dataset(spark, sf_dir):
    s1, pool, truth = synthetic.dataset(spark, 2_000)
    return s1.unionByName(pool).join(truth.withColumnRenamed("t_id", "entity_id"), "entity_id", "left")


@query("two_stage")
def two_stage(spark, sf_dir):
    """Both stages trained and applied; pairs of equal compact names in a country are the truth."""
    s1, pool = sides(spark, sf_dir)
    features = materialize(P.build_features(blocking.candidates(s1, pool, VIEWS), s1, pool, s1), "pairs")  # read by labels, training and prediction
    same = F.col("q_name_compact") == F.col("t_name_compact")
    features = learning.with_labels(features, features.filter(same & (F.col("hn_match") == 1)))
    true = features.groupBy("s1_id").agg(F.sum("label").alias("n_true"))
    e = s1.select(F.col("entity_id").alias("s1_id")).join(true, "s1_id", "left").fillna(0, ["n_true"])
    return learning.train(features, e).matches(features)


@query("gbt_oof")
def gbt_oof(spark, sf_dir):
    """Out-of-fold quality of labelled documents from plain text measures."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    df = docs.select(F.col("doc_id").cast("string").alias("s1_id"), F.length("text").alias("chars"), F.size(F.split("text", "\\s+")).alias("words"), F.length(F.regexp_replace("text", "[^#*$%&|!]", "")).alias("marks"), F.col("quality").alias("label"))
    out, _ = learning.out_of_fold(df, ["chars", "words", "marks"], "p", folds=2, trees=3)
    return out.select("s1_id", "label", "p")


LINKS = f"""(with s as (select * from {COMB}), o as (select *, row_number() over (partition by country, t_id order by cos desc, s1_id) = 1 as owner from {duck.top('s', 10)} x),
  d as (select *, max(case when owner then cos end) over (partition by country, s1_id) as best from o)
  select s1_id, array_to_string(list_sort(list(t_id)), ',') as ids from d where owner and cos >= 0.5 and cos >= 0.9 * best group by s1_id)"""


@query("link_records", f"select r.entity_id as source1_entity_id, coalesce(ids, '') as matched_entity_ids from (select entity_id from {RECORDS} r0 where source = 'S1') r left join {LINKS} l on l.s1_id = r.entity_id")
def link_records(spark, sf_dir):
    """Normalise, block by TF-IDF, keep one owner, decide, one row for each reference record."""
    s1, pool = sides(spark, sf_dir)
    both = s1.withColumn("side", F.lit("q")).unionByName(pool.withColumn("side", F.lit("t")))
    w = materialize(blocking.token_weights(both, VIEWS[0]), "weights-comb")
    best = blocking.best_pairs(w.filter("side = 'q'"), w.filter("side = 't'"), 10)
    chosen = decision.decide(decision.one_owner(best, "cos"), 0.5, 0.0, 0.9, "cos").filter("matched")
    return tables.one_row_each(s1, chosen)

