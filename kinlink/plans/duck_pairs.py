"""SQL fragments of string similarities and pair features, for the DuckDB twins.

Similarities follow their definitions: windows, token sets and common subsequences
are spelled out, so they check the engine's shortcuts; nine digits count, as there. ``a`` and ``b`` must be names
(columns or lambda parameters); texts may have up to 120 characters.
"""

from __future__ import annotations

from itertools import count

from kinlink.plans import duck

_names = count()


def _let(value: str, body) -> str:
    """``body`` of a name that is bound to ``value``."""
    name = f"v{next(_names)}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def lcs_length(a: str, b: str) -> str:
    """Common subsequence by bit sets: a free bit for every character of a that is not matched yet."""
    f, m, c, i = (f"{x}{next(_names)}" for x in "fmci")
    full = f"(cast(pow(2, length({a})) as hugeint) - 1)"
    places = f"coalesce(list_sum(list_transform(range(length({a})), lambda {i}: case when substr({a}, {i} + 1, 1) = {c} then cast(pow(2, {i}) as hugeint) else 0::hugeint end)), 0)::hugeint"
    masks = f"list_transform(string_split({b}, ''), lambda {c}: {places})"
    free = f"list_reduce(list_concat([{full}], {masks}), lambda {f}, {m}: (({f} + ({f} & {m})) | ({f} - ({f} & {m}))) & {full})"
    return f"(length({a}) - bit_count({free}))"


def jaro_winkler(a: str, b: str) -> str:
    return f"round(jaro_winkler_similarity({a}, {b}), 9)"


def ratio(a: str, b: str) -> str:
    return f"(case when {a} = {b} then 100.0::double else round(200.0::double * {lcs_length(a, b)} / (length({a}) + length({b})), 9) end)"


def lcs(a: str, b: str) -> str:
    return f"(case when {a} = {b} then 1.0::double else round({lcs_length(a, b)}::double / greatest(length({a}), length({b})), 9) end)"


def _tokens(x: str) -> str:
    w = f"w{next(_names)}"
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda {w}: {w} <> '')"


def _joined(tokens: str) -> str:
    return f"array_to_string(list_sort({tokens}), ' ')"


def token_sort(a: str, b: str) -> str:
    return _let(_joined(_tokens(a)), lambda x: _let(_joined(_tokens(b)), lambda y: ratio(x, y)))


def token_set(a: str, b: str) -> str:
    """The best of the three ratios between the shared tokens and either side's own tokens after them."""

    def best(l: str, r: str) -> str:
        t = f"t{next(_names)}"
        own = lambda x, y: _joined(f"list_filter({x}, lambda {t}: not list_contains({y}, {t}))")
        shared = _joined(f"list_intersect({l}, {r})")
        return _let(shared, lambda s: _let(own(l, r), lambda x: _let(own(r, l), lambda y: three(s, x, y))))

    def three(s: str, x: str, y: str) -> str:
        with_own = lambda z: f"trim({s} || ' ' || {z})"
        near = lambda z: f"200.0::double * length({s}) / (length({s}) + length({z}))"
        found = _let(with_own(x), lambda p: _let(with_own(y), lambda q: f"case when {s} = '' then {ratio(p, q)} else greatest({ratio(p, q)}, {near(p)}, {near(q)}) end"))
        return f"case when {s} <> '' and ({x} = '' or {y} = '') then 100.0::double else {found} end"

    sets = _let(f"list_distinct({_tokens(a)})", lambda l: _let(f"list_distinct({_tokens(b)})", lambda r: f"case when len({l}) = 0 or len({r}) = 0 then 0.0::double else {best(l, r)} end"))
    return f"round({sets}, 9)"


def partial(a: str, b: str) -> str:
    """The best ratio of the shorter text and any window of the longer one, windows over the ends included."""

    def windows(short: str, long: str) -> str:
        e = f"e{next(_names)}"
        window = f"substr({long}, greatest({e} - length({short}), 0) + 1, {e} - greatest({e} - length({short}), 0))"
        return f"list_max(list_transform(range(1, length({long}) + length({short})), lambda {e}: {_let(window, lambda w: ratio(short, w))}))"

    one = f"case when length({a}) <= length({b}) then {windows(a, b)} else {windows(b, a)} end"
    both = f"case when length({a}) = length({b}) then greatest({windows(a, b)}, {windows(b, a)}) else {one} end"
    return f"(case when {a} = {b} then 100.0::double when {a} = '' or {b} = '' then 0.0::double else {both} end)"


def crc32(x: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    c, b, v, i = (f"{n}{next(_names)}" for n in "cbvi")
    step = f"list_reduce(list_concat([xor({c}, {b})], range(8)), lambda {v}, {i}: case when {v} & 1 = 1 then xor({v} >> 1, 3988292384) else {v} >> 1 end)"
    octets = f"list_transform(string_split({x}, ''), lambda {i}: ord({i})::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {octets}), lambda {c}, {b}: {step}), 4294967295)"


def unit(x: str, seed: int = 0) -> str:
    """The number in [0, 1) that decides samples: 32 bits of an MD5."""
    return f"(cast('0x' || substr(md5('{seed}|' || {x}), 1, 8) as bigint) / 4294967296.0::double)"


def stratified(source: str, n: int, seed: int = 0) -> str:
    """Rows of ``source`` (entity_id, country): the same share of every country."""
    return f"""(select * exclude (k, m, total) from (select *, row_number() over (partition by country order by {unit('entity_id', seed)}, entity_id) as k, count(*) over (partition by country) as m, count(*) over () as total from {source} s0) s1
  where k <= ceil(m * least(1.0::double, {n}::double / total)))"""


def masked(value: str, a: str, b: str) -> str:
    return f"case when {a} <> '' and {b} <> '' then {value} end"


def strings(source: str) -> str:
    """Rows of ``source`` (q_ and t_ columns of both records) with the string and set features."""
    made = {
        "name_jw": jaro_winkler("q_name_norm", "t_name_norm"),
        "name_lev": "1 - levenshtein(q_name_norm, t_name_norm) / greatest(length(q_name_norm), length(t_name_norm))",
        "name_lcs": lcs("q_name_norm", "t_name_norm"),
        "name_tset": f"{token_set('q_name_norm', 't_name_norm')} / 100",
        "name_tsort": f"{token_sort('q_name_norm', 't_name_norm')} / 100",
        "name_partial": f"{partial('q_name_norm', 't_name_norm')} / 100",
        "core_jw": masked(jaro_winkler("q_name_core", "t_name_core"), "q_name_core", "t_name_core"),
        "core_tset": masked(f"{token_set('q_name_core', 't_name_core')} / 100", "q_name_core", "t_name_core"),
        "core_exact": "cast(q_name_core = t_name_core and q_name_core <> '' as int)",
        "compact_partial": masked(f"{partial('q_name_compact', 't_name_compact')} / 100", "q_name_compact", "t_name_compact"),
        "compact_ratio": masked(f"{ratio('q_name_compact', 't_name_compact')} / 100", "q_name_compact", "t_name_compact"),
        "compact_exact": "cast(q_name_compact = t_name_compact and q_name_compact <> '' as int)",
        "addr_jw": masked(jaro_winkler("q_addr_norm", "t_addr_norm"), "q_addr_norm", "t_addr_norm"),
        "addr_lcs": masked(lcs("q_addr_norm", "t_addr_norm"), "q_addr_norm", "t_addr_norm"),
        "addr_tset": masked(f"{token_set('q_addr_norm', 't_addr_norm')} / 100", "q_addr_norm", "t_addr_norm"),
        "addr_tsort": masked(f"{token_sort('q_addr_norm', 't_addr_norm')} / 100", "q_addr_norm", "t_addr_norm"),
        "addr_missing": "cast(t_addr_norm = '' as int)",
        "hn_match": "case when q_house_number = '' or t_house_number = '' then 0 when q_house_number = t_house_number then 1 else -1 end",
        "name_len_ratio": "least(length(q_name_norm), length(t_name_norm)) / nullif(greatest(length(q_name_norm), length(t_name_norm)), 0)",
        "addr_len_ratio": masked("least(length(q_addr_norm), length(t_addr_norm)) / greatest(length(q_addr_norm), length(t_addr_norm))", "q_addr_norm", "t_addr_norm"),
        "is_s2": "cast(t_id like 'S2-%' as int)",
    }
    parts = lambda x: f"list_distinct(list_filter(list_transform(string_split({x}, ','), lambda c: trim(c)), lambda c: c <> ''))"
    digits = lambda x: f"list_distinct(regexp_extract_all({x}, '\\b(\\d+[a-z]?)\\b', 1))"
    made |= {
        "comp_ov_s1": "len(list_intersect(qp, tp)) / nullif(len(qp), 0)",
        "comp_ov_t": "len(list_intersect(qp, tp)) / nullif(len(tp), 0)",
        "num_jacc": "len(list_intersect(qd, td)) / nullif(len(list_distinct(list_concat(qd, td))), 0)",
        "num_conflict": "cast(len(qd) > 0 and len(td) > 0 and len(list_intersect(qd, td)) = 0 as int)",
    }
    sets = f"(select *, {parts('q_addr_norm')} as qp, {parts('t_addr_norm')} as tp, {digits('q_addr_norm')} as qd, {digits('t_addr_norm')} as td from {source})"
    return "(select * exclude (qp, tp, qd, td), " + ", ".join(f"{v} as {k}" for k, v in made.items()) + f" from {sets} z)"


SIDE = ("name_norm", "name_core", "name_compact", "addr_norm", "house_number", "addr_key", "name_key")


def joined(pairs: str, records: str) -> str:
    """Pairs with the columns of both their records."""
    cols = ", ".join(f"q.{c} as q_{c}, t.{c} as t_{c}" for c in SIDE)
    return f"(select p.*, {cols} from {pairs} p join {records} q on q.entity_id = p.s1_id join {records} t on t.entity_id = p.t_id)"


def context(score: str) -> str:
    """Rank and gaps of a score within its query; a missing score counts as -1."""
    v = f"coalesce({score}, -1)"
    second = f"coalesce(nth_value({v}, 2) over (partition by country, s1_id order by {v} desc, t_id rows between unbounded preceding and unbounded following), -1)"
    best = f"max({v}) over (partition by country, s1_id)"
    rank = f"rank() over (partition by country, s1_id order by {v} desc)"
    return f"{rank} as {score}_rank, {best} - {v} as {score}_gap_best, case when {v} >= {best} then {v} - {second} else {v} - {best} end as {score}_gap_second"


def features(pairs: str, records: str) -> str:
    """All stage-1 columns of ``pairs`` (country, s1_id, t_id, cos_comb, cos_name)."""

    def mass(field: str, p: str) -> str:
        return f"""tok_{p} as (select country, entity_id, unnest(list_distinct({duck.words(field)})) as token from rec),
  idf_{p} as (select country, token, ln((1 + n) / (1 + count(*))) + 1 as idf from tok_{p} join (select country, count(*) as n from rec group by all) using (country) group by country, token, n),
  own_{p} as (select entity_id, token, idf from tok_{p} join idf_{p} using (country, token)), mass_{p} as (select entity_id, sum(idf) as m from own_{p} group by all),
  shared_{p} as (select s1_id, t_id, sum(q.idf) as s, max(q.idf) as mx from pairs join own_{p} q on q.entity_id = s1_id join own_{p} t on t.entity_id = t_id and t.token = q.token group by all),
  idfs_{p} as (select s1_id, t_id, coalesce(s, 0) as {p}_idf_shared, coalesce(mx, 0) as {p}_idf_max_shared, coalesce(s, 0) / a.m as {p}_idf_cov_s1, coalesce(s, 0) / b.m as {p}_idf_cov_t, a.m - coalesce(s, 0) as {p}_idf_miss_s1, b.m - coalesce(s, 0) as {p}_idf_miss_t
    from pairs left join shared_{p} using (s1_id, t_id) left join mass_{p} a on a.entity_id = s1_id left join mass_{p} b on b.entity_id = t_id),"""

    scores = ", ".join(context(s) for s in ("cos_comb", "cos_name", "name_tset", "addr_tset"))
    return f"""(with rec as materialized (select * from {records}), pairs as materialized (select * from {pairs}), texts as materialized (select * from {strings(joined('pairs', 'rec'))}),
  {mass('name_norm', 'name')} {mass('addr_norm', 'addr')}
  s1 as (select *, case when name_compact = '' then 0 else count(*) over (partition by country, name_compact) - 1 end as n_rival_compact, case when name_key = '' then 0 else count(*) over (partition by country, name_key) - 1 end as n_rival_tokens from rec where source = 'S1'),
  grp as (select * from s1 where name_compact <> '' qualify row_number() over (partition by country, name_compact order by entity_id) <= 21),
  met as (select x.s1_id, x.t_id, x.t_name_norm, x.t_addr_norm, g.name_norm as rn, g.addr_norm as ra from texts x join grp g on g.country = x.country and g.name_compact = x.q_name_compact and g.entity_id <> x.s1_id),
  riv as (select s1_id, t_id, max(case when t_addr_norm <> '' then {token_set('t_addr_norm', 'ra')} / 100 end) as rival_addr_best, max({token_set('t_name_norm', 'rn')} / 100) as rival_name_best from met group by all),
  twin as (select entity_id, n as t_compact_twins from (select *, count(*) over (partition by country, name_compact) as n from rec where source <> 'S1' and length(name_compact) >= 6) where n between 2 and 20),
  made as (select x.*, a.* exclude (s1_id, t_id), b.addr_idf_max_shared, b.addr_idf_cov_s1, b.addr_idf_cov_t, s1.n_rival_compact, s1.n_rival_tokens, rival_addr_best, rival_name_best, coalesce(addr_tset, 0) - rival_addr_best as self_minus_rival_addr,
    coalesce(t_compact_twins, 1) as t_compact_twins, greatest(cos_comb, cos_name) as cos_max, (cos_comb + cos_name) / 2 as cos_mean
  from texts x join idfs_name a using (s1_id, t_id) join idfs_addr b using (s1_id, t_id) join s1 on s1.entity_id = x.s1_id left join riv using (s1_id, t_id) left join twin on twin.entity_id = x.t_id)
  select *, 0 as expanded, count(*) over (partition by country, s1_id) as n_cands, {scores} from made)"""


def siblings(rows: str) -> str:
    """(country, s1_id, t_id, sib_..., confidence columns) of ``rows`` with t_ columns and p1."""
    same = lambda c: f"(x.{c} = a.{c} and x.{c} <> '')"
    sure = lambda cond: f"sum(case when a.p1 >= 0.5 and {cond} then 1 else 0 end)::bigint"
    most = lambda cond: f"max(case when {cond} then a.p1 else 0 end)"
    made = {
        "sib_name_wmax": "max(a.p1 * n)",
        "sib_addr_wmax": "max(a.p1 * ad)",
        "sib_name_conf_max": "max(case when a.p1 >= 0.5 then n else 0 end)",
        "sib_addr_conf_max": "max(case when a.p1 >= 0.5 then ad else 0 end)",
        "sib_addr_eq_conf": sure(same("t_addr_norm")),
        "sib_compact_eq_conf": sure(same("t_name_compact")),
        "sib_name_hi_conf": sure("n >= 0.9"),
        "sib_addr_hi_conf": sure("ad >= 0.9"),
        "sib_addrkey_eq_conf": sure(same("t_addr_key")),
        "sib_addrkey_eq_wmax": most(same("t_addr_key")),
        "sib_namekey_eq_conf": sure(same("t_name_key")),
        "sib_namekey_eq_wmax": most(same("t_name_key")),
        "sib_hn_eq_conf": sure(same("t_house_number")),
        "sib_hn_eq_wmax": most(same("t_house_number")),
        "sib_hn_conflict_conf": sure("x.t_house_number <> '' and a.t_house_number <> '' and x.t_house_number <> a.t_house_number"),
    }
    for c in ("x", "a"):
        made = {k: v.replace(f"{c}.t_", f"{c}_t_").replace(f"{c}.p1", f"{c}_p1") for k, v in made.items()}
    texts = ("t_name_norm", "t_addr_norm", "t_name_compact", "t_addr_key", "t_name_key", "t_house_number", "p1")
    both = ", ".join(f"x.{c} as x_{c}, a.{c} as a_{c}" for c in texts)
    found = f"""select country, s1_id, t_id, {', '.join(f'{v} as {k}' for k, v in made.items())} from
    (select *, {token_set('x_t_name_norm', 'a_t_name_norm')} / 100 as n, {token_set('x_t_addr_norm', 'a_t_addr_norm')} / 100 as ad from
      (select x.country, x.s1_id, x.t_id, {both} from ranked x join ranked a on a.country = x.country and a.s1_id = x.s1_id and a.r <= 5 and a.r <> x.r)) group by all"""
    zeros = ", ".join(f"coalesce({k}, 0) as {k}" for k in made)
    is_s2 = "t_id like 'S2-%'"
    return f"""(with ranked as materialized (select *, row_number() over (partition by country, s1_id order by p1 desc, t_id) as r from {rows}), found as ({found}),
  c as (select country, s1_id, t_id, p1, r as p1_rank, case when r = 1 then coalesce(nth_value(p1, 2) over o, 0) else max(p1) over w end as p1_best_other, sum(cast(p1 >= 0.5 as int)) over w as n_conf, sum(p1) over w as sum_p1,
    sum(cast(p1 >= 0.5 and {is_s2} as int)) over w as n_conf_s2, sum(cast(p1 >= 0.5 and not {is_s2} as int)) over w as n_conf_s3 from ranked
    window w as (partition by country, s1_id), o as (partition by country, s1_id order by p1 desc, t_id rows between unbounded preceding and unbounded following))
  select country, s1_id, t_id, {zeros}, p1_rank, p1_best_other, p1 - p1_best_other as p1_gap_best_other, n_conf::bigint as n_conf, sum_p1, n_conf_s2::bigint as n_conf_s2, n_conf_s3::bigint as n_conf_s3,
    (case when {is_s2} then n_conf_s2 else n_conf_s3 end - cast(p1 >= 0.5 as int))::bigint as n_conf_same_source_other
  from c left join found using (country, s1_id, t_id))"""
