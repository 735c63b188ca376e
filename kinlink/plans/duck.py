"""SQL fragments of the text rules, for the DuckDB twins."""

from __future__ import annotations

from kinlink.functions import rules

WORDS = r"[\p{L}\p{N}_]+"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(to)}, 'g')"


def collapse(x: str) -> str:
    return f"trim({_sub(x, r'\s+', ' ')})"


def zeros(x: str) -> str:
    return _sub(x, "(^|[^0-9])0+([0-9])", r"\1\2")


def unaccented(x: str) -> str:
    return f"lower(strip_accents({x}))"


def website(x: str) -> str:
    return _sub(x, rules.WEBSITE, " ")


def junk(x: str) -> str:
    return _sub(x, rules.NAME_JUNK, " ")


def digit_letters(x: str) -> str:
    one = f"case when regexp_matches(w, '\\d') and length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) >= 2 and not regexp_matches(w, '{rules.ORDINAL}') then translate(w, '{rules.DIGITS}', '{rules.AS_LETTERS}') else w end"
    return f"array_to_string(list_transform(string_split({collapse(x)}, ' '), lambda w: {one}), ' ')"


def word_map(x: str, words: dict[str, str]) -> str:
    cases = " ".join(f"when {_quoted(k)} then {_quoted(v)}" for k, v in words.items())
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{WORDS}|[^\\p{{L}}\\p{{N}}_]+'), lambda w: case w {cases} else w end), '')"


def name_norm(x: str) -> str:
    x = zeros(junk(website(_sub(unaccented(f"coalesce({x}, '')"), "['’`]", ""))))
    x = digit_letters(_sub(_sub(x, r"\s*&\s*", " and "), r"[^\p{L}\p{N}_\s]", " "))
    return collapse(word_map(x, rules.NAME_WORDS))


def name_core(norm: str) -> str:
    return collapse(_sub(norm, r"\b(?:" + "|".join(rules.LEGAL_FORMS) + r")\b", " "))


def address_norm(x: str) -> str:
    x = zeros(unaccented(f"coalesce({x}, '')"))
    x = _sub(_sub(_sub(x, "['’`]", ""), r"\s*&\s*", " and "), r"[^\p{L}\p{N}_\s,]", " ")
    return collapse(word_map(x, rules.ADDRESS_WORDS))


def house_number(x: str) -> str:
    base = zeros(unaccented(x))
    part = f"list_filter(list_transform(string_split({base}, ','), lambda c: regexp_extract(c, {_quoted(rules.HOUSE_COMPONENT)}, 1)), lambda c: c <> '')[1]"
    got = f"coalesce(nullif(regexp_extract({base}, {_quoted(rules.HOUSE_EXPLICIT)}, 1), ''), nullif(regexp_extract({base}, {_quoted(rules.HOUSE_NO)}, 1), ''), {part}, '')"
    return _sub(got, r"\s+", "")


def key(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct(string_split({collapse(f"replace({x}, ',', ' ')")}, ' '))), ' ')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORDS}')"


def records() -> str:
    """The normalised record view."""
    from kinlink.plans.views import RECORDS

    return f"""
    (select *, replace(name_core, ' ', '') as name_compact, {collapse("name_norm || ' ' || replace(addr_norm, ',', ' ')")} as combined,
      {key("addr_norm")} as addr_key, {key("name_core")} as name_key
    from (select *, {name_core("name_norm")} as name_core from
      (select *, {name_norm("business_name")} as name_norm, {address_norm("business_address")} as addr_norm,
        {house_number("business_address")} as house_number, split_part(entity_id, '-', 1) as source from ({RECORDS}) r0) r1) r2)
    """


def weights(source: str, field: str, max_df: float, min_df: int = 2, tokens: str | None = None) -> str:
    """TF-IDF weights (country, side, entity_id, token, w) of a record source with those columns."""
    return f"""
    (with rec as (select * from {source}),
      tf as (select country, side, entity_id, token, count(*) as tf from (select country, side, entity_id, unnest({tokens or words(field)}) as token from rec) group by all),
      n as (select country, count(*) as n from rec group by all),
      df as (select country, token, count(*) as df from tf group by all),
      kept as (select df.*, n.n from df join n using (country) where df >= {min_df} and df <= greatest({max_df} * n, {min_df})),
      raw as (select tf.*, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as raw from tf join kept using (country, token))
    select country, side, entity_id, token, raw / sqrt(sum(raw * raw) over (partition by country, side, entity_id)) as w from raw)
    """


def scores(weights_sql: str) -> str:
    """Cosines (country, s1_id, t_id, cos) between sides q and t."""
    return f"""
    (with w as (select * from {weights_sql})
    select country, q.entity_id as s1_id, t.entity_id as t_id, round(sum(q.w * t.w), 9) as cos
    from w q join w t using (country, token) where q.side = 'q' and t.side = 't' group by all)
    """


def top(scores_sql: str, k: int) -> str:
    return f"(select * from {scores_sql} qualify row_number() over (partition by country, s1_id order by cos desc, t_id) <= {k})"
