"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

from kinlink.llm import licenses, urlfilter

_SPACE = "\\x20\\x09-\\x0D"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+')"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _urls() -> str:
    """Every pattern is run on every URL here: the index must lose none."""
    sites = sorted(urlfilter.SITE_RULES, key=lambda r: -len(r.host) - len(r.path))
    fits = [f"WHEN (host = {_quoted(r.host)} OR ends_with(host, {_quoted('.' + r.host)})) AND starts_with(path, {_quoted(r.path)}) THEN" for r in sites]
    rule = "CASE " + " ".join(f"{f} {_quoted(r.host + r.path)}" for f, r in zip(fits, sites)) + " END"
    site = "CASE " + " ".join(f"{f} {_quoted(r.verdict)}" for f, r in zip(fits, sites)) + " END"
    pattern = "CASE " + " ".join(f"WHEN regexp_matches(low, {_quoted(r.pattern)}) THEN {k}" for k, r in enumerate(urlfilter.PATTERN_RULES)) + " END"
    by_pattern = "CASE pattern " + " ".join(f"WHEN {k} THEN {_quoted(r.verdict)}" for k, r in enumerate(urlfilter.PATTERN_RULES)) + " END"
    return f"""
        WITH cut AS (
            SELECT page_id, {_lower("coalesce(url, '')")} AS low,
                   CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), split AS (
            SELECT page_id, low, {_lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
        ), judged AS (
            SELECT page_id, host, path, {rule} AS rule, {site} AS site, CAST({pattern} AS INTEGER) AS pattern FROM split
        )
        SELECT page_id, host, path, rule, coalesce(site, {by_pattern}, 'allow') AS verdict, pattern FROM judged
    """


_LINES = f"""
    WITH split AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
        FROM documents
    ), keyed AS (
        SELECT *, {_lower(f"regexp_replace(line, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')")} AS k FROM split
    ), repeated AS (
        SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
    ), judged AS (
        SELECT doc_id, line, place, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM keyed LEFT JOIN repeated USING (k)
    )
    SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
"""


def _words_in_order(words: str, ahead: int) -> str:
    """(doc_id, i, w0, w1, ...): each word of a text with those that follow it."""
    following = ", ".join(f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS w{k}" for k in range(ahead))
    return f"SELECT doc_id, i, {following} FROM (SELECT doc_id, unnest({words}) AS w, generate_subscripts({words}, 1) - 1 AS i FROM documents)"


def _phrases() -> str:
    words = f"regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    here = lambda p: " AND ".join(f"w{k} = {_quoted(w)}" for k, w in enumerate(p.split()))
    label = "CASE " + " ".join(f"WHEN {here(p)} THEN {_quoted(name)}" for p, name in licenses.BASE) + " END"
    return f"""
        WITH found AS (
            SELECT doc_id, count(*) AS n, min(i) AS low, max(i) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
            FROM (SELECT doc_id, i, {label} AS label FROM ({_words_in_order(words, 3)})) WHERE label IS NOT NULL GROUP BY doc_id
        )
        SELECT doc_id, CAST(len({words}) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word,
               coalesce(labels, '') AS base_labels
        FROM documents LEFT JOIN found USING (doc_id)
    """


_COUNTS = f"""
    WITH windows AS (
        SELECT doc_id, i, concat_ws(' ', w0, w1, w2, w3, w4, w5, w6, w7) AS part FROM ({_words_in_order(_WORDS, 8)}) WHERE w7 IS NOT NULL
    ), again AS (
        SELECT doc_id, unnest(list(i)) AS i FROM windows GROUP BY doc_id, part HAVING count(*) > 1
    ), covered AS (
        SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM again) GROUP BY doc_id
    ), counted AS (
        SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words, CAST(length(array_to_string({_WORDS}, '')) AS BIGINT) AS word_chars,
               CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines, coalesce(n, 0) AS n_repeat_words
        FROM documents LEFT JOIN covered USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, coalesce(n_symbols, 0) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
           n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
    FROM counted
"""

#: A target is the level times the weight, stopped at the cap; the level rises until the sources that stop stay the same.
_TARGETS = f"""
    WITH RECURSIVE sized AS (
        SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents
    ), sources AS (
        SELECT source, sum(size) AS n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3] AS weight FROM sized GROUP BY source
    ), levels(round, level) AS (
        SELECT 0, (SELECT 1.5 * sum(n) / sum(weight) FROM sources)
        UNION ALL
        SELECT round + 1, (SELECT (1.5 * sum(n) - coalesce(sum(2 * n) FILTER (WHERE level * weight > 2 * n), 0)) / nullif(sum(weight) FILTER (WHERE level * weight <= 2 * n), 0) FROM sources)
        FROM levels WHERE round < 50 AND level IS NOT NULL
    )
    SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(CAST(least(2 * n, coalesce((SELECT level FROM levels ORDER BY round DESC LIMIT 1) * weight, 2 * n)) AS DOUBLE), 4) AS target
    FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source
"""

SQL = {"op6_url_filters": _urls(), "op9_line_dedup": _LINES, "license_phrases": _phrases(), "quality_counts": _COUNTS, "mix_targets": _TARGETS}
