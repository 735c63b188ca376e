"""URL filters: site rules, and pattern rules indexed by their rarest literal token.

Method. A pattern rule is a regular expression with the literal tokens (runs of
[a-z0-9]) that every match contains. How many URLs contain each literal is
counted over all rows; a rule is filed under its rarest one. A URL's distinct
tokens look their rules up, and only those rules run their expressions. Site
rules (host, path) are looked up by the suffixes of the host; the longest rule
that fits wins over any pattern. Everything happens within the row, without a
shuffle: the indexes are constant maps, at most MAX_RULES rules.

Edge cases: a null URL, or one without ``://``, has empty host and path, fits no
site rule and still meets the patterns; an empty table, or rules that nothing
fits, allow; repeated rows are judged alike.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.text import ascii_lower

MAX_RULES = 20_000


@dataclass(frozen=True)
class SiteRule:
    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class PatternRule:
    pattern: str
    literals: tuple[str, ...]
    verdict: str = "block"


#: Site rules of the contract.
SITE_RULES = (
    SiteRule("com", "/", "allow"),
    SiteRule("example.com", "/en/", "block"),
    SiteRule("www.example.com", "/en/", "allow"),
    SiteRule("net", "/es/", "block"),
    SiteRule("net", "/fr/", "block"),
)

#: Patterns over the lower-cased URL and the tokens that each match contains.
PATTERN_RULES = (
    PatternRule(r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule(r"://([^/?#]*\.)?casino-win\.", ("casino", "win")),
    PatternRule(r"://([^/?#]*\.)?free-bets\.", ("free", "bets")),
    PatternRule(r"://([^/?#]*\.)?ads-track\.", ("ads", "track")),
    PatternRule(r"://([^/?#]*\.)?doubleclick\.net([:/?#]|$)", ("doubleclick", "net")),
    PatternRule(r"://([^/?#]*[.-])?porn[.-]", ("porn",)),
    PatternRule(r"://([^/?#]*[.-])?xxx[.-]", ("xxx",)),
    PatternRule(r"://([^/?#]*[.-])?phishing[.-]", ("phishing",)),
    PatternRule(r"://([^/?#]*[.-])?malware[.-]", ("malware",)),
    PatternRule(r"/wp-login\.php([?#]|$)", ("wp", "login", "php")),
    PatternRule(r"/cgi-bin/", ("cgi", "bin")),
    PatternRule(r"\.exe([?#]|$)", ("exe",)),
    PatternRule(r"[?&]phpsessid=", ("phpsessid",)),
    PatternRule(r"[?&]jsessionid=", ("jsessionid",)),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    has = F.instr(url, "://") > 0
    after = F.regexp_replace(url, "(?s)^.*?://", "")
    host = F.regexp_extract(after, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(after, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, ascii_lower(host)).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct runs of [a-z0-9] of the lower-cased URL."""
    return F.array_distinct(F.filter(F.split(ascii_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def _constant_map(entries: dict[str, str]) -> Column:
    return F.from_json(F.lit("{" + ",".join(f"{_quoted(k)}:{_quoted(v)}" for k, v in entries.items()) + "}"), "map<string,string>")


def _quoted(text: str) -> str:
    return json.dumps(text)


def literal_counts(pages: DataFrame, rules: tuple[PatternRule, ...] = PATTERN_RULES, url_col: str = "url") -> dict[str, int]:
    """URLs that contain each literal of the rules, over all rows."""
    literals = sorted({t for r in rules for t in r.literals})
    if not literals:
        return {}
    wanted = F.array(*map(F.lit, literals))
    found = pages.select(F.explode(F.array_intersect(url_tokens(F.col(url_col)), wanted)).alias("t")).groupBy("t").count()
    return dict.fromkeys(literals, 0) | {t: n for t, n in found.collect()}


def rarest_index(rules: tuple[PatternRule, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by the rarest literal of each; ties go to the longer literal, then the first by name."""
    index: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        index.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(k)
    return index


def judge(pages: DataFrame, site_rules: tuple[SiteRule, ...] = SITE_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, pattern) of every URL; ``pattern`` is the number of the first pattern rule that matched."""
    if len(site_rules) + len(pattern_rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: their index is part of the plan")
    host, path = host_and_path(F.col(url_col))
    df = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), host.alias("host"), path.alias("path"))

    by_host: dict[str, list[SiteRule]] = {}
    for r in site_rules:
        by_host.setdefault(r.host, []).append(r)
    sites = _constant_map({h: "\n".join(f"{r.path} {r.verdict}" for r in rs) for h, rs in by_host.items()})
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    found = F.flatten(F.transform(suffixes, lambda h: F.transform(F.coalesce(F.split(F.element_at(sites, h), "\n"), F.array().cast("array<string>")), lambda x: F.struct(h.alias("h"), F.substring_index(x, " ", 1).alias("p"), F.substring_index(x, " ", -1).alias("v")))))
    fits = F.filter(found, lambda r: F.startswith(F.col("path"), r["p"]))
    best = F.array_sort(F.transform(fits, lambda r: F.struct((-F.length(r["h"]) - F.length(r["p"])).alias("n"), F.concat(r["h"], r["p"]).alias("rule"), r["v"].alias("v"))))
    df = df.withColumn("_site", F.get(best, 0))

    index = rarest_index(pattern_rules, literal_counts(pages, pattern_rules, url_col))
    by_token = _constant_map({t: ",".join(map(str, ks)) for t, ks in index.items()})
    patterns = F.split(F.lit("\n".join(r.pattern for r in pattern_rules)), "\n")
    verdicts = F.split(F.lit("\n".join(r.verdict for r in pattern_rules)), "\n")
    lower = ascii_lower(F.col("_url"))
    candidates = F.flatten(F.transform(url_tokens(F.col("_url")), lambda t: F.coalesce(F.split(F.element_at(by_token, t), ",").cast("array<int>"), F.array().cast("array<int>"))))
    df = df.withColumns({"_lower": lower, "_candidates": candidates})
    df = df.withColumn("pattern", F.array_min(F.filter("_candidates", lambda k: F.regexp_like(F.col("_lower"), F.get(patterns, k)))))
    verdict = F.coalesce(F.col("_site")["v"], F.get(verdicts, F.col("pattern")), F.lit("allow"))
    return df.select(F.col("_id").alias(id_col), "host", "path", F.col("_site")["rule"].alias("rule"), verdict.alias("verdict"), "pattern")


def allowed(pages: DataFrame, site_rules: tuple[SiteRule, ...] = SITE_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Ids whose URL is allowed."""
    return judge(pages, site_rules, pattern_rules, id_col, url_col).filter(F.col("verdict") == "allow").select(id_col)
