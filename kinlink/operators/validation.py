"""Rules for submitted id lists (matches and candidates)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLES = 5


@dataclass
class Findings:
    errors: dict[str, list[str]] = field(default_factory=dict)
    warnings: dict[str, list[str]] = field(default_factory=dict)

    @property
    def exit_code(self) -> int:
        return 1 if self.errors else 0


def parsed(lines: DataFrame) -> DataFrame:
    """(s1_id, ids, malformed) of raw ``value`` lines without the header."""
    tab = F.instr("value", "\t") > 0
    ids = F.filter(F.transform(F.split(F.substring_index("value", "\t", -1), ","), lambda x: F.btrim(x)), lambda x: x != "")
    return lines.select(F.when(tab, F.btrim(F.substring_index("value", "\t", 1))).alias("s1_id"), F.when(tab, ids).alias("ids"), (~tab).alias("malformed"))


def issues(rows: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, s1_id): one row for each broken rule of each list in ``rows`` (s1_id, ids, malformed).

    Rules: malformed, duplicate_row, duplicate_id, self_match, wrong_prefix, unknown_id
    (only with ``known``), missing_s1 and unexpected_s1 (against ``required``).
    """
    good = rows.filter("not malformed")
    flat = good.select("s1_id", F.explode("ids").alias("id"))

    def rule(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), "s1_id").distinct()

    s1 = F.startswith("id", F.lit("S1-"))
    other = F.startswith("id", F.lit("S2-")) | F.startswith("id", F.lit("S3-"))
    parts = [
        rule("malformed", rows.filter("malformed")),
        rule("duplicate_row", good.groupBy("s1_id").count().filter("count > 1")),
        rule("duplicate_id", good.filter(F.size("ids") != F.size(F.array_distinct("ids")))),
        rule("self_match", flat.filter(s1)),
        rule("wrong_prefix", flat.filter(~s1 & ~other)),
        rule("missing_s1", required.select("s1_id").distinct().join(good, "s1_id", "left_anti")),
        rule("unexpected_s1", good.join(required.select("s1_id").distinct(), "s1_id", "left_anti")),
    ]
    if known is not None:
        parts.append(rule("unknown_id", flat.filter(other).join(known.select(F.col("entity_id").alias("id")), "id", "left_anti")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1_id, ids): matched ids that are not among the candidates of the same query (a warning)."""
    joined = matches.select("s1_id", "ids").join(candidates.select("s1_id", F.col("ids").alias("c")), "s1_id", "left")
    extra = F.array_except("ids", F.coalesce("c", F.array().cast("array<string>")))
    return joined.select("s1_id", extra.alias("ids")).filter(F.size("ids") > 0)


def validate_files(spark: SparkSession, matches: str, required: DataFrame, candidates: str | None = None, known: DataFrame | None = None, strict: bool = False) -> Findings:
    """Findings about a match file and, if there is one, a candidate file, with a few examples each.

    A missing candidate file is a warning, or an error in ``strict`` mode.
    """
    out = Findings()
    tables = {}
    for kind, path, second in (("matches", matches, "matched_entity_ids"), ("candidates", candidates, "candidate_entity_ids")):
        missing = path is None
        if not missing:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            missing = not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        if missing:
            (out.errors if kind == "matches" or strict else out.warnings)[f"{kind}: no file"] = []
            continue
        lines = spark.read.text(path)
        head = lines.first()
        if head is None:
            out.errors[f"{kind}: empty file"] = []
            continue
        wanted = f"source1_entity_id\t{second}"
        if head[0].strip() != wanted:
            why = "comma-separated" if "\t" not in head[0] and "," in head[0] else "wrong header"
            out.errors[f"{kind}: {why}"] = [head[0]]
            continue
        rows = parsed(lines.filter((F.col("value") != head[0]) & (F.btrim("value") != "")))
        tables[kind] = rows.filter("not malformed")
        found = issues(rows, required, known).groupBy("rule").agg(F.slice(F.array_sort(F.collect_set(F.coalesce("s1_id", F.lit("?")))), 1, EXAMPLES).alias("s"))
        out.errors |= {f"{kind}: {r['rule']}": list(r["s"]) for r in found.collect()}
    if len(tables) == 2:
        extra = [r["s1_id"] for r in outside_candidates(tables["matches"], tables["candidates"]).orderBy("s1_id").limit(EXAMPLES).collect()]
        if extra:
            out.warnings["matches outside candidates"] = extra
    return out
