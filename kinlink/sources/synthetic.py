"""A seeded record-linkage dataset made from row numbers alone: any size, any partitioning, the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.sources.sampling import unit

PREFIXES = ("Summit", "Global", "Prime", "Evergreen", "Silver", "Royal", "Pacific", "Urban", "Nova", "Heritage", "Crystal", "Golden")
SECTORS = ("Solutions", "Logistics", "Foods", "Textiles", "Pharma", "Motors", "Builders", "Systems", "Traders", "Energy")
FORMS = {"US": ("Inc", "LLC", "Corporation"), "India": ("Pvt Ltd", "Private Limited", "LLP"), "France": ("SARL", "SAS", "SA")}
CITIES = {"US": ("Austin", "Denver", "Dayton"), "India": ("Surat", "Pune", "Indore"), "France": ("Lyon", "Nantes", "Lille")}
STREETS = {"US": "Commerce Way", "India": "Industrial Area", "France": "Rue de la Republique"}


def _pick(values: tuple[str, ...], key: Column, seed: int) -> Column:
    return F.get(F.split(F.lit("|".join(values)), "\\|"), F.floor(unit(key, seed=seed) * len(values)).cast("int"))


def _by_country(f) -> Column:
    out = None
    for c in FORMS:
        out = F.when(F.col("country") == c, f(c)) if out is None else out.when(F.col("country") == c, f(c))
    return out


def entities(spark: SparkSession, n: int, countries: tuple[str, ...] = tuple(FORMS), seed: int = 42) -> DataFrame:
    """(k, entity_id, business_name, business_address, country) of n clean entities."""
    df = spark.range(n).withColumnRenamed("id", "k")
    df = df.withColumn("country", _pick(countries, F.col("k"), seed))
    prefix, sector, number = _pick(PREFIXES, F.col("k"), seed + 1), _pick(SECTORS, F.col("k"), seed + 2), F.col("k").cast("string")
    form = _by_country(lambda c: _pick(FORMS[c], F.col("k"), seed + 3))
    city = _by_country(lambda c: _pick(CITIES[c], F.col("k"), seed + 4))
    street = _by_country(lambda c: F.lit(STREETS[c]))
    house = (100 + F.floor(unit("k", seed=seed + 5) * 900)).cast("string")
    name = F.when(F.col("country") == "France", F.concat_ws(" ", sector, prefix, number, form)).otherwise(F.concat_ws(" ", prefix, sector, number, form))
    address = F.when(F.col("country") == "India", F.concat(F.lit("Plot "), house, F.lit(", "), street, F.lit(", "), city)).otherwise(F.concat(house, F.lit(" "), street, F.lit(", "), city))
    return df.select("k", F.concat(F.lit("S1-"), number).alias("entity_id"), name.alias("business_name"), address.alias("business_address"), "country")


def _noisy_name(name: Column, key: Column, seed: int) -> Column:
    """A shorter or longer legal form, a doubled letter, or no legal form at all."""
    short = F.replace(F.replace(name, F.lit("Private Limited"), F.lit("Pvt Ltd")), F.lit("Corporation"), F.lit("Corp"))
    out = F.when(unit(key, seed=seed) < 0.7, short).otherwise(name)
    at = (2 + F.floor(unit(key, seed=seed + 1) * 6)).cast("int")
    typo = F.concat(F.substring(out, F.lit(1), at), F.substring(out, at, F.length(out)))
    out = F.when(unit(key, seed=seed + 2) < 0.3, typo).otherwise(out)
    return F.when(unit(key, seed=seed + 3) < 0.25, F.regexp_replace(out, " (Pvt Ltd|Private Limited|Inc|LLC|LLP|Corp|Corporation|SARL|SAS|SA)$", "")).otherwise(out)


def _noisy_address(address: Column, key: Column, seed: int) -> Column:
    out = F.when(unit(key, seed=seed) < 0.6, F.regexp_replace(F.regexp_replace(address, "Rue", "R"), "Area", "Ar.")).otherwise(address)
    out = F.when(unit(key, seed=seed + 1) < 0.3, F.concat(F.lit("Near City Bank, "), out)).otherwise(out)
    return F.when(unit(key, seed=seed + 2) < 0.2, F.regexp_replace(out, ", [A-Za-z]+$", "")).otherwise(out)


def dataset(spark: SparkSession, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(S1, pool, truth pairs): a quarter singletons, 45 in 100 with one match and the rest with one in
    each source, and a third as many distractors in each source."""
    clean = entities(spark, n, seed=seed)
    share = unit("k", seed=seed + 10)
    second = (share >= 0.25) & ((share < 0.475) | (share >= 0.7))
    third = (share >= 0.475)

    def source(tag: str, chosen: Column, shift: int) -> DataFrame:
        key = F.concat(F.lit(tag), F.col("k").cast("string"))
        matched = clean.filter(chosen).select(
            F.concat(F.lit(f"{tag}-"), F.col("k").cast("string")).alias("entity_id"),
            _noisy_name(F.col("business_name"), key, seed + shift).alias("business_name"),
            _noisy_address(F.col("business_address"), key, seed + shift + 5).alias("business_address"),
            "country",
            F.col("entity_id").alias("owner"),
        )
        other = entities(spark, n // 3, seed=seed + shift + 50).select(
            F.concat(F.lit(f"{tag}-9"), F.col("k").cast("string"), F.lit("x")).alias("entity_id"), F.concat(F.col("business_name"), F.lit(" Branch")).alias("business_name"), "business_address", "country", F.lit(None).cast("string").alias("owner")
        )
        return matched.unionByName(other)

    pool = source("S2", second, 100).unionByName(source("S3", third, 200))
    truth = pool.filter("owner is not null").select(F.col("owner").alias("s1_id"), F.col("entity_id").alias("t_id"))
    return clean.drop("k"), pool.drop("owner"), truth
