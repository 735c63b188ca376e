"""Normalised records: the frame-level driver of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions import text as T

RAW = ("entity_id", "business_name", "business_address", "country")


def normalize_records(raw: DataFrame, words: dict[str, str] | None = None) -> DataFrame:
    """Raw records (entity_id, business_name, business_address, country) with their normal forms.

    Missing source columns count as empty; missing values become '' and never null, but
    ``country``, the partition label, stays as it is (``country_clean`` is trimmed and lower-cased).
    """
    for c in RAW:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    df = raw.withColumns({"name_norm": T.name_norm(F.col("business_name"), words), "_base": T.address_base(F.col("business_address")), "addr_missing": T.is_missing_address(F.col("business_address"))})
    df = df.withColumns(
        {
            "name_core": T.strip_legal_forms(F.col("name_norm")),
            "addr_norm": T.address_norm(F.col("_base")),
            "landmark": T.landmark(F.col("_base")),
            "house_number": T.house_number(T.strip_leading_zeros(F.col("_base"))),
            "source": F.substring_index("entity_id", "-", 1),
            "country_clean": F.lower(F.btrim("country")),
        }
    )
    df = df.withColumns({"name_compact": F.replace("name_core", F.lit(" "), F.lit("")), "combined": T.collapse_spaces(F.concat_ws(" ", "name_norm", F.replace("addr_norm", F.lit(","), F.lit(" ")))), "addr_key": T.order_free_key(F.col("addr_norm")), "name_key": T.order_free_key(F.col("name_core"))})
    return df.select("country", "entity_id", "source", "name_norm", "name_core", "name_compact", "addr_norm", "addr_missing", "landmark", "house_number", "combined", "addr_key", "name_key", "country_clean")
