"""Streaming use of the record operators: normalisation and probing of a fixed reference are row-wise or
stream-static joins, so they run unchanged on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinlink.operators.records import normalize_records
from kinlink.sources.tables import RECORD


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """New tab-separated record files of a folder, as a stream."""
    return spark.readStream.csv(path, sep="\t", header=True, quote="", schema=RECORD)


def normalized_stream(raw: DataFrame, words: dict[str, str] | None = None) -> DataFrame:
    return normalize_records(raw, words)


def exact_links(stream: DataFrame, reference: DataFrame, key: str = "name_compact") -> DataFrame:
    """(country, s1_id, t_id): stream records whose non-empty key a reference record of the country has."""
    known = reference.filter(F.col(key) != "").select("country", F.col("entity_id").alias("s1_id"), F.col(key).alias("_k"))
    return stream.withColumnRenamed(key, "_k").filter("_k <> ''").join(known, ["country", "_k"]).select("country", "s1_id", F.col("entity_id").alias("t_id"))


def start_links(links: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append links to Parquet; what a batch finds is written exactly once."""
    return links.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
