"""Shared text conventions of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SPACE_BYTES = SPACE.encode()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in an Arrow batch that carries texts. Long documents make long rows.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Bound the texts that one Arrow batch holds (a session setting)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever the optimiser moves or copies."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of a text: maximal runs without white space; null gives none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return let(trimmed, lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def carried(docs: DataFrame, **columns: Column) -> DataFrame:
    """Pack all input columns into ``_row`` so that working columns can't clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[v.alias(k) for k, v in columns.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that :func:`carried` packed."""
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def blobs(column: pa.Array) -> Iterator[bytes]:
    """Bytes of a binary Arrow column, null as empty, without decoding."""
    for value in column:
        got = value.as_py()
        yield b"" if got is None else got
