"""Line dedup with two Bloom filters.

Method. Lines are dealt to shards by their digests, and each shard has two Bloom
filters, one of lines seen once and one of lines seen again. The number of shards
follows the input (LINE_BITS filter bits for each expected line), so filters never
fill up and none is broadcast: a shard's task streams its digests into its filters,
and a second stream tests the shard's lines against the filter of repeats. Only the
lines that it suspects are shuffled for exact confirmation by 128-bit digest and for
the choice of the holder that keeps the line. An overfull filter (lines far shorter
than LINE_BYTES) only suspects more.

Skew. A task ships a line once, however many of its documents hold it: what it sees
again itself is suspected at once. So a line that a third of all documents hold is
one row a task at its shard and a combinable count in the confirmation; the join that
hands decisions back is a plain equi-join that adaptive execution may split. Texts
move once.

Edge cases: null and empty texts are one empty line; a document holds a key once
however often it repeats it, and all its lines with that key go; rows count as
documents, also repeated ones, and all rows with the largest id keep the line; a
null id is smaller than any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.text import SPACE, SPACE_BYTES, ascii_lower, blobs, carried, small_batches, unpacked
from kinlink.sources.shared import discard, materialize

MIN_CHARS = 20
MIN_DOCS = 3
#: Bits of each of a shard's filters.
SHARD_BITS = 1 << 23
#: Filter bits for each expected line, and bytes of text for each expected line.
LINE_BITS, LINE_BYTES = 8, 64
#: Distinct lines that a task holds before it ships them.
HELD_LINES = 300_000


def line_digests(data: bytes, min_chars: int = MIN_CHARS) -> set[bytes]:
    """Digests of the distinct keys of a text that are long enough."""
    keys = {line.strip(SPACE_BYTES).lower() for line in data.split(b"\n")}
    return {hashlib.md5(k).digest() for k in keys if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars)}


def _places(digests: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each digest and its three bits in a filter of its shard."""
    words = np.frombuffer(b"".join(blobs(digests)), dtype="<u4").reshape(-1, 4)
    return words[:, 0].astype(np.uint64) << np.uint64(32) | words[:, 1], words[:, 1:] % np.uint32(bits)


def _shipped(docs: DataFrame, shards: int, min_chars: int, id_col: str) -> DataFrame:
    """(shard, _id, digest, again): lines that a task has seen in one document, once each with it; lines that it has
    seen in more, once without it; and each holder of the latter as a suspect, in shard -1."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, object] = {}
        again: set[bytes] = set()

        def out(shard: list[int], ids: list, digests: list[bytes], repeated: list[bool], kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(ids, kind), pa.array(digests, pa.binary()), pa.array(repeated)], names=["shard", "_id", "digest", "again"])

        def ship(kind: pa.DataType) -> pa.RecordBatch:
            digests = list(first)
            shard = (np.frombuffer(b"".join(digests), "<u4").reshape(-1, 4)[:, 0] % np.uint32(shards)).tolist()
            repeated = [d in again for d in digests]
            return out(shard, [None if r else first[d] for d, r in zip(digests, repeated)], digests, repeated, kind)

        for batch in batches:
            kind, ids, suspects = batch.schema.field(0).type, [], []
            for k, data in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                for d in line_digests(data, min_chars):
                    if d not in first:
                        first[d] = k
                        continue
                    if d not in again:
                        again.add(d)
                        ids.append(first[d])
                        suspects.append(d)
                    ids.append(k)
                    suspects.append(d)
            if suspects:
                yield out([-1] * len(ids), ids, suspects, [True] * len(ids), kind)
            if len(first) > HELD_LINES:
                yield ship(kind)
                first.clear()
                again.clear()
        if first:
            yield ship(kind)

    return docs.select(F.col(id_col), F.col("_text")).mapInArrow(run, f"shard int, _id {id_type.simpleString()}, digest binary, again boolean")


def _spans(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal shards."""
    cuts = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a < b:
            yield int(shard[a]), slice(a, b)


def _second_filters(shipped: DataFrame, bits: int) -> DataFrame:
    """(shard, bits): compressed bitmaps of the lines seen again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())], names=["shard", "bits"])

        for batch in batches:
            again = batch.column(2).to_numpy(zero_copy_only=False)
            for s, span in _spans(batch.column(0).to_numpy()):
                if s != now:
                    if now is not None:
                        yield done()
                    now, once, twice = s, np.zeros(bits, bool), np.zeros(bits, bool)
                head, at = _places(batch.column(1)[span], bits)
                _, which, times = np.unique(head, return_inverse=True, return_counts=True)
                before = again[span] | (times[which] > 1) | once[at].all(axis=1)
                once[at] = True
                twice[at[before]] = True
        if now is not None:
            yield done()

    rows = shipped.filter("shard >= 0").select("shard", "digest", "again")
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, bits binary")


def _suspects(shipped: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """(_id, digest) of the lines that tasks or the second filters have seen again, once for each document."""
    id_type = shipped.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bitmap = None, None
        for batch in batches:
            for s, span in _spans(batch.column(0).to_numpy()):
                part = batch.slice(span.start, span.stop - span.start)
                if s != now:  # a shard's filter comes before its lines
                    now, bitmap = s, np.frombuffer(zlib.decompress(part.column(3)[0].as_py()), np.uint8)
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                _, at = _places(part.column(2), bits)
                hit = ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(hit)) for k in (1, 2)], names=["_id", "digest"])

    lines = shipped.filter("shard >= 0 and not again").select("shard", "_id", "digest", F.lit(None).cast("binary").alias("bits"))
    both = filters.select("shard", F.lit(None).cast(id_type).alias("_id"), F.lit(None).cast("binary").alias("digest"), "bits").union(lines)
    tested = both.repartition("shard").sortWithinPartitions("shard", F.col("bits").isNull()).mapInArrow(run, f"_id {id_type.simpleString()}, digest binary")
    return shipped.filter("shard < 0").select("_id", "digest").union(tested)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, scope: str = "default", bits: int = SHARD_BITS) -> DataFrame:
    """(_id, drops): the digests of the lines that each document loses."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    total = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = max(1, -(-total * LINE_BITS // (LINE_BYTES * bits)))
    shipped = materialize(_shipped(texts, shards, min_chars, id_col), "lines", scope)
    filters = materialize(_second_filters(shipped, bits), "filters", scope)
    suspects = materialize(_suspects(shipped, filters, bits), "suspects", scope)
    for done in (shipped, filters):
        discard(done)
    # written, so that both sides of the join are plain exchanges, whose hot digests Spark can split
    confirmed = materialize(suspects.groupBy("digest").agg(F.count("*").alias("n"), F.max("_id").alias("keeper")).filter(F.col("n") >= min_docs), "confirmed", scope)
    losers = suspects.join(confirmed, "digest").filter(~F.col("_id").eqNullSafe(F.col("keeper")))
    return losers.groupBy("_id").agg(F.collect_set("digest").alias("drops"))


def _kept(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, scope: str) -> DataFrame:
    drops = repeated_lines(docs, id_col, text_col, min_chars, min_docs, scope)
    df = carried(docs, _key=F.col(id_col), _text=F.coalesce(F.col(text_col), F.lit("")))
    df = df.join(drops, F.col("_key").eqNullSafe(F.col("_id")), "left")

    def stays(line: Column) -> Column:
        return ~F.array_contains("drops", F.unhex(F.md5(ascii_lower(F.btrim(line, F.lit(SPACE))))))

    lines = F.split("_text", "\n")
    df = df.withColumn("_kept", F.when(F.col("drops").isNotNull(), F.filter(lines, stays)))
    none = F.col("_kept").isNull()
    return df.withColumns(
        {
            "n_lines": F.size(lines).cast("bigint"),
            "n_dropped": F.when(none, F.lit(0)).otherwise(F.size(lines) - F.size("_kept")).cast("bigint"),
            "kept_text": F.when(none, F.col("_text")).otherwise(F.array_join("_kept", "\n")),
        }
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, scope: str = "default") -> DataFrame:
    """(id, n_lines, n_dropped, kept_text) of every document."""
    return _kept(docs, id_col, text_col, min_chars, min_docs, scope).select(F.col("_key").alias(id_col), "n_lines", "n_dropped", "kept_text")


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, scope: str = "default") -> DataFrame:
    """The documents with their kept text, columns as in ``docs``."""
    df = _kept(docs, id_col, text_col, min_chars, min_docs, scope)
    return unpacked(df.withColumn("_row", F.col("_row").withField(text_col, F.col("kept_text"))), docs.columns)
