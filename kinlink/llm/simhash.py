"""SimHash near-duplicates by multi-index hashing.

Method. A text's words (ASCII-lower-cased) give SHINGLE-word shingles with
repeats; a fingerprint bit is set if it is set in over half of their XXH64
values. Equal fingerprints are one class. Distinct fingerprints are indexed in
one table for each of SEGMENTS segments; two fingerprints within MAX_BITS bits
agree in some segment, or each segment differs and then all but
MAX_BITS - SEGMENTS segments differ in exactly one bit; so balls of radius 1 in
MAX_BITS - SEGMENTS + 1 segments fetch every match that equal segments don't.
Values of even parity enumerate the ball (of two values at distance 1 one is
even). Complete distances are verified before a link counts. The search is exact.

Skew. Copies collapse into classes first. A segment value with more than BLOCK
members is split into blocks that are compared pair of blocks by pair of blocks
in separate tasks; a task emits a spanning set of links, never all pairs. With
three segments (21, 21 and 22 bits) a fingerprint emits 3 + 21 rows on average,
at every size of input.

Edge cases: null, empty or wordless texts have fingerprint zero and link like any
other; texts of fewer words than a shingle hash their whole sequence; repeated
rows share their class; a null id is never the smallest id, and a component that
has only null ids has component_id null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.components import components
from kinlink.llm.text import blobs, carried, small_batches, unpacked
from kinlink.sources.shared import materialize

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: (shift, width) of the segments of a fingerprint.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Segments for up to 7 bits.
FOUR_SEGMENTS = ((0, 16), (16, 16), (32, 16), (48, 16))
#: Members of one segment value that one task compares with as many others.
BLOCK = 1_024
#: Groups up to this size are verified for many groups at a time.
SMALL = 8


def shingle_hashes(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles of one UTF-8 text, with repeats; none without words."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([of(joined, SEED)], dtype="<u8")
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - shingle]]
    return np.array([of(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])], dtype="<u8")


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one UTF-8 text, unsigned."""
    values = shingle_hashes(data, shingle)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 16_384):
        part = values[at : at + 16_384]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * ones > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, digests: bool = False) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed 64-bit integer; with ``digests`` the text's digest too."""
    small_batches(docs.sparkSession)
    carry = {id_col: F.col(id_col)} | ({"digest": digest(text_col)} if digests else {})
    picked = docs.select(*[c.alias(k) for k, c in carry.items()], F.col(text_col).cast("binary").alias("_text"))
    names, schema = list(carry), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(data, shingle) for data in blobs(batch.column(len(names)))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(fp.view(np.int64))], names=[*names, "fp"])

    return picked.mapInArrow(run, f"{schema}, fp long")


def _keys(fp: np.ndarray, segments: tuple, balls: int, probes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Table keys (segment number above the value) and the fingerprints that they belong to."""
    keys, owners = [], []
    for s, (shift, width) in enumerate(segments[:balls] if probes else segments):
        value = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        if not probes:
            keys.append(value | np.uint64(s << 40))
            owners.append(fp)
            continue
        even = np.bitwise_count(value) % 2 == 0
        flips = np.uint64(1) << np.arange(width, dtype=np.uint64)
        keys.append(((value[even][:, None] ^ flips[None, :]) | np.uint64(s << 40)).ravel())
        owners.append(np.repeat(fp[even], width))
    return np.concatenate(keys), np.concatenate(owners)


def _members(classes: DataFrame, segments: tuple, balls: int) -> DataFrame:
    """(key, fp, probe): where each fingerprint stands in the tables, and what it looks up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 2_048):
                for probes in (False, True) if balls else (False,):
                    keys, owners = _keys(fp[at : at + 2_048], segments, balls, probes)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owners.view(np.int64)), pa.array(np.full(len(keys), probes))], names=["key", "fp", "probe"])

    return classes.select("fp").mapInArrow(run, "key long, fp long, probe boolean")


def _spanning(left: np.ndarray, right: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between ``left`` and ``right`` (and within left, if right is left) that span its components."""
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= most
    label = np.arange(len(left))
    none = len(left)
    while True:  # the smallest label that is reached by way of a right member
        of_right = np.where(near, label[:, None], none).min(axis=0)
        new = np.minimum(label, np.where(near, of_right[None, :], none).min(axis=1))
        if (new == label).all():
            break
        label = new
    linked = of_right < none
    return [(left[of_right[linked]], right[linked]), (left[label], left)]


def _compare(group: np.ndarray, fp: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups, sorted by group; right marks members that are only compared with the others."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, len(group)])
    big = np.repeat(sizes > SMALL, sizes)
    a, b = [], []
    g, f, r = group[~big], fp[~big], right[~big]
    for d in range(1, SMALL):
        if len(g) <= d:
            break
        ok = (g[:-d] == g[d:]) & ~(r[:-d] & r[d:]) & (np.bitwise_count(f[:-d] ^ f[d:]) <= most)
        a.append(f[:-d][ok])
        b.append(f[d:][ok])
    for at, n in zip(first[sizes > SMALL], sizes[sizes > SMALL]):
        f, r = fp[at : at + n], right[at : at + n]
        left = f[~r]
        if len(left):
            for other in ([f[r]] if r.all() else [left, f[r]]):
                if len(other):
                    for x, y in _spanning(left, other, most):
                        a.append(x)
                        b.append(y)
    if not a:
        return fp[:0], fp[:0]
    a, b = np.concatenate(a), np.concatenate(b)
    differ = a != b
    return a[differ], b[differ]


def links(classes: DataFrame, most: int = MAX_BITS, segments: tuple = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints ``fp`` within ``most`` bits."""
    if most >= 2 * len(segments):
        raise ValueError("more segments are needed: the balls have radius 1")
    members = _members(classes, segments, max(0, most - len(segments) + 1))
    hot = members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    hot = hot.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = members.join(hot, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks").cast("bigint")).cast("int"))
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_left = F.transform(all_blocks, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(False).alias("right")))
    as_right = F.transform(all_blocks, lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(True).alias("right")))
    spread = F.when(F.col("probe"), as_right).otherwise(F.concat(as_left, F.filter(as_right, lambda x: x["i"] < x["j"])))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("probe").alias("right")))
    places = F.when(F.col("blocks").isNull(), alone).otherwise(spread)
    placed = members.select("key", "fp", F.inline(places)).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "right", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            key, i, j, fp, right = parts
            group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            a, b = _compare(group, fp.view(np.uint64), right, most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)))
            parts = tuple(np.concatenate(x) for x in zip(*held))
            key, i, j = parts[:3]
            last = (key == key[-1]) & (i == i[-1]) & (j == j[-1])
            cut = len(key) - int(last.sum())
            held = [tuple(x[cut:] for x in parts)]
            if cut:
                yield out(tuple(x[:cut] for x in parts))
        if held:
            yield out(held[0])

    return placed.select("key", "i", "j", "fp", "right").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_BITS, shingle: int = SHINGLE, segments: tuple = SEGMENTS, scope: str = "default", digests: bool = False) -> DataFrame:
    """(id, fp, root, component_id) of every row: ``root`` is one fingerprint for each component,
    ``component_id`` the smallest id in it; with ``digests`` the text's digest too."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, digests), "fingerprints", scope)
    classes = rows.groupBy("fp").agg(F.min(id_col).alias("_least"))
    found = components(links(classes, most, segments), scope=scope)
    classes = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = classes.select("fp", "root").join(least, "root")
    return rows.join(classes, "fp").select(F.col(id_col), "fp", "root", "component_id", *(["digest"] if digests else []))


def digest(text_col: str = "text") -> Column:
    """Digest of a text; null as empty."""
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def firsts(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each root of ``found`` (id, digest, root): the smallest id, null last, then the
    smallest text digest; any of rows that are equal in both."""
    key = lambda i, d: F.concat(d, F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("")))
    best = found.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), "digest")).alias("f"))
    best = best.select(key(F.col("f.id"), F.col("f.digest")).alias("_first"))
    # the join leaves the rows dealt by their key, as the last step needs them: texts move once
    kept = carried(docs, _first=key(F.col(id_col), digest(text_col))).join(best.hint("merge"), "_first", "left_semi")
    return unpacked(kept.dropDuplicates(["_first"]), docs.columns)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_BITS, shingle: int = SHINGLE, segments: tuple = SEGMENTS, scope: str = "default") -> DataFrame:
    """One document of each component, with all its columns (see ``firsts``)."""
    return firsts(docs, near_duplicates(docs, id_col, text_col, most, shingle, segments, scope, digests=True), id_col, text_col)
