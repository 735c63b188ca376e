"""Near-duplicates by the Jaccard similarity of shingle sets, verified exactly.

Method. A text's distinct shingles (as in ``simhash``) are a set of 64-bit hashes;
equal sets are one class. BANDS x ROWS minimum hashes make BANDS keys, and classes
that share a key are candidates: a pair at the least similarity of 0.8 is missed
with chance (1 - 0.8 ** ROWS) ** BANDS, 5e-8. Candidates are verified on their whole
sets, in whole numbers. Sets are kept as 40 bits a shingle; two unlike shingles of two
texts of 10,000 words are taken for equal with chance 1e-4. Only the sets of classes
that share a bucket with another leave the table of sets.

Skew. Buckets with the same members are compared once. A bucket of more than BLOCK
members is split into blocks that are compared pair of blocks by pair of blocks in
separate tasks; a task emits a spanning set of links, never all pairs. No member is
left out and no pair of a bucket goes unverified unless it is connected already.

Edge cases: null, empty or wordless texts have no shingles, are alike and unlike any
other; a text of fewer words than a shingle is one shingle; repeated rows share their
class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import simhash
from kinlink.llm.components import components
from kinlink.llm.text import blobs, small_batches
from kinlink.sources.shared import materialize

SHINGLE = 5
#: Least similarity that links, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 4
SEED = 0x5EED
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
#: Shingles that are hashed at a time.
CHUNK = 1_024

_drawn = np.random.default_rng(SEED)
_TIMES = _drawn.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_PLUS = _drawn.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None]


def shingle_set(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of one UTF-8 text."""
    return np.unique(simhash.shingle_hashes(data, shingle))


def packed_set(found: np.ndarray) -> bytes:
    """The upper five bytes of each hash of a sorted set."""
    return found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpacked_set(packed: bytes) -> np.ndarray:
    """The hashes of a packed set, by their upper five bytes."""
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def band_keys(found: np.ndarray) -> np.ndarray:
    """BANDS keys of a set; none if it is empty."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        mixed = (found[None, at : at + CHUNK] * _TIMES + _PLUS) >> np.uint64(16)
        np.minimum(least, mixed.min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def shingle_sets(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, **carry) -> DataFrame:
    """(the ``carry`` columns, cls, keys, hashes): class, band keys and packed shingle set of every whole text."""
    small_batches(docs.sparkSession)
    picked = docs.select(*[c.alias(k) for k, c in carry.items()], F.col(text_col).cast("binary").alias("_text"))
    names = list(carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, keys, packed = [], [], []
            for data in blobs(batch.column(len(names))):
                found = shingle_set(data, shingle)
                packed.append(packed_set(found))
                cls.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                keys.append(band_keys(found))
            own = [pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *own], names=[*names, "cls", "keys", "hashes"])

    return picked.mapInArrow(run, f"{schema}, cls long, keys array<long>, hashes binary")


def spanning(cls: np.ndarray, right: np.ndarray, sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Links of one block (or of its left members with the right ones) that span its components."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    marked = np.zeros(len(codes), bool)
    label = np.arange(len(sets))
    links = []
    two = right.any()
    others = np.flatnonzero(right) if two else np.arange(len(sets))
    low = starts[others[0]] if two else 0
    high = (starts[others[-1]] + sizes[others[-1]]) if two else len(codes)
    for a in np.flatnonzero(~right):
        if (label[others] == label[a]).all():
            continue
        own = codes[starts[a] : starts[a] + sizes[a]]
        marked[own] = True
        common = np.add.reduceat(marked[codes[low:high]], starts[others] - low, dtype=np.int64)
        marked[own] = False
        near = others[common * (least[0] + least[1]) >= least[0] * (sizes[a] + sizes[others])]
        for b in near:
            if label[b] != label[a]:
                links.append((int(cls[a]), int(cls[b])))
                label[label == label[b]] = label[a]
    return links


def placed(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, i, j, right, cls): where the members (key, cls) of every bucket are compared."""
    same = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("cls")).alias("x")).filter("n > 1")
    once = same.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = members.join(once, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("bigint")).cast("int"))
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_left = F.transform(all_blocks, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(False).alias("right")))
    as_right = F.transform(all_blocks, lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(True).alias("right")))
    # block i against block j for i <= j; where they are one block, every member is on the left
    spread = F.concat(F.filter(as_left, lambda x: x["i"] <= x["j"]), F.filter(as_right, lambda x: x["i"] < x["j"]))
    return dealt.select("key", "cls", F.inline(spread))


def links(rows: DataFrame, least: tuple[int, int] = LEAST, block: int = BLOCK, scope: str = "default") -> DataFrame:
    """(a, b): links that span the components of the classes of ``rows`` (cls, keys, hashes), repeated or not."""
    classes = rows.select("cls", "keys").dropDuplicates(["cls"])
    places = materialize(placed(classes.select("cls", F.explode("keys").alias("key")), block), "places", scope)
    wanted = materialize(places.select("cls").distinct(), "wanted", scope)
    sets = rows.select("cls", "hashes").join(wanted, "cls", "left_semi").dropDuplicates(["cls"])
    found = places.join(sets, "cls").select("key", "i", "j", "right", "cls", "hashes")
    return compared(found, lambda cls, right, packed: spanning(cls, right, [unpacked_set(p) for p in packed], least))


def compared(rows: DataFrame, span: Callable[[np.ndarray, np.ndarray, list[bytes]], list[tuple[int, int]]]) -> DataFrame:
    """(a, b): what ``span`` links in each place of ``rows`` (key, i, j, right, cls and a binary column)."""
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "right", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        place = None

        def out(ended: list[list[tuple]]) -> pa.RecordBatch:
            found = []
            for rows in ended:
                right = np.array([r[0] for r in rows])
                if len(rows) > 1 and not right.all():
                    found += span(np.array([r[1] for r in rows], np.int64), right, [r[2] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            ended = []
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != place:
                    if held:
                        ended.append(held)
                    held, place = [], (key, i, j)
                held.append(tuple(row))
            if ended:
                yield out(ended)
        if held:
            yield out([held])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST, block: int = BLOCK, scope: str = "default") -> DataFrame:
    """(id, digest, root) of every row: ``digest`` is the text's, ``root`` one class for each component."""
    rows = shingle_sets(docs, text_col, shingle, **{id_col: F.col(id_col), "digest": simhash.digest(text_col)})
    rows = materialize(rows, "shingle-sets", scope)
    found = components(links(rows.filter(F.size("keys") > 0), least, block, scope), scope=scope)
    return rows.join(found, rows["cls"] == found["node"], "left").select(F.col(id_col), "digest", F.coalesce("root", "cls").alias("root"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST, block: int = BLOCK, scope: str = "default") -> DataFrame:
    """One document of each component, with all its columns (see ``simhash.firsts``)."""
    return simhash.firsts(docs, near_duplicates(docs, id_col, text_col, shingle, least, block, scope), id_col, text_col)


def linked_by_either(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST, block: int = BLOCK, scope: str = "default") -> DataFrame:
    """(id, digest, root) of every row: components under the links of near fingerprints (``simhash``) and of alike sets together.

    One graph holds both kinds of classes and an edge for each text that joins two of them,
    so components are searched once.
    """
    prints = materialize(simhash.fingerprints(docs, id_col, text_col, digests=True), "fingerprints", scope)
    sets = materialize(shingle_sets(docs, text_col, shingle, **{id_col: F.col(id_col), "digest": simhash.digest(text_col)}), "shingle-sets", scope)
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    both = sets.select(id_col, "digest", "cls").join(prints.select("digest", "fp").distinct(), "digest")
    both = materialize(both.select(F.col(id_col), "digest", node("1:", "fp").alias("a"), node("2:", "cls").alias("b")), "both", scope)
    near = simhash.links(prints.select("fp").distinct()).select(node("1:", "a").alias("a"), node("1:", "b").alias("b"))
    alike = links(sets.filter(F.size("keys") > 0), least, block, scope).select(node("2:", "a").alias("a"), node("2:", "b").alias("b"))
    found = components(near.union(alike).union(both.select("a", "b").distinct()), scope=scope)
    return both.join(found, F.col("a") == F.col("node")).select(F.col(id_col), "digest", "root")
