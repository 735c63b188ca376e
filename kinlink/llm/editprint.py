"""Document fingerprints by randomised edit embedding.

Method. A text is embedded by WALKS shared random walks over its characters: at step
j the character under the pointer is written, and a bit that is drawn for (j,
character) decides whether the pointer moves on. Where two texts differ by an edit
their walks part, and fall in step again after few steps on the average, so edit
distance turns into Hamming distance between the embeddings. A fingerprint holds
sampled positions of them, one byte each (a hash of the character there and the next
three, so that unlike texts of one language rarely agree). Positions are drawn once for all texts: SAMPLES from each block of positions
[2^b - 1, 2^(b+1) - 1), in a fixed order, and a text whose walks end in block k takes
the first SAMPLES / 2^(k-b) of block b. So longer texts thin the same positions out,
and any two fingerprints can be compared where the longer one has a position; a walk
that has ended writes zeros. Likeness is one less the Hamming distance's share of
those where either walk still goes on, corrected for chance. Near pairs come from bands of BAND sampled
positions (also those at the next length, so that pairs astride of two lengths meet)
and are verified on all samples.

The walks of many texts advance together, one array step for each position, as long
as MANY of them go on; the few longest texts are walked one by one. So the work is in
proportion to the characters, however the lengths are spread.

Neighbours. ``with_neighbours`` deals texts to ranges of ids, compressed and once
each (the head of a range also goes to the range before it), and streams a sorted
range, so a third of all rows in one range is a stream, not a group in memory.

Edge cases: null and empty texts have no characters and the fingerprint of a zero
byte, alike only to itself; repeated rows and equal ids are ordered by text hash; ids
are integers, null ids come last; a single row is its own neighbour; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import cycle, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import jaccard
from kinlink.llm.components import components
from kinlink.llm.text import blobs, small_batches
from kinlink.sources.shared import materialize

WALKS, SAMPLES = 4, 16
#: Characters from the pointer on that a sample is a hash of.
CONTEXT = 4
#: Steps after which the shared bits come round again.
PERIOD = 4_096
#: Samples of a band, of which a band key is made.
BAND = 4
#: Texts that walk together, at least, and characters that are embedded at a time.
MANY, TOGETHER = 16, 1 << 22
SEED = 0x5EED
#: Rows of an id range, about, and ranges at most (the driver holds one id of each).
RANGE_ROWS, MOST_RANGES = 2_048, 100_000
#: Blocks of positions that texts can reach (2^32 steps).
_BLOCKS = 32
EMPTY = bytes(1)
_END = 255


@cache
def shared_bits() -> np.ndarray:
    """The walks' bits for each step and character class, one bit of a byte for each walk; the end stays."""
    bits = np.random.default_rng(SEED).integers(0, 1 << WALKS, (PERIOD, 256), dtype=np.uint8)
    bits[:, _END] = 0
    return bits


@cache
def drawn(block: int) -> list[int]:
    """The sampled positions of a block, in their order."""
    rng = np.random.default_rng((SEED, block))
    if 1 << block <= 4 * SAMPLES:
        offsets = rng.permutation(1 << block)[:SAMPLES].tolist()
    else:
        offsets = list(dict.fromkeys(rng.integers(0, 1 << block, 4 * SAMPLES).tolist()))[:SAMPLES]
    return [(1 << block) - 1 + x for x in offsets]


@cache
def places(top: int) -> list[tuple[int, int]]:
    """(block, number) of the samples of texts that end in block ``top``."""
    return [(b, i) for b in range(top + 1) for i in range(min(len(drawn(b)), SAMPLES >> (top - b)))]


@cache
def _seen_from(own: int, top: int) -> np.ndarray:
    """Where the samples of ``places(top)`` stand among those of ``places(own)``; after the last, where none does."""
    at = {x: k for k, x in enumerate(places(own))}
    return np.array([at.get(x, len(at)) for x in places(top)], np.int64)


def steps_of(n: int) -> int:
    """Steps within which the walks over n characters end (they take 2n on the average)."""
    return 2 * n + int(6 * n**0.5) + 4


def _walked(codes: list[np.ndarray]) -> list[bytes]:
    """Fingerprints of texts, given longest first and none empty."""
    n = np.array([len(c) for c in codes], np.int64)
    start = np.cumsum(n + CONTEXT) - n - CONTEXT  # end marks follow a text, so that no context reaches into the next
    flat = np.full(int((n + CONTEXT).sum()), 0x110000, np.uint32)
    inside = np.ones(len(flat), bool)
    for k in range(CONTEXT):
        inside[start + n + k] = False
    flat[inside] = np.concatenate(codes)
    kind = ((flat * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(_END)
    kind = np.where(inside, kind, _END).astype(np.uint8)
    here = np.zeros(len(flat) + CONTEXT, np.uint32)
    for k in range(CONTEXT):
        here[: len(flat) - k] = (here[: len(flat) - k] ^ flat[k:]) * np.uint32(0x85EBCA6B)
    here = here[: len(flat)] ^ (here[: len(flat)] >> np.uint32(15))
    here = np.where(inside, 1 + here % np.uint32(255), 0).astype(np.uint8)
    steps = np.array([steps_of(x) for x in n.tolist()], np.int64)
    top = np.array([x.bit_length() - 1 for x in steps.tolist()])
    marks = sorted({drawn(b)[i] for k in set(top.tolist()) for b, i in places(k)})
    found: dict[int, np.ndarray] = {}  # what the walks write at a sampled position
    bits, shifts = shared_bits(), np.arange(WALKS, dtype=np.uint8)[:, None]
    at = np.repeat(start[None, :], WALKS, axis=0)
    stop = int(steps[MANY - 1]) if len(n) >= MANY else 0
    wanted = set(marks)
    live = np.searchsorted(-steps, -np.arange(stop), side="left").tolist()
    for j in range(stop):
        m = live[j]
        if m < at.shape[1]:
            at = at[:, :m].copy()
        if j in wanted:
            found[j] = here[at]
        moved = bits[j % PERIOD].take(kind.take(at))
        moved >>= shifts
        moved &= 1
        at += moved
    late = [j for j in marks if j >= stop]
    if late:
        rows = [[((bits[j] >> w) & 1).tobytes() for j in range(PERIOD)] for w in range(WALKS)]
        for j in late:
            found[j] = np.zeros((WALKS, int(np.searchsorted(-steps, -j, side="left"))), np.uint8)
        for t in range(min(len(n), MANY) if stop else len(n)):
            text = kind[start[t] : start[t] + n[t] + 1].tobytes()
            for w in range(WALKS):
                j, i, end = stop, int(at[w, t] - start[t]) if t < at.shape[1] else 0, int(n[t])
                for mark in late:
                    if mark >= steps[t]:
                        break
                    for row in islice(cycle(rows[w]), j % PERIOD, j % PERIOD + mark - j):
                        i += row[text[i]]
                    j = mark
                    if i == end:
                        break
                    found[mark][w, t] = here[start[t] + i]
    out = []
    for k in sorted(set(top.tolist()), reverse=True):
        mine = np.flatnonzero(top == k)
        a, b = int(mine[0]), int(mine[-1]) + 1
        block = np.zeros((b - a, WALKS, len(places(k))), np.uint8)
        for p, (x, i) in enumerate(places(k)):
            got = found[drawn(x)[i]][:, a:b]
            block[: got.shape[1], :, p] = got.T
        out += [bytes([k + 1]) + row.tobytes() for row in block]
    return out


def prints(texts: list[str]) -> list[bytes]:
    """Fingerprints: the block where a text's walks end, plus one, and the samples of each walk."""
    once = dict.fromkeys(texts)
    codes = {t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in once if t}
    order = sorted(codes, key=lambda t: -len(codes[t]))
    done = {"": EMPTY} | (dict(zip(order, _walked([codes[t] for t in order]))) if order else {})
    return [done[t] for t in texts]


def seen(prints: list[bytes], top: int) -> np.ndarray:
    """Samples of fingerprints that end in block ``top`` or before, at the positions of ``places(top)``."""
    out = np.zeros((len(prints), WALKS, len(places(top))), np.uint8)
    for k, x in enumerate(prints):
        if x != EMPTY:
            own = np.pad(np.frombuffer(x, np.uint8)[1:].reshape(WALKS, -1), ((0, 0), (0, 1)))
            out[k] = own[:, _seen_from(x[0] - 1, top)]
    return out.reshape(len(prints), -1)


def _alike(view: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Likeness of rows of samples: the share of equal ones where a walk still goes on, corrected for chance."""
    held = ((view | other) != 0).sum(axis=-1)
    equal = ((view == other) & (view != 0)).sum(axis=-1) / np.maximum(held, 1)
    return np.maximum(0.0, (equal - 1 / 255) / (1 - 1 / 255))


def likeness(a: bytes, b: bytes) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    if EMPTY in (a, b):
        return 0.0
    x, y = seen([a, b], max(a[0], b[0]) - 1)
    return float(_alike(x, y))


def band_keys(print_: bytes) -> list[int]:
    """Keys of the bands of a fingerprint: at its own positions, those of its last block apart, and at the next length's."""
    if print_ == EMPTY:
        return []
    keys, own = [], print_[0] - 1
    for top in (own, own + 1):
        samples = seen([print_], top)[0].reshape(WALKS, -1)
        last = np.array([b == top for b, _ in places(top)])
        for part, which in enumerate((~last, last) if top == own else (~last,)):
            # walks and positions are mixed, so that a band's samples lie far apart
            values = samples[:, which].ravel()
            values = values[np.random.default_rng((SEED, top, part)).permutation(len(values))]
            cuts = ((k, values[k : k + BAND]) for k in range(0, len(values) - BAND + 1, BAND))
            keys += [xxhash.xxh64_intdigest(band.tobytes(), (top << 16) + (part << 12) + k) for k, band in cuts if band.any()]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def edited(text: str, following: str) -> str:
    """The text whose last third is replaced by the beginning of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print, keys) of every whole text: fingerprint and band keys."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            got = prints(texts)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(got, pa.binary()), pa.array(map(band_keys, got), pa.list_(pa.int64()))], names=[id_col, "print", "keys"])

        for batch in batches:
            ids.append(batch.column(0))
            texts += [data.decode("utf-8", "replace") for data in blobs(batch.column(1))]
            size += batch.column(1).nbytes
            if size >= TOGETHER:
                yield out()
                ids, texts, size = [], [], 0
        if texts:
            yield out()

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, f"`{id_col}` {id_type}, print binary, keys array<bigint>")


def _spanning(cls: np.ndarray, right: np.ndarray, prints: list[bytes], least: float) -> list[tuple[int, int]]:
    """Links of one block (or of its left members with the right ones) that span its components."""
    ends = np.array([x[0] - 1 for x in prints])
    views = {int(k): seen([x if x[0] - 1 <= k else EMPTY for x in prints], int(k)) for k in np.unique(ends)}
    others = np.flatnonzero(right) if right.any() else np.arange(len(cls))
    label, links = np.arange(len(cls)), []
    for a in np.flatnonzero(~right):
        for k, view in views.items():
            if k < ends[a]:
                continue
            now = others[(np.maximum(ends[others], ends[a]) == k) & (label[others] != label[a])]
            for b in now[_alike(view[now], view[a]) >= least] if len(now) else ():
                if label[b] != label[a]:
                    links.append((int(cls[a]), int(cls[b])))
                    label[label == label[b]] = label[a]
    return links


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, block: int = jaccard.BLOCK, scope: str = "default") -> DataFrame:
    """(id, group): documents whose fingerprints are linked by likeness of ``least`` or more.

    Equal fingerprints are one class. All classes that share a band are compared, block
    by block where many do; a task emits a spanning set of links.
    """
    rows = materialize(fingerprints(docs, id_col, text_col).withColumn("cls", F.xxhash64("print")), "prints", scope)
    classes = rows.select("cls", "print", "keys").dropDuplicates(["cls"])
    found = jaccard.placed(classes.select("cls", F.explode("keys").alias("key")), block).join(classes.select("cls", "print"), "cls").select("key", "i", "j", "right", "cls", "print")
    found = components(jaccard.compared(found, lambda cls, right, prints: _spanning(cls, right, prints, least)), scope=scope)
    out = rows.join(found, F.col("cls") == F.col("node"), "left")
    return out.select(id_col, F.coalesce("root", "cls").alias("group"))


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every text,
    its neighbour being the next one by descending id (after the last, the first)."""
    spark = docs.sparkSession
    small_batches(spark)
    lowest = -(2**63)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(lowest))
    ids = docs.select(key.alias("k"))
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    dealt = ids.repartitionByRange(ranges, F.col("k").desc()).groupBy(F.spark_partition_id()).agg(F.max("k").alias("head"))
    heads = np.array(sorted((r["head"] for r in dealt.collect()), reverse=True), np.int64)  # one number a range
    shared = spark.sparkContext.broadcast(heads)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = shared.value
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            place = len(heads) - np.searchsorted(heads[::-1], own, side="left") - 1  # heads not below the id, less one
            part, extra, keys, null, packed = [], [], [], [], []
            for k, p, missing, data in zip(own.tolist(), place.tolist(), batch.column(1).to_pylist(), blobs(batch.column(2))):
                z = squeeze.compress(data)
                copies = [(p, 0)]
                if k == heads[p]:
                    copies.append(((p - 1) % len(heads), 1))
                for at, x in copies:
                    part.append(at)
                    extra.append(x)
                    keys.append(k)
                    null.append(missing)
                    packed.append(z)
            tie = [xxhash.xxh64_intdigest(z) >> 1 for z in packed]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(extra, pa.int8()), pa.array(keys, pa.int64()), pa.array(tie, pa.int64()), pa.array(null, pa.bool_()), pa.array(packed, pa.binary())], names=["part", "extra", "k", "tie", "missing", "z"])

    rows = docs.select(key.alias("k"), F.col(id_col).isNull().alias("missing"), F.col(text_col).cast("binary").alias("_text"))
    rows = rows.mapInArrow(deal, "part int, extra byte, k long, tie long, missing boolean, z binary")
    rows = rows.repartition(ranges, "part").sortWithinPartitions("part", "extra", F.col("k").desc(), "tie")
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        held = None  # the last text that still waits for its neighbour

        def out(pairs: list[tuple]) -> pa.RecordBatch:
            texts = [p[2] for p in pairs]
            changed = [edited(p[2], p[3]) for p in pairs]
            found = prints([*texts, *changed, *(p[3] for p in pairs)])
            own, other, following = (found[k * len(pairs) : (k + 1) * len(pairs)] for k in range(3))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([None if p[1] else p[0] for p in pairs], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array([x.hex() for x in own]),
                    pa.array([x.hex() for x in other]),
                    pa.array([likeness(x, y) for x, y in zip(own, other)], pa.float64()),
                    pa.array([likeness(x, y) for x, y in zip(own, following)], pa.float64()),
                ],
                names=names,
            )

        pairs, size = [], 0
        for batch in batches:
            for part, extra, k, _, missing, z in zip(*(c.to_pylist() for c in batch.columns)):
                text = expand.decompress(z).decode("utf-8", "replace")
                if held is not None and held[0] == part:
                    pairs.append((held[1], held[2], held[3], text))
                    size += len(held[3])
                held = None if extra else (part, k, missing, text)
                if size >= TOGETHER:
                    yield out(pairs)
                    pairs, size = [], 0
        if pairs:
            yield out(pairs)

    found = rows.mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType))
