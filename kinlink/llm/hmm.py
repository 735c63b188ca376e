"""LM scoring with a hidden Markov model.

Model. A text is a sequence of word tokens and one end token. A hidden chain of
STATES states emits one symbol a token: each of the FREQUENT most frequent words
has a symbol of its own, every other word falls in one of CLASSES classes by its
last bytes, and the end has a symbol. Within a class the word is drawn by smoothed
corpus counts (c + 0.5) / (C + 0.5 (W + 1)), C and W being the class's tokens and
distinct words, with one unseen outcome a class. So a text's probability is the
chain's exact likelihood of its symbols, times its words given their classes:
a proper distribution over known words and one unseen outcome a class.

Training. Word counts cover every training token and stay in a distributed table
that grows with the corpus. Baum-Welch covers every training document: tasks sum
expected counts over their rows, the sums meet by symbol, and the driver holds
only symbols x states. Expected counts add as integers, so order doesn't matter.

Long texts. Sequences are cut into chunks that advance together; a chunk of a
longer sequence first yields its transfer matrix, which carries the forward and
backward vectors from chunk to chunk exactly. A sequence of more than WINDOW tokens
goes window by window, both vectors carried on, in scoring and in training. So
nothing is truncated and no loop runs over the tokens of one text.

Skew. The most frequent words, at most TABLED of them, are scored from a broadcast
table; a histogram of the counts tells from which count on they are that few, so
the driver sees this table and nothing more, whatever the input. Only the others,
distinct for each document, meet the count table in a shuffle. A word of more than
KEY_BYTES bytes goes by its digest and last bytes, so no key is long.

Edge cases: null and empty texts are the end token alone; no training rows give
uniform symbols; rows are kept apart by an own row number, so repeated ids are
scored row by row; a null id trains as if its text were empty.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.text import blobs, small_batches
from kinlink.sources.shared import materialize

STATES = 8
FREQUENT, CLASSES = 16_384, 4_096
#: Words in the broadcast table of counts, at most, and bytes of a word that is its own key.
TABLED, KEY_BYTES = 131_072, 32
#: Training rounds, and emissions of the unigram distribution that are added to each state.
ROUNDS, PRIOR = 5, 256.0
#: Tokens of a chunk and of a batch of chunks that advance together, and steps between scalings.
CHUNK, TOGETHER, SCALED = 16_384, 1 << 20, 8
#: Tokens of a text that are held as arrays at a time.
WINDOW = 1 << 20
#: Bytes of text that are split at a time, and distinct words that a counting task holds.
SPLIT_BYTES, HELD_WORDS = 1 << 22, 200_000
SCALE = 1 << 16


def key_of(word: bytes) -> bytes:
    """What a word goes by: itself, or for a long one its digest (after a byte that no text holds) and last bytes."""
    return word if len(word) <= KEY_BYTES else b"\xff" + hashlib.md5(word).digest() + word[-3:]


def class_of(key: bytes) -> int:
    """Class of a word that has no symbol of its own, by its last three bytes and whether it is longer."""
    return zlib.crc32(key[-3:] + (b"+" if len(key) > 3 else b"")) % CLASSES


def _class_column() -> Column:
    """``class_of`` of the column ``word``."""
    longer = F.when(F.octet_length("word") > 3, F.lit("+")).otherwise(F.lit("")).cast("binary")
    return (F.crc32(F.concat(F.substring("word", -3, 3), longer)) % CLASSES).cast("int")


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of a text: split at white space, A-Z lower-cased. Gives how many words each text has, which
    of the distinct ones they are, and the keys of the distinct words."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(bare)
    words = lists.flatten()
    n = np.diff(lists.offsets.to_numpy())
    empty = pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # an empty text splits into one empty word
        n = n - empty
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    coded = words.dictionary_encode()
    distinct = coded.dictionary.view(pa.binary())
    long = np.flatnonzero(pc.greater(pc.binary_length(distinct), KEY_BYTES).to_numpy(zero_copy_only=False))
    if len(long):
        keys = distinct.to_pylist()
        for k in long.tolist():
            keys[k] = key_of(keys[k])
        distinct = pa.array(keys, pa.binary())
    return n, coded.indices.to_numpy(), distinct


def _gathered(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches of about SPLIT_BYTES bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= SPLIT_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all words of a column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _gathered(batches, 0):
            _, which, distinct = split(batch.column(0))
            now = pa.table({"word": distinct, "n": pa.array(np.bincount(which, minlength=len(distinct)), pa.int64())})
            held = now if held is None else pa.concat_tables([held, now])
            held = held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            if held.num_rows > HELD_WORDS:
                yield from held.to_batches(max_chunksize=65_536)
                held = None
        if held is not None:
            yield from held.to_batches(max_chunksize=65_536)

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words from the count on from which they are at most ``most``, by count and word."""
    octave = F.floor(F.log2("n"))
    # exact up to 4,096, then 256 steps an octave: at most some 18,000 rows, whatever the input
    step = F.when(F.col("n") < 4_096, F.col("n")).otherwise(F.floor(F.col("n") / F.pow(F.lit(2.0), octave - 8)) * F.pow(F.lit(2.0), octave - 8)).cast("bigint")
    seen, least = 0, None
    for low, kinds in sorted(counts.groupBy(step.alias("low")).agg(F.count("*").alias("kinds")).collect(), reverse=True):
        seen += kinds
        if seen > most:
            break
        least = low
    if least is None:
        return []
    found = counts.filter(F.col("n") >= least).select("word", "n").collect()
    return sorted(((bytes(w), n) for w, n in found), key=lambda x: (-x[1], x[0]))


class Chain:
    """A hidden Markov chain over symbols, as arrays: state STATES is the place before a text."""

    def __init__(self, moves: np.ndarray, emits: np.ndarray):
        self.moves, self.emits = moves, emits  # (S+1) x (S+1), symbols x (S+1)

    @staticmethod
    def first(unigram: np.ndarray, seed: int = 7) -> Chain:
        """Unlike states near the unigram distribution, each slow to change."""
        rng = np.random.default_rng(seed)
        s = STATES
        emits = np.zeros((len(unigram), s + 1))
        emits[:, :s] = unigram[:, None] * rng.gamma(2.0, 0.5, (len(unigram), s))
        emits[:, :s] /= emits[:, :s].sum(axis=0)
        moves = np.zeros((s + 1, s + 1))
        moves[:s, :s] = 0.2 / s + 0.8 * np.eye(s)
        moves[s, :s] = 1 / s
        return Chain(moves, emits)

    def updated(self, moves: np.ndarray, emits: np.ndarray, unigram: np.ndarray) -> Chain:
        s = STATES
        new_moves, new_emits = np.zeros_like(self.moves), np.zeros_like(self.emits)
        new_moves[:, :s] = moves[:, :s] + 0.1
        new_moves /= new_moves.sum(axis=1, keepdims=True)
        new_emits[:, :s] = emits[:, :s] + PRIOR * unigram[:, None]
        new_emits[:, :s] /= new_emits[:, :s].sum(axis=0)
        return Chain(new_moves, new_emits)


class Batch:
    """Sequences of symbols, cut into chunks that advance together.

    Chunks are sorted by length, so at each step the first ``live[t]`` of them go on; step t's
    symbols and vectors lie packed at ``at[t]``.
    """

    def __init__(self, chain: Chain, sequences: list[np.ndarray], start: np.ndarray | None = None, stop: np.ndarray | None = None):
        """start: the vector that enters the first chunk of every sequence; stop: the one that comes back into the last."""
        self.chain = chain
        self.start = np.eye(STATES + 1)[STATES] if start is None else start
        self.stop = np.ones(STATES + 1) if stop is None else stop
        n = np.array([len(x) for x in sequences], np.int64)
        per = -(-n // CHUNK)
        owner = np.repeat(np.arange(len(n)), per)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        size = np.minimum(CHUNK, n[owner] - number * CHUNK)
        order = np.argsort(-size, kind="stable")
        self.owner, self.number, self.size = owner[order], number[order], size[order]
        begin = np.r_[0, np.cumsum(n)[:-1]][self.owner] + self.number * CHUNK
        self.live = np.searchsorted(-self.size, -np.arange(int(self.size.max())), side="left")
        self.at = np.r_[0, np.cumsum(self.live)]
        step = np.repeat(np.arange(len(self.live)), self.live)
        chunk = np.arange(self.at[-1]) - self.at[step]
        self.symbols = np.concatenate(sequences)[begin[chunk] + step]
        self.multi = np.flatnonzero(per[self.owner] > 1)
        self.texts = len(n)

    def _transfers(self) -> np.ndarray:
        """Transfer matrices of the chunks of longer sequences, scaled."""
        s = STATES + 1
        own = self.multi  # sorted by size, as all chunks are
        p = np.broadcast_to(np.eye(s), (len(own), s, s)).copy()
        for t in range(int(self.size[own].max(initial=0))):
            m = int(np.searchsorted(own, self.live[t]))
            q = (p[:m].reshape(-1, s) @ self.chain.moves).reshape(m, s, s)
            q *= self.chain.emits[self.symbols[self.at[t] + own[:m]]][:, None, :]
            if t % SCALED == 0:
                q /= q.max(axis=(1, 2))[:, None, None]
            p[:m] = q
        return p / p.max(axis=(1, 2))[:, None, None]

    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors that enter each chunk from the left and from the right, each scaled."""
        s = STATES + 1
        left, right = np.empty((len(self.size), s)), np.empty((len(self.size), s))
        left[:], right[:] = self.start, self.stop
        if len(self.multi):
            p = self._transfers()
            at = np.lexsort((self.number[self.multi], self.owner[self.multi]))
            owner = self.owner[self.multi][at]
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[start, len(owner)])
            for k in range(1, int(length.max())):  # all longer sequences advance together, chunk by chunk
                now = start[length > k] + k
                v = np.einsum("ni,nij->nj", left[self.multi[at[now - 1]]], p[at[now - 1]])
                left[self.multi[at[now]]] = v / v.sum(axis=1, keepdims=True)
                back = start[length > k] + length[length > k] - 1 - k
                w = np.einsum("nij,nj->ni", p[at[back + 1]], right[self.multi[at[back + 1]]])
                right[self.multi[at[back]]] = w / w.sum(axis=1, keepdims=True)
        return left, right

    def loglik(self) -> np.ndarray:
        """Natural log likelihood of each sequence; ``last`` keeps each chunk's last vector."""
        s = STATES
        moves, emits, ones = self.chain.moves[:s, :s].copy(), self.chain.emits[:, :s].copy(), np.ones((s, 1))
        a = self._ends()[0] @ self.chain.moves[:, :s]
        log, last = np.zeros(len(a)), np.zeros((len(a), s + 1))
        ends = [*self.live[1:].tolist(), 0]
        for t, m in enumerate(self.live.tolist()):
            if t:
                a = a[:m] @ moves
            a *= emits.take(self.symbols[self.at[t] : self.at[t] + m], axis=0)
            low = 0 if t % SCALED == SCALED - 1 else ends[t]  # all chunks now and then, and those that end here
            if low < m:
                scale = a[low:] @ ones
                a[low:] /= scale
                log[low:m] += np.log(scale[:, 0])
                last[ends[t] : m, :s] = a[ends[t] :]
        self.last = last
        return np.bincount(self.owner, log, minlength=self.texts)

    def expected(self) -> tuple[np.ndarray, np.ndarray]:
        """Expected moves, and expected emissions by symbol; ``before`` keeps each chunk's backward vector at its start.

        A symbol's emissions may be scaled freely here, so they are scaled to sum 1 and
        vectors shrink slowly; single precision and rare scalings do.
        """
        s = STATES
        left, right = (x.astype(np.float32) for x in self._ends())
        moves = self.chain.moves[:, :s].astype(np.float32)
        inner, back = moves[:s].copy(), moves.T.copy()
        inner_back = inner.T.copy()
        emits = (self.chain.emits / self.chain.emits.sum(axis=1, keepdims=True))[:, :s].astype(np.float32)
        ones = np.ones((s, 1), np.float32)
        at, live = self.at.tolist(), self.live.tolist()
        gamma, drawn = np.empty((at[-1], s), np.float32), emits.take(self.symbols, axis=0)
        for t, m in enumerate(live):  # forward vectors first
            now = gamma[at[t] : at[t + 1]]
            np.dot(gamma[at[t - 1] : at[t - 1] + m] if t else left, inner if t else moves, out=now)
            now *= drawn[at[t] : at[t + 1]]
            if t % SCALED == SCALED - 1:
                now /= now @ ones
        b = right[:, :s].copy()
        total = np.zeros((s + 1, s))
        for t in range(len(live) - 1, -1, -1):
            m, here, e = live[t], gamma[at[t] : at[t + 1]], drawn[at[t] : at[t + 1]]
            e *= b[:m]
            # the vector before is still a forward one; its step to here is scaled like this one unless t scales
            before = gamma[at[t - 1] : at[t - 1] + m] if t else left
            c = e @ (inner_back if t else back)
            here *= b[:m]
            share = 1 / (here @ ones)
            here *= share  # from here on the states' probabilities at this step
            e *= 1 / np.einsum("ij,ij->i", before, c)[:, None] if t % SCALED == SCALED - 1 else share
            total[: before.shape[1]] += before.T @ e
            if t % SCALED == 0:
                c /= c.sum(axis=1, keepdims=True)
            if t:
                b[:m] = c
            else:
                self.before = c
        counts = np.empty((len(emits), s))
        for k in range(s):
            counts[:, k] = np.bincount(self.symbols, gamma[:, k], minlength=len(emits))
        return np.pad(total * self.chain.moves[:, :s], ((0, 0), (0, 1))), counts


def _batched(sequences: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    part, size = [], 0
    for x in sequences:
        part.append(x)
        size += len(x)
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def _symbols(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(data, "<u2") for data in blobs(column))


def _windows(chain: Chain, x: np.ndarray) -> tuple[float, list[np.ndarray | None]]:
    """Log likelihood of a very long sequence, its vector carried from window to window, and what enters each."""
    total, starts = 0.0, [None]
    for at in range(0, len(x), WINDOW):
        batch = Batch(chain, [x[at : at + WINDOW]], starts[-1])
        total += float(batch.loglik()[0])
        starts.append(batch.last[int(np.argmax(batch.number))])
    return total, starts[:-1]


def _loglik(chain: Chain, part: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihoods of sequences of any length."""
    if all(len(x) <= WINDOW for x in part):
        return Batch(chain, part).loglik()
    return np.array([_windows(chain, x)[0] for x in part])


def _expected(chain: Chain, part: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Expected moves and emissions of sequences of any length."""
    moves, emits = np.zeros_like(chain.moves), np.zeros((len(chain.emits), STATES))
    short = [x for x in part if len(x) <= WINDOW]
    if short:
        moves, emits = Batch(chain, short).expected()
    for x in (x for x in part if len(x) > WINDOW):
        stop = None
        for k, start in reversed(list(enumerate(_windows(chain, x)[1]))):
            batch = Batch(chain, [x[k * WINDOW : (k + 1) * WINDOW]], start, stop)
            m, e = batch.expected()
            moves, emits, stop = moves + m, emits + e, batch.before[int(np.argmin(batch.number))]
    return moves, emits


@dataclass(frozen=True)
class Table:
    """The most frequent words: symbol, and log10 shares among all words and within the class (0 for own symbols)."""

    places: dict[bytes, int]
    symbols: np.ndarray
    base: np.ndarray
    share: np.ndarray
    own: int
    ended: tuple[float, int]  # base share of the end, and whether training saw one


def _encode(docs: DataFrame, table: Table, training: Column, id_col: str, text_col: str) -> DataFrame:
    """(row, id, training, n_tokens, known, base, share, symbols, other words with class and count), a row for each text."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, _id {id_type}, training boolean, n_tokens long, _known long, _base double, _share double, symbols binary, rare array<struct<word:binary,class:int,times:int>>"
    names = ["row", "_id", "training", "n_tokens", "_known", "_base", "_share", "symbols", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        find, own = table.places.get, table.own
        # the last entries stand for a word outside the table, and for the end
        base, share = np.r_[table.base, 0.0, table.ended[0]], np.r_[table.share, 0.0, 0.0]
        known = np.r_[np.ones(len(table.base), np.int64), 0, table.ended[1]]
        for batch in _gathered(batches, 3):
            n, which, distinct = split(batch.column(3))
            words = distinct.to_pylist()
            place = np.fromiter((find(w, -1) for w in words), np.int64, len(words))
            symbol = np.where(place >= 0, np.r_[table.symbols, 0][place], 0)
            others = np.flatnonzero(place < 0)
            symbol[others] = [own + class_of(words[k]) for k in others.tolist()]
            place[others] = len(table.base)
            ends = np.cumsum(n + 1)
            starts = np.r_[0, ends[:-1]]
            inside = np.ones(int(ends[-1]), bool)
            inside[ends - 1] = False
            flat, entry = np.full(len(inside), own + CLASSES, "<u2"), np.full(len(inside), len(base) - 1, np.int64)
            flat[inside], entry[inside] = symbol[which], place[which]
            rows = np.repeat(np.arange(len(n)), n)
            rare = place[which] == len(table.base)
            pairs, times = np.unique(rows[rare] * len(words) + which[rare], return_counts=True)
            row, word = np.divmod(pairs, max(len(words), 1))
            entries = pa.StructArray.from_arrays([distinct.take(pa.array(word)), pa.array((symbol[word] - own).astype(np.int32)), pa.array(times.astype(np.int32))], names=["word", "class", "times"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)), entries)
            offsets = np.r_[0, 2 * ends].astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            sums = [pa.array(np.add.reduceat(x[entry], starts)) for x in (known, base, share)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n + 1, pa.int64()), *sums, packed, lists], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("_id"), training.alias("training"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, schema)


def _trained(encoded: DataFrame, unigram: np.ndarray, rounds: int) -> Chain:
    """Baum-Welch over all training rows."""
    spark = encoded.sparkSession
    symbols = encoded.filter("training").select("symbols")
    chain = Chain.first(unigram)
    end = len(unigram)

    def step(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chain = Chain(*shared.value)
            moves, emits = np.zeros_like(chain.moves), np.zeros((len(chain.emits), STATES))
            for part in _batched(x for batch in batches for x in _symbols(batch.column(0))):
                m, e = _expected(chain, part)
                moves += m
                emits += e
            used = np.flatnonzero(emits.any(axis=1))
            keys = np.r_[used, end + np.arange(len(moves))]
            values = np.rint(np.vstack([emits[used], moves[:, :STATES]]) * SCALE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(values[:, k]) for k in range(STATES))], names=["symbol", *(f"s{k}" for k in range(STATES))])

        schema = "symbol int, " + ", ".join(f"s{k} long" for k in range(STATES))
        return symbols.mapInArrow(run, schema).groupBy("symbol").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)])

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((chain.moves, chain.emits))
        emits, moves = np.zeros_like(chain.emits), np.zeros_like(chain.moves)
        for row in step(shared).collect():  # symbols x states, fixed by the parameters
            (moves if row[0] >= end else emits)[row[0] - end if row[0] >= end else row[0], :STATES] = np.array(row[1:]) / SCALE
        chain = chain.updated(moves, emits, unigram)
        shared.unpersist()
    return chain


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, scope: str = "default") -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score) of every whole text; learns from rows where ``training`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    taught = docs.filter(training)
    counts = materialize(_count_words(taught.select(F.col(text_col).alias("_text"))), "counts", scope)
    texts = taught.count()
    size = np.zeros((CLASSES, 2), np.int64)  # tokens and distinct words of each class; below, without the frequent words
    for c, n, k in counts.groupBy(_class_column().alias("class")).agg(F.sum("n"), F.count("*")).collect():
        size[c] = n, k
    words, distinct = (int(x) for x in size.sum(axis=0))
    total, kinds = words + texts, distinct + (texts > 0)  # with the end token
    listed = _most_frequent(counts, TABLED)
    hot = listed[:FREQUENT]
    own = np.array([n for _, n in hot], np.float64)
    for w, n in hot:
        size[class_of(w)] -= n, 1
    log_n = math.log10(total + 0.5 * (kinds + 1))
    class_log = np.log10(size[:, 0] + 0.5 * (size[:, 1] + 1))
    classes = np.array([class_of(w) for w, _ in listed[FREQUENT:]], np.int64)
    logs = np.log10(np.array([n for _, n in listed], np.float64) + 0.5)
    table = Table(
        {w: k for k, (w, _) in enumerate(listed)},
        np.r_[np.arange(len(hot)), len(hot) + classes].astype(np.int64),
        logs - log_n,
        np.r_[np.zeros(len(hot)), logs[len(hot) :] - class_log[classes]],
        len(hot),
        (math.log10(texts + 0.5) - log_n, int(texts > 0)),
    )
    encoded = materialize(_encode(docs, table, training, id_col, text_col), "encoded", scope)
    unigram = np.r_[own, size[:, 0], texts] + 0.5
    unigram /= unigram.sum()
    chain = _trained(encoded, unigram, rounds)

    shared = spark.sparkContext.broadcast(chain)
    names = [f.name for f in encoded.schema.fields[:7]]

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, held, size = shared.value, [], 0

        def out() -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            log = [_loglik(chain, part) for part in _batched(_symbols(rows.column(7)))]
            return pa.RecordBatch.from_arrays([*rows.columns[:7], pa.array(np.concatenate(log) / math.log(10))], names=[*names, "_log"])

        for batch in batches:
            held.append(batch)
            size += batch.column(7).nbytes // 2
            if size >= TOGETHER:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields[:7])
    rows = encoded.drop("rare").mapInArrow(chained, f"{schema}, _log double")
    class_logs = F.split(F.lit(",".join(map(repr, class_log.tolist()))), ",").cast("array<double>")
    rare = encoded.select("row", F.inline("rare")).join(counts.select("word", "n"), "word", "left")
    share = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(F.lit(0))).alias("_rare_known"),
        F.sum(F.col("times") * (share - F.lit(log_n))).alias("_rare_base"),
        F.sum(F.col("times") * (share - F.get(class_logs, F.col("class")))).alias("_rare_share"),
    )
    zero = F.lit(0.0)
    return rows.join(rare, "row", "left").select(
        F.col("_id").alias(id_col),
        "training",
        "n_tokens",
        (F.col("_known") + F.coalesce("_rare_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_rare_base", zero)).alias("base_score"),
        (F.col("_log") + F.col("_share") + F.coalesce("_rare_share", zero)).alias("score"),
    )
