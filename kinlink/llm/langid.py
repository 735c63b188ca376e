"""Language identification by segmentation-marginalised unigrams.

Method. A fixed public vocabulary of pieces is given. For every language, piece
probabilities are fitted by expectation-maximisation over all segmentations of
the training words; a word's probability in a language is the sum, by a forward
recursion, over all ways to cut it into pieces. A text's words are whole runs of
letters and their combining marks, lower-cased, with the vocabulary's word mark in
front (no piece crosses words), so its likelihood is the product over its words.
Words of more than SHORT characters (prose without spaces, say) go through a scaled
recursion, window by window, that gives the same probability without underflow. The
prediction is the language of highest likelihood, the score its posterior under
a uniform prior. Whole texts are scored; ids, sources and labels never are inputs.

Bounds. The model is fitted on at most TRAIN_DOCS documents a language, those
with the smallest id hashes among the training rows, and holds (pieces x
languages) doubles, whatever the input; at most MAX_LANGS languages. E-steps run
on the executors over word counts; longer words train in units of SHORT characters,
the word mark in the first alone. The driver sees the model's own size and no more.
Workers remember the likelihoods of at most MEMO_WORDS distinct short words.

Edge cases: null texts and texts without a letter give ``und`` with score 0;
no training rows at all give ``und`` too; characters outside the vocabulary
cost a fixed small probability; repeated rows and ties are resolved alike (the
first language by name).
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.text import blobs, small_batches
from kinlink.sources.shared import materialize

TRAIN_DOCS = 600
MAX_LANGS = 400
ROUNDS = 3
#: Characters up to which a word, or a unit of one in training, needs no scaling.
SHORT = 32
#: Positions of long words that are held at a time (by languages), and steps between scalings.
LONG_WINDOW, LONG_DOUBLES, SCALED = 256, 2_000_000, 8
#: Hash buckets of a language in which training documents are ranked first.
RANK_BUCKETS = 64
#: Pieces in a block of counts.
BLOCK = 256
MEMO_WORDS, MEMO_DOUBLES = 250_000, 4_000_000
SMOOTHING = 0.05
#: Probability of a character that no piece covers, and the word mark of the vocabulary.
UNKNOWN = 1e-7
MARK = "▁"
MARKS = "".join(chr(k) for k in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(k))[0] == "M")
WORD = re.compile(rf"[^\W\d_]+(?:[{MARKS}]+[^\W\d_]*)*")
#: What WORD amounts to in a text without marks, several times faster.
PLAIN_WORD = re.compile(r"[^\W\d_]+")
#: Marks of the first plane, which a class looks up in a table, and everything beyond it in one range.
MAYBE_MARK = re.compile(f"[{''.join(c for c in MARKS if c < '\U00010000')}\U00010000-\U0010FFFF]")
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    pieces: tuple[str, ...]
    probabilities: np.ndarray  # pieces x langs


def read_pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Lattice:
    """All pieces of many words, and the recursions over their segmentations."""

    def __init__(self, pieces: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(pieces):
            self.automaton.add_word(p, k)
        self.automaton.make_automaton()
        self.lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.longest = max(map(len, pieces), default=1)

    def build(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Bounds of each word (its mark included), and (start, end, piece) of every match; piece -1 is an unknown character."""
        text = "".join([w + "\n" for w in words])
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.r_[0, np.cumsum(size)[:-1]]
        last = first + size - 1
        last_at, piece = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2).T
        end, length = last_at + 1, self.lengths[piece]
        start = end - length
        alone = np.ones(len(text), bool)
        alone[start[length == 1]] = False
        alone[last] = False
        at = np.flatnonzero(alone)
        start, end, piece = np.r_[start, at], np.r_[end, at + 1], np.r_[piece, np.full(len(at), -1)]
        return first, last, start, end, piece

    @staticmethod
    def _sum(total: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray, step: np.ndarray) -> None:
        """total[end] += total[start] * weight in the order of ``step``; equal ends have equal steps."""
        order = np.lexsort((end, step))
        start, end, weight, step = start[order], end[order], weight[order], step[order]
        cuts = np.r_[0, np.flatnonzero(step[1:] != step[:-1]) + 1, len(step)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            e = end[a:b]
            heads = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            total[e[heads]] = np.add.reduceat(total[start[a:b]] * weight[a:b], heads, axis=0)

    def forward(self, words: list[str], p: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Probability of each word in each language, and what the recursion used."""
        first, last, start, end, piece = self.build(words)
        weight = np.vstack([p, np.full((1, p.shape[1]), UNKNOWN)])[piece]
        alpha = np.zeros((last[-1] + 1, p.shape[1]))
        alpha[first] = 1.0
        origin = np.repeat(first, last - first + 1)
        self._sum(alpha, start, end, weight, end - origin[start])
        return alpha[last], (first, last, start, end, piece, weight, alpha)

    def long_logs(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language, for words of any length.

        All words advance together, window by window; what a window hands on are the
        last positions that a piece can start from, scaled now and then.
        """
        reach, langs = self.longest, p.shape[1]
        weights = np.vstack([p, np.full((1, langs), UNKNOWN)])
        out = np.empty((len(words), langs))
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        many = max(1, LONG_DOUBLES // ((reach + LONG_WINDOW) * langs))
        for a in range(0, len(order), many):
            now = order[a : a + many]
            size = np.array([len(words[k]) for k in now])
            log, alpha = np.zeros((len(now), langs)), np.zeros((len(now), reach, langs))
            alpha[:, -1] = 1.0
            for base in range(0, int(size.max()), LONG_WINDOW):
                live = int(np.searchsorted(-size, -base, side="left"))
                low = max(0, base - reach + 1)
                first, _, start, end, piece = self.build([words[k][low : base + LONG_WINDOW] for k in now[:live]])
                word = np.searchsorted(first, start, side="right") - 1
                step = end - first[word] + low - base  # positions from the window's begin
                inside = step > 0
                word, step, length, piece = word[inside], step[inside], (end - start)[inside], piece[inside]
                by = np.lexsort((word, step))
                word, step, length, piece = word[by], step[by], length[by], piece[by]
                alpha = np.concatenate([alpha[:live], np.zeros((live, LONG_WINDOW, langs))], axis=1)
                cuts = np.searchsorted(step, np.arange(1, LONG_WINDOW + 2))
                for j in range(1, min(LONG_WINDOW, int(size[0]) - base) + 1):
                    m, x, y = int(np.searchsorted(-size, -(base + j), side="right")), cuts[j - 1], cuts[j]
                    place = reach - 1 + j
                    w = word[x:y]
                    heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                    alpha[w[heads], place] = np.add.reduceat(alpha[w, place - length[x:y]] * weights[piece[x:y]], heads, axis=0)
                    done = np.flatnonzero(size[:m] == base + j)
                    if len(done):
                        out[[now[k] for k in done]] = np.log(alpha[done, place]) + log[done]
                    if j % SCALED == 0:
                        held = alpha[:m, place - reach + 1 : place + 1]
                        most = held.max(axis=1)
                        held /= most[:, None]
                        log[:m] += np.log(most)
                alpha = alpha[:, -reach:]
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces x langs), given how often each language has each word."""
        total, (first, last, start, end, piece, weight, alpha) = self.forward(words, p)
        beta = np.zeros_like(alpha)
        beta[last] = 1.0
        close = np.repeat(last, last - first + 1)
        self._sum(beta, end, start, weight, close[start] - start)
        word = np.repeat(np.arange(len(words)), last - first + 1)[start]
        share = alpha[start] * weight * beta[end] * (counts / np.maximum(total, 1e-300))[word]
        known = piece >= 0
        return np.stack([np.bincount(piece[known], share[known, k], minlength=len(p)) for k in range(p.shape[1])], axis=1)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and their marks."""
    text = text.lower()
    return (PLAIN_WORD if text.isascii() or not MAYBE_MARK.search(text) else WORD).findall(text)


def _units(data: bytes) -> Iterator[str]:
    """Training units of a text."""
    for w in map(MARK.__add__, words_of(data.decode("utf-8", "replace"))):
        yield from (w[at : at + SHORT] for at in range(0, len(w), SHORT))


def _word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n) over the sampled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, data in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                counts.update((lang, w) for w in _units(data))
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    return sample.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(np.rint(counts * 2**20).astype(np.int64).tobytes(), 1)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole counts, summed by block."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, packed in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
            sums[at] = sums.get(at, 0) + np.frombuffer(zlib.decompress(packed), np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(n.tobytes(), 1) for n in sums.values()], pa.binary())], names=["block", "n"])


def fit(docs: DataFrame, pieces: list[str], training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS, scope: str = "default") -> LanguageModel:
    """Piece probabilities by language from a bounded sample of the rows where ``training`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.filter(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = labelled.select(F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    langs = tuple(sorted(r[0] for r in ids.select("_lang").distinct().limit(MAX_LANGS + 1).collect()))
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return LanguageModel((), (), np.zeros((0, 0)))
    # ranked in buckets first, so that a language that holds most rows is no single task's work
    ids = ids.withColumn("_bucket", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(RANK_BUCKETS)))
    for groups in (["_lang", "_bucket"], ["_lang"]):
        first = Window.partitionBy(*groups).orderBy(F.xxhash64("_id"), "_id")
        ids = ids.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= TRAIN_DOCS)
    chosen = ids.select("_lang", "_id")
    texts = labelled.select(F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    sample = texts.join(F.broadcast(chosen), ["_lang", "_id"], "left_semi").select("_lang", "_text")  # at most TRAIN_DOCS x MAX_LANGS ids
    number = {lang: k for k, lang in enumerate(langs)}
    counts = materialize(_word_counts(sample).groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("by")), "words", scope)
    p = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((tuple(pieces), p))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, now = shared.value
            lattice, total = Lattice(names), np.zeros(now.shape)
            for batch in batches:
                words, by = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at in range(0, len(words), 4_096):
                    part = by[at : at + 4_096]
                    n = np.zeros((len(part), now.shape[1]))
                    for k, entries in enumerate(part):
                        for x in entries:
                            n[k, number[x["lang"]]] = x["n"]
                    total += lattice.expected(words[at : at + 4_096], n, now)
            for at in range(0, len(total), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_packed(total[at : at + BLOCK])], pa.binary())], names=["block", "n"])

        total = np.zeros(p.shape)
        blocks = counts.mapInArrow(run, "block int, n binary").repartition(min(64, -(-len(p) // BLOCK)), "block")
        for at, packed in blocks.mapInArrow(_summed, "block int, n binary").collect():  # pieces x languages, fixed by the parameters
            total[at : at + BLOCK] = np.frombuffer(zlib.decompress(packed), np.int64).reshape(-1, len(langs)) / 2**20
        used = (total > 1e-4).any(axis=1) | np.array([len(x) == 1 for x in pieces])
        pieces, total = [x for x, u in zip(pieces, used) if u], total[used] + SMOOTHING
        p = total / total.sum(axis=0)
    return LanguageModel(langs, tuple(pieces), p)


_scorers: dict[int, tuple[Lattice, dict[str, int], np.ndarray]] = {}


def _scorer(key: int, model: LanguageModel) -> tuple[Lattice, dict[str, int], np.ndarray]:
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Lattice(model.pieces), {}, np.zeros((min(MEMO_WORDS, MEMO_DOUBLES // len(model.langs)), len(model.langs)))
    return _scorers[key]


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lattice, known, memo = _scorer(hash((m.pieces, m.probabilities.tobytes())), m) if m.langs else (None, {}, None)
        for batch in batches:
            lang, score = [], []
            texts = [data.decode("utf-8", "replace") for data in blobs(batch.column(1))]
            parts = [words_of(t) for t in texts] if m.langs else []
            distinct = set().union(*parts)
            lengthy = [w for w in distinct if len(w) >= SHORT]  # the word mark counts
            longer = dict(zip(lengthy, lattice.long_logs([MARK + w for w in lengthy], m.probabilities))) if lengthy else {}
            distinct.difference_update(lengthy)
            table = memo
            if distinct:
                new = list(distinct.difference(known))
                if len(known) + len(new) > len(memo):
                    known.clear()
                    new = list(distinct)
                if len(new) > len(memo):  # this batch alone has more words than the memo holds
                    table = np.zeros((len(new), len(m.langs)))
                for at in range(0, len(new), 4_096):
                    part = new[at : at + 4_096]
                    rows = np.log(lattice.forward([MARK + w for w in part], m.probabilities)[0])
                    table[len(known) : len(known) + len(part)] = rows
                    known.update(zip(part, range(len(known), len(known) + len(part))))
            for k, text in enumerate(texts):
                if not m.langs or not LETTER.search(text):
                    lang.append("und")
                    score.append(0.0)
                    continue
                words = [w for w in parts[k] if w not in longer] if longer else parts[k]
                total = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
                if len(words) < len(parts[k]):
                    total = total + sum(longer[w] for w in parts[k] if w in longer)
                best = int(total.argmax())
                lang.append(m.langs[best])
                score.append(float(1.0 / np.exp(total - total[best]).sum()))
            if table is not memo:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")
