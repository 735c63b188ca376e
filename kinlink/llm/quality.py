"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio.

Method. Words and pairs of neighbouring words are hashed into a fixed number of
buckets. Two multinomials with additive smoothing are fitted over the buckets:
one over all documents (raw corpus, full counts), one over trusted documents. A
document's score is the sum over its n-grams of log(target) - log(raw), divided
by the number of n-grams. One threshold, fixed from labelled rows, decides on
every document alike. DataFrame functions only: the bucket ratios (BUCKETS
doubles, 128 KB whatever the input) enter the plan as a constant array.

A second ratio of the same kind sets labelled toxic against trusted documents.
Of the lower-cased words only those whose document counts differ beyond chance
(log-likelihood ratio of at least LEAST_G2) have a ratio; all others count zero.
Its mean over a document's words is ``harm``, and a document above the limit goes.
Words are learnt from one half of the labelled rows, the limit from the other.

Bounds. All labelled rows count, none is sampled; at most TERMS words have a toxic
ratio. Thresholds are exact order statistics; the 0.2 % of scores beyond one are ranked.
Before labels are joined, a bitmap of MARKS bits (8 MB whatever the input) drops most
texts without one, so that hardly more than the labelled texts are shuffled, once. Equal
texts count once by taking the counts of all but the first of them off again.

Edge cases: null or empty text has no words, so n_words is 0 and it fails the
base rule; no trusted rows (or an empty label table) make all ratios 0 and keep
what passes the base rule; no toxic rows, or none that differ, make every harm 0;
repeated rows are scored alike; labels of unknown documents are ignored; null ids
and null labels are never examples.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.text import SPACE, carried, let, unpacked, words_of
from kinlink.sources.shared import discard, materialize

#: Hash buckets of the n-gram multinomials.
BUCKETS = 16_384
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Share of trusted examples that the threshold must keep.
KEEP_SHARE = 0.998
#: Least log-likelihood ratio of a toxic word (chi-square of one degree: 4e-8 by chance), and their greatest number.
LEAST_G2 = 30.0
TERMS = 1_024
#: Bits of the bitmap that rows are tested by before they are shuffled.
MARKS = 1 << 26
#: What parts the words of the toxic ratio: ASCII and Latin-1 signs, general and CJK punctuation.
SIGNS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\xBF\\u2000-\\u206F\\u3000-\\u303F]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class QualityModel:
    ratios: tuple[float, ...]
    threshold: float
    #: Hashes of toxic words with their log ratios, and the harm above which documents go.
    terms: tuple[tuple[int, float], ...] = ()
    limit: float = math.inf


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(wh: Column) -> Column:
    """Hashes of neighbouring words."""
    n = F.size(wh)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.get(wh, i - 1), F.get(wh, i)))).otherwise(F.array().cast("array<bigint>"))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS).cast("bigint")).cast("int")


def _bucket_counts(docs: DataFrame) -> list[int]:
    """Counts of all n-grams of all documents by bucket."""
    grams = docs.select(let(_hashes(words_of(F.col("_text"))), lambda wh: F.transform(F.concat(wh, _pairs(wh)), _bucket)).alias("_b"))
    counts = [0] * BUCKETS
    # explode_outer: explode would add a filter on the array's size, which computes it twice
    for b, n in grams.select(F.explode_outer("_b").alias("b")).groupBy("b").count().collect():
        if b is not None:
            counts[b] = n
    return counts


def _marked(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows with a key, and few others: those whose hash no key has in a bitmap of MARKS bits go, without a shuffle."""
    at = F.pmod(F.xxhash64(on), F.lit(MARKS)) + 1  # bitmap positions are counted from 1
    marks = keys.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_marks"))
    placed = rows.join(F.broadcast(marks), F.bitmap_bucket_number(at) == F.col("_bucket"))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_marks", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = placed.filter(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))) != 0)
    return held.select(*rows.columns)


def _joined(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``rows`` joined to ``keys`` by a column; of the rows hardly more than the matching ones are shuffled, and none is sorted."""
    return _marked(rows, keys, on).join(keys.hint("shuffle_hash"), on)


def _labelled(texts: DataFrame, labels: DataFrame, id_col: str, scope: str) -> DataFrame:
    """All labelled documents with flags: good (trusted), bad (rejected), toxic; a scratch table, its rows numbered by ``_n``."""
    flag = lambda wanted, name: F.max(F.coalesce(wanted, F.lit(False))).alias(name)
    kinds = {"good": (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), "bad": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    ids = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*[flag(v, k) for k, v in kinds.items()])
    ids = materialize(ids.filter("good or bad or toxic"), "labels", scope)
    found = _joined(texts, ids, "_id").withColumn("_n", F.monotonically_increasing_id())
    return materialize(found, "labelled", scope)


def _log_shares(counts: list[int]) -> list[float]:
    total = sum(counts) + SMOOTHING * BUCKETS
    return [math.log((c + SMOOTHING) / total) for c in counts]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str = "quality") -> QualityModel:
    """Raw counts over all ``docs``, target counts and thresholds from all ``labels`` (id, quality, toxic)."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    labelled = _labelled(texts, labels, id_col, scope)
    try:
        return _fitted(texts, labelled, scope)
    finally:
        discard(labelled)


def _fitted(texts: DataFrame, labelled: DataFrame, scope: str) -> QualityModel:
    target = _bucket_counts(labelled.filter("good"))
    if not sum(target):
        return QualityModel((0.0,) * BUCKETS, -math.inf)
    ratios = tuple(t - r for t, r in zip(_log_shares(target), _log_shares(_bucket_counts(texts))))
    scores = materialize(_scores(labelled, ratios), "scores", scope)
    threshold = _threshold(scores.filter("good"), scores.filter("bad"))
    discard(scores)
    learns = F.pmod(F.xxhash64("_id", F.lit("terms")), F.lit(2)) == 0
    learnt, held = labelled.filter(learns), labelled.filter(~learns)
    terms = _terms(learnt.filter("toxic"), learnt.filter("good"), scope)
    if not terms:
        return QualityModel(ratios, threshold)
    harms = materialize(_harms(held, terms), "harms", scope)
    limit = _limit(harms.filter("good"), harms.filter("toxic"))
    discard(harms)
    return QualityModel(ratios, threshold, terms, limit)


def _nth(values: DataFrame, at: int, n: int) -> float:
    """The value ``x`` at a place of ``n`` in ascending order, from the nearer end: 1 - KEEP_SHARE of them at most are ranked."""
    down = at > n - 1 - at
    return values.select("x").orderBy(F.desc("x") if down else F.asc("x")).offset(n - 1 - at if down else at).limit(1).collect()[0][0]


def _plain_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words between white space, signs and punctuation."""
    return F.transform(F.array_remove(F.split(F.lower(text), SIGNS), ""), lambda w: F.xxhash64(w))


def _terms(toxic: DataFrame, good: DataFrame, scope: str) -> tuple[tuple[int, float], ...]:
    """Words that stand in more toxic documents than chance allows, with their log ratios; equal texts count once."""
    side = lambda df, t: df.select(F.lit(t).alias("t"), (2 * F.col("_n") + t).alias("n"), F.xxhash64("_text").alias("d"), "_text")
    both = side(toxic, 1).unionByName(side(good, 0))
    numbers = both.select("t", "d", "n")
    firsts = numbers.groupBy("t", "d").agg(F.min("n").alias("first"))
    sizes = dict(firsts.groupBy("t").count().collect())
    a_all, b_all = sizes.get(1, 0), sizes.get(0, 0)
    if not a_all or not b_all:
        return ()
    copies = materialize(numbers.join(firsts, ["t", "d"]).filter("n <> first").select("n"), "copies", scope)
    signed = lambda df, sign: df.select("t", F.lit(sign).alias("sign"), F.explode(F.array_distinct(_plain_hashes(F.col("_text")))).alias("h"))
    words = signed(both, 1).unionByName(signed(_joined(both, copies, "n"), -1))
    a, b = F.sum(F.col("t") * F.col("sign")).cast("double"), F.sum((1 - F.col("t")) * F.col("sign")).cast("double")
    counts = words.groupBy("h").agg(a.alias("a"), b.alias("b"))
    share = (F.col("a") + F.col("b")) / (a_all + b_all)
    cell = lambda n, of, p: F.when(n > 0, n * F.log(n / (of * p))).otherwise(0.0)
    seen = cell(F.col("a"), a_all, share) + cell(F.col("b"), b_all, share)
    unseen = cell(a_all - F.col("a"), a_all, 1 - share) + cell(b_all - F.col("b"), b_all, 1 - share)
    tested = counts.withColumn("g2", F.round(2 * (seen + unseen), 6)).filter((F.col("g2") >= LEAST_G2) & (F.col("a") * b_all > F.col("b") * a_all))
    rows = tested.orderBy(F.desc("g2"), "h").limit(TERMS).collect()
    return tuple((r["h"], math.log((r["a"] + 0.5) / (a_all + 1)) - math.log((r["b"] + 0.5) / (b_all + 1))) for r in rows)


def _harm(ph: Column, terms: tuple[tuple[int, float], ...]) -> Column:
    """Mean toxic log ratio of a document's words; 0 if it has none."""
    if not terms:
        return F.lit(0.0)
    constants = lambda xs, kind: F.split(F.lit(",".join(map(repr, xs))), ",").cast(f"array<{kind}>")
    keys, weights = constants([h for h, _ in terms], "bigint"), constants([r for _, r in terms], "double")
    found = F.filter(ph, lambda h: h.isin([h for h, _ in terms]))
    total = F.aggregate(found, F.lit(0.0), lambda a, h: a + F.get(weights, F.array_position(keys, h).cast("int") - 1))
    return F.when(F.size(ph) > 0, total / F.size(ph)).otherwise(F.lit(0.0))


def _harms(labelled: DataFrame, terms: tuple[tuple[int, float], ...]) -> DataFrame:
    """(good, toxic, x): the harm of every trusted and every toxic document."""
    harm = let(F.coalesce("_text", F.lit("")), lambda t: let(_plain_hashes(t), lambda ph: _harm(ph, terms)))
    return labelled.filter("good or toxic").select("good", "toxic", harm.alias("x"))


def _limit(good: DataFrame, toxic: DataFrame) -> float:
    """The high quantile of trusted harm that KEEP_SHARE keeps, raised half-way to the
    toxic examples' low quantile where a gap lies between."""
    n, m = good.count(), toxic.count()
    if not n:
        return math.inf
    high = _nth(good, min(n - 1, int(KEEP_SHARE * n)), n)
    low = _nth(toxic, int((1 - KEEP_SHARE) * m), m) if m else high
    return (low + high) / 2 if low > high else high


def _scores(labelled: DataFrame, ratios: tuple[float, ...]) -> DataFrame:
    """(good, bad, x): the score of every trusted and every rejected document of MIN_WORDS or more."""
    scored = let(_hashes(words_of(F.col("_text"))), lambda wh: let(_pairs(wh), lambda pairs: F.struct(F.size(wh).alias("n"), _score(wh, pairs, ratios).alias("x"))))
    return labelled.filter("good or bad").select("good", "bad", scored.alias("s")).select("good", "bad", "s.n", "s.x").filter(F.col("n") >= MIN_WORDS)


def _threshold(good: DataFrame, bad: DataFrame) -> float:
    """Where trusted scores begin: the low quantile that KEEP_SHARE keeps, lowered
    half-way to the rejected examples' high quantile where a gap lies between."""
    n, m = good.count(), bad.count()
    if not n:
        return -math.inf
    low = _nth(good, int((1 - KEEP_SHARE) * n), n)
    high = _nth(bad, min(m - 1, int(KEEP_SHARE * m)), m) if m else low
    return (low + high) / 2 if high < low else low


def _score(wh: Column, pairs: Column, ratios: tuple[float, ...]) -> Column:
    """Mean log ratio of a document's n-grams; 0 if it has none."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    n, zero = F.size(wh), F.lit(0.0)
    total = F.aggregate(F.concat(wh, pairs), zero, lambda a, h: a + F.get(table, _bucket(h)))  # names the table once: plans print it
    return F.when(n > 0, total / (2 * n - 1)).otherwise(zero)


def _windows(pairs: Column) -> Column:
    """Hashes of all windows of WINDOW (8) words, put together from pairs and fours."""
    fours = F.transform(pairs, lambda h, i: F.xxhash64(h, F.get(pairs, i + 2)))  # the last two are short and stand in no window
    return let(fours, lambda f: F.transform(F.sequence(F.lit(0), F.size(f) - WINDOW + 1), lambda i: F.xxhash64(F.get(f, i), F.get(f, i + 4))))


def _repeat_words(wh: Column, pairs: Column) -> Column:
    """Words in windows that are found twice or more."""
    by_hash = lambda w: F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.array_sort(F.transform(twice, lambda j: F.get(s, j)["i"]))

    def covered(at: Column) -> Column:
        step = lambda j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - F.get(at, j), F.lit(WINDOW)))
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0).cast("bigint"), lambda a, j: a + step(j))

    counted = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), let(by_hash(w), lambda s: let(starts(s), covered)))
    return F.coalesce(F.when(F.size(wh) > WINDOW, let(_windows(pairs), counted)), F.lit(0).cast("bigint"))


def measures(text: Column, model: QualityModel | None = None) -> Column:
    """The counts of the base rule, and score and harm if a ``model`` is given, of a text as one struct.

    Every array is bound to a lambda variable, so that no optimiser rule can copy its
    computation into the functions that read it: filters may be pushed below this column.
    """

    def counts(t: Column, words: Column) -> Column:
        full = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
        plain = {
            "n_words": F.size(words).cast("bigint"),
            "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("bigint"),
            "n_dup_lines": let(full, lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")),
        }
        if model is not None:
            plain["harm"] = let(_plain_hashes(t), lambda ph: _harm(ph, model.terms)) if model.terms else F.lit(0.0)
        scored = lambda wh, pairs: {"n_repeat_words": _repeat_words(wh, pairs)} | ({} if model is None else {"score": _score(wh, pairs, model.ratios)})
        return let(_hashes(words), lambda wh: let(_pairs(wh), lambda pairs: F.struct(*[c.alias(k) for k, c in (plain | scored(wh, pairs)).items()])))

    return let(F.coalesce(text, F.lit("")), lambda t: let(words_of(t), lambda words: counts(t, words)))


def _judged(docs: DataFrame, model: QualityModel, text_col: str) -> DataFrame:
    """``_row`` (all input columns), the measures as ``_m``, base_failed and kept."""
    df = carried(docs, _m=measures(F.col(text_col), model))
    m = F.col("_m")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    bound = lambda x: F.lit(max(-1e308, min(1e308, x)))
    passes = (m["score"] >= bound(model.threshold)) & (m["harm"] <= bound(model.limit))
    return df.select("_row", "_m", failed.alias("base_failed"), (~failed & passes).alias("kept"))


def judge(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts, base_failed, kept, score and harm."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return _judged(docs, model, text_col).select(F.col("_row")[id_col].alias(id_col), *[F.col("_m")[c].alias(c) for c in counts], "base_failed", "kept", F.col("_m")["score"].alias("score"), F.col("_m")["harm"].alias("harm"))


def keep(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    return unpacked(_judged(docs, model, text_col).filter("kept"), docs.columns)
