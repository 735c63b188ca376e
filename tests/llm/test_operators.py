"""Small fixtures against plain Python versions, and the edge cases of every operator."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from kinlink.llm import bpe, components, editprint, hmm, langid, licenses, linededup, mixing, quality, simhash, urlfilter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LINE = "The same long enough line of boilerplate"
TEXTS = [
    None,
    "",
    " \n\t",
    "one",
    "a b c d e f g h",
    f"{LINE}\nsomething else of its own here, really",
    f"  {LINE.upper()}\t\nand yet another thing",
    f"{LINE}\n{LINE}\nlast",
    "word " * 400,
    "word " * 400 + "x",
    "Häuser & Straßen — größer als früher\r\n\u2028naïve façade 日本語 🙂",
    "Permission is hereby granted, free of charge, to any person obtaining a copy. All rights reserved. CC BY cc by",
    "This work is licensed under the GNU General Public License, version 3.",
    " ".join(f"w{k}" for k in range(3000)),
    " ".join(f"w{k}" for k in range(3000)) + " tail",
    "same text twice",
    "same text twice",
]
ROWS = [(k, t, ("en", "de", None)[k % 3], ("b", "a", None)[k % 3], 0, 1.0, "x") for k, t in enumerate(TEXTS)]
ROWS += [ROWS[-1], (None, "no id at all", "en", "a", 0, 1.0, "x")]
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, score double, component_id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return SPACE.findall(text or "")


def test_bpe(spark, docs, nothing):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = bpe.encode(docs, path, pattern).collect()
    want = Counter((r[0], tuple(encoding.encode_ordinary(r[1] or ""))) for r in ROWS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)
    assert Counter(bytes(r.decoded) for r in got) == Counter((r[1] or "").encode() for r in ROWS)
    again = bpe.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>"), path).collect()
    assert Counter(bytes(r.decoded) for r in again) == Counter((r[1] or "").encode() for r in ROWS)
    digests = {r.doc_id: r for r in bpe.encode_digest(docs, path, pattern).collect()}
    assert digests[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(nothing, path, pattern).count() == 0


def measures(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(13, 1, 0), (10, 1, None), (8, 0, 0), (None, 1, 0), (99, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.judge(docs, model).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in got) == Counter((r[0], *measures(r[1])) for r in ROWS)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed and r.score >= model.threshold)
    assert {r.doc_id for r in got if r.kept} >= {13}
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.judge(nothing, quality.fit(nothing, labels.limit(0))).count() == 0
    open_ = quality.fit(docs, labels.limit(0))
    assert {r.doc_id for r in quality.judge(docs, open_).filter("kept").collect()} == {r[0] for r in ROWS if measures(r[1])[0] >= 20 and 100 * measures(r[1])[4] <= 30 * measures(r[1])[0]}


def test_line_dedup(docs, nothing):
    holders = defaultdict(list)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for r in ROWS:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(-1 if r[0] is None else r[0])
    want = Counter()
    for r in ROWS:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == (-1 if r[0] is None else r[0])]
        want[r[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = Counter(tuple(r) for r in linededup.dedup(docs).collect())
    assert got == want and any(k[2] for k in got)
    assert linededup.deduped(docs).columns == docs.columns
    assert linededup.dedup(nothing).count() == 0


def test_line_filters_find_every_repeat(spark):
    rng = np.random.default_rng(8)
    lines = [f"line {k} that is long enough to count" for k in range(400)]
    rows = [(k, "\n".join(lines[i] for i in rng.integers(0, 400, 3)) + "\neverybody holds this line here") for k in range(300)] + [(None, lines[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    holders = defaultdict(set)
    for number, (_, text) in enumerate(rows):
        for line in text.split("\n"):
            holders[hashlib.md5(line.encode()).digest()].add(number)
    want = Counter()
    for d, held in holders.items():
        keeper = max(-1 if rows[i][0] is None else rows[i][0] for i in held)
        want.update((rows[i][0], d) for i in held if len(held) >= 3 and (rows[i][0] is None or rows[i][0] != keeper))
    # the smallest filters suspect nearly every line, and hundreds of shards hold a few lines each
    for bits in (linededup.SHARD_BITS, 512, 64):
        got = linededup.repeated_lines(docs, bits=bits).collect()
        assert Counter((r._id, bytes(d)) for r in got for d in r.drops) == want


def plain_fingerprint(text, n=4):
    w = SPACE.findall(lower(text))
    if not w:
        return 0
    parts = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    label = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_simhash(docs, nothing):
    prints = [plain_fingerprint(r[1]) for r in ROWS]
    label, ids = grouped(prints), [r[0] for r in ROWS]
    least = {g: min((i for i, x in zip(ids, label) if x == g and i is not None), default=None) for g in set(label)}
    want = Counter((i, p, least[g]) for i, p, g in zip(ids, prints, label))
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_search_is_exact(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    many = [int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))) for c in np.repeat(centres, 12)]
    many += [int(centres[0]) ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)]
    fps = sorted(set(many))
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    for block, most, segments in ((1_024, 4, simhash.SEGMENTS), (16, 4, simhash.SEGMENTS), (64, 7, simhash.FOUR_SEGMENTS)):
        label = grouped_fast(fps, most)
        roots = {r.node % 2**64: r.root for r in components.components(simhash.links(df, most, segments, block)).collect()}
        mine = defaultdict(set)
        for f in fps:
            mine[roots.get(f, ("alone", f))].add(f)
        theirs = defaultdict(set)
        for f, g in zip(fps, label):
            theirs[g].add(f)
        assert {frozenset(x) for x in mine.values()} == {frozenset(x) for x in theirs.values()}


def grouped_fast(fps, most):
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= most
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (5, 5), (None, 3), (90, 80)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {80: 80, 90: 80, 100: 80}
    assert components.components(edges.limit(0)).count() == 0


def plain_targets(sizes):
    """Targets by weight, stopped at the cap, the excess shared again until none is above."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: (3, 1, 2)[i % 3] for i, x in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[x] for x in open_)
        full = {x for x in open_ if level * weight[x] > 2 * sizes[x]}
        if not full:
            return out | {x: level * weight[x] for x in open_}
        out |= {x: 2.0 * sizes[x] for x in full}
        left, open_ = left - sum(2 * sizes[x] for x in full), open_ - full
    return out


def plain_seats(w, seats):
    out = np.zeros(len(w), int)
    for _ in range(seats if np.any(w) else 0):
        out[np.argmax(w / (2 * out + 1))] += 1
    return out.tolist()


def test_targets_and_seats(spark, monkeypatch):
    schema = "_source string, source_size long, docs long"
    rng = np.random.default_rng(3)
    cases = [{"b": 100, "a": 100, None: 100}, {}, {"a": 0}, {"a": 0, "b": 7}, {"x": 160, "y": 160, "z": 160, "Z": 160, "é": 1}]
    cases += [{f"s{k}": int(n) for k, n in enumerate(rng.pareto(0.7, 60) * 40)}]
    for sizes in cases:
        for few in (mixing.FEW, 0):  # 0: the factor is narrowed as far as it goes
            monkeypatch.setattr(mixing, "FEW", few)
            table = spark.createDataFrame([(k, n, 1) for k, n in sizes.items()], schema).repartition(3)
            goals, total = mixing.targets(table)
            got = sorted(mixing.source_blocks(goals, total).collect(), key=lambda r: r["rank"])
            want = plain_targets(sizes)
            assert {r["_source"]: r["target"] for r in got} == pytest.approx(want) and [r["rank"] for r in got] == list(range(len(sizes)))
            assert [r["_source"] for r in got] == sorted(sizes, key=lambda x: (x is None, x or "")) and total == pytest.approx(sum(want.values()))
            assert [r["_blocks"] for r in got] == plain_seats(np.array([r["target"] for r in got]), int(total / mixing.BLOCK + 0.5))
    for _ in range(30):
        w, seats = rng.integers(0, 50, 7).astype(float), int(rng.integers(0, 60))
        assert mixing.sainte_lague(w, seats).tolist() == plain_seats(w, seats)
        given = mixing.shared_out(w, 3 * seats)
        assert given.sum() == min(3 * seats, 2 * w.sum()) and (given <= 2 * w).all()


@pytest.mark.parametrize("shard_docs, group", [(2, 2), (3, 1_024)])
def test_mix_takes_what_the_quotas_say(spark, docs, monkeypatch, shard_docs, group):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", group)
    got = mixing.mix(docs).collect()
    source = {x[0]: x[3] for x in ROWS}
    taken, goal, size = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r["size"]
        goal[source[r.doc_id]] = r.target
    order = sorted(goal, key=lambda x: (x is None, x or ""))
    blocks = plain_seats(np.array([goal[x] for x in order]), int(sum(goal.values()) / mixing.BLOCK + 0.5))
    assert [taken[x] for x in order] == [min(16 * b, 2 * size[x]) for x, b in zip(order, blocks)]


def test_mix(spark, docs, nothing):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in ROWS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    size, taken, target = Counter(), Counter(), {}
    for r, source in ((r, {x[0]: x[3] for x in ROWS}[r.doc_id]) for r in got):
        size[source] += r["size"]
        taken[source] += r.taken
        target[source] = r.target
        assert r.source_size == sum(len(words(x[1])) for x in ROWS if x[3] == source)
    assert target == pytest.approx(plain_targets(dict(size)))
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in target)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_licenses(docs, nothing):
    index = licenses.build_index(licenses.document_frequencies(docs))
    got = {r.doc_id: r for r in licenses.scan(docs, index).collect()}
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for r in ROWS:
        w = word.findall(lower(r[1]))
        found = [(i, label) for i in range(len(w)) for phrase, label in licenses.BASE if w[i : i + len(phrase.split())] == phrase.split()]
        g = got[r[0]]
        assert (g.n_words, g.n_base, g.base_labels) == (len(w), len(found), ",".join(sorted({x[1] for x in found})))
        assert (g.first_word, g.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1
    assert "mit" in got[11].labels.split(",") and got[12].labels == "gpl" and got[0].labels == ""
    assert licenses.scan(nothing, index).count() == 0


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("https://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("https://x.net", "x.net", "", None, "allow"),
        ("https://m.spam-farm.example.org/en/1", "m.spam-farm.example.org", "/en/1", None, "block"),
        ("https://spam.example.org/farm", "spam.example.org", "/farm", None, "allow"),
        ("a://b.net/fr/?q=http://c.com/", "b.net", "/fr/", "net/fr/", "block"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x"), (2, "http://spam.com/", "y"), (1, url, "x")], "page_id long, url string, host string")
    got = [r for r in urlfilter.judge(pages).collect() if r.page_id == 1]
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [(host, path, rule, verdict)] * 2


def test_urls_of_empty_table(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def plain_word(word, pieces, p):
    """Probability of a word in one language, by exact arithmetic over all segmentations."""
    alpha = [Fraction(1)]
    for end in range(1, len(word) + 1):
        found = [(n, Fraction(p[pieces.index(word[end - n : end])])) for n in range(1, end + 1) if word[end - n : end] in pieces]
        if word[end - 1] not in pieces:
            found.append((1, Fraction(langid.UNKNOWN)))
        alpha.append(sum(alpha[end - n] * x for n, x in found))
    return alpha[-1]


def log_of(x):
    return math.log(x.numerator) - math.log(x.denominator)


def test_language_model():
    pieces = ("▁", "a", "b", "ab", "▁a")
    lattice = langid.Lattice(pieces)
    p = np.array([[0.2], [0.3], [0.1], [0.25], [0.15]])
    got = lattice.forward(["▁ab", "▁b", "▁aéb"], p)[0][:, 0]
    assert got == pytest.approx([0.2 * 0.3 * 0.1 + 0.2 * 0.25 + 0.15 * 0.1, 0.2 * 0.1, (0.2 * 0.3 + 0.15) * langid.UNKNOWN * 0.1])
    counts = lattice.expected(["▁ab"], np.array([[1.0]]), p)[:, 0]
    paths = {(0, 1, 2): 0.006, (0, 3): 0.05, (4, 2): 0.015}
    assert counts == pytest.approx([sum(v for k, v in paths.items() if i in k) / 0.071 for i in range(5)])
    assert lattice.forward(["▁ab", "▁b"], p)[0][:, 0] == pytest.approx(got[:2])


def test_long_words_are_whole(monkeypatch):
    pieces = ("▁", "a", "b", "ab", "▁a", "abba", "bab")
    lattice, rng = langid.Lattice(pieces), np.random.default_rng(6)
    p = rng.dirichlet(np.ones(len(pieces)), 3).T
    words = ["▁" + "".join(rng.choice(list("abé"), n)) for n in (1, 5, 31, 32, 33, 255, 256, 257, 600)] + ["▁" + "é" * 300]
    want = [[log_of(plain_word(w, pieces, p[:, k])) for k in range(3)] for w in words]
    for doubles in (langid.LONG_DOUBLES, 2_000):
        monkeypatch.setattr(langid, "LONG_DOUBLES", doubles)
        assert np.allclose(lattice.long_logs(words, p), want, rtol=1e-9)
    short = [w for w in words if len(w) <= langid.SHORT]
    assert np.allclose(np.log(lattice.forward(short, p)[0]), want[: len(short)], rtol=1e-9)


def test_words_of_language_id():
    assert langid.words_of("Ab1c_d e\u0301e\u0301 हिन्दी ไทยยาว" + "語" * 50) == ["ab", "c", "d", "e\u0301e\u0301", "हिन्दी", "ไทยยาว" + "語" * 50]


def test_language_id(spark, docs, nothing):
    pieces = langid.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(k, ("the weather is rather nice today", "das wetter ist heute ziemlich schön")[k % 2], ("en", "de")[k % 2]) for k in range(40)] + [(90, None, "en"), (91, "12 !", "de"), (92, "", None), (93, "the nice weather", None), (93, "the nice weather", None)]
    rows += [(200, "thenice" * 20_000, "en"), (201, "dasschöne" * 300 + " ist " * 3_000, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.fit(table, pieces, F.col("doc_id") % 4 != 2)
    got = langid.predict(table, model).collect()
    assert all(r.lang_pred == ("en", "de")[r.doc_id % 2] and r.score > 0.9 for r in got if r.doc_id < 40)
    assert {(r.doc_id, r.lang_pred) for r in got if r.doc_id >= 90} == {(90, "und"), (91, "und"), (92, "und"), (93, "en"), (200, "en"), (201, "de")} and len(got) == len(rows)
    assert langid.predict(nothing, model).count() == 0
    empty = langid.fit(nothing, pieces, F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def plain_loglik(chain, symbols):
    a = np.eye(hmm.STATES + 1)[hmm.STATES]
    total = 0.0
    for x in symbols:
        a = (a @ chain.moves) * chain.emits[x]
        total += math.log(a.sum())
        a /= a.sum()
    return total


def plain_expected(chain, symbols):
    """One Baum-Welch step over a sequence, symbol by symbol."""
    n, s = len(symbols), hmm.STATES + 1
    forward, backward = [np.eye(s)[hmm.STATES]], [np.ones(s)]
    for x in symbols:
        a = (forward[-1] @ chain.moves) * chain.emits[x]
        forward.append(a / a.sum())
    for x in symbols[:0:-1]:
        b = chain.moves @ (chain.emits[x] * backward[-1])
        backward.append(b / b.sum())
    backward = backward[::-1]
    moves, emits = np.zeros((s, s)), np.zeros((len(chain.emits), hmm.STATES))
    for t in range(n):
        both = forward[t][:, None] * chain.moves * (chain.emits[symbols[t]] * backward[t])[None, :]
        both /= both.sum()
        moves += both
        emits[symbols[t]] += both.sum(axis=0)[: hmm.STATES]
    return moves, emits


@pytest.mark.parametrize("chunk, window", [(hmm.CHUNK, hmm.WINDOW), (64, hmm.WINDOW), (64, 300), (7, 16)])
def test_chain_is_exact(monkeypatch, chunk, window):
    monkeypatch.setattr(hmm, "CHUNK", chunk)
    monkeypatch.setattr(hmm, "WINDOW", window)
    rng = np.random.default_rng(2)
    chain = hmm.Chain.first(np.full(30, 1 / 30))
    chain = hmm.Chain(chain.moves, chain.emits * rng.gamma(1.0, 1.0, chain.emits.shape))
    sequences = [rng.integers(0, 30, n).astype("<u2") for n in (1, 5, 64, 65, 700, 2, 300, 301)]
    assert hmm._loglik(chain, sequences) == pytest.approx([plain_loglik(chain, x) for x in sequences])
    moves, emits = hmm._expected(chain, sequences)
    plain = [plain_expected(chain, x) for x in sequences]
    assert moves == pytest.approx(sum(m for m, _ in plain), rel=1e-3, abs=1e-3)
    assert emits == pytest.approx(sum(e for _, e in plain), rel=1e-3, abs=1e-3)
    better = chain.updated(moves, emits, np.full(30, 1 / 30))
    assert better.moves.sum(axis=1) == pytest.approx(np.ones(hmm.STATES + 1)) and better.emits.sum(axis=0)[:-1] == pytest.approx(np.ones(hmm.STATES))


def test_words_of_hmm():
    texts = [None, "", " \n\t", "A b\x0ba  ", "É é", "x" * 40 + "End " + "x" * 40 + "end", "\u2028 a"]
    n, which, keys = hmm.split(hmm.pa.array(texts))
    want = [words(lower(t)) for t in texts]
    found = iter(keys.to_pylist()[k] for k in which)
    assert [[next(found) for _ in range(k)] for k in n] == [[hmm.key_of(w.encode()) for w in ws] for ws in want]
    long = hmm.key_of(b"x" * 40 + b"end")
    assert len(long) <= hmm.KEY_BYTES and hmm.class_of(long) == hmm.class_of(b"more than thatend")


def test_most_frequent_words(spark):
    rng = np.random.default_rng(4)
    rows = [(f"w{k}".encode(), int(n)) for k, n in enumerate(np.r_[rng.integers(1, 9, 400), 4_096, 4_097, 9_000, 9_001, 10**12])]
    counts = spark.createDataFrame(rows, "word binary, n long")
    for most in (0, 1, 4, 60, 200, 1_000):
        got = hmm._most_frequent(counts, most)
        least = min((n for _, n in got), default=None)
        assert len(got) <= most and got == sorted((r for r in rows if least is not None and r[1] >= least), key=lambda r: (-r[1], r[0]))
    assert len(hmm._most_frequent(counts, 1_000)) == len(rows) and hmm._most_frequent(counts.limit(0), 5) == []


@pytest.mark.parametrize("tabled, frequent", [(hmm.TABLED, hmm.FREQUENT), (40, 5), (0, 0)])
def test_hmm_scores(monkeypatch, docs, tabled, frequent):
    monkeypatch.setattr(hmm, "TABLED", tabled)
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    kept = {}
    trained = hmm._trained
    monkeypatch.setattr(hmm, "_trained", lambda *args: kept.setdefault("chain", trained(*args)))
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    got = hmm.score(docs, training, rounds=1).collect()
    taught = [r for r in ROWS if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    counts = Counter(w for r in taught for w in words(lower(r[1])))
    n, v = sum(counts.values()) + len(taught), len(counts) + 1
    one = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    ranked = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    listed = [w for w in ranked if sum(c >= counts[w] for c in counts.values()) <= tabled]
    own = {w: k for k, w in enumerate(listed[:frequent])}
    size = defaultdict(lambda: [0, 0])
    for w in set(counts) - set(own):
        size[hmm.class_of(w.encode())][0] += counts[w]
        size[hmm.class_of(w.encode())][1] += 1
    want = Counter()
    for r in ROWS:
        w = words(lower(r[1]))
        symbols = [own[x] if x in own else len(own) + hmm.class_of(x.encode()) for x in w] + [len(own) + hmm.CLASSES]
        share = sum(math.log10((counts[x] + 0.5) / (size[hmm.class_of(x.encode())][0] + 0.5 * (size[hmm.class_of(x.encode())][1] + 1))) for x in w if x not in own)
        score = plain_loglik(kept["chain"], symbols) / math.log(10) + share
        want[r[0], len(w) + 1, sum(x in counts for x in w) + 1, n, round(sum(one(counts[x]) for x in w) + one(len(taught)), 5), round(score, 5)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want


def test_hmm_without_rows_to_learn_from(docs, nothing):
    assert hmm.score(nothing, F.lit(True), rounds=1).count() == 0
    assert hmm.score(docs, F.lit(False), rounds=1).count() == len(ROWS)


def test_fingerprints(docs, nothing):
    got = editprint.with_neighbours(docs).collect()
    assert len(got) == len(ROWS)
    ids = [r[0] for r in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0], reverse=True)]
    texts = {r[0]: r[1] or "" for r in ROWS}
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for here, there in zip(ids, [*ids[1:], ids[0]]):
        a, b = texts[here], texts[there]
        cut = len(a) // 3
        edited = a[: len(a) - cut] + b[:cut]
        assert any(r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(a) for r in by_id[here])
    first = editprint.prints([r[1] or "" for r in ROWS])
    own = {r[0]: x for r, x in zip(ROWS, first)}
    for here, there in zip(ids, [*ids[1:], ids[0]]):
        other = editprint.prints([editprint.edited(texts[here], texts[there])])[0]
        row = (own[here].hex(), other.hex(), editprint.likeness(own[here], other), editprint.likeness(own[here], own[there]))
        assert row in [(r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in by_id[here]]
    big = by_id[13][0]
    assert big.near_edited > 0.5 and by_id[14][0].near_next > 0.95
    assert editprint.with_neighbours(nothing).count() == 0
    groups = {r.doc_id: r.group for r in editprint.near_groups(docs).collect()}
    assert groups[13] == groups[14] and groups[15] == groups[16] and groups[3] != groups[13]
