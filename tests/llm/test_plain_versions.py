"""Method labels and scores of the native operators against plain Python versions, and very long texts."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinlink.llm import langid, licenses, quality

NOTICE = licenses.TEMPLATES[0].words
TEXTS = [
    "",
    None,
    "no licence here at all",
    f"Intro words. {NOTICE.upper()}, and so on.",
    "released under the mit license; licensed under the apache license, version 2.0",
    "permission is hereby granted free of charge but then it goes on in other words altogether",
    "mit license mit license released under the mit licence",
    "All Rights Reserved. CC BY 4.0, GNU General Public License",
    "this work is licensed under cc by sa 4 0 and cc by nc",
    "word " * 5_000 + NOTICE + " word" * 5_000,
    f"{NOTICE} {NOTICE}",
    "free of charge to any person obtaining a copy of this software",
]


def plain_labels(text, index):
    """Labels and score: two postings or more that agree on a place, and the key phrase where it must be."""
    words = [w for w in re.split(licenses.NOT_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    labels = {label for phrase, label in licenses.BASE if f" {phrase} " in f" {' '.join(words)} "}
    votes = Counter((t, i - p) for i, w in enumerate(words) for t, p in index.get(w, ()))
    score = 1.0 if labels else 0.0
    for (t, at), n in votes.items():
        template, key = licenses.TEMPLATES[t].words.split(), licenses.TEMPLATES[t].key.split()
        begin = at + next(i for i in range(len(template)) if template[i : i + len(key)] == key)
        if n > 1 and begin >= 0 and words[begin : begin + len(key)] == key:
            labels.add(licenses.TEMPLATES[t].label)
            score = max(score, sum(0 <= at + p < len(words) and words[at + p] == w for p, w in enumerate(template)) / len(template))
    return ",".join(sorted(labels)), score


def test_license_labels_and_score(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    index = licenses.build_index(licenses.document_frequencies(docs))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs, index).collect()}
    for k, t in enumerate(TEXTS):
        labels, score = plain_labels(t, index)
        assert got[k][0] == labels, t
        assert got[k][1] == pytest.approx(score), t


def plain_score(text, ratios, bucket):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    grams = [bucket[(w,)] for w in words] + [bucket[pair] for pair in zip(words, words[1:])]
    return sum(ratios[b] for b in grams) / len(grams) if grams else 0.0


def test_quality_score(spark):

    texts = ["good words make good texts " * 8, "spam spam buy now " * 9, None, "", "x", "one two three\nfour  five\tsix", "long text of words " * 4_000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    split = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for t in texts]
    grams = sorted({(w,) for ws in split for w in ws} | {p for ws in split for p in zip(ws, ws[1:])})
    frame = spark.createDataFrame([(g[0], g[-1], len(g)) for g in grams], "a string, b string, n int")
    one, two = F.xxhash64("a"), F.xxhash64(F.xxhash64("a"), F.xxhash64("b"))
    rows = frame.select("a", "b", "n", F.pmod(F.when(F.col("n") == 1, one).otherwise(two), F.lit(quality.BUCKETS)).alias("k")).collect()
    bucket = {((r["a"],) if r["n"] == 1 else (r["a"], r["b"])): r["k"] for r in rows}
    counted = lambda chosen: Counter(bucket[g] for k in chosen for g in [*((w,) for w in split[k]), *zip(split[k], split[k][1:])])
    raw, target = counted(range(len(texts))), counted((0, 5))
    share = lambda c, b: math.log((c[b] + quality.SMOOTHING) / (sum(c.values()) + quality.SMOOTHING * quality.BUCKETS))
    assert all(model.ratios[b] == pytest.approx(share(target, b) - share(raw, b)) for b in range(0, quality.BUCKETS, 7))
    for r in quality.judge(docs, model).collect():
        score = plain_score(texts[r["doc_id"]], model.ratios, bucket)
        assert r["score"] == pytest.approx(score)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= model.threshold)


def test_plain_words_are_the_words():
    texts = ["", "plain ascii words 12", "schön ist’s", "éa", "हिन्दी", "\U0001f600 smile", "a\U0001e8d0b", "語" * 50, "İstanbul ẞ"]
    assert [langid.words_of(t) for t in texts] == [langid.WORD.findall(t.lower()) for t in texts]


def test_quality_harm(spark):
    """Toxic words, their ratios, the limit and every harm against plain Python; equal texts count once."""
    filler = lambda i: " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(25 + i % 5))
    rows = [(i, filler(i) + (f" Bad{i % 3}! line" if i % 2 else "")) for i in range(400)] + [(400 + i, filler(1) + " Bad1! line") for i in range(30)]
    rows += [(500, None), (501, ""), (502, "BAD1"), (503, "bad1 " * 30_000), (504, "w1 " * 30), (None, filler(3) + " bad2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(t is not None and "Bad" in t)) for i, t in rows[:430]], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    halves = dict(docs.filter("doc_id < 430").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("terms")), F.lit(2))).collect())
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    hashed = dict(spark.createDataFrame([(w,) for w in sorted({w for _, t in rows for w in words(t)})], "w string").select("w", F.xxhash64("w")).collect())
    learnt = {(int("Bad" in t), t) for i, t in rows[:430] if halves[i] == 0}
    n = [sum(s == 0 for s, _ in learnt), sum(s == 1 for s, _ in learnt)]
    seen = [Counter(w for s, t in learnt if s == side for w in set(words(t))) for side in (0, 1)]
    cell = lambda x, of, p: x * math.log(x / (of * p)) if x else 0.0
    terms = {}
    for w, h in hashed.items():
        b, a = seen[0][w], seen[1][w]
        p = (a + b) / sum(n)
        if 0 < p < 1 and 2 * (cell(a, n[1], p) + cell(b, n[0], p) + cell(n[1] - a, n[1], 1 - p) + cell(n[0] - b, n[0], 1 - p)) >= quality.LEAST_G2 and a * n[0] > b * n[1]:
            terms[h] = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
    assert {hashed["line"], hashed["bad1"]} <= set(terms) and dict(model.terms) == pytest.approx(terms)
    harm = lambda t: sum(terms.get(hashed[w], 0.0) for w in words(t)) / max(1, len(words(t)))
    held = [sorted(harm(t) for i, t in rows[:430] if halves[i] == 1 and ("Bad" in t) == side) for side in (False, True)]
    assert model.limit == pytest.approx((held[0][int(quality.KEEP_SHARE * len(held[0]))] + held[1][int((1 - quality.KEEP_SHARE) * len(held[1]))]) / 2)
    judged = {(r.doc_id, r.harm, r.kept, r.base_failed) for r in quality.judge(docs, model).collect()}
    texts = dict(rows)
    assert len(judged) == len(rows) and all(h == pytest.approx(harm(texts[i])) for i, h, _, _ in judged)
    assert all(not kept for _, h, kept, _ in judged if h > model.limit) and not any(failed for i, _, _, failed in judged if i is not None and i < 430)
    clean = quality.fit(docs, labels.filter("toxic = 0"))
    assert clean.terms == () and {r.harm for r in quality.judge(docs, clean).collect()} == {0.0}
    assert all(r.harm == 0.0 for r in quality.judge(docs, quality.fit(docs, labels.filter("toxic = 1"))).collect())


def test_quality_learns_from_all_labelled_rows(spark):
    docs = spark.createDataFrame([(i, f"word{i} and so on") for i in range(4_200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4_200)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)  # all documents are trusted, so that target and raw counts are equal
    assert set(model.ratios) == {0.0}


def test_thresholds_are_order_statistics(spark):
    values = [((7 * i) % 2_003) / 10 for i in range(2_003)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for at in (0, 4, 1_000, 1_998, 2_002):
        assert quality._nth(frame, at, len(values)) == sorted(values)[at]


def test_few_texts_without_label_are_shuffled(spark):
    docs = spark.createDataFrame([(None if i % 7 == 0 else i // 2, f"text {i}") for i in range(20_000)], "_id long, _text string").repartition(3)
    ids = spark.range(0, 20_000, 5).select(F.col("id").alias("_id"), F.lit(True).alias("good"))
    want = sorted(tuple(r) for r in docs.join(ids, "_id").select("_id", "_text").collect())
    assert sorted(tuple(r) for r in quality._joined(docs, ids, "_id").select("_id", "_text").collect()) == want
    assert len(want) <= quality._marked(docs, ids, "_id").count() <= 1.01 * len(want)
    assert quality._joined(docs, ids.limit(0), "_id").count() == 0
