"""Near-duplicates against brute force."""

import random
from collections import defaultdict

import corpus_pipeline
from kinlink.llm import editprint, jaccard, simhash

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """Component number of each text, by all pairs."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return label


def partition(labels):
    groups = defaultdict(set)
    for k, x in enumerate(labels):
        groups[x].add(k)
    return {frozenset(g) for g in groups.values()}


def corpus():
    """Copies with 0 to 5 changed words in 120, around the least similarity, and texts that share long passages."""
    rng = random.Random(3)
    texts = [None, "", "one", "One ", "a b c d e"]
    for base in range(30):
        words = [f"v{rng.randrange(3_000)}" for _ in range(120)]
        for changed in (0, 1, 2, 2, 3, 3, 4, 5):
            copy = list(words)
            for at in rng.sample(range(len(copy)), changed):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    passage = " ".join(f"p{k}" for k in range(150))
    for k in range(60):
        own = [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 60))]
        texts += [f"{passage} {' '.join(own)}", f"{passage} {' '.join(own[:-2])} y{k}"]
    return texts


def test_stage_links_what_brute_force_links(spark):
    texts = corpus()
    want = partition(brute(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    for block in (jaccard.BLOCK, 16):
        root = {r.doc_id: r.root for r in jaccard.near_duplicates(docs, block=block).collect()}
        assert partition([root[k] for k in range(len(texts))]) == want
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in want)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_representatives_without_or_with_repeated_ids(spark):
    long = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcde"]
    rows = [(None, long[0]), (None, long[0]), (None, long[1]), (None, long[2]), (7, long[3]), (7, long[4]), (8, long[4])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for operator in (simhash, jaccard):
        kept = sorted((r.text, r.doc_id) for r in operator.representatives(docs).collect())
        assert kept == [(long[0], None), (long[1], None), (long[2], None), (long[3], 7), (long[4], 7)]
        none = operator.representatives(docs.filter("doc_id is null")).collect()
        assert sorted(r.text for r in none) == long[:3]


def plain_print(text):
    """The fingerprint by its definition, character by character."""
    if not text:
        return editprint.EMPTY
    codes, n = [ord(c) for c in text], len(text)
    padded = codes + [0x110000] * editprint.CONTEXT
    steps, bits = editprint.steps_of(n), editprint.shared_bits()
    top = steps.bit_length() - 1
    out = bytearray([top + 1])
    for walk in range(editprint.WALKS):
        pointer, at = [], 0
        for j in range(steps):
            pointer.append(at)
            if at < n:
                kind = ((codes[at] * 0x9E3779B1 % 2**32) >> 16) % 255
                at += int(bits[j % editprint.PERIOD, kind]) >> walk & 1
        assert at == n
        for block, number in editprint.places(top):
            j = editprint.drawn(block)[number]
            if j >= steps or pointer[j] == n:
                out.append(0)
                continue
            h = 0
            for code in padded[pointer[j] : pointer[j] + editprint.CONTEXT]:
                h = (h ^ code) * 0x85EBCA6B % 2**32
            h ^= h >> 15
            out.append(1 + h % 255)
    return bytes(out)


def edit_corpus():
    rng = random.Random(11)
    passage = " ".join(f"p{rng.randrange(10**4)}" for _ in range(120))
    texts = [None, "", "x", "xy", "Ümlaut 🙂", "x" * 3_000]
    for k in range(60):
        own = [f"q{rng.randrange(10**6)}" for _ in range(90)]
        texts.append(f"{passage} {' '.join(own)}")
        own[rng.randrange(90)] = "changed"
        texts.append(f"{passage} {' '.join(own)}")
    return texts


def test_fingerprints_are_sampled_walk_positions(monkeypatch):
    texts = [t or "" for t in edit_corpus()][:40]
    want = [plain_print(t) for t in texts]
    assert editprint.prints(texts) == want
    for many in (1, 7, 10**6):  # all together, some, and one by one
        monkeypatch.setattr(editprint, "MANY", many)
        assert editprint.prints(texts) == want and editprint.prints(texts[:1] + texts[5:6]) == [want[0], want[5]]


def test_likeness_follows_edits():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(900, 4_000))) for _ in range(150)]

    def changed(text, edits):
        chars = list(text)
        for _ in range(edits):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice(([], ["#"], ["#", chars[at]]))
        return "".join(chars)

    found = {}
    for edits in (1, 4, 64):
        copies = [changed(t, edits) for t in base]
        prints = editprint.prints(base + copies)
        pairs = list(zip(prints, prints[len(base) :]))
        found[edits] = sorted(editprint.likeness(a, b) for a, b in pairs)[len(base) // 2]
        near = [(a, b) for a, b in pairs if editprint.likeness(a, b) >= 0.8]
        # recall of the bands over all pairs that are near: 0.9 at least (it is above 0.99)
        assert sum(bool(set(editprint.band_keys(a)) & set(editprint.band_keys(b))) for a, b in near) >= 0.99 * len(near)
    assert found[1] > 0.95 and found[1] > found[4] > 0.8 > found[64]
    unlike = editprint.prints(base)
    assert max(editprint.likeness(a, b) for a, b in zip(unlike, unlike[1:])) < 0.3


def test_edit_groups_hold_every_pair_that_shares_a_band(spark):
    texts = edit_corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    prints = editprint.prints([t or "" for t in texts])
    bands = [set(editprint.band_keys(p)) for p in prints]
    label, shared, near = list(range(len(texts))), 0, 0
    for a in range(len(texts)):
        for b in range(a):
            if editprint.likeness(prints[a], prints[b]) >= 0.8:
                near += 1
                shared += prints[a] == prints[b] or bool(bands[a] & bands[b])
                if prints[a] == prints[b] or bands[a] & bands[b]:
                    label = [label[b] if x == label[a] else x for x in label]
    assert near >= 60 and shared >= 0.99 * near
    for block in (jaccard.BLOCK, 16):
        group = {r.doc_id: r.group for r in editprint.near_groups(docs, block=block).collect()}
        assert partition([group[k] for k in range(len(texts))]) == partition(label)


def test_components_of_prints_and_sets_are_searched_once(spark, monkeypatch):
    """Chains of both kinds of links are one component; the graph is searched once for both."""
    calls, search = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda *a, **k: calls.append(1) or search(*a, **k))
    monkeypatch.setattr(simhash, "components", lambda *a, **k: calls.append(1) or search(*a, **k))
    body = "one two three " * 200
    tail = lambda c, n: body + " ".join(f"{c}{k}" for k in range(n))
    texts = [tail("a", 12), tail("b", 12), tail("b", 12), " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(58)), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == [0, 3, 5] and len(calls) == 1
