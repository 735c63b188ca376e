import random
from functools import lru_cache

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinlink.functions import similarity as S
from kinlink.operators import pairs
from kinlink.plans import catalog

WORDS = st.text("abc ", max_size=14)


def lcs(a, b):
    @lru_cache(None)
    def go(i, j):
        if i == len(a) or j == len(b):
            return 0
        return go(i + 1, j + 1) + 1 if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

    return go(0, 0)


@settings(max_examples=150, deadline=None)
@given(WORDS, WORDS)
def test_lcs_and_ratios(a, b):
    assert S.lcs_length(a, b) == lcs(a, b)
    for f in (S.ratio_of, S.token_sort_of, S.token_set_of, S.partial_of):
        assert 0 <= f(a, b) <= 100 + 1e-9 and abs(f(a, b) - f(b, a)) < 1e-9
    if a.strip():
        assert S.ratio_of(a, a) == S.token_set_of(a, a) == S.partial_of(a, a) == 100


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", min_size=1, max_size=10), st.text("abcd", min_size=1, max_size=10))
def test_jaro_winkler_against_duckdb(a, b):
    want = duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]
    assert abs(S.jaro_winkler_of(a, b) - want) < 1e-9


def test_fixed_cases():
    assert round(S.jaro_winkler_of("martha", "marhta"), 4) == 0.9611
    assert S.token_set_of("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert S.token_set_of("", "a") == 0
    assert S.partial_of("yankees", "new york yankees") == 100
    assert S.ratio_of("", "") == 100


def test_equal_pairs_of_texts_are_compared_once():
    seen = []

    def f(a, b):
        seen.append((a, b))
        return 0.1234565

    for _ in range(2):
        assert S.matrix_of(f, ["x", "y"], np.array([[True, True], [False, False]])).tolist() == [[0.123457, 0.123457], [0, 0]]
    assert seen == [("x", "x"), ("x", "y")]


def test_neighbours_are_all_pairs_of_a_group(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.choice((1, 2, None)), k, " ".join(rng.sample(["red", "ring", "é", "bolt"], 2))) for k in rng.sample(range(1000), 90)]
    df = spark.createDataFrame(rows, "g string, s int, id long, x string")
    want = {(a[2], b[2]): (a[3], b[3]) for a in rows for b in rows if a[:2] == b[:2] and a[1] is not None and a[2] < b[2]}
    for size, out in ((pairs.ROWS, pairs.OUT), (7, 5)):
        monkeypatch.setattr(pairs, "ROWS", size)
        monkeypatch.setattr(pairs, "OUT", out)
        got = {(a, b): sim for a, b, sim in pairs.neighbour_similarity(df, ["g", "s"], "id", "x", S.levenshtein_of).collect()}
        assert got == {k: round(S.levenshtein_of(*v), 6) for k, v in want.items()}
    texts = spark.createDataFrame([v for v in want.values()] + [("", ""), ("", "a"), ("abc", "")], "a string, b string")
    assert all(S.levenshtein_of(a, b) == sim for a, b, sim in texts.select("a", "b", S.levenshtein(texts.a, texts.b)).collect())


def test_brand_neighbours_of_any_size_are_compared(spark, tmp_path):
    """Pairs of a brand whatever their sizes; null texts keep their pairs, as SQL does."""
    rng = random.Random(11)
    rows = [(k, rng.choice(["red ring", "old bolt", "ring red", None]), rng.choice(["Brand#1", "Brand#2", None]), rng.choice(["LARGE", "SMALL", None]), rng.choice([1, 2, None])) for k in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    with duckdb.connect() as db:
        db.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
        for name in ("sim_levenshtein", "sim_jaro_winkler", "sim_ratio", "sim_token_set"):
            want = db.execute(catalog.SQL[name]).fetchall()
            got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
            assert len(got) == len(want) and sorted(got) == sorted(want), name
            if name in ("sim_levenshtein", "sim_jaro_winkler"):
                of = {k: brand for k, _, brand, _, _ in rows}
                assert {x[:2] for x in got} == {(a, b) for a in of for b in of if a < b and of[a] and of[a] == of[b]}
            assert any(x[2] is None for x in got)
