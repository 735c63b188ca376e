import zlib

import pytest
from pyspark.sql import functions as F

from kinlink.functions import text as T
from kinlink.functions import tokens as K
from kinlink.operators.learning import holdout, learn_word_map
from kinlink.operators.records import normalize_records


def names(spark, raw):
    df = spark.createDataFrame([("S1-1", raw, None, "US")], "entity_id string, business_name string, business_address string, country string")
    return normalize_records(df).first()


def address(spark, raw):
    df = spark.createDataFrame([("S1-1", None, raw, "US")], "entity_id string, business_name string, business_address string, country string")
    return normalize_records(df).first()


@pytest.mark.parametrize(
    "raw, norm, core",
    [
        ("Orelee's", "orelees", "orelees"),
        ("highlandintelligence.com", "highlandintelligence", "highlandintelligence"),
        ("K0lkata 5hree Ni1giri Bui1ding", "kolkata shree nilgiri building", "kolkata shree nilgiri building"),
        ("21st 4th 3m 2024", "21st 4th 3m 2024", "21st 4th 3m 2024"),
        ("राम मार्केटिंग प्राइवेट लिमिटेड", "ram marketing private limited", "ram marketing"),
        ("ABC Services Pvt Ltd", "abc services private limited", "abc services"),
        ("ABC Pvt", "abc private", "abc private"),
        ("Foo S.A.R.L.", "foo s a r l", "foo s a r l"),
        ("Summit Solutions Group", "summit solutions group", "summit solutions group"),
        ("A & B", "a and b", "a and b"),
        (None, "", ""),
    ],
)
def test_names(spark, raw, norm, core):
    row = names(spark, raw)
    assert (row.name_norm, row.name_core, row.name_compact) == (norm, core, core.replace(" ", ""))


@pytest.mark.parametrize(
    "raw, number",
    [("IA, Iowa City, 1064 Newton Rd", "1064"), ("Plot 45, Industrial Area, Surat", "45"), ("630 45th Terrace, Kansas City, MO", ""), ("No. 0253, Main", "253")],
)
def test_house_numbers(spark, raw, number):
    assert address(spark, raw).house_number == number


@pytest.mark.parametrize("raw", [None, "", "nan", "None", " null "])
def test_missing_address(spark, raw):
    row = address(spark, raw)
    assert row.addr_missing and (row.addr_norm, row.landmark, row.house_number, row.addr_key) == ("", "", "", "")


def test_addresses(spark):
    assert address(spark, "12 Main Street").addr_norm == address(spark, "12 Main St").addr_norm == "12 main st"
    assert address(spark, "BIG LAKE, MN, 1373 MANITOU ST").addr_key == address(spark, "1373 MANITOU ST, BIG LAKE, MN").addr_key
    row = address(spark, "Near SBI ATM, Plot 45")
    assert row.landmark == "near sbi atm" and row.addr_norm == "near sbi atm, plot 45"


def test_transliteration():
    assert T.transliterate_text("प्रा. लि.").startswith("private limited")
    assert T.transliterate_text("റ്റ") == "tt"
    assert T.transliterate_text("१२३") == "123"
    assert T.transliterate_text("plain") == "plain"


def test_tokens(spark):
    df = spark.createDataFrame([("Ab é_1 x", "a, ,b,c", "12 b7 8a 9ab")], "w string, c string, n string")
    row = df.select(K.words(F.col("w")), K.components(F.col("c")), K.numbers(F.col("n")), K.char_grams(F.col("w"))).first()
    assert row[0] == ["Ab", "é_1", "x"] and row[1] == ["a", "b", "c"] and row[2] == ["12", "8a"]
    assert row[3] == [" Ab", "Ab ", " é_", "é_1", "_1 ", " x "]


def test_holdout(spark):
    ids = [f"S1-{k:05d}" for k in range(50)]
    got = spark.createDataFrame([(i,) for i in ids], "i string").select("i", holdout(F.col("i"))).collect()
    assert all(r[1] == (zlib.crc32(r[0].encode()) % 5 == 0) for r in got)


def test_word_map(spark):
    s1 = spark.createDataFrame([(f"S1-{k}", "Life Industries", "", "India") for k in range(3)], "entity_id string, business_name string, business_address string, country string")
    pool = spark.createDataFrame([(f"S2-{k}", "लाइफ इंडस्ट्रीज", "", "India") for k in range(3)], s1.schema)
    truth = spark.createDataFrame([(f"S1-{k}", f"S2-{k}") for k in range(3)], "s1_id string, t_id string")
    words = {r.word: r.reading for r in learn_word_map(s1, pool, truth).collect()}
    assert words == {"लाइफ": "life", "इंडस्ट्रीज": "industries"}
    assert normalize_records(pool, words).first().name_norm == "life industries"
