"""Queries of the text rules and tokenisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink.functions import text as T
from kinlink.functions import tokens as K
from kinlink.operators.learning import holdout
from kinlink.operators.records import normalize_records
from kinlink.plans import duck, duck_pairs as D
from kinlink.plans.registry import query
from kinlink.plans.views import RECORDS, table, view


def records(spark, sf_dir):
    """The normalised record view."""
    return normalize_records(view(spark, sf_dir, RECORDS, "part"))


NORMAL = ["entity_id", "country", "name_norm", "name_core", "name_compact", "addr_norm", "house_number", "combined", "addr_key", "name_key"]


@query("norm_records", f"select {', '.join(NORMAL)} from {duck.records()}")
def norm_records(spark, sf_dir):
    return records(spark, sf_dir).select(*NORMAL)


@query("norm_name", f"select doc_id, {duck.name_norm('text')} as name_norm, {duck.name_core(duck.name_norm('text'))} as name_core from documents")
def norm_name(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", T.name_norm(F.col("text")).alias("name_norm"))
    return df.withColumn("name_core", T.strip_legal_forms(F.col("name_norm")))


@query("norm_address", f"select doc_id, {duck.address_norm('text')} as addr_norm from documents")
def norm_address(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.address_norm(T.address_base(F.col("text"))).alias("addr_norm"))


@query("norm_accents", f"select doc_id, {duck.unaccented('text')} as plain from documents")
def norm_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(T.strip_accents(F.col("text"))).alias("plain"))


@query("norm_leading_zero", f"select c_custkey, {duck.zeros('c_name')} as plain from customer union all select s_suppkey, {duck.zeros('s_name')} from supplier")
def norm_leading_zero(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", T.strip_leading_zeros(F.col("c_name")).alias("plain"))
    return c.union(table(spark, sf_dir, "supplier").select("s_suppkey", T.strip_leading_zeros(F.col("s_name"))))


@query("norm_url", f"select page_id, {duck.website('lower(url)')} as name from pages")
def norm_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.drop_website_parts(F.lower("url")).alias("name"))


@query("norm_junk", f"select c_custkey, {duck.junk("'id #' || cast(c_custkey as string) || ' ' || lower(c_name) || ' d/b/a x'")} as name from customer")
def norm_junk(spark, sf_dir):
    name = F.concat(F.lit("id #"), F.col("c_custkey").cast("string"), F.lit(" "), F.lower("c_name"), F.lit(" d/b/a x"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.drop_junk_ids(name).alias("name"))


@query("digit_letter_fix", f"select p_partkey, {duck.digit_letters("translate(p_name, 'oe', '03') || ' 21st ' || lower(p_brand)")} as fixed from part")
def digit_letter_fix(spark, sf_dir):
    noisy = F.concat(F.translate("p_name", "oe", "03"), F.lit(" 21st "), F.lower("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.digits_as_letters(noisy).alias("fixed"))


@query("order_invariant_key", f"select doc_id, {duck.key('text')} as k from documents")
def order_invariant_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.order_free_key(F.col("text")).alias("k"))


@query("house_number", f"select entity_id, {duck.house_number('business_address')} as house_number from ({RECORDS}) r")
def house_number(spark, sf_dir):
    df = view(spark, sf_dir, RECORDS, "part")
    return df.select("entity_id", T.house_number(T.strip_leading_zeros(T.address_base(F.col("business_address")))).alias("house_number"))


@query("landmark", "select doc_id, trim(regexp_extract(lower(strip_accents(text)), '\\b(near|opp|opposite|behind|beside|adjacent to|adj|next to|in front of)\\s+([^,]+)', 0)) as landmark from documents")
def landmark(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.landmark(F.lower(T.strip_accents(F.col("text")))).alias("landmark"))


@query("tokens_word", f"select doc_id, len(t) as n, len(list_distinct(t)) as n_distinct, array_to_string(list_sort(list_distinct(t)), ' ') as tokens from (select doc_id, {duck.words('lower(text)')} as t from documents)")
def tokens_word(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", K.words(F.lower("text")).alias("t"))
    return df.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("tokens"))


@query(
    "tokens_char3",
    "select gram, count(*) as n from (select unnest(list_transform(range(1, greatest(length(w) - 1, 2)), lambda i: substr(w, i, 3))) as gram from "
    "(select ' ' || unnest(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) || ' ' as w from documents)) group by gram",
)
def tokens_char3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(K.char_grams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("tokens_component", "select doc_id, len(list_filter(list_transform(string_split(text, ','), lambda c: trim(c)), lambda c: c <> '')) as n from documents")
def tokens_component(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(K.components(F.col("text"))).cast("long").alias("n"))


@query("tokens_number", "select page_id, array_to_string(list_transform(regexp_extract_all(url, '\\b(\\d+[a-z]?)\\b', 1), lambda x: x), ' ') as numbers from pages")
def tokens_number(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(K.numbers(F.col("url")), " ").alias("numbers"))


@query("tokens_hashed")
def tokens_hashed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(K.hashed(K.words(F.lower("text")))).alias("n"))


@query("transliterate")
def transliterate(spark, sf_dir):
    """Every conversation turn beside a rendering of it with Brahmic digits and marks mixed in."""
    text = F.concat(F.lit("राम मार्केटिंग प्राइवेट लिमिटेड "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.name_norm(text).alias("name"))


@query("holdout_split", f"select c_custkey, {D.crc32("'S1-' || cast(c_custkey as string)")} % 5 = 0 as held_out from customer")
def holdout_split(spark, sf_dir):
    key = F.concat(F.lit("S1-"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", holdout(key).alias("held_out"))
