import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_columns_and_effects(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    out = corpus_pipeline.byte_bpe(spark, docs, sf)
    assert out.count() == docs.count() and public_tokenizers.PATTERN


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_near_dedup_links_by_fingerprints_and_by_shingle_sets(spark):
    body = "one two three " * 200  # three shingles: no bit ties
    other = [f"w{k}" for k in range(60)]
    texts = {
        1: body + " ".join(f"a{k}" for k in range(12)),  # equal fingerprints, few equal shingles
        2: body + " ".join(f"b{k}" for k in range(12)),
        3: " ".join(other),
        4: " ".join(other[:-2]),  # shingle sets alike
        5: "nothing like the others at all",
        None: None,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5]
