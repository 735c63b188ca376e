import inspect
import random
import threading

import pytest
from pyspark.sql import functions as F

from kinlink.operators import blocking, context, decision, evaluation, learning, pairs, validation
from kinlink.operators.records import normalize_records
from kinlink.plans import decision_queries, pair_queries
from kinlink.sources import sampling, synthetic, tables
from kinlink.sources.shared import materialize


def test_f05(spark):
    e = spark.createDataFrame([(c,) for c in "abcdefg"], "s1_id string")
    said = spark.createDataFrame([("a", "S2-00047"), ("a", "S2-00193"), ("a", "S3-00812"), ("c", "x"), ("e", "y"), ("f", "x"), ("g", "x")], "s1_id string, t_id string")
    true = spark.createDataFrame([("a", "S2-00047"), ("a", "S3-00812"), ("d", "x"), ("e", "x"), ("f", "x"), ("g", "x"), ("g", "y")], "s1_id string, t_id string")
    got = {r.s1_id: round(r.f05, 6) for r in decision.entity_scores(e, said, true).collect()}
    assert got == {"a": round(5 / 7, 6), "b": 1.0, "c": 0.0, "d": 0.0, "e": 0.0, "f": 1.0, "g": round(0.625 / 0.75, 6)}
    none = decision.macro(decision.entity_scores(e.limit(0), said, true)).first()
    assert (none.singleton_accuracy, none.matches_macro_f05) == (1.0, 0.0)


def test_owner_and_decision(spark):
    df = spark.createDataFrame([("US", "a", "t1", 0.9), ("US", "b", "t1", 0.8), ("US", "b", "t2", 0.7)], "country string, s1_id string, t_id string, p double")
    owned = decision.one_owner(df)
    assert {(r.s1_id, r.t_id) for r in owned.filter("owner").collect()} == {("a", "t1"), ("b", "t2")}
    assert [(r.s1_id, r.t_id) for r in decision.decide(owned, 0.5, 0.75, 0.9).filter("matched").collect()] == [("a", "t1")]


def test_grid_has_336_points():
    assert len(decision.grid()) == 336


def test_group_context(spark):
    df = spark.createDataFrame([("a", "1", 0.5), ("a", "2", 0.5), ("a", "3", None), ("b", "1", 0.2)], "s1_id string, t_id string, v double")
    got = {(r.s1_id, r.t_id): (r.n_cands, r.v_rank, r.v_gap_best, r.v_gap_second) for r in context.group_context(df, ["s1_id"], ["v"]).collect()}
    assert got == {("a", "1"): (3, 1, 0.0, 0.0), ("a", "2"): (3, 1, 0.0, 0.0), ("a", "3"): (3, 3, 1.5, -1.5), ("b", "1"): (1, 1, 0.0, 1.2)}


@pytest.fixture(scope="module")
def linked(spark):
    s1, pool, truth = synthetic.dataset(spark, 60)
    s1, pool, truth = (materialize(x, "test") for x in (normalize_records(s1), normalize_records(pool), truth))
    views = (blocking.View("comb", "combined", 8, max_df=0.3), blocking.View("name", "name_norm", 4, max_df=0.3))
    return s1, pool, truth, blocking.candidates(s1, pool, views)


def test_candidates(linked):
    s1, pool, truth, got = linked
    assert got.groupBy("s1_id").count().agg(F.max("count")).first()[0] <= 12
    assert got.select("country", "s1_id", "t_id").distinct().count() == got.count()
    caught = truth.join(got, ["s1_id", "t_id"], "left_semi").count() / truth.count()
    assert caught > 0.9


def test_expansion_caps_and_flags(spark, linked):
    s1, pool, _, got = linked
    more = blocking.expand_twins(got, s1, pool)
    assert more.count() >= got.count() and more.filter("expanded = 1").join(got, ["s1_id", "t_id"], "left_semi").count() == 0


def test_features_and_two_stages(spark, linked):
    s1, pool, truth, got = linked
    features = learning.with_labels(pairs.build_features(got, s1, pool, s1), truth)
    assert len(pairs.feature_columns(features)) >= 55 and features.count() == got.count()
    e = s1.select(F.col("entity_id").alias("s1_id")).join(truth.groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").fillna(0)
    model = learning.train(features, e, folds=2, trees=2)
    found = model.matches(features)
    score = decision.macro(decision.entity_scores(e, found, truth)).first().macro_f05
    assert score > 0.7 and found.groupBy("t_id").count().filter("count > 1").count() == 0
    report = evaluation.score_report(s1.select(F.col("entity_id").alias("s1_id"), "country"), got, found, truth).collect()
    assert sum(r.n_s1 for r in report if r.country is None) == s1.count() and all(r.stray == 0 for r in report)


def test_registered_two_stage_trains_in_full(spark, linked, monkeypatch):
    """The query trains as the operator does by itself, on features that are written once."""
    s1, pool, _, got = linked
    asked = []

    class Model:
        def matches(self, features):
            return features

    def train(features, entities, **options):
        asked.append(options)
        return Model()

    signature = inspect.signature(learning.train)
    monkeypatch.setattr(learning, "train", train)
    monkeypatch.setattr(decision_queries, "sides", lambda spark, sf_dir: (s1, pool))
    monkeypatch.setattr(decision_queries.blocking, "candidates", lambda *a, **b: got)
    features = decision_queries.two_stage(spark, "")
    used = signature.bind(None, None, **asked[0])
    used.apply_defaults()
    assert used.arguments == {"features": None, "entities": None} | {k: p.default for k, p in signature.parameters.items() if k not in ("features", "entities")}
    assert used.arguments["folds"] >= 5 and used.arguments["trees"] >= 60
    assert features.count() == got.count() and 0 < features.filter("label = 1").count() < features.count()
    assert features._jdf.queryExecution().analyzed().collectLeaves().size() == 2  # pairs and labels read what was written


def test_models_of_folds_are_fitted_at_once(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"S1-{k % 40}", f"S2-{k}", x := rng.random(), rng.random(), int(x > 0.5)) for k in range(200)]
    df = spark.createDataFrame(rows, "s1_id string, t_id string, x double, y double, label int").coalesce(1).cache()
    numbered = df.withColumn("_fold", learning.fold(F.col("s1_id"), 3))
    want = {}
    for k in range(3):
        alone = learning.Booster(["x", "y"], 2).fit(numbered.filter(F.col("_fold") != k))
        want |= {r.t_id: r.p for r in alone.predict(numbered.filter(F.col("_fold") == k), "p").collect()}
    met, fit = threading.Barrier(4), learning.Booster.fit

    def together(self, part):
        met.wait(20)
        return fit(self, part)

    monkeypatch.setattr(learning.Booster, "fit", together)
    got, whole = learning.out_of_fold(df, ["x", "y"], "p", folds=3, trees=2)
    assert {r.t_id: r.p for r in got.collect()} == want and whole.model is not None


def test_tables_and_validation(spark, tmp_path):
    src = tmp_path / "s1.tsv"
    src.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t"Q" St\tUS\nS1-2\tAcme\t\tUS\n')
    rows = {r.entity_id: r for r in tables.read_records(spark, str(src)).collect()}
    assert rows["S1-1"].business_name is None and rows["S1-1"].business_address == '"Q" St' and rows["S1-2"].business_address is None
    truth = tmp_path / "truth.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,\nS1-2\t\n")
    t = tables.read_truth(spark, str(truth))
    assert {r.s1_id: r.ids for r in t.collect()} == {"S1-1": ["S2-1", "S3-2"], "S1-2": []}
    out = str(tmp_path / "out")
    s1 = tables.read_records(spark, str(src))
    tables.write_lists(tables.one_row_each(s1, tables.truth_pairs(t)), out, single_file=True)
    required = s1.select(F.col("entity_id").alias("s1_id"))
    good = validation.validate_files(spark, out, required)
    assert good.exit_code == 0 and "candidates: no file" in good.warnings
    bad = tmp_path / "bad.tsv"
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS1-2,S2-1,S2-1\nS1-1\tX-1\nS1-9\t\nbroken\n")
    found = validation.validate_files(spark, str(bad), required).errors
    assert {k.split(": ")[1] for k in found} == {"self_match", "duplicate_id", "duplicate_row", "wrong_prefix", "unexpected_s1", "missing_s1", "malformed"}


def test_samples_are_stable(spark):
    df = spark.createDataFrame([(f"S1-{k}", "AB"[k % 2]) for k in range(100)], "entity_id string, country string")
    a = {r.entity_id for r in sampling.stratified(df, 20).collect()}
    assert a == {r.entity_id for r in sampling.stratified(df.repartition(7), 20).collect()} and len(a) == 20
    assert a <= {r.entity_id for r in sampling.drop_rivals(df, sampling.stratified(df, 20), 0.5).collect()}


def test_stream(spark, tmp_path):
    from kinlink.streaming import records as R

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\tAcme, Inc.\t\tUS\n")
    ref = normalize_records(spark.createDataFrame([("S1-1", "ACME Inc", "", "US")], "entity_id string, business_name string, business_address string, country string"))
    links = R.exact_links(R.normalized_stream(R.read_stream(spark, str(tmp_path / "in"))), ref)
    R.start_links(links, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("US", "S1-1", "S2-1")]


def test_best_pairs_are_the_top_k_of_all_pair_scores(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(c, f"{side}{k:03d}", f"w{rng.randrange(14)}", rng.choice((0.1, 0.25, 0.5))) for c in "ab" for side in "qt" for k in range(60) for _ in range(4)]
    weights = spark.createDataFrame(rows, "country string, entity_id string, token string, w double").groupBy("country", "entity_id", "token").agg(F.max("w").alias("w"))
    q, t = weights.filter("entity_id like 'q%'"), weights.filter("entity_id like 't%'")
    for size in (blocking.LIST, 3):
        monkeypatch.setattr(blocking, "LIST", size)
        for queries, pool, apart in ((q, t, False), (t, t, True)):
            scores = blocking.pair_scores(queries, pool)
            want = blocking.top_k(scores.filter("s1_id <> t_id") if apart else scores, 5)
            got = blocking.best_pairs(queries, pool, 5, apart)
            assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert blocking.best_pairs(q.limit(0), t, 5).count() == 0


def shuffled(spark):
    """Bytes that the session's stages have written to shuffles so far."""
    gateway = spark.sparkContext._gateway
    none, quantiles = gateway.jvm.java.util.ArrayList(), gateway.new_array(gateway.jvm.double, 0)
    return sum(s.shuffleWriteBytes() for s in gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)))


def test_best_pairs_shuffle_records_and_not_pairs(spark):
    rng = random.Random(5)
    rows = [("a", f"{side}{k:04d}", f"w{j}", rng.random()) for side in "qt" for k in range(800) for j in range(4)]
    weights = spark.createDataFrame(rows, "country string, entity_id string, token string, w double")
    before = shuffled(spark)
    assert blocking.best_pairs(weights.filter("entity_id like 'q%'"), weights.filter("entity_id like 't%'"), 5).count() == 4000
    assert shuffled(spark) - before < 1_000_000  # 640,000 pairs, 6,400 weights


def test_holders_shuffle_a_text_once_and_not_once_a_word(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(str(k), " ".join(rng.sample(words, 400))) for k in range(50)], "t_id string, text string")
    items = spark.createDataFrame([("i", "no w1 w2")], "s1_id string, item string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        assert pair_queries.holders(docs, items).count() == 0
        assert shuffled(spark) - before < 2_000_000  # 0.1 MB of texts, 40 MB with a text at each word
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_holders_are_all_documents_with_an_item(spark):
    docs = [("1", "xa bb ccd and more"), ("2", "a bb cc"), ("3", "a  bb cc"), ("4", "bb"), ("5", None), ("6", "ab")]
    items = [("i", "a bb cc"), ("j", "bb"), ("k", "a b"), ("l", "b"), ("m", "none of these words")]
    got = pair_queries.holders(spark.createDataFrame(docs, "t_id string, text string"), spark.createDataFrame(items, "s1_id string, item string"))
    assert {tuple(r) for r in got.collect()} == {(i, d) for i, item in items for d, text in docs if text and item in text}


def test_idf_overlap_keeps_a_pair_in_one_row(spark):
    s1 = spark.createDataFrame([("US", "S1-1", "a b c"), ("US", "S1-2", "")], "country string, entity_id string, name_norm string")
    pool = spark.createDataFrame([("US", "S2-1", "b c d"), ("US", "S2-2", "x")], "country string, entity_id string, name_norm string")
    pairs = s1.select("country", s1.entity_id.alias("s1_id")).crossJoin(pool.select(pool.entity_id.alias("t_id")))
    idf = spark.createDataFrame([("US", t, float(k)) for k, t in enumerate("abcdx", 1)], "country string, token string, idf double")
    from kinlink.operators import pairs as P

    out = P.idf_overlap(pairs, s1, pool, idf, "name_norm", "n")
    got = {(r.s1_id, r.t_id): (r.n_idf_shared, r.n_idf_max_shared, r.n_idf_cov_s1, r.n_idf_cov_t, r.n_idf_miss_s1, r.n_idf_miss_t) for r in out.collect()}
    assert got == {("S1-1", "S2-1"): (5.0, 3.0, 5 / 6, 5 / 9, 1.0, 4.0), ("S1-1", "S2-2"): (0.0, 0.0, 0.0, 0.0, 6.0, 5.0), ("S1-2", "S2-1"): (0.0, 0.0, None, 0.0, 0.0, 9.0), ("S1-2", "S2-2"): (0.0, 0.0, None, 0.0, 0.0, 5.0)}
    assert "Aggregate [country#" in out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("s1_id" in line and "t_id" in line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in line)


def record_frame(spark, n, words, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), f"{side}{k:03d}", " ".join(rng.choices(words, k=rng.randrange(4))), rng.choice(words + ["w0 w0"])) for side in "qt" for k in range(n)]
    df = spark.createDataFrame(rows, "country string, entity_id string, x string, y string")
    return df.filter("entity_id like 'q%'"), df.filter("entity_id like 't%'")


def all_scores(s1, pool, view):
    both = s1.withColumn("side", F.lit("q")).unionByName(pool.withColumn("side", F.lit("t")))
    w = blocking.token_weights(both, view)
    return blocking.pair_scores(w.filter("side = 'q'"), w.filter("side = 't'"))


def test_candidates_are_the_top_k_of_all_pair_scores(spark, monkeypatch):
    s1, pool = record_frame(spark, 70, [f"w{k}" for k in range(9)], 7)
    views = (blocking.View("x", "x", 4, max_df=0.6), blocking.View("y", "y", 3, max_df=0.6))
    scores = [{(r.country, r.s1_id, r.t_id): r.cos for r in all_scores(s1, pool, v).collect()} for v in views]
    want = {tuple(r)[:3] for v in views for r in blocking.top_k(all_scores(s1, pool, v), v.k).select("country", "s1_id", "t_id").collect()}
    for size, room in ((blocking.LIST, blocking.ROOM), (20, 0)):
        monkeypatch.setattr(blocking, "LIST", size)
        monkeypatch.setattr(blocking, "ROOM", room)
        got = {(r.country, r.s1_id, r.t_id): (r.cos_x, r.cos_y) for r in blocking.candidates(s1, pool, views).collect()}
        assert set(got) == want
        assert all(abs(c - s.get(p, 0.0)) < 2e-9 for p, cs in got.items() for c, s in zip(cs, scores))
    assert blocking.candidates(s1.limit(0), pool, views).count() == blocking.candidates(s1, pool.limit(0), views).count() == 0


def test_candidates_search_equal_texts_once(spark):
    rows = [("a", f"{side}{k:05d}", f"w{k % 20} x{k % 10}", f"y{k % 5}") for side in "qt" for k in range(3000)]
    df = spark.createDataFrame(rows, "country string, entity_id string, x string, y string")
    views = (blocking.View("x", "x", 3, max_df=0.6), blocking.View("y", "y", 2, max_df=0.6))
    before = shuffled(spark)
    assert blocking.candidates(df.filter("entity_id like 'q%'"), df.filter("entity_id like 't%'"), views).count() >= 9000
    assert shuffled(spark) - before < 600_000  # 6,000 records of 20 texts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_closure_joins_the_pool_once_for_all_keys(spark):
    pool = spark.createDataFrame([("t1", "a", "n", "k"), ("t2", "a", "m", ""), ("t3", "", "n", None), ("t4", "b", "x", "k")], "entity_id string, addr_key string, name_compact string, name_key string")
    found = spark.createDataFrame([("q1", "t1"), ("q2", "t3")], "s1_id string, t_id string")
    missed = spark.createDataFrame([("q1", "t2"), ("q1", "t3"), ("q1", "t4"), ("q2", "t1"), ("q3", "t1"), ("q3", "gone")], "s1_id string, t_id string")
    out = evaluation.closure(missed, found, pool)
    assert {tuple(r) for r in out.collect()} == {("addr_key", 6, 1), ("name_compact", 6, 2), ("name_key", 6, 1)}
    assert {tuple(r)[1:] for r in evaluation.closure(missed.limit(0), found, pool).collect()} == {(0, 0)}
    assert sum("Join " in line for line in plan(out).split("\n")) == 1


def test_candidates_of_some_queries_are_theirs_among_all(spark):
    s1, pool = record_frame(spark, 60, [f"w{k}" for k in range(9)], 8)
    views = (blocking.View("x", "x", 4, max_df=0.6), blocking.View("y", "y", 3, max_df=0.6))
    some = s1.filter("entity_id < 'q020'")
    whole = blocking.candidates(s1, pool, views).filter("s1_id < 'q020'")
    assert sorted(map(tuple, blocking.candidates(s1, pool, views, asked=some).collect())) == sorted(map(tuple, whole.collect()))


def test_second_hop_adds_the_nearest_of_all_pool_records(spark):
    s1, pool = record_frame(spark, 50, [f"w{k}" for k in range(7)], 9)
    view = blocking.View("x", "x", 3, max_df=0.6)
    pairs = blocking.candidates(s1, pool, (view,))
    similarity = pairs.select("country", "s1_id", "t_id", (F.col("cos_x") * 100).alias("name_ts"), F.lit(0.0).alias("addr_ts"))
    both = s1.withColumn("side", F.lit("q")).unionByName(pool.withColumn("side", F.lit("t")))
    w = blocking.token_weights(both, view).filter("side = 't'")
    near, anchors, known = {}, {}, {}
    for r in sorted(blocking.pair_scores(w, w).filter("s1_id <> t_id").collect(), key=lambda r: (-r.cos, r.t_id)):
        near.setdefault(r.s1_id, []).append(r.t_id)
    for r in sorted(similarity.collect(), key=lambda r: (-r.name_ts, r.t_id)):
        known.setdefault(r.s1_id, set()).add(r.t_id)
        if r.name_ts >= 80:
            anchors.setdefault(r.s1_id, []).append(r.t_id)
    want = {(q, t) for q, ts in anchors.items() for t in sorted({n for a in ts[:2] for n in near.get(a, [])[:4]} - known[q])[:5]}
    out = blocking.second_hop(pairs, similarity, s1, pool, view, k=4, cap=5)
    assert want and {(r.s1_id, r.t_id) for r in out.filter("hop2 = 1").collect()} == want
    assert out.filter("hop2 = 0").count() == pairs.count()


def test_sibling_anchor_share_meets_a_query_in_one_row(spark):
    pool = spark.createDataFrame([("t1", "a b", "x"), ("t2", "b a", "y z"), ("t3", "c", None), ("t4", "", "x")], "entity_id string, name_norm string, addr_norm string")
    found = spark.createDataFrame([("q1", "t1"), ("q4", "t1")], "s1_id string, t_id string")
    missed = spark.createDataFrame([("q1", "t2"), ("q1", "t3"), ("q1", "t4"), ("q2", "t1")], "s1_id string, t_id string")
    out = evaluation.sibling_anchor_share(missed, found, pool, (90, 100))
    assert {tuple(r) for r in out.collect()} == {(90, 0.25, 0.25), (100, 0.25, 0.25)}
    assert evaluation.sibling_anchor_share(missed.limit(0), found, pool).count() == 0
    assert sum("Join " in line for line in plan(out).split("\n")) == 1


def test_twins_of_anchors_found_once(spark, linked):
    s1, pool, _, got = linked
    more = blocking.expand_twins(got, s1, pool, cap=1)
    assert "ArrowEvalPython" not in plan(more)  # anchors are read, their similarities are not computed for every key
    anchors = got.filter("cos_comb >= 0.3").select("country", "s1_id", "t_id")
    known, near = {(r.s1_id, r.t_id) for r in got.collect()}, {}
    for key, least in blocking.TWIN_KEYS:
        groups = {}
        for r in blocking.twin_groups(pool, key, least).collect():
            groups.setdefault((r.country, r[key]), set()).add(r.entity_id)
        for ids in groups.values():
            for t in ids:
                near.setdefault(t, set()).update(ids)
    new = {}
    for r in anchors.collect():
        new.setdefault(r.s1_id, set()).update(t for t in near.get(r.t_id, ()) if (r.s1_id, t) not in known)
    want = {(q, t) for q, ts in new.items() for t in sorted(ts)[:2]}
    assert {(r.s1_id, r.t_id) for r in blocking.add_twins(got, anchors, pool, cap=2).filter("expanded = 1").collect()} == want
