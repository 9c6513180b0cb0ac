"""Relational operators, sources and the streaming counter."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import assess, bench, corpus, evaluation
from textloom.sources import files
from textloom.streaming import counter


@pytest.mark.parametrize("seed", range(3))
def test_auroc_with_ties_is_the_share_of_won_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0.1, 0.2, 0.3, 0.5, 0.9]), True) for _ in range(40)] + [(rng.choice([0.0, 0.1, 0.2, 0.3]), False) for _ in range(70)]
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    won = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "score double, positive boolean").withColumn("g", F.lit(1))
    assert evaluation.auroc(df, ["g"]).first()["auroc"] == pytest.approx(won)


def test_empty_class_has_no_auroc(spark):
    df = spark.createDataFrame([(1, 0.5, True)], "g int, score double, positive boolean")
    assert evaluation.auroc(df, ["g"]).first()["auroc"] is None


def test_thresholds_interpolate_and_are_strict(spark):
    df = spark.createDataFrame([(1, 0.0, False), (1, 10.0, False), (1, 9.9, True), (1, 9.91, True)], "g int, score double, positive boolean")
    limit = evaluation.thresholds(df, ["g"])
    assert limit.first()["threshold"] == pytest.approx(9.9)
    r = evaluation.rates(df.join(limit.withColumn("threshold", F.lit(9.9)), "g"), ["g"]).first()
    assert (r["tp"], r["fp"], r["tpr"]) == (1, 1, 0.5)


def test_split_sizes(spark):
    df = spark.range(101).withColumn("s", F.lit("x"))
    parts = {r["part"]: r["count"] for r in evaluation.split_half(df, ["s"], "id", most=20).groupBy("part").count().collect()}
    assert parts == {"calib": 20, "test": 81}


def test_gate_first_reason_wins(spark):
    df = spark.createDataFrame([(None, 0.9, 0.0), (0.8, 0.1, 0.5), (0.9, 0.4, 0.5), (0.9, 0.6, 0.03), (0.9, 0.6, 0.02)], "a double, t double, u double")
    allowed, why = evaluation.gate(F.col("a"), F.col("t"), F.col("u"))
    assert [r["x"] for r in df.select(allowed.alias("x")).collect()] == [False, False, False, False, True]
    assert df.select(why.alias("w")).collect()[1]["w"].startswith("AUROC")


def test_bootstrap_interval_holds_the_estimate(spark):
    rows = [(1, k, float(k % 7), k % 3 == 0) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, id int, score double, positive boolean")
    r = evaluation.interval(evaluation.bootstrap(df, ["g"], 40), ["g"]).first()
    assert r["auroc_low"] <= evaluation.auroc(df, ["g"]).first()["auroc"] <= r["auroc_high"]


def test_choose_prefers_within_the_margin(spark):
    c = spark.createDataFrame([("big", "a", 0.95), ("small", "b", 0.947), ("small", "c", 0.9)], "pair string, name string, value double")
    assert evaluation.choose(c, "small").first()["name"] == "b"
    assert evaluation.choose(c, "small", 0.001).first()["name"] == "a"


def test_kappa_of_full_agreement(spark):
    df = spark.createDataFrame([(1, True, True), (1, True, True)], "g int, a boolean, b boolean")
    assert evaluation.agreement(df, ["g"]).first()["kappa"] == 1.0


def test_quota_makes_up_for_a_scarce_genre(spark):
    df = spark.createDataFrame([(k, "en", "news" if k < 2 else "wiki") for k in range(20)], "doc_id int, lang string, genre string")
    assert corpus.quota(df, ["lang"], "genre", 5).count() == 10


def test_cut_overshoot_is_null(spark):
    df = spark.createDataFrame([("One two three. Four five six seven. Eight.",)], "t string")
    cut = lambda a, b: df.select(corpus.cut(F.col("t"), F.lit(a), F.lit(b)).alias("c")).first()["c"]
    assert cut(4, 8) == (7, 2, "One two three. Four five six seven.") and cut(4, 6) is None and cut(50, 60) is None


def test_bench_summary_skips_errors(spark):
    rows = [("r", None, 3.0, 100, 50), ("r", None, 5.0, 100, 150), ("r", "boom", 9.0, 999, 1)]
    s = bench.summary(spark.createDataFrame(rows, "transform string, error string, z_after double, tokens int, words int"), ["transform"]).first()
    assert (s["n"], s["errors"], s["z_mean"], s["share_below"], s["tokens_per_1000_words"]) == (2, 1, 4.0, 0.5, 1000.0)


def test_specs_keep_first_labels(spark):
    got = spark.range(1).select(bench.specs(F.lit("a@3, b,a@3")).alias("s")).first()["s"]
    assert [tuple(x) for x in got] == [("a@3", "a", 3), ("b", "b", None)]


def test_assess_refuses_early(spark):
    calib = assess.calibration(spark.createDataFrame([("short", float(k), False) for k in range(10)], "bucket string, score double, positive boolean"))
    texts = spark.createDataFrame([(10, "en", 3, 5.0), (50, "fr", 3, 5.0), (50, "en", 1, 5.0), (50, "en", 3, 5.0), (50, "en", 3, 99.0)], "words int, language string, sentences int, score double")
    got = [(r["refused"], r["tail_k"], r["verdict"]) for r in assess.assess(texts, calib).orderBy("score", "words", "language", "sentences").collect()]
    assert ("too short", None, None) in got and (None, 5, "no evidence") in got and (None, 0, "machine-like") in got and len([g for g in got if g[0]]) == 3


def test_sources(spark, tmp_path):
    assert files.read_jsonl(spark, str(tmp_path / "none"), "id long").count() == 0
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n\n{bad\n{"id": 2}\n')
    assert sorted(r["id"] for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id long").collect()) == [1, 2]
    for name, flag in (("b1-a.json", "false"), ("b2-a.json", "true")):
        (tmp_path / name).write_text(f'{{"annotator": "a", "pairs": [{{"id": "p", "flip": {flag}}}]}}')
    assert files.read_annotations(spark, str(tmp_path / "*-a.json"), "struct<id:string,flip:boolean>").first()["flip"] is True


@pytest.mark.parametrize("body,ok", [
    ('{"v":1,"e":"page","f":"home","m":"-"}', True), ('{"v":2,"e":"page","f":"home","m":"-"}', False), ('{"v":1,"e":"page","f":"home"}', False), ("[]", False), ("", False), (None, False),
    ('{"v":1,"e":"page","f":"home","m":"-","x":1}', False), ('{"v":1,"e":"page","f":"home","m":"' + "x" * 300 + '"}', False),
])
def test_events_are_refused_whole(spark, body, ok):
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(counter.allowed(F.col("b")).alias("x")).first()["x"] is ok


def test_stream_counts_across_batches(spark, tmp_path):
    schema = "ts timestamp, e string"
    for k in range(2):
        spark.sql(f"select timestamp'2024-01-0{k + 1} 10:00:00' ts, 'a' e union all select timestamp'2024-01-01 11:00:00', 'a'").write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        counter.start_upsert(stream, ["e"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r["day"], r["n"]) for r in counter.read_counters(spark, str(tmp_path / "out"), ["e"]).collect()}
    assert got == {("2024-01-01", 3), ("2024-01-02", 1)}


def test_tails_and_logistic_fit_are_those_of_plain_code(spark):
    import numpy as np

    from textloom.operators import assess

    rng = np.random.default_rng(1)
    humans = [(b, float(v)) for b in ("short", "long") for v in rng.choice([1.0, 2.0, 2.5, *rng.normal(size=300)], 900)]
    asked = [(b, float(v)) for b in ("short", "long", "none") for v in [2.0, -99.0, 99.0, *rng.normal(size=40)]]
    got = assess.tails(spark.createDataFrame(asked, "bucket string, score double"), spark.createDataFrame([(*h, 1) for h in humans], "bucket string, score double, n long")).collect()
    found = {(r["bucket"], r["score"]): r["tail_k"] for r in got}
    assert all(found[b, s] == sum(c == b and v >= s for c, v in humans) for b, s in asked if b != "none")
    x, z = rng.normal(size=400), rng.normal(size=400)
    y = rng.random(400) < 1 / (1 + np.exp(-(2 * x - z + 1)))
    rows = [("short", float(a), None if k % 9 == 0 else float(b), bool(c)) for k, (a, b, c) in enumerate(zip(x, z, y))]
    fit = assess.logistic_fit(spark.createDataFrame(rows, "bucket string, nll double, burstiness double, positive boolean")).first()
    fill = np.mean([r[2] for r in rows if r[2] is not None])
    design = np.column_stack([x, [fill if r[2] is None else r[2] for r in rows], np.ones(400)])
    weight = np.where(y, 400 / (2 * y.sum()), 400 / (2 * (~y).sum()))
    w = np.array([fit["w_nll"], fit["w_burst"], fit["bias"]])
    slope = design.T @ (weight * (y - 1 / (1 + np.exp(-design @ w)))) - np.array([1, 1, 0]) * w
    assert abs(fit["fill"] - fill) < 1e-9 and np.abs(slope).max() < 1e-4


def test_mean_of_cells_needs_them_all(spark):
    cells = spark.createDataFrame([(0.5,), (0.75,), (None,)], "auroc double")
    assert evaluation.mean_of_cells(cells, 2).first()["mean"] == 0.625
    assert evaluation.mean_of_cells(cells, 3).where("isnan(mean)").count() == 1


def test_sum_below_takes_null_groups_and_null_scores(spark):
    from textloom.operators import ranks

    points = spark.createDataFrame([(g, s, 2) for g in ("a", None) for s in (None, *map(float, range(700)))], "g string, score double, v long")
    got = ranks.sum_below(points, ["g"], "score", "v").collect()
    assert len(got) == 1402 and all(r["below"] == (0 if r["score"] is None else 2 * (r["score"] + 1)) for r in got)
