"""Evaluation from counts: one ordered pass, resampled histograms, exact bounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import statistics
from textloom.operators import assess, corpus, evaluation, ranks


def test_running_sums_are_those_of_the_group_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(9)]), k, rng.choice([None, 1, 5]), rng.random()) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, v int, id int, n int, x double").repartition(5)
    got = ranks.running(df, ["g"], ["v", F.desc("id")], {"n_below": F.col("n"), "x_below": F.col("x")}).collect()
    assert len(got) == 700
    for g in (None, "a", "b"):
        n, x = 0, 0.0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, -r[2])):
            (found,) = [f for f in got if f["id"] == r[2]]
            assert found["n_below"] == n and found["x_below"] == pytest.approx(x)
            n, x = n + (r[3] or 0), x + r[4]
    assert ranks.running(df.limit(0), ["g"], ["v"], {"s": F.col("n")}).count() == 0


def test_one_large_group_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select("id", F.lit("all").alias("g"))
        found = ranks.running(df, ["g"], ["id"], {"s": F.lit(1)})
        assert found.where("s = id").count() == 20_000 and found.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def made_scores(n=240, seed=4):
    rng = random.Random(seed)
    return [(rng.choice(["x", "y"]), k % 3 == 0, round(rng.gauss(0.7 if k % 3 == 0 else 0, 1), 1), k) for k in range(n)]


def auroc(p, q):
    return sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q))


def test_the_resampled_histogram_agrees_with_resampled_rows(spark):
    rows = made_scores()
    df = spark.createDataFrame(rows, "g string, positive boolean, score double, id long")
    found = evaluation.interval(evaluation.bootstrap(df, ["g"], 1500), ["g"]).collect()
    rng = np.random.default_rng(1)
    for r in found:
        p, q = ([s for g, c, s, _ in rows if g == r["g"] and c == one] for one in (True, False))
        drawn = sorted(auroc(rng.choice(p, len(p)), rng.choice(q, len(q))) for _ in range(1500))
        assert r["auroc_low"] == pytest.approx(drawn[37], abs=0.02) and r["auroc_high"] == pytest.approx(drawn[1461], abs=0.02)


def test_what_is_resampled_is_scores_not_rows(spark):
    df = spark.range(30_000).select(F.lit("x").alias("g"), (F.col("id") % 2 == 0).alias("positive"), (F.col("id") % 7).cast("double").alias("score"), "id")
    found = evaluation.bootstrap(df, ["g"], 50).agg(F.count("*").alias("n"), F.avg("auroc").alias("mean"), F.stddev("auroc").alias("sd")).first()
    plain = evaluation.auroc(df, ["g"]).first()["auroc"]
    assert found["n"] == 50 and found["mean"] == pytest.approx(plain, abs=0.005) and 0.0005 < found["sd"] < 0.01


def test_a_group_in_several_ranges_has_one_bootstrap(spark):
    df = spark.createDataFrame(made_scores(900), "g string, positive boolean, score double, id long")
    one = {(r["g"], r["rep"]): r["auroc"] for r in evaluation.bootstrap(df, ["g"], 5).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        many = {(r["g"], r["rep"]): r["auroc"] for r in evaluation.bootstrap(df, ["g"], 5).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == many and len(one) == 10


def test_a_class_that_is_empty_has_no_auroc(spark):
    df = spark.createDataFrame([("x", True, 1.0, 1), ("x", True, None, 2), ("y", False, 1.0, 3), ("y", True, 2.0, 4)], "g string, positive boolean, score double, id long")
    found = evaluation.bootstrap(df, ["g"], 200)
    assert found.where("g = 'x' and auroc is not null").count() == 0
    assert {r["auroc"] for r in found.where("g = 'y' and auroc is not null").collect()} == {1.0}


def test_poisson_draws_have_their_mean_and_variance():
    draw = evaluation.poisson_draws(20_000)
    for n in (1, 3, 40, 5_000, 10**9):
        x = draw(n, 12345)
        assert abs(x.mean() - n) < 5 * math.sqrt(n / 20_000) and x.var() == pytest.approx(n, rel=0.06)
    assert draw(0, None).sum() == 0


@pytest.mark.parametrize(("k", "n", "upper"), [(0, 300, 1 - 0.05 ** (1 / 300)), (0, 75, 1 - 0.05 ** (1 / 75)), (1, 2, 0.9746794344808963), (3, 3, 1.0), (5, 0, None), (None, 3, None)])
def test_upper_bounds(spark, k, n, upper):
    got = spark.createDataFrame([(k, n)], "k long, n long").select(statistics.clopper_pearson_upper(F.col("k"), F.col("n"))).first()[0]
    assert got == (upper if upper is None else pytest.approx(upper, abs=1e-9))


def test_upper_bounds_of_many_are_as_cheap_as_of_few(spark):
    pairs = [(10**6, 10**8), (999_999, 10**6), (10**6, 10**7)]
    got = [r[0] for r in spark.createDataFrame(pairs, "k long, n long").select(statistics.clopper_pearson_upper(F.col("k"), F.col("n"))).collect()]
    for (k, n), p in zip(pairs, got):
        assert k / n < p <= 1
        if n - k > 100:  # as close as a normal's
            assert (p - k / n) / math.sqrt(k / n * (1 - k / n) / n) == pytest.approx(1.645, abs=0.01)
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n in [(0, 5), (2, 9), (7, 30), (29, 30)]:
        assert exact(k, n, statistics.upper_bound(k, n, 0.05)) == pytest.approx(0.05, abs=1e-9)


def test_blocks_of_counts_are_blocks_of_rows(spark):
    rows = spark.createDataFrame([(*r, 0.4 if r[0] == "x" else None) for r in made_scores()], "g string, positive boolean, score double, id long, threshold double")
    counted = rows.groupBy("g", "positive", "score", "threshold").agg(F.count("*").alias("n"))
    one, other = (sorted(evaluation.block(t, ["g"], n).collect()) for t, n in ((rows, None), (counted, "n")))
    assert [tuple(r) for r in one] == [pytest.approx(tuple(r)) for r in other] and one[0]["tp"] is not None and one[1]["tp"] is None


def test_tails_come_from_one_order(spark):
    rng = random.Random(3)
    humans = [("short", rng.choice([1.0, 2.0, 2.5, rng.random()]), False) for _ in range(300)] + [("medium", 4.0, False)]
    calib = assess.calibration(spark.createDataFrame(humans, "bucket string, score double, positive boolean"))
    texts = [(k, rng.choice([50, 60, 150, 700, 3]), "en", 3, rng.choice([None, 1.0, 2.0, 9.0, -1.0, rng.random()])) for k in range(200)]
    got = {r["id"]: r for r in assess.assess(spark.createDataFrame(texts, "id int, words int, language string, sentences int, score double"), calib).collect()}
    assert len(got) == 200
    for k, words, _, _, score in texts:
        own = [h for b, h, _ in humans if b == got[k]["bucket"]]
        want = sum(h >= score for h in own) if own and words >= 40 and score is not None else None
        assert got[k]["tail_k"] == want


def places(rows, each):
    """Both passes, document by document."""
    import hashlib

    order = sorted(rows, key=lambda r: (hashlib.md5(f"l-{r[0]}".encode()).hexdigest(), r[0]))
    lows = [("long", 301), ("medium", 100), ("short", 40)]
    room = {(c, g, b): each for _, c, g, _ in rows for b, _ in lows}
    out, left = {}, order
    for turn in (1, 2):
        rest = []
        for r in left:
            for b, low in lows:
                if r[3] >= low and room[r[1], r[2], b] > 0:
                    room[r[1], r[2], b] -= 1
                    out[r[0]] = (b, turn)
                    break
            else:
                rest.append(r)
        lacks, left = room, rest
        room = {(c, g, b): sum(n for (d, _, e), n in lacks.items() if (d, e) == (c, b)) if lacks[c, g, b] == 0 else 0 for c, g, b in lacks}
    return out


@pytest.mark.parametrize("each", [1, 4, 15])
def test_the_longest_open_bucket_document_by_document(spark, each):
    rng = random.Random(each)
    rows = [(k, rng.choice(["en", "it"]), rng.choice(["wiki", "news", "blog"]) if k % 9 else "rare", rng.choice([10, 45, 150, 350, 900])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id int, cell string, genre string, words int")
    got = corpus.longest_open(df, "cell", "genre", "words", each).collect()
    assert {r["doc_id"]: (r["bucket"], r["pass"]) for r in got} == places(rows, each) and len(got) == len({r["doc_id"] for r in got})


def scans(df):
    return str(df._jdf.queryExecution().executedPlan().toString()).count("FileScan parquet")


def test_the_evaluations_plans_are_short(spark, tmp_path):
    import textloom.plans.workflow  # noqa: F401  joins its queries
    from textloom.plans.catalogue import QUERIES

    for name, most in (("longest_open", 12), ("assess_verdict", 8), ("eval_families", 9), ("cell_gate", 9), ("bootstrap_interval", 1)):
        assert scans(QUERIES[name](spark, "/root/testdata/sf0.001")) <= most, name
