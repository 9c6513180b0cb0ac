"""Calibrated assessment of texts: early refusal, human tail, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import statistics, tokens
from textloom.operators import ranks
from textloom.sources.shared import stored

LANGUAGES = ("en", "it", "es")


def calibration(rows: DataFrame, q: float = 0.99) -> DataFrame:
    """(bucket, human_score, n, threshold) of negatives: a row per distinct score and how often it comes, with its bucket's threshold."""
    counted = stored(rows.where(~F.col("positive") & F.col("score").isNotNull()).groupBy("bucket", F.col("score").alias("human_score")).agg(F.count("*").alias("n")), "calibration")
    limits = ranks.quantile_of_counts(counted, ["bucket"], "human_score", "n", q, "threshold")
    return counted.join(F.broadcast(limits), "bucket")  # a row per bucket


def tails(scores: DataFrame, humans: DataFrame) -> DataFrame:
    """(bucket, score, tail_k) of the distinct (bucket, score) of scores: how many of humans (bucket, score, n) are at or over it.
    Equal scores are summed first, so no score is too frequent; buckets without humans are left out."""
    h = humans.where("score is not null").groupBy("bucket", "score").agg(F.sum("n").alias("n"))
    asked = scores.where("score is not null").select("bucket", "score").distinct().withColumn("n", F.lit(0).cast("long"))
    points = ranks.sum_below(h.unionByName(asked).groupBy("bucket", "score").agg(F.sum("n").alias("n")), ["bucket"], "score", "n")
    total = points.groupBy("bucket").agg(F.sum("n").alias("total")).where("total > 0")
    return points.join(F.broadcast(total), "bucket").select("bucket", "score", (F.col("total") - F.col("below")).alias("tail_k"))  # a row per bucket


def assess(texts: DataFrame, calib: DataFrame, language: str = "language") -> DataFrame:
    """texts (words, language, sentences, score) with bucket, refused, human tail and verdict, by calibration()'s
    table. Scores at or over the text's count to its tail; a verdict needs a score strictly over the threshold.

    Texts and calibration are put in one order by bucket and score, texts before humans of an equal score, and one running sum tells each text how many humans are below it."""
    bucket = tokens.assess_bucket(F.col("words"))
    refused = (
        F.when(F.col("words") < tokens.BUCKETS[0][1], "too short")
        .when(~F.coalesce(F.col(language).isin(*LANGUAGES), F.lit(False)), "language not measured")
        .when(F.col("sentences") < 2, "too few sentences")
    )
    rows = texts.withColumn("bucket", bucket).withColumn("refused", refused)
    humans = calib.select("bucket", F.col("human_score").cast("double").alias("_score"), F.col("n").alias("_n"))
    both = rows.select("bucket", F.col("score").cast("double").alias("_score"), F.lit(0).cast("long").alias("_n"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_text"))
    both = both.unionByName(humans.withColumn("_text", F.lit(None).cast(both.schema["_text"].dataType)))
    below = ranks.running(both, ["bucket"], ["_score", F.col("_text").isNotNull().desc()], {"_below": F.col("_n")}).where("_text is not null")
    rows = below.select("_text.*", "_below")
    rows = rows.join(F.broadcast(calib.groupBy("bucket").agg(F.first("threshold").alias("threshold"), F.sum("n").alias("tail_n"))), "bucket", "left")  # a row per bucket
    measured = F.col("refused").isNull()
    tail = F.when(measured & F.col("score").isNotNull(), F.col("tail_n") - F.col("_below"))
    rows = rows.withColumn("tail_k", tail).withColumn("tail_n", F.when(measured, F.col("tail_n"))).drop("_below")
    low, high = statistics.wilson(F.col("tail_k"), F.col("tail_n"))
    verdict = F.when(measured & F.col("threshold").isNotNull(), F.when(F.col("score") > F.col("threshold"), "machine-like").otherwise("no evidence"))
    return rows.withColumn("tail_low", low).withColumn("tail_high", high).withColumn("verdict", verdict)


def with_cells(assessed: DataFrame, cells: DataFrame, learners: DataFrame, language: str = "language") -> DataFrame:
    """assessed with what its cell (language, bucket, allowed, why, fpr_upper) and the learners' (language, bucket, fp, n, fpr, fpr_upper) say, a row a cell each. A cell that is not
    allowed, or not measured, refuses the verdict; the tail stays."""
    known = cells.select(F.col("language").alias(language), "bucket", F.struct("allowed", "why", "fpr_upper").alias("cell"))
    writers = learners.select(F.col("language").alias(language), "bucket", F.struct("fp", "n", "fpr", "fpr_upper").alias("learners"))
    rows = assessed.join(F.broadcast(known), [language, "bucket"], "left").join(F.broadcast(writers), [language, "bucket"], "left")
    shut = F.col("refused").isNull() & ~F.coalesce(F.col("cell.allowed"), F.lit(False))
    why = F.concat(F.lit("cell not allowed: "), F.coalesce("cell.why", F.lit("not measured")))
    return rows.withColumn("verdict", F.when(~shut, F.col("verdict"))).withColumn("refused", F.when(shut, why).otherwise(F.col("refused")))


def percent(x: Column) -> Column:
    return F.concat(F.format_number(100 * x, 1), F.lit("%"))


def spoken(rows: DataFrame) -> Column:
    """array<string>: what with_cells() found, as a person reads it."""
    tail = F.when(
        F.col("tail_k").isNotNull(),
        F.concat(F.lit("Of "), F.col("tail_n").cast("string"), F.lit(" measured human texts of this length, "), F.col("tail_k").cast("string"), F.lit(" scored at least as machine-like ("),
                 percent(F.try_divide("tail_k", "tail_n")), F.lit("; 95% interval "), percent(F.col("tail_low")), F.lit(" to "), percent(F.col("tail_high")), F.lit(")."),),
    )
    verdict = F.when(F.col("verdict") == "machine-like", F.concat(F.lit("Verdict: machine-like. The threshold flagged at most "), percent(F.col("cell.fpr_upper")), F.lit(" of human texts here."))).when(
        F.col("verdict") == "no evidence", F.lit("Verdict: no evidence of machine writing, which is no proof of a person's.")
    )
    writers = F.when(
        F.col("learners").isNotNull(),
        F.concat(F.lit("Second-language writers crossed the threshold "), F.col("learners.fp").cast("string"), F.lit(" times in "), F.col("learners.n").cast("string"), F.lit(" ("), percent(F.col("learners.fpr")), F.lit(").")),
    )
    return F.array_compact(F.array(tail, verdict, F.concat(F.lit("No verdict: "), F.col("refused"), F.lit(".")), writers))


#: Detectors whose lower values are the more machine-like.
LOWER_IS_MACHINE = ("binoculars", "nll_obs", "perplexity", "burstiness")


def oriented(detector: Column, score: Column) -> Column:
    """The score such that higher is more machine-like."""
    return F.when(detector.isin(*LOWER_IS_MACHINE), -score).otherwise(score)


def logistic_score(nll: Column, burstiness: Column, w_nll: Column, w_burst: Column, bias: Column, fill: Column) -> Column:
    """The linear score; a missing burstiness counts as fill."""
    return w_nll * nll + w_burst * F.coalesce(burstiness, fill) + bias


def logistic_fit(rows: DataFrame, by: str = "bucket", rounds: int = 8) -> DataFrame:
    """(by, w_nll, w_burst, bias, fill) of rows (nll, burstiness, positive): balanced classes, a ridge of 1 on both weights, Newton's method.
    Each round is one aggregation to ten sums a group, whose groups are length buckets. A group without both classes is left out."""
    import numpy as np

    spark = rows.sparkSession
    y = F.col("positive").cast("double")
    base = rows.where("nll is not null and positive is not null")
    facts = base.groupBy(by).agg(F.count("*").alias("n"), F.sum(y).alias("pos"), F.coalesce(F.avg("burstiness"), F.lit(0.0)).alias("fill")).where("pos > 0 and pos < n").collect()
    state = {r[by]: np.zeros(3) for r in facts}
    for _ in range(rounds if facts else 0):
        given = spark.createDataFrame([(r[by], r["n"] / (2 * r["pos"]), r["n"] / (2 * (r["n"] - r["pos"])), r["fill"], *map(float, state[r[by]])) for r in facts], f"`{by}` string, c1 double, c0 double, fill double, a double, b double, c double")
        x = (F.col("nll").cast("double"), F.coalesce(F.col("burstiness").cast("double"), F.col("fill")), F.lit(1.0))
        p = 1 / (1 + F.exp(-logistic_score(x[0], x[1], F.col("a"), F.col("b"), F.col("c"), F.col("fill"))))
        weight = F.when(F.col("positive"), F.col("c1")).otherwise(F.col("c0"))
        slope = [F.sum(weight * (y - p) * v).alias(f"g{i}") for i, v in enumerate(x)]
        bend = [F.sum(weight * p * (1 - p) * x[i] * x[j]).alias(f"h{i}{j}") for i in range(3) for j in range(i, 3)]
        for r in base.join(F.broadcast(given), by).groupBy(by).agg(*slope, *bend).collect():
            w, ridge = state[r[by]], np.array([1.0, 1.0, 1e-9])
            h = np.array([[r[f"h{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
            state[r[by]] = w + np.linalg.solve(h + np.diag(ridge), np.array([r[f"g{i}"] for i in range(3)]) - ridge * w)
    return spark.createDataFrame([(r[by], *map(float, state[r[by]]), float(r["fill"])) for r in facts], f"`{by}` string, w_nll double, w_burst double, bias double, fill double")
