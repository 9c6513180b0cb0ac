"""Measuring transforms on samples: specifications, cache, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import tokens
from textloom.operators import ranks


def specs(listing: Column) -> Column:
    """array<struct<label, base, stride>> of "name,name@3,...": repeats of a label go."""
    labels = F.array_distinct(F.filter(F.transform(F.split(listing, ","), lambda s: F.trim(s)), lambda s: s != ""))
    return F.transform(labels, lambda s: F.struct(s.alias("label"), F.split_part(s, F.lit("@"), F.lit(1)).alias("base"), F.nullif(F.split_part(s, F.lit("@"), F.lit(2)), F.lit("")).try_cast("int").alias("stride")))


def options_digest(*options: Column) -> Column:
    """Twelve hex digits over every option that changes the output, in the order given."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(o.cast("string"), F.lit("")) for o in options]).cast("binary")), 1, 12)


def probe(samples: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """samples with cached: whether the cache holds their transform, id and options for the very text."""
    keyed = samples.withColumn("text_sha1", F.sha1(F.col(text).cast("binary")))
    hit = cache.select("transform", "id", "digest", "text_sha1").distinct().withColumn("hit", F.lit(True))
    return keyed.join(hit, ["transform", "id", "digest", "text_sha1"], "left").withColumn("cached", F.coalesce("hit", F.lit(False))).drop("hit")


def summary(rows: DataFrame, keys: list[str], threshold: float = 4.0) -> DataFrame:
    """Means skip nulls and errors; tokens per 1,000 words is a ratio of sums; the share below the threshold is strict."""
    ok = F.col("error").isNull()
    z = F.when(ok, F.col("z_after"))
    middle = ranks.quantile(rows.withColumn("_z", z), keys, "_z", 0.5, "z_median")
    out = rows.groupBy(*keys).agg(
        F.count_if(ok).alias("n"), F.count_if(~ok).alias("errors"), F.avg(z).alias("z_mean"), F.max(z).alias("z_max"),
        F.avg(F.when(z < threshold, 1.0).when(z.isNotNull(), 0.0)).alias("share_below"),
        F.try_divide(F.sum(F.when(ok, F.col("tokens"))) * 1000.0, F.sum(F.when(ok, F.col("words")))).alias("tokens_per_1000_words"),
    )
    return out.join(middle, keys, "left")


def limit_per_group(rows: DataFrame, group: str, n: int, order: str) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("rn") <= n).drop("rn")


def model_summary(rows: DataFrame, key: str = "model", below: float = 4.0) -> DataFrame:
    """Means and extremes of rows' z per model, and how many are below the limit."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.avg("z").alias("z_mean"), F.max("z").alias("z_max"), F.count_if(F.col("z") < below).alias("n_below"))


def usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and tokens of calls (prompt, reply, prompt_tokens, completion_tokens); counts that are absent are estimated from the text."""
    counted = lambda n, text: F.sum(F.coalesce(F.col(n).cast("long"), tokens.estimated_tokens(F.col(text)).cast("long"), F.lit(0)))
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), counted("prompt_tokens", "prompt").alias("prompt_tokens"), counted("completion_tokens", "reply").alias("completion_tokens"))


def verdict(coverage: Column, z: Column) -> Column:
    """How a rewriter did: good if it changed 95% of the wording and the score is that of unmarked text, poor under 90%, else close."""
    return F.when((coverage >= 0.95) & (z.isNull() | (F.abs(z) < 4)), "good").when(coverage < 0.9, "poor").otherwise("close")


# Parts of the names of models whose own output is marked.
MARKING = ("claude", "gemini", "anthropic")


def marks_its_output(model: Column) -> Column:
    return F.lower(model).rlike("|".join(MARKING))


def marked(scored: Column, z: Column) -> Column:
    """Whether a text carries the mark: at least 50 scored positions and a z over 4."""
    return (scored >= 50) & (z > 4)
