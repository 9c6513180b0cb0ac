"""Running transforms over samples: which are asked for, what a cache holds already, rows of results and of errors, and the measurement before and after."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.functions import marks, tokens
from textloom.functions.expressions import bind
from textloom.functions.registry import Options, Registry, told
from textloom.operators import bench, ranks
from textloom.sources.shared import stored

CONTROL = "control(plain)"
ENTRY = "struct<text:string,edits:int,counts:map<string,int>>"


def matter(transform: Column, options: dict[str, Column | None]) -> Column:
    """The twelve options that change an output, as JSON with sorted keys; those that are not given are null."""
    names = {**asdict(Options())}
    given = {"transform": transform} | {n: options.get(n) for n in names}
    shown = {n: F.coalesce(F.to_json(F.struct(v.alias("x"))), F.lit("{}")) if v is not None else F.lit('{"x":null}') for n, v in given.items()}
    value = {n: F.coalesce(F.nullif(F.regexp_extract(c, r'(?s)^\{"x":(.*)\}$', 1), F.lit("")), F.lit("null")) for n, c in shown.items()}
    parts = [F.concat(F.lit(json.dumps(n) + ": "), value[n]) for n in sorted(value)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def digest(transform: Column, options: dict[str, Column | None]) -> Column:
    return F.substring(F.sha1(matter(transform, options).cast("binary")), 1, 12)


def asked(samples: DataFrame, listing: str, known: Registry) -> tuple[DataFrame, list[str]]:
    """(samples with label, base and stride for each specification that is known, labels of those that are not). The specifications are a literal
    array that each sample is exploded by: no table is joined."""
    labels = list(dict.fromkeys(x for x in (part.strip() for part in listing.split(",")) if x))
    fine = [x for x in labels if x.split("@")[0] in known.found]
    every = F.explode(bench.specs(F.lit(",".join(fine)))).alias("spec")
    return samples.select("*", every).select(*samples.columns, "spec.label", "spec.base", "spec.stride"), [x for x in labels if x not in fine]


def problem(samples: DataFrame, text: str = "text") -> Column:
    """Why a sample cannot be transformed, or null: the row stays, with its reason."""
    return F.when(F.col(text).isNull(), F.lit("ValueError: no text"))


def entry_of(found: Column) -> Column:
    return F.struct(found["text"].alias("text"), found["edits"].cast("int").alias("edits"), found["counts"].alias("counts")).cast(ENTRY)


def with_cached(samples: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """samples with _held, all that cache holds for each one's id and text, from which run() takes what it needs. So a sample meets the cache once, whole, and not once for each specification."""
    keyed = samples.withColumn("text_sha1", F.sha1(F.col(text).cast("binary")))
    each = cache.groupBy("id", "text_sha1", F.col("transform").alias("base"), "digest").agg(F.first("entry").cast(ENTRY).alias("entry"))  # as many for a sample as there are options
    held = each.groupBy("id", "text_sha1").agg(F.collect_list(F.struct("base", "digest", "entry")).alias("_held"))
    return keyed.join(held, ["id", "text_sha1"], "left").select(*samples.columns, "_held")


def run(todo: DataFrame, known: Registry, cache: DataFrame | None = None, options: Options = Options(), text: str = "text") -> DataFrame:
    """todo (id, base, label, text, ...) with digest, text_sha1, cached, error, seconds and entry. What cache (transform, id, digest, text_sha1, entry) holds for the very
    text is taken from it, or from _held where with_cached() has been asked; only the rest is transformed. A text on which a transform fails is a row with an error and no entry, and enters no cache."""
    given = {n: F.lit(v) if not isinstance(v, tuple) else F.array(*[F.lit(x) for x in v]).cast("array<string>") for n, v in asdict(options).items() if v is not None}
    keyed = todo.withColumn("digest", digest(F.col("base"), given | {"stride": F.col("stride")})).withColumn("text_sha1", F.sha1(F.col(text).cast("binary")))
    if cache is not None:
        held = cache.select(F.col("transform").alias("base"), "id", "digest", "text_sha1", F.col("entry").cast(ENTRY).alias("held")).dropDuplicates(["base", "id", "digest", "text_sha1"])
        probed = keyed.join(held, ["base", "id", "digest", "text_sha1"], "left")
    elif "_held" in todo.columns:
        probed = keyed.withColumn("held", F.get(F.filter("_held", lambda h: (h["base"] == F.col("base")) & (h["digest"] == F.col("digest"))), F.lit(0))["entry"]).drop("_held")
    else:
        probed = keyed.withColumn("held", F.lit(None).cast(ENTRY))
    probed = probed.withColumn("cached", F.col("held").isNotNull())
    made, failed, seconds = F.lit(None).cast(ENTRY), F.lit(None).cast("string"), F.lit(None).cast("double")
    for base in known.names():
        # Only its own rows reach a transform: a Python function would be called for all of them.
        found = known.get(base)(F.when(~F.col("cached") & (F.col("base") == base), F.col(text)), options)
        its = F.col("base") == base
        if getattr(known.get(base), "catches", False):
            made, failed, seconds = F.when(its, entry_of(found)).otherwise(made), F.when(its, found["error"]).otherwise(failed), F.when(its, found["seconds"]).otherwise(seconds)
        else:  # stands in the entry alone, so that no plan has it twice
            made = F.when(its, bind(found, entry_of)).otherwise(made)
    error = F.when(~F.col("cached"), F.coalesce(problem(todo, text), failed))
    return probed.withColumns({"error": error, "entry": F.coalesce("held", F.when(error.isNull(), made)), "seconds": seconds}).drop("held")


def timed(todo: DataFrame, known: Registry, cache: DataFrame, options: Options = Options(), text: str = "text") -> DataFrame:
    """run(), label by label and stored, so that transforms made of column expressions have seconds too: those of all cores, shared out among the rows that were transformed."""
    spark = todo.sparkSession
    labels = [r[0] for r in todo.select("label").distinct().orderBy("label").toLocalIterator()]  # as many as are asked for
    parts = []
    for label in labels:
        began = time.perf_counter()
        part = stored(run(todo.where(F.col("label") == label), known, cache, options, text), "runs")
        spent = (time.perf_counter() - began) * spark.sparkContext.defaultParallelism
        fresh = part.where("not cached and error is null").count()
        parts.append(part.withColumn("seconds", F.when(~F.col("cached"), F.coalesce("seconds", F.lit(spent / max(1, fresh))))))
    return reduce(DataFrame.unionByName, parts) if parts else run(todo, known, cache, options, text)


def optional_metrics(rows: DataFrame, metrics: dict[str, Callable[[str, str], float]], order: str = "id", before: str = "text", after: str = "entry.text") -> DataFrame:
    """rows with a double for each of metrics, functions of two texts, and `<metric>_error`. A metric that fails is null from its first failure, by order, on; that row has what it raised. So
    results do not depend on how rows are dealt; a task passes by what is behind a failure it has seen."""
    kinds = T.StructType([f for name in metrics for f in (T.StructField(name, T.DoubleType()), T.StructField(f"{name}_error", T.StringType()))])

    def measure(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        failed: dict[str, object] = {}
        for places, olds, news in batches:
            out = []
            for at, old, new in zip(places.to_pylist(), olds.to_pylist(), news.to_pylist()):
                row: dict[str, object] = {}
                for name, fn in metrics.items():
                    if old is None or new is None or name in failed and at > failed[name]:
                        continue
                    try:
                        row[name] = float(fn(old, new))
                    except Exception as e:  # the metric is at fault, not the run
                        row[f"{name}_error"] = told(e)
                        failed[name] = min(at, failed.get(name, at))
                out.append({f.name: row.get(f.name) for f in kinds})
            yield pa.array(out, to_arrow_type(kinds))

    found = stored(rows.withColumn("_m", F.arrow_udf(measure, kinds)(F.col(order), F.col(before), F.col(after))), "metrics")
    first = found.agg(*[F.min(F.when(F.col(f"_m.{name}_error").isNotNull(), F.col(order))).alias(name) for name in metrics]).select(F.struct("*").alias("_first"))
    whole = found.crossJoin(F.broadcast(first))  # one row
    fine = lambda name: F.col(f"_first.{name}").isNull() | (F.col(order) < F.col(f"_first.{name}"))
    columns = {name: F.when(fine(name), F.col(f"_m.{name}")) for name in metrics} | {f"{name}_error": F.when(F.col(order) == F.col(f"_first.{name}"), F.col(f"_m.{name}_error")) for name in metrics}
    return whole.withColumns(columns).drop("_m", "_first")


def scores(rows: DataFrame, scorer: Callable[[list[str]], list[float | None]], id_col: str = "id", text: str = "text", batch: int = 16) -> DataFrame:
    """(id, score, error): rows scored by a function of some texts at a time. A batch that fails is scored text by text, so that only the text at fault has an error and no score; a null text is one."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(texts: list[str]) -> list[tuple[float | None, str | None]]:
            try:
                found = scorer(texts)
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} scores for {len(texts)} texts")
                return [(None if x is None else float(x), None) for x in found]
            except Exception as e:
                return [(None, told(e))] if len(texts) == 1 else [x for t in texts for x in some([t])]

        for b in batches:
            texts, out = b.column(1).to_pylist(), [(None, "ValueError: no text")] * b.num_rows
            there = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(there), batch):
                part = there[at : at + batch]
                for i, x in zip(part, some([texts[i] for i in part])):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.float64()), pa.array([e for _, e in out], pa.string())], names=["id", "score", "error"])

    kept = rows.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return kept.mapInArrow(score, T.StructType([kept.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())]))


def scored_so_far(rows: DataFrame, done: DataFrame, scorer: Callable[[list[str]], list[float | None]], id_col: str = "id", text: str = "text", batch: int = 16) -> DataFrame:
    """done (id, score, error) without its errors, and the scores of the rows that it lacks or failed on."""
    fine = done.where("error is null")
    todo = rows.join(fine.select(F.col("id").alias(id_col)), id_col, "left_anti")
    return fine.select("id", "score", "error").unionByName(scores(todo, scorer, id_col, text, batch))


def new_entries(results: DataFrame) -> DataFrame:
    """What a run adds to its cache."""
    return results.where("not cached and error is null").select(F.col("base").alias("transform"), "id", "digest", "text_sha1", "entry")


def append_cache(results: DataFrame, path: str) -> None:
    new_entries(results).write.mode("append").parquet(path)


def controls(plain: DataFrame, text: str = "text") -> DataFrame:
    """Results of the identity over unmarked texts, under a label of their own."""
    entry = F.struct(F.col(text).alias("text"), F.lit(0).alias("edits"), F.create_map().cast("map<string,int>").alias("counts")).cast(ENTRY)
    return plain.withColumns({"label": F.lit(CONTROL), "base": F.lit("none"), "stride": F.lit(None).cast("int"), "cached": F.lit(False), "error": F.lit(None).cast("string"), "seconds": F.lit(None).cast("double"), "entry": entry})


def marked(samples: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """samples with _before, the mark's score of each text, and _words, their number: what measured() needs of a text however many results it has."""
    return samples.withColumns({"_before": marks.mark_score(F.col(text), key), "_words": tokens.word_count(F.col(text))})


def measured(results: DataFrame, key: str = "key", text: str = "text", cosine: Column | None = None, perplexity: tuple[Column, Column] | None = None) -> DataFrame:
    """results with the mark's score before and after, what stays intact and the edit ratio. A metric whose model is not at hand is null in every row. Samples that were marked() with the same key before they were run
    are not scored again."""
    rows = results if {"_before", "_words"} <= set(results.columns) else marked(results, key, text)
    none = F.lit(None).cast("double")
    rows = rows.withColumnRenamed("_before", "_b").withColumn("_after", F.col("entry.text"))
    rows = marks.compared(rows, text, "_after", "_b", key, "_c").withColumn("_a", F.col("_c.score"))
    return rows.select(
        *[c for c in results.columns if c not in ("_before", "_words")], F.col("_b.tokens").alias("tokens_before"), F.col("_a.tokens").alias("tokens_after"), F.col("_b.scored").alias("scored_before"), F.col("_a.scored").alias("scored_after"),
        F.col("_b.z").alias("z_before"), F.col("_a.z").alias("z_after"), F.col("_b.z_w").alias("zw_before"), F.col("_a.z_w").alias("zw_after"), F.col("_a.p").alias("p_after"),
        F.round("_c.intact", 4).alias("intact"), (cosine if cosine is not None else none).alias("cosine"),
        F.round("_c.edit_ratio", 4).alias("edit_ratio"),
        *(p.alias(n) for p, n in zip(perplexity or (none, none), ("ppl_before", "ppl_after"))), F.col("_words").alias("input_words"),
    )


MEANS = ("z_before", "z_after", "zw_after", "intact", "cosine", "edit_ratio", "seconds", "ppl_before", "ppl_after")


def summary(rows: DataFrame, by: str = "label", threshold: float = 4.0) -> DataFrame:
    """A row a transform: counts, means that skip nulls, z's median and maximum, the shares strictly below limits, and model tokens per 1,000 words as a ratio of sums. Rows with an error only count as such."""
    ok = F.col("error").isNull()
    of = lambda c: F.when(ok, F.col(c))
    below = lambda c, limit: F.avg(F.when(of(c) < limit, 1.0).when(of(c).isNotNull(), 0.0))
    spent = F.coalesce(of("prompt_tokens"), F.lit(0)) + F.coalesce(of("completion_tokens"), F.lit(0))
    rows = stored(rows.select(by, "error", "cached", "prompt_tokens", "completion_tokens", "input_words", *MEANS), "summary")
    middle = ranks.quantile(rows.where(ok), [by], "z_after", 0.5, "z_after_median").withColumnRenamed(by, "_of")
    out = rows.groupBy(by).agg(
        F.count_if(ok).alias("n"), F.count_if(~ok).alias("errors"), F.count_if(ok & F.col("cached")).alias("cached"), *[F.avg(of(c)).alias(f"{c}_mean") for c in MEANS],
        F.max(of("z_after")).alias("z_after_max"), below("zw_after", threshold).alias("share_zw_below_threshold"), below("z_after", threshold).alias("share_below_threshold"),
        below("z_after", 2.0).alias("share_below_2"), F.try_divide(F.sum(spent) * 1000.0, F.sum(of("input_words"))).alias("llm_tokens_per_1k_words"),
    )
    return out.join(F.broadcast(middle), F.col(by).eqNullSafe(F.col("_of")), "left").drop("_of")  # a row a transform
