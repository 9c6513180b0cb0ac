"""Running sums, row numbers and quantiles for groups of any size: no group is sorted, or buffered, in one task.

All of them are one ordered pass: rows are sorted by ranges of (group, order) over all tasks, each task keeps running sums of the rows it holds, and what a group has in earlier
ranges is added from a table of one row a range. The pass is stored, so that whatever is built on it reads its input no more than the sort does."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.sources.shared import stored


def group_key(keys: list[str]) -> Column:
    """A string that tells groups apart, null keys too."""
    return F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keys]))


def running(rows: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """rows with, for each of sums, the sum of its column over the rows of the same keys that come before, 0 for the first. Null keys are a group; order puts nulls first unless it says otherwise."""
    values = {out: F.coalesce(c, F.lit(0)) for out, c in sums.items()}
    tagged = rows.select("*", *[v.alias(out) for out, v in values.items()], group_key(keys).alias("_key"))
    kinds = {out: T.DoubleType() if isinstance(tagged.schema[out].dataType, (T.DoubleType, T.FloatType)) else T.LongType() for out in values}
    tagged = tagged.withColumns({out: F.col(out).cast(kinds[out]) for out in values})
    tagged = tagged.withColumns({f"_own_{out}": F.col(out) for out in values})
    schema = T.StructType([*tagged.schema.fields, T.StructField("_part", T.IntegerType())])
    names, outs, own = schema.names, list(values), {f"_of_{out}": f"_own_{out}" for out in values}

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, last, carried = TaskContext.get().partitionId(), None, [0] * len(outs)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column("_key")
            starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1])
            lengths = np.diff(np.append(starts, n))
            columns = {c: batch.column(c) for c in names[:-1]}
            for i, out in enumerate(outs):
                v = columns[out].to_numpy(zero_copy_only=False)
                up = np.cumsum(v)
                before = up - v
                found = before - np.repeat(before[starts], lengths)
                if key[0].as_py() == last:
                    found[: lengths[0]] += carried[i]
                carried[i] = found[-1] + v[-1]
                columns[out] = pa.array(found)
            last = key[-1].as_py()
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(np.full(n, part, "<i4"))], names=names)

    dealt = tagged.repartitionByRange("_key", *order).sortWithinPartitions("_key", *order)
    passed = stored(dealt.mapInArrow(add_up, schema), "running")
    totals = passed.groupBy("_key", "_part").agg(*[F.sum(v).alias(name) for name, v in own.items()])
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = totals.select("_key", "_part", F.lag("_part").over(Window.partitionBy("_key").orderBy("_part")).alias("_before"), *[F.sum(name).over(earlier).alias(name) for name in own])
    begun = begun.where("_before is not null").drop("_before")  # only a range's first group can have begun in an earlier one
    found = passed.join(F.broadcast(begun), ["_key", "_part"], "left")
    return found.withColumns({out: F.col(out) + F.coalesce(F.col(f"_of_{out}"), F.lit(0)) for out in outs}).select(*rows.columns, *outs)


def sum_below(points: DataFrame, keys: list[str], score: str, value: str, out: str = "below") -> DataFrame:
    """points, which have one row per keys and score, with the sum of value over the group's lower scores, 0 without any. Null scores come first."""
    return running(points, keys, [score], {out: F.col(value)})


def numbered(rows: DataFrame, keys: list[str], digest: Column, ties: list[str], out: str = "rn") -> DataFrame:
    """rows with out, their number from 1 in their group by digest and ties."""
    found = running(rows.withColumn("_digest", digest), keys, ["_digest", *ties], {out: F.lit(1)})
    return found.withColumn(out, F.col(out) + 1).drop("_digest")


def quantile(rows: DataFrame, keys: list[str], score: str, q: float, out: str) -> DataFrame:
    """(keys, out): the linear-interpolated quantile of the group's scores, nulls left out; exact, and without a buffer of a group's values."""
    return quantile_of_counts(rows.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("_n")), keys, score, "_n", q, out)


def quantile_of_counts(points: DataFrame, keys: list[str], score: str, n: str, q: float, out: str) -> DataFrame:
    """quantile() of points, which say how often a score comes, a row each."""
    ranked = sum_below(points, keys, score, n, "_below").withColumn("_group", group_key(keys))
    total = ranked.groupBy("_group").agg(F.sum(n).alias("_total"))
    place = q * (F.col("_total") - 1)
    holds = lambda at: F.max(F.when((F.col("_below") <= at) & (F.col("_below") + F.col(n) > at), F.col(score).cast("double")))
    ends = ranked.join(total, "_group").groupBy("_group").agg(*[F.first(k).alias(k) for k in keys], holds(F.floor(place)).alias("_low"), holds(F.ceil(place)).alias("_high"), F.max(place - F.floor(place)).alias("_part"))
    return ends.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(out))
