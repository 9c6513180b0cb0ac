"""A closed-vocabulary event counter on Structured Streaming: an event counts if every field is on its list, else it is refused whole."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: The fields of an event and what they may hold.
VOCABULARY = {"v": ("1",), "e": ("page", "model_download", "facts", "detect", "rewrite"), "f": ("home", "app", "privacy", "-"), "m": ("qwen2.5-0.5b", "gemma-3-1b", "-")}
LONGEST = 256


def allowed(body: Column, vocabulary: dict[str, tuple[str, ...]] = VOCABULARY, longest: int = LONGEST) -> Column:
    """Whether a JSON body has just the vocabulary's fields with allowed values. Never null."""
    fields = F.from_json(body, "map<string,string>")
    ok = (F.length(body) <= longest) & (F.array_sort(F.map_keys(fields)) == F.array(*[F.lit(k) for k in sorted(vocabulary)]))
    for name, values in vocabulary.items():
        ok = ok & F.try_element_at(fields, F.lit(name)).isin(*values)
    return F.coalesce(ok, F.lit(False))


# How the service answers.
ALLOWED, PREFLIGHT, MALFORMED, FOREIGN, NOWHERE, TOO_LONG = 200, 204, 400, 403, 404, 413


def status(method: Column, path: Column, origin: Column, body: Column, site: str, at: str = "/e") -> Column:
    """The answer to a request: only a POST from the site's own pages to the counter's path, short enough and allowed, counts. The first rule that fails decides."""
    return (
        F.when(method == "OPTIONS", PREFLIGHT)
        .when(~(method.eqNullSafe(F.lit("POST")) & path.eqNullSafe(F.lit(at))), NOWHERE)
        .when(~origin.eqNullSafe(F.lit(site)), FOREIGN)
        .when(F.length(body) > LONGEST, TOO_LONG)
        .when(~allowed(body), MALFORMED)
        .otherwise(ALLOWED)
    )


def opted_out(privacy_control: Column, *do_not_track: Column) -> Column:
    """Whether a browser asks not to be counted, by either signal."""
    out = F.coalesce(privacy_control, F.lit(False))
    for signal in do_not_track:
        out = out | F.coalesce(signal == "1", F.lit(False))
    return out


def sent(events: DataFrame, locks: DataFrame, at: str = "ts") -> DataFrame:
    """events with sent_at: an event of a locked stretch (a row of locks: locked_from, locked_to) waits for its end, null while there is none; all others go at once. locks do not overlap and are few."""
    held = events.join(F.broadcast(locks), (F.col(at) >= F.col("locked_from")) & (F.col("locked_to").isNull() | (F.col(at) < F.col("locked_to"))), "left")
    return held.withColumn("sent_at", F.when(F.col("locked_from").isNull(), F.col(at)).otherwise(F.col("locked_to"))).drop("locked_from", "locked_to")


def daily(events: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return events.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"), *keys).agg(F.count("*").alias("n"))


def counts(stream: DataFrame, keys: list[str], late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Counts per day of event time. Events later than `late` behind the latest are dropped, which bounds the state."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", "1 day").alias("w"), *keys).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), *keys, "n")


def refused(stream: DataFrame, site: str) -> DataFrame:
    """Requests (method, path, origin, body) that do not count, each with its status."""
    answer = status(F.col("method"), F.col("path"), F.col("origin"), F.col("body"), site)
    return stream.withColumn("status", answer).where(F.col("status") != ALLOWED)


def append_new(stream: DataFrame, key: str, path: str, checkpoint: str, late: str = "1 day", ts: str = "ts") -> StreamingQuery:
    """Appends rows whose key has not come within `late`, and skips what the checkpoint says is there, so that a run that broke off can be repeated."""
    once = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class ProgressLines(StreamingQueryListener):
    """Each event of a streaming query as a line of JSON, given to write()."""

    def __init__(self, write: Callable[[str], None]):
        self.write = write

    def line(self, event: str, **values) -> None:
        self.write(json.dumps({"v": 1, "event": event} | {k: v for k, v in values.items() if v is not None}))

    def onQueryStarted(self, event) -> None:
        self.line("started", id=str(event.id), name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.line("progress", id=str(p.id), batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.line("idle", id=str(event.id))

    def onQueryTerminated(self, event) -> None:
        self.line("ended", id=str(event.id), error=event.exception)


class Counters:
    """Counters of a stream, kept in a folder in three tables, each by the number of the batch that wrote it, so that a batch that is repeated writes the same again.

    open: the counters of days that can still change, with `high`, the latest time seen; each batch reads the one before it and writes its own, and those before these two go. closed: the
    counters of a day, once, when it is `late` behind. late: events that come more than `late` behind what earlier batches have seen, each with a reason; they count
    nowhere. A batch that closes no day, or has no late event, writes no such file, so the files that stay follow days and late events, not batches."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], late: str = "1 day", ts: str = "ts"):
        self.spark, self.path, self.keys, self.late, self.ts = spark, path.rstrip("/"), keys, late, ts

    def numbers(self, table: str) -> list[int]:
        """The batches that a table has, in order."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        names = [f.getPath().getName() for f in system.listStatus(folder)]
        done = [n for n in names if n.startswith("batch=") and system.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in done)

    def drop(self, table: str, number: int) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/batch={number}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def before(self, number: int) -> DataFrame | None:
        """The open counters as batch `number` finds them."""
        earlier = [n for n in self.numbers("open") if n < number]
        return self.spark.read.parquet(f"{self.path}/open/batch={earlier[-1]}") if earlier else None

    def add(self, batch: DataFrame, number: int) -> None:
        old = self.before(number)
        high = old.agg(F.max("high")).first()[0] if old is not None else None
        limit = F.lit(high).cast("timestamp") - F.expr(f"INTERVAL {self.late}")
        time = F.col(self.ts).cast("timestamp")
        behind = F.coalesce(time < limit, F.lit(False)) if high is not None else F.lit(False)
        reason = F.when(time.isNull(), "no time").when(behind, f"more than {self.late} late")
        rows = batch.withColumn("reason", reason)
        rows.persist()
        day = F.date_format(time, "yyyy-MM-dd").alias("day")
        fresh = rows.where("reason is null").groupBy(day, *self.keys).agg(F.count("*").cast("long").alias("n"), F.max(time).alias("high"))
        both = fresh if old is None else fresh.unionByName(old.where("day is not null"))
        counted = both.groupBy("day", *self.keys).agg(F.sum("n").alias("n"), F.max("high").alias("high"))
        counted.persist()
        seen = [t for t in (high, counted.agg(F.max("high")).first()[0]) if t is not None]
        high = F.lit(max(seen, default=None)).cast("timestamp")
        over = F.coalesce(F.to_timestamp(F.date_add(F.col("day").cast("date"), 1)) <= high - F.expr(f"INTERVAL {self.late}"), F.lit(False))
        for table, part in (("late", rows.where("reason is not null")), ("closed", counted.where(over).drop("high"))):
            if not part.isEmpty():
                part.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={number}")
        still = counted.where(~over & F.col("day").isNotNull()).withColumn("high", high)
        # A row of no day keeps the latest time where every day is closed.
        mark = self.spark.range(1).select(*[(high if f.name == "high" else F.lit(None)).cast(f.dataType).alias(f.name) for f in still.schema])
        still.unionByName(mark).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/open/batch={number}")  # days that are open and a closed vocabulary: few rows
        for n in [n for n in self.numbers("open") if n < number][:-1]:  # the one before stays, for this batch may be repeated
            self.drop("open", n)
        rows.unpersist()
        counted.unpersist()

    def table(self, name: str) -> DataFrame | None:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}") if self.numbers(name) else None

    def counts(self) -> DataFrame:
        """(day, keys, n) of all days, closed or open."""
        last = self.numbers("open")
        if not last:
            raise ValueError(f"no batch has been counted in {self.path}")
        now = self.spark.read.parquet(f"{self.path}/open/batch={last[-1]}").where("day is not null").select("day", *self.keys, "n")
        closed = self.table("closed")
        return now if closed is None else now.unionByName(closed.select("day", *self.keys, "n"))

    def late_events(self) -> DataFrame | None:
        """Events that came too late, with their reason and the batch in which they came; None if there are none."""
        return self.table("late")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs what is there."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.add(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_upsert(stream: DataFrame, keys: list[str], table_path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Counters of what is there, added to those of the folder."""
    return Counters(stream.sparkSession, table_path, keys, late).start(stream, checkpoint)


def read_counters(spark: SparkSession, table_path: str, keys: list[str]) -> DataFrame:
    return Counters(spark, table_path, keys).counts()
