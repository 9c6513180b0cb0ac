"""Counters with state of their own, late events, pages read as a stream, and failures that stay where they happen."""

import json
import os
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from textloom.functions import marks, registry
from textloom.operators import runs
from textloom.sources.paged import PagedRows
from textloom.streaming import counter


def files_below(path):
    return sum(len([n for n in names if n.startswith("part-")]) for _, _, names in os.walk(path))


def test_many_batches_leave_few_files_and_a_repeated_one_changes_nothing(spark, tmp_path):
    rng = random.Random(1)
    counters = counter.Counters(spark, f"{tmp_path}/c", ["e"], "1 day")
    want, high, late = {}, None, []
    rows, kept = [], 0
    for number in range(40):
        rows = [(number * 10 + i, f"2024-01-{1 + number // 8 + rng.choice([0, 0, 0, -3]) if number > 30 else 1 + number // 8:02d} {rng.randrange(24):02d}:00:00", rng.choice("ab")) for i in range(6)]
        batch = spark.createDataFrame(rows, "id int, at string, e string").select("id", F.to_timestamp("at").alias("ts"), "e")
        counters.add(batch, number)
        if number in (7, 33, 39):
            before = sorted(map(tuple, counters.counts().collect()))
            counters.add(batch, number)  # as after a failure between writing and committing
            assert sorted(map(tuple, counters.counts().collect())) == before
        import datetime

        times = [datetime.datetime.fromisoformat(a) for _, a, _ in rows]
        for (k, a, e), t in zip(rows, times):
            if high is not None and t < high - datetime.timedelta(days=1):
                late.append(k)
            else:
                want[a[:10], e] = want.get((a[:10], e), 0) + 1
        high = max([*times, *([high] if high else [])])
        kept = max(kept, files_below(f"{tmp_path}/c/open"))
    assert {(r["day"], r["e"]): r["n"] for r in counters.counts().collect()} == want
    assert sorted(r["id"] for r in counters.late_events().collect()) == sorted(late) and late
    assert {r["reason"] for r in counters.late_events().collect()} == {"more than 1 day late"}
    assert kept <= 4 and len(counters.numbers("closed")) <= 6


def test_events_without_a_time_and_empty_batches(spark, tmp_path):
    counters = counter.Counters(spark, f"{tmp_path}/c", ["e"])
    with pytest.raises(ValueError, match="no batch"):
        counters.counts()
    frame = spark.createDataFrame([("a", None), ("b", "2024-01-01 00:00:00")], "e string, at string").select("e", F.to_timestamp("at").alias("ts"))
    counters.add(frame, 0)
    counters.add(frame.limit(0), 1)
    assert [tuple(r) for r in counters.counts().collect()] == [("2024-01-01", "b", 1)]
    assert [(r["e"], r["reason"]) for r in counters.late_events().collect()] == [("a", "no time")]


def test_pages_are_read_on_from_where_a_run_ended(spark, tmp_path):
    state = {"total": 120, "asked": []}

    class Rows(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            state["asked"].append(q["offset"])
            found = [{"row_idx": k, "row": {"text": f"t{k}"}} for k in range(q["offset"], min(q["offset"] + q["length"], state["total"]))]
            body = json.dumps({"rows": found, "num_rows_total": state["total"]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Rows)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedRows)
    stream = spark.readStream.format("paged_rows").schema("row_idx long, text string").options(url=f"http://127.0.0.1:{server.server_port}/rows", page=50, wait="0.01", timeout="5").load()

    def run():
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="100 milliseconds").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["row_idx"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    try:
        assert run() == list(range(120))
        state["asked"].clear()
        state["total"] = 170
        assert run() == list(range(170))
        assert min(a for a in state["asked"] if a) >= 120  # 0 only asks for the number of rows
    finally:
        server.shutdown()
        server.server_close()


def test_a_transform_that_fails_on_a_text_leaves_one_row_with_an_error(spark):
    def odd(text, options):
        if "bad" in text:
            raise KeyError(f"no {text}\nat all")
        if text == "none":
            return None
        return text[::-1], {"turned": len(text)}

    known = registry.transforms.with_function("odd", odd)
    samples = spark.createDataFrame([("a", "abc"), ("b", "bad"), ("c", None), ("d", "none"), ("e", "")], "id string, text string").repartition(1)
    todo, unknown = runs.asked(samples, "odd,none", known)
    empty = spark.createDataFrame([], f"transform string, id string, digest string, text_sha1 string, entry {runs.ENTRY}")
    rows = {(r["id"], r["label"]): r for r in runs.run(todo, known, empty).collect()}
    assert unknown == [] and len(rows) == 10 and "odd" not in registry.transforms.found
    assert rows["a", "odd"]["entry"]["text"] == "cba" and rows["a", "odd"]["entry"]["counts"] == {"turned": 3} and rows["a", "odd"]["seconds"] >= 0
    assert rows["b", "odd"]["error"] == "KeyError: 'no bad\\nat all'" and rows["b", "odd"]["entry"] is None and rows["b", "none"]["error"] is None
    assert rows["c", "odd"]["error"] == "ValueError: no text" and rows["d", "odd"]["error"] == "TypeError: a transform gave NoneType, not a text" and rows["e", "odd"]["entry"]["text"] == ""
    assert runs.new_entries(runs.run(todo, known, empty)).where("transform = 'odd'").count() == 2
    timed = {(r["id"], r["label"]): r["seconds"] for r in runs.timed(todo, known, empty).collect()}
    assert timed["a", "none"] > 0 and timed["a", "odd"] >= 0


def test_a_metric_that_fails_is_null_from_then_on(spark):
    def length(before, after):
        if before == "x" * 70:
            raise ZeroDivisionError("seventy")
        return len(after)

    rows = spark.createDataFrame([(k, "x" * k if k != 55 else None, "y" * k) for k in range(100)], "id int, text string, new string").repartition(7)
    got = {r["id"]: r for r in runs.optional_metrics(rows, {"length": length, "one": lambda a, b: 1}, "id", "text", "new").collect()}
    assert len(got) == 100 and all(got[k]["length"] == (None if k == 55 or k >= 70 else k) for k in got)
    assert [k for k in got if got[k]["length_error"]] == [70] and got[70]["length_error"] == "ZeroDivisionError: seventy"
    assert all(got[k]["one"] == (None if k == 55 else 1.0) and got[k]["one_error"] is None for k in got)


def test_a_batch_that_fails_is_scored_text_by_text(spark):
    def score(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("bad text")
        return [None if t == "" else float(len(t)) for t in texts]

    rows = spark.createDataFrame([(k, "bad" if k == 5 else None if k == 6 else "" if k == 7 else "x" * k) for k in range(40)], "id int, text string").repartition(2)
    got = {r["id"]: r for r in runs.scores(rows, score).collect()}
    assert got[5]["error"] == "RuntimeError: bad text" and got[6]["error"] == "ValueError: no text" and got[7]["score"] is None and got[7]["error"] is None
    assert all(got[k]["score"] == k for k in got if k not in (0, 5, 6, 7))
    again = {r["id"]: r for r in runs.scored_so_far(rows, runs.scores(rows, score), lambda texts: [1.0] * len(texts)).collect()}
    assert len(again) == 40 and again[5]["score"] == 1.0 and again[8]["score"] == 8.0 and again[6]["error"] == "ValueError: no text"
    short = {r["id"]: r for r in runs.scores(rows.where("id > 30"), lambda texts: texts[:-1]).collect()}
    assert all(r["error"].startswith("ValueError: 0 scores for 1") for r in short.values())


def test_the_mark_from_ids_is_that_from_words(spark):
    rng = random.Random(2)
    rows = [(k, [rng.randrange(6) for _ in range(rng.choice([0, 3, 5, 6, 60]))]) for k in range(60)] + [(99, [7] * 30_000), (98, None)]
    df = spark.createDataFrame(rows, "k int, ids array<long>").withColumn("g", F.transform(marks.ngrams(F.transform("ids", lambda x: x.cast("string"))), lambda gram: marks.g_bits(gram, "key")))
    got = {r["k"]: r["s"] for r in df.select("k", marks.mark_score_of_ids(F.col("ids"), F.col("g")).alias("s")).collect()}
    assert got[98] is None and got[99]["scored"] == 1
    for k, ids in rows:
        if ids is not None:
            tokens, grams, scored, mean, z, z_w, _ = marks.score_of([str(i) for i in ids], "key")
            assert tuple(got[k]) == pytest.approx((tokens, grams, scored, mean, z, z_w))
