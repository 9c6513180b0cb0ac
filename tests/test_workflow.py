"""Registries, runs, requests, ranks, streams and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from textloom import cli
from textloom.functions import marks, registry, tokens
from textloom.operators import assess, corpus, evaluation, ranks, runs
from textloom.sources import reports, requests
from textloom.streaming import counter


def test_a_folder_adds_transforms_and_its_failures_are_kept(tmp_path):
    (tmp_path / "good.py").write_text("from textloom.functions.registry import result, transforms\nfrom pyspark.sql import functions as F\n@transforms.register('shout')\ndef shout(text, options):\n    return result(F.upper(text), F.create_map().cast('map<string,int>'), F.lit(1))\n")
    (tmp_path / "bad.py").write_text("raise RuntimeError('no  such\\nthing')")
    (tmp_path / "_own.py").write_text("raise RuntimeError('not read')")
    known = registry.Registry()
    known.read_folder(str(tmp_path))
    known.read_folder(str(tmp_path))
    assert "shout" in registry.transforms.found and known.failed == {"bad.py": "RuntimeError: no such thing"}
    del registry.transforms.found["shout"]
    with pytest.raises(KeyError, match="known are"):
        registry.transforms.get("nothing")
    assert registry.detectors.names() == sorted(registry.DETECTORS)


def test_runs_take_results_from_the_cache_and_keep_errors(spark, tmp_path):
    rows = [("a", "I don't know.", "en"), ("b", None, "en"), ("c", "plain", "en")]
    samples = spark.createDataFrame(rows, "id string, text string, lang string")
    todo, unknown = runs.asked(samples, "rules,none, rules,what", registry.transforms)
    assert unknown == ["what"] and todo.count() == 6
    empty = spark.createDataFrame([], f"transform string, id string, digest string, text_sha1 string, entry {runs.ENTRY}")
    first = runs.run(todo, registry.transforms, empty)
    runs.append_cache(first, f"{tmp_path}/cache")
    again = {(r["id"], r["label"]): r for r in runs.run(todo, registry.transforms, spark.read.parquet(f"{tmp_path}/cache")).collect()}
    assert again["a", "rules"]["cached"] and again["a", "rules"]["entry"]["text"] == "I do not know." and again["b", "rules"]["error"] == "ValueError: no text" and again["b", "none"]["entry"] is None
    other = runs.run(todo, registry.transforms, spark.read.parquet(f"{tmp_path}/cache"), registry.Options(rules=("dashes",)))
    assert not any(r["cached"] for r in other.collect())
    measured = runs.measured(first).withColumns({c: F.lit(None).cast("double") for c in ("seconds", "prompt_tokens", "completion_tokens")})
    found = {r["label"]: r for r in runs.summary(measured).collect()}
    assert (found["rules"]["n"], found["rules"]["errors"], found["rules"]["cosine_mean"]) == (2, 1, None) and found["none"]["edit_ratio_mean"] == 0.0 and found["none"]["intact_mean"] == 0.0


def test_ranks_over_ranges_are_row_numbers_and_quantiles(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).cast("double").alias("v")).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    numbered = ranks.numbered(df, ["g"], F.md5(F.col("id").cast("string").cast("binary")), ["id"]).collect()
    for g in (None, 1, 2):
        own = sorted((r for r in numbered if r["g"] == g), key=lambda r: r["rn"])
        assert [r["rn"] for r in own] == list(range(1, len(own) + 1))
    got = {r["g"]: r["q"] for r in ranks.quantile(df, ["g"], "v", 0.9, "q").collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.9)).alias("q")).collect()}
    assert got == pytest.approx(want)
    assert ranks.quantile(df.limit(0), ["g"], "v", 0.9, "q").count() == 0


def test_split_has_caps_and_kinds_that_are_only_tested(spark):
    df = spark.range(100).select("id", F.lit("x").alias("s"), (F.col("id") % 4 == 0).alias("rewritten"))
    got = evaluation.split_half(df, ["s"], "id", 10, test_only=F.col("rewritten"))
    assert {(r["rewritten"], r["part"]): r["count"] for r in got.groupBy("rewritten", "part").count().collect()} == {(False, "calib"): 10, (False, "test"): 65, (True, "test"): 25}


def test_documents_go_to_the_longest_open_bucket(spark):
    rows = [(k, "en", "wiki", 350) for k in range(5)] + [(10 + k, "en", "news", 60) for k in range(4)]
    got = {r["doc_id"]: (r["bucket"], r["pass"]) for r in corpus.longest_open(spark.createDataFrame(rows, "doc_id int, lang string, genre string, words int"), "lang", "genre", "words", 1).collect()}
    wiki = sorted(v for k, v in got.items() if k < 10)
    assert wiki == [("long", 1), ("long", 2), ("medium", 1), ("medium", 2), ("short", 1)] and [v for k, v in got.items() if k >= 10] == [("short", 1)]


def test_answers_are_read_from_lines_and_arrays(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "one"}\nnot json\n\n{"id": "2", "text": ""}\n')
    (tmp_path / "a-part1.json").write_text('[{"id": "3", "text": "a **three**"}, {"id": "9", "text": "x"}]')
    (tmp_path / "a-part2.json").write_text('[{"id": "4", "text": "four"}')
    answers = requests.read_parts(spark, f"{tmp_path}/a.jsonl", f"{tmp_path}/a-part*.json")
    assert sorted(r["id"] for r in answers.collect()) == ["1", "2", "3", "9"]
    asked = spark.createDataFrame([(str(k), "en", "wiki", "t") for k in range(1, 5)], "id string, lang string, genre string, topic string")
    got = requests.ingest(answers.union(answers), asked, asked.where("id = 1"), "g", "m").collect()
    assert [(r["id"], r["text"], r["bucket"]) for r in got] == [("3", "a three", None)]
    assert requests.read_parts(spark, f"{tmp_path}/none", f"{tmp_path}/none*").count() == 0
    topics = spark.createDataFrame([("a", "wiki"), ("b", "news")], "topic string, genre string")
    long = requests.long_requests(topics, 5, ("x", "y"), F.concat(F.lit("about "), "topic"), "r-").orderBy("id").collect()
    assert [r["generator"] for r in long] == ["x", "y", "x", "y", "x"] and len({r["id"] for r in long}) == 5 and {r["prompt"] for r in long} == {"about a", "about b"}
    assert requests.top_up(asked, asked.where("id > 2")).count() == 2


def test_human_texts_are_filled_from_pages(spark):
    prose = "These are the words of a sentence that is long enough to be taken as prose. " * 5
    rows = [("d", "c", k, 1, "en", "wiki", prose + "\n| a table |\n- item") for k in range(4)] + [("d", "c", 0, 1, "en", "wiki", prose)]
    pages = spark.createDataFrame(rows, "dataset string, config string, row_idx int, place int, lang string, genre string, text string")
    got = requests.fill(pages, pages.where("row_idx = 3"), 2).collect()
    assert len(got) == 2 and all(r["bucket"] == "short" and "table" not in r["text"] and r["id"].startswith("h-en-wiki-") for r in got)


def test_assessments_are_spoken_by_cell(spark):
    rows = spark.createDataFrame([("t", "en", 150, 5, 3.0), ("u", "en", 400, 5, 0.0), ("v", "xx", 150, 5, 1.0)], "id string, language string, words int, sentences int, score double")
    humans = spark.createDataFrame([("medium", float(k) / 50, False) for k in range(100)] + [("long", 1.0, False)], "bucket string, score double, positive boolean")
    cells = spark.createDataFrame([("en", "medium", True, "allowed", 0.02), ("en", "long", False, "too few", 0.1)], "language string, bucket string, allowed boolean, why string, fpr_upper double")
    writers = spark.createDataFrame([("en", "medium", 1, 50, 0.02, 0.1)], "language string, bucket string, fp int, n int, fpr double, fpr_upper double")
    found = assess.with_cells(assess.assess(rows, assess.calibration(humans)), cells, writers)
    said = {r["id"]: r["s"] for r in found.select("id", assess.spoken(found).alias("s")).collect()}
    assert said["t"][0].startswith("Of 100 measured human texts of this length, 0 scored") and "machine-like" in said["t"][1] and "1 times in 50 (2.0%)" in said["t"][2]
    assert said["u"][-1] == "No verdict: cell not allowed: too few." and said["v"] == ["No verdict: language not measured."]


def test_tables_of_reports(spark):
    blocks = spark.createDataFrame([("cell", "en/long", 9, 8, 0.95, 0.5, 1, 0.3), ("cell", "en/short", 1, 1, None, None, None, None)], "family string, of string, n_pos int, n_neg int, auroc double, tpr double, fp int, fpr_upper double")
    assert reports.cell_table(blocks)[2:] == ["| en/long | 0.95 | 50% of 9 | 1 of 8 | 30.0% |", "| en/short | - | - | - | - |"]
    scores = spark.createDataFrame([("x", "b", 0.5), ("x", "a", None), ("y", "b", 0.75)], "detector string, of string, auroc double")
    assert reports.detector_table(scores) == ["| detector | a | b |", "|---|---|---|", "| x | - | 0.50 |", "| y | - | 0.75 |"]


def test_streams_report_and_append_once(spark, tmp_path):
    lines = []
    listener = counter.ProgressLines(lines.append)
    spark.streams.addListener(listener)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    events = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:00:01"), ("b", "2026-01-01 00:00:02")], "id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(source)
    for _ in range(2):
        counter.append_new(spark.readStream.schema(events.schema).parquet(source), "id", out, f"{tmp_path}/check").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
    spark.streams.removeListener(listener)
    assert all(json.loads(x)["v"] == 1 for x in lines)


def test_refused_events_have_their_status(spark):
    body = '{"v": 1, "e": "page", "f": "home", "m": "-"}'
    rows = [("POST", "/e", "s", body), ("POST", "/e", "s", "{"), ("POST", "/e", None, body), ("GET", "/e", "s", body), ("OPTIONS", "/", None, None), ("POST", "/e", "s", body + " " * 300)]
    df = spark.createDataFrame(rows, "method string, path string, origin string, body string")
    assert sorted(r["status"] for r in counter.refused(df, "s").collect()) == [204, 400, 403, 404, 413]


def test_bench_and_corpus_from_the_command_line(spark, tmp_path, capsys):
    samples = tmp_path / "s.jsonl"
    samples.write_text("\n".join(json.dumps({"id": f"{k}", "text": "We don't know the color of it, and that is all.", "lang": "en", "watermarked": k < 2}) for k in range(3)))
    for _ in range(2):
        assert cli.main(["bench", str(samples), "--transforms", "rules,what", "--out", f"{tmp_path}/o"], spark) == 0
    out = capsys.readouterr()
    assert "what is not known" in out.err and "| rules | 2 | 0 | 2 |" in out.out and "control(plain)" in out.out
    assert cli.main(["transforms", "--json"]) == 0 and "rules" in json.loads(capsys.readouterr().out)["transforms"]
    assert cli.main(["check", f"{tmp_path}/none"], spark) == 1 and capsys.readouterr().err.count("\n") == 1
    assert cli.main(["mark", str(samples), "--key", "k"], spark) == 0 and json.loads(capsys.readouterr().out)["score"]["tokens"] > 10
    pairs = tmp_path / "p.jsonl"
    pairs.write_text("\n".join(json.dumps({"id": str(k), "kind": "names", "a": k > 1, "b": k > 0, "tool": k > 0}) for k in range(4)))
    assert cli.main(["facts-eval", "score", "--pairs", str(pairs), "--settled", f"{tmp_path}/none"], spark) == 2
    (tmp_path / "settled.jsonl").write_text('{"id": "1", "kind": "names", "value": true}')
    assert cli.main(["facts-eval", "score", "--pairs", str(pairs), "--settled", f"{tmp_path}/settled.jsonl"], spark) == 0 and json.loads(capsys.readouterr().out)["precision"] == 1.0


def test_scores_evaluation_and_marks_from_the_command_line(spark, tmp_path, capsys):
    features = tmp_path / "f.jsonl"
    features.write_text("\n".join(json.dumps({"id": str(k), "binoculars": None if k == 3 else k / 10, "nll_obs": 1.0, "error": "OSError: gone" if k == 4 else None}) for k in range(6)))
    for _ in range(2):
        assert cli.main(["score", str(features), "--detectors", "binoculars,perplexity", "--out", f"{tmp_path}/scores"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(x["detector"], x["scored"], x["errors"]) for x in lines] == [("binoculars", 6, 2), ("perplexity", 6, 1), ("binoculars", 2, 2), ("perplexity", 1, 1)]
    rows = [{"id": str(k), "kind": "ai" if k % 2 else "human", "lang": "en", "bucket": "long", "generator": "m" if k % 2 else None, "genre": "news", "score": k % 2 * 2 + (k * 37 % 100) / 100} for k in range(1200)]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)))
    asked = ["evaluate", f"{tmp_path}/s.jsonl", "--out", f"{tmp_path}/e", "--replicates", "50", "--publish", f"{tmp_path}/cal"]
    assert cli.main(asked, spark) == 0
    out = capsys.readouterr().out
    assert "| en/long | 1.00 |" in out and "published" in out and spark.read.json(f"{tmp_path}/e/gates").first()["allowed"]
    assert cli.main(asked, spark) == 0 and "not published" in capsys.readouterr().out
    text = tmp_path / "t.txt"
    text.write_text("one two three four five six seven eight nine ten eleven twelve")
    assert cli.main(["detect", str(text), "--watermark-only", "--watermark-keys", "a,b", "--json"], spark) == 0
    assert [json.loads(x)["key"] for x in capsys.readouterr().out.splitlines()] == ["a", "b"]
    assert cli.main(["detect", str(text), "--watermark-only", "--watermark-keys", "a"], spark) == 0 and "no mark found" in capsys.readouterr().out
    assert cli.main(["detect", str(text), "--watermark-only"], spark) == 1 and cli.main(["detect", str(text)], spark) == 1
    at = spark.read.text(str(text)).select(F.input_file_name()).first()[0]
    path = cli.read_text(spark, str(text)).first()["path"]
    ids = spark.range(1).select(F.lit(path).alias("path"), F.expr("sequence(1L, 30L)").alias("ids")).withColumn("g", F.array_repeat(F.array_repeat(F.lit(1), 8), 26))
    ids.write.parquet(f"{tmp_path}/ids")
    assert at and cli.main(["detect", str(text), "--watermark-only", "--watermark-ids", f"{tmp_path}/ids", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["score"]["mean_g"] == 1.0


def test_bench_options_sweeps_and_folders(spark, tmp_path, capsys):
    samples, plain = tmp_path / "s.jsonl", tmp_path / "p.jsonl"
    samples.write_text(json.dumps({"id": "1", "text": "We don't know the color, shape, and size of it — or do we?", "lang": "en", "watermarked": True}))
    plain.write_text(json.dumps({"id": "2", "text": "It is plain.", "lang": "en"}))
    asked = ["bench", str(samples), "--plain", str(plain), "--transforms", "none", "--sweep", "rules:2,3", "--rules", "dashes", "--timed", "--out", f"{tmp_path}/o"]
    assert cli.main(asked, spark) == 0
    out = capsys.readouterr().out
    assert "| rules@2 | 1 |" in out and "| rules@3 | 1 |" in out and "control(plain)" in out
    rows = {r["label"]: r for r in spark.read.json(f"{tmp_path}/o/rows").collect()}
    assert "don't" in rows["rules@2"]["entry"]["text"] and "—" not in rows["rules@2"]["entry"]["text"] and rows["none"]["seconds"] > 0
    assert cli.main([*asked, "--seed", "7"], spark) == 1 and "--force" in capsys.readouterr().err
    assert cli.main([*asked, "--seed", "7", "--force"], spark) == 0


def test_a_bench_measures_each_text_once_and_as_by_single_functions(spark):
    texts = ["", "one two", "A b c d e f g h", "the colour of a thing is not the color of it " * 4, None, "é à ü Straße a b c d e f", "İ x y z a b c d e", "x" * 50, "I don't know what it is and I don't care at all"]
    samples = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    known = registry.transforms.with_function("loud", lambda t, _: t.upper())
    marked = runs.marked(samples)
    cache = runs.new_entries(runs.run(runs.asked(marked.where("id % 2 = 0"), "rules,loud", known)[0], known))
    todo = runs.asked(runs.with_cached(marked, cache.union(cache)), "rules,none,loud", known)[0]
    results = runs.run(todo, known)
    by_key = runs.run(runs.asked(samples, "rules,none,loud", known)[0], known, cache)
    shown = lambda df: sorted((r["id"], r["label"], r["cached"], r["error"] or "", r["entry"] and r["entry"]["text"] or "") for r in df.collect())
    assert shown(results) == shown(by_key) and sum(r[2] for r in shown(results)) == 8
    got = {(r["id"], r["label"]): r for r in runs.measured(results).collect()}
    words = lambda c: tokens.letter_words(F.lower(c))
    rows = runs.stored(results.select("id", "label", "text", F.col("entry.text").alias("after")), "rows")
    want = rows.select("id", "label", marks.mark_score("text", "key").alias("b"), marks.mark_score("after", "key").alias("a"), F.round(marks.intact_fraction()(words("text"), words("after")), 4).alias("intact"), F.round(marks.word_edit_ratio("text", "after"), 4).alias("ratio"))
    assert len(got) == 27
    for r in want.collect():
        g = got[r["id"], r["label"]]
        assert (g["intact"], g["edit_ratio"]) == (r["intact"], r["ratio"])
        for score, end in ((r["b"], "before"), (r["a"], "after")):
            assert [g[f"{c}_{end}"] for c in ("tokens", "scored", "z", "zw")] == ([score[c] for c in ("tokens", "scored", "z", "z_w")] if score else [None] * 4)
