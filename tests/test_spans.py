"""Facts, numerals, spans, the paged source, pairs and exports on small cases."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from textloom import cli
from textloom.functions import facts, marks, numerals, spans, tokens
from textloom.operators import bench, evaluation
from textloom.sources.paged import LostPage, PagedReader, PagedRows, lost_pages


@pytest.mark.parametrize(
    "lang,text,want",
    [
        ("en", "two hundred and five thousand", [205000]), ("en", "a hundred cats and one dog", [100]), ("en", "twenty and three", [20, 3]), ("en", "one thousand million", [1001000]),
        ("it", "duemila ventitré trecentoquarantacinque", [2000, 23, 345]), ("it", "un milione e duecento", [1000200]), ("it", "sei uno un due", [2]), ("it", "milioni mila", []),
        ("es", "treinta y tres mil", [33000]), ("es", "mil un mil", [1000, 1000]), ("es", "cuarenta y veinte", [40, 20]), ("es", "quinientas setecientos", [1200]), ("en", "", []),
    ],
)
def test_number_words(lang, text, want):
    assert numerals.values(text.split(), lang) == want


def test_italian_words_that_are_no_numbers():
    assert [numerals.italian(w) for w in ("una", "sei", "casa", "", "milioni", "mila")] == [None] * 6 and numerals.italian("centomila") == 100000


def test_facts_of_a_text():
    f = facts.read_facts("# Big Title Here\n1. We met Ann O'Neil in 1999, and saw 3 million cats. Putting on Tax-Free goods isn't all all. Tip 3: Not Bob; I'm IBM **Great Label**", "en")
    assert dict(f["numbers"]) == {1999.0: 1, 3e6: 1, 3.0: 1}
    assert dict(f["names"]) == {"Ann": 1, "O'Neil": 1, "Tax": 1, "Free": 1, "Bob": 1, "IBM": 1}
    assert f["negations"] == 2 and dict(f["quantifiers"]) == {"all": 1}
    assert dict(facts.read_facts("Costa 1.234,5 euro e 2.000 lire, al massimo due volte", "it")["numbers"]) == {1234.5: 1, 2000.0: 1, 2.0: 1}


def test_facts_of_odd_rows_are_null_or_empty(spark):
    df = spark.createDataFrame([(1, "a", "de"), (2, None, "en"), (3, "", "es"), (4, "x", None)], "id int, t string, lang string")
    got = {r["id"]: r["f"] for r in df.select("id", facts.facts(F.col("t"), F.col("lang")).alias("f")).collect()}
    assert got[1] is None and got[2] is None and got[4] is None and got[3]["words"] == 0 and got[3]["numbers"] == {}


def test_difference_in_words(spark):
    df = spark.createDataFrame([("All three met Ann in 2.5 days.", "Some met ANN in 2.25 days, not Bob."), ("Same text.", "Same text."), (None, "x")], "a string, b string")
    found = facts.diff(df, "a", "b")
    changed, same, none = [r for r in found.select("*", facts.sentences(found).alias("said")).collect()]
    assert changed["numbers_missing"] == ["2.5", "3"] and changed["numbers_added"] == ["2.25"] and changed["names_missing"] == [] and changed["quantifiers_missing"] == ["all"] and changed["quantifiers_added"] == ["some"]
    assert changed["names_added"] == ["Bob"] and changed["altered"] == 6
    assert changed["said"][1:] == ["Numbers: gone 2.5, 3; new 2.25.", "Names: new Bob.", "Negation words: 0 before, 1 after; not counted above, worth a look.", "Quantifiers: gone all; new some."]
    assert same["said"] == ["No number, name or quantifier changed."] and none["said"] is None and none["altered"] is None


def test_spans(spark):
    text = "a\n```py\nx ~~~\n```` \nb `c` ~~~~\n~~~\nopen\n~~"
    assert [text[a:b] for a, b in spans.fences_of(text)] == ["```py\nx ~~~\n```` \n", "~~~\nopen\n~~"]
    line = "see https://e.org/x_(y) or me@e.org, C:\\a\\b.txt [text](./q.md) {city}"
    assert {"https://e.org/x_(y)", "me@e.org,"[:-1], "C:\\a\\b.txt", "](./q.md)", "{city}"} <= {line[a:b] for a, b in spans.protected_of(line)}
    assert spans.protected_of("") == [] and facts.heading_spans("A Title Of Some Kind\nNo title here.\n**bold**") == [(0, 20), (36, 44), (36, 44)]
    said = "Then Ann has three cats, not all"
    assert [said[a:b] for a, b in facts.fact_spans_of(said, "en")] == ["Ann", "three", "not", "all"]
    df = spark.createDataFrame([("a b", {1: "c"}), ("é 😀 b", {0: "x", 1: "y"}), (None, {0: "x"}), ("a", None)], "t string, m map<int,string>")
    assert [r[0] for r in df.select(spans.replace_words("t", "m")).collect()] == ["a c", "x 😀 y", None, "a"]
    pair = spark.createDataFrame([("- one\n  two\n3. x", "* ONE\nTWO\ny"), ("a", "b\nc"), ("> q\n", "r\n")], "a string, b string")
    assert [r[0] for r in pair.select(spans.keep_layout(F.col("a"), F.col("b"))).collect()] == ["- ONE\n  TWO\n3. y", "b\nc", "> r\n"]
    words = spark.createDataFrame([("a b c d", "a x c d e")], "a string, b string")
    assert words.select(spans.changed_words("a", "b")).first()[0] == [1, 4]


def test_json_of_replies():
    assert spans.first_json('<think>{"no": 1}</think>Sure: {"a": [1, {"b": 2}]} and {"c": 3}') == '{"a": [1, {"b": 2}]}'
    assert spans.first_json("```json\n[1, 2]\n``` {") == "[1, 2]" and spans.first_json("{broken [") is None and spans.first_json("") is None


def test_paged_source(spark):
    failed = []

    class Rows(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            at, n = int(q["offset"]), int(q["length"])
            if at == 200 and not failed:
                failed.append(at)
                return self.send_error(500)
            body = json.dumps({"rows": [{"row_idx": k, "row": {"text": f"{q['dataset']} {k}"}} for k in range(at, at + n)]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Rows)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedRows)
    url = f"http://127.0.0.1:{server.server_port}/rows"
    df = spark.read.format("paged_rows").schema("row_idx long, text string, more string").options(url=url, dataset="d", rows=250, wait="0.01").load()
    got = df.collect()
    assert sorted(r["row_idx"] for r in got) == list(range(250)) and {r["text"] for r in got} == {f"d {k}" for k in range(250)} and failed == [200] and got[0]["more"] is None
    server.shutdown()
    server.server_close()
    reader = PagedReader(df.schema, {"url": url, "wait": "0", "tries": "2", "timeout": "1"})
    with pytest.raises(LostPage, match="rows 0 to 99"):
        [list(reader.read(p)) for p in reader.partitions()]
    with pytest.raises(ValueError, match="_error"):
        PagedReader(df.schema, {"url": url, "strict": "false"})
    lost = spark.read.format("paged_rows").schema("row_idx long, text string, _error string").options(url=url, rows=250, wait="0", tries="1", timeout="1", strict="false").load()
    assert [(r["row_idx"], r["_error"].split(":")[0]) for r in lost_pages(lost).orderBy("row_idx").collect()] == [(0, "rows 0 to 99"), (100, "rows 100 to 199"), (200, "rows 200 to 249")]


def test_pairs_disputes_and_verdicts(spark):
    long = "word " * 30
    rows = spark.createDataFrame([(1, f"{long}\n\nshort", f"x\n\n{long}"), (2, long, "a\n\nb"), (3, None, "a")], "id int, a string, b string")
    assert [(r["id"], r["paragraph"], r["rewrite"]) for r in evaluation.paragraph_pairs(rows, "a", "b").collect()] == [(1, 0, "x")]
    pairs = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, True)], "id int, a boolean, b boolean")
    assert [r["id"] for r in evaluation.disputes(pairs, pairs.select("id").where("id = 3")).collect()] == [1]
    kinds = evaluation.changed_kinds(F.struct(F.array(F.lit("3")).alias("missing"), F.array().cast("array<string>").alias("added")), F.struct(F.array().cast("array<string>").alias("missing"), F.lit(None).cast("array<string>").alias("added")), F.lit(None).cast("boolean"), F.array(F.lit("all (same)")))
    assert spark.range(1).select(*[v.alias(k) for k, v in kinds.items()]).first().asDict() == {"numbers": True, "names": False, "negation": False, "quantifiers": False}
    v = spark.createDataFrame([(0.96, 1.0), (0.96, None), (0.96, 5.0), (0.5, 0.0), (None, 1.0)], "c double, z double").select(bench.verdict(F.col("c"), F.col("z")))
    assert [r[0] for r in v.collect()] == ["good", "good", "close", "poor", "close"]
    s = spark.createDataFrame([("Paper",), ("The",), ("ox",), ("a1bc",), ("über",)], "w string").select(tokens.content_score(F.col("w")))
    assert [r[0] for r in s.collect()] == [1.0, 0.0, 0.3, 0.0, 1.0]
    m = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>").select(marks.mean_pool(F.col("v"), F.col("m"))).first()[0]
    assert m == pytest.approx([0.6, 0.8])


def test_calibration_is_published_only_if_better(spark, tmp_path):
    humans = spark.createDataFrame([("short", 2.0), ("short", 1.0), ("short", None)], "bucket string, score double")
    limits = spark.createDataFrame([("short", 1.9), ("long", 3.0)], "bucket string, threshold double")
    cells = spark.createDataFrame([("en/short", True, "fine"), ("en/long", False, "few")], "cell string, allowed boolean, why string")
    out = evaluation.calibration_export(humans, limits, cells)
    r = out.first()
    assert r["buckets"]["short"]["human_scores"] == [1.0, 2.0] and r["buckets"]["long"]["human_scores"] == [] and r["cells"]["en/long"]["why"] == "few"
    path = f"{tmp_path}/calibration"
    assert not evaluation.publish(out, path, 1) and not evaluation.publish(out, path, 0, dry_run=True) and evaluation.publish(out, path, 0)
    assert spark.read.json(path).count() == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("We don't know Ann and the 3 cats of the house.")
    (tmp_path / "b.md").write_text("We don't know Bob and the 4 cats of\u200b the house.")
    a, b = f"file://{tmp_path}/a.md", f"file://{tmp_path}/b.md"
    assert cli.main(["diff", a, b], spark) == 0 and "Names: gone Ann; new Bob." in capsys.readouterr().out
    assert cli.main(["diff", a, b, "--json"], spark) == 0 and json.loads(capsys.readouterr().out)["altered"] == 4
    assert cli.main(["check", b], spark) == 0 and "ZERO WIDTH SPACE" in capsys.readouterr().out
    assert cli.main(["run", a, "--rules", "contractions"], spark) == 0 and "do not" in capsys.readouterr().out
    assert cli.main(["rules"]) == 0 and "spelling" in capsys.readouterr().out
