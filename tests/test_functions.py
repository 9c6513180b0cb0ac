"""Column expressions against hand-made cases."""

import difflib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import cleaning, facts, guarded, marks, matching, rewriting, spans, statistics, tokens
from textloom.functions.expressions import pieces_of


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n,corpus,assess,learner", [(39, None, None, None), (40, "short", "short", "short"), (99, "short", "short", "short"), (100, "medium", "medium", "medium"), (301, "long", "long", "long"), (601, None, "long", "long")])
def test_bucket_rules(spark, n, corpus, assess, learner):
    assert one(spark, F.struct(tokens.corpus_bucket(F.col("n")), tokens.assess_bucket(F.col("n")), tokens.learner_bucket(F.col("n"))), n=n) == (corpus, assess, learner)


def test_words_keep_apostrophes_and_count_letters_only(spark):
    assert one(spark, tokens.words(F.col("t")), t="Don’t stop at 3, l'été!") == ["Don’t", "stop", "at", "3", "l'été"]
    assert one(spark, tokens.word_count(F.col("t")), t="one 2 trois") == 2


def test_sentences_keep_the_tail(spark):
    assert one(spark, tokens.sentences(F.col("t")), t='He said "no." Then left… 3.5 more\nand so') == ['He said "no."', "Then left…", "3.5 more\nand so"]


def test_language_without_votes_is_null(spark):
    assert one(spark, F.struct(*tokens.best_vote(tokens.language_votes(F.col("t")))), t="123 456") == (None, 0.0)
    assert one(spark, tokens.best_vote(tokens.language_votes(F.col("t")))[0], t="che il gatto non del") == "it"


def test_cleaning_spares_fences_and_emoji(spark):
    text = "a​b ```x​y``` c d ☃️ e️"
    assert one(spark, cleaning.plain_characters(F.col("t")), t=text) == "ab ```x​y``` c d ☃️ e"
    assert one(spark, cleaning.edits(F.col("t")), t=text) == 2
    assert one(spark, F.size(cleaning.targets(F.col("t"))), t=text) == 3


@pytest.mark.parametrize("rule,before,after", [
    (cleaning.dashes, "one — two, 1–2", "one, two, 1–2"), (cleaning.typography, "“a”… b‑c", '"a"... b-c'), (cleaning.serial_comma, "red, green, and blue", "red, green and blue"),
    (cleaning.numbers, "5 percent of 1,234,567 not 1,23", "5% of 1234567 not 1,23"), (cleaning.detokenize, "( a , b ) l ' x", "(a, b) l'x"), (cleaning.tidy, "# T\n\n\n\nA **b**.", "A b."),
])
def test_rules(spark, rule, before, after):
    assert one(spark, rule(F.col("t")), t=before) == after


def test_wording_rules_run_once_and_spare_code(spark):
    df = spark.createDataFrame([("I don't utilize the colour `don't` in order to win.",), (None,)], "text string")
    out = [r["text_out"] for r in rewriting.apply_rules(df).collect()]
    assert out[1] is None
    assert "`don't`" in out[0] and "do not" in out[0] and "in order to" not in out[0]


def test_digit_values(spark):
    assert one(spark, facts.digit_value(F.col("t")), t="1,234.5%") == 1234.5
    assert one(spark, facts.digit_value(F.col("t"), "it"), t="1.234,5") == 1234.5


def test_fact_difference(spark):
    df = spark.createDataFrame([("We met Ann in 1999 and saw three cats.", "We met Ann in 2001 and saw two cats. Not Bob.")], "a string, b string")
    r = facts.diff(df, "a", "b").first()
    assert r["numbers_missing"] == ["1999", "3"] and r["numbers_added"] == ["2", "2001"]
    assert r["names_missing"] == [] and r["names_added"] == ["Bob"] and r["altered"] == 5 and r["negations_after"] == 1


@pytest.mark.parametrize("k,n,upper", [(0, 300, 0.00993608), (2, 300, 0.02083623), (10, 300, 0.05588474), (0, 75, 0.0391556)])
def test_clopper_pearson(spark, k, n, upper):
    assert one(spark, statistics.clopper_pearson_upper(F.col("k"), F.col("n")), k=k, n=n) == pytest.approx(upper, abs=1e-6)


def test_wilson_and_tail(spark):
    low, high = one(spark, F.struct(*statistics.wilson(F.col("k"), F.col("n"))), k=0, n=75)
    assert low == 0 and 0.03 < high < 0.06
    assert one(spark, statistics.wilson(F.col("k"), F.col("n"))[0], k=0, n=0) is None
    assert one(spark, statistics.upper_tail(F.col("z")), z=1.0) == pytest.approx(0.5 * math.erfc(1 / math.sqrt(2)))


def test_marks(spark):
    words = ["a", "b", "c", "d", "e", "a", "b", "c", "d", "x"]
    df = spark.createDataFrame([(words, words[:5] + ["q"] * 5)], "a array<string>, b array<string>")
    r = df.select(marks.ngrams(F.col("a")).alias("g"), marks.mark_score(F.array_join("a", " "), "k").alias("f"), marks.intact_fraction()("a", "a").alias("all"), marks.intact_fraction()("a", "b").alias("some")).first()
    assert len(r["g"]) == 6 and (r["f"]["grams"], r["f"]["scored"], r["f"]["tokens"]) == (6, 5, 10) and r["all"] == 1.0 and r["some"] == pytest.approx(1 / 6)
    pair = spark.createDataFrame([("a b c d", "a x c y"), (None, "x")], "a string, b string")
    assert [x["r"] for x in pair.select(marks.word_edit_ratio("a", "b").alias("r")).collect()] == [0.5, 0.0]


def test_short_texts_are_neutral(spark):
    df = spark.createDataFrame([("",), ("a b c d e",), (None,), ("a b c d e f",)], "t string")
    got = [r[0] for r in df.select(marks.mark_score(F.col("t"), "k")).collect()]
    assert [(r["scored"], r["mean_g"], r["z"], r["p"]) for r in got[:2]] == [(0, 0.5, 0.0, 0.5)] * 2 and got[2] is None and got[3]["scored"] == 2


def test_sequence_features_of_uniform_logits(spark):
    uniform = [-math.log(10)] * 10
    df = spark.createDataFrame([(1, 3, uniform, uniform), (1, 4, uniform, uniform)], "k int, token int, o array<double>, p array<double>")
    r = marks.sequence_features(df, ["k"]).first()
    assert r["nll_obs"] == pytest.approx(math.log(10)) and r["binoculars"] == pytest.approx(1) and r["perplexity"] == pytest.approx(10) and r["fdg_oo"] == pytest.approx(0, abs=1e-6)


PATHS = ["C:\\Users\\color\\favorite (final).docx", "D:\\Program Files (x86)\\center\\organize.exe", "~/Library/Application Support/color/center.txt", "/usr/local/color/organize.sh", "\\\\server\\color\\favorite.txt", "../color/dir/file.md", "/etc/color"]


@pytest.mark.parametrize("path", PATHS)
def test_rules_and_rewriters_leave_paths_of_every_shape(spark, path):
    text = f"The colour report is at {path} and the theatre programme follows."
    out = one(spark, rewriting.ruled(F.col("t"), ("spelling",)), t=text)
    assert path in out["text"] and out["edits"] == 2
    assert any(text[a:b].startswith(path) for scan in guarded.FROM_REWRITERS for a, b in guarded.every(scan, text))


def test_places_between_paths_stay_prose(spark):
    places = lambda t: one(spark, pieces_of(F.col("t"), guarded.FROM_RULES), t=t)[1::2]
    assert places("Run ./scripts/build.sh and ../other/file.md today.") == ["./scripts/build.sh", "../other/file.md"]
    text = "a@b c@d.ef. `x` ``` y ``` www. https://e.org/(a) ](q(w)e) `` z`` /"
    assert places(text) == ["c@d.ef.", "`x`", "``` y ```", "https://e.org/(a)", "` z`"]
    assert [[text[a:b] for a, b in guarded.every(scan, text)] for scan in (guarded.code_run, guarded.mail_in_prose, guarded.link_target)] == [["`x`", "``` y ```", "`` z``"], ["c@d.ef"], ["](q(w)e)"]]


def test_rules_count_what_they_change(spark):
    df = spark.createDataFrame([("Don't use the color red.",), ("See https://x.y/a—b, `don't` and me@x.org from 2019–2021",), (None,), ("",)], "text string")
    got = rewriting.apply_rules(df, counts="ruled").select("text_out", "ruled.edits", "ruled.counts", rewriting.density(F.col("ruled.edits"), F.lit(5)).alias("d")).collect()
    assert got[0]["text_out"] == "Do not use the colour red." and got[0]["edits"] == 2 and got[0]["counts"]["contractions"] == 1 and got[0]["d"] == 40.0
    assert got[1]["edits"] == 0 and got[1]["text_out"] == df.collect()[1][0] and got[2]["text_out"] is None and got[3]["edits"] == 0
    assert one(spark, rewriting.contractions(F.col("t"))["n"], t="I'd say he's fine and that's it.") == 0 and one(spark, rewriting.contractions(F.col("t"))["text"], t="DON'T. Can't we? i am") == "DO NOT. Cannot we? i'm"
    both = df.select(rewriting.ruled(F.lit("Non c’è — davvero. Additionally, color."), language="it")["text"]).first()[0]
    assert both == "Non c'è, davvero. Additionally, color."


@pytest.mark.parametrize("name,column,text,n", [("dashes", cleaning.dashes, "one — two – three, 1–2", 2), ("typography", cleaning.typography, "“a”… b‑c", 4), ("serial_comma", cleaning.serial_comma, "a, b, and c, d, or é", 1), ("numbers", cleaning.numbers, "5 percent of 1,234,567 not 1,23", 2)])
def test_both_forms_of_a_rule_agree(spark, name, column, text, n):
    got = one(spark, rewriting.ruled(F.col("t"), (name,)), t=text)
    assert (got["text"], got["edits"], got["counts"]) == (one(spark, column(F.col("t")), t=text), n, {name: n})


def test_odd_texts_come_back_whole(spark):
    odd = ["", "x" * 10_000, "a " * 20_000, "`" * 3_000, "a@" * 3_000, "/a b" * 2_000, "``` open\n``` `x", "\U0010ffff1 \U0010ffff0 \U0010ffff\x01", "a\r\nb", "שלום 👍🏽 e\u0301", "C:\\a (b) [c](d(e)f)", "word " * 40_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string").select("k", "t", rewriting.ruled(F.col("t")).alias("r")).collect()
    assert all(r["r"]["text"] == r["t"] and r["r"]["edits"] == 0 for r in rows) and len(rows) == len(odd)


def test_a_rule_that_makes_or_ends_a_place_is_seen_by_the_next(spark):
    assert one(spark, rewriting.ruled(F.col("t")), t="so…~/color is color")["text"] == "so...~/colour is colour"
    assert one(spark, rewriting.ruled(F.col("t")), t="see ~/color, color")["text"] == "see ~/color, colour"


def test_shared_runs_are_those_of_the_standard_matcher():
    rng = random.Random(3)
    for listed in (matching.LISTED_PAIRS, 0):
        for _ in range(400):
            k = rng.choice([1, 2, 3, 8, 40])
            a = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
            b = list(a) if rng.random() < 0.5 else [rng.randrange(k) for _ in range(rng.randint(0, 40))]
            for _ in range(rng.randint(0, 4) if b else 0):
                b[rng.randrange(len(b))] = rng.randrange(k)
            want = [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()][:-1]
            kept, matching.LISTED_PAIRS = matching.LISTED_PAIRS, listed
            try:
                assert matching.shared_runs(a, b) == want
            finally:
                matching.LISTED_PAIRS = kept


def test_texts_that_repeat_themselves_are_matched_in_seconds():
    began = time.time()
    assert matching.shared_runs(["x"] * 20_000, ["x"] * 20_000) == [(0, 0, 20_000)]
    a = [f"w{k}" for k in range(10)] * 2_000
    b = [w if k % 400 else "z" for k, w in enumerate(a)]
    assert sum(size for _, _, size in matching.shared_runs(a, b)) >= 19_900 and time.time() - began < 20


def test_replies_are_cleaned(spark):
    text = '<think>x</think>\n\nOkay, here is a revised version:\nOne line.\n\nTEXT:\nTwo.\n---\nI hope this helps!\n'
    assert one(spark, cleaning.clean_reply(F.col("t")), t=text) == "One line.\n\nTwo."
    assert one(spark, cleaning.clean_reply(F.col("t")), t="“quoted”") == "quoted" and one(spark, cleaning.clean_reply(F.col("t")), t="") == "" and one(spark, cleaning.clean_reply(F.col("t")), t="Here:") == "Here:"


def test_helpers(spark):
    assert one(spark, tokens.file_name(F.col("t")), t="infill@3 / x!") == "infill@3_x" and one(spark, tokens.gigabytes(F.col("n")), n=3 << 29) == "1.5 GB" and one(spark, tokens.head(F.col("t"), 3), t="abcd") == "abc…"
    parts = one(spark, F.struct(cleaning.paragraphs_as_they_are(F.col("t")).alias("p"), cleaning.paragraph_parts(F.col("t")).alias("s")), t="a\n \n\n b\n\nc")
    assert "".join(x for pair in zip(parts["p"], [*parts["s"], ""]) for x in pair) == "a\n \n\n b\n\nc" and len(parts["p"]) == 3
    assert spans.sentences_at("One. Two? Three", [0, 5, 12]) == [0, 1, 2] and spans.first_json("<think>{broken") is None


def test_uniform_logits(spark):
    df = spark.createDataFrame([([1.0] * 20,)], "x array<double>").select(marks.log_softmax(F.col("x")).alias("p"))
    r = df.select(F.element_at("p", 1).alias("nll"), marks.expected(F.col("p"), F.col("p")).alias("h")).first()
    assert -r["nll"] == pytest.approx(math.log(20)) and -r["h"] == pytest.approx(math.log(20))
