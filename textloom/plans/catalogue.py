"""The queries by name, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import cleaning, facts, marks, rewriting, spans, statistics, tokens
from textloom.operators import assess, bench, corpus, evaluation
from textloom.sources.shared import new_path, spread, stored
from textloom.streaming import counter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def r6(c):
    return F.round(c, 6)


# Pieces of SQL that several oracles share.
LETTERS = r"'[\p{L}\p{Nl}\p{No}]+'"
WORDS_SQL = rf"len(regexp_extract_all(text, {LETTERS}))"
CORPUS_SQL = "CASE WHEN {0} BETWEEN 40 AND 99 THEN 'short' WHEN {0} BETWEEN 100 AND 300 THEN 'medium' WHEN {0} BETWEEN 301 AND 600 THEN 'long' END"
ASSESS_SQL = "CASE WHEN {0} > 600 THEN 'long' WHEN {0} BETWEEN 40 AND 99 THEN 'short' WHEN {0} BETWEEN 100 AND 300 THEN 'medium' WHEN {0} BETWEEN 301 AND 600 THEN 'long' END"
VOTES_SQL = ", ".join(f"len(list_filter(t, lambda w: list_contains([{', '.join(repr(w) for w in v)}], w))) AS {k}" for k, v in tokens.LANGUAGE_VOTES.items())
GUESS_SQL = f"""g AS (SELECT *, CASE WHEN en + it + es = 0 THEN NULL WHEN en = greatest(en, it, es) THEN 'en' WHEN it = greatest(en, it, es) THEN 'it' ELSE 'es' END AS guess,
    CASE WHEN en + it + es = 0 THEN 0.0 ELSE greatest(en, it, es) / (en + it + es) END AS share
    FROM (SELECT *, {VOTES_SQL} FROM (SELECT *, regexp_extract_all(lower(text), {LETTERS}) AS t, {WORDS_SQL} AS words FROM documents)))"""
SCORED_SQL = f"""s AS (SELECT *, {ASSESS_SQL.format("words")} AS bucket FROM
    (SELECT d.doc_id, d.lang, d.source, l.toxic, l.quality, l.quality = 0 AS positive, {WORDS_SQL} AS words, length(text) / greatest({WORDS_SQL}, 1) AS score FROM documents d JOIN labels l USING (doc_id)))"""
SPLIT_SQL = """p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY lang, bucket, positive ORDER BY md5('0-' || doc_id), doc_id) <= count(*) OVER (PARTITION BY lang, bucket, positive) // 2
    THEN 'calib' ELSE 'test' END AS part FROM s)"""
AUROC_SQL = "sum(CASE WHEN positive THEN rk END) AS r1, sum(positive::INT) AS n1, sum((NOT positive)::INT) AS n0"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").withColumn("words", tokens.word_count(F.col("text")))


def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir).withColumns({f"v_{k}": v for k, v in tokens.language_votes(F.col("text")).items()})
    guess, share = tokens.best_vote({k: F.col(f"v_{k}") for k in tokens.LANGUAGE_VOTES})
    return df.withColumn("guess", guess).withColumn("share", share)


def scored(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    """Documents with labels: class positive (low quality) and a score, characters a word; and other columns made from the text."""
    rows = documents(spark, sf_dir).withColumns({"score": F.length("text") / F.greatest("words", F.lit(1)), **columns}).drop("text")
    return rows.join(read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), "doc_id").withColumn("positive", F.col("quality") == 0).withColumn("bucket", tokens.assess_bucket(F.col("words")))


def slim(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    """scored(), written once for queries that go over it more often than once."""
    return stored(scored(spark, sf_dir, **columns), "scored")


def split(rows: DataFrame) -> DataFrame:
    return evaluation.split_half(rows, ["lang", "bucket", "positive"], "doc_id")


# ---- words, sentences, languages, buckets


@query(f"""WITH {GUESS_SQL} SELECT guess AS language, {CORPUS_SQL.format("words")} AS bucket, count(*) AS n, round(avg(words), 6) AS mean_words FROM g GROUP BY ALL""")
def language_bucket_profile(spark, sf_dir):
    df = guessed(spark, sf_dir).withColumn("bucket", tokens.corpus_bucket(F.col("words")))
    return df.groupBy(F.col("guess").alias("language"), "bucket").agg(F.count("*").alias("n"), r6(F.avg("words")).alias("mean_words"))


@query(f"SELECT doc_id, {WORDS_SQL} AS words, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*')) AS tokens, (length(text) + 3) // 4 AS estimated_tokens FROM documents")
def word_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "words", F.size(tokens.words(F.col("text"))).cast("long").alias("tokens"), tokens.estimated_tokens(F.col("text")).alias("estimated_tokens"))


@query(f"""WITH w AS (SELECT {WORDS_SQL} AS n FROM documents) SELECT {CORPUS_SQL.format("n")} AS corpus, {ASSESS_SQL.format("n")} AS assess,
    CASE WHEN n >= 40 THEN {CORPUS_SQL.format("least(n, 600)")} END AS learner, count(*) AS n FROM w GROUP BY ALL""")
def bucket_rules(spark, sf_dir):
    n = F.col("words")
    return documents(spark, sf_dir).groupBy(tokens.corpus_bucket(n).alias("corpus"), tokens.assess_bucket(n).alias("assess"), tokens.learner_bucket(n).alias("learner")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT lang, lower(w) AS word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, {LETTERS})) AS w FROM documents) GROUP BY 1, 2)
    SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 20""")
def word_tokens_top(spark, sf_dir):
    words = read(spark, sf_dir, "documents", "lang", "text").select("lang", F.explode(tokens.letter_words(F.col("text"))).alias("w"))
    counted = words.groupBy("lang", F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    return corpus.first_per_group(counted, ["lang"], 20, [F.desc("n"), "word"]).drop("rn")


@query(f"WITH {GUESS_SQL} SELECT doc_id, guess, round(share, 6) AS share FROM g")
def guess_language(spark, sf_dir):
    return guessed(spark, sf_dir).select("doc_id", "guess", r6("share").alias("share"))


@query(f"WITH {GUESS_SQL} SELECT lang, coalesce(guess, 'none') AS guess, count(*) AS n FROM g GROUP BY ALL")
def language_confusion(spark, sf_dir):
    return guessed(spark, sf_dir).groupBy("lang", F.coalesce("guess", F.lit("none")).alias("guess")).agg(F.count("*").alias("n"))


@query(f"WITH {GUESS_SQL} SELECT doc_id, CASE WHEN share >= 0.6 THEN guess WHEN lang IN ('en', 'it', 'es') THEN lang END AS language FROM g")
def fact_language(spark, sf_dir):
    hint = F.when(F.col("lang").isin(*assess.LANGUAGES), F.col("lang"))
    return guessed(spark, sf_dir).select("doc_id", F.when(F.col("share") >= 0.6, F.col("guess")).otherwise(hint).alias("language"))


SENTENCES_SQL = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?…]+["''”’»)\]]*)(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""


@query(f"SELECT doc_id, len(s) AS sentences, round({WORDS_SQL} / greatest(len(s), 1), 6) AS words_per_sentence FROM (SELECT *, {SENTENCES_SQL} AS s FROM documents)")
def sentence_count(spark, sf_dir):
    df = documents(spark, sf_dir).withColumn("n", F.size(tokens.sentences(F.col("text"))).cast("long"))
    return df.select("doc_id", F.col("n").alias("sentences"), r6(F.col("words") / F.greatest("n", F.lit(1))).alias("words_per_sentence"))


@query(rf"""WITH s AS (SELECT doc_id, unnest({SENTENCES_SQL}) AS s FROM documents), w AS (SELECT doc_id, regexp_extract_all(s, {LETTERS}) AS w FROM s),
    m AS (SELECT doc_id, list_sum(list_transform(w, lambda x: length(x))) / len(w) AS m FROM w WHERE len(w) >= 3)
    SELECT doc_id, round(CASE WHEN count(m) >= 2 THEN stddev_pop(m) END, 6) AS burstiness, count(m) AS sentences FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id""")
def burstiness(spark, sf_dir):
    """Spread of the sentences' mean values, null without two that count; here a word's value is its length."""
    words = F.transform(tokens.sentences(F.col("text")), tokens.letter_words)
    total = lambda w: F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    means = F.transform(F.filter(words, lambda w: F.size(w) >= 3), lambda w: total(w) / F.size(w))
    df = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode_outer(means).alias("m"))
    return df.groupBy("doc_id").agg(r6(F.when(F.count("m") >= 2, F.stddev_pop("m"))).alias("burstiness"), F.count("m").alias("sentences"))


# ---- cleaning. The tables hold none of what these operators look for, so both sides put the same characters in first.

INJECTED = ((" the ", " the​ "), (" de ", " de️ "), ("tion", "ti­on"))
INJECT_SQL = "replace(replace(replace(text, ' the ', chr(160) || 'the' || chr(8203) || ' '), ' de ', chr(8201) || 'de' || chr(65039) || ' '), 'tion', 'ti' || chr(173) || 'on')"


def injected(spark, sf_dir):
    text = F.col("text")
    for a, b in INJECTED:
        text = F.replace(text, F.lit(a), F.lit(b))
    # Behind a generator the text is a column, and the replaces are not written into every expression that reads it.
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.array(text)).alias("text"))


@query(f"""WITH t AS (SELECT {INJECT_SQL} AS t FROM documents), c AS (SELECT unnest([chr(160), chr(8203), chr(8201), chr(65039), chr(173)]) AS c, unnest(['NO-BREAK SPACE', 'ZERO WIDTH SPACE', 'THIN SPACE', 'VARIATION SELECTOR-16', 'SOFT HYPHEN']) AS name)
    SELECT name, CAST(sum(length(t) - length(replace(t, c, ''))) AS BIGINT) AS n FROM t, c GROUP BY name HAVING sum(length(t) - length(replace(t, c, ''))) > 0""")
def invisible_scan(spark, sf_dir):
    found = injected(spark, sf_dir).select(F.explode(cleaning.targets(F.col("text"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return found.select(cleaning.character_name(F.col("c")).alias("name"), "n")


@query(f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '[­​️]', '', 'g'), '[  ]', ' ', 'g')) AS digest, length(t) - length(regexp_replace(t, '[­​️  ]', '', 'g')) AS edits
    FROM (SELECT doc_id, {INJECT_SQL} AS t FROM documents)""")
def unicode_clean(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", F.sha2(cleaning.plain_characters(F.col("text")).cast("binary"), 256).alias("digest"), cleaning.edits(F.col("text")).alias("edits"))


def hashed(df, column):
    return df.select("doc_id", F.sha2(column.cast("binary"), 256).alias("digest"))


@query("SELECT doc_id, sha256(replace(replace(replace(text, '. ', '... '), ' the ', ' \"the\" '), ' of ', ' of-')) AS digest FROM documents")
def rule_typography(spark, sf_dir):
    t = F.col("text")
    for a, b in ((". ", "… "), (" the ", " “the” "), (" of ", " of‑")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return hashed(read(spark, sf_dir, "documents", "doc_id", "text"), cleaning.typography(t))


@query(r"SELECT doc_id, sha256(regexp_replace(replace(text, ' the ', ', and '), '(^|[^\p{L}\p{N}_])([\p{L}\p{N}_]+), ([\p{L}\p{N}_]+), (and|or) ([\p{L}\p{N}_]+)', '\1\2, \3 \4 \5', 'g')) AS digest FROM documents")
def rule_serial_comma(spark, sf_dir):
    return hashed(read(spark, sf_dir, "documents", "doc_id", "text"), cleaning.serial_comma(F.replace("text", F.lit(" the "), F.lit(", and "))))


@query("SELECT doc_id, sha256(replace(replace(text, ' of ', ' 1234567 '), ' the ', ' 12.5% ')) AS digest FROM documents")
def rule_numbers(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit(" of "), F.lit(" 1,234,567 ")), F.lit(" the "), F.lit(" 12.5 percent "))
    return hashed(read(spark, sf_dir, "documents", "doc_id", "text"), cleaning.numbers(t))


LEFT_SQL, RIGHT_SQL = r"([^ \t\n\r\x0b\x0c\d,;:(\[])", r"([^ \t\n\r\x0b\x0c\d,;:)\]])"
TWICE_SQL = "regexp_replace(regexp_replace({0}, '{1}', '{2}', 'g'), '{1}', '{2}', 'g')"  # for neighbours that share a character


@query("SELECT doc_id, sha256(" + TWICE_SQL.format("replace(text, ' the ', ' — ')", rf"{LEFT_SQL}[ \t]*[—–][ \t]*{RIGHT_SQL}", r"\1, \2") + ") AS digest FROM documents")
def rule_dashes(spark, sf_dir):
    return hashed(read(spark, sf_dir, "documents", "doc_id", "text"), cleaning.dashes(F.replace("text", F.lit(" the "), F.lit(" — "))))


@query()
def rules_all(spark, sf_dir):
    """All rules for English, with how often each changed something."""
    df = rewriting.apply_rules(spread(documents(spark, sf_dir)), counts="ruled")
    counts = [F.element_at("ruled.counts", name).alias(f"n_{name}") for name, _, _ in rewriting.RULES]
    digest = F.sha2(F.col("text_out").cast("binary"), 256).alias("digest")
    return df.select("doc_id", digest, *counts, F.col("ruled.edits").alias("edits"), rewriting.density(F.col("ruled.edits"), F.col("words")).alias("density"), marks.word_edit_ratio(F.col("text"), F.col("text_out")).alias("edit_ratio"))


@query(rf"""SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')),
    lambda s: s <> '' AND NOT contains(s, '|') AND NOT regexp_matches(s, '^([-*•·]|[0-9]+[.)])\s') AND len(regexp_extract_all(s, {LETTERS})) >= 6 AND regexp_matches(s, '[.!?…»"”''’)]$')), chr(10))) AS digest FROM documents""")
def prose_lines(spark, sf_dir):
    return hashed(read(spark, sf_dir, "documents", "doc_id", "text"), cleaning.prose(F.col("text")))


@query(r"""WITH t AS (SELECT doc_id, '# A heading' || repeat(chr(10), 4) || replace(text, ' the ', ' **the** ') AS t FROM documents)
    SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^\s*(#+\s.*|\*\*[^*]+\*\*\s*)$', '', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM t""")
def tidy_text(spark, sf_dir):
    df = read(spark, sf_dir, "documents", "doc_id", "text")
    return hashed(df, cleaning.tidy(F.concat(F.lit("# A heading\n\n\n\n"), F.replace("text", F.lit(" the "), F.lit(" **the** ")))))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, ',', ' ,'), '.', ' .'), '\s+([,.;:!?)»%])', '\1', 'g'), '([(«])\s+', '\1', 'g'),
    '([\p{L}\p{N}_])\s+''\s*([\p{L}\p{N}_])', '\1''\2', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""")
def detokenize_text(spark, sf_dir):
    df = read(spark, sf_dir, "documents", "doc_id", "text")
    return hashed(df, cleaning.detokenize(F.replace(F.replace("text", F.lit(","), F.lit(" ,")), F.lit("."), F.lit(" ."))))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\n\s*\n'), lambda s: trim(s) <> '')) AS paragraphs FROM documents")
def paragraph_count(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(cleaning.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


@query(rf"""WITH s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, {SENTENCES_SQL} AS l FROM documents)),
    w AS (SELECT doc_id, k, sum(len(regexp_extract_all(s, {LETTERS}))) OVER (PARTITION BY doc_id ORDER BY k) AS words FROM s),
    f AS (SELECT doc_id, min(k) AS sentences, min(words) AS words FROM w WHERE words >= 40 + doc_id % 60 GROUP BY doc_id)
    SELECT doc_id, CAST(words AS BIGINT) AS words, CAST(sentences AS BIGINT) AS sentences FROM f WHERE words <= 300""")
def excerpt_cut(spark, sf_dir):
    got = F.explode(F.array(corpus.cut(F.col("text"), 40 + F.col("doc_id") % 60, F.lit(300)))).alias("g")
    df = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", got).where("g is not null")
    return df.select("doc_id", F.col("g.words").cast("long").alias("words"), F.col("g.sentences").cast("long").alias("sentences"))


# ---- facts


@query(r"""SELECT doc_id, len(l) AS n, list_max(list_transform(l, lambda t: CAST(replace(replace(t, '%', ''), ',', '') AS DOUBLE))) AS largest FROM
    (SELECT doc_id, list_filter(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]{3})*(?:[.,][0-9]+)?%?|[\p{L}\p{Nl}\p{No}]+(?:[''’-][\p{L}\p{Nl}\p{No}]+)*'), lambda t: regexp_matches(t, '^[0-9]') AND TRY_CAST(replace(replace(t, '%', ''), ',', '') AS DOUBLE) IS NOT NULL) AS l FROM documents)""")
def digit_facts(spark, sf_dir):
    df = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", facts.digit_numbers(F.col("text")).alias("l"))
    return df.select("doc_id", F.size("l").cast("long").alias("n"), F.array_max("l").alias("largest"))


NEG_SQL = ", ".join(f"'{w}'" for w in facts.NEGATIONS["en"])


@query(rf"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), {LETTERS}), lambda w: w IN ({NEG_SQL}))) + len(regexp_extract_all(lower(text), 'n[''’]t\b')) AS negations FROM documents""")
def negation_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", facts.negations(F.col("text")).alias("negations"))


@query(rf"""WITH t AS (SELECT lang, ' ' || array_to_string(regexp_extract_all(lower(text), {LETTERS}), ' ') || ' ' AS t FROM documents),
    a AS (SELECT lang, replace(t, ' more than ', ' | ') AS a, t FROM t), b AS (SELECT lang, replace(a, ' less than ', ' | ') AS b, (length(t) - length(a)) // 8 AS more, a FROM a)
    SELECT lang, CAST(sum(more) AS BIGINT) AS more_than, CAST(sum((length(a) - length(b)) // 8) AS BIGINT) AS less_than FROM b GROUP BY lang""")
def quantifier_counts(spark, sf_dir):
    counts = facts.quantifier_counts(F.col("text"))
    return read(spark, sf_dir, "documents", "lang", "text").groupBy("lang").agg(F.sum(counts["more than"]).alias("more_than"), F.sum(counts["less than"]).alias("less_than"))


@query(rf"""WITH w AS (SELECT lower(unnest(regexp_extract_all(text, {LETTERS}))) AS w FROM documents)
    SELECT CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS name_key, count(*) AS n, count(DISTINCT w) AS forms FROM w GROUP BY 1""")
def name_key_groups(spark, sf_dir):
    w = read(spark, sf_dir, "documents", "text").select(F.explode(tokens.letter_words(F.col("text"))).alias("w")).select(F.lower("w").alias("w"))
    once = w.groupBy("w").agg(F.count("*").alias("n"))
    return once.groupBy(cleaning.name_key(F.col("w")).alias("name_key")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


def adjacent(spark, sf_dir):
    """Each turn of a conversation beside the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return turns.withColumn("before", F.lag("text").over(w)).where("before is not null and text is not null")


@query()
def fact_diff_adjacent(spark, sf_dir):
    """With its sentences."""
    found = facts.diff(adjacent(spark, sf_dir), "before", "text")
    return found.withColumn("said", facts.sentences(found)).drop("before", "text")


@query(r"""WITH a AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
    n AS (SELECT conv_id, turn, regexp_extract_all(b || ' 12 7 12 ' || turn, '[0-9]+') AS x, regexp_extract_all(text || ' 12 ' || (turn % 3) || ' 5', '[0-9]+') AS y FROM a WHERE b IS NOT NULL AND text IS NOT NULL),
    l AS (SELECT conv_id, turn, unnest(x) AS v, 1 AS k FROM n UNION ALL SELECT conv_id, turn, unnest(y), -1 FROM n),
    m AS (SELECT conv_id, turn, v, sum(k) AS k FROM l GROUP BY ALL)
    SELECT conv_id, turn, CAST(sum(greatest(k, 0)) AS BIGINT) AS missing, CAST(sum(greatest(-k, 0)) AS BIGINT) AS added FROM m GROUP BY ALL HAVING sum(abs(k)) > 0""")
def multiset_difference(spark, sf_dir):
    digits = lambda c: facts.counted(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))
    turn = F.col("turn")
    before, after = F.concat("before", F.lit(" 12 7 12 "), turn.cast("string")), F.concat("text", F.lit(" 12 "), (turn % 3).cast("string"), F.lit(" 5"))  # the turns have few numbers of their own
    df = adjacent(spark, sf_dir).select("conv_id", "turn", digits(before).alias("a"), digits(after).alias("b"))
    out = df.select("conv_id", "turn", facts.size_of(facts.surplus(F.col("a"), F.col("b"))).alias("missing"), facts.size_of(facts.surplus(F.col("b"), F.col("a"))).alias("added"))
    return out.where("missing + added > 0")


@query()
def facts_rate(spark, sf_dir):
    rows = facts.diff(adjacent(spark, sf_dir), "before", "text").withColumn("shelf", F.pmod("conv_id", F.lit(4)))
    return rows.groupBy("shelf").agg(F.try_divide(F.sum("altered") * 1000.0, F.sum("words")).alias("altered_per_1000_words"), F.count("*").alias("pairs"))


# ---- evaluation


@query(f"WITH {SCORED_SQL}, {SPLIT_SQL} SELECT doc_id, part FROM p")
def split_calib_test(spark, sf_dir):
    return split(slim(spark, sf_dir)).select("doc_id", "part")


@query(f"WITH {SCORED_SQL}, {SPLIT_SQL} SELECT bucket, round(quantile_cont(score, 0.99), 6) AS threshold, count(*) AS n FROM p WHERE part = 'calib' AND NOT positive GROUP BY bucket")
def quantile_threshold(spark, sf_dir):
    rows = split(slim(spark, sf_dir)).where("part = 'calib' and not positive")
    sizes = rows.groupBy(F.col("bucket").alias("of")).agg(F.count("*").alias("n"))
    limits = evaluation.thresholds(rows, ["bucket"]).join(sizes, F.col("bucket").eqNullSafe(F.col("of")))
    return limits.select("bucket", r6("threshold").alias("threshold"), "n")


RANKED_SQL = "SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {0}, score) - 1) / 2.0 AS rk FROM {1} WINDOW w AS (PARTITION BY {0} ORDER BY score)"


@query(f"""WITH {SCORED_SQL}, k AS ({RANKED_SQL.format("lang, bucket", "s")}), a AS (SELECT lang, bucket, {AUROC_SQL} FROM k GROUP BY ALL)
    SELECT lang, bucket, CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg, round(CASE WHEN n1 * n0 > 0 THEN (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) END, 6) AS auroc FROM a""")
def auroc_by_cell(spark, sf_dir):
    return evaluation.auroc(scored(spark, sf_dir), ["lang", "bucket"]).withColumn("auroc", r6("auroc"))


@query(f"""WITH {SCORED_SQL}, g AS (SELECT 'cell:' || lang || '/' || coalesce(bucket, '-') AS g, score, positive FROM s UNION ALL SELECT 'bucket:' || coalesce(bucket, '-'), score, positive FROM s UNION ALL SELECT 'lang:' || lang, score, positive FROM s WHERE bucket <> 'short'),
    k AS ({RANKED_SQL.format("g", "g")}), a AS (SELECT g, {AUROC_SQL} FROM k GROUP BY g)
    SELECT g AS grouping_key, CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg, round(CASE WHEN n1 >= 5 AND n0 >= 5 THEN (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) END, 6) AS auroc FROM a""")
def eval_grouping_sets(spark, sf_dir):
    """Each row counts in its cell, its bucket and, but for short ones, its language; ranks are taken anew in each."""
    b = F.coalesce("bucket", F.lit("-"))
    keys = F.array_compact(F.array(F.concat(F.lit("cell:"), "lang", F.lit("/"), b), F.concat(F.lit("bucket:"), b), F.when(F.col("bucket") != "short", F.concat(F.lit("lang:"), "lang"))))
    counts = evaluation.score_counts(scored(spark, sf_dir), ["lang", "bucket"]).select("score", "p", "q", F.explode(keys).alias("grouping_key"))
    out = evaluation.auroc_of_counts(counts.groupBy("grouping_key", "score").agg(F.sum("p").alias("p"), F.sum("q").alias("q")), ["grouping_key"])
    enough = (F.col("n_pos") >= evaluation.LEAST_CLASS) & (F.col("n_neg") >= evaluation.LEAST_CLASS)
    return out.withColumn("auroc", r6(F.when(enough, F.col("auroc"))))


THRESHOLD_SQL = "h AS (SELECT bucket, quantile_cont(score, 0.9) AS threshold FROM p WHERE part = 'calib' AND NOT positive GROUP BY bucket), j AS (SELECT p.*, h.threshold FROM p JOIN h USING (bucket) WHERE part = 'test')"
RATES_SQL = "r AS (SELECT lang, bucket, sum((positive AND score > threshold)::INT)::BIGINT AS tp, sum((NOT positive AND score > threshold)::INT)::BIGINT AS fp, sum(positive::INT)::BIGINT AS n_pos, sum((NOT positive)::INT)::BIGINT AS n_neg FROM j GROUP BY ALL)"
WILSON_SQL = "({0} / {1} + 1.9208 / {1} {2} 1.96 * sqrt({0} / {1} * (1 - {0} / {1}) / {1} + 0.9604 / ({1} * {1}))) / (1 + 3.8416 / {1})"


def at_threshold(rows, p=None):
    p = split(rows) if p is None else p
    limits = evaluation.thresholds(p.where("part = 'calib'"), ["bucket"], 0.9)
    return evaluation.rates(p.where("part = 'test'").join(F.broadcast(limits), "bucket"), ["lang", "bucket"])  # a row per bucket


@query(f"""WITH {SCORED_SQL}, {SPLIT_SQL}, {THRESHOLD_SQL}, {RATES_SQL} SELECT lang, bucket, tp, fp, n_pos, n_neg, round(CASE WHEN n_pos > 0 THEN tp / n_pos END, 6) AS tpr, round(CASE WHEN n_neg > 0 THEN fp / n_neg END, 6) AS fpr FROM r""")
def tpr_fpr_at_threshold(spark, sf_dir):
    return at_threshold(slim(spark, sf_dir)).select("lang", "bucket", "tp", "fp", "n_pos", "n_neg", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query(f"""WITH {SCORED_SQL}, c AS (SELECT lang, bucket, sum(positive::INT) AS k, count(*) AS n FROM s GROUP BY ALL)
    SELECT lang, bucket, CAST(k AS BIGINT) AS k, n, round(greatest(0, {WILSON_SQL.format("k", "n", "-")}), 6) AS low, round(least(1, {WILSON_SQL.format("k", "n", "+")}), 6) AS high FROM c""")
def wilson_interval(spark, sf_dir):
    c = scored(spark, sf_dir).groupBy("lang", "bucket").agg(F.sum(F.col("positive").cast("long")).alias("k"), F.count("*").alias("n"))
    low, high = statistics.wilson(F.col("k"), F.col("n"))
    return c.select("lang", "bucket", "k", "n", r6(low).alias("low"), r6(high).alias("high"))


def upper_sql(k: str, n: str) -> str:
    """The one-sided bound by bisection over the sum of the binomial's terms."""
    terms = f"list_sum(list_transform(range({k} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln((a.lo + a.hi) / 2) + ({n} - i) * ln(1 - (a.lo + a.hi) / 2))))"
    halved = f"CASE WHEN {terms} > 0.05 THEN {{'lo': (a.lo + a.hi) / 2, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': (a.lo + a.hi) / 2}} END"
    found = f"list_reduce(list_transform(range(50), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 1.0::DOUBLE}}), lambda a, b: {halved})"
    return f"CASE WHEN {n} > 0 THEN CASE WHEN {k} >= {n} THEN 1.0 ELSE ({found}).lo END END"


@query(f"""WITH {SCORED_SQL}, c AS (SELECT lang, bucket, CAST(sum(toxic::INT) AS BIGINT) AS k, count(*) AS n FROM s GROUP BY ALL) SELECT lang, bucket, k, n, round({upper_sql("k", "n")}, 6) AS upper FROM c""")
def clopper_pearson_upper(spark, sf_dir):
    c = scored(spark, sf_dir).groupBy("lang", "bucket").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("k"), F.count("*").alias("n"))
    return c.select("lang", "bucket", "k", "n", r6(statistics.clopper_pearson_upper(F.col("k"), F.col("n"))).alias("upper"))


REPLICATES = 2000


def bootstrap_sql(*keys: str, rows: str = "s", replicates: int = REPLICATES) -> str:
    """Ends in ba (keys, rep, auroc): the histogram of scores, a hash for each of its numbers and replicates, and the Poisson number whose interval it falls into."""
    by, also = ", ".join(keys), "".join(f"{k}, " for k in keys)
    steps = [f"xor(bh, bh >> 16) * {0x85EBCA6B}::UBIGINT & 4294967295::UBIGINT", f"xor(bh, bh >> 13) * {0xC2B2AE35}::UBIGINT & 4294967295::UBIGINT", "xor(bh, bh >> 16)"]
    chain, of = [], "b2"
    for i, step in enumerate(steps):
        chain.append(f"b2{i} AS (SELECT * REPLACE ({step} AS bh) FROM {of})")
        of = f"b2{i}"
    return f"""b0 AS (SELECT {also}score, CAST(count_if(positive) AS BIGINT) AS p, CAST(count_if(NOT positive) AS BIGINT) AS q, min(doc_id) FILTER (positive) AS ip, min(doc_id) FILTER (NOT positive) AS iq FROM {rows} GROUP BY ALL),
    b1 AS (SELECT {also}score, c, n, CAST('0x' || left(md5(concat_ws('-', {by}, c, id)), 8) AS UBIGINT) AS seed FROM (SELECT {also}score, 1 AS c, p AS n, ip AS id FROM b0 WHERE p > 0 UNION ALL SELECT {also}score, 0, q, iq FROM b0 WHERE q > 0)),
    b2 AS (SELECT {also}score, c, n, rep, (seed + rep::UBIGINT * {0x9E3779B9}::UBIGINT) & 4294967295::UBIGINT AS bh FROM b1, range({replicates}) r(rep)), {", ".join(chain)},
    bp AS (SELECT n, k, sum(exp(-n + k * ln(n) - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) - exp(-n + k * ln(n) - lgamma(k + 1)) AS least FROM (SELECT n, CAST(unnest(range(n + 12 * CAST(floor(sqrt(n)) AS BIGINT) + 21)) AS BIGINT) AS k FROM (SELECT DISTINCT n FROM b1))),
    bd AS (SELECT {", ".join(f"x.{k}" for k in keys)}, x.score, x.rep, x.c, bp.k FROM {of} x ASOF JOIN bp ON x.n = bp.n AND x.bh / 4294967296.0 >= bp.least),
    br AS (SELECT {also}rep, score, sum(CASE WHEN c = 1 THEN k ELSE 0 END) AS p, sum(CASE WHEN c = 0 THEN k ELSE 0 END) AS q FROM bd GROUP BY ALL),
    bb AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY {also}rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM br),
    ba AS (SELECT {also}rep, CASE WHEN sum(p) * sum(q) > 0 THEN sum(p * (below + q / 2.0)) / (sum(p) * sum(q)) END AS auroc FROM bb GROUP BY ALL)"""


INTERVAL_SQL = "bi AS (SELECT {0}, l[CAST(floor(len(l) * 0.025) AS BIGINT) + 1] AS auroc_low, l[greatest(CAST(floor(len(l) * 0.975) AS BIGINT), 1)] AS auroc_high FROM (SELECT {0}, list_sort(list(auroc)) AS l FROM ba WHERE auroc IS NOT NULL GROUP BY ALL))"
GATE_SQL = f"""g AS (SELECT r.*, auroc_low, CASE WHEN n_pos > 0 THEN tp / n_pos END AS tpr, {upper_sql("fp", "n_neg")} AS fpr_upper FROM r LEFT JOIN bi USING (lang, bucket)),
    v AS (SELECT *, CASE WHEN auroc_low IS NULL OR tpr IS NULL OR fpr_upper IS NULL THEN 'not enough measured texts' WHEN auroc_low < 0.85 THEN 'AUROC lower bound under 0.85' WHEN tpr < 0.5 THEN 'the threshold catches under half of the positives'
        WHEN fpr_upper > 0.02 THEN 'the false-positive rate could be over 2%' ELSE 'allowed' END AS why FROM g)"""
GATES_SQL = f"""{SCORED_SQL}, {SPLIT_SQL}, {THRESHOLD_SQL}, {RATES_SQL}, {bootstrap_sql("lang", "bucket")}, {INTERVAL_SQL.format("lang, bucket")}, {GATE_SQL}"""


def gated(rows, p=None):
    """The gate's verdict on each cell, from 2,000 replicates and the rates of the test half."""
    cells = evaluation.bootstrap(rows.select("lang", "bucket", "positive", "score", F.col("doc_id").alias("id")), ["lang", "bucket"], REPLICATES)
    joined = at_threshold(rows, p).join(evaluation.interval(cells, ["lang", "bucket"]), ["lang", "bucket"], "left")
    allowed, why = evaluation.gate(F.col("auroc_low"), F.col("tpr"), F.col("fpr_upper"))
    return joined.withColumns({"allowed": allowed, "why": why})


@query(f"WITH {GATES_SQL} SELECT lang, bucket, why = 'allowed' AS allowed, why, round(auroc_low, 6) AS auroc_low, round(fpr_upper, 6) AS fpr_upper FROM v")
def cell_gate(spark, sf_dir):
    return gated(slim(spark, sf_dir)).select("lang", "bucket", "allowed", "why", r6("auroc_low").alias("auroc_low"), r6("fpr_upper").alias("fpr_upper"))


@query(f"WITH {SCORED_SQL}, {bootstrap_sql('lang')} SELECT lang, CAST(rep AS BIGINT) AS rep, round(auroc, 6) AS auroc FROM ba")
def bootstrap_auroc(spark, sf_dir):
    """2,000 replicates."""
    rows = scored(spark, sf_dir).select("lang", "positive", "score", F.col("doc_id").alias("id"))
    return evaluation.bootstrap(rows, ["lang"], REPLICATES).select("lang", F.col("rep").cast("long").alias("rep"), r6("auroc").alias("auroc"))


@query(f"""WITH {SCORED_SQL} SELECT lang, CAST(sum((a AND b)::INT) AS BIGINT) AS both, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM
    (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM (SELECT *, avg((a = b)::INT) OVER w AS po, avg(a::INT) OVER w AS pa, avg(b::INT) OVER w AS pb FROM (SELECT lang, positive AS a, score > 6.5 AS b FROM s) WINDOW w AS (PARTITION BY lang))) GROUP BY lang, po, pe""")
def kappa(spark, sf_dir):
    pairs = scored(spark, sf_dir).select("lang", F.col("positive").alias("a"), (F.col("score") > 6.5).alias("b"))
    return evaluation.agreement(pairs, ["lang"]).select("lang", "both", r6("kappa").alias("kappa"))


@query(f"""WITH {SCORED_SQL} SELECT lang, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall FROM
    (SELECT lang, sum((positive AND score > 6.5)::INT)::BIGINT AS tp, sum((NOT positive AND score > 6.5)::INT)::BIGINT AS fp, sum((positive AND NOT score > 6.5)::INT)::BIGINT AS fn FROM s GROUP BY lang)""")
def precision_recall(spark, sf_dir):
    pairs = scored(spark, sf_dir).select("lang", (F.col("score") > 6.5).alias("tool"), F.col("positive").alias("ref"))
    return evaluation.precision_recall(pairs, ["lang"]).withColumns({"precision": r6("precision"), "recall": r6("recall")})


@query(f"WITH {SCORED_SQL} SELECT doc_id, CASE WHEN (quality = 0) = (toxic = 1) THEN quality = 0 ELSE score > 6.5 END AS reference, (quality = 0) <> (toxic = 1) AS disputed FROM s")
def majority_reference(spark, sf_dir):
    a, b = F.col("quality") == 0, F.col("toxic") == 1
    return scored(spark, sf_dir).select("doc_id", evaluation.majority(a, b, F.col("score") > 6.5).alias("reference"), (a != b).alias("disputed"))


@query(f"""WITH {SCORED_SQL}, k AS ({RANKED_SQL.format("source", "s")}), a AS (SELECT source, {AUROC_SQL} FROM k GROUP BY source),
    v AS (SELECT source AS pair, 'score' AS name, round((r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS value FROM a WHERE n1 * n0 > 0)
    SELECT * FROM v ORDER BY (pair = 'src0' AND (SELECT max(value) FROM v) - value <= 0.005) DESC, value DESC, pair DESC, name DESC LIMIT 1""")
def choose_detector(spark, sf_dir):
    """The feature is the one best candidate; there are as many as sources."""
    cells = evaluation.auroc(scored(spark, sf_dir), ["source"]).where("auroc is not null")
    return evaluation.choose(cells.select(F.col("source").alias("pair"), F.lit("score").alias("name"), r6("auroc").alias("value")), "src0")


@query(f"""WITH {SCORED_SQL}, {SPLIT_SQL}, h AS (SELECT bucket, quantile_cont(score, 0.9) AS t FROM p WHERE part = 'calib' AND NOT positive GROUP BY bucket)
    SELECT lang, bucket, sum((score > t)::INT)::BIGINT AS flagged, count(*) AS n FROM p JOIN h USING (bucket) WHERE part = 'test' AND NOT positive AND toxic = 1 GROUP BY ALL""")
def learner_fpr(spark, sf_dir):
    p = split(slim(spark, sf_dir))
    limits = evaluation.thresholds(p.where("part = 'calib'"), ["bucket"], 0.9)
    rows = p.where("part = 'test' and not positive and toxic = 1").join(F.broadcast(limits), "bucket")
    return rows.groupBy("lang", "bucket").agg(F.sum((F.col("score") > F.col("threshold")).cast("long")).alias("flagged"), F.count("*").alias("n"))


@query(f"""WITH {SCORED_SQL}, h AS (SELECT bucket, quantile_cont(score, 0.99) AS t, list(score) AS hs FROM s WHERE NOT positive GROUP BY bucket),
    g0 AS (SELECT d.doc_id, d.text, {SENTENCES_SQL.replace("(text", "(d.text")} AS se FROM documents d)
    SELECT doc_id, s.bucket, refused, CASE WHEN refused IS NULL THEN len(list_filter(hs, lambda v: v >= score)) END AS tail_k, CASE WHEN refused IS NULL AND t IS NOT NULL THEN CASE WHEN score > t THEN 'machine-like' ELSE 'no evidence' END END AS verdict
    FROM (SELECT s.*, CASE WHEN words < 40 THEN 'too short' WHEN lang NOT IN ('en', 'it', 'es') THEN 'language not measured' WHEN len(se) < 2 THEN 'too few sentences' END AS refused FROM s JOIN g0 USING (doc_id)) s LEFT JOIN h ON s.bucket = h.bucket""")
def assess_verdict(spark, sf_dir):
    rows = slim(spark, sf_dir, sentences=F.size(tokens.sentences(F.col("text"))))
    return assess.assess(rows.drop("bucket").withColumnRenamed("lang", "language"), assess.calibration(rows)).select("doc_id", "bucket", "refused", "tail_k", "verdict")


@query(f"""WITH {SCORED_SQL} SELECT lang, count(*) AS n, count_if(toxic = 1 AND positive AND words <= 300) AS outside, round(count_if(toxic = 1 AND positive AND words <= 300) / count(*), 6) AS share FROM s GROUP BY lang""")
def outside_share(spark, sf_dir):
    pairs = scored(spark, sf_dir).select("lang", (F.col("toxic") == 1).alias("other_a"), F.col("positive").alias("other_b"), (F.col("words") > 300).alias("ref"))
    return evaluation.outside_share(pairs, ["lang"]).select("lang", "n", "outside", r6("share").alias("share"))


@query(f"SELECT round(avg(auroc), 6) AS mean FROM ({ORACLE['auroc_by_cell']}) WHERE bucket IN ('medium', 'long') AND lang IN ('en', 'fr', 'es') HAVING count(auroc) = 6 UNION ALL SELECT 'nan'::DOUBLE FROM ({ORACLE['auroc_by_cell']}) WHERE bucket IN ('medium', 'long') AND lang IN ('en', 'fr', 'es') HAVING count(auroc) <> 6")
def six_cell_mean(spark, sf_dir):
    cells = auroc_by_cell(spark, sf_dir).where(F.col("bucket").isin("medium", "long") & F.col("lang").isin("en", "fr", "es"))
    return evaluation.mean_of_cells(cells, 6).select(r6("mean").alias("mean"))


@query(f"WITH {SCORED_SQL} SELECT doc_id, round(-score, 6) AS binoculars, round(score, 6) AS fast_detectgpt, round(0.5 * score + 0.25 * coalesce(CASE WHEN words >= 100 THEN words END, 80) - 1, 6) AS logistic FROM s")
def detector_scores(spark, sf_dir):
    """Scores turned so that higher is more machine-like, and the linear score with a missing second feature."""
    s, f = F.col("score"), F.lit
    linear = assess.logistic_score(s, F.when(F.col("words") >= 100, F.col("words")), f(0.5), f(0.25), f(-1.0), f(80))
    return scored(spark, sf_dir).select("doc_id", *[r6(assess.oriented(f(d), s)).alias(d) for d in ("binoculars", "fast_detectgpt")], r6(linear).alias("logistic"))


@query()
def logistic_fit(spark, sf_dir):
    rows = scored(spark, sf_dir).where("bucket is not null")
    return assess.logistic_fit(rows.select("bucket", F.col("score").alias("nll"), F.when(F.col("words") % 7 > 0, F.log("words")).alias("burstiness"), "positive"))


# ---- text marks and model outputs

GRAMS_SQL = rf"""t AS (SELECT doc_id, regexp_extract_all(lower(text), {LETTERS}) AS t FROM documents), n AS (SELECT doc_id, unnest(range(1, len(t) - 3)) AS k, t FROM t WHERE len(t) >= 5),
    g AS (SELECT doc_id, k, array_to_string(t[k:k + 4], ' ') AS gram, array_to_string(t[k:k + 3], ' ') AS ctx FROM n), m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ctx ORDER BY k) = 1 AS first FROM g)"""


@query(f"WITH {GRAMS_SQL}, a AS (SELECT doc_id, count(*) AS grams, sum(first::INT)::BIGINT AS scored FROM m GROUP BY doc_id) SELECT t.doc_id, coalesce(grams, 0) AS grams, CASE WHEN len(t) > 5 THEN scored ELSE 0 END AS scored FROM t LEFT JOIN a USING (doc_id)")
def ngram_repetition_mask(spark, sf_dir):
    """Five-word grams of a text, and how many have their first four words for the first time; none counts in a text of five words or fewer."""
    s = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", marks.mark_score(F.col("text"), "key").alias("s"))
    return s.select("doc_id", F.col("s.grams").cast("long").alias("grams"), F.col("s.scored").cast("long").alias("scored"))


BITS_SQL = "+".join(f"(CAST('0x' || md5('key/' || gram)[{2 * k + 1}:{2 * k + 2}] AS INT) % 2)" for k in range(marks.DEPTH))
WEIGHTED_SQL = "+".join(f"{w!r}*(CAST('0x' || md5('key/' || gram)[{2 * k + 1}:{2 * k + 2}] AS INT) % 2)" for k, w in enumerate(marks.layer_weights()))
SD_W = (0.25 * sum(w * w for w in marks.layer_weights()) / marks.DEPTH**2) ** 0.5


@query(f"""WITH {GRAMS_SQL}, a AS (SELECT doc_id, count(*) AS n, avg(({BITS_SQL}) / 8.0) AS g, avg(({WEIGHTED_SQL}) / 8.0) AS w FROM m WHERE first GROUP BY doc_id),
    b AS (SELECT t.doc_id, CASE WHEN len(t) > 5 THEN n ELSE 0 END AS n, g, w FROM t LEFT JOIN a USING (doc_id))
    SELECT doc_id, n AS scored, round(CASE WHEN n > 0 THEN g ELSE 0.5 END, 6) AS mean_g, round(CASE WHEN n > 0 THEN (g - 0.5) / (0.5 / sqrt(n * 8)) ELSE 0 END, 6) AS z,
    round(CASE WHEN n > 0 THEN (w - 0.5) / ({SD_W!r} / sqrt(n)) ELSE 0 END, 6) AS z_w FROM b""")
def mark_score(spark, sf_dir):
    """Mean of the keyed bits over unmasked grams and layers, its z, and z with layers weighted from ten to one; short texts are neutral."""
    s = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", marks.mark_score(F.col("text"), "key").alias("s"))
    return s.select("doc_id", F.col("s.scored").cast("long").alias("scored"), r6("s.mean_g").alias("mean_g"), r6("s.z").alias("z"), r6("s.z_w").alias("z_w"))


@query(ORACLE["mark_score"])
def mark_from_ids(spark, sf_dir):
    """The same score from stored ids and g-values: words as numbers of their digests, and for each gram its array of bits."""
    number = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long")
    words = spread(read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", tokens.letter_words(F.lower("text")).alias("w"))
    rows = words.select("doc_id", F.transform("w", number).alias("ids"), F.transform(marks.ngrams(F.col("w")), lambda gram: marks.g_bits(gram, "key")).alias("g"))
    s = rows.select("doc_id", marks.mark_score_of_ids(F.col("ids"), F.col("g")).alias("s"))
    return s.select("doc_id", F.col("s.scored").cast("long").alias("scored"), r6("s.mean_g").alias("mean_g"), r6("s.z").alias("z"), r6("s.z_w").alias("z_w"))


@query()
def mark_p_value(spark, sf_dir):
    m = mark_score(spark, sf_dir)
    found = (F.col("scored") >= 50) & (F.col("z") > 4)
    return m.select("doc_id", "z", statistics.upper_tail(F.col("z")).alias("p"), found.alias("found"))


@query()
def rewrite_measure(spark, sf_dir):
    """A transform's edit ratio, intact share and coverage, measured on pairs."""
    df = rewriting.apply_rules(read(spark, sf_dir, "documents", "doc_id", "text"), names=("dashes", "typography", "serial_comma", "phrases"))
    words = lambda c: tokens.letter_words(F.lower(c))
    out = df.select("doc_id", marks.word_edit_ratio(F.col("text"), F.col("text_out")).alias("edit_ratio"), marks.intact_fraction()(words(F.col("text")), words(F.col("text_out"))).alias("intact"))
    return out.withColumn("coverage", 1 - F.col("intact"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 8) AS o, list_transform(list_reverse(embedding), lambda v: CAST(v AS DOUBLE) * 8) AS p FROM embeddings),
    y AS (SELECT vec_id, o, p, ln(list_sum(list_transform(o, lambda v: exp(v)))) AS lo, ln(list_sum(list_transform(p, lambda v: exp(v)))) AS lp FROM x)
    SELECT vec_id, round(lo - o[vec_id % 64 + 1], 6) AS nll_obs, round(lp - p[vec_id % 64 + 1], 6) AS nll_perf,
    round(list_sum(list_transform(list_zip(o, p), lambda z: exp(z[2] - lp) * (lo - z[1]))), 6) AS cross_entropy,
    round((lp - p[vec_id % 64 + 1]) / list_sum(list_transform(list_zip(o, p), lambda z: exp(z[2] - lp) * (lo - z[1]))), 6) AS binoculars FROM y""")
def logit_features(spark, sf_dir):
    """Embeddings stand for the logits of an observer, reversed ones for those of a performer; the token is the id modulo 64."""
    scale = lambda c: F.transform(c, lambda v: v.cast("double") * 8)
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", marks.log_softmax(scale(F.col("embedding"))).alias("o"), marks.log_softmax(scale(F.reverse("embedding"))).alias("p"))
    at = (F.col("vec_id") % 64 + 1).cast("int")
    rows = rows.select("vec_id", -F.element_at("o", at).alias("a"), (-F.element_at("o", at)).alias("nll_obs"), (-F.element_at("p", at)).alias("nll_perf"), (-marks.expected(F.col("o"), F.col("p"))).alias("x"))
    return rows.select("vec_id", r6("nll_obs").alias("nll_obs"), r6("nll_perf").alias("nll_perf"), r6("x").alias("cross_entropy"), r6(F.col("nll_perf") / F.col("x")).alias("binoculars"))


@query("""SELECT a.vec_id, round(greatest(-1, least(1, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))))), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(other, "vec_id").select("vec_id", r6(marks.cosine(F.col("embedding"), F.col("b"))).alias("cosine"))


# ---- bench, corpus building, sources

BENCH_SQL = f"b AS (SELECT d.source AS transform, CASE WHEN doc_id % 17 = 0 THEN 'failed' END AS error, CASE WHEN doc_id % 13 > 0 THEN (doc_id % 97) / 10.0 END AS z_after, (length(text) + 3) // 4 AS tokens, {WORDS_SQL} AS words FROM documents d)"


@query(f"""WITH {BENCH_SQL}, o AS (SELECT transform, error, CASE WHEN error IS NULL THEN z_after END AS z, tokens, words FROM b)
    SELECT transform, count(*) FILTER (error IS NULL) AS n, count(*) FILTER (error IS NOT NULL) AS errors, round(avg(z), 6) AS z_mean, round(quantile_cont(CAST(z AS DOUBLE), 0.5), 6) AS z_median, CAST(max(z) AS DOUBLE) AS z_max, round(avg(CASE WHEN z < 4 THEN 1.0 WHEN z IS NOT NULL THEN 0.0 END), 6) AS share_below,
    round(sum(tokens) FILTER (error IS NULL) * 1000.0 / sum(words) FILTER (error IS NULL), 6) AS tokens_per_1000_words FROM o GROUP BY transform""")
def bench_summary(spark, sf_dir):
    df = documents(spark, sf_dir)
    z = F.when(F.col("doc_id") % 13 > 0, (F.col("doc_id") % 97) / 10.0)
    rows = df.select(F.col("source").alias("transform"), F.when(F.col("doc_id") % 17 == 0, F.lit("failed")).alias("error"), z.alias("z_after"), tokens.estimated_tokens(F.col("text")).alias("tokens"), "words")
    s = bench.summary(rows, ["transform"])
    return s.withColumns({c: r6(c) for c in ("z_mean", "z_median", "share_below", "tokens_per_1000_words")})


@query("""SELECT doc_id, label, base, stride FROM (SELECT doc_id, unnest([source, source || '@' || doc_id % 7, lang]) AS label, unnest([source, source, lang]) AS base, unnest([NULL, doc_id % 7, NULL])::INTEGER AS stride FROM documents)""")
def spec_expansion(spark, sf_dir):
    """Each document asks for its source, its source at a stride, and its language, with repeats and blanks between."""
    stride = F.concat("source", F.lit("@"), (F.col("doc_id") % 7).cast("string"))
    listing = F.concat_ws(",", "source", F.concat(F.lit(" "), stride), F.lit(""), "source", F.concat("lang", F.lit(" ")))
    return read(spark, sf_dir, "documents", "doc_id", "source", "lang").select("doc_id", F.explode(bench.specs(listing)).alias("s")).select("doc_id", "s.*")


@query("SELECT doc_id, left(sha1(lang || '|' || source || '|' || (doc_id % 5)), 12) AS digest FROM documents")
def options_digest(spark, sf_dir):
    df = read(spark, sf_dir, "documents", "doc_id", "lang", "source")
    return df.select("doc_id", bench.options_digest(F.col("lang"), F.col("source"), F.col("doc_id") % 5).alias("digest"))


@query("SELECT doc_id AS id, doc_id % 3 = 0 AS cached FROM documents")
def cache_probe(spark, sf_dir):
    df = read(spark, sf_dir, "documents", "doc_id", "text").select(F.lit("rules").alias("transform"), F.col("doc_id").alias("id"), F.lit("d").alias("digest"), "text")
    stored = df.withColumn("text_sha1", F.when(F.col("id") % 3 == 0, F.sha1(F.col("text").cast("binary"))).otherwise("stale")).drop("text")
    return bench.probe(df, stored).select("id", "cached")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_todo(spark, sf_dir):
    return corpus.resume(read(spark, sf_dir, "documents", "doc_id"), read(spark, sf_dir, "labels", "doc_id"), "doc_id")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10")
def limit_per_group(spark, sf_dir):
    return bench.limit_per_group(read(spark, sf_dir, "documents", "doc_id", "source"), "source", 10, "doc_id")


@query("""WITH k AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('q-' || doc_id), doc_id) AS rn FROM documents),
    h AS (SELECT lang, count(DISTINCT source) * 8 - count(*) AS lacking FROM k WHERE rn <= 8 GROUP BY lang),
    m AS (SELECT k.*, row_number() OVER (PARTITION BY lang ORDER BY rn, md5('q-' || doc_id), doc_id) AS rm FROM k WHERE rn > 8)
    SELECT doc_id, 1 AS pass FROM k WHERE rn <= 8 UNION ALL SELECT doc_id, 2 FROM m JOIN h USING (lang) WHERE rm <= lacking""")
def quota_fill(spark, sf_dir):
    return corpus.quota(read(spark, sf_dir, "documents", "doc_id", "lang", "source"), ["lang"], "source", 8).select("doc_id", "pass")


@query("SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 3 AS way FROM documents")
def round_robin(spark, sf_dir):
    return corpus.round_robin(read(spark, sf_dir, "documents", "doc_id", "lang"), 3, "doc_id", ["lang"]).select("doc_id", "way")


@query("""SELECT doc_id, lang, (row_number() OVER (ORDER BY md5('b-' || doc_id), doc_id) - 1) // 10 AS batch FROM
    (SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('s-' || doc_id), doc_id) <= 30)""")
def stratified_sample(spark, sf_dir):
    """Thirty of each language, dealt into batches of ten."""
    picked = corpus.first_per_group(read(spark, sf_dir, "documents", "doc_id", "lang"), ["lang"], 30, corpus.hash_order("s", "doc_id"))
    return corpus.batches(picked, 10, corpus.hash_order("b", "doc_id")).select("doc_id", "lang", "batch")


@query("SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY turn)) AS digest, count(*) AS parts FROM conversations GROUP BY conv_id")
def sentence_regroup(spark, sf_dir):
    g = corpus.regroup(read(spark, sf_dir, "conversations", "conv_id", "turn", "text"), "conv_id", "turn")
    return g.select("conv_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "parts")


@query("SELECT user_id, event_id, event_type FROM events WHERE event_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_wins(spark, sf_dir):
    """Every seventh event stands for a row with an error."""
    rows = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").withColumn("error", F.when(F.col("event_id") % 7 == 0, "failed"))
    return corpus.latest(rows, "user_id", "event_id", "error").drop("error")


@query("SELECT d.doc_id, d.lang, d.source, t.topic_source FROM documents d LEFT JOIN (SELECT lang, max(source) AS topic_source FROM documents WHERE doc_id % 2 = 0 GROUP BY lang) t USING (lang) WHERE d.source <> 'src1'")
def manifest(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "source")
    topics = d.where(F.col("doc_id") % 2 == 0).groupBy("lang").agg(F.max("source").alias("topic_source"))
    return d.join(topics, "lang", "left").where("source <> 'src1'").select("doc_id", "lang", "source", "topic_source")


# ---- events and JSON

BODY = lambda: F.to_json(F.struct(F.when(F.col("event_id") % 9 == 0, 2).otherwise(1).alias("v"), F.when(F.col("event_type") == "click", "page").otherwise(F.col("event_type")).alias("e"), F.lit("home").alias("f"), F.lit("-").alias("m")))


@query("SELECT event_id, event_type = 'click' AND event_id % 9 <> 0 AS ok FROM events")
def event_validate(spark, sf_dir):
    return read(spark, sf_dir, "events", "event_id", "event_type").select("event_id", counter.allowed(BODY()).alias("ok"))


COUNTS_SQL = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"


@query("SELECT event_type AS model, count(*) AS n, round(avg(value), 6) AS z_mean, max(value) AS z_max, count_if(value < 4) AS n_below FROM events GROUP BY event_type")
def model_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "events", "event_type", "value").select(F.col("event_type").alias("model"), F.col("value").alias("z"))
    return bench.model_summary(rows).withColumn("z_mean", r6("z_mean"))


@query("""SELECT role, count(*) AS calls, sum(coalesce(CASE WHEN turn % 2 = 0 THEN turn END, (length(text) + 3) // 4))::BIGINT AS prompt_tokens, sum((length(text) + 3) // 4)::BIGINT AS completion_tokens
    FROM (SELECT role, turn, coalesce(text, '') AS text FROM conversations) GROUP BY role""")
def usage_totals(spark, sf_dir):
    calls = read(spark, sf_dir, "conversations", "role", "turn", "text").select("role", F.col("text").alias("prompt"), F.col("text").alias("reply"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"))
    return bench.usage(calls, ["role"])


@query(COUNTS_SQL)
def event_counts_daily(spark, sf_dir):
    return counter.daily(read(spark, sf_dir, "events", "ts", "event_type"), ["event_type"])


@query(COUNTS_SQL)
def event_counts_stream(spark, sf_dir):
    """The same counts by a streaming query that runs over what is there; its state and its counters lie in the shared folder."""
    at = new_path(spark, "counter")
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counter.start_upsert(stream.select("ts", "event_type"), ["event_type"], f"{at}/counters", f"{at}/checkpoint").awaitTermination()
    return counter.read_counters(spark, f"{at}/counters", ["event_type"])


BATCHES_SQL = """e AS (SELECT *, (event_id * 7) % 3 AS k FROM events), h AS (SELECT k, max(ts) AS high FROM e GROUP BY k), m AS (SELECT a.k, max(b.high) AS before FROM h a JOIN h b ON b.k < a.k GROUP BY a.k),
    c AS (SELECT e.*, coalesce(ts < before - INTERVAL 3 DAY, FALSE) AS late FROM e LEFT JOIN m USING (k))"""


def three_batches(spark, sf_dir):
    """Events in three arrivals, so that many come late; those more than three days behind are told apart. Each arrival is a run of its own over the folder."""
    at = new_path(spark, "counter")
    events = read(spark, sf_dir, "events", "event_id", "ts", "event_type")
    counters = counter.Counters(spark, f"{at}/counters", ["event_type"], "3 days")
    for k in range(3):
        events.where(F.pmod(F.col("event_id") * 7, F.lit(3)) == k).write.mode("append").parquet(f"{at}/source")
        counters.start(spark.readStream.schema(events.schema).parquet(f"{at}/source"), f"{at}/checkpoint").awaitTermination()
    return counters


@query(f"WITH {BATCHES_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM c WHERE NOT late GROUP BY ALL")
def counters_in_batches(spark, sf_dir):
    """Counters over three arrivals, closed days and open ones."""
    return three_batches(spark, sf_dir).counts()


@query(f"WITH {BATCHES_SQL} SELECT event_id, 'more than 3 days late' AS reason, CAST(k AS BIGINT) AS arrival FROM c WHERE late")
def late_events(spark, sf_dir):
    """Events that came too late, with the reason."""
    found = three_batches(spark, sf_dir).late_events()
    rows = read(spark, sf_dir, "events", "event_id").limit(0).select("event_id", F.lit("").alias("reason"), F.lit(0).alias("batch")) if found is None else found
    return rows.select("event_id", "reason", F.col("batch").cast("long").alias("arrival"))


@query("SELECT event_type, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type")
def json_fields(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_type", "props").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count("*").alias("n"))


@query()
def clean_reply(spark, sf_dir):
    """Every turn as a model would wrap it."""
    raw = F.concat(F.lit("<think>a plan</think>\nHere is the text:\n\n"), "text", F.lit("\n\n---\nLet me know what you think."))
    return read(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.sha2(cleaning.clean_reply(raw).cast("binary"), 256).alias("digest"))


# ---- spans, pairs of paragraphs, disputes, verdicts

#: The texts of the tables have no marks, so some are put in front and behind, in the oracle as well.
MARKED_UP = ("# A heading\n````````````\ncode ", "\n````````````\nsee `x` at https://example.org/a_(b) or ~/notes.txt\n- ")


@query(r"""SELECT conv_id, turn, 12 AS fence_start, CAST(12 + 18 + length(text) + 14 AS BIGINT) AS fence_end, 11 AS heading_end, 3 AS inside_tail FROM conversations""")
def span_kinds(spark, sf_dir):
    head, tail = MARKED_UP
    flat = F.concat(F.lit(head), "text", F.lit(tail))
    df = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.length(flat).alias("n"), spans.fence_spans(flat).alias("f"), spans.protected_spans(flat).alias("p"), spans.heading_spans(flat).alias("h"))
    # The tail holds code, an address and a path.
    inside = F.size(F.array_distinct(F.transform(F.filter("p", lambda s: s["start"] >= F.col("f")[0]["end"]), lambda s: s["start"])))
    return df.select("conv_id", "turn", F.col("f")[0]["start"].alias("fence_start"), F.col("f")[0]["end"].cast("long").alias("fence_end"), F.col("h")[0]["end"].alias("heading_end"), inside.alias("inside_tail"))


@query(rf"""WITH a AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    p AS (SELECT conv_id, turn, list_filter(string_split_regex(before, '\n\s*\n'), lambda s: trim(s) <> '') AS b, list_filter(string_split_regex(text, '\n\s*\n'), lambda s: trim(s) <> '') AS t FROM a WHERE before IS NOT NULL AND text IS NOT NULL),
    e AS (SELECT conv_id, turn, unnest(b) AS o, unnest(range(len(b))) AS paragraph FROM p WHERE len(b) = len(t))
    SELECT conv_id, turn, CAST(paragraph AS INTEGER) AS paragraph, len(regexp_extract_all(o, {LETTERS})) AS words FROM e WHERE len(regexp_extract_all(o, {LETTERS})) >= 30""")
def paragraph_pairs(spark, sf_dir):
    """Of all neighbouring turns, by paragraph."""
    pairs = evaluation.paragraph_pairs(adjacent(spark, sf_dir), "before", "text")
    return pairs.select("conv_id", "turn", "paragraph", tokens.word_count(F.col("original")).cast("long").alias("words"))


@query(f"WITH {SCORED_SQL} SELECT doc_id, quality = 0 AS a, toxic = 1 AS b FROM s WHERE (quality = 0) <> (toxic = 1) AND doc_id % 3 <> 0")
def disputes(spark, sf_dir):
    """Where two judgements differ and none of those settled, here every third document, decides."""
    pairs = scored(spark, sf_dir).select("doc_id", (F.col("quality") == 0).alias("a"), (F.col("toxic") == 1).alias("b"))
    settled = read(spark, sf_dir, "documents", "doc_id").where("doc_id % 3 = 0")
    return evaluation.disputes(pairs, settled, "doc_id")


@query(f"""SELECT lang, source, sum(CASE WHEN length(w) >= 4 THEN 10 ELSE 3 END) AS tenths, count(*) AS n FROM
    (SELECT lang, source, lower(unnest(regexp_extract_all(text, '[\\p{{L}}]+'))) AS w FROM documents) WHERE w NOT IN ({", ".join(repr(w) for w in tokens.STOP_WORDS)}) GROUP BY ALL""")
def content_words(spark, sf_dir):
    """Scores of words in tenths, summed by word first."""
    w = read(spark, sf_dir, "documents", "lang", "source", "text").select("lang", "source", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("w"))
    score = tokens.content_score(F.col("w"))
    return w.where(score > 0).groupBy("lang", "source").agg(F.sum(F.round(score * 10).cast("long")).alias("tenths"), F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT doc_id, {WORDS_SQL} AS n, length(text) AS l FROM documents)
    SELECT CASE WHEN v >= 0.95 AND abs(z) < 4 THEN 'good' WHEN v < 0.9 THEN 'poor' ELSE 'close' END AS verdict, count_if(n >= 50 AND z > 4) AS marked, count(*) AS n FROM
    (SELECT n, (doc_id % 21) / 20.0 AS v, l / greatest(n, 1) - 2 AS z FROM c) GROUP BY 1""")
def rewriter_verdicts(spark, sf_dir):
    """Coverage and z are stand-ins."""
    df = documents(spark, sf_dir).select("words", (F.pmod("doc_id", F.lit(21)) / 20.0).alias("v"), (F.length("text") / F.greatest("words", F.lit(1)) - 2).alias("z"))
    return df.groupBy(bench.verdict(F.col("v"), F.col("z")).alias("verdict")).agg(F.count_if(bench.marked(F.col("words"), F.col("z"))).alias("marked"), F.count("*").alias("n"))


@query(f"""WITH {GATES_SQL}, hm AS (SELECT *, row_number() OVER (PARTITION BY bucket, lang ORDER BY md5('c-' || doc_id), doc_id) AS rn FROM p WHERE part = 'calib' AND NOT positive AND bucket IS NOT NULL),
    lm AS (SELECT bucket, round(quantile_cont(score, 0.99), 6) AS threshold, count_if(rn <= 100) AS n, round(sum(score) FILTER (rn <= 100), 6) AS total FROM hm GROUP BY bucket)
    SELECT 'bucket' AS kind, bucket AS name, threshold, n, total, CAST(NULL AS BOOLEAN) AS allowed, CAST(NULL AS VARCHAR) AS why FROM lm
    UNION ALL SELECT 'cell', lang || '/' || bucket, NULL, n_neg, NULL, why = 'allowed', why FROM v""")
def calibration_export(spark, sf_dir):
    """The row that assessments ship with, unfolded: its buckets' thresholds and scores, at most 100 of each language, and what the gate says of its cells."""
    rows = slim(spark, sf_dir)
    p = split(rows)
    humans = p.where("part = 'calib' and not positive and bucket is not null").select("bucket", F.col("lang").alias("cell"), "score", F.col("doc_id").alias("id"), "positive")
    cells = gated(rows, p).select(F.concat_ws("/", "lang", "bucket").alias("cell"), "allowed", "why", F.col("n_neg").alias("n_human"))
    out = evaluation.calibration_export(humans, evaluation.thresholds(humans, ["bucket"]), cells)
    none = F.lit(None)
    b = out.select(F.explode("buckets").alias("name", "e")).select(F.lit("bucket").alias("kind"), "name", r6("e.threshold").alias("threshold"), F.size("e.human_scores").cast("long").alias("n"), r6(F.aggregate("e.human_scores", F.lit(0.0), lambda x, y: x + y)).alias("total"), none.cast("boolean").alias("allowed"), none.cast("string").alias("why"))
    c = out.select(F.explode("cells").alias("name", "e")).select(F.lit("cell").alias("kind"), "name", none.cast("double").alias("threshold"), F.col("e.n_human").alias("n"), none.cast("double").alias("total"), F.col("e.allowed").alias("allowed"), F.col("e.why").alias("why"))
    return b.unionByName(c)


@query()
def facts_by_language(spark, sf_dir):
    """Facts of whole documents in their language; null for those without a lexicon."""
    df = read(spark, sf_dir, "documents", "doc_id", "lang", "text").withColumn("f", facts.facts(F.col("text"), F.col("lang")))
    sized = {k: facts.size_of(F.col(f"f.{k}")) for k in ("numbers", "names", "quantifiers")}
    return df.select("doc_id", "lang", *[v.alias(k) for k, v in sized.items()], F.col("f.negations").alias("negations"), F.col("f.words").alias("words"))


@query()
def changed_word_share(spark, sf_dir):
    """Of each turn, the share of words that no run kept from the turn before."""
    pairs = adjacent(spark, sf_dir).select("conv_id", "turn", F.size(spans.changed_words(F.col("before"), F.col("text"))).alias("changed"), F.size(tokens.words(F.col("text"))).alias("n"))
    return pairs.select("conv_id", "turn", "changed", F.try_divide("changed", "n").alias("share"))


LAYOUT_SQL = "list_transform(string_split('# ' || text, chr(10)), lambda l: '- ' || regexp_replace(regexp_replace(l, '^[ \t]*(?:[-*+]|[0-9]+[.)]|#{1,6}|>)[ \t]+', ''), '^[ \t]+', ''))"


@query(f"SELECT conv_id, turn, md5(array_to_string({LAYOUT_SQL}, chr(10))) AS kept FROM conversations")
def layout_kept(spark, sf_dir):
    """Every turn, by lines: each takes the mark of a list item from a text of as many lines."""
    items = F.array_join(F.transform(F.split("text", "\n", -1), lambda _: F.lit("- a line")), "\n")
    df = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return df.select("conv_id", "turn", F.md5(spans.keep_layout(items, F.concat(F.lit("# "), "text")).cast("binary")).alias("kept"))
