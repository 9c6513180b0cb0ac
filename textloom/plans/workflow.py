"""More queries by name: evaluation by all groups, bench runs, corpora and requests, events by status, outputs of models. They join those of catalogue.py."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from textloom.functions import cleaning, marks, registry, rewriting, spans, tokens
from textloom.operators import assess, corpus, evaluation, runs
from textloom.plans.catalogue import (
    AUROC_SQL, INTERVAL_SQL, RANKED_SQL, REPLICATES, SCORED_SQL, SENTENCES_SQL, SPLIT_SQL, WORDS_SQL, bootstrap_sql, documents, query, r6, read, scored, slim, split,
)
from textloom.sources import reports, requests
from textloom.sources.shared import spread
from textloom.streaming import counter

# ---- evaluation

KIND_SQL = "CASE WHEN NOT positive THEN 'human' WHEN doc_id % 5 = 0 THEN 'rewritten' ELSE 'ai' END"
GENERATORS = ["src0", "src1", "src2"]
FAMILY_SQL = f"""kd AS (SELECT *, {KIND_SQL} AS kind, 'g' || (doc_id % 2) AS genre FROM p WHERE part = 'test'),
    hh AS (SELECT bucket, quantile_cont(score, 0.9) AS threshold FROM p WHERE part = 'calib' AND NOT positive GROUP BY bucket),
    kt AS (SELECT kd.*, hh.threshold FROM kd LEFT JOIN hh USING (bucket)),
    f AS (SELECT 'cell' AS family, lang || '/' || bucket AS of, score, positive, threshold FROM kt WHERE kind <> 'rewritten' UNION ALL SELECT 'bucket', bucket, score, positive, threshold FROM kt WHERE kind <> 'rewritten'
        UNION ALL SELECT 'language', lang, score, positive, NULL FROM kt WHERE kind <> 'rewritten' AND bucket <> 'short'
        UNION ALL SELECT 'generator', source || '/' || bucket, score, positive, threshold FROM kt WHERE kind = 'ai'
        UNION ALL SELECT 'generator', g || '/' || bucket, score, positive, threshold FROM kt, unnest({GENERATORS}) u(g) WHERE kind = 'human'
        UNION ALL SELECT 'genre', genre || '/' || bucket, score, positive, threshold FROM kt WHERE kind <> 'rewritten' UNION ALL SELECT 'rewritten', bucket, score, positive, threshold FROM kt WHERE kind <> 'ai'),
    fg AS (SELECT *, family || ':' || of AS g FROM f WHERE of IS NOT NULL)"""


def judged(spark, sf_dir):
    """The test half with kinds, genres and thresholds: every fifth low-quality document stands for a rewritten one."""
    p = split(slim(spark, sf_dir))
    limits = evaluation.thresholds(p.where("part = 'calib'"), ["bucket"], 0.9)
    kind = F.when(~F.col("positive"), "human").when(F.col("doc_id") % 5 == 0, "rewritten").otherwise("ai")
    rows = p.where("part = 'test'").withColumns({"kind": kind, "genre": F.concat(F.lit("g"), (F.col("doc_id") % 2).cast("string")), "generator": F.col("source")})
    return rows.join(F.broadcast(limits), "bucket", "left")  # a row a bucket


def family_blocks(spark, sf_dir):
    """All families from one table of counts by finest group and score."""
    finest = judged(spark, sf_dir).groupBy("kind", "lang", "bucket", "generator", "genre", "positive", "threshold", "score").agg(F.count("*").alias("n"))
    grouped = evaluation.families(finest, GENERATORS)
    return evaluation.block(grouped.withColumn("threshold", F.when(F.col("by_threshold"), F.col("threshold"))), ["family", "of"], "n")


@query(f"""WITH {SCORED_SQL}, {SPLIT_SQL}, {FAMILY_SQL}, k AS ({RANKED_SQL.format("g", "fg")}),
    a AS (SELECT family, of, {AUROC_SQL}, count_if(positive AND score > threshold) AS tp, count_if(NOT positive AND score > threshold) AS fp, count(threshold) AS nt FROM k GROUP BY family, of)
    SELECT family, of, CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg, round(CASE WHEN n1 >= 5 AND n0 >= 5 THEN (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) END, 6) AS auroc,
    CASE WHEN n1 >= 5 AND n0 >= 5 AND nt > 0 THEN tp END AS tp, CASE WHEN n1 >= 5 AND n0 >= 5 AND nt > 0 THEN fp END AS fp,
    round(CASE WHEN n1 >= 5 AND n0 >= 5 AND nt > 0 THEN tp / n1 END, 6) AS tpr, round(CASE WHEN n1 >= 5 AND n0 >= 5 AND nt > 0 THEN fp / n0 END, 6) AS fpr FROM a""")
def eval_families(spark, sf_dir):
    """The evaluation block by all six families of groups."""
    found = family_blocks(spark, sf_dir)
    return found.select("family", "of", "n_pos", "n_neg", r6("auroc").alias("auroc"), "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query(f"WITH {SCORED_SQL}, {bootstrap_sql('lang')}, {INTERVAL_SQL.format('lang')} SELECT lang, round(auroc_low, 6) AS auroc_low, round(auroc_high, 6) AS auroc_high FROM bi")
def bootstrap_interval(spark, sf_dir):
    """The 51st and 1950th of 2,000 resampled AUROCs."""
    rows = scored(spark, sf_dir).select("lang", "positive", "score", F.col("doc_id").alias("id"))
    found = evaluation.interval(evaluation.bootstrap(rows, ["lang"], REPLICATES), ["lang"])
    return found.select("lang", r6("auroc_low").alias("auroc_low"), r6("auroc_high").alias("auroc_high"))


@query(f"""WITH {SCORED_SQL}, c AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY lang, bucket, positive) AS n FROM s WHERE toxic = 0 WINDOW w AS (PARTITION BY lang, bucket, positive ORDER BY md5('0-' || doc_id), doc_id))
    SELECT doc_id, CASE WHEN rn <= CASE WHEN positive THEN n // 2 ELSE least(n // 2, 10) END THEN 'calib' ELSE 'test' END AS part FROM c UNION ALL SELECT doc_id, 'test' FROM s WHERE toxic <> 0""")
def split_capped(spark, sf_dir):
    """Humans give ten of a stratum to calibration at most, machines half; toxic documents stand for kinds that are only tested."""
    rows = scored(spark, sf_dir)
    return evaluation.split_half(rows, ["lang", "bucket", "positive"], "doc_id", 10, capped=~F.col("positive"), test_only=F.col("toxic") != 0).select("doc_id", "part")


@query()
def eval_tables(spark, sf_dir):
    """The report's tables as lines."""
    found = family_blocks(spark, sf_dir)
    lines = reports.cell_table(found) + reports.side_table(found, "rewritten") + reports.side_table(found, "generator") + reports.side_table(found, "genre")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


CELLS = [("en", "medium", True, "allowed", 0.015), ("en", "long", False, "AUROC lower bound under 0.85", 0.03), ("es", "medium", True, "allowed", 0.02)]
WRITERS = [("en", "medium", 2, 130, 2 / 130, 0.059)]


@query(f"""WITH {SCORED_SQL}, se AS (SELECT doc_id, len({SENTENCES_SQL}) AS n FROM documents), r AS (SELECT s.*, CASE WHEN words < 40 THEN 'too short' WHEN lang NOT IN ('en', 'it', 'es') THEN 'language not measured' WHEN n < 2 THEN 'too few sentences' END AS r0 FROM s JOIN se USING (doc_id)),
    c AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {c}, '{d}')" for a, b, c, d, _ in CELLS)}) v(lang, bucket, allowed, why))
    SELECT doc_id, coalesce(r0, CASE WHEN NOT coalesce(allowed, FALSE) THEN 'cell not allowed: ' || coalesce(why, 'not measured') END) AS refused, r0 IS NULL AND coalesce(allowed, FALSE) AS judged FROM r LEFT JOIN c USING (lang, bucket)""")
def assess_cells(spark, sf_dir):
    """Verdicts are given in cells that allow it."""
    rows = slim(spark, sf_dir, sentences=F.size(tokens.sentences(F.col("text"))))
    return told(spark, rows.drop("bucket").withColumnRenamed("lang", "language"), rows).select("doc_id", "refused", F.col("verdict").isNotNull().alias("judged"))


def told(spark, texts, rows):
    cells = spark.createDataFrame(CELLS, "language string, bucket string, allowed boolean, why string, fpr_upper double")
    writers = spark.createDataFrame(WRITERS, "language string, bucket string, fp int, n int, fpr double, fpr_upper double")
    return assess.with_cells(assess.assess(texts, assess.calibration(rows)), cells, writers)


@query()
def assess_sentences(spark, sf_dir):
    rows = slim(spark, sf_dir, sentences=F.size(tokens.sentences(F.col("text"))))
    found = told(spark, rows.drop("bucket").withColumnRenamed("lang", "language"), rows)
    return found.select("doc_id", assess.spoken(found).alias("said"))


# ---- bench runs


def matter_sql(base: str) -> str:
    given = {"transform": base} | {k: None for k in registry.Options.__dataclass_fields__} | {"ngram_len": 5, "rules": [], "language": "en"}
    return hashlib.sha1(json.dumps(given, sort_keys=True).encode()).hexdigest()[:12]


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{matter_sql('rules')}' ELSE '{matter_sql('none')}' END AS digest FROM documents")
def option_matter_digest(spark, sf_dir):
    """Twelve digits over the sorted JSON of the twelve options."""
    base = F.when(F.col("doc_id") % 2 == 0, "rules").otherwise("none")
    given = {"ngram_len": F.lit(5), "rules": F.array().cast("array<string>"), "language": F.lit("en")}
    return read(spark, sf_dir, "documents", "doc_id").select("doc_id", runs.digest(base, given).alias("digest"))


@query("SELECT doc_id AS id, label, label AS base, CAST(NULL AS INTEGER) AS stride FROM documents, (SELECT unnest(['rules', 'none']) AS label)")
def specs_by_samples(spark, sf_dir):
    """Unknown specifications are skipped, repeats count once."""
    rows, unknown = runs.asked(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "rules, nothing@2, none, rules", registry.transforms)
    assert unknown == ["nothing@2"]
    return rows


def bench_rows(spark, sf_dir, of=lambda samples: samples):
    """Runs over all documents; a third of the results is in the cache already, every seventeenth text is missing."""
    text = F.when(F.col("doc_id") % 17 > 0, F.col("text"))
    samples = of(spread(read(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), text.alias("text"))))
    known = registry.transforms.with_function("picky", picky)
    asked = lambda rows: runs.asked(rows, "rules,unicode,picky", known)[0]
    cache = runs.new_entries(runs.run(asked(samples.where(F.col("id") % 3 == 0)), known))
    return runs.run(asked(runs.with_cached(samples, cache)), known), samples


def picky(text: str, options: registry.Options) -> str:
    """A transform that fails on every text of a length that five divides."""
    if len(text) % 5 == 0:
        raise ValueError(f"{len(text)} characters")
    return text.upper()


@query("""WITH r AS (SELECT label, doc_id, doc_id % 17 = 0 OR (label = 'picky' AND length(text) % 5 = 0) AS failed FROM documents, (SELECT unnest(['rules', 'unicode', 'picky']) AS label))
    SELECT label, count(*) FILTER (NOT failed) AS n, count(*) FILTER (failed) AS errors, count(*) FILTER (NOT failed AND doc_id % 3 = 0) AS cached FROM r GROUP BY label""")
def bench_run(spark, sf_dir):
    """A text that is missing, or on which a transform fails, is a row with an error; all others are done."""
    rows, _ = bench_rows(spark, sf_dir)
    ok = F.col("error").isNull()
    return rows.groupBy("label").agg(F.count_if(ok & F.col("entry").isNotNull()).alias("n"), F.count_if(~ok).alias("errors"), F.count_if(F.col("cached")).alias("cached"))


@query()
def bench_measure(spark, sf_dir):
    """The mark before and after, and how much stays; controls are unmarked texts as they are."""
    rows, samples = bench_rows(spark, sf_dir, runs.marked)
    plain = runs.controls(samples.where("id % 4 = 0")).withColumns({"digest": F.lit(None).cast("string"), "text_sha1": F.lit(None).cast("string")})
    both = rows.unionByName(plain).withColumn("entry", F.struct("entry.text"))
    measured = runs.measured(both).withColumns({c: F.lit(None).cast("double") for c in ("prompt_tokens", "completion_tokens")})
    return runs.summary(measured).drop("seconds_mean")


def shared_words(before: str, after: str) -> float:
    """A metric that fails on long texts."""
    if len(before) > 4000:
        raise MemoryError(f"{len(before)} characters")
    return float(len(after))


@query("""WITH f AS (SELECT min(doc_id) AS first FROM documents WHERE length(text) > 4000) SELECT doc_id, CASE WHEN first IS NULL OR doc_id < first THEN CAST(length(text) AS DOUBLE) END AS size,
    CASE WHEN doc_id = first THEN 'MemoryError: ' || length(text) || ' characters' END AS size_error FROM documents, f""")
def metric_breaker(spark, sf_dir):
    """A metric that fails is null from its first failure on, in the order of ids, however rows are dealt."""
    rows = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("after", F.col("text"))
    return runs.optional_metrics(rows, {"size": shared_words}, "doc_id", "text", "after").select("doc_id", "size", "size_error")


def lengths_or_failure(texts: list[str]) -> list[float]:
    if any(len(t) % 7 == 0 for t in texts):
        raise ValueError("a length that seven divides")
    return [float(len(t)) for t in texts]


@query("""SELECT doc_id AS id, CASE WHEN length(text) % 7 > 0 THEN CAST(length(text) AS DOUBLE) END AS score, CASE WHEN length(text) % 7 = 0 THEN 'ValueError: a length that seven divides' END AS error FROM documents""")
def score_resumed(spark, sf_dir):
    """Scores by batches; a third is done already, and what failed then is tried anew."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    done = runs.scores(docs.where("doc_id % 3 = 0"), lengths_or_failure, "doc_id")
    return runs.scored_so_far(docs, done, lengths_or_failure, "doc_id")


@query("SELECT doc_id, len(regexp_extract_all(replace(replace(text, '. ', '… '), ' the ', ' “the” '), '[“”„‘’‚…‑‐]')) AS changed FROM documents")
def rule_counts(spark, sf_dir):
    """How often a rule changed something: typographic characters are put into each document first."""
    typed = F.replace(F.replace("text", F.lit(". "), F.lit("… ")), F.lit(" the "), F.lit(" “the” "))
    ruled = rewriting.ruled(typed, ("typography",))
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.element_at(ruled["counts"], "typography").cast("long").alias("changed"))


# ---- corpora and requests

LONGEST_SQL = """t0 AS (SELECT doc_id, lang, CASE WHEN source < 'src3' THEN 'wiki' ELSE 'news' END AS genre, {w} AS words, md5('l-' || doc_id) AS h, NULL AS bucket FROM documents)""".format(w=WORDS_SQL)


def _stage_sql(name: str, before: str, bucket: str, low: int, room: str) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY lang, genre, bucket IS NULL AND words >= {low} ORDER BY h, doc_id) AS rn FROM {before}"
    return f"{name} AS (SELECT doc_id, lang, genre, words, h, CASE WHEN bucket IS NULL AND words >= {low} AND rn <= {room} THEN '{bucket}' ELSE bucket END AS bucket FROM ({ranked}))"


EACH = 6
FIRST_SQL = ", ".join(_stage_sql(f"t{k + 1}", f"t{k}", b, low, str(EACH)) for k, (b, low, _) in enumerate(reversed(tokens.BUCKETS)))
ROOM_SQL = f"""gg AS (SELECT DISTINCT lang, genre, b AS bk FROM t0, unnest({[b for b, _, _ in tokens.BUCKETS]}) u(b)), lk AS (SELECT gg.*, {EACH} - (SELECT count(*) FROM t3 WHERE t3.lang = gg.lang AND t3.genre = gg.genre AND t3.bucket = gg.bk) AS lacks FROM gg),
    rm AS (SELECT *, CASE WHEN lacks = 0 THEN sum(lacks) OVER (PARTITION BY lang, bk) ELSE 0 END AS room FROM lk), u0 AS (SELECT * FROM t3 WHERE bucket IS NULL)"""
SECOND_SQL = ", ".join(
    _stage_sql(f"u{k + 1}", f"u{k}", b, low, f"(SELECT room FROM rm WHERE rm.lang = q.lang AND rm.genre = q.genre AND rm.bk = '{b}')").replace(f"FROM u{k})", f"FROM u{k}) q") for k, (b, low, _) in enumerate(reversed(tokens.BUCKETS))
)


@query(f"WITH {LONGEST_SQL}, {FIRST_SQL}, {ROOM_SQL}, {SECOND_SQL} SELECT doc_id, bucket, 1 AS pass FROM t3 WHERE bucket IS NOT NULL UNION ALL SELECT doc_id, bucket, 2 FROM u3 WHERE bucket IS NOT NULL")
def longest_open(spark, sf_dir):
    """Each document to the longest bucket that is open for its language and genre, in two passes."""
    rows = documents(spark, sf_dir).select("doc_id", "lang", F.when(F.col("source") < "src3", "wiki").otherwise("news").alias("genre"), "words")
    return corpus.longest_open(rows, "lang", "genre", "words", EACH).select("doc_id", "bucket", "pass")


@query("""WITH t AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('a-' || doc_id), doc_id) AS turn FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS place FROM t)
    SELECT doc_id, lang, source, place FROM p WHERE place <= 12""")
def alternate_sources(spark, sf_dir):
    """Twelve of each language, sources in turn."""
    return corpus.alternate(read(spark, sf_dir, "documents", "doc_id", "lang", "source"), "lang", "source", 12).select("doc_id", "lang", "source", F.col("place").cast("long").alias("place"))


@query("""WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s-' || doc_id), doc_id) AS rn FROM documents), p AS (SELECT * FROM t WHERE rn <= 30)
    SELECT doc_id, lang, CASE WHEN rn <= 15 THEN 'dev' ELSE 'heldout' END AS part, row_number() OVER (ORDER BY md5('s2-' || doc_id), doc_id) AS number FROM p""")
def sample_halves(spark, sf_dir):
    """Thirty of each language, half for development, numbered in one shuffled order."""
    return corpus.halves(read(spark, sf_dir, "documents", "doc_id", "lang"), ["lang"], 30, "s").select("doc_id", "lang", "part", F.col("number").cast("long").alias("number"))


@query("SELECT CAST(conv_id AS VARCHAR) AS doc, count(*) AS parts, count(text) AS texts FROM conversations GROUP BY conv_id")
def sentence_rows(spark, sf_dir):
    """Rows named by document and ordinal, joined again and detokenised."""
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    texts = rows.groupBy(F.split_part("id", F.lit("-"), F.lit(1)).alias("doc")).agg(F.count("text").alias("texts"))
    return corpus.regroup_sentences(rows).select("doc", "parts").join(texts, "doc")


@query("""WITH d AS (SELECT doc_id, text, lang, source FROM documents WHERE doc_id % 3 > 0 AND text <> ''), q AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id FROM documents WHERE doc_id % 5 = 0)
    SELECT doc_id AS id, lang, source AS genre FROM d WHERE doc_id IN (SELECT doc_id FROM q) AND doc_id NOT IN (SELECT doc_id FROM n)""")
def answers_ingest(spark, sf_dir):
    """Answers that were asked for and are not in yet."""
    d = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    asked = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "lang", F.col("source").alias("genre"), F.lit("t").alias("topic"))
    done = d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"))
    answers = d.where("doc_id % 3 > 0").select(F.col("doc_id").alias("id"), "text")
    return requests.ingest(answers, asked, done, "g", "m").select("id", "lang", "genre")


@query("SELECT doc_id AS id, doc_id - 1 AS source, length(d.text) AS n, (SELECT length(o.text) FROM documents o WHERE o.doc_id = d.doc_id - 1) AS n_original FROM documents d WHERE d.doc_id % 2 = 1 AND EXISTS (SELECT 1 FROM documents o WHERE o.doc_id = d.doc_id - 1)")
def rewrites_beside_originals(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
    odd = d.where("id % 2 = 1").withColumn("source", F.col("id") - 1)
    found = requests.rewrites(odd, d)
    return found.select("id", "source", F.length("text").cast("long").alias("n"), F.length("original").cast("long").alias("n_original"))


@query("""WITH v AS (SELECT source AS dataset, lang AS config, count(*) AS r FROM documents GROUP BY ALL)
    SELECT dataset, config, CAST(t AS INTEGER) AS try, CAST(('0x' || left(md5('0-' || dataset || '-' || config || '-' || t), 12)) AS BIGINT) % greatest(1, r - 10) AS "offset" FROM v, range(1, 41) u(t)""")
def random_page_offsets(spark, sf_dir):
    """Where pages of ten are read from each source and language, whose documents are its rows."""
    sources = read(spark, sf_dir, "documents", "source", "lang").groupBy(F.col("source").alias("dataset"), F.col("lang").alias("config")).agg(F.count("*").alias("rows"))
    return requests.random_pages(sources, page=10).select("dataset", "config", "try", "offset")


@query("SELECT DISTINCT source FROM documents ORDER BY source")
def distinct_sorted(spark, sf_dir):
    return read(spark, sf_dir, "documents", "source").distinct().orderBy("source")


@query("SELECT DISTINCT p_name AS name, split_part(p_name, ':', 1) IN (SELECT split_part(p_name || ':4b', ':', 1) FROM part WHERE p_partkey % 3 = 0) AS installed FROM part")
def installed_flags(spark, sf_dir):
    """Parts stand for models: those of every third are there, under a tag."""
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name")
    local = parts.where("p_partkey % 3 = 0").select(F.concat("p_name", F.lit(":4b")).alias("name"))
    return requests.installed(parts.select(F.col("p_name").alias("name")).distinct(), local).select("name", "installed")


@query("SELECT page_id AS path, sha256(html) AS found, page_id % 2 = 0 AS intact FROM pages")
def pinned_files(spark, sf_dir):
    """Every second page has the digest that it should have."""
    pages = read(spark, sf_dir, "pages", "page_id", "html").select(F.col("page_id").alias("path"), F.col("html").cast("binary").alias("content"))
    pins = pages.select("path", F.when(F.col("path") % 2 == 0, F.sha2("content", 256)).otherwise("other").alias("sha256"))
    return requests.pinned(pages, pins).select("path", "found", "intact")


# ---- words in sentences, outputs of models


@query(rf"""WITH m AS (SELECT doc_id, regexp_replace(text, '([.!?…]+["''”’»)\]]*)(\s|$)', '\1' || chr(1) || '\2', 'g') AS t FROM documents), w AS (SELECT doc_id, regexp_extract_all(t, '\x01|[\p{{L}}\p{{Nl}}\p{{No}}]+') AS w FROM m)
    SELECT doc_id, len(list_filter(w, lambda x: x <> chr(1))) AS words, CASE WHEN list_contains(w, chr(1)) THEN list_position(w, chr(1)) - 1 ELSE len(w) END AS in_first FROM w""")
def words_in_sentences(spark, sf_dir):
    """Each word's sentence by its place: how many words there are, and how many of them in the first."""
    df = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", spans.sentence_of_words(F.col("text")).alias("at"))
    first = F.size(F.filter("at", lambda k: k == 0))
    return df.select("doc_id", F.size("at").cast("long").alias("words"), first.cast("long").alias("in_first"))


@query("""WITH x AS (SELECT vec_id // 8 AS seq, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 8) AS o, list_transform(list_reverse(embedding), lambda v: CAST(v AS DOUBLE) * 8) AS p FROM embeddings),
    y AS (SELECT seq, vec_id, o, p, ln(list_sum(list_transform(o, lambda v: exp(v)))) AS lo, ln(list_sum(list_transform(p, lambda v: exp(v)))) AS lp FROM x),
    z AS (SELECT seq, o[vec_id % 64 + 1] - lo AS ll, list_sum(list_transform(o, lambda v: exp(v - lo) * (v - lo))) AS m_oo, list_sum(list_transform(o, lambda v: exp(v - lo) * (v - lo) * (v - lo))) AS s_oo,
        list_sum(list_transform(list_zip(o, p), lambda t: exp(t[2] - lp) * (t[1] - lo))) AS m_po, list_sum(list_transform(list_zip(o, p), lambda t: exp(t[2] - lp) * (t[1] - lo) * (t[1] - lo))) AS s_po FROM y)
    SELECT seq, round(-avg(ll), 6) AS nll_obs, round(exp(least(-avg(ll), 50)), 5) AS perplexity, round((sum(ll) - sum(m_oo)) / sqrt(greatest(sum(s_oo - m_oo * m_oo), 1e-9)), 5) AS fdg_oo, round((sum(ll) - sum(m_po)) / sqrt(greatest(sum(s_po - m_po * m_po), 1e-9)), 5) AS fdg_po FROM z GROUP BY seq""")
def zero_shot_features(spark, sf_dir):
    """Embeddings stand for an observer's logits and reversed ones for a performer's, eight of them for a text; the token is the id modulo 64."""
    scale = lambda c: F.transform(c, lambda v: v.cast("double") * 8)
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    rows = rows.select(F.floor(F.col("vec_id") / 8).alias("seq"), (F.col("vec_id") % 64).cast("int").alias("token"), marks.log_softmax(scale(F.col("embedding"))).alias("o"), marks.log_softmax(scale(F.reverse("embedding"))).alias("p"))
    f = marks.sequence_features(rows, ["seq"])
    return f.select("seq", r6("nll_obs").alias("nll_obs"), F.round("perplexity", 5).alias("perplexity"), F.round("fdg_oo", 5).alias("fdg_oo"), F.round("fdg_po", 5).alias("fdg_po"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\n{2,}'), lambda s: trim(s) <> '')) AS on_blank_lines, len(string_split_regex(text, '\n[ \t]*\n\s*')) AS as_they_are FROM documents")
def paragraph_variants(spark, sf_dir):
    """Three ways of cutting; paragraph_count has the third."""
    t = F.col("text")
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(cleaning.paragraphs_on_blank_lines(t)).cast("long").alias("on_blank_lines"), F.size(cleaning.paragraphs_as_they_are(t)).cast("long").alias("as_they_are"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[.!?…:]+["''”»)\\]]*\\s+|\\n')) AS clauses, len(regexp_extract_all(text, '[.!?…]\\s+')) AS after_stops, len(regexp_extract_all(regexp_replace(text, '([.!?…]+["''”’)\\]]*)(\\s|$)', chr(1) || '\\2', 'g'), '\\x01|\\n')) AS with_quotes FROM documents""")
def sentence_cuts(spark, sf_dir):
    """Where the three other splitters cut."""
    df = read(spark, sf_dir, "documents", "doc_id", "text")
    return df.select("doc_id", *[F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long").alias(name) for name, p in tokens.OTHER_SPLITS.items()])


@query("SELECT doc_id, sha1(text) AS sha1, CASE WHEN length(text) > 9 THEN left(text, 9) || '…' ELSE text END AS head FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents)")
def short_forms(spark, sf_dir):
    """One line of a text, its digest and its head."""
    line = tokens.one_line(F.col("text"))
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha1(line.cast("binary")).alias("sha1"), tokens.head(line, 9).alias("head"))


# ---- events

SITE = "https://example.org"


@query(f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 204 WHEN event_id % 7 = 0 OR event_id % 13 = 0 THEN 404 WHEN event_id % 5 = 0 THEN 403 WHEN event_id % 9 = 0 OR event_type <> 'click' THEN 400 ELSE 200 END AS status FROM events""")
def event_status(spark, sf_dir):
    """How the counter answers requests of all kinds."""
    from textloom.plans.catalogue import BODY

    n = F.col("event_id")
    method = F.when(n % 11 == 0, "OPTIONS").when(n % 7 == 0, "GET").otherwise("POST")
    path = F.when(n % 13 == 0, "/x").otherwise("/e")
    origin = F.when(n % 5 == 0, "https://elsewhere.org").otherwise(SITE)
    return read(spark, sf_dir, "events", "event_id", "event_type").select("event_id", counter.status(method, path, origin, BODY(), SITE).alias("status"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 6 <> 0 AND NOT (event_id % 10 = 1) GROUP BY event_type")
def events_not_opted_out(spark, sf_dir):
    """By either signal."""
    n = F.col("event_id")
    out = counter.opted_out(n % 6 == 0, F.when(n % 10 == 1, "1").when(n % 10 == 2, "0"))
    return read(spark, sf_dir, "events", "event_id", "event_type").where(~out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT min(ts) + INTERVAL 1 DAY AS a, min(ts) + INTERVAL 2 DAY AS b, min(ts) + INTERVAL 3 DAY AS c FROM events)
    SELECT event_id, CASE WHEN ts >= a AND ts < b THEN b WHEN ts >= c THEN NULL ELSE ts END AS sent_at FROM events, l""")
def events_held(spark, sf_dir):
    """Events of a locked stretch go out when it ends."""
    e = read(spark, sf_dir, "events", "event_id", "ts")
    day = lambda k: F.expr(f"first + INTERVAL {k} DAY")
    locks = e.agg(F.min("ts").alias("first")).select(F.inline(F.array(F.struct(day(1).alias("locked_from"), day(2).alias("locked_to")), F.struct(day(3).alias("locked_from"), F.lit(None).cast("timestamp_ntz").alias("locked_to")))))
    return counter.sent(e, locks).select("event_id", "sent_at")
