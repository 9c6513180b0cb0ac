"""Where texts come from: the catalogue of sources, pages at random places of them, requests for texts and the answers to these."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import cleaning, tokens
from textloom.operators import corpus

# The sources by language and genre, in the order in which they are read. The second round's fallback is marked by place 2.
SOURCES = "lang string, genre string, place int, dataset string, config string, split string, text_field string, topic_field string, rows long"
CATALOGUE = [
    ("en", "wiki", 1, "wikimedia/wikipedia", "20231101.en", "train", "text", "title", 6407814),
    ("it", "wiki", 1, "wikimedia/wikipedia", "20231101.it", "train", "text", "title", 1833639),
    ("es", "wiki", 1, "wikimedia/wikipedia", "20231101.es", "train", "text", "title", 1841155),
    ("en", "news", 1, "EdinburghNLP/xsum", "default", "train", "document", "summary", 204045),
    ("it", "news", 1, "ARTeLab/ilpost", "default", "train", "source", "target", 35201),
    ("es", "news", 1, "GEM/mlsum", "es", "train", "text", "title", 259888),
    ("it", "news", 2, "ARTeLab/fanpage", "default", "train", "source", "target", 67492),
]
#: Words to ask for so that a text comes out in the bucket.
ASKED_WORDS = {"short": 65, "medium": 190, "long": 420}


def catalogue(spark: SparkSession, second_round: bool = False) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, SOURCES).where(F.lit(second_round) | (F.col("place") == 1))


def random_pages(sources: DataFrame, tries: int = 40, page: int = 100, seed: str = "0") -> DataFrame:
    """sources with try and offset: `tries` places in [0, rows - page), drawn by a digest, so that any run asks for the same pages."""
    each = sources.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "dataset", "config", F.col("try").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    return each.withColumn("offset", F.pmod(drawn, F.greatest(F.lit(1), F.col("rows") - page)))


def fill(pages: DataFrame, seen: DataFrame, each: int, lang: str = "lang", genre: str = "genre") -> DataFrame:
    """Human texts of pages (dataset, config, row_idx, place, lang, genre, text): prose of documents not seen, the first sources' before the others', in the longest bucket
    that is open."""
    least = F.when(F.col(genre) == "wiki", 12).otherwise(6)
    rows = pages.join(seen.select("dataset", "config", "row_idx"), ["dataset", "config", "row_idx"], "left_anti").dropDuplicates(["dataset", "config", "row_idx"])
    rows = rows.withColumn("text", F.when(least == 12, cleaning.prose(F.col("text"), 12)).otherwise(cleaning.prose(F.col("text"), 6)))
    rows = rows.withColumn("words", tokens.word_count(F.col("text"))).withColumn("id", F.concat_ws("-", F.lit("h"), lang, genre, F.when(F.col("place") > 1, F.split_part("dataset", F.lit("/"), F.lit(-1))), F.col("row_idx").cast("string")))
    return corpus.longest_open(rows, lang, genre, "words", each, id_col="id")


def top_up(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Requests whose id is not there yet."""
    return requests.join(existing.select("id"), "id", "left_anti")


def long_requests(topics: DataFrame, n: int, generators: tuple[str, ...], prompt: Column, prefix: str, order: str = "topic") -> DataFrame:
    """n requests for long texts over the topics, which are gone through again if there are fewer, the generators taken in turn."""
    places = topics.sparkSession.range(n).withColumnRenamed("id", "j")
    numbered = corpus.batches(topics, 1, [F.md5(F.col(order).cast("binary")), order])
    total = numbered.count()
    placed = places.withColumn("batch", F.pmod("j", F.lit(max(1, total)))).join(F.broadcast(numbered), "batch")  # topics are titles
    generator = F.element_at(F.array(*[F.lit(g) for g in generators]), (F.col("j") % len(generators) + 1).cast("int"))
    return placed.select(F.concat(F.lit(prefix), F.lpad(F.col("j").cast("string"), 3, "0")).alias("id"), *[c for c in topics.columns], generator.alias("generator"), prompt.alias("prompt"))


def prompts_of(requests: DataFrame, generator: str) -> DataFrame:
    """(lang, id, prompt) of one generator's requests, to be written by language."""
    return requests.where(F.col("generator") == generator).select("lang", "id", "prompt")


def read_parts(spark: SparkSession, lines: str, parts: str) -> DataFrame:
    """(id, text) of a file of JSON lines and of files that hold an array each. What is no JSON is left out, a broken array as a whole."""
    found = []
    for path, array in ((lines, False), (parts, True)):
        try:
            raw = spark.read.text(path, wholetext=array)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        row = "id string, text string"
        parsed = F.from_json("value", "array<struct<id:string,text:string>>", {"mode": "PERMISSIVE"}) if array else F.array(F.from_json("value", row))
        whole = F.expr("try_parse_json(value)").isNotNull()
        found.append(raw.where(whole).select(F.explode(parsed).alias("r")).select("r.*"))
    out = found[0] if found else spark.createDataFrame([], "id string, text string")
    return out.unionByName(found[1]) if len(found) > 1 else out


def ingest(answers: DataFrame, requests: DataFrame, done: DataFrame, generator: str, model: str) -> DataFrame:
    """Answers to known requests that are not in yet and have a text, tidied and filed by the length at which they came out. Of answers to one request one counts."""
    fresh = answers.where("text is not null and text <> ''").dropDuplicates(["id"]).join(done.select("id"), "id", "left_anti")
    rows = fresh.join(requests.select("id", "lang", "genre", "topic"), "id").withColumn("text", cleaning.tidy(F.col("text"))).withColumn("words", tokens.word_count(F.col("text")))
    return rows.select("id", F.lit("ai").alias("kind"), "lang", "genre", tokens.corpus_bucket(F.col("words")).alias("bucket"), "words", F.lit(generator).alias("generator"), F.lit(model).alias("model"), "topic", "text")


def rewrites(done: DataFrame, originals: DataFrame, key: str = "source") -> DataFrame:
    """Rewrites beside their originals, by id or by the column that names it; those without an original are dropped."""
    source = originals.select(F.col("id").alias(key), F.col("text").alias("original"))
    return done.join(source, key)


def installed(known: DataFrame, local: DataFrame, name: str = "name") -> DataFrame:
    """known with installed: whether local has a name with the same part before the colon."""
    stem = F.split_part(F.col(name), F.lit(":"), F.lit(1))
    there = local.select(stem.alias("_stem")).distinct().withColumn("installed", F.lit(True))
    return known.withColumn("_stem", stem).join(there, "_stem", "left").withColumn("installed", F.coalesce("installed", F.lit(False))).drop("_stem")


def pinned(files: DataFrame, pins: DataFrame) -> DataFrame:
    """files (path, content) with their SHA-256 and whether it is the one that pins (path, sha256) names."""
    return files.select("path", F.sha2("content", 256).alias("found")).join(pins, "path", "left").withColumn("intact", F.col("found").eqNullSafe(F.col("sha256")))
