"""python -m textloom.cli COMMAND ...; paths are any that Spark reads.

    check FILE                                   invisible and exotic characters by name
    diff A B [--lang L] [--json]                 facts that differ
    run FILE [--transform T] [--rules a,b] [--lang L] [-o OUT]
    transforms [--json]                          what can be run, and which files of the folder failed
    rules                                        the wording rules and their languages
    detect FILE --calibration TABLES --features TABLE [--lang L] [--watermark] [--watermark-keys K,K] [--watermark-ngram N] [--watermark-ids TABLE] [--json]
    detect FILE --watermark-only --watermark-keys K [...]  the text mark alone, by each key or by stored ids and g-values
    mark FILE --key K                            the text mark's score
    bench SAMPLES --transforms a,b --out OUT [--plain FILE] [--sweep infill:2,3] [--limit N] [--lang L] [--threshold Z] [--timed] [--force] [--no-cache] and the options of transforms
    score FEATURES --detectors a,b --out OUT [--no-resume]     detectors' scores of rows of features, with error rows
    evaluate SCORES --out OUT [--generators g,h] [--publish FILE] [--replicates N]     families of groups, gates and the calibration
    corpus {requests,ingest,status,manifest} ... building corpora
    facts-eval {sample,disagree,score} ...       annotated pairs

An answer is 0, a question that has none 2, a failure one line and 1.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import cleaning, facts, lexicon, marks, registry, rewriting, tokens
from textloom.operators import assess, bench, corpus, evaluation, runs
from textloom.sources import files, reports, requests
from textloom.sources.files import read_text
from textloom.sources.shared import stored

FOLDER = "TEXTLOOM_TRANSFORMS"


def language(text, hint: str | None):
    """The guess if it holds three of five votes, else the hint."""
    guess, share = tokens.best_vote(tokens.language_votes(text))
    return F.when(share >= 0.6, guess).otherwise(F.lit(hint).cast("string"))


def check(texts: DataFrame) -> DataFrame:
    """(path, name, n): invisible and exotic characters by name."""
    found = texts.select("path", F.explode(cleaning.targets(F.col("text"))).alias("ch"))
    return found.groupBy("path", cleaning.character_name(F.col("ch")).alias("name")).agg(F.count("*").alias("n")).orderBy("path", F.desc("n"), "name")


def diff(before: DataFrame, after: DataFrame, hint: str | None) -> DataFrame:
    """Of two texts: each side must be one file."""
    for side in (before, after):
        if side.limit(2).count() != 1:
            raise ValueError("diff takes one file on each side")
    pair = before.select(F.col("text").alias("before"), F.lit(1).alias("_k")).join(after.select("text", F.lit(1).alias("_k")), "_k").drop("_k")
    return facts.diff(pair.withColumn("lang", language(F.col("before"), hint)), "before", "text", F.col("lang"))


def shown(rows: DataFrame) -> None:
    for r in rows.toJSON().toLocalIterator():
        print(r)


def add_commands(sub) -> None:
    def command(name: str, *arguments: tuple, **defaults):
        p = sub.add_parser(name)
        for names, options in arguments:
            p.add_argument(*names.split(), **options)
        p.set_defaults(**defaults)

    flag = {"action": "store_true"}
    lang = ("--lang", {"choices": lexicon.LANGUAGES})
    command("check", ("file", {}), do=do_check)
    command("rules", do=do_rules)
    command("transforms", ("--json", flag), do=do_transforms)
    command("diff", ("before", {}), ("after", {}), lang, ("--json", flag), do=do_diff)
    command("run", ("file", {}), ("--transform", {"default": "rules"}), ("--rules", {"default": ""}), ("--lang", {"default": "en"}), ("-o --out", {}), do=do_run)
    command("mark", ("file", {}), ("--key", {"required": True}), do=do_mark)
    command(
        "detect", ("file", {}), ("--calibration", {}), ("--features", {}), lang, ("--watermark", flag), ("--watermark-only", flag), ("--watermark-keys", {"default": ""}), ("--watermark-ngram", {"type": int, "default": marks.NGRAM}),
        ("--watermark-ids", {}), ("--json", flag), do=do_detect,
    )
    command("score", ("features", {}), ("--detectors", {"default": ",".join(registry.DETECTORS)}), ("--out", {"required": True}), ("--no-resume", flag), do=do_score)
    command("evaluate", ("scores", {}), ("--out", {"required": True}), ("--generators", {"default": ""}), ("--quantile", {"type": float, "default": 0.99}), ("--replicates", {"type": int, "default": 2000}), ("--publish", {}), ("--dry-run", flag), do=do_evaluate)
    command(
        "bench", ("samples", {}), ("--transforms", {"default": "none,unicode,rules"}), ("--out", {"required": True}), ("--limit", {"type": int}), ("--lang", {}), ("--threshold", {"type": float, "default": 4.0}),
        ("--key", {"default": "key"}), ("--no-cache", flag), ("--plain", {}), ("--sweep", {"default": ""}), ("--timed", flag), ("--force", flag), ("--model", {}), ("--temperature", {"type": float}), ("--seed", {"type": int}),
        ("--stride", {"type": int}), ("--span", {"type": int}), ("--ngram-len", {"type": int, "default": 5}), ("--rules", {"default": ""}), ("--language", {"default": "en"}), ("--tokenaware", {}), ("--min-coverage", {"type": float}),
        ("--max-passes", {"type": int}), do=do_bench,
    )
    command("corpus", ("what", {"choices": ("requests", "ingest", "status", "manifest")}), ("--requests", {}), ("--answers", {}), ("--parts", {}), ("--done", {}), ("--generator", {}), ("--model", {}), ("--rows", {}), ("--out", {}), do=do_corpus)
    command("facts-eval", ("what", {"choices": ("sample", "disagree", "score")}), ("--pairs", {}), ("--settled", {}), ("--per", {"type": int, "default": 30}), ("--out", {}), do=do_facts_eval)


def do_check(spark, args) -> int:
    for r in check(read_text(spark, args.file)).toLocalIterator():
        print(f"{r['n']}\t{r['name']}")
    return 0


def do_rules(spark, args) -> int:
    print("\n".join(f"{name}\t{','.join(langs)}" for name, _, langs in rewriting.RULES))
    return 0


def do_transforms(spark, args) -> int:
    known = registry.transforms
    print(json.dumps({"v": 1, "transforms": known.names(), "failed": known.failed}) if args.json else "\n".join([*known.names(), *(f"{n}: {why}" for n, why in known.failed.items())]))
    return 0


def do_diff(spark, args) -> int:
    found = diff(read_text(spark, args.before), read_text(spark, args.after), args.lang)
    r = found.select("*", facts.sentences(found).alias("said"), F.to_json(F.struct(*[c for c in found.columns if c not in ("before", "text")])).alias("json")).first()
    if r["said"] is None:
        print("The language is not known; name it with --lang.", file=sys.stderr)
        return 2
    print(r["json"] if args.json else "\n".join(r["said"]))
    return 0


def do_run(spark, args) -> int:
    options = registry.Options(rules=tuple(x for x in args.rules.split(",") if x), language=args.lang)
    done = read_text(spark, args.file).select(registry.transforms.get(args.transform)(F.col("text"), options)["text"].alias("value"))
    if args.out:
        done.write.mode("overwrite").text(args.out)
    else:
        for r in done.toLocalIterator():
            sys.stdout.write(r["value"])
    return 0


def do_mark(spark, args) -> int:
    shown(read_text(spark, args.file).select("path", marks.mark_score(F.col("text"), args.key).alias("score")))
    return 0


def mark_rows(texts: DataFrame, args) -> DataFrame:
    """(path, key, score, marked): the mark of each text by each key, or by the stored ids and g-values of --watermark-ids (path, ids, g)."""
    if args.watermark_ids:
        stored = texts.sparkSession.read.parquet(args.watermark_ids).select("path", "ids", "g")
        found = texts.select("path").join(stored, "path").select("path", F.lit(None).cast("string").alias("key"), marks.mark_score_of_ids(F.col("ids"), F.col("g"), args.watermark_ngram).alias("score"))
    else:
        keys = [k for k in args.watermark_keys.split(",") if k]
        if not keys:
            raise ValueError("the mark needs --watermark-keys or --watermark-ids")
        parts = [texts.select("path", F.lit(k).alias("key"), marks.mark_score(F.col("text"), k, args.watermark_ngram).alias("score")) for k in keys]
        found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("marked", bench.marked(F.col("score.scored"), F.col("score.z")))


def do_detect(spark, args) -> int:
    """--calibration: a folder of the tables calibration, cells and learners; --features: (path, score) of the chosen detector, higher being more machine-like."""
    texts = read_text(spark, args.file)
    if not args.watermark_only:
        if not (args.calibration and args.features):
            raise ValueError("detect needs --calibration and --features, or --watermark-only")
        table = lambda name: spark.read.parquet(f"{args.calibration}/{name}")
        t = texts.withColumn("language", F.lit(args.lang) if args.lang else language(F.col("text"), None)).withColumn("words", tokens.word_count(F.col("text"))).withColumn("sentences", F.size(tokens.sentences(F.col("text"))))
        found = assess.with_cells(assess.assess(t.join(spark.read.parquet(args.features), "path"), table("calibration")), table("cells"), table("learners"))
        if args.json:
            shown(found.drop("text"))
        else:
            for r in found.select(F.explode(assess.spoken(found)).alias("line")).toLocalIterator():
                print(r["line"])
    if args.watermark or args.watermark_only:
        found = mark_rows(texts, args)
        if args.json:
            shown(found)
        else:
            for r in found.toLocalIterator():
                print(f"Mark{f' by {r['key']}' if r['key'] else ''}: z {r['score']['z']:.2f} over {r['score']['scored']} positions, {'marked' if r['marked'] else 'no mark found'}.")
    return 0


FEATURES = "id string, nll_obs double, nll_perf double, binoculars double, fdg_oo double, fdg_po double, burstiness double, error string"


def do_score(spark, args) -> int:
    """FEATURES: JSON lines (id, features, error). OUT gets (id, detector, score, error); what it has without an error is kept."""
    features = files.read_jsonl(spark, args.features, FEATURES)
    named = [d for d in args.detectors.split(",") if d]
    each = F.array(*[F.struct(F.lit(d).alias("detector"), registry.detectors.get(d)({f: F.col(f) for f in features.columns}).alias("score")) for d in named])
    rows = features.select("id", "error", F.explode(each).alias("s")).select("id", "s.detector", F.when(F.col("error").isNull(), F.col("s.score")).alias("score"), F.coalesce("error", F.when(F.col("s.score").isNull(), F.lit("ValueError: no feature"))).alias("error"))
    if not args.no_resume:
        done = files.read_jsonl(spark, args.out, "id string, detector string, score double, error string").where("error is null")
        rows = rows.join(done.select("id", "detector"), ["id", "detector"], "left_anti")
    files.append_jsonl(rows, args.out)
    total = rows.groupBy("detector").agg(F.count("*").alias("scored"), F.count("error").alias("errors")).orderBy("detector")
    shown(total)
    return 0


def do_evaluate(spark, args) -> int:
    """SCORES: JSON lines (id, kind: human, ai or rewritten, lang, bucket, generator, genre, score), higher being more machine-like. OUT gets blocks, gates and tables; --publish the calibration if it allows more cells."""
    rows = files.read_jsonl(spark, args.scores, "id string, kind string, lang string, bucket string, generator string, genre string, score double")
    rows = stored(rows.where("score is not null").withColumn("positive", F.col("kind") != "human"), "scores")
    split = evaluation.split_half(rows, ["lang", "bucket", "kind"], "id")
    humans = split.where("part = 'calib' and not positive and bucket is not null")
    limits = evaluation.thresholds(humans, ["bucket"], args.quantile)
    tested = split.where("part = 'test'").join(F.broadcast(limits), "bucket", "left")  # a row a bucket
    generators = [g for g in args.generators.split(",") if g] or sorted(r[0] for r in rows.where("kind = 'ai' and generator is not null").select("generator").distinct().toLocalIterator())
    grouped = evaluation.families(tested, generators)
    blocks = stored(evaluation.block(grouped.withColumn("threshold", F.when(F.col("by_threshold"), F.col("threshold"))), ["family", "of"]), "blocks")
    plain = tested.where("kind in ('human', 'ai') and bucket is not null")
    low = evaluation.interval(evaluation.bootstrap(plain, ["lang", "bucket"], args.replicates), ["lang", "bucket"])
    rates = evaluation.rates(plain.where("threshold is not null"), ["lang", "bucket"]).join(low, ["lang", "bucket"], "left")
    allowed, why = evaluation.gate(F.col("auroc_low"), F.col("tpr"), F.col("fpr_upper"))
    gates = stored(rates.select(F.concat_ws("/", "lang", "bucket").alias("cell"), allowed.alias("allowed"), why.alias("why"), "auroc_low", "tpr", "fpr", "fpr_upper", F.col("n_neg").alias("n_human")), "gates")
    for name, table in (("blocks", blocks), ("gates", gates)):
        table.coalesce(1).write.mode("overwrite").json(f"{args.out}/{name}")  # a row a group
    lines = reports.cell_table(blocks) + [""] + [x for family in ("rewritten", "generator", "genre") for x in (*reports.side_table(blocks, family), "")]
    print("\n".join(lines))
    if args.publish:
        export = evaluation.calibration_export(humans.withColumnRenamed("lang", "cell"), limits, gates)
        try:
            before = spark.read.json(args.publish).select(F.size(F.filter(F.map_values(F.from_json(F.to_json("cells"), "map<string,struct<allowed:boolean>>")), lambda c: c["allowed"]))).first()[0]
        except PySparkException:
            before = 0
        print("published" if evaluation.publish(export, args.publish, before, args.dry_run) else f"not published: it allows no more cells than the {before} of before")
    return 0


def do_bench(spark, args) -> int:
    """SAMPLES: JSON lines (id, text, lang, watermarked); --plain: unmarked ones in a file of their own. --sweep infill:2,3 asks for infill@2 and infill@3. OUT gets rows, summary and cache; one that has rows of
    another run already is not written over without --force."""
    schema = "id string, text string, lang string, watermarked boolean"
    rows = files.read_jsonl(spark, args.samples, schema)
    if args.plain:
        rows = rows.where("watermarked").unionByName(files.read_jsonl(spark, args.plain, schema).withColumn("watermarked", F.lit(False)))
    swept = [f"{name}@{stride}" for part in args.sweep.split(";") if part for name, _, strides in [part.partition(":")] for stride in strides.split(",") if stride]
    given = {n: getattr(args, n) for n in registry.Options.__dataclass_fields__ if n != "rules"}
    options = registry.Options(**given, rules=tuple(x for x in args.rules.split(",") if x))
    rows = rows.where(F.col("lang") == args.lang) if args.lang else rows
    if args.limit:
        rows = corpus.first_per_group(rows, ["watermarked"], args.limit, ["id"]).drop("rn")
    todo, unknown = runs.asked(rows.where("watermarked"), ",".join([args.transforms, *swept]), registry.transforms)
    for label in unknown:
        print(f"{label} is not known and is skipped", file=sys.stderr)
    empty = spark.createDataFrame([], f"transform string, id string, digest string, text_sha1 string, entry {runs.ENTRY}")
    cache = f"{args.out}/cache"
    try:
        held = empty if args.no_cache else spark.read.schema(empty.schema).parquet(cache)
    except PySparkException:
        held = empty
    settings = json.dumps({"samples": args.samples, "plain": args.plain, "transforms": args.transforms, "sweep": args.sweep, "limit": args.limit, "lang": args.lang, "options": asdict(options)}, sort_keys=True, default=list)
    try:
        was = spark.read.text(f"{args.out}/settings").first()
    except PySparkException:
        was = None
    if was and was[0] != settings and not args.force:
        raise ValueError(f"{args.out} holds a run with other settings; --force writes over it")
    spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.out}/settings")
    results = (runs.timed if args.timed else runs.run)(todo, registry.transforms, held, options)
    plain = runs.controls(rows.where("not watermarked")).withColumns({"digest": F.lit(None).cast("string"), "text_sha1": F.lit(None).cast("string")})
    none = {c: F.lit(None).cast("double") for c in ("prompt_tokens", "completion_tokens")}
    runs.measured(results.unionByName(plain), args.key).withColumns(none).write.mode("overwrite").json(f"{args.out}/rows")
    if not args.no_cache:
        runs.append_cache(results, cache)
    measured = spark.read.json(f"{args.out}/rows")
    for c, kind in {**{m: "double" for m in runs.MEANS}, "prompt_tokens": "double", "completion_tokens": "double", "zw_after": "double", "error": "string"}.items():
        measured = measured if c in measured.columns else measured.withColumn(c, F.lit(None).cast(kind))
    found = runs.summary(measured, threshold=args.threshold)
    found.coalesce(1).write.mode("overwrite").json(f"{args.out}/summary")
    print(files.markdown(found))
    return 0


def do_corpus(spark, args) -> int:
    asked = lambda: files.read_jsonl(spark, args.requests, "id string, lang string, genre string, topic string, prompt string, generator string")
    text_rows = "id string, kind string, lang string, genre string, bucket string, words long, generator string, model string, topic string, text string"
    if args.what == "requests":
        requests.prompts_of(asked(), args.generator).write.mode("overwrite").partitionBy("lang").json(args.out)
    elif args.what == "ingest":
        answers = requests.read_parts(spark, args.answers, args.parts)
        files.append_jsonl(requests.ingest(answers, asked(), files.read_jsonl(spark, args.done, text_rows), args.generator, args.model), args.out)
    elif args.what == "status":
        shown(files.read_jsonl(spark, args.rows, text_rows).groupBy("kind", "lang", "bucket", "genre", "generator").agg(F.count("*").alias("n")).orderBy("kind", "lang", "bucket", "genre", "generator"))
    else:
        files.write_manifest(files.read_jsonl(spark, args.rows, text_rows), args.out)
    return 0


def do_facts_eval(spark, args) -> int:
    """sample: --pairs (id, stratum, ...); disagree and score: --pairs (id, kind, a, b, tool) with --settled (id, kind, value)."""
    if args.what == "sample":
        picked = corpus.halves(spark.read.json(args.pairs), ["stratum"], args.per, "s", "id")
        picked.write.mode("overwrite").json(args.out)
        return 0
    pairs = files.read_jsonl(spark, args.pairs, "id string, kind string, a boolean, b boolean, tool boolean").withColumn("key", F.concat_ws("/", "id", "kind"))
    settled = files.read_jsonl(spark, args.settled, "id string, kind string, value boolean").withColumn("key", F.concat_ws("/", "id", "kind"))
    open_ = evaluation.disputes(pairs, settled, "key")
    if args.what == "disagree":
        shown(open_.drop("key").orderBy("id", "kind"))
        return 0
    if not open_.isEmpty():
        print("Some disputes are not settled; see disagree.", file=sys.stderr)
        return 2
    judged = pairs.join(settled.select("key", "value"), "key", "left").withColumn("ref", evaluation.majority(F.col("a"), F.col("b"), F.col("value")))
    shown(evaluation.precision_recall(judged, ["kind"]).join(evaluation.agreement(pairs, ["kind"]).select("kind", "kappa"), "kind").orderBy("kind"))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    add_commands(parser.add_subparsers(dest="command", required=True))
    args = parser.parse_args(argv)
    if folder := os.environ.get(FOLDER):
        registry.transforms.read_folder(folder, spark.sparkContext if spark else None)
    try:
        return args.do(spark or (None if args.do in (do_rules, do_transforms) else SparkSession.builder.getOrCreate()), args)
    except (PySparkException, KeyError, ValueError, OSError) as e:
        print(" ".join(str(e).split())[:300], file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
