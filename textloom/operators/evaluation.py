"""Evaluating a scorer: AUROC with ties, thresholds, rates, intervals, bootstrap, splits, agreement."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.functions import cleaning, statistics, tokens
from textloom.operators import ranks
from textloom.sources.shared import stored

FPR_BOUND, LEAST_AUROC, LEAST_TPR, LEAST_CLASS = 0.02, 0.85, 0.5, 5
#: Humans of a cell whose scores a calibration ships.
CALIBRATION_HUMANS = 100


def auroc(scores: DataFrame, keys: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """Mann-Whitney with average ranks, per group of keys; null if a class is empty. Equal scores are summed first, so a
    score shared by a third of all rows is one row, and the running sum cuts large groups into ranges."""
    return auroc_of_counts(score_counts(scores, keys, score, positive), keys, score)


def score_counts(scores: DataFrame, keys: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """(keys, score, p, q): how many of each class have a score."""
    return scores.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))


def auroc_of_counts(counts: DataFrame, keys: list[str], score: str = "score", sums: tuple[str, ...] = ()) -> DataFrame:
    """auroc() of counts by score (keys, score, p, q), a row each; with the groups' totals of other columns."""
    wins = ranks.sum_below(counts, keys, score, "q").withColumn("wins", F.col("p") * (F.col("below") + F.col("q") / 2.0))
    total = wins.groupBy(*keys).agg(F.sum("wins").alias("wins"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), *[F.sum(c).alias(c) for c in sums])
    return total.select(*keys, "n_pos", "n_neg", F.try_divide(F.col("wins"), F.col("n_pos") * F.col("n_neg")).alias("auroc"), *sums)


def seeded(seed: str, id_col: str) -> Column:
    """The digest by whose order rows are taken at random, the same in any engine."""
    return F.md5(F.concat(F.lit(seed + "-"), F.col(id_col).cast("string")).cast("binary"))


def split_half(rows: DataFrame, strata: list[str], id_col: str, most: int | None = None, seed: str = "0", capped: Column | None = None, test_only: Column | None = None) -> DataFrame:
    """rows with part calib or test: of each stratum half, in the order of a digest of seed and id; where `capped` holds (everywhere, if it is
    not given) `most` rows at most. Rows of which test_only holds are all test and count for no stratum."""
    apart = F.coalesce(test_only, F.lit(False)) if test_only is not None else F.lit(False)
    rows = rows.withColumn("_apart", apart)
    ranked = ranks.numbered(rows, [*strata, "_apart"], seeded(seed, id_col), [id_col], "_rn").withColumn("_stratum", ranks.group_key(strata))
    sizes = ranked.where("not _apart").groupBy(F.col("_stratum").alias("_of")).agg(F.count("*").alias("_size"))
    found = ranked.join(sizes, F.col("_stratum") == F.col("_of"), "left")
    half = F.floor(F.col("_size") / 2)
    if most is not None:
        half = F.when(capped if capped is not None else F.lit(True), F.least(half, F.lit(most))).otherwise(half)
    return found.withColumn("part", F.when(~F.col("_apart") & (F.col("_rn") <= half), "calib").otherwise("test")).drop("_apart", "_rn", "_of", "_size", "_stratum")


def thresholds(rows: DataFrame, keys: list[str], q: float = 0.99, score: str = "score") -> DataFrame:
    """Linear-interpolated quantile of the negatives' scores."""
    return ranks.quantile(rows.where(~F.col("positive")), keys, score, q, "threshold")


def rates(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Strictly over the row's threshold: counts, rates, their intervals."""
    over = F.col(score) > F.col("threshold")
    out = rows.groupBy(*keys).agg(
        F.sum((F.col("positive") & over).cast("long")).alias("tp"), F.sum((~F.col("positive") & over).cast("long")).alias("fp"),
        F.sum(F.col("positive").cast("long")).alias("n_pos"), F.sum((~F.col("positive")).cast("long")).alias("n_neg"),
    )
    return out.select("*", *[v.alias(c) for c, v in rates_of(*[F.col(c) for c in ("tp", "fp", "n_pos", "n_neg")]).items()])


def rates_of(tp: Column, fp: Column, n_pos: Column, n_neg: Column) -> dict[str, Column]:
    low, high = statistics.wilson(tp, n_pos)
    return {"tpr": F.try_divide(tp, n_pos), "fpr": F.try_divide(fp, n_neg), "tpr_low": low, "tpr_high": high, "fpr_upper": statistics.clopper_pearson_upper(fp, n_neg)}


def gate(auroc_low: Column, tpr: Column, fpr_upper: Column) -> tuple[Column, Column]:
    """(allowed, why): the first rule that fails decides."""
    why = (
        F.when(auroc_low.isNull() | tpr.isNull() | fpr_upper.isNull(), "not enough measured texts")
        .when(auroc_low < LEAST_AUROC, "AUROC lower bound under 0.85")
        .when(tpr < LEAST_TPR, "the threshold catches under half of the positives")
        .when(fpr_upper > FPR_BOUND, "the false-positive rate could be over 2%")
        .otherwise("allowed")
    )
    return why == "allowed", why


def bootstrap(scores: DataFrame, keys: list[str], replicates: int, id_col: str = "id") -> DataFrame:
    """(keys, rep, auroc): AUROC of resampled rows, replicates from 0 on.

    It is the histogram of scores that is resampled: in each replicate a score of n rows of a class comes as often as a Poisson number of mean n, drawn from the digest
    of key, class and the smallest id among these rows, so that any engine draws the same. Each task turns the scores it holds, in order, into arrays of running counts over all
    replicates, and gives three numbers a group and replicate; what moves is the distinct scores, and these."""
    name = lambda c: F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(c), F.min(F.when(F.col("positive") == (c == "1"), F.col(id_col))).cast("string"))
    seed = lambda c: F.conv(F.substring(F.md5(name(c).cast("binary")), 1, 8), 16, 10).cast("long")
    counts = scores.groupBy(*keys, "score").agg(F.count_if(F.col("positive")).alias("p"), F.count_if(~F.col("positive")).alias("q"), seed("1").alias("p_seed"), seed("0").alias("q_seed"))
    counts = stored(counts.withColumn("_key", ranks.group_key(keys)), "bootstrap-scores")
    dealt = counts.repartitionByRange("_key", "score").sortWithinPartitions("_key", "score")
    lists = T.ArrayType(T.LongType())
    schema = T.StructType([counts.schema["_key"], *[counts.schema[k] for k in keys], T.StructField("part", T.IntegerType()), *[T.StructField(c, lists) for c in ("p", "q", "wins")]])

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, draw = TaskContext.get().partitionId(), poisson_draws(replicates)
        key, first, p, q, wins = None, None, None, None, None

        def done():
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a))
            return pa.RecordBatch.from_arrays([*first, pa.array([part], pa.int32()), one(p), one(q), one(wins)], names=schema.names)

        for batch in batches:
            names, numbers = batch.column("_key").to_pylist(), [batch.column(c).to_pylist() for c in ("p", "q", "p_seed", "q_seed")]
            for i, (now, n_p, n_q, seed_p, seed_q) in enumerate(zip(names, *numbers)):
                if now != key:
                    if key is not None:
                        yield done()
                    key, first = now, [batch.column(c).slice(i, 1) for c in ("_key", *keys)]
                    p, q, wins = (np.zeros(replicates, np.int64) for _ in range(3))
                drawn_p, drawn_q = draw(n_p, seed_p), draw(n_q, seed_q)
                wins += drawn_p * (2 * q + drawn_q)  # twice the pairs won, a tie being half a win
                p, q = p + drawn_p, q + drawn_q
        if key is not None:
            yield done()

    parts = dealt.mapInArrow(resample, schema)
    each = parts.select("_key", *keys, "part", F.posexplode(F.arrays_zip("p", "q", "wins")).alias("rep", "r"))
    lower = F.coalesce(F.sum("r.q").over(Window.partitionBy("_key", "rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = each.select("_key", *keys, "rep", "r.p", "r.q", (F.col("r.wins") + 2 * F.col("r.p") * lower).alias("wins"))
    total = won.groupBy("_key", "rep").agg(*[F.first(k).alias(k) for k in keys], F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum("wins").alias("wins"))
    return total.select(*keys, "rep", F.try_divide(F.col("wins") / 2.0, F.col("p") * F.col("q")).alias("auroc"))


def poisson_draws(replicates: int):
    """draw(n, seed): that many Poisson numbers of mean n, from a hash of seed and replicate."""
    import numpy as np

    known: dict[int, tuple[int, object]] = {}
    steps = np.arange(replicates, dtype=np.uint64) * np.uint64(0x9E3779B9)

    def below(n: int):
        """(least, P(X <= k) for k from least on): as far as 12 deviations."""
        if n not in known:
            reach = 12 * math.isqrt(n) + 20
            least = max(0, n - reach)
            k = np.arange(least, n + reach + 1)
            log = -n + least * math.log(n) - math.lgamma(least + 1) + np.concatenate([[0.0], np.cumsum(np.log(n / k[1:]))])
            known[n] = least, np.cumsum(np.exp(log))
        return known[n]

    def draw(n: int, seed: int | None):
        if not n:
            return np.zeros(replicates, np.int64)
        h = (steps + np.uint64(seed)) & np.uint64(0xFFFFFFFF)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
        h ^= h >> np.uint64(16)
        least, cdf = below(n)
        return least + np.searchsorted(cdf, h / 2.0**32, side="right")

    return draw


def interval(replicates: DataFrame, keys: list[str]) -> DataFrame:
    """The 2.5 and 97.5 per cent order statistics."""
    ordered = replicates.where("auroc is not null").groupBy(*keys).agg(F.sort_array(F.collect_list("auroc")).alias("a"))
    n = F.size("a")
    at = lambda k: F.get("a", F.greatest(k.cast("int"), F.lit(0)))
    return ordered.select(*keys, at(F.floor(n * 0.025)).alias("auroc_low"), at(F.floor(n * 0.975) - 1).alias("auroc_high"))


def families(rows: DataFrame, generators: list[str]) -> DataFrame:
    """rows (kind: human, ai or rewritten, lang, bucket, generator, genre) once for each group in which they are evaluated, with family, of and by_threshold. Humans
    of a length stand against each of the generators, and against the rewritten texts; languages leave out short texts and have no threshold."""
    human, machine, rewritten = (F.col("kind") == k for k in ("human", "ai", "rewritten"))
    plain = human | machine
    one = lambda name, of, when, limit=True: F.when(when & of.isNotNull(), F.array(F.struct(F.lit(name).alias("family"), of.alias("of"), F.lit(limit).alias("by_threshold"))))
    at = lambda c: F.concat(c, F.lit("/"), F.col("bucket"))
    against = F.when(human & F.col("bucket").isNotNull(), F.transform(F.array(*[F.lit(g) for g in generators]), lambda g: F.struct(F.lit("generator").alias("family"), at(g).alias("of"), F.lit(True).alias("by_threshold"))))
    groups = [
        one("cell", at(F.col("lang")), plain), one("bucket", F.col("bucket"), plain), one("language", F.col("lang"), plain & (F.col("bucket") != "short"), False),
        against, one("generator", at(F.col("generator")), machine), one("genre", at(F.col("genre")), plain), one("rewritten", F.col("bucket"), human | rewritten),
    ]
    none = F.array().cast("array<struct<family:string,of:string,by_threshold:boolean>>")
    return rows.select("*", F.explode(F.concat(*[F.coalesce(g, none) for g in groups])).alias("_g")).select(*rows.columns, "_g.*")


def block(rows: DataFrame, keys: list[str], n: str | None = None) -> DataFrame:
    """Per group: counts and, from five texts of each class on, AUROC and, where rows have a threshold, rates with their intervals. n: a column that says for how many texts a row stands."""
    many = F.col(n) if n else F.lit(1)
    of = lambda when: F.sum(F.when(when, many).otherwise(0))
    over, known = F.col("score") > F.col("threshold"), F.col("threshold").isNotNull()
    sums = {"p": F.col("positive"), "q": ~F.col("positive"), "tp": F.col("positive") & over, "fp": ~F.col("positive") & over, "k_pos": F.col("positive") & known, "k_neg": ~F.col("positive") & known}
    counts = rows.groupBy(*keys, "score").agg(*[of(when).alias(c) for c, when in sums.items()])
    out = auroc_of_counts(counts, keys, sums=("tp", "fp", "k_pos", "k_neg"))
    enough, some = (F.col("n_pos") >= LEAST_CLASS) & (F.col("n_neg") >= LEAST_CLASS), F.col("k_pos") + F.col("k_neg") > 0
    shown = {"auroc": F.col("auroc")} | {c: F.when(some, v) for c, v in ({"tp": F.col("tp"), "fp": F.col("fp")} | rates_of(F.col("tp"), F.col("fp"), F.col("k_pos"), F.col("k_neg"))).items()}
    return out.select(*keys, "n_pos", "n_neg", *[F.when(enough, v).alias(c) for c, v in shown.items()])


def choose(candidates: DataFrame, prefer: str, margin: float = 0.005) -> DataFrame:
    """The candidate (pair, name, value) of the best value, or the best of the preferred pair if it is within the margin."""
    best = Window.partitionBy(F.lit(1))
    near = candidates.where(F.col("value").isNotNull()).withColumn("near", (F.max("value").over(best) - F.col("value") <= margin) & (F.col("pair") == prefer))
    return near.orderBy(F.desc("near"), F.desc("value"), F.desc("pair"), F.desc("name")).limit(1).drop("near")


def agreement(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Kappa of two annotators' boolean columns a and b, per keys."""
    both = lambda x, y: F.sum((x & y).cast("long"))
    a, b = F.col("a"), F.col("b")
    counts = pairs.groupBy(*keys).agg(both(a, b).alias("both"), both(a, ~b).alias("only_a"), both(~a, b).alias("only_b"), both(~a, ~b).alias("neither"))
    return counts.withColumn("kappa", statistics.kappa(*[F.col(c) for c in ("both", "only_a", "only_b", "neither")]))


def precision_recall(pairs: DataFrame, keys: list[str], tool: str = "tool", ref: str = "ref") -> DataFrame:
    t, r = F.col(tool), F.col(ref)
    n = lambda c: F.sum(c.cast("long"))
    c = pairs.groupBy(*keys).agg(n(t & r).alias("tp"), n(t & ~r).alias("fp"), n(~t & r).alias("fn"))
    return c.select("*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))


def majority(a: Column, b: Column, settled: Column) -> Column:
    return F.when(a == b, a).otherwise(settled)


def outside_share(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Share of pairs that both annotators changed otherwise (other_a, other_b) and that have no change of a kind (ref), with its interval."""
    outside = F.col("other_a") & F.col("other_b") & ~F.col("ref")
    counts = pairs.groupBy(*keys).agg(F.count_if(outside).alias("outside"), F.count("*").alias("n"))
    low, high = statistics.wilson(F.col("outside"), F.col("n"))
    return counts.select("*", F.try_divide("outside", "n").alias("share"), low.alias("low"), high.alias("high"))


def mean_of_cells(cells: DataFrame, expected: int, value: str = "auroc") -> DataFrame:
    """The mean over exactly the expected number of cells with a value, else NaN."""
    return cells.agg(F.when(F.count(value) == expected, F.avg(value)).otherwise(F.lit(float("nan"))).alias("mean"))


def changed_kinds(numbers: Column, names: Column, negation_flip: Column, quantifiers: Column) -> dict[str, Column]:
    """Which kinds an annotation says changed. numbers and names: struct<missing, added> of arrays; a quantifier listed as (same) is none."""
    some = lambda s: F.size(F.coalesce(s["missing"], F.array())) + F.size(F.coalesce(s["added"], F.array())) > 0
    real = F.exists(quantifiers, lambda q: ~F.lower(q).contains("(same)"))
    return {"numbers": some(numbers), "names": some(names), "negation": F.coalesce(negation_flip, F.lit(False)), "quantifiers": F.coalesce(real, F.lit(False))}


def disputes(pairs: DataFrame, settled: DataFrame, key: str = "id") -> DataFrame:
    """pairs (key, kind, a, b) on which the annotators differ and that settled (key) does not decide. References need this to be empty."""
    return pairs.where(F.col("a") != F.col("b")).join(settled.select(key), key, "left_anti")


def paragraph_pairs(rows: DataFrame, before: str, after: str, least_words: int = 30) -> DataFrame:
    """rows by paragraph (paragraph, original, rewrite), of texts with equally many paragraphs, if the original has least_words words."""
    both = rows.withColumns({"_b": cleaning.paragraphs(F.col(before)), "_a": cleaning.paragraphs(F.col(after))}).where(F.size("_b") == F.size("_a"))
    each = both.select(*rows.columns, F.posexplode(F.arrays_zip(F.col("_b").alias("original"), F.col("_a").alias("rewrite"))).alias("paragraph", "_p"))
    return each.select(*rows.columns, "paragraph", "_p.original", "_p.rewrite").where(tokens.word_count(F.col("original")) >= least_words)


def calibration_export(humans: DataFrame, limits: DataFrame, cells: DataFrame, id_col: str = "id", most: int = CALIBRATION_HUMANS, seed: str = "c") -> DataFrame:
    """One row that assessments ship with: buckets and cells as maps. humans (bucket, score, and cell and id if they have one), limits (bucket, threshold), cells (cell, allowed, why, ...), a row each.

    At most `most` humans of a cell are shipped, the first by a digest of seed and id, so the row is as large as there are cells, whatever the corpus; a threshold is that of all of them.
    allowed and why are the gate's, as given."""
    by = id_col if id_col in humans.columns else "score"
    order = Window.partitionBy("bucket", *[c for c in ("cell",) if c in humans.columns]).orderBy(seeded(seed, by), by)
    shipped = humans.where("score is not null").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most)  # tasks keep `most` a cell before they shuffle
    tails = shipped.groupBy("bucket").agg(F.array_sort(F.collect_list("score")).alias("human_scores"))
    entry = limits.join(tails, "bucket", "left").select("bucket", F.struct("threshold", F.coalesce("human_scores", F.array().cast("array<double>")).alias("human_scores")).alias("entry"))
    buckets = entry.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "entry")))).alias("buckets"))
    rest = F.struct(*[c for c in cells.columns if c != "cell"])
    return buckets.join(cells.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cell", rest.alias("entry"))))).alias("cells")), F.lit(True), "inner")  # one row each


def publish(export: DataFrame, path: str, verdicts_before: int, dry_run: bool = False) -> bool:
    """Writes export if it allows more cells than the calibration before it; says whether it did."""
    verdicts = export.select(F.size(F.filter(F.map_values("cells"), lambda c: c["allowed"]))).first()[0]
    if verdicts > verdicts_before and not dry_run:
        export.write.mode("overwrite").json(path)
        return True
    return False
