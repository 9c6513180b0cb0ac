"""Building corpora: excerpts, quotas, assignments, samples, regrouping, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import cleaning
from textloom.functions.tokens import BUCKETS, letter_words, sentences
from textloom.operators import ranks


def hash_order(seed: str, id_col: str) -> list[Column]:
    return [F.md5(F.concat(F.lit(seed + "-"), F.col(id_col).cast("string"))), F.col(id_col)]


def cut(text: Column, target: Column, most: Column) -> Column:
    """struct<words, sentences, excerpt> of the first sentences that reach target words; null if they overshoot most or the text is too short."""
    bind = lambda value, fn: F.transform(F.array(value), fn)[0]  # noqa: E731  computes a value once that fn uses often
    state = F.struct(F.lit(0).alias("words"), F.lit(0).alias("sentences"))
    step = lambda acc, n: F.when(acc["words"] >= target, acc).otherwise(F.struct((acc["words"] + n).alias("words"), (acc["sentences"] + 1).alias("sentences")))

    def taken(found: Column) -> Column:
        got = F.aggregate(F.transform(found, lambda s: F.size(letter_words(s))), state, step)
        whole = lambda g: F.when((g["words"] >= target) & (g["words"] <= most), F.struct(g["words"].alias("words"), g["sentences"].alias("sentences"), F.array_join(F.slice(found, F.lit(1), g["sentences"]), " ").alias("excerpt")))
        return bind(got, whole)

    return bind(sentences(text), taken)


def first_per_group(rows: DataFrame, keys: list[str], n: int, order: list) -> DataFrame:
    """The first n of each group. Spark keeps n per task before it shuffles, so large groups don't meet whole."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def digest_of(seed: str, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "-"), F.col(id_col).cast("string")).cast("binary"))


def quota(rows: DataFrame, cells: list[str], genre: str, each: int, seed: str = "q", id_col: str = "doc_id") -> DataFrame:
    """Up to `each` of every cell and genre; what a genre lacks is made up by others of the cell, whose number of genres sets the total."""
    ranked = ranks.numbered(rows, [*cells, genre], digest_of(seed, id_col), [id_col], "rn")
    first, rest = ranked.where(F.col("rn") <= each), ranked.where(F.col("rn") > each)
    have = first.groupBy(*cells).agg((F.count_distinct(genre) * each - F.count("*")).alias("lacking"))
    # No more of a cell is wanted than it lacks, and Spark keeps each task's first of these only; the bound is the number of genres times `each`.
    open_ = rest.join(F.broadcast(have.where("lacking > 0")), cells)
    more = open_.withColumn("rm", F.row_number().over(Window.partitionBy(*cells).orderBy("rn", *hash_order(seed, id_col)))).where(F.col("rm") <= F.col("lacking"))
    return first.withColumn("pass", F.lit(1)).unionByName(more.drop("rm", "lacking").withColumn("pass", F.lit(2))).drop("rn")


def longest_open(rows: DataFrame, cell: str, genre: str, words: str, each: int, seed: str = "l", id_col: str = "doc_id") -> DataFrame:
    """rows that find a place, with bucket and pass. Taken in the order of a digest, a document goes to the longest bucket that it can fill and that is still open
    for its cell and genre. In a second pass what a genre lacks of a bucket is added to the room of the cell's other genres.

    A pass needs one order. Up to a document, those that have asked for a bucket are those that can fill no longer one, and what the next longer bucket
    had no room for; so running counts by longest bucket tell, row by row, where each document ends up."""
    names = [b for b, _, _ in reversed(BUCKETS)]
    longest = F.coalesce(*[F.when(F.col(words) >= low, F.lit(k)) for k, (_, low, _) in enumerate(reversed(BUCKETS))])
    rows = rows.withColumns({"_longest": longest, "_digest": digest_of(seed, id_col)})

    def counted(some: DataFrame) -> DataFrame:
        """some with _up_k: how many so far, itself included, have their longest bucket at k."""
        own = {f"_up_{k}": (F.col("_longest") == k).cast("long") for k in range(len(names))}
        found = ranks.running(some, [cell, genre], ["_digest", id_col], own)
        return found.withColumns({c: F.col(c) + F.coalesce(v, F.lit(0)) for c, v in own.items()})

    def asked(room: list[Column]) -> list[Column]:
        out = []
        for k in range(len(names)):
            over = F.greatest(out[k - 1] - room[k - 1], F.lit(0)) if k else F.lit(0)
            out.append(F.col(f"_up_{k}") + over)
        return out

    def deal(some: DataFrame, room: list[Column]) -> DataFrame:
        turns = [F.when((F.col("_longest") <= k) & (a <= r), name) for k, (name, a, r) in enumerate(zip(names, asked(room), room))]
        return some.withColumn("bucket", F.coalesce(*turns))

    all_open = [F.lit(each)] * len(names)
    first = counted(rows)
    lacking = lambda most: [F.greatest(each - a, F.lit(0)).alias(f"_lacks_{k}") for k, a in enumerate(most)]
    lacks = first.groupBy(cell, genre).agg(*[F.max(f"_up_{k}").alias(f"_up_{k}") for k in range(len(names))]).select(cell, genre, *lacking(asked(all_open)))
    whole = Window.partitionBy(cell)
    room = [F.when(F.col(f"_lacks_{k}") == 0, F.sum(f"_lacks_{k}").over(whole)).otherwise(F.lit(0)).alias(f"_room_{k}") for k in range(len(names))]
    room = lacks.select(F.col(cell).alias("_in_cell"), F.col(genre).alias("_in_genre"), *room)  # a row a cell and genre
    first = deal(first, all_open).drop(*[f"_up_{k}" for k in range(len(names))])
    left = first.where("bucket is null and _longest is not null").drop("bucket")
    again = counted(left).join(F.broadcast(room), F.col(cell).eqNullSafe(F.col("_in_cell")) & F.col(genre).eqNullSafe(F.col("_in_genre")))
    second = deal(again, [F.col(f"_room_{k}") for k in range(len(names))])
    shown = [c for c in first.columns if c not in ("_longest", "_digest")]
    return first.where("bucket is not null").select(*shown, F.lit(1).alias("pass")).unionByName(second.where("bucket is not null").select(*shown, F.lit(2).alias("pass")))


def round_robin(rows: DataFrame, ways: int, order: str, by: list[str]) -> DataFrame:
    """rows, whose order column is numeric, dealt in turn."""
    below = ranks.sum_below(rows.groupBy(*by, order).agg(F.count("*").alias("_n")), by, order, "_n", "_below").drop("_n")
    here = F.row_number().over(Window.partitionBy(*by, order).orderBy(F.monotonically_increasing_id()))
    return rows.withColumn("_here", here).join(below, [*by, order]).withColumn("way", F.pmod(F.col("_below") + F.col("_here") - 1, F.lit(ways)).cast("long")).drop("_below", "_here")


def alternate(rows: DataFrame, cell: str, group: str, each: int, seed: str = "a", id_col: str = "doc_id") -> DataFrame:
    """The first `each` of every cell, its groups taken in turn: the first of each by digest, then the second of each, and so on."""
    turn = ranks.numbered(rows, [cell, group], digest_of(seed, id_col), [id_col], "_turn").where(F.col("_turn") <= each)
    place = F.row_number().over(Window.partitionBy(cell).orderBy("_turn", group))
    return turn.withColumn("place", place).where(F.col("place") <= each).drop("_turn")


def halves(rows: DataFrame, strata: list[str], each: int, seed: str, id_col: str = "doc_id") -> DataFrame:
    """`each` of every stratum, the first half of them development and the others held out, under numbers of one order over all."""
    picked = ranks.numbered(rows, strata, digest_of(seed, id_col), [id_col], "_rn").where(F.col("_rn") <= each)
    part = F.when(F.col("_rn") <= each // 2, "dev").otherwise("heldout")
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(digest_of(seed + "2", id_col), id_col))  # of the few that annotators read
    return picked.withColumn("part", part).withColumn("number", number).drop("_rn")


def regroup(rows: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """The texts of a key joined by spaces in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda p: p[text])
    return rows.groupBy(key).agg(F.array_join(parts, " ").alias(text), F.count("*").alias("parts"))


def regroup_sentences(rows: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(doc, text, parts) of rows whose ids are a document's name, a hyphen and the sentence's number: joined in order and detokenised."""
    cut_at = F.instr(F.col(id_col), "-")
    named = rows.select(F.expr(f"substring(`{id_col}`, 1, instr(`{id_col}`, '-') - 1)").alias("doc"), F.expr(f"try_cast(substring(`{id_col}`, instr(`{id_col}`, '-') + 1) as int)").alias("_k"), text, cut_at.alias("_at"))
    whole = regroup(named.where("_at > 0 and _k is not null"), "doc", "_k", text)
    return whole.withColumn(text, cleaning.detokenize(F.col(text)))


def latest(rows: DataFrame, key: str, version: str, error: str | None = None) -> DataFrame:
    """Of each key the row of the last version. Rows with an error are no version."""
    best = F.max_by(F.struct(*rows.columns), F.col(version)).alias("r")
    return (rows.where(F.col(error).isNull()) if error else rows).groupBy(F.col(key).alias("_k")).agg(best).select("r.*")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def batches(rows: DataFrame, size: int, order: list) -> DataFrame:
    """Batches of `size` rows in a total order. The rows are the few that annotators read."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1) / size).cast("long"))
