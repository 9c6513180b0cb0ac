"""The prefix trie of conversations, from mergeable partial tries.

A turn is known by two 64-bit hashes of its role and text, and a prefix by the exclusive or of its turns' hashes, each mixed with the turn's place: a key of
128 bits and the depth, which a running aggregate gives. Texts themselves are not shuffled. Turns are numbered by one sort of the whole table by ranges of (conversation, turn, hashes, row),
so that a conversation of any number of turns is dealt over many tasks; what a conversation has in earlier ranges is added from a table that has a row
for each range at most.

Each task combines the prefixes it reads into a partial trie, a table of nodes by key, and rounds of hash-keyed merges join the partial tries of FAN tasks each into one, until
one is left: members and ends add up, the smallest member stays. Lists of the members that end at a node are merged likewise, as runs of
ascending ids: tasks hold ascending ranges of ids, so runs of a node follow each other, and the digest of a node's list is taken run by run.

The roll-up goes bottom-up without a round for each level. Every node is owned by its smallest member, so what a conversation owns is the lower end of its path. A
conversation sums what it owns from its end upwards; a node's subtree then holds its owner's sum up to there, and all that its other members own.

Defined cases: rows with a null conversation take no part; a null role or text is empty; null turns come first; equal turns of a conversation are ordered by
hash, and repeated rows are turns of their own; an empty table gives an empty result, without a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import join_groups, store

#: A conversation's turns are summed in cells of so many.
CELL = 4096
#: Partial tries that a round of merges joins into one.
FAN = 64
#: Ids that a task keeps before it writes its runs.
HELD_IDS = 500_000
KEY = ["depth", "k1", "k2"]
SLIM = "conv_id long, part int, idx long, c1 long, c2 long, bytes long"


def hashed_text(role: Column, text: Column) -> tuple[Column, Column]:
    """The two hashes by which a turn is known."""
    return F.xxhash64(role, text), F.xxhash64(F.lit(1), text, role)


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, c1, c2, bytes) of every turn: its place from 1, the hashes of its role and text, and its text's bytes in UTF-8."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    c1, c2 = hashed_text(role, text)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), c1.alias("c1"), c2.alias("c2"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "c1", "c2", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "c1", "c2", "bytes")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            if ids[0] != last:
                seen = 0
            starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            lengths = np.diff(np.append(starts, len(ids)))
            at = np.arange(1, len(ids) + 1) - np.repeat(starts, lengths)
            at[: lengths[0]] += seen
            last, seen = ids[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(len(ids), part, "<i4")), pa.array(at), *(batch.column(c) for c in ("c1", "c2", "bytes"))], names=["conv_id", "part", "idx", "c1", "c2", "bytes"])

    slim = store(dealt.mapInArrow(number, SLIM), "trie-turns")
    runs = slim.groupBy("conv_id", "part").agg(F.max("idx").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Only the first conversation of a range can have begun in an earlier one.
    begun = runs.withColumn("before", before).where("before is not null").select("conv_id", "part", "before")
    known = slim.join(F.broadcast(begun), ["conv_id", "part"], "left")
    return known.select("conv_id", (F.col("idx") + F.coalesce("before", F.lit(0))).alias("pos"), "c1", "c2", "bytes")


def branched(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation c took the first h turns of conversation c - c % group in place of its own first h, where h is the CRC-32 of c in decimal
    modulo heads: (conv_id, pos, c1, c2, bytes), and (conv_id, n), n being 0 for a conversation that has none left."""
    base, h = F.col("conv_id") - F.col("conv_id") % group, F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    had = turns.groupBy("conv_id").agg(F.max("pos").alias("had"))
    turn = F.struct("pos", "c1", "c2", "bytes")
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("first"))  # fewer than heads
    plan = had.withColumns({"base": base, "h": h}).join(first, "base", "left").withColumn("head", F.filter("first", lambda t: t["pos"] <= F.col("h")))
    taken = F.coalesce(F.size("head"), F.lit(0))
    plan = plan.select("conv_id", "had", "head", (taken - F.col("h")).alias("shift"), (taken + F.greatest(F.col("had") - F.col("h"), F.lit(0))).alias("n"))
    plan = store(plan, "trie-plan")
    heads_ = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    own = join_groups(turns.where(F.col("pos") > h), plan.select("conv_id", "shift", "had"), ["conv_id"], "had", "inner")
    own = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "c1", "c2", "bytes")
    return heads_.unionByName(own), plan.select("conv_id", "n")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, bytes, ends) of every prefix of every conversation, the empty one too; p1 and p2 are the next shorter one's key, ends says whether it is all of the conversation."""
    mixed = turns.select("conv_id", F.col("pos").alias("depth"), F.xxhash64("pos", "c1").alias("h1"), F.xxhash64(F.lit(2), "c2", "pos").alias("h2"), "bytes")
    roots = convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "h1", "h2", "bytes")])
    cell = F.floor(F.col("depth") / CELL)
    rows = mixed.unionByName(roots).withColumn("cell", cell)
    here = Window.partitionBy("conv_id", "cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"k1": F.bit_xor("h1").over(here), "k2": F.bit_xor("h2").over(here), "next": F.lead("depth").over(Window.partitionBy("conv_id", "cell").orderBy("depth"))})
    # A cell's last row ends its conversation unless there is another cell: n tells, and only of conversations that have several.
    several = convs.where(F.col("n") >= CELL)
    rows = store(rows, "trie-cells")
    if several.isEmpty():
        found = rows.withColumn("ends", F.col("next").isNull())
    else:
        totals = rows.where("next is null").join(several, "conv_id").select("conv_id", "cell", "n", F.col("k1").alias("t1"), F.col("k2").alias("t2"))  # a row a cell
        earlier = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select("conv_id", "cell", "n", F.bit_xor("t1").over(earlier).alias("b1"), F.bit_xor("t2").over(earlier).alias("b2"))
        known = rows.join(carried, ["conv_id", "cell"], "left")
        none = F.lit(0).cast("long")
        plus = lambda k, b: F.col(k).bitwiseXOR(F.coalesce(b, none))
        found = known.withColumns({"k1": plus("k1", "b1"), "k2": plus("k2", "b2"), "ends": F.col("next").isNull() & (F.col("n").isNull() | (F.col("n") == F.col("depth")))})
    return found.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "bytes", "ends")


def merged(rows: DataFrame) -> DataFrame:
    """The trie of rows of prefixes: (depth, k1, k2, p1, p2, bytes, n, first, n_ends) of every node."""
    lanes = rows.rdd.getNumPartitions()
    tries = rows.select(*KEY, "p1", "p2", "bytes", F.lit(1).cast("long").alias("n"), F.col("conv_id").alias("first"), F.col("ends").cast("long").alias("n_ends"), F.spark_partition_id().alias("lane"))
    while True:
        lanes = -(-lanes // FAN)
        by = [*KEY, F.floor(F.col("lane") / FAN).cast("int").alias("lane")] if lanes > 1 else KEY
        # What is grouped is combined in the tasks that hold it before it moves: the partial tries.
        tries = tries.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("p1", "p2", "bytes")], F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("n_ends").alias("n_ends"))
        if lanes == 1:
            return tries


def end_digests(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of every node at which a conversation ends: the digest of the ids, ascending, joined by commas."""
    ends = rows.where("ends").select(*KEY, "conv_id").repartitionByRange("conv_id").sortWithinPartitions("conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A list a node, and another after HELD_IDS ids."""
        held: dict[tuple, list[int]] = {}
        waiting = 0

        def flush():
            keys = list(held)
            for at in range(0, len(keys), 1 << 14):
                some = keys[at : at + (1 << 14)]
                columns = [pa.array([k[j] for k in some], pa.int64()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([held[k][0] for k in some], pa.int64()), pa.array([",".join(map(str, held[k])) for k in some], pa.large_string())], names=[*KEY, "first", "run"])
            held.clear()

        for batch in batches:
            for depth, k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault((depth, k1, k2), []).append(conv)
            waiting += batch.num_rows
            if waiting >= HELD_IDS:
                yield from flush()
                waiting = 0
        yield from flush()

    runs = ends.mapInArrow(run, "depth long, k1 long, k2 long, first long, run string").repartition(*KEY).sortWithinPartitions(*KEY, "first")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "run"))):
                if key == now:
                    sha.update(b",")
                else:
                    done += [(*now, sha.hexdigest())] if now else []
                    now, sha = key, hashlib.sha256()
                sha.update(text.encode())
            yield listed(done)
        yield listed([(*now, sha.hexdigest())] if now else [])

    def listed(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "ends_sha256"])

    return runs.mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, rows: DataFrame, convs: DataFrame) -> DataFrame:
    """nodes (with n_children) with n_leaves and saved_tokens of their subtrees."""
    worth, leaf = (F.col("n") - 1) * F.col("bytes"), (F.col("n_children") == 0).cast("long")
    cells = nodes.withColumns({"worth": worth, "leaf": leaf, "cell": F.floor(F.col("depth") / CELL)})
    # What the owner owns from its end up to the node, in the node's cell and in the deeper ones.
    within = Window.partitionBy("first", "cell").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deeper = Window.partitionBy("first").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.groupBy("first", "cell").agg(F.sum("worth").alias("w"), F.sum("leaf").alias("l"), F.min("depth").alias("top"), F.count("*").alias("size"))
    lower = sums.select("first", "cell", F.coalesce(F.sum("w").over(deeper), F.lit(0)).alias("w"), F.coalesce(F.sum("l").over(deeper), F.lit(0)).alias("l")).where("w != 0 or l != 0")
    owned = cells.withColumns({"own_w": F.sum("worth").over(within), "own_l": F.sum("leaf").over(within)}).join(lower, ["first", "cell"], "left")
    owned = owned.withColumns({"own_w": F.col("own_w") + F.coalesce("w", F.lit(0)), "own_l": F.col("own_l") + F.coalesce("l", F.lit(0))}).drop("w", "l", "cell", "worth", "leaf")
    # What other members own in all, at the nodes above their own.
    owners = sums.groupBy(F.col("first").alias("conv_id")).agg(F.sum("w").alias("w"), F.sum("l").alias("l"), F.min("top").alias("top")).where("(w != 0 or l != 0) and top > 0")
    owners = owners.join(convs.select("conv_id", (F.col("n") + 1).alias("size")), "conv_id")
    lent = join_groups(rows.select("conv_id", *KEY), owners, ["conv_id"], "size", "inner").where(F.col("depth") < F.col("top"))
    lent = lent.groupBy(*KEY).agg(F.sum("w").alias("w"), F.sum("l").alias("l"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return owned.join(lent, KEY, "left").withColumns({"n_leaves": plus("own_l", "l"), "saved_tokens": plus("own_w", "w")}).drop("own_w", "own_l", "w", "l")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node of the trie of turns (conv_id, pos, c1, c2, bytes) of convs (conv_id, n): (depth, k1, k2, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256)."""
    rows = store(prefixes(turns, convs), "trie-prefixes")
    nodes = store(merged(rows), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    known = store(rolled_up(nodes, rows, convs), "trie-rolled")
    parents = known.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("first").alias("parent_conv_id"), F.col("n_children").alias("_size"))
    found = join_groups(known, parents, ["depth", "p1", "p2"], "_size").join(end_digests(rows), KEY, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(*KEY, F.col("first").alias("conv_id"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "n_ends", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def of_conversations(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations as they are."""
    turns = numbered_turns(conversations, **columns)
    return trie(turns, turns.groupBy("conv_id").agg(F.max("pos").alias("n")))
