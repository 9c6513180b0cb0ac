"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `replicas` virtual nodes on a ring of `positions` places; a document's place is a hash of its id and
its home is the first virtual node clockwise. No shard takes more than its bound: documents of a full shard
continue clockwise to the next distinct shard that has room. Planning runs on counts per place, which are at most
`positions` rows, never on documents: first every shard takes of its own places up to its bound, so that only what
exceeds a bound moves, then what is left walks on clockwise, one shard a round. The plan gives each place ranges
of ranks with their shard and first slot; documents find theirs by their rank within the place.

Law `rows`: the bounds are the floor and the ceiling of the mean, so that counts are at most one apart. A `slack`
over zero loosens the bound to ceil(mean * (1 + slack)) and moves fewer rows.

Defined cases: a null text has no bytes, size 1 and the checksum of nothing; null ids are spread by their text's checksum;
repeated rows are placed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.llm.common import rows_per_cell_salt, store

REPLICAS = 128
POSITIONS = 4096


def ring(shards: int, replicas: int = REPLICAS, positions: int = POSITIONS) -> list[list[int]]:
    """For each place, the distinct shards in clockwise order from it. The nodes of a shard do not depend on how
    many shards there are."""
    at: dict[int, list[int]] = {}
    for shard in range(shards):
        for k in range(replicas):
            place = int(hashlib.md5(f"{shard}/{k}".encode()).hexdigest(), 16) % positions
            at.setdefault(place, []).append(shard)
    nodes = [(p, s) for p in sorted(at) for s in sorted(at[p], key=lambda s: hashlib.md5(f"{p}/{s}".encode()).hexdigest())]
    order, first = [], 0
    for place in range(positions):
        while first < len(nodes) and nodes[first][0] < place:
            first += 1
        seen: dict[int, None] = {}
        for k in range(len(nodes)):
            seen.setdefault(nodes[(first + k) % len(nodes)][1])
            if len(seen) == shards:
                break
        order.append(list(seen))
    return order


def bounds(total: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack:
        return [-(-int(total * (1 + slack)) // shards) + 1] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def placement(counts: dict[int, int], order: list[list[int]], bound: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (place, rank_from, rank_to, shard, first_slot, hops), by rounds as the module says."""
    room, taken, plan = list(bound), [0] * len(bound), []
    ahead = {place: (0, n) for place, n in sorted(counts.items())}  # next rank, rows left
    for hop in range(len(bound)):
        for place, (rank, left) in list(ahead.items()):
            shard = order[place][hop]
            if n := min(left, room[shard]):
                plan.append((place, rank, rank + n, shard, taken[shard], hop))
                room[shard] -= n
                taken[shard] += n
                ahead[place] = (rank + n, left - n)
            if n == left:
                del ahead[place]
    assert not ahead, "the bounds hold fewer rows than there are"
    return plan


def place_of(id_col: str, positions: int):
    """Null ids are spread by the checksum of their text."""
    return F.pmod(F.coalesce(F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.xxhash64("text_crc32")), F.lit(positions)).cast("int")


PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("place", "rank_from", "rank_to", "shard", "first_slot", "hops")])


def shard_rows(docs: DataFrame, shards: int = 8, slack: float = 0.0, replicas: int = REPLICAS, positions: int = POSITIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, home_shard, hops) of every row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = store(rows.withColumns({"place": place_of("doc_id", positions), "row": F.monotonically_increasing_id()}), "ring")
    counts = {int(r["place"]): int(r["count"]) for r in rows.groupBy("place").count().collect()}  # at most positions rows
    order, total = ring(shards, replicas, positions), sum(counts.values())
    plan = placement(counts, order, bounds(total, shards, slack))
    slots = F.broadcast(spark.createDataFrame(plan, PLAN))  # at most positions * shards rows

    # Ranks within a place. The fullest place says how many cells there are, and rows go to cells by their number, so that neither a hot place nor rows repeated whole meet in one task.
    cells = rows_per_cell_salt(max(counts.values(), default=0), 100_000, 4)
    salted = rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int"))
    before = F.sum("count").over(Window.partitionBy("place").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = salted.groupBy("place", "cell").count().select("place", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("place", "cell").orderBy("row"))
    r = salted.withColumn("inside", inside).join(starts, ["place", "cell"]).withColumn("rank", F.col("before") + F.col("inside") - 1).alias("r")
    s = slots.alias("s")
    homes = F.array(*[F.lit(o[0]) for o in order])
    return r.join(s, (F.col("r.place") == F.col("s.place")) & (F.col("r.rank") >= F.col("s.rank_from")) & (F.col("r.rank") < F.col("s.rank_to"))).select(
        "r.doc_id", "r.size", "r.text_crc32", F.col("s.shard").cast("int").alias("shard"),
        (F.col("s.first_slot") + F.col("r.rank") - F.col("s.rank_from")).cast("long").alias("slot"),
        F.element_at(homes, F.col("r.place") + 1).alias("home_shard"), F.col("s.hops").cast("int").alias("hops"),
    )
