"""Exact deduplication over an extendible-hash index on shared files. DataFrame operations only.

The texts, normalised, are written once to the shared folder with a 64-bit hash key: the index pages. Keys are counted, which
moves 24 bytes a distinct key at most; a key that comes once settles its row there and then, and its text is not moved at all.

The directory is over the first bits of the repeated keys. It starts with one bucket and doubles while some bucket holds more than `capacity` bytes
of text, splitting only overfull buckets, up to 2**20 entries. Owner tasks take runs of neighbouring buckets, that is ranges of keys, of about
`owner_bytes`: the directory's owner number is the partition number of the exchange itself. Within its range an owner sorts entries by key and
normalised bytes, so texts that collide in a key are neighbours in one chain and stay apart because their bytes are compared.

A key with more than `hot_rows` rows or `hot_bytes` bytes could not be split by any directory. Its rows are folded by bytes in the tasks that read
them, so that one entry a task and text is moved, and find the folded entries by a broadcast, of which there is one for hot_rows rows or hot_bytes bytes
at most, and one per text that collides with it.

Defined cases: null equals empty; texts are equal when identical after lower-casing A-Z only; of equal texts the row with the
largest id stays, among repeated ids any one of them, exactly one; null ids come last; an empty table gives an
empty result; other columns are ignored, or carried whole in one struct that cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import sent, store

BUCKET_BYTES = 4 << 20
OWNER_BYTES = 64 << 20
HOT_ROWS, HOT_BYTES = 50_000, 64 << 20
MAX_DEPTH = 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() does the same, and faster, where no other letter has case to lose."""
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def directory(histogram: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int]]:
    """2**depth entries (depth of the bucket, bucket), buckets numbered in key order; histogram: what a prefix of max_depth bits holds. depth is the
    least at which no bucket holds more than capacity, or max_depth."""
    depth, buckets = 0, [(0, 0, sum(histogram.values()))]  # depth, prefix, load
    while depth < max_depth and any(load > capacity for _, _, load in buckets):
        depth += 1  # the directory doubles: its entries point at the buckets they came from, and the overfull ones split
        loads: dict[int, int] = {}
        for slot, n in histogram.items():
            prefix = slot >> (max_depth - depth)
            loads[prefix] = loads.get(prefix, 0) + n
        split = lambda d, p, load: [(depth, q, loads.get(q, 0)) for q in (2 * p, 2 * p + 1)] if load > capacity and d == depth - 1 else [(d, p, load)]  # noqa: B023, E731
        buckets = [new for b in buckets for new in split(*b)]
    return [(d, number) for number, (d, _, _) in enumerate(buckets) for _ in range(1 << (depth - d))]


def owners(entries: list[tuple[int, int]], histogram: dict[int, int], max_depth: int, owner_bytes: int) -> list[int]:
    """The owner of each entry: runs of whole buckets, a new one once the last holds owner_bytes."""
    shift = max_depth - (len(entries).bit_length() - 1)
    loads: dict[int, int] = {}
    for slot, n in histogram.items():
        bucket = entries[slot >> shift][1]
        loads[bucket] = loads.get(bucket, 0) + n
    of, owner, held = {}, 0, 0
    for bucket in range(entries[-1][1] + 1):
        if held >= owner_bytes:
            owner, held = owner + 1, 0
        of[bucket] = owner
        held += loads.get(bucket, 0)
    return [of[bucket] for _, bucket in entries]


def index_pages(docs: DataFrame, id_col: str, text_col: str, carry: bool, key_of: Callable[[Column], Column]) -> DataFrame:
    """The stored pages: (_row, doc_id, key, size, text_sha256, norm[, _carried]). With _carried, norm is not stored beside the text in it but made on reading."""
    norm = lambda text: ascii_lower(F.coalesce(text, F.lit("")))
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_carried")] if carry else []
    pages = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), norm(F.col(text_col)).alias("norm"), *carried)
    pages = pages.withColumns({"key": key_of(F.col("norm")), "size": F.octet_length("norm").cast("long"), "text_sha256": F.sha2(F.col("norm").cast("binary"), 256)})
    if not carry:
        return store(pages, "dedup-pages")
    return store(pages.drop("norm"), "dedup-pages").withColumn("norm", norm(F.col("_carried")[text_col]))


def with_owner(rows: DataFrame, keys: DataFrame, capacity: int, owner_bytes: int, max_depth: int) -> DataFrame:
    """rows dealt to their owner tasks, with the column owner."""
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    bits = min(max_depth, max(1, (4 * total // capacity).bit_length()))
    slot = lambda depth: F.shiftrightunsigned("key", 64 - depth).cast("int")
    histogram = {r["slot"]: r["bytes"] for r in keys.groupBy(slot(bits).alias("slot")).agg(F.sum("bytes").alias("bytes")).toLocalIterator()}  # at most 2**max_depth rows
    entries = directory(histogram, capacity, bits)
    depth = len(entries).bit_length() - 1
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    of = owners(entries, histogram, bits, max(1, min(owner_bytes, total // (2 * parallel))))
    if not depth:
        return rows.withColumn("owner", F.lit(0)).repartitionById(1, "owner")
    listed = rows.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(str(of)), "array<int>")).alias("slot", "owner"))
    return rows.withColumn("slot", slot(depth)).join(F.broadcast(listed), "slot").drop("slot").repartitionById(of[-1] + 1, "owner")


def repeated(
    docs: DataFrame, id_col: str, text_col: str, carry: bool, capacity: int, owner_bytes: int, max_depth: int, hot_rows: int, hot_bytes: int, key_of: Callable[[Column], Column]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, keys that come more than once, decisions on the rows of these: _row, doc_id, keep_id, group_size, kept, text_sha256)."""
    pages = index_pages(docs, id_col, text_col, carry, key_of)
    keys = pages.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    keys = store(keys.withColumn("hot", (F.col("n") > hot_rows) | (F.col("bytes") > hot_bytes)), "dedup-keys")
    known, hot_keys = keys.agg(F.count("*"), F.coalesce(F.sum(F.col("hot").cast("long")), F.lit(0))).first()
    slim = ("_row", "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    rows = pages.select("_row", "doc_id", "key", "norm", "text_sha256")
    listed = sent(keys.where("hot").select("key"), hot_keys)  # one for hot_rows rows or hot_bytes bytes at most
    calm = rows.join(listed, "key", "left_anti") if hot_keys else rows
    calm = calm.join(sent(keys.where("not hot").select("key"), known - hot_keys), "key")

    chain = Window.partitionBy("owner", "key", "norm").orderBy(F.desc_nulls_last("doc_id"), "_row")
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cold = with_owner(calm, keys.where("not hot"), capacity, owner_bytes, max_depth)
    cold = cold.select("_row", "doc_id", F.first("doc_id").over(whole).alias("keep_id"), F.count("*").over(whole).alias("group_size"), (F.row_number().over(chain) == 1).alias("kept"), "text_sha256")
    if not hot_keys:
        return pages, keys, cold.select(*slim)
    hot = rows.join(listed, "key")
    best = F.coalesce(F.max_by("_row", "doc_id"), F.max("_row")).alias("keeper")
    folded = store(hot.groupBy("key", "norm", "text_sha256").agg(best, F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("norm"), "dedup-hot")
    hot = hot.drop("norm").join(sent(folded, folded.count()), ["key", "text_sha256"])
    return pages, keys, cold.select(*slim).unionByName(hot.withColumn("kept", F.col("_row") == F.col("keeper")).select(*slim))


def decide(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_BYTES, owner_bytes: int = OWNER_BYTES, max_depth: int = MAX_DEPTH, hot_rows: int = HOT_ROWS,
    hot_bytes: int = HOT_BYTES, key_of: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs."""
    pages, keys, found = repeated(docs, id_col, text_col, False, capacity, owner_bytes, max_depth, hot_rows, hot_bytes, key_of)
    known, hot_keys = keys.agg(F.count("*"), F.count_if(F.col("hot"))).first()
    alone = pages.select("doc_id", "key", "text_sha256").join(sent(keys.where("hot").select("key"), hot_keys), "key", "left_anti")
    alone = alone.join(sent(keys.where("not hot").select("key"), known - hot_keys), "key", "left_anti")
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return found.drop("_row").unionByName(alone)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies, with its own columns."""
    pages, _, found = repeated(docs, id_col, text_col, True, BUCKET_BYTES, OWNER_BYTES, MAX_DEPTH, HOT_ROWS, HOT_BYTES, F.xxhash64)
    dropped = store(found.where("not kept").select("_row"), "dedup-dropped")
    return pages.join(sent(dropped, dropped.count()), "_row", "left_anti").select("_carried.*")
