"""What the operators of this subpackage share: durable intermediate tables and column checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.shared import new_path, shared_dir

__all__ = ["by_bytes", "filesystem", "join_groups", "new_path", "rows_per_cell_salt", "selector", "sent", "shared_dir", "store", "text_or_empty"]


def store(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table of row or key numbers up to which it is sent to every task (8 to 24 bytes a row); larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def sent(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def filesystem(path: str):
    """(file system, path in it) by which Python tasks read files of the shared folder."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        path = "file:///" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        path = "s3:" + rest
    return fs.FileSystem.from_uri(path)


def selector(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, allow_not_found=True)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch by runs of rows that hold up to `most` bytes in a column of texts, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def rows_per_cell_salt(total: int, rows_per_cell: int = 200_000, least: int = 16) -> int:
    """How many salted cells hold about rows_per_cell rows each."""
    return max(least, -(-total // rows_per_cell))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


#: Groups up to this many are sent to every task; beyond it only those are that salt a shuffled join, which are fewer than SALTED.
SENT_GROUPS, SALTED, GROUP_ROWS = 200_000, 100_000, 100_000


def join_groups(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, how: str = "left") -> DataFrame:
    """rows with the columns of facts, which has one row a group of keys and, in size, about how many of rows are in it. Null keys are equal. A group of any
    size is dealt over many tasks: where facts are too many to be sent, rows of large groups are salted, and their facts copied for each salt."""
    facts = store(facts, "facts")
    groups, total = facts.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    named = facts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in facts.columns if c not in keys])
    same = lambda a: [F.col(k).eqNullSafe(F.col(f"{a}_{k}")) for k in keys]
    if groups <= SENT_GROUPS:
        return rows.join(F.broadcast(named), same("_of"), how).drop(*[f"_of_{k}" for k in keys])
    each = max(GROUP_ROWS, total // SALTED)  # so fewer than SALTED groups are larger
    copies = F.greatest(F.ceil(F.col(size) / each), F.lit(1)).cast("int")
    large = facts.where(F.col(size) > each).select(*[F.col(k).alias(f"_large_{k}") for k in keys], copies.alias("_copies"))
    salted = rows.join(F.broadcast(large), same("_large"), "left").drop(*[f"_large_{k}" for k in keys])
    salted = salted.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_copies", F.lit(1)).cast("long"))).drop("_copies")
    named = named.withColumn("_as", F.explode(F.sequence(F.lit(0), copies - 1)))
    return salted.join(named, [*same("_of"), F.col("_salt") == F.col("_as")], how).drop("_salt", "_as", *[f"_of_{k}" for k in keys])
