"""Vector code compression: every vector becomes one small code a part, by codebooks trained over all vectors.

Components are whole numbers, floor(scale * x). Vectors are dealt into columnar blocks, a row of numbers a component, which are stored once in the shared
folder. A round of training is one `treeAggregate` over the RDD of blocks: a block's distances to the entries of a part accumulate component by
component, its parts are added to integer tensors of sums and counts with `np.add.at`, and tensors merge through a tree of tasks, so that the driver
gets one tensor of the codebooks' own size. Codebooks have a fixed number of entries, whatever the number of vectors, and so are sent to the tasks.

Arithmetic is on 64-bit integers while components are under 2**24, and on unbounded integers beyond, so that results are exact either way.

Defined cases: vectors that are null or hold null or non-finite components take no part; equal ids are separate rows, ordered by their components where
ids decide; null ids come last; fewer vectors than entries make as many entries as there are vectors; vectors of each length have codebooks of their own;
a length that the number of parts does not divide makes parts whose lengths differ by one at most, and empty vectors are all zeros with error 0; errors beyond
64 bits are given as 2**63 - 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.llm.common import join_groups, store

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors in a block at most.
BLOCK = 4096
#: Components up to this are added and multiplied as 64-bit integers: 2**38 of them can be added, and the squares of 2**12.
NARROW = 1 << 24
MOST = (1 << 63) - 1


def taking_part(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, x array<double>) of the vectors that are coded."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.coalesce(F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))), F.lit(False))
    return vectors.where(finite).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), x.alias("x"))


def whole(x, scale: int):
    """floor(scale * x) of a matrix of doubles, as 64-bit integers, or as unbounded ones if some number is large."""
    import math

    import numpy as np

    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not scaled.size or np.abs(scaled).max() < NARROW:
        return scaled.astype(np.int64)
    exact = lambda y: math.floor(y * scale) if abs(y) < 1 << 40 else int(y) * scale  # noqa: E731  doubles from 2**52 on are whole
    return np.array([[exact(float(y)) for y in row] for row in x], object).reshape(x.shape)


def blocks_of(rows: DataFrame) -> DataFrame:
    """(dim, ids, labels, data): at most BLOCK vectors of one length; data has their doubles, component by component."""
    label = rows.schema["label"].dataType
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("data", T.BinaryType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: dict[int, list] = {}
        waiting, kind = 0, None

        def flush():
            for dim, parts in sorted(held.items()):
                ids, labels = (pa.concat_arrays([p[k] for p in parts]) for k in (0, 1))
                x = np.concatenate([p[2] for p in parts])
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), one(ids), one(labels), pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], names=["dim", "ids", "labels", "data"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                ids, labels, lists = some.columns
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(float), lists.offsets.to_numpy().astype(np.int64)
                sizes, starts = np.diff(ends), ends[:-1] - ends[0]
                for dim in np.unique(sizes).tolist():
                    rows_ = np.flatnonzero(sizes == dim)
                    if waiting + len(rows_) > BLOCK:
                        yield from flush()
                        waiting = 0
                    waiting += len(rows_)
                    held.setdefault(dim, []).append((ids.take(pa.array(rows_)), labels.take(pa.array(rows_)), flat[starts[rows_][:, None] + np.arange(dim)[None, :]]))
        yield from flush()

    return rows.select("vec_id", "label", "x").mapInArrow(deal, schema)


def columns_of(data: bytes, dim: int, rows: int, scale: int):
    """The block's whole numbers, a row a component."""
    import numpy as np

    return whole(np.frombuffer(data).reshape(dim, rows), scale)


def cuts(dim: int, parts: int) -> list[int]:
    return [dim * p // parts for p in range(parts + 1)]


def nearest(columns, book, parts: int):
    """(entry, squared distance) of each part of each vector: two lists of arrays. book: a row a component, a column an entry."""
    import numpy as np

    narrow = columns.dtype != object and book.dtype != object and len(columns) <= 1 << 12
    kind = np.int64 if narrow else object
    columns, book = columns.astype(kind, copy=False), book.astype(kind, copy=False)
    found, errors = [], []
    bounds = cuts(len(columns), parts)
    for low, high in zip(bounds, bounds[1:]):
        far = np.zeros((columns.shape[1], book.shape[1]), kind)
        for j in range(low, high):
            apart = columns[j][:, None] - book[j][None, :]
            far += apart * apart
        best = far.argmin(axis=1)  # the lowest of equals
        found.append(best)
        errors.append(far[np.arange(len(best)), best])
    return found, errors


def added(total: dict, block: tuple, books: dict, parts: int, scale: int) -> dict:
    """total, which has (sums, counts) by length of vectors, with a block's parts added to the entries that they are nearest to."""
    import numpy as np

    dim, rows, data = block
    columns, book = columns_of(bytes(data), dim, rows, scale), books[dim]
    found, _ = nearest(columns, book, parts)
    if dim not in total:
        total[dim] = (np.zeros(book.shape, np.int64), np.zeros((parts, book.shape[1]), np.int64))
    sums, counts = total[dim]
    if columns.dtype == object and sums.dtype != object:
        sums = sums.astype(object)
    bounds = cuts(dim, parts)
    for p, entry in enumerate(found):
        np.add.at(counts[p], entry, 1)
        for j in range(bounds[p], bounds[p + 1]):
            np.add.at(sums[j], entry, columns[j])
    total[dim] = (sums, counts)
    return total


def merged(a: dict, b: dict) -> dict:
    return {dim: tuple(x + y for x, y in zip(a[dim], b[dim])) if dim in a and dim in b else a.get(dim) or b[dim] for dim in {*a, *b}}


def renewed(book, sums, counts, parts: int):
    """Entries at the floor of their parts' means; those without parts stay."""
    import numpy as np

    each = np.repeat(counts, np.diff(cuts(len(book), parts)), axis=0)  # a row a component
    means = sums // np.maximum(each, 1)
    return np.where(each > 0, means, book)


def first_books(rows: DataFrame, entries: int, scale: int) -> dict:
    """The first entries: the vectors of the smallest ids of each length. Tasks keep `entries` of a length each before they shuffle."""
    import numpy as np

    dim = F.size("x").alias("dim")
    order = Window.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id"), "x")
    first = rows.select("vec_id", "x", dim).withColumn("at", F.row_number().over(order)).where(F.col("at") <= entries)
    found: dict[int, dict[int, list[float]]] = {}
    for r in first.toLocalIterator():  # `entries` vectors a length
        found.setdefault(r["dim"], {})[r["at"]] = r["x"]
    return {dim: whole(np.array([x for _, x in sorted(at.items())], float).reshape(len(at), dim).T, scale) for dim, at in found.items()}


def train(blocks: DataFrame, books: dict, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE) -> dict:
    """The codebooks by length of vectors after the rounds."""
    context = blocks.sparkSession.sparkContext
    rdd = blocks.select("dim", F.size("ids").alias("rows"), "data").rdd.map(tuple)
    for _ in range(rounds if books else 0):
        sent = context.broadcast(books)
        total = rdd.treeAggregate({}, lambda t, block, sent=sent: added(t, block, sent.value, parts, scale), merged)
        books = {dim: renewed(book, *total[dim], parts) for dim, book in books.items()}
        sent.destroy()
    return books


def digest(book, parts: int) -> str:
    """SHA-256 of the entries' components, by part, entry and place within the part."""
    bounds = cuts(len(book), parts)
    return hashlib.sha256(",".join(str(int(x)) for low, high in zip(bounds, bounds[1:]) for entry in book[low:high].T for x in entry).encode()).hexdigest()


def coded(blocks: DataFrame, books: dict, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of the blocks' vectors."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", blocks.schema["labels"].dataType.elementType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    named = {dim: digest(book, parts) for dim, book in books.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for r in range(batch.num_rows):
                dim, ids, labels = batch.column("dim")[r].as_py(), batch.column("ids")[r].values, batch.column("labels")[r].values
                found, errors = nearest(columns_of(batch.column("data")[r].as_py(), dim, len(ids), scale), books[dim], parts)
                hexed, wide = np.stack(found, axis=1).astype("u1").tobytes().hex(), 2 * parts
                codes = [hexed[at : at + wide] for at in range(0, len(hexed), wide)]
                error = [min(int(e), MOST) for e in sum(errors)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(error, pa.int64()), pa.array([named[dim]] * len(ids), pa.string())], names=schema.names)

    return blocks.mapInArrow(assign, schema)


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, dict]:
    """((vec_id, label, code, error, codebooks_sha256) of every vector that takes part, the codebooks by length of vectors: a row a component, a column an entry)."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number must fit two hex digits")
    rows = taking_part(vectors, id_col, vector_col, label_col)
    blocks = store(blocks_of(rows), "codes-blocks")
    books = train(blocks, first_books(rows, entries, scale), rounds, parts, scale)
    return store(coded(blocks, books, parts, scale), "codes"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of error over the rows of an equal label, nulls together. A label of any number of rows is added up before it moves."""
    total = F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(MOST).cast("decimal(29,0)")).cast("long")
    return join_groups(codes, codes.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("_size")), ["label"], "_size").drop("_size")


def decode(codes: str, book, parts: int = PARTS):
    """The whole numbers that a code stands for."""
    import numpy as np

    bounds = cuts(len(book), parts)
    return np.concatenate([book[low:high, int(codes[2 * p : 2 * p + 2], 16)] for p, (low, high) in enumerate(zip(bounds, bounds[1:]))])
