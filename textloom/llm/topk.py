"""Exact top-k inner products over norm-sorted vectors.

Vectors are dealt by range of length and packed into blocks, longest first; queries are packed alike into larger blocks. Both are rotated by
the leading singular vectors of the directions of the corpus, from a Gram matrix that tasks add up. Candidates are then taken in rounds of blocks by
descending length, each round four times the one before. A round begins with a table of what each block of queries still
needs: the least length at which Cauchy-Schwarz lets a candidate reach the k-th score that some query of the block has so far. Only
blocks of that length or more are joined to it, so what lengths rule out is not shuffled, and a round without any pair ends the search. Within a pair
of blocks partial sums over the leading rotated coordinates plus the product of the residual lengths rule out more, with room for rounding,
and only the rest is scored, exactly. Every round raises the k-th scores.

Components are whole numbers held in doubles, and in two or four bytes where they fit. Scores are exact: by floats while sums stay
under 2**53, by 64-bit integers while they stay under 2**63, and by unbounded integers beyond.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do empty ones or those with a null id; finite components
of any size take part, and a score among a query's best of a block that does not fit 64 bits is an error (as is a component whose product with the scale is no double), not a dropped row; vectors of another
dimension than a query are no candidates of it; ties go to the smaller id; repeated ids are separate queries and candidates, except that a
query never meets rows of its own id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import store

SCALE = 256
BLOCK = 4096
QUERIES = 8192
LEADING = 16
#: Dimensions up to this have their whole Gram matrix added up; beyond it a product with this many columns.
WHOLE_GRAM = 256
FIRST_ROUND, GROWTH = 4, 4
SCHEMA = "query_id long, rank int, vec_id long, score long"
PACKED = "dim int, block long, high double, ids binary, kind string, data binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<double> of whole numbers, norm, dim) of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.coalesce(F.size(x) > 0, F.lit(False)) & F.coalesce(F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))), F.lit(False))
    large = float(1 << 52)  # doubles from here on are whole

    def whole(y):
        z = y * float(scale)
        lost = F.raise_error(F.lit(f"a component of {vector_col} times {scale} is no double")).cast("double")
        return F.when(F.abs(z) < large, F.floor(z).cast("double")).when(F.abs(z) < float("inf"), z).otherwise(lost)

    rows = vectors.where(finite & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))
    return rows.select("vec_id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)).alias("norm"), F.size("v").alias("dim"))


def packed(rows: DataFrame, block: int) -> DataFrame:
    """Blocks of at most `block` vectors of one dimension and of neighbouring lengths, the longest first."""
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # tells equal rows apart, so that they need not meet in one task
    dealt = rows.repartitionByRange("dim", F.desc("norm"), "row").sortWithinPartitions("dim", F.desc("norm"), "row")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        number, held, dim = TaskContext.get().partitionId() << 32, [], None

        def flush():
            nonlocal number, held
            ids, data, norms = (np.concatenate(x) for x in zip(*held))
            most = np.abs(data).max()
            kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
            number, held = number + 1, []
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([norms[0]]), pa.array([ids.astype("<i8").tobytes()]), pa.array([kind]), pa.array([data.astype(kind).tobytes()])],
                names=["dim", "block", "high", "ids", "kind", "data"],
            )

        for batch in batches:
            ids, norms, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "norm", "dim"))
            flat, ends = batch.column("v").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
            at = 0
            while at < len(ids):
                if dim != dims[at]:
                    if held:
                        yield flush()
                    dim = int(dims[at])
                room = block - sum(len(h[0]) for h in held)
                same = int(np.searchsorted(dims, dim, side="right"))
                stop = min(at + room, same)
                held.append((ids[at:stop], flat[ends[at] : ends[stop]].reshape(-1, dim), norms[at:stop]))
                at = stop
                if stop < same or sum(len(h[0]) for h in held) == block:
                    yield flush()
        if held:
            yield flush()

    return dealt.mapInArrow(pack, PACKED)


def unpacked(batch: pa.RecordBatch, r: int, ids: str = "ids", kind: str = "kind", data: str = "data", dim: str = "dim"):
    """(ids, components as doubles) of row r."""
    import numpy as np

    raw = np.frombuffer(batch.column(data)[r].as_py(), batch.column(kind)[r].as_py())
    return np.frombuffer(batch.column(ids)[r].as_py(), "<i8"), raw.reshape(-1, batch.column(dim)[r].as_py()).astype(float)


def rotations(blocks: DataFrame) -> dict[int, object]:
    """The leading singular vectors of the directions of each dimension. Tasks add products up; only sums reach the driver."""
    import numpy as np

    def sketch(dim: int):
        return np.eye(dim) if dim <= WHOLE_GRAM else np.random.default_rng(dim).standard_normal((dim, WHOLE_GRAM))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, object] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                _, x = unpacked(batch, r)
                norms = np.linalg.norm(x, axis=1)
                fine = np.isfinite(norms) & (norms > 0)
                x = x[fine] / norms[fine, None]
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + x.T @ (x @ sketch(x.shape[1]))
        for dim, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * total.size, pa.int32()), pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["dim", "cell", "x"])

    sums = blocks.select("dim", "ids", "kind", "data").mapInArrow(part, "dim int, cell int, x double").groupBy("dim", "cell").agg(F.sum("x").alias("x"))
    found: dict[int, dict[int, float]] = {}
    for r in sums.toLocalIterator():  # a matrix a dimension
        found.setdefault(r["dim"], {})[r["cell"]] = r["x"]
    out = {}
    for dim, cells in found.items():
        gram = np.zeros(dim * min(dim, WHOLE_GRAM))
        gram[list(cells)] = list(cells.values())
        out[dim] = np.linalg.svd(gram.reshape(dim, -1), full_matrices=False)[0][:, :LEADING]
    return out


def exact_scores(q, c):
    """The inner products of whole numbers, as numbers of a type that holds them."""
    import numpy as np

    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    if most < 2**63 and max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    wide = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return wide(q) @ wide(c).T


def best_of(q, ids_q, c, ids_c, k: int, floors, rotation):
    """(query index, candidate index, score) of the pairs that may be among a query's k best: exact scores at or over floors."""
    import numpy as np

    with np.errstate(over="ignore", invalid="ignore"):  # what is no number rules nothing out
        nq, nc = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
        rq, rc = q @ rotation, c @ rotation
        rest_q, rest_c = (np.sqrt(np.maximum(n**2 - (r**2).sum(1), 0)) + 1e-7 * n for n, r in ((nq, rq), (nc, rc)))
        out = []
        for at in range(0, len(q), 128):
            some = slice(at, at + 128)
            slack = 1e-9 * (nq[some, None] * nc[None, :] + 1)
            shut = nq[some, None] * nc[None, :] + slack < floors[some, None]
            shut |= rq[some] @ rc.T + rest_q[some, None] * rest_c[None, :] + slack * 1e3 < floors[some, None]
            rows, columns = np.flatnonzero(~shut.all(axis=1)), np.flatnonzero(~shut.all(axis=0))
            if not len(rows):
                continue
            scores = exact_scores(q[at + rows], c[columns])
            able = ~shut[np.ix_(rows, columns)] & (ids_q[at + rows][:, None] != ids_c[columns][None, :])
            for i, r in enumerate((at + rows).tolist()):
                found = np.flatnonzero(able[i])
                found = found[scores[i, found] >= floors[r]]
                if len(found) > k:
                    order = sorted(range(len(found)), key=lambda j: (-scores[i, found[j]], ids_c[columns[found[j]]])) if scores.dtype == object else np.lexsort((ids_c[columns][found], -scores[i, found]))
                    found = found[list(order[:k])]
                out += [(r, int(columns[j]), int(scores[i, j])) for j in found]
    if any(not -(2**63) <= s < 2**63 for _, _, s in out):
        raise OverflowError("a score does not fit 64 bits")
    return out


def seeker(k: int, turned: dict[int, object]):
    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for r in range(batch.num_rows):
                ids_q, q = unpacked(batch, r, "q_ids", "q_kind", "q_data")
                ids_c, c = unpacked(batch, r)
                floors = np.frombuffer(batch.column("floors")[r].as_py(), "<f8")
                found = best_of(q, ids_q, c, ids_c, k, floors, turned[q.shape[1]])
                places, columns, scores = zip(*found) if found else ((), (), ())
                of = [batch.column("q_block")[r].as_py()] * len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of, pa.int64()), pa.array(places, pa.int32()), pa.array(ids_q[list(places)], pa.int64()), pa.array(ids_c[list(columns)], pa.int64()), pa.array(scores, pa.int64())],
                    names=["q_block", "place", "query_id", "vec_id", "score"],
                )

    return seek


def armed(queries: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
    """queries with floors, each query's k-th score so far (-inf: none), and need, the least length of a candidate that can still matter."""
    if best is None:
        low = queries.select("q_block", F.array().cast("array<struct<place:int,floor:double>>").alias("low"))
    else:
        kth = best.where(F.col("rank") == k).select("q_block", "place", F.col("score").cast("double").alias("floor"))
        low = queries.select("q_block").join(kth.groupBy("q_block").agg(F.collect_list(F.struct("place", "floor")).alias("low")), "q_block", "left")  # at most a block's queries

    def arm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            floors_, needs = [], []
            for r in range(batch.num_rows):
                _, q = unpacked(batch, r, "q_ids", "q_kind", "q_data")
                floors = np.full(len(q), -np.inf)
                for e in batch.column("low")[r].as_py() or ():
                    floors[e["place"]] = e["floor"]
                with np.errstate(all="ignore"):
                    need = np.where(floors > 0, floors / np.linalg.norm(q, axis=1) * (1 - 1e-8) - 1e-8, 0.0)
                floors_.append(floors.astype("<f8").tobytes())
                needs.append(float(np.nan_to_num(need, nan=0.0).min()))
            kept = [batch.column(c) for c in ("q_block", "dim", "q_ids", "q_kind", "q_data")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(floors_, pa.binary()), pa.array(needs, pa.float64())], names=["q_block", "dim", "q_ids", "q_kind", "q_data", "floors", "need"])

    return queries.join(low, "q_block").mapInArrow(arm, "q_block long, dim int, q_ids binary, q_kind string, q_data binary, floors binary, need double")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query, a row whose id `every` divides, among all other rows."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale)
    cands = store(packed(rows, block), "topk-blocks")
    queries = packed(rows.where(F.col("vec_id") % every == 0), query_block).drop("high")
    queries = store(queries.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("data").alias("q_data")), "topk-queries")
    # Blocks by descending length: a row of 20 bytes for `block` vectors.
    order = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("high"), "block")) - 1
    order = store(cands.select("dim", "block", "high").withColumn("at", order), "topk-order")
    most, query_blocks = order.agg(F.max("at")).first()[0], queries.count()
    if most is None or not query_blocks:
        return spark.createDataFrame([], SCHEMA)
    turned = rotations(cands)
    # Each block of queries is copied so often that a round's pairs are dealt over all tasks.
    copies = max(1, min(most + 1, -(-2 * spark.sparkContext.defaultParallelism // query_blocks)))
    best, low, high = None, 0, FIRST_ROUND
    ranked = F.row_number().over(Window.partitionBy("q_block", "place").orderBy(F.desc("score"), "vec_id"))
    while low <= most:
        now = store(armed(queries, best, k), "topk-armed")
        needs = F.broadcast(now.select("dim", "q_block", "need"))  # 20 bytes for a block of queries
        turn = order.where((F.col("at") >= low) & (F.col("at") < high)).select("dim", "block", "high")
        if best is not None and turn.join(needs, "dim").where("high >= need").isEmpty():  # what is left is shorter still
            break
        # Lengths decide before anything is shuffled which copies of a block there are.
        met = cands.drop("dim", "high").join(turn, "block").join(needs, "dim").where("high >= need").drop("need", "high").withColumn("copy", F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int"))
        copied = now.drop("dim", "need").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        found = met.join(copied, ["q_block", "copy"]).select("q_block", "q_ids", "q_kind", "q_data", "floors", "dim", "ids", "kind", "data")
        found = found.mapInArrow(seeker(k, turned), "q_block long, place int, query_id long, vec_id long, score long")
        both = found if best is None else found.unionByName(best.drop("rank"))
        best = store(both.withColumn("rank", ranked).where(F.col("rank") <= k), "topk-best")
        low, high = high, high * GROWTH
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
