"""Toxicity by classifier chains of linear models.

Categories are predicted one after the other; each later model sees the probabilities of the earlier ones, and is trained
with out-of-fold ones, as it will meet the models' honest guesses in use. Features are the distinct words of the whole text and their
first four to six letters, which catches stems whose endings vary; each model takes the words whose presence differs most
surely between its classes. Training takes at most `sample_rows` labelled rows, those with the least hash of their id; scoring is one pass
over all rows without a shuffle.

Defined cases: null equals empty and is scored by the constant alone; labels that are null or without a document are left out, repeated labels
count once with the larger value; without labels of both classes a category's probability is its share (0 without labels);
repeated rows get equal scores, and of an id that repeats one row is fitted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a step of fitting holds as numbers at a time.
FIT_ROWS = 1024
#: The bound on labelled rows that are fitted.
SAMPLE_ROWS = 8000
FOLDS = 3
FEATURES = 256
SLOTS = 1 << 22
MIN_DOCS = 3
MIN_ROOT_G = 3.5
THRESHOLD = 0.5
#: Order of the chain. The column of labels and whether its 0 or its 1 is the category.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))

WORD = re.compile(r"[^\W\d_]+")


def slots(word: str) -> tuple[int, ...]:
    """The word's features: itself and its first four to six letters."""
    found = {f"={word}", *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)}
    return tuple(zlib.crc32(x.encode()) % SLOTS for x in sorted(found))


def vocabulary(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Linear:
    """Probabilities of one category: columns of the features taken, weights, and weights of the earlier categories."""

    taken: list[int] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    earlier: list[float] = field(default_factory=list)
    constant: float = -20.0


def logits(p):
    import numpy as np

    q = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def root_of_g(a, b, pos: int, neg: int):
    """The square root of the G statistic of each feature, present in a of pos and b of neg documents: how sure the difference is, rare features too."""
    import numpy as np

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / expected), 0.0)

    a, b = a.astype(float), b.astype(float)
    share, rest = (a + b) / (pos + neg), 1 - (a + b) / (pos + neg) + 1e-12
    total = part(a, pos * share) + part(b, neg * share) + part(pos - a, pos * rest) + part(neg - b, neg * rest)
    return np.sqrt(np.maximum(2 * total, 0))


def fit(rows, offsets, y, earlier, ridge: float = 0.3) -> Linear:
    """rows: all rows' features in a line, offsets: where each begins. earlier: (rows, earlier categories) probabilities."""
    import numpy as np

    n, pos = len(y), int(y.sum())
    if not n or pos in (0, n):
        share = pos / n if n else 0.0
        return Linear(earlier=[0.0] * earlier.shape[1], constant=float(logits(np.array(share))))
    runs = [(low, min(low + FIT_ROWS, n)) for low in range(0, n, FIT_ROWS)]  # some rows at a time, so that the driver holds no copies of all
    a, b = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for low, high in runs:
        toxic = np.repeat(y[low:high] == 1, np.diff(offsets[low : high + 1]))
        some = rows[offsets[low] : offsets[high]]
        a += np.bincount(some[toxic], minlength=SLOTS)
        b += np.bincount(some[~toxic], minlength=SLOTS)
    often = np.flatnonzero(a + b >= MIN_DOCS)
    g = root_of_g(a[often], b[often], pos, n - pos)
    order = np.argsort(-g, kind="stable")[:FEATURES]
    taken = np.sort(often[order[g[order] >= MIN_ROOT_G]])
    at = np.full(SLOTS, -1, np.int32)
    at[taken] = np.arange(len(taken))
    x = np.zeros((n, len(taken)), np.int8)
    for low, high in runs:
        column = at[rows[offsets[low] : offsets[high]]]
        owner = np.repeat(np.arange(low, high), np.diff(offsets[low : high + 1]))
        x[owner[column >= 0], column[column >= 0]] = 1
    more = np.column_stack([logits(earlier), np.ones(n)])
    w = np.zeros(len(taken) + more.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(12):
        bend, slope = np.diag(penalty), -penalty * w
        for low, high in runs:
            part = slice(low, high)
            xs = np.hstack([x[part], more[part]])
            p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
            bend += xs.T @ (xs * np.maximum(p * (1 - p), 1e-4)[:, None])
            slope += xs.T @ (y[part] - p)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return Linear(taken.tolist(), w[: len(taken)].tolist(), w[len(taken) : -1].tolist(), float(w[-1]))


def predict(model: Linear, rows, offsets, earlier):
    import numpy as np

    weights = np.zeros(SLOTS)
    weights[model.taken] = model.weights
    n = len(offsets) - 1
    z = np.zeros(n)
    for low in range(0, n, FIT_ROWS):
        high = min(low + FIT_ROWS, n)
        owner = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
        z[low:high] = np.bincount(owner, weights[rows[offsets[low] : offsets[high]]], minlength=high - low) + model.constant
    if len(model.earlier):
        z = z + logits(earlier) @ np.array(model.earlier)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(rows, offsets, labels) -> list[Linear]:
    """labels: (rows, categories). Later models are fitted with the earlier ones' out-of-fold predictions."""
    import numpy as np

    n, k = labels.shape
    fold = np.arange(n) % FOLDS
    chain, earlier = [], np.zeros((n, 0))

    def part(mask):
        keep = np.flatnonzero(mask)
        sizes = np.diff(offsets)[keep]
        picks = np.concatenate([rows[offsets[r] : offsets[r + 1]] for r in keep]) if len(keep) else rows[:0]
        return keep, picks, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    for c in range(k):
        y = labels[:, c].astype(float)
        chain.append(fit(rows, offsets, y, earlier))
        held_out = np.zeros(n)
        if c < k - 1:
            for f in range(FOLDS):
                inside, r_in, o_in = part(fold != f)
                outside, r_out, o_out = part(fold == f)
                held_out[outside] = predict(fit(r_in, o_in, y[inside], earlier[inside]), r_out, o_out, earlier[outside])
        earlier = np.column_stack([earlier, held_out])
    return chain


def features_blob(text: Column) -> Column:
    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                found: set[int] = set()
                for w in vocabulary(t):
                    found.update(memo[w] if w in memo else memo.setdefault(w, slots(w)))
                if len(memo) > 500_000:
                    memo.clear()
                out.append(np.array(sorted(found), "<i4").tobytes())
            yield pa.array(out, pa.binary())

    return of(text)


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[Linear]:
    import numpy as np

    columns = {c for _, c, _ in chain}
    one = labels.select(F.col(id_col).alias("_id"), *columns).where(" and ".join(f"{c} is not null" for c in sorted(columns)) + " and _id is not null").groupBy("_id").agg(*[F.max(c).alias(c) for c in sorted(columns)])
    picked = one.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")  # the sample is bounded
    # One row an id, as documents may repeat theirs: the features of the repeat that comes first by them.
    once = texts.select("_id", *sorted(columns), features_blob(F.col("_text")).alias("f")).groupBy("_id", *sorted(columns)).agg(F.min("f").alias("f"))
    found = sorted(once.collect(), key=lambda r: r["_id"])
    order = np.random.default_rng(0).permutation(len(found))
    found = [found[k] for k in order]
    offsets = np.concatenate([[0], np.cumsum([len(r["f"]) // 4 for r in found])]).astype(np.int64)
    rows = np.zeros(offsets[-1], "<i4")
    for k, r in enumerate(found):
        rows[offsets[k] : offsets[k + 1]] = np.frombuffer(r["f"], "<i4")
    y = np.array([[int(r[c] == v) for _, c, v in chain] for r in found]).reshape(len(found), len(chain))
    del found
    return fit_chain(rows, offsets, y)


def probabilities(text: Column, models: list[Linear]) -> Column:
    """array<double>: a probability per category."""
    table: dict[int, list[tuple[int, float]]] = {}
    for c, m in enumerate(models):
        for slot, w in zip(m.taken, m.weights):
            table.setdefault(slot, []).append((c, w))
    plan = [(m.constant, m.earlier) for m in models]

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import math

        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                found: set[int] = set()
                for w in vocabulary(t):
                    hit = memo.get(w)
                    if hit is None:
                        hit = memo[w] = tuple(s for s in slots(w) if s in table)
                    if hit:
                        found.update(hit)
                if len(memo) > 500_000:
                    memo.clear()
                z = [c for c, _ in plan]
                for s in found:
                    for c, w in table[s]:
                        z[c] += w
                ps: list[float] = []
                for c, (_, earlier) in enumerate(plan):
                    for p, w in zip(ps, earlier):
                        q = min(max(p, 1e-6), 1 - 1e-6)
                        z[c] += w * math.log(q / (1 - q))
                    ps.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z[c])))))
                out.append(ps)
            yield pa.array(out, pa.list_(pa.float64()))

    return of(text)


def score(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", out: str = "_p") -> DataFrame:
    """docs with out, the probabilities of the chain's categories."""
    return docs.withColumn(out, probabilities(F.col(text_col), train(docs, labels, chain, sample_rows, id_col, text_col)))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs that the last category of the chain does not hold, with their own columns."""
    out = "_p" + "_" * max(map(len, docs.columns))  # longer than any name there
    return score(docs, labels, id_col=id_col, text_col=text_col, out=out).where(F.element_at(out, -1) < threshold).drop(out)
