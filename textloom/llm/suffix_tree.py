"""Language-model scoring by a probabilistic suffix tree over words.

A state is a context of up to `depth` words. A context is a candidate if it comes at least `least` times in the training texts, and is retained if a divergence test says
that its next words differ from those of its longest retained suffix: the log-likelihood that its own distribution gains over the suffix's, each occurrence left
out of the counts that score it, must be over `gain`. Distributions are smoothed towards the suffix's, P(w | s) = (c(s, w) + m P(w | suffix)) / (n(s) + m), down to the base of single words. A
word is scored by the longest retained suffix of what comes before it.

The texts are read once into chunks: words by number, in columns, stored in the shared folder. A level of the tree is one exchange. Each chunk lists its distinct (context, next word) pairs once,
with their training counts, by buckets of the context's hash; the task of a bucket adds them up, tests the contexts and answers each chunk in
the order in which it asked; answers are written by part of the chunks, where the chunks' tasks read them. So texts do not move, a pair moves once a chunk and
level, and nothing but sums reaches the driver. Contexts that come more than SPLIT times are dealt over several buckets by their next words, and their
gains, which are sums over next words, are added up afterwards. The number of buckets grows with the number of words.

Words and contexts are told apart by 64-bit hashes. Defined cases: a null text is empty, and an empty text is its end alone; a document without id is held out, as are those
whose remainder is 0; repeated ids and rows are documents of their own; without training texts every word is as likely as any; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import by_bytes, filesystem, new_path, selector, store

DEPTH, LEAST, GAIN, PRIOR = 2, 8, 4.0, 16.0
ALPHA = 0.1
#: In the divergence test, probabilities of suffixes are rounded to so many steps a power of ten.
LOG_STEPS = 100
#: Words in a chunk, unless one text has more; words a bucket of a level.
CHUNK_WORDS, BUCKET_WORDS = 1_250_000, 1_000_000
#: Bytes of texts that are cut into words at once, unless one text has more.
READ_BYTES = 4 << 20
#: Contexts of more occurrences are split, or, if they are more, of those beyond a part in SPLIT_MOST of all words, so that there are fewer than SPLIT_MOST of them.
SPLIT, SPLIT_MOST = 200_000, 4_000_000
CHUNKS = "part int, chunk long, n_words long, n_train long, n_listed long, ids array<long>, docs binary, words binary, codes binary"
ASKED = "bucket int, part int, chunk long, asked binary"
ANSWERS = "part int, chunk long, bucket int, answer binary, context long, gain double"


def frozen(*arrays) -> bytes:
    """Arrays in few bytes: byte by place, compressed."""
    import numpy as np

    head, bodies = [], []
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view("u1").reshape(len(a), a.itemsize).T).tobytes()
        bodies.append(pa.Codec("zstd", 3).compress(planes, asbytes=True) if planes else b"")
        head += [len(a), len(bodies[-1])]
    return np.array(head, "<i8").tobytes() + b"".join(bodies)


def thawed(blob: bytes, *kinds: str) -> list:
    import numpy as np

    head, at, out = np.frombuffer(blob, "<i8", 2 * len(kinds)).tolist(), 16 * len(kinds), []
    for kind, n, size in zip(kinds, head[::2], head[1::2]):
        width = np.dtype(kind).itemsize
        planes = pa.decompress(blob[at : at + size], decompressed_size=n * width, codec="zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, "u1").reshape(width, n).T).view(kind).reshape(n))
        at += size
    return out


def with_steps(values, starts):
    """Ascending runs as their first values and steps."""
    import numpy as np

    steps = np.diff(values, prepend=values[:1])
    steps[starts] = values[starts]
    return steps


def without_steps(steps, starts):
    import numpy as np

    up = np.cumsum(steps, dtype=steps.dtype)
    return up - np.repeat(up[starts] - steps[starts], np.diff(np.append(starts, len(steps))))


def stepped(columns: list) -> list:
    """Columns of rows in ascending order: each as steps wherever those before it stay."""
    import numpy as np

    out, new = [], np.arange(len(columns[0])) == 0
    for c in columns:
        out.append(with_steps(c, np.flatnonzero(new)))
        new = new | changes(c)
    return out


def unstepped(columns: list) -> list:
    import numpy as np

    out, new = [], np.arange(len(columns[0])) == 0
    for c in columns:
        out.append(without_steps(c, np.flatnonzero(new)))
        new = new | changes(out[-1])
    return out


def changes(x):
    """Where a value differs from the one before it, and at the first."""
    import numpy as np

    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def context_of(words: list):
    """A hash of the numbers of a context's words."""
    import numpy as np

    out = np.zeros(len(words[0]), np.uint64)
    for w in words:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64) + np.uint64(1))
    return out


def mixed(x):
    """A 64-bit hash of 64-bit numbers."""
    import numpy as np

    x = np.asarray(x).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def chunked(docs: DataFrame, id_col: str, text_col: str, folds: int, chunk_words: int) -> DataFrame:
    """The chunks: ids of documents, docs (words of each, whether it is held out), words (hash and training count of each distinct word) and codes (the words' numbers, most frequent first). An
    end is the word of no letters."""
    key = F.col(id_col).cast("long")
    held = F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        import xxhash
        from pyspark import TaskContext

        part, number, waiting, kept = TaskContext.get().partitionId(), 0, 0, []

        def flush():
            nonlocal number, waiting, kept
            ids, out, sizes = pa.concat_arrays([k[0] for k in kept]), np.concatenate([k[1] for k in kept]), np.concatenate([k[2] for k in kept])
            listed = pa.chunked_array([k[3] for k in kept]).combine_chunks().dictionary_encode()
            at, words = listed.indices.to_numpy(), listed.dictionary.to_pylist()
            codes = np.insert(at, np.cumsum(sizes), len(words))  # an end after each text
            sizes, counts = sizes + 1, None
            order = np.argsort(-np.bincount(codes, minlength=len(words) + 1), kind="stable")
            rank = np.empty(len(order), "<i4")
            rank[order] = np.arange(len(order))
            codes = rank[codes]
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in words] + [xxhash.xxh64_intdigest("")], "<u8")[order]
            trained = np.repeat(~out, sizes)
            counts = np.bincount(codes[trained], minlength=len(order)).astype("<i8")
            row = (part, (part << 32) + number, len(codes), int(trained.sum()), len(order), ids, frozen(sizes.astype("<i8"), out.astype("u1")), frozen(hashes, counts), frozen(codes))
            number, waiting, kept = number + 1, 0, []
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), None, pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array([v], t) if t is not None else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v, t in zip(row, kinds)]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CHUNKS.split(", ")])

        for batch in (b for whole in batches for b in by_bytes(whole, 1, READ_BYTES)):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(1), "")))
            words = lists.flatten()
            full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
            before, ends = np.concatenate([[0], np.cumsum(full)]), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            bounds = before[ends]
            words = words.filter(pa.array(full))
            out, at = batch.column(2).to_numpy(zero_copy_only=False), 0
            while at < batch.num_rows:
                # As many documents as fit, one at least.
                stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + chunk_words - waiting, side="right")) - 1)
                if kept and bounds[stop] - bounds[at] + waiting > chunk_words:
                    yield flush()
                    continue
                kept.append((batch.column(0).slice(at, stop - at), out[at:stop].astype(bool), np.diff(bounds[at : stop + 1]), words.slice(bounds[at], bounds[stop] - bounds[at])))
                waiting, at = waiting + int(bounds[stop] - bounds[at]), stop
        if kept:
            yield flush()

    return docs.select(key, F.col(text_col).cast("string"), held).mapInArrow(read, CHUNKS)


def grouped_by(bucket, *values):
    """(order of entries by bucket and values, [(bucket, first, end)])."""
    import numpy as np

    order = np.lexsort((*values[::-1], bucket)) if values else np.argsort(bucket, kind="stable")
    found = bucket[order]
    starts = np.flatnonzero(np.diff(found, prepend=-1))
    return order, list(zip(found[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(found)]))


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    of = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(columns, kinds)], names=names)


def ask_words(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for part, chunk, words in zip(*(c.to_pylist() for c in batch.columns)):
                hashes, counts = thawed(words, "<u8", "<i8")
                order, cuts = grouped_by((hashes % np.uint64(buckets)).astype(int), hashes)
                yield batch_of([(b, part, chunk, frozen(with_steps(hashes[order[low:high]], [0]), counts[order[low:high]])) for b, low, high in cuts], ASKED)

    return ask


def answer_words():
    """For each word asked for its training count and its rank in the bucket, the most frequent first. gain has a bucket's words that are in training texts, once."""

    def answer(asked: pa.Table) -> pa.Table:
        import numpy as np

        rows = asked.to_pylist()
        steps, counts = zip(*(thawed(r["asked"], "<u8", "<i8") for r in rows))
        hashes = [np.cumsum(x, dtype=x.dtype) for x in steps]
        found, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype("<i8")
        rank = np.empty(len(found), "<i8")
        rank[np.argsort(-total, kind="stable")] = np.arange(len(found))
        out, low = [], 0
        for r, h in zip(rows, hashes):
            own, low = at[low : low + len(h)], low + len(h)
            out.append((r["part"], r["chunk"], r["bucket"], frozen(total[own], rank[own]), None, None))
        out.append((-1, -1, rows[0]["bucket"], None, None, float((total > 0).sum())))
        return pa.Table.from_batches([batch_of(out, ANSWERS)])

    return answer


class Chunk:
    """A chunk in a task, with what is known so far. gram: for each place the number of the words that end there, or -1; seen: the training count of each number. Two chunks are in memory on an executor of
    two cores, so what one level needs goes when the level is done, and columns of places are 32 bits wide where numbers allow it."""

    def __init__(self, row: dict, answers: list[str], model: dict):
        import numpy as np

        self.model, self.part, self.chunk = model, row["part"], row["chunk"]
        self.sizes, self.out = thawed(row["docs"], "<i8", "u1")
        (codes,), (hashes, _) = thawed(row["codes"], "<i4"), thawed(row["words"], "<u8", "<i8")
        self.first = np.cumsum(self.sizes) - self.sizes
        bucket = (hashes % np.uint64(model["word_buckets"])).astype(int)
        order, _ = grouped_by(bucket, hashes)
        got = [thawed(a, "<i8", "<i8") for a in self.told(answers[0])]
        count, number = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        count[order], number[order] = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        number = number * model["word_buckets"] + bucket  # a word's number in all chunks, small if it is frequent
        # Words by their numbers, so that whatever is in order here is so for all.
        order = np.argsort(number)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.codes, self.count, self.number = rank[codes], count[order], number[order]
        del got, codes, hashes, bucket, count, number, order, rank
        self.p = ((self.count + ALPHA) / (model["n"] + ALPHA * (model["v"] + 1)))[self.codes]
        self.base = np.add.reduceat(np.log10(self.p), self.first)
        self.gram, self.seen, self.level = self.codes, self.count, 0
        for path, retained in zip(answers[1:], model["retained"]):
            self.step(path, retained)

    def told(self, path: str) -> list[bytes]:
        """The answers to this chunk, by bucket."""
        import pyarrow.parquet as pq

        system, root = filesystem(path)
        found = []
        for f in system.get_file_info(selector(f"{root}/part={self.part}")):
            if f.path.endswith(".parquet"):
                with system.open_input_file(f.path) as opened:
                    for batch in pq.ParquetFile(opened).iter_batches(batch_size=256, columns=["chunk", "bucket", "answer"]):
                        found += [(b, a) for c, b, a in zip(*(x.to_pylist() for x in batch.columns)) if c == self.chunk]
        return [a for _, a in sorted(found, key=lambda x: x[0])]

    def ask(self) -> SimpleNamespace:
        """The next level's pairs: places, pair (of each place), order (the pairs by bucket, context and next word), cuts (of the buckets) and, in that order, at (a place of each pair), context, n (of the
        context) and starts (of the runs of a context)."""
        import numpy as np

        self.level += 1
        able, frequent = np.zeros(len(self.codes), bool), np.append(self.seen >= self.model["least"], False)  # the last is for -1
        able[1:] = frequent[self.gram[:-1]]
        able[self.first] = False
        places = np.flatnonzero(able).astype(np.int32)
        key = self.gram[places - 1].astype(np.int64) * len(self.count) + self.codes[places]
        order = np.argsort(key)
        new = changes(key[order])
        pair = np.empty(len(places), np.int32)
        pair[order] = np.cumsum(new, dtype=np.int32) - 1
        at = places[order[new]]  # pairs are in the order of their words' numbers
        del able, key, order, new
        n = self.seen[self.gram[at - 1]]
        context, piece = context_of(self.words(at)), self.number[self.codes[at]] % np.maximum(-(-n // self.model["split"]), 1)
        bucket = (mixed(context + piece.astype(np.uint64)) % np.uint64(self.model["buckets"])).astype(np.int32)
        order, cuts = grouped_by(bucket)
        order, context, bucket = order.astype(np.int32), context[order], bucket[order]
        starts = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | changes(context))
        return SimpleNamespace(places=places, pair=pair, order=order, cuts=cuts, at=at[order], context=context, n=n[order], starts=starts)

    def words(self, at) -> list:
        """The numbers of the words of the contexts before some places."""
        return [self.number[self.codes[at - back]] for back in range(self.level, 0, -1)]

    def questions(self) -> list[tuple]:
        import numpy as np

        asked = self.ask()
        trained = np.repeat(self.out == 0, self.sizes)
        count = np.bincount(asked.pair[trained[asked.places]], minlength=len(asked.at))[asked.order]
        out, ends = [], np.append(asked.starts, len(asked.at))
        for b, low, high in asked.cuts:
            i, j = np.searchsorted(asked.starts, (low, high))
            at, runs = asked.at[low:high], asked.starts[i:j]
            large = np.where(asked.n[runs] > self.model["split"], asked.n[runs], 0)
            dear = np.clip(np.round(-LOG_STEPS * np.log10(self.p[at])), 0, 32767).astype("<i2")
            facts = (np.diff(ends[i : j + 1]).astype("<i4"), large, with_steps(self.number[self.codes[at]], runs - low), count[low:high], dear)
            out.append((b, self.part, self.chunk, frozen(*stepped(self.words(asked.at[runs])), *facts)))
        return out

    def step(self, path: str, retained) -> None:
        """Takes a level's answers in. retained: the split contexts that are retained."""
        import numpy as np

        asked, told = self.ask(), self.told(path)
        total, kept = np.zeros(len(asked.at), np.int64), np.zeros(len(asked.at), bool)
        ends = np.append(asked.starts, len(asked.at))
        if len(told) != len(asked.cuts):
            raise ValueError(f"{len(told)} answers to {len(asked.cuts)} questions in {path}")
        for (_, low, high), answer in zip(asked.cuts, told):
            (sums, runs), (i, j) = thawed(answer, "<i8", "u1"), np.searchsorted(asked.starts, (low, high))
            runs, starts = runs.astype(bool), asked.starts[i:j]
            large = asked.n[starts] > self.model["split"]
            runs[large] = np.isin(asked.context[starts][large], retained)
            total[asked.order[low:high]], kept[asked.order[low:high]] = sums, np.repeat(runs, np.diff(ends[i : j + 1]))
        places, pair = asked.places, asked.pair
        del asked, told, ends
        taken = kept[pair]
        at, prior = places[taken], self.model["prior"]
        p = self.p[at]
        p *= prior
        p += total[pair[taken]]
        p /= self.seen[self.gram[at - 1]] + prior
        self.p[at] = p
        self.gram, self.seen = np.full(len(self.codes), -1, np.int32), total
        self.gram[places] = pair


def gain_of(total, n, p, prior: float):
    """What the counts of a context's next words gain over the suffix's probabilities p, in natural logarithms, each occurrence left out of the counts that score it."""
    import numpy as np

    seen = np.maximum(total, 1)
    return total * np.log((seen - 1 + prior * p) / ((n - 1 + prior) * p))


def answer_pairs(model: dict, level: int):
    """For each pair asked for its training count, for each context whether it is retained. Contexts that are split get their part of the gain instead."""

    def answer(asked: pa.Table) -> pa.Table:
        import numpy as np

        rows = asked.to_pylist()
        got = []
        for r in rows:
            *words, lengths, n, steps, count, dear = thawed(r["asked"], *["<i8"] * level, "<i4", "<i8", "<i8", "<i8", "<i2")
            got.append((context_of(unstepped(words)), n, lengths, without_steps(steps, np.cumsum(lengths) - lengths), count, dear))
        runs, n, lengths, following, count, dear = (np.concatenate([g[k] for g in got]) for k in range(6))
        context = np.repeat(runs, lengths)
        order = np.lexsort((following, context))
        new = changes(context[order]) | changes(following[order])
        starts = np.flatnonzero(new)
        total = np.add.reduceat(count[order], starts)
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        at = order[starts]
        heads = np.flatnonzero(changes(context[at]))
        # A context's occurrences: what is here of it, unless it is split; then chunks say.
        sums, large = np.add.reduceat(total, heads), np.repeat(n, lengths)[at]
        size = np.where(large > 0, large, np.repeat(sums, np.diff(np.append(heads, len(at)))))
        gains = gain_of(total, size, 10.0 ** (dear[at] / -LOG_STEPS), model["prior"])
        gain, of = np.add.reduceat(gains, heads), context[at][heads]
        retained = gain > model["gain"]
        known = retained[np.searchsorted(of, runs)].astype("u1")
        large, where = np.unique(runs[n > 0]), rows[0]["bucket"]
        out = [(-1, -1, where, None, int(c), float(g)) for c, g in zip(large.astype(np.int64), gain[np.searchsorted(of, large)])]
        low, first = 0, 0
        for r, g in zip(rows, got):
            own, mine = pair[low : low + len(g[3])], known[first : first + len(g[0])]
            low, first = low + len(g[3]), first + len(g[0])
            out.append((r["part"], r["chunk"], where, frozen(total[own], mine), None, None))
        return pa.Table.from_batches([batch_of(out, ANSWERS)])

    return answer


def exchanged(asked: DataFrame, answer, name: str) -> tuple[DataFrame, str]:
    """The answers to what is asked, and the folder that has them by part. What is no answer to a chunk is part -1."""
    spark = asked.sparkSession
    path = new_path(spark, name)
    asked.groupBy("bucket").applyInArrow(answer, ANSWERS).repartition("part").write.partitionBy("part").parquet(path)
    return spark.read.schema(ANSWERS.replace("part int, ", "") + ", part int").parquet(path), path


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, depth: int = DEPTH, least: int = LEAST, gain: float = GAIN, prior: float = PRIOR,
    chunk_words: int = CHUNK_WORDS, bucket_words: int = BUCKET_WORDS, split: int = SPLIT,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; of `folds` parts of the ids one is held out."""
    chunks = store(chunked(docs, id_col, text_col, folds, chunk_words), "tree-chunks")
    words, n, listed = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_train", "n_listed")]).first()
    if not words:
        return docs.sparkSession.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    model = {"least": least, "gain": gain, "prior": prior, "n": n, "split": max(split, n // SPLIT_MOST), "buckets": -(-words // bucket_words), "word_buckets": -(-listed // bucket_words), "retained": []}
    told, path = exchanged(chunks.select("part", "chunk", "words").mapInArrow(ask_words(model["word_buckets"]), ASKED), answer_words(), "tree-words")
    model["v"] = int(told.where("part = -1").agg(F.coalesce(F.sum("gain"), F.lit(0))).first()[0])
    answers = [path]
    for level in range(1, depth + 1):
        told, path = exchanged(chunks.select("part", "chunk", "docs", "words", "codes").mapInArrow(asker(answers, model), ASKED), answer_pairs(model, level), "tree-level")
        large = told.where("part = -1").groupBy("context").agg(F.sum("gain").alias("gain")).where(F.col("gain") > gain).select("context")
        answers, model = [*answers, path], {**model, "retained": [*model["retained"], numbers(large)]}
    return chunks.select("part", "chunk", "ids", "docs", "words", "codes").mapInArrow(scorer(answers, model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def numbers(contexts: DataFrame):
    """The hashes of split contexts, of which there are fewer than SPLIT_MOST."""
    import numpy as np

    return np.array([r[0] for r in contexts.toLocalIterator()], np.int64).astype(np.uint64)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield {c: batch.column(c)[r].as_py() if c != "ids" else batch.column(c)[r].values for c in batch.schema.names}


def asker(answers: list[str], model: dict):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield batch_of(Chunk(row, answers, model).questions(), ASKED)

    return ask


def scorer(answers: list[str], model: dict):
    def scored(row: dict) -> pa.RecordBatch:
        import numpy as np

        c = Chunk(row, answers, model)
        sums = lambda x: pa.array(np.add.reduceat(x, c.first))
        known = (c.count > 0)[c.codes].astype(np.int64)
        columns = [row["ids"], pa.array(c.out.astype(bool)), pa.array(c.sizes), sums(known), pa.array(np.full(len(c.sizes), model["n"], "<i8")), pa.array(c.base), sums(np.log10(c.p))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield scored(row)  # a function of its own, so that no chunk is held while the next is made

    return scores
