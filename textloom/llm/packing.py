"""Best-fit packing of tokenised documents into fixed-length sequences.

Length-histogram planning. The corpus is tokenised once and its pieces are stored. Only the histogram of piece
lengths, at most `capacity` counts, reaches the driver, where best-fit decreasing runs over counts: one step places
many equal pieces at once. The plan names, for each range of ranks within a length, the sequences and offsets to
take; pieces find their slots by joining on length and rank. Ranks come from salted cells, so that a length shared
by a third of all pieces is still ranked by many tasks.

Defined cases: a null or empty text is one piece holding only the end id; a text longer than the capacity is cut
into full pieces and a shorter last one; repeated rows each get their own slot; an empty table gives an empty
result; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.llm.common import rows_per_cell_salt, store

CAPACITY = 2048
END_ID = 0
#: A plan of more rows than this is joined by shuffle, cell of ranks by cell, instead of being broadcast (48 bytes a row). A plan has some rows for each length and each kind of room that is
#: filled, at most capacity * capacity / 2, however many documents there are.
BROADCAST_PLAN_ROWS = 200_000
#: Ranks of a length in a cell of that join: no length is hot, and a piece meets only the plan's rows in its cell.
CELL_RANKS = 1_024
#: Distinct words whose ids a Python worker keeps; beyond it the memo starts anew, which costs time only.
MEMO_WORDS = 700_000
#: Signs that end a run of letters for the tokenizer. An apostrophe may begin a token with letters, a less-than sign a special one, and signs beyond ASCII may be composed with a letter.
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "'<|>")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """The tokenizer's ids of whole texts, word by word: it drops white space and no token spans it, so the ids of a
    text are those of its words in a row. Words are encoded once per worker."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.np, self.tokenizer, self.memo = np, Tokenizer.from_file(path), {"": b""}
        # Runs of small ASCII letters are units as they are: neither its normalizer nor its pattern changes them.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True

    def ids(self, text: str) -> bytes:
        return self.np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Puts words into the memo. What follows the letters a word begins with is a token run of its own if it is of printable ASCII signs without
        apostrophes, and ASCII letters lose their case, so such words share their ids with the bare lower-case word."""
        memo = self.memo
        if len(memo) + len(words) > MEMO_WORDS:
            memo.clear()
            memo[""] = b""
        parts, cores = [], set()
        for word in words:
            core = word.rstrip(SIGNS)
            if not (core.isalpha() and (core.isascii() or core.lower().isalpha())):  # a dotted capital I becomes two characters, the second no letter
                memo[word] = self.ids(word)
                continue
            tail = word[len(core) :]
            if tail not in memo:
                memo[tail] = self.ids(tail)
            if core.isascii():
                core = core.lower()
            if core not in memo:
                cores.add(core)
            if core != word:
                parts.append((word, core, tail))
        plain = [core for core in cores if core.isascii()]
        for tokenizer, some in ((self.plain, plain), (self.tokenizer, list(cores.difference(plain)))):
            for at in range(0, len(some), 1000):
                self._learn_letters(tokenizer, some[at : at + 1000])
        for word, core, tail in parts:
            memo[word] = memo[core] + memo[tail]

    def _learn_letters(self, tokenizer, cores: list[str]) -> None:
        """A run of letters is one unit of the tokenizer, whose last token alone is a word's end."""
        np = self.np
        ids = np.array(tokenizer.encode_batch_fast([" ".join(cores)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(cores):
            raw, start = ids.tobytes(), 0
            for core, stop in zip(cores, (cuts * 4).tolist()):
                self.memo[core] = raw[start:stop]
                start = stop
        else:
            for core in cores:
                self.memo[core] = self.ids(core)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        for at in range(0, len(split), 64):
            some = split[at : at + 64]
            missing = set().union(*some).difference(self.memo)
            if missing:
                self.learn(missing)
            for words in some:
                try:
                    yield b"".join(map(self.memo.__getitem__, words))
                except KeyError:  # one text with more words than the memo holds
                    yield b"".join(self.memo[w] if w in self.memo else self.ids(w) for w in words)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of ids, four bytes each."""
    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[at : at + 4 * capacity]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document: (doc_id, piece, start, length, ids_crc32)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode_all([t or "" for t in batch.column(1).to_pylist()])):
                for found in cut(ids + end, capacity):
                    for column, value in zip(rows, (doc, *found)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pieces, PIECES)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Rows (length, rank_from, rank_to, per_sequence, first_sequence, first_offset): pieces of that length with ranks in
    [rank_from, rank_to) go, per_sequence at a time, to sequences from first_sequence on, from first_offset on.
    Open sequences are kept as runs of consecutive numbers by their room. Best fit puts the next piece where least
    room stays, so it fills one sequence of the tightest room as often as the piece fits before it takes the next.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(first: int, sequences: int, each: int, free: int) -> None:
            nonlocal left, rank
            plan.append((length, rank, rank + sequences * each, each, first, capacity - free))
            rank, left = rank + sequences * each, left - sequences * each
            room[free - each * length].append((first, sequences))

        for free in range(length, capacity + 1):
            each = free // length
            while left and room[free]:
                first, sequences = room[free].pop()
                if whole := min(sequences, left // each):
                    put(first, whole, each, free)
                if whole < sequences:
                    if left:  # fewer than each
                        put(first + whole, 1, left, free)
                        whole += 1
                    if whole < sequences:
                        room[free].append((first + whole, sequences - whole))
            if not left:
                break
        if left:
            each = capacity // length
            if whole := left // each:
                put(opened, whole, each, capacity)
                opened += whole
            if left:
                put(opened, 1, left, capacity)
                opened += 1
    return plan


PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "rank_from", "rank_to", "per_sequence", "first_sequence", "first_offset")])


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """pieces with rank, from 0 and gapless within each length; any one length is spread over many cells."""
    cells = rows_per_cell_salt(total)
    salted = pieces.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int"))
    sizes = salted.groupBy("length", "cell").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("length", "cell", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "cell").orderBy("row"))
    return salted.withColumn("inside", inside).join(starts, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("row", "cell", "before", "inside")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of docs with (sequence_id, offset): as few sequences as best-fit decreasing makes of them."""
    spark: SparkSession = docs.sparkSession
    # The row number tells pieces of repeated rows apart, so that they are dealt over all cells.
    pieces = store(token_pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    plan = best_fit_plan(counts, capacity)
    slots = spark.createDataFrame(plan, PLAN)
    rows, keys = ranked(pieces, sum(counts.values())), ["length"]
    if len(plan) <= BROADCAST_PLAN_ROWS:
        slots = F.broadcast(slots)
    else:
        cell = lambda rank: F.floor(rank / CELL_RANKS)
        slots = slots.withColumn("cell", F.explode(F.sequence(cell(F.col("rank_from")), cell(F.col("rank_to") - 1))))
        rows, keys = rows.withColumn("cell", cell(F.col("rank"))), ["length", "cell"]
    p, s = rows.alias("p"), slots.alias("s")
    here = (F.col("p.rank") >= F.col("s.rank_from")) & (F.col("p.rank") < F.col("s.rank_to"))
    placed = p.join(s, [here, *[F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys]])
    nth = F.col("p.rank") - F.col("s.rank_from")
    return placed.select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32",
        (F.col("s.first_sequence") + F.floor(nth / F.col("s.per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("s.first_offset") + nth % F.col("s.per_sequence") * F.col("p.length")).cast("long").alias("offset"),
    )
