"""SentencePiece encoding and decoding over a relational lattice.

Texts are split into units that no piece of the model reaches across: before each run of white-space marks and, if the model's pieces keep
letters and other characters apart, between these. The distinct units explode into their substrings of at most the longest piece's
length, an equi-join with the piece table (a few ten thousand rows, broadcast) keeps those that are pieces, and the edges are grouped by unit. A
fold with aggregate() then picks the path: for a unigram model Viterbi, the best sum of scores up to each position; for a BPE model, whose
ids are not those of the best sum, the merges over the same edges, in order of their scores and the leftmost first. One pass over the ordered edges
does all merges if each piece comes out of its own characters by such a pass, which is tested when the model is read;
else every step looks for the best merge anew.

Texts are neither copied nor shuffled. Their table is read twice, by file and row number: a part is a run of rows of a file. The first pass gives each part's distinct
units, so that a frequent unit is one row a part; units meet once, are encoded, and go back as one dictionary a part, which is written to the shared
folder. The second pass puts each text together from its part's dictionary. Docs that are no plain table of files are stored first.

Characters without a piece become their UTF-8 bytes' pieces. Units of any length take the same way.

Defined cases: null gives null ids, empty text no ids; repeated rows give repeated results; an empty table gives an empty result; other columns
are ignored unless named in keep; a literal U+2581 reads as a space, as in the library.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import by_bytes, filesystem, new_path, selector, store

MARK = "▁"
#: Rows of a part.
PART_ROWS = 32768
#: Units that a task takes through the lattice.
TASK_UNITS = 40_000
#: Units of the dictionaries that a task writes.
BOOK_UNITS = 400_000
#: Bytes of texts that are put together at once, unless one text has more.
TEXT_BYTES = 4 << 20
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6


#: A letter: of the word characters neither digits and the underscore nor other numbers, such as superscripts.
LETTER = r"[^\W\d_" + "".join(chr(c) for c in range(0x10000) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()) + "]"


class Model:
    """The table of pieces and what else a model file says."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.path, self.kind = path, proto.trainer_spec.model_type
        self.rows = [(k, p.piece, float(p.score), int(p.type)) for k, p in enumerate(proto.pieces)]

    @property
    def pieces(self) -> list[tuple[str, int, float]]:
        return [(piece, k, score) for k, piece, score, kind in self.rows if kind == NORMAL]

    @functools.cached_property
    def units(self) -> str:
        """The pattern of a unit: pieces have marks in front alone, or are of marks, and it is checked whether they mix letters and others."""
        bodies = [body for piece, _, _ in self.pieces if (body := piece.lstrip(MARK))]
        if any(MARK in body for body in bodies):
            return "(?s:.+)"
        mixed = re.compile(f"{LETTER}(?!{LETTER}).|(?!{LETTER}).{LETTER}", re.DOTALL)
        if any(mixed.search(body) for body in bodies):
            return f"{MARK}*[^{MARK}]+|{MARK}+"
        return f"{MARK}*{LETTER}+|{MARK}*(?:(?!{LETTER})[^{MARK}])+|{MARK}+"

    @functools.cached_property
    def late(self) -> list[str] | None:
        """The pieces that do not come out of their characters when edges are taken once, by descending score and from the left; null if one holds another."""
        score = {piece: x for piece, _, x in self.pieces}

        def whole(piece: str) -> bool:
            n, cuts = len(piece), [True] * (len(piece) + 1)
            for _, a, b in sorted((-score[piece[a:b]], a, b) for a in range(n) for b in range(a + 2, n + 1) if piece[a:b] in score):
                if cuts[a] and cuts[b] and sum(cuts[a + 1 : b]) == 1:
                    cuts[a + 1 : b] = [False] * (b - a - 1)
            return sum(cuts) == 2

        found = [piece for piece in score if not whole(piece)]
        return found if len(found) <= 50 and not any(x in y and x != y for x in found for y in found) else None

    @property
    def byte_ids(self) -> list[int]:
        """Ids of the bytes 0 to 255, or the unknown id for each."""
        at = {piece: k for k, piece, _, kind in self.rows if kind == BYTE}
        unknown = next((k for k, _, _, kind in self.rows if kind == UNKNOWN), 0)
        return [at.get(f"<0x{b:02X}>", unknown) for b in range(256)]

    @property
    def hex(self) -> list[str]:
        """UTF-8 bytes of each id in hex; control ids have none."""
        out = []
        for _, piece, _, kind in self.rows:
            out.append(piece.encode().hex() if kind == NORMAL else piece[3:5] if kind == BYTE else "20e2818720" if kind == UNKNOWN else "")
        return out


def marked(text: str) -> str:
    """With marks for spaces and one in front."""
    return MARK + text.replace(" ", MARK) if text else ""


#: both: the bits of the places that an edge starts and ends at; span: these and the bits between. They hold in words of up to BIT_PLACES characters.
EDGE = "array<struct<start:int,end:int,id:int,score:double,both:bigint,span:bigint>>"
BIT_PLACES = 62


def bits_from(place: Column) -> Column:
    """All bits from a place on."""
    return F.call_function("shiftleft", F.lit(-1).cast("long"), place.cast("int"))


def lattice(distinct: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, edges, and other columns of distinct) of every word: the occurrences of pieces in it by their places, and each character without a piece, whose id is null."""
    others = [c for c in distinct.columns if c != "word"]
    starts = distinct.select("*", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    parts = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("at") + 1))).alias("n"))
    parts = parts.select("word", *others, F.col("at").cast("int").alias("at"), F.col("n").cast("int").alias("n"), F.substring("word", F.col("at"), F.col("n")).alias("piece"))
    found = parts.join(F.broadcast(pieces), "piece", "left").where("id is not null or n = 1")
    start, end = F.col("at") - 1, F.col("at") + F.col("n") - 1
    span = bits_from(start).bitwiseAND(F.bitwise_not(bits_from(end + 1)))
    both = span.bitwiseAND(F.bitwise_not(bits_from(start + 1).bitwiseAND(F.bitwise_not(bits_from(end)))))
    edge = F.struct(start.alias("start"), end.alias("end"), "id", "score", both.alias("both"), span.alias("span"))
    return found.groupBy("word").agg(F.sort_array(F.collect_list(edge)).cast(EDGE).alias("edges"), *[F.first(c).alias(c) for c in others])


def piece_or_bytes(word: Column, start: Column, end: Column, id_: Column, byte_ids: list[int]) -> Column:
    """array<int> of a step of the path."""
    table = F.split(F.lit(" ".join(map(str, byte_ids))), " ").cast("array<int>")
    raw = F.hex(F.substring(word, start + 1, end - start).cast("binary"))
    return F.when(id_.isNotNull(), F.array(id_)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda k: F.element_at(table, F.conv(F.substring(raw, k, F.lit(2)), 16, 10).cast("int") + 1))
    )


def viterbi(word: Column, edges: Column, byte_ids: list[int], unknown_score: float) -> Column:
    """Ids of the path with the best sum of scores; a character without a piece costs unknown_score. Ties go to the longer last piece. One fold over the edges by their ends: the state has the best way to each
    place so far, and the best one yet to the place that the edges now end at."""
    n = F.length(word)
    WAY = "struct<best:double,from:int,id:int>"
    way = lambda best, start, id_: F.struct(best.alias("best"), start.cast("int").alias("from"), id_.cast("int").alias("id")).cast(WAY)
    bind = lambda value, fn: F.transform(F.array(value), fn)[0]  # noqa: E731  computes a value once that fn uses often
    by_end = F.array_sort(F.transform(edges, lambda e: F.struct(e["end"].alias("end"), e["start"].alias("start"), e["id"].alias("id"), F.coalesce(e["score"], F.lit(unknown_score)).alias("score"))))
    start = F.struct(F.array().cast(f"array<{WAY}>").alias("done"), way(F.lit(0.0), F.lit(-1), F.lit(None)).alias("now"), F.lit(0).alias("end")).cast(f"struct<done:array<{WAY}>,now:{WAY},end:int>")

    def step(acc: Column, e: Column) -> Column:
        moved = e["end"] > acc["end"]
        done = F.when(moved, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])

        def taken(d: Column) -> Column:
            new = way(F.element_at(d, e["start"] + 1)["best"] + e["score"], e["start"], e["id"])
            return F.struct(d.alias("done"), F.when(moved | (new["best"] > acc["now"]["best"]), new).otherwise(acc["now"]).alias("now"), e["end"].cast("int").alias("end"))

        return bind(done, taken).cast(f"struct<done:array<{WAY}>,now:{WAY},end:int>")

    states = F.aggregate(by_end, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    back = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(n.cast("int").alias("at"), F.array().cast("array<int>").alias("out"), states.alias("s")),
        lambda acc, _: F.when(acc["at"] <= 0, acc).otherwise(
            F.struct(
                F.element_at(acc["s"], acc["at"] + 1)["from"].alias("at"),
                F.concat(piece_or_bytes(word, F.element_at(acc["s"], acc["at"] + 1)["from"], acc["at"], F.element_at(acc["s"], acc["at"] + 1)["id"], byte_ids), acc["out"]).alias("out"),
                acc["s"].alias("s"),
            )
        ),
        lambda acc: acc["out"],
    )
    return back


def in_order(word: Column, edges: Column, byte_ids: list[int], late: list[int], has_late: Column | None = None) -> Column:
    """Ids of the BPE path by one pass over the edges, best score and leftmost first. The state has a 1 for each place that is cut and a 0 for each that is not, as the bits of a number or, in words of more
    places, as a string; an edge merges if it spans two cut places with one between. A merge makes no edge of a better score able, but for those of late pieces around it, which are asked right after it.
    has_late: whether a word has late pieces, if that is known."""
    EDGES = "array<struct<order:double,start:int,end:int,both:bigint,span:bigint>>"
    sized = lambda es: F.sort_array(F.transform(es, lambda e: F.struct((-e["score"]).alias("order"), e["start"].alias("start"), e["end"].alias("end"), e["both"].alias("both"), e["span"].alias("span")))).cast(EDGES)
    by_score = sized(F.filter(edges, lambda e: e["end"] - e["start"] > 1))
    if late:
        around = sized(F.filter(edges, lambda e: e["id"].isin(late)))
        asked = lambda e: F.concat(F.array(e), F.filter(around, lambda u: (u["order"] <= e["order"]) & (u["start"] <= e["start"]) & (u["end"] >= e["end"])))
        has_late = F.exists(edges, lambda e: e["id"].isin(late)) if has_late is None else has_late
        by_score = F.when(has_late, F.flatten(F.transform(by_score, asked))).otherwise(by_score)

    def step(cuts: Column, e: Column) -> Column:
        able = F.substring(cuts, e["start"] + 1, e["end"] - e["start"] + 1).rlike("^10*10*1$")
        return F.when(able, F.concat(F.substring(cuts, F.lit(1), e["start"] + 1), F.repeat(F.lit("0"), e["end"] - e["start"] - 1), F.substring(cuts, e["end"] + 1, F.length(cuts)))).otherwise(cuts)

    def bit_step(cuts: Column, e: Column) -> Column:
        able = (cuts.bitwiseAND(e["both"]) == e["both"]) & (F.bit_count(cuts.bitwiseAND(e["span"])) == 3)
        return F.when(able, cuts.bitwiseAND(e["both"].bitwiseOR(F.bitwise_not(e["span"])))).otherwise(cuts)

    bits = F.aggregate(by_score, F.bitwise_not(bits_from(F.length(word) + 1)), bit_step)
    bind = lambda value, fn: F.transform(F.array(value), fn)[0]  # noqa: E731  computes a value once that fn uses often
    short = bind(bits, lambda c: F.filter(edges, lambda e: (c.bitwiseAND(e["both"]) == e["both"]) & (F.bit_count(c.bitwiseAND(e["span"])) == 2)))
    long = path_ids(word, edges, F.aggregate(by_score, F.repeat(F.lit("1"), F.length(word) + 1), step), byte_ids)
    return F.when(F.length(word) <= BIT_PLACES, ids_of(word, short, byte_ids)).otherwise(long)


def merges(word: Column, edges: Column, byte_ids: list[int]) -> Column:
    """Ids of the BPE path of any table of pieces: every step merges the edge of the best score, the leftmost among equals, of all that are able then."""

    def step(cuts: Column, _: Column) -> Column:
        able = F.filter(edges, lambda e: F.substring(cuts, e["start"] + 1, e["end"] - e["start"] + 1).rlike("^10*10*1$"))
        best = F.array_min(F.transform(able, lambda e: F.struct((-e["score"]).alias("order"), e["start"].alias("start"), e["end"].alias("end"))))
        joined = F.concat(F.substring(cuts, F.lit(1), best["start"] + 1), F.repeat(F.lit("0"), best["end"] - best["start"] - 1), F.substring(cuts, best["end"] + 1, F.length(cuts)))
        return F.coalesce(joined, cuts)

    return path_ids(word, edges, F.aggregate(F.sequence(F.lit(1), F.length(word)), F.repeat(F.lit("1"), F.length(word) + 1), step), byte_ids)


def path_ids(word: Column, edges: Column, cuts: Column, byte_ids: list[int]) -> Column:
    """The ids of the edges, sorted by place, between neighbouring cuts."""
    bind = lambda value, fn: F.transform(F.array(value), fn)[0]  # noqa: E731  computes a value once that fn uses often
    path = bind(cuts, lambda c: F.filter(edges, lambda e: F.substring(c, e["start"] + 1, e["end"] - e["start"] + 1).rlike("^10*1$")))
    return ids_of(word, path, byte_ids)


def ids_of(word: Column, path: Column, byte_ids: list[int]) -> Column:
    """The ids of edges that follow each other."""
    bind = lambda value, fn: F.transform(F.array(value), fn)[0]  # noqa: E731  computes a value once that fn uses often
    parts = lambda p: F.flatten(F.transform(p, lambda e: piece_or_bytes(word, e["start"], e["end"], e["id"], byte_ids)))
    return bind(path, lambda p: F.when(F.exists(p, lambda e: e["id"].isNull()), parts(p)).otherwise(F.transform(p, lambda e: e["id"])))


def word_ids(distinct: DataFrame, model: Model) -> DataFrame:
    """distinct (word, ...) with ids."""
    table = distinct.sparkSession.createDataFrame(model.pieces, "piece string, id int, score double")
    found = lattice(distinct, table, max(len(p[0]) for p in model.pieces))
    w, e = F.col("word"), F.col("edges")
    if model.kind == UNIGRAM:
        ids = viterbi(w, e, model.byte_ids, min(p[2] for p in model.pieces) - 10.0)  # the cost of the unknown is the library's
    elif model.late is None:
        ids = merges(w, e, model.byte_ids)
    else:
        at = {piece: k for piece, k, _ in model.pieces}
        ids = in_order(w, e, model.byte_ids, [at[piece] for piece in model.late], functools.reduce(Column.__or__, [w.contains(piece) for piece in model.late], F.lit(False)))
    return found.select(*distinct.columns, ids.alias("ids"))


def by_part(table: DataFrame, text_col: str, keep: tuple[str, ...], part_rows: int) -> DataFrame:
    """(_keep, _text, part) of a table of files; part names a run of rows of a file by a hash; runs of one hash would share a dictionary."""
    block = F.concat_ws("#", "_metadata.file_path", F.floor(F.col("_metadata.row_index") / part_rows).cast("string"))
    return table.select(F.struct(F.lit(0).alias("_"), *keep).alias("_keep"), F.col(text_col).alias("_text"), F.xxhash64(block).alias("part"))


class Splitter:
    """The units of texts. A text whose spaces stand one by one between other characters is cut at these, and each distinct chunk is cut into units once."""

    def __init__(self, pattern: str):
        self.unit = re.compile(pattern)
        self.by_chunk = self.unit.findall(f"a{MARK}b") == ["a", f"{MARK}b"]  # a mark begins a unit

    def chunks(self, text: str) -> list[str] | None:
        if not self.by_chunk or "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            return None
        return text.split(" ")

    def of_chunk(self, chunk: str) -> list[str]:
        return self.unit.findall(MARK + chunk)

    def of_text(self, text: str) -> list[str]:
        return self.unit.findall(marked(text))


class Book(dict):
    """Ids by chunk, made from those of units when a chunk is first met."""

    def __init__(self, known: dict[str, bytes], splitter: Splitter):
        super().__init__()
        self.known, self.splitter = known, splitter

    def __missing__(self, chunk: str) -> bytes:
        found = self[chunk] = b"".join(map(self.known.__getitem__, self.splitter.of_chunk(chunk)))
        return found

    def ids(self, text: str) -> bytes:
        if (chunks := self.splitter.chunks(text)) is not None:
            return b"".join(map(self.__getitem__, chunks))
        return b"".join(map(self.known.__getitem__, self.splitter.of_text(text)))


def part_units(texts: DataFrame, pattern: str) -> DataFrame:
    """(part, word): the distinct units of each part. A part that two tasks read may list a unit twice."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, part, chunks, seen = Splitter(pattern), None, set(), set()

        def flush():
            for chunk in chunks:
                seen.update(splitter.of_chunk(chunk))
            listed = list(seen)
            for at in range(0, len(listed), 1 << 16):
                some = listed[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int64()), pa.array(some, pa.string())], names=["part", "word"])

        for batch in batches:
            for now, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now != part:
                    yield from flush()
                    part, chunks, seen = now, set(), set()
                if text:
                    if (found := splitter.chunks(text)) is not None:
                        chunks.update(found)
                    else:
                        seen.update(splitter.of_text(text))
        yield from flush()

    return texts.select("part", "_text").mapInArrow(split, "part long, word string")


def write_books(texts: DataFrame, model: Model, path: str) -> None:
    """The dictionary of each part, in a folder of its name: (word, ids)."""
    listed = store(part_units(texts, model.units), "pieces-units")
    total = listed.count()
    tasks = max(1, total // TASK_UNITS)
    # A number of tasks of its own, as few bytes become many edges. The lattice holds words alone; where a word is asked for meets its ids in the partition both are in, by sorting, so that
    # rows of a word go on side by side and take little room.
    asked = listed.repartition(tasks, "word")
    words = asked.groupBy("word").agg(F.min("part").alias("_some")).where("_some is not null").select("word")  # asks for both columns, so that both sides read one exchange
    rows = asked.join(word_ids(words, model).hint("merge"), "word").select("part", "word", "ids")
    rows.repartition(max(1, total // BOOK_UNITS), "part").sortWithinPartitions("part").write.partitionBy("part").parquet(path)


def returned(ids: pa.ListArray, texts: pa.Array, table: pa.Array) -> pa.Array:
    """Whether the texts that ids stand for, decoded as decode() does, are these; true where both are null. table: the bytes of each id."""
    import numpy as np
    import pyarrow.compute as pc

    flat, offsets = table.take(ids.values), ids.offsets.to_numpy()
    ends = np.frombuffer(flat.buffers()[1], "<i8", len(flat) + 1, 8 * flat.offset)[offsets]  # of each text in the pieces' bytes, which follow each other
    found = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ends)), flat.buffers()[2]])
    found = pc.replace_substring(found, MARK.encode(), b" ")
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    # Of a space in front, which decode() takes away, the given text knows nothing.
    blank = pa.scalar(b"", pa.large_binary())
    same = pc.equal(found, pc.if_else(pc.starts_with(found, b" "), pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts, blank), texts))
    return pc.if_else(pc.and_(ids.is_null(), texts.is_null()), True, pc.fill_null(pc.if_else(ids.is_null(), False, same), False))


def put_together(texts: DataFrame, model: Model, path: str, schema: T.StructType, check: bool) -> DataFrame:
    """The texts with their ids from their parts' dictionaries. check: whether the ids give the text again, in place of the text."""
    pattern, pieces = model.units, [bytes.fromhex(x) for x in model.hex] if check else []

    def book_of(part: int) -> dict[str, bytes]:
        import numpy as np
        import pyarrow.parquet as pq

        system, root = filesystem(path)
        known: dict[str, bytes] = {}
        for found in system.get_file_info(selector(f"{root}/part={part}")):
            if found.path.endswith(".parquet"):
                with system.open_input_file(found.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(columns=["word", "ids"]):
                        lists = batch.column(1)
                        raw, ends = lists.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes(), (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
                        known.update(zip(batch.column(0).to_pylist(), map(raw.__getitem__, map(slice, ends, ends[1:]))))
        return known

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        splitter, part, book, table = Splitter(pattern), None, None, pa.array(pieces, pa.large_binary())
        for batch in (b for whole in batches for b in by_bytes(whole, 1, TEXT_BYTES)):
            out = []
            for now, text in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                if text and now != part:
                    part, book = now, None  # not two dictionaries at once
                    book = Book(book_of(now), splitter)
                out.append(None if text is None else book.ids(text) if text else b"")
            offsets = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in out])]).astype("<i4")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(x or b"" for x in out), "<i4")), mask=pa.array([x is None for x in out], pa.bool_()))
            shown = returned(ids, batch.column(1), table) if check else batch.column(1)
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), shown, ids], names=schema.names)

    return texts.select("_keep", "_text", "part").mapInArrow(encode, schema)


def encode(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = (), stored: bool = False, part_rows: int = PART_ROWS, check: bool = False) -> DataFrame:
    """keep's columns with text (as `_text`) and ids of every row. stored: docs is a table of files as read, which does not change. check: in place of the text, `round_trip`, whether the ids give it again."""
    spark = docs.sparkSession
    kept = docs.select(*keep).schema
    if not stored:
        docs = store(docs.select(F.struct(*keep, F.lit(0).alias("_")).alias("k"), F.col(text_col).alias("_text")), "pieces-rows")
        docs, keep, text_col = docs, tuple(f"k.`{c}`" for c in keep), "_text"
    texts, path = by_part(docs, text_col, keep, part_rows), new_path(spark, "pieces-books")
    write_books(texts, model, path)
    out = T.StructType([T.StructField("_", T.IntegerType()), *kept.fields, T.StructField("round_trip", T.BooleanType()) if check else T.StructField("_text", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return put_together(texts, model, path, out, check).drop("_")


def decode(ids: Column, model: Model) -> Column:
    """The text of ids; null for null."""
    table = F.split(F.lit(",".join(model.hex)), ",")
    joined = F.array_join(F.transform(ids, lambda k: F.element_at(table, k + 1)), "")
    text = F.replace(F.decode(F.unhex(joined), "UTF-8"), F.lit(MARK), F.lit(" "))
    return F.when(text.startswith(" "), F.substring(text, 2, 2147483647)).otherwise(text)
