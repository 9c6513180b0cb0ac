"""WARC archives with a two-level capture index.

Writing goes through Spark's text writer, whose commit protocol survives lost executors: a line is a record and the line
separator is the CRLF CRLF that ends one. A file holds a bounded number of records. Of records with equal payloads of
at least `revisit_bytes` bytes, the one with the largest page id is the response and the others are revisits that refer to it.

The index has two levels. Records' positions are read from the archives themselves, header by header. Their keys, the url with its
host reversed, are sorted by range, cut into blocks of lines and compressed; the directory keeps one row a block with its first and last key.
A look-up finds its blocks by binary search in the directory, reads the lines in them, and then only the byte ranges of its records.

Defined cases: a null page is empty; a null url has an empty key; equal payloads are told by SHA-1 and length; rows repeated whole are all
responses or all revisits of an equal row's page; an empty table makes an empty archive; other columns are ignored; control characters in a url are
percent-encoded in its header.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import filesystem, new_path, store

CRLF = "\r\n"
END = CRLF + CRLF
REVISIT_BYTES = 1000
RECORDS_PER_FILE = 4000
LINES_PER_BLOCK = 512
#: Bytes of archives that a task reads, where there are many.
TASK_BYTES = 128 << 20
#: Directories of more rows than this are searched by joining on ranges instead of being sent to the tasks (about 100 bytes a row).
DIRECTORY_ROWS = 200_000
#: Blocks in a run of the second level at least.
RUN_BLOCKS = 1_000
#: Groups of equal payloads up to this number are sent to every task (about 70 bytes a row), so that pages are not shuffled.
GROUP_ROWS = 200_000
DATE = "2000-01-01T00:00:00Z"


def surt(url: Column) -> Column:
    """The url with its host reversed: http://www.Example.com:80/a?b -> com,example,www:80)/a?b."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(rest, r"^[^/?#]*?(:[0-9]+)(?:[/?#]|$)", 1)
    path = F.regexp_replace(rest, r"^[^/?#]*", "")
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.regexp_replace(F.concat(reversed_host, port, F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path)), r"[\x00-\x20\x7f]", "+")


def typed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, bytes, digest, record_type, refers_to)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "first")
    groups = store(groups, "warc-groups")
    if groups.count() <= GROUP_ROWS:  # else the pages are shuffled, and a group with many copies is split by the adaptive join
        groups = F.broadcast(groups)
    joined = rows.join(groups, ["digest", "bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "bytes", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("null")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ((F.lit("-"),) if k else ()) + (F.substring(h, a, n),)], F.lit(">"))


def records(rows: DataFrame) -> DataFrame:
    """(value): the record without the CRLF CRLF that ends it."""
    revisit = F.col("record_type") == "revisit"
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, head).otherwise(F.concat(head, "payload"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x1f\x7f]", "%20"), " ", "%20")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to"), F.col("digest")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("X-Page-Id", F.col("page_id").cast("string")), line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")), line("X-Key", surt(F.col("url"))),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF),
    )
    return rows.select(F.concat(header, block).alias("value"))


def write(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, **columns) -> None:
    records(typed(pages, **columns)).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def open_file(path: str):
    system, at = filesystem(path)
    return system.open_input_file(at)


def headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip(" \t") for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split(CRLF)[1:]) if k}


def scan(file) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length, headers) of each record; payloads are skipped over."""
    size, at = file.size(), 0
    while at < size:
        raw, want = b"", 1024
        while (stop := raw.find(END.encode())) < 0:
            file.seek(at + len(raw))
            more = file.read(want)
            if not more:
                raise ValueError(f"a record header at byte {at} does not end")
            raw, want = raw + more, want * 2
        found = headers(raw[:stop])
        length = stop + 4 + int(found["content-length"])
        yield at, length, found
        at += length + 4


def archive_tasks(spark: SparkSession, path: str) -> int:
    """How many tasks read the archive: by its files' number and bytes, which say more than the small rows that name them."""
    files, size = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).agg(F.count("*"), F.sum("length")).first()
    return max(1, min(files, max(4 * spark.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES)))


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """(key, page_id, path, offset, length) of each record of the archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").repartition(archive_tasks(spark, path), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with open_file(name) as f:
                    for at, length, found in scan(f):
                        page = found.get("x-page-id")
                        rows.append((found.get("x-key", ""), int(page) if page else None, name, at, length))
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "path", "offset", "length"])

    return files.mapInArrow(read, "key string, page_id long, path string, offset long, length long")


def build_index(spark: SparkSession, path: str, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """The stored blocks: (first_key, last_key, number, lines, block), numbered in order. Without the column block it is the directory."""
    lines = store(index_lines(spark, path), "warc-lines")  # else the sample for the ranges would read the archives once more
    dealt = lines.repartitionByRange("key", "page_id", "path", "offset").sortWithinPartitions("key", "page_id", "path", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers = itertools.count(TaskContext.get().partitionId() << 32)

        def block(rows):
            lines = "\n".join("\t".join(map(str, r)) for r in rows).encode()
            values = (rows[0][0], rows[-1][0], next(numbers), len(rows), zlib.compress(lines))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["first_key", "last_key", "number", "lines", "block"])

        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= lines_per_block:
                yield block(held[:lines_per_block])
                held = held[lines_per_block:]
        if held:
            yield block(held)

    return store(dealt.mapInArrow(pack, "first_key string, last_key string, number long, lines long, block binary"), "warc-index")


LINES = "key string, page_id long, path string, offset long, length long"


def unpacked(raw: bytes) -> list[tuple]:
    lines = (line.split("\t") for line in zlib.decompress(raw).decode().split("\n"))
    return [(k, None if p == "None" else int(p), path, int(o), int(n)) for k, p, path, o, n in lines]


def lines_of(blocks: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                columns = list(zip(*unpacked(raw)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "path", "offset", "length"])

    return blocks.select("block").mapInArrow(read, LINES)


def look_up(index: DataFrame, urls: DataFrame, url_col: str = "url", most: int = DIRECTORY_ROWS) -> DataFrame:
    """The index lines of the captures of urls."""
    keys = urls.select(surt(F.col(url_col)).alias("key")).distinct()
    blocks = index.count()
    if blocks > most:
        return lines_of(blocks_by_runs(index, keys, max(RUN_BLOCKS, blocks // max(1, most)))).join(keys, "key", "left_semi")
    directory = sorted((r["first_key"], r["last_key"], r["number"]) for r in index.select("first_key", "last_key", "number").collect())
    hits = keys.mapInArrow(finder(directory), "number long, key string").select("number").distinct()
    return lines_of(index.join(hits, "number", "left_semi")).join(keys, "key", "left_semi")


def finder(directory: list[tuple[str, str, int]]):
    """The numbers of directory's ranges (first key, last key, number), in order, that hold a key, by binary search."""
    firsts, lasts, numbers = ([d[k] for d in directory] for k in range(3))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(numbers[at], key) for key in batch.column(0).to_pylist() for at in holding(firsts, lasts, key)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([k for _, k in out], pa.string())], names=["number", "key"])

    return find


def holding(firsts: list[str], lasts: list[str], key: str) -> Iterator[int]:
    at = bisect.bisect_left(lasts, key)
    while at < len(firsts) and firsts[at] <= key:
        yield at
        at += 1


def blocks_by_runs(index: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """The blocks that hold one of keys, over a directory that is too large for the driver: a second, sparser level has a row for each run of `size` blocks of a range. A key finds
    its run in it by binary search, and its blocks in the part of the directory that is the run's, in the run's own task."""
    # A block's number is its range's and its own within the range.
    run = F.shiftleft(F.shiftright("number", 32), 32) + F.floor(F.col("number").bitwiseAND(0xFFFFFFFF) / size)
    directory = store(index.select("first_key", "last_key", "number", run.cast("long").alias("run")), "warc-directory")
    sparse = directory.groupBy("run").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
    runs = sorted((r["first_key"], r["last_key"], r["run"]) for r in sparse.toLocalIterator())  # a row for `size` blocks, and one for each range
    asked = keys.mapInArrow(finder(runs), "number long, key string").withColumnRenamed("number", "run")

    def search(ask: pa.Table, own: pa.Table) -> pa.Table:
        found = sorted(zip(own.column("first_key").to_pylist(), own.column("last_key").to_pylist(), own.column("number").to_pylist()))
        firsts, lasts = [f[0] for f in found], [f[1] for f in found]
        return pa.table({"number": pa.array(sorted({found[at][2] for key in ask.column("key").to_pylist() for at in holding(firsts, lasts, key)}), pa.int64())})

    hits = asked.groupBy("run").cogroup(directory.groupBy("run")).applyInArrow(search, "number long")
    return index.join(hits.distinct(), "number", "left_semi")


CAPTURE = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def read_ranges(lines: DataFrame, tasks: int) -> DataFrame:
    """By so many tasks, the captures at the lines' byte ranges: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload). Digests of
    responses are computed from what was read and must be those in the header."""
    dealt = lines.select("path", "offset", "length").repartition(tasks, "path").sortWithinPartitions("path", "offset")
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def capture(raw: bytes) -> tuple:
        import hashlib

        top, _, block = raw.partition(END.encode())
        found = headers(top)
        http, _, payload = block.partition(END.encode())
        digest, kind = found["warc-payload-digest"].removeprefix("sha1:"), found["warc-type"]
        size = int(headers(http)["content-length"])
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"the payload of {found['warc-record-id']} does not have its digest")
        number = lambda name: int(found[name]) if found.get(name) else None
        return number("x-page-id"), found.get("warc-target-uri"), kind, number("x-refers-to-page-id"), size, digest, payload.decode() if kind == "response" else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, rows, held = None, None, [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            for path, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    if file:
                        file.close()
                    name, file = path, open_file(path)
                file.seek(at)
                rows.append(capture(file.read(length)))
                held += length
                if held > 8_000_000:
                    yield flush()
                    rows, held = [], 0
        if file:
            file.close()
        if rows:
            yield flush()

    return dealt.mapInArrow(read, CAPTURE)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes the pages, indexes the archive, looks the pages' urls up and reads every capture back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, **columns)
    return read_ranges(look_up(build_index(spark, path), pages, columns.get("url_col", "url")), archive_tasks(spark, path))
