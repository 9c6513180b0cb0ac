"""Rows of a paged HTTP service as a Spark source: each page is a partition, so executors fetch them side by side.

    spark.dataSource.register(PagedRows)
    spark.read.format("paged_rows").schema("row_idx long, text string").options(url=..., dataset=..., rows=2500).load()

Options: url; rows, how many to read from `offset` (0) on; page (100) rows a request; tries (5); wait (5) seconds, times the try's number, after a failed one; timeout (60) seconds; all others go
into the request. The service answers {"rows": [{"row_idx": 0, "row": {...}}], "num_rows_total": ...}. Columns that a row lacks are null.

A page that cannot be read in all tries fails the job (strict, the default). With strict=false it is one row, of its offset as row_idx, whose column `_error`, which the schema must
then have, says what was wrong: lost_pages() counts them, and nothing is lost unseen.

    spark.readStream.format("paged_rows").schema(...).options(url=..., per_batch=1000).load()

reads on from the offset that the checkpoint has, `per_batch` rows a batch at most (all that there are, if it is not given), as far as the service's number of rows, or `rows`, goes.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

OWN = ("url", "rows", "page", "tries", "wait", "timeout", "offset", "strict", "per_batch")
ERROR = "_error"


class LostPage(OSError):
    """A page that could not be read in all tries."""


class Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


class PagedRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "row_idx long, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStream(schema, dict(self.options))


class Pages:
    """What both readers share."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.options = schema.fieldNames(), options
        number = lambda k, usual: type(usual)(options.get(k, usual))
        self.first, self.rows, self.page = number("offset", 0), number("rows", 100), number("page", 100)
        self.tries, self.wait, self.timeout = number("tries", 5), number("wait", 5.0), number("timeout", 60.0)
        self.strict = str(options.get("strict", "true")).lower() != "false"
        if not self.strict and ERROR not in self.columns:
            raise ValueError(f"without strict the schema needs a column {ERROR} for what was wrong with lost pages")

    def between(self, first: int, last: int) -> list[Page]:
        return [Page(at, min(self.page, last - at)) for at in range(first, last, self.page)]

    def fetch(self, page: Page) -> dict:
        asked = {k: v for k, v in self.options.items() if k not in OWN} | {"offset": page.offset, "length": page.length}
        address, last = f"{self.options['url']}?{urllib.parse.urlencode(asked)}", None
        for k in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(address, timeout=self.timeout) as answer:
                    return json.load(answer)
            except (OSError, ValueError, urllib.error.URLError) as e:
                last = e
                time.sleep(self.wait * k)
        raise LostPage(f"rows {page.offset} to {page.offset + page.length - 1}: {type(last).__name__}: {last}")

    def read(self, partition: Page) -> Iterator[tuple]:
        try:
            found = self.fetch(partition).get("rows", [])
        except LostPage as e:
            if self.strict:
                raise
            found = [{"row_idx": partition.offset, "row": {ERROR: str(e)}}]
        for one in found:
            row = {"row_idx": one["row_idx"]} | one["row"]
            yield tuple(row.get(c) for c in self.columns)


class PagedReader(Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return self.between(self.first, self.first + self.rows)


class PagedStream(Pages, DataSourceStreamReader):
    """Offsets are row numbers; a batch is the pages between two of them, so a batch that is repeated asks for the same rows."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        super().__init__(schema, options)
        self.per_batch = int(options["per_batch"]) if "per_batch" in options else None
        self.at: int | None = None

    def initialOffset(self) -> dict:
        self.at = self.first
        return {"row": self.first}

    def total(self) -> int:
        """Behind the last row that there is to read."""
        if "rows" in self.options:
            return self.first + self.rows
        return int(self.fetch(Page(self.first, 1)).get("num_rows_total", self.first))

    def latestOffset(self) -> dict:
        last = self.total()
        if self.per_batch and self.at is not None:
            last = min(last, self.at + self.per_batch)
        self.at = max(last, self.at or 0)
        return {"row": self.at}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.at = end["row"]
        return self.between(start["row"], end["row"])

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["row"])


def lost_pages(rows: DataFrame) -> DataFrame:
    """(row_idx, _error) of the pages that could not be read; their number is its count."""
    return rows.where(F.col(ERROR).isNotNull()).select("row_idx", ERROR)
