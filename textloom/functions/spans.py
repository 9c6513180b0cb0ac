"""Spans of a text, as array<struct<start, end>> in code points, and edits that respect them.

Built-ins give matches without their places, and adding lengths up in an aggregate() copies its state at each step, so places come from Arrow-batched
functions that read a text once.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.functions import facts as fact
from textloom.functions import guarded, lexicon
from textloom.functions.marks import edit_words
from textloom.functions.matching import shared_runs

Span = tuple[int, int]
SPANS = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))

#: A fence opens with three or more of one mark and closes with as many of them at least, or at the end of the text.
FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})[^\n]*(?:\n|\Z)(?s:.*?)(?:^[ \t]{0,3}\1[^\n]*(?:\n|\Z)|\Z)", re.MULTILINE)
#: The brackets of what a template leaves to be filled in, and how much may stand in them on one line.
BRACKETS, MOST_INSIDE = {"[": "]", "{": "}", "<": ">"}, 40


def fences_of(text: str) -> list[Span]:
    return [m.span() for m in FENCE.finditer(text)]


def placeholders_of(text: str) -> list[Span]:
    """Brackets up to the next one that closes them."""
    out, at = [], 0
    while at < len(text):
        close = BRACKETS.get(text[at])
        end = text.find(close, at + 1, at + MOST_INSIDE + 2) if close else -1
        if end > at + 1 and "\n" not in text[at:end]:
            out.append((at, end + 1))
            at = end
        at += 1
    return out


def protected_of(text: str) -> list[Span]:
    """Code, addresses, mail, link targets, paths and placeholders, by start; overlaps stay."""
    places = [place for scan in guarded.FROM_REWRITERS for place in guarded.every(scan, text)]
    return sorted(fences_of(text) + places + placeholders_of(text))


def as_column(find: Callable[[str], list[Span]]):
    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else [{"start": a, "end": b} for a, b in find(t)] for t in batch.to_pylist()], to_arrow_type(SPANS))

    return spans


fence_spans = as_column(fences_of)
protected_spans = as_column(protected_of)
heading_spans = as_column(fact.heading_spans)


@F.arrow_udf(SPANS)
def fact_spans(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of a text in a language; null without a lexicon."""
    for texts, langs in batches:
        rows = zip(texts.to_pylist(), langs.to_pylist())
        yield pa.array([[{"start": a, "end": b} for a, b in fact.fact_spans_of(t, lang)] if t is not None and lang in lexicon.LANGUAGES else None for t, lang in rows], to_arrow_type(SPANS))


STOPS = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)")


def sentence_bounds(text: str) -> list[Span]:
    """Of the sentences that hold more than white space."""
    ends = [m.end() for m in STOPS.finditer(text)] + [len(text)]
    return [(a, b) for a, b in zip([0, *ends], ends) if text[a:b].strip()]


def sentences_at(text: str, places: list[int]) -> list[int]:
    """For each of the ascending places the sentence in which it is; the last, if it is behind all."""
    bounds = sentence_bounds(text)
    ends = [b for _, b in bounds[:-1]]
    return [bisect.bisect_right(ends, at) for at in places]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def sentence_of_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """For each letter word of a text the sentence in which it begins."""
    import regex

    word = regex.compile(r"[\p{L}\p{Nl}\p{No}]+")
    for batch in batches:
        yield pa.array([None if t is None else sentences_at(t, [m.start() for m in word.finditer(t)]) for t in batch.to_pylist()], pa.list_(pa.int32()))


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def changed_of(before: str, after: str) -> list[int]:
    """Which of after's words are in no run kept from before."""
    b = edit_words(after)
    kept = {k for _, start, size in shared_runs(edit_words(before), b) for k in range(start, start + size)}
    return [k for k in range(len(b)) if k not in kept]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def changed_words(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for before, after in batches:
        yield pa.array([None if a is None or b is None else changed_of(a, b) for a, b in zip(before.to_pylist(), after.to_pylist())], pa.list_(pa.int32()))


WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


@F.arrow_udf(T.StringType())
def replace_words(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The text with the words at the keys of map<int, string> replaced, all else as it is."""
    for texts, maps in batches:
        out = []
        for t, m in zip(texts.to_pylist(), maps.to_pylist()):
            put = dict(m or ())
            at = iter(range(len(t or "")))
            out.append(None if t is None else WORD.sub(lambda w: new if (new := put.get(next(at))) is not None else w[0], t))  # noqa: B023
        yield pa.array(out, pa.string())


MARKER = r"^[ \t]*(?:[-*+]|[0-9]+[.)]|#{1,6}|>)[ \t]+"


def keep_layout(before: Column, after: Column) -> Column:
    """after, with the list, heading and quote marks and the indentation of before's lines, if it has as many lines; else as it is."""
    old, new = F.split(before, "\n", -1), F.split(after, "\n", -1)

    def line(o: Column, n: Column) -> Column:
        mark = F.regexp_extract(o, MARKER, 0)
        lead = F.when(mark != "", mark).otherwise(F.regexp_extract(o, r"^[ \t]*", 0))
        return F.concat(lead, F.regexp_replace(F.regexp_replace(n, MARKER, ""), r"^[ \t]+", ""))

    return F.when(F.size(old) == F.size(new), F.array_join(F.zip_with(old, new, line), "\n")).otherwise(after)


#: A thinking block that does not end holds all the rest.
THINKING = re.compile(r"<think>.*?(?:</think>|\Z)", re.DOTALL)
FENCED = re.compile(r"```[a-zA-Z]*\s*\n(.*?)```", re.DOTALL)


def first_json(reply: str) -> str | None:
    """The first object or array that can be read in a model's reply, after its thinking block and within its fence if there is one."""
    plain = THINKING.sub("", reply)
    fenced = FENCED.search(plain)
    decoder = json.JSONDecoder()
    for body in ([fenced[1]] if fenced else []) + [plain]:
        for m in re.finditer(r"[{\[]", body):
            try:
                return json.dumps(decoder.raw_decode(body, m.start())[0], ensure_ascii=False)
            except ValueError:
                continue
    return None


@F.arrow_udf(T.StringType())
def reply_json(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if t is None else first_json(t) for t in batch.to_pylist()], pa.string())
