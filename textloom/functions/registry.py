"""Transforms and detectors by name. A transform takes a text column and options and gives struct<text, counts, edits> columns, or, if it is a Python function of one text,
struct<text, counts, edits, error, seconds>: what it raises stays with its row. A detector gives a score column that is the higher the more machine-like.

Files of a folder can add more: each is run once, under a name of its own, and may call register(). A file that fails is kept in `failed` with the reason, and the
others are there all the same.
"""

from __future__ import annotations

import importlib.util
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.functions import cleaning, rewriting
from textloom.operators import assess


@dataclass(frozen=True)
class Options:
    """What changes a transform's output; the names are those of the digest."""

    model: str | None = None
    temperature: float | None = None
    seed: int | None = None
    stride: int | None = None
    span: int | None = None
    ngram_len: int = 5
    rules: tuple[str, ...] = ()
    language: str | None = "en"
    tokenaware: str | None = None
    min_coverage: float | None = None
    max_passes: int | None = None


Transform = Callable[[Column, Options], Column]
CAUGHT = (
    T.StructType().add("text", T.StringType()).add("counts", T.MapType(T.StringType(), T.IntegerType())).add("edits", T.IntegerType()).add("error", T.StringType()).add("seconds", T.DoubleType())
)


def told(e: Exception) -> str:
    """An exception on one line."""
    return " ".join(f"{type(e).__name__}: {e}".split())[:200]


def caught(fn: Callable[[str, Options], str | tuple[str, dict[str, int]]]) -> Transform:
    """A transform from a function of one text, which gives the new text, or it and counts of edits by kind. An exception ends its own row only, as that row's error; seconds are those of the call."""

    def transform(text: Column, options: Options) -> Column:
        @F.arrow_udf(CAUGHT)
        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([None if t is None else one(t) for t in batch.to_pylist()], to_arrow_type(CAUGHT))

        def one(t: str) -> dict:
            began = time.perf_counter()
            try:
                made = fn(t, options)
                new, counts = made if isinstance(made, tuple) else (made, {})
                if not isinstance(new, str):
                    raise TypeError(f"a transform gave {type(new).__name__}, not a text")
                out = {"text": new, "counts": list(counts.items()), "edits": sum(counts.values()), "error": None}
            except Exception as e:  # whatever a transform does wrong with a text, the others must be done
                out = {"text": None, "counts": None, "edits": None, "error": told(e)}
            return out | {"seconds": time.perf_counter() - began}

        return of(text)

    transform.catches = True
    return transform


@dataclass
class Registry:
    found: dict[str, Callable] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    read: set[str] = field(default_factory=set)

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def keep(fn: Callable) -> Callable:
            self.found[name] = fn
            return fn

        return keep

    def with_function(self, name: str, fn: Callable) -> Registry:
        """A registry that has a Python function of one text as well."""
        return Registry(self.found | {name: caught(fn)}, self.failed, self.read)

    def get(self, name: str) -> Callable:
        if name not in self.found:
            raise KeyError(f"{name!r} is not known; known are {', '.join(self.names())}")
        return self.found[name]

    def names(self) -> list[str]:
        return sorted(self.found)

    def read_folder(self, folder: str, context=None) -> None:
        """Runs the folder's files, each once; those whose names begin with an underscore are theirs alone. context: a SparkContext, whose executors get the files too."""
        names = sorted(n for n in os.listdir(folder) if n.endswith(".py") and not n.startswith("_")) if os.path.isdir(folder) else []
        for name in names:
            path = os.path.join(folder, name)
            if path in self.read:
                continue
            self.read.add(path)
            if context is not None:
                context.addPyFile(path)
            spec = importlib.util.spec_from_file_location(f"textloom_folder_{name[:-3]}", path)
            try:
                spec.loader.exec_module(importlib.util.module_from_spec(spec))
            except Exception as e:  # whatever is wrong with somebody's file, the rest must work
                self.failed[name] = told(e)


transforms, detectors = Registry(), Registry()


def result(text: Column, counts: Column, edits: Column) -> Column:
    return F.struct(text.alias("text"), counts.alias("counts"), edits.cast("int").alias("edits"))


@transforms.register("none")
def identity(text: Column, options: Options) -> Column:
    return result(text, F.create_map().cast("map<string,int>"), F.lit(0))


@transforms.register("unicode")
def plain_characters(text: Column, options: Options) -> Column:
    edits = cleaning.edits(text)
    return result(cleaning.plain_characters(text), F.create_map(F.lit("unicode"), edits.cast("int")), edits)


@transforms.register("rules")
def rules(text: Column, options: Options) -> Column:
    return rewriting.ruled(text, options.rules, options.language or "")


#: Detectors and the feature that each reads.
DETECTORS = {"binoculars": "binoculars", "fast_detectgpt": "fdg_oo", "fast_detectgpt_cross": "fdg_po", "perplexity": "nll_obs", "burstiness": "burstiness"}
for _name in DETECTORS:
    detectors.register(_name)(lambda features, name=_name: assess.oriented(F.lit(name), features[DETECTORS[name]]))
