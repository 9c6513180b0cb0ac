"""Sources and sinks: JSON lines, annotation folders, caches, manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines by a given schema; a missing path is an empty table, blank and malformed lines are skipped."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_annotations(spark: SparkSession, glob: str, pair_schema: str) -> DataFrame:
    """The pairs of all annotation files; of a pair in several files that of the last file counts."""
    raw = spark.read.schema(f"annotator string, model string, pairs array<{pair_schema}>").option("multiLine", True).json(glob)
    rows = raw.select(F.input_file_name().alias("file"), "annotator", F.explode("pairs").alias("p")).select("file", "annotator", "p.*")
    last = F.row_number().over(Window.partitionBy("annotator", "id").orderBy(F.desc("file")))
    return rows.withColumn("rn", last).where("rn = 1").drop("rn", "file")


def union_corpora(*parts: DataFrame) -> DataFrame:
    """All rows that have a bucket; columns that a part lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.where(F.col("bucket").isNotNull())


def write_manifest(rows: DataFrame, path: str, drop: tuple[str, ...] = ("text",)) -> None:
    rows.drop(*drop).write.mode("overwrite").json(path)


def write_batches(rows: DataFrame, path: str, hide: tuple[str, ...] = ()) -> None:
    """A folder per value of batch, without the columns that annotators must not see."""
    rows.drop(*hide).write.mode("overwrite").partitionBy("batch").json(path)


def markdown(rows: DataFrame, digits: int = 2) -> str:
    """A report table of a summary, which has a row per transform."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows.collect()])
