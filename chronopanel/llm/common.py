"""What the corpus operators share: text defaults, Arrow batch size and staged tables (those of the library)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.sources.staging import discard, fresh_path, release, shared_dir, staged

__all__ = ["discard", "fresh_path", "id_and_text", "kept_by_text", "only_of_one", "packed_row", "release", "shared_dir", "staged", "table", "text_or_empty", "tune"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long, and text without nulls."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def tune(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows: texts can be long, and a Python worker holds a batch at a time.

    Spark reads this setting when a plan starts, so it stays set for the session; results do not depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def packed_row(df: DataFrame) -> Column:
    """All columns of df in one struct, so that no name of theirs meets one of an operator."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def kept_by_text(docs: DataFrame, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of docs whose texts keep wants, with all their columns, in one pass over Arrow batches."""
    at, rows = docs.columns.index("text"), docs.select(packed_row(docs).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(0).field(at).to_pylist()), pa.bool_()))

    return rows.mapInArrow(run, rows.schema).select("row.*")


def only_of_one(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text hash are in kept (doc_id, row), one of each set of repeated rows, with all their columns."""
    keyed = docs.select(packed_row(docs).alias("whole"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("hash"))
    met = keyed.join(kept, keyed["id"].eqNullSafe(kept["doc_id"]) & (keyed["hash"] == kept["row"]))
    one = Window.partitionBy("id", "hash").orderBy(F.lit(0))
    return met.withColumn("n", F.row_number().over(one)).filter("n = 1").select("whole.*")
