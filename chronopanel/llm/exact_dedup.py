"""Exact duplicates by a content sort, with DataFrame operations only.

Rows are range-partitioned at sampled splitters of their normalised bytes: a short head routes, so that the sample stays small, and a
hash of the whole text parts the texts of a common head. An external sort by the whole text and the id puts equal texts next to each
other, and each row is compared in full with its neighbour: where it differs a run opens, and its first row has the smallest id.

A text of more rows than HOT_ROWS is counted beforehand (by hash, on 16 bytes a row) and gets salts, so that its rows are several runs
in several tasks; the first rows of these runs, a few a text, are compared in full again. No other row is looked at twice.

Defined cases: a null text is an empty text; a null doc_id sorts last and stays only where its text has no other id; of
repeated rows (equal id and text) one is kept; texts are compared whole, however long; an empty table gives no rows. Other columns are
ignored by classes and kept by deduplicated, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed_row, staged, text_or_empty

HEAD_BYTES = 32
HOT_ROWS = 16_384
MAX_HOT = 1_000_000  # rows of the broadcast table of hot texts, 12 bytes each
#: Only what differs from one single space is replaced; the result is that of replacing each run of [\x20\x09-\x0D].
_RUN = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, _RUN, " ")


def hot_texts(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(h, salts) of the texts of more than hot_rows rows, at most MAX_HOT; None where there are none."""
    least = max(hot_rows, docs.count() // MAX_HOT)
    counts = docs.select(F.xxhash64(normalised(text_or_empty())).alias("h")).groupBy("h").count()
    hot = staged(counts.filter(F.col("count") > least).select("h", F.ceil(F.col("count") / hot_rows).cast("int").alias("salts")), "exact-hot")
    return hot if hot.head(1) else None


PLACE, SALTED = ("head", "h"), ("head", "h", "salt")


def sorted_rows(rows: DataFrame, place: tuple[str, ...] = PLACE) -> DataFrame:
    """rows (row: a struct with doc_id and text, h, perhaps salt) in content order, with norm, run (its number) and opens (its first row)."""
    head = F.substring(normalised(F.coalesce("row.text", F.lit(""))).cast("binary"), 1, HEAD_BYTES)
    ranged = rows.withColumn("head", head).repartitionByRange(*place)  # satisfies the windows' distribution: no other exchange
    ranged = ranged.withColumn("norm", normalised(F.coalesce("row.text", F.lit(""))))
    order = Window.partitionBy(*place).orderBy("norm", F.col("row.doc_id").asc_nulls_last())
    placed = ranged.withColumn("opens", ~F.col("norm").eqNullSafe(F.lag("norm").over(order)))
    return placed.withColumn("run", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _split(docs: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The sorted rows of ordinary texts, and those of hot ones with salts."""
    hot = hot_texts(docs, hot_rows)
    rows = docs.select(packed_row(docs).alias("row"), F.xxhash64(normalised(text_or_empty())).alias("h"))
    if hot is None:
        return sorted_rows(rows), None
    salt = F.pmod(F.hash("row.doc_id"), F.col("salts"))
    return (
        sorted_rows(rows.join(F.broadcast(hot), "h", "left_anti")),
        sorted_rows(rows.join(F.broadcast(hot), "h").select("row", "h", salt.alias("salt")), SALTED),
    )


def _runs(placed: DataFrame, place: tuple[str, ...] = PLACE) -> DataFrame:
    """doc_id, keep_id, group_size, opens, text_sha256 of every row, by its run alone; what tells runs apart."""
    slim = placed.select("row.doc_id", *place, "run", "opens", "norm", F.sha2("norm", 256).alias("text_sha256"))
    slim = slim.withColumn("norm", F.when(F.col("opens"), F.col("norm")))
    of_run = Window.partitionBy(*place, "run")
    return slim.select("*", F.min("doc_id").over(of_run).alias("keep_id"), F.count(F.lit(1)).over(of_run).alias("group_size"))


def classes(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    ordinary, hot = _split(docs.select("doc_id", "text"), hot_rows)
    out = _runs(ordinary).select("doc_id", "keep_id", "group_size", F.col("opens").alias("kept"), "text_sha256")
    if hot is None:
        return out
    # Of each hot text the first rows of its runs are compared in full; the runs learn what the text has as a whole.
    runs = staged(_runs(hot, SALTED), "exact-hot-runs")
    key = [*SALTED, "run"]
    whole = runs.filter("opens").groupBy("norm").agg(F.min("keep_id").alias("least"), F.sum("group_size").alias("total"), F.min(F.struct(F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("id"), "salt")).alias("at"), F.collect_list(F.struct(*key)).alias("runs"))
    whole = staged(whole.select("least", "total", F.col("at.salt").alias("first_salt"), F.explode("runs").alias("r")).select("least", "total", "first_salt", "r.*"), "exact-hot-texts")
    joined = runs.join(whole, key)
    kept = F.col("opens") & (F.col("salt") == F.col("first_salt"))
    return out.unionByName(joined.select("doc_id", F.col("least").alias("keep_id"), F.col("total").alias("group_size"), kept.alias("kept"), "text_sha256"))


def deduplicated(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of docs that stay, with all their columns; texts are shuffled once."""
    ordinary, hot = _split(docs, hot_rows)
    out = ordinary.filter("opens").select("row.*")
    if hot is None:
        return out
    first = staged(hot.filter("opens").select("row", "norm"), "exact-hot-first")  # a row a run
    order = Window.partitionBy("norm").orderBy(F.col("row.doc_id").asc_nulls_last())
    return out.unionByName(first.withColumn("n", F.row_number().over(order)).filter("n = 1").select("row.*"))
