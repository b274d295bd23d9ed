"""Variable-capacity best-fit packing.

A best fit of pieces in decreasing length depends on lengths only, so it runs on their histogram: as many numbers as the
largest capacity, whatever the number of documents. Equal bins are one segment with a multiplicity. Where no open bin
has room, the size that costs least per token it can be expected to hold is opened (a fixed overhead, its capacity and a
share of its square, against the pieces that are left and fit its rest); finally each bin shrinks to the smallest permitted capacity for its contents. Pieces then find their
bins by rank within their length, counted in salted parts, so that a hot length is not one task's work.

Documents longer than the largest capacity are cut into pieces of it; no token is dropped.

Defined cases: null and empty documents have no piece in a bin: among the places their row has null bin columns and length 0, among
the bins they do not occur; a null doc_id sorts first in ranks; equal lengths are ranked by id; repeated rows are packed each; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, staged, text_or_empty, tune

CAPACITIES = (2048, 4096, 8192, 16384)
OVERHEAD = 64  # cost of a bin beside its capacity, in tokens
ATTENTION = 1 / 65536  # cost of attention a squared token of capacity: it favours small bins, the overhead large ones
SALTS = 32  # parts of a length at least; a hot length has as many as keep them at PART rows
PART = 100_000
END = b"\xff"  # the end-of-text token among bytes


def byte_tokens(text: Column) -> Column:
    """Length under a byte-level vocabulary, end-of-text token included; an empty text has none."""
    n = F.octet_length(text)
    return F.when(n > 0, n + 1).otherwise(0)


def vocabulary_tokens(docs: DataFrame, ranks_path: str, pattern: str, max_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, tokens under a byte-pair vocabulary (a file of base64 tokens and ranks that Spark can read), end of text included.

    The file is read once and broadcast; its size is checked.
    """
    spark = docs.sparkSession
    data = spark.read.format("binaryFile").load(ranks_path).select("length", "content").first()
    if data["length"] > max_bytes:
        raise ValueError(f"{ranks_path} has more than {max_bytes} bytes")
    held = spark.sparkContext.broadcast(bytes(data["content"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) + 1 if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "tokens"])

    tune(spark)
    return id_and_text(docs).mapInArrow(run, "doc_id long, tokens long")


def opening(length: int, count: int, shorter: int, capacities: tuple[int, ...], overhead: int) -> int:
    """The capacity of least cost per token: shorter is what pieces below length hold together."""
    best = None
    for c in capacities:
        if c >= length:
            own = min(count, c // length) * length
            held = own + min(c - own, shorter)
            cost = (overhead + c + ATTENTION * c * c) / held
            if best is None or cost < best[0] - 1e-12:
                best = (cost, c)
    return best[1]


def plan_bins(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, per_bin, bin, base): the pieces of that length ranked lo <= r < hi go to bin + (r - lo) // per_bin, at base + (r - lo) % per_bin * length."""
    capacities = tuple(sorted(capacities))
    free: dict[int, list[tuple[int, int, int]]] = {}  # room left: (first bin, bins, tokens held)
    rooms: list[int] = []
    moves: list[tuple[int, int, int, int, int, int]] = []
    bins, left = 0, sum(k * n for k, n in histogram.items())

    def put(room: int, segment: tuple[int, int, int]) -> None:
        if room > 0:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append(segment)

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        left -= length * n
        while rank < n:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, many, held = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(k)
            else:
                room = opening(length, n - rank, left, capacities, overhead)
                # The choice stays the same while the pieces left would fill any size.
                spare = n - rank - capacities[-1] // length
                first, many, held = bins, max(0, spare) // (room // length) + 1, 0
                bins += many
            each = room // length
            full = min(many, (n - rank) // each)
            if full:
                moves.append((length, rank, rank + full * each, each, first, held))
                put(room - each * length, (first, full, held + each * length))
                rank += full * each
            if full < many:
                rest = min(n - rank, each - 1)
                if rest:
                    moves.append((length, rank, rank + rest, each, first + full, held))
                    put(room - rest * length, (first + full, 1, held + rest * length))
                    rank += rest
                    full += 1
                if full < many:
                    put(room, (first + full, many - full, held))
    return moves


def pieces(items: DataFrame, largest: int) -> DataFrame:
    """doc_id, piece, start, length: cuts of at most largest tokens; items: doc_id, tokens."""
    cut = items.filter("tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / largest).cast("int"))))
    return cut.select("doc_id", "piece", (F.col("piece").cast("long") * largest).alias("start"), F.least(F.lit(largest), F.col("tokens") - F.col("piece").cast("long") * largest).cast("int").alias("length"))


def pack(items: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, salts: int = SALTS) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset, bin_tokens, bin_capacity of every piece."""
    spark = items.sparkSession
    capacities = tuple(sorted(capacities))
    items = staged(items.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")), "pack-items")
    salts = max(salts, math.ceil(items.agg(F.sum(F.ceil(F.col("tokens") / capacities[-1]))).first()[0] or 0) // PART)
    cut = pieces(items, capacities[-1]).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = staged(cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most the largest capacity
    moves = spark.createDataFrame(plan_bins(histogram, capacities, overhead), "length int, lo long, hi long, per_bin int, bin long, base int")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    meets = (F.col("lo") < F.col("off") + F.col("n")) & (F.col("hi") > F.col("off"))
    held = parts.join(moves, "length").filter(meets).groupBy("length", "salt", "off").agg(F.collect_list(F.struct("lo", "hi", "per_bin", "bin", "base")).alias("moves"))
    # Parquet cuts the lineage, so the join below is a skew join where a length is hot.
    ranked = cut.join(staged(held, "pack-moves"), ["length", "salt"])
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = ranked.withColumn("r", F.col("off") + F.row_number().over(order) - 1)
    ranked = ranked.withColumn("m", F.element_at(F.filter("moves", lambda m: (m["lo"] <= F.col("r")) & (F.col("r") < m["hi"])), 1)).withColumn("k", F.col("r") - F.col("m.lo"))
    placed = ranked.select("doc_id", "piece", "start", "length", (F.col("m.bin") + F.floor(F.col("k") / F.col("m.per_bin"))).cast("long").alias("bin_id"), (F.col("m.base") + F.pmod("k", F.col("m.per_bin")) * F.col("length")).cast("int").alias("bin_offset"))
    sized = placed.withColumn("bin_tokens", F.sum("length").over(Window.partitionBy("bin_id")).cast("int"))
    size = F.lit(capacities[-1])
    for c in reversed(capacities[:-1]):
        size = F.when(F.col("bin_tokens") <= c, c).otherwise(size)
    sized = sized.withColumn("bin_capacity", size.cast("int"))
    none = items.filter("tokens = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("length"), *(F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "long"), ("bin_offset", "int"), ("bin_tokens", "int"), ("bin_capacity", "int"))))
    return sized.unionByName(none)


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """The places of the pieces of docs under the byte-level vocabulary, as pack gives them."""
    return pack(docs.select("doc_id", byte_tokens(text_or_empty()).alias("tokens")), capacities, overhead)


def sequences(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """The packed bins, a row each: bin_id, bin_capacity, bin_tokens, and by place in the bin doc_ids, pieces, starts, lengths; tokens.

    tokens holds the byte-level tokens of the whole bin: UTF-8, and END (which UTF-8 has not) after each text. Rows get numbers, under
    which their lengths are packed; a text is moved once to meet the places of its pieces, and once, in pieces, to its bins. Rows with
    equal id and text are one text with places for each.
    """
    key = [F.concat_ws(":", F.lit("id"), F.col("doc_id").cast("string")).alias("key"), F.xxhash64(text_or_empty()).alias("row")]
    items = staged(docs.select("doc_id", *key, byte_tokens(text_or_empty()).alias("tokens"), F.monotonically_increasing_id().alias("uid")), "pack-rows")
    placed = pack(items.select(F.col("uid").alias("doc_id"), "tokens"), capacities, overhead)
    places = placed.filter("bin_id is not null").groupBy(F.col("doc_id").alias("uid")).agg(F.collect_list(F.struct("bin_id", "bin_capacity", "bin_tokens", "bin_offset", "piece", "start", "length")).alias("places"))
    places = staged(items.select("uid", "key", "row").join(staged(places, "pack-places"), "uid").drop("uid"), "pack-texts")
    one = Window.partitionBy("key", "row").orderBy(F.lit(0))
    texts = docs.select("doc_id", *key, text_or_empty().alias("text")).filter("text <> ''").withColumn("n", F.row_number().over(one)).filter("n = 1")
    met = texts.join(places.hint("merge"), ["key", "row"]).withColumn("bytes", F.concat(F.col("text").cast("binary"), F.lit(END)))
    cut = met.select("doc_id", F.explode(F.expr("transform(places, p -> struct(p.bin_id as bin_id, p.bin_capacity as bin_capacity, p.bin_tokens as bin_tokens, p.bin_offset as bin_offset, p.piece as piece, p.start as start, p.length as length, substring(bytes, cast(p.start as int) + 1, p.length) as content))")).alias("p"))
    inside = F.sort_array(F.collect_list(F.struct("p.bin_offset", "doc_id", "p.piece", "p.start", "p.length", "p.content")))
    bins = cut.groupBy("p.bin_id").agg(F.first("p.bin_capacity").alias("bin_capacity"), F.first("p.bin_tokens").alias("bin_tokens"), inside.alias("own"))
    each = lambda c: F.transform("own", lambda x: x[c])
    tokens = F.expr("unhex(array_join(transform(own, x -> hex(x.content)), ''))")
    return bins.select("bin_id", "bin_capacity", "bin_tokens", each("doc_id").alias("doc_ids"), each("piece").alias("pieces"), each("start").alias("starts"), each("length").alias("lengths"), tokens.alias("tokens"))
