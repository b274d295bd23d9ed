"""Repeated passages by a sparse enhanced suffix array.

A byte goes if a string of LENGTH bytes over it also starts anywhere else. A suffix array of every byte would be many times
the corpus, so suffixes are sampled by content: the anchor of a window of LENGTH bytes is its smallest k-gram hash
(the rightmost of equals), which equal windows share at equal places. Windows with one anchor form a cell, about one in 150
bytes. Then

1. cells are counted by k-gram; those whose k-gram is unique hold no repeat and are dropped;
2. cells whose whole bytes occur again are repeats as they are, whatever the number of copies (counts are pre-aggregated);
3. the distinct cells of a k-gram that differ are sorted as suffixes from their anchor; the stack scan over common prefixes
   yields the interval tree, and each interval with diverse left extensions gives maximal repeats with all occurrences: the
   longest common left context of an occurrence with any other one of the interval, plus the prefix, if they reach LENGTH;
4. k-grams with more than GROUP distinct cells are not gathered: runs of their windows, and only where those differ single windows,
   are hashed and counted with partial sums.

A cell is at most one window's range of starts, so nothing is lost where documents or long texts are cut.

Defined cases: null texts are empty; texts shorter than LENGTH have no repeat; repeated rows repeat each other; extra columns are
ignored; documents are told apart by id and content hash, so null and repeated ids are allowed (the id -2^63 stands for null); an empty
table gives no rows; long texts are read in parts of PIECE bytes that overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty, tune

LENGTH, GRAM = 400, 96
GROUP = 256
STRIDE = 16
PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
TABLE = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(256)], np.uint64)

CELL = "id long, row long, lo int, hi int, anchor int, gram long, whole long"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_CACHE: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base at least, and those of its inverse."""
    if len(_CACHE.get("up", ())) < n:
        _CACHE["up"], _CACHE["down"] = _powers(max(n, 1 << 19))
    return _CACHE["up"], _CACHE["down"]


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of the k bytes from each position."""
    n = len(data) + 1
    up, down = powers(n)
    total = np.zeros(n, np.uint64)
    np.cumsum(TABLE[data] * up[: n - 1], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: n - k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def cells_of(data: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi (first and last start of the windows), anchor and k-gram hash of the cells of one text of at least length bytes."""
    h = _gram_hashes(data, k)
    n = len(h)
    bits = np.uint64(int(n).bit_length())
    back = np.arange(n - 1, -1, -1, dtype=np.uint64)
    least = sliding_min((h >> bits << bits) | back, length - k + 1)
    anchor = (np.uint64(n - 1) - (least & ((np.uint64(1) << bits) - np.uint64(1)))).astype(np.int64)
    cuts = np.flatnonzero(np.diff(anchor)) + 1
    lo = np.concatenate([[0], cuts])
    hi = np.concatenate([cuts - 1, [len(anchor) - 1]])
    at = anchor[lo]
    return lo, hi, at, h[at]


def _cells(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CELL.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                data = text.as_buffer()
                size = data.size if data is not None else 0
                view = memoryview(data) if size else b""
                for at in range(0, size - length + 1, PIECE):
                    part = np.frombuffer(view[at : at + PIECE + length - 1], np.uint8)
                    lo, hi, anchor, gram = cells_of(part, length, k)
                    out[0].append(np.full(len(lo), i))
                    for c, x in zip((2, 3, 4, 5), (lo + at, hi + at, anchor + at, gram.view(np.int64)), strict=True):
                        out[c].append(x)
                    digest = xxhash.xxh3_64_intdigest
                    whole = [digest(view[a:b], s) for a, b, s in zip((lo + at).tolist(), (hi + at + length).tolist(), (anchor - lo).tolist(), strict=True)]
                    out[6].append(np.array(whole, np.uint64).view(np.int64))
            if out[0]:
                rows = pa.array(np.concatenate(out[0]))
                own = [batch.column(0).take(rows), batch.column(1).take(rows)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.concatenate(out[c])).cast(kinds[c]) for c in range(2, 7))], names=names)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """id (null: the smallest long), row (a content hash) and text."""
    text = text_or_empty()
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), F.xxhash64(text, "doc_id").alias("row"), text.alias("text"))


def lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def interval_tree(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each interval; prefixes[i] is that of the sorted suffixes i and i + 1. Children come first."""
    stack: list[tuple[int, int]] = []
    for i, p in enumerate([*prefixes, -1]):
        left = i
        while stack and stack[-1][0] > p:
            depth, left = stack.pop()
            yield depth, left, i
        if p >= 0 and (not stack or stack[-1][0] < p):
            stack.append((p, left))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(common prefix, number of occurrences, [(occurrence, left extension)]) of the intervals that reach length.

    lefts are reversed, so that a common left extension is a common prefix too.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    common = [lcp(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    out = []
    for depth, first, last in interval_tree(common):
        own = sorted(order[first : last + 1], key=lefts.__getitem__)
        near = [0, *(lcp(lefts[a], lefts[b]) for a, b in zip(own, own[1:], strict=False)), 0]
        reach = [(x, max(near[i], near[i + 1])) for i, x in enumerate(own)]  # neighbours by left context share the most
        reach = [(x, e) for x, e in reach if e + depth >= length]
        if reach:
            out.append((depth, last - first + 1, reach))
    return out


def _slices(length: int):
    """Bytes left (reversed) and right of the anchor of each wanted cell of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            ids, rows, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for i, (text, cells) in enumerate(zip(batch.column(2).cast(pa.binary()), wanted, strict=True)):
                view = memoryview(text.as_buffer())
                for c in cells:
                    lo, hi, at = c["lo"], c["hi"], c["anchor"]
                    for k, v in enumerate((ids[i], rows[i], lo, at, c["gram"], c["once"], bytes(view[lo:at])[::-1], bytes(view[at : hi + length]))):
                        out[k].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["id", "row", "lo", "anchor", "gram", "once", "lefts", "rights"])

    return run


COVER = "id long, row long, start int, end int"


def _covers(length: int):
    """Rows sorted by k-gram: the covered range around each anchor, group by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                for depth, _, reach in maximal_repeats([x[5] for x in held], [x[6] for x in held], length):
                    out.extend((held[x][0], held[x][1], held[x][2] - e, held[x][2] + depth) for x, e in reach if held[x][4])
            held.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "row", "start", "end"])

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if held and r[3] != held[0][3]:
                    close()
                held.append(r)
            yield batch_of()
        close()
        yield batch_of()

    return run


SEGMENT_ROW = "id long, row long, start int, anchor int, once boolean, slot int, core long, whole long, hashes array<long>"


def _segments(length: int):
    """Windows of each cell in runs of STRIDE by their distance from the anchor: a hash of what all windows of such a run share, one of
    the bytes of this run, and one of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda data, seed=0: xxhash.xxh3_64_intdigest(data, seed) - (1 << 63)
        for batch in batches:
            out: list[tuple] = []
            for i, row, lo, at, once, left, right in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                whole, reach = memoryview(left[::-1] + right), len(left)  # the anchor's place
                last = len(whole) - length
                for slot in range((reach - last) // STRIDE, reach // STRIDE + 1):
                    near, far = reach - slot * STRIDE, reach - slot * STRIDE - STRIDE + 1
                    a, b = max(0, far), min(last, near)
                    core = digest(whole[near : far + length], slot)
                    out.append((i, row, lo + a, at, once, slot, core, digest(whole[a : b + length], reach - a), [digest(whole[w : w + length]) for w in range(a, b + 1)]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            columns = list(zip(*out, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SEGMENT_ROW.split(", ")])

    return run


def counted_covers(sliced: DataFrame, length: int) -> list[DataFrame]:
    """Covers of cells whose k-gram has too many distinct cells to gather, by partial sums only.

    Runs of windows that occur again as a whole are repeats; only one of each kind of the others with a common core is taken apart.
    """
    rows = staged(sliced.select("id", "row", "lo", "anchor", "once", "lefts", "rights").mapInArrow(_segments(length), SEGMENT_ROW), "repeat-segments")
    kinds = staged(rows.groupBy("slot", "core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row", "start", "anchor", "once", "hashes")).alias("at")), "repeat-runs")
    again = staged(kinds.filter("n > 1").select("slot", "core", "whole"), "repeat-runs-again")
    end = F.col("start") + F.size("hashes") - 1 + length
    full = rows.filter("once").join(again, ["slot", "core", "whole"]).select("id", "row", "start", end.alias("end"))
    mixed = staged(kinds.groupBy("slot", "core").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("slot", "core"), "repeat-runs-mixed")
    apart = kinds.join(mixed, ["slot", "core"]).select("n", "at.*").select("n", "id", "row", "start", "anchor", "once", F.posexplode("hashes").alias("i", "hash"))
    windows = staged(apart.select("id", "row", (F.col("start") + F.col("i")).alias("start"), (F.col("anchor") - F.col("start") - F.col("i")).alias("offset"), (F.col("once") & (F.col("n") == 1)).alias("once"), "hash"), "repeat-windows")
    known = staged(windows.groupBy("hash", "offset").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash", "offset"), "repeat-known")
    return [full, windows.filter("once").join(known, ["hash", "offset"]).select("id", "row", "start", (F.col("start") + length).alias("end"))]


def repeat_covers(docs: DataFrame, length: int = LENGTH, k: int = GRAM, group: int = GROUP) -> DataFrame:
    """(id, row, start, end): byte ranges that repeats of at least length bytes cover; they may overlap."""
    spark = docs.sparkSession
    tune(spark, 256)
    rows = keyed(docs)
    cells = staged(rows.filter(F.octet_length("text") >= length).mapInArrow(_cells(length, k), CELL), "repeat-cells")
    grams = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    cells = staged(cells.join(staged(grams, "repeat-grams"), "gram", "left_semi"), "repeat-shared")
    place = F.struct("id", "row", "lo", "hi", "anchor")
    kinds = staged(cells.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")), "repeat-kinds")
    again = staged(kinds.filter("n > 1").select("gram", "whole"), "repeat-again")
    full = cells.join(again, ["gram", "whole"]).select("id", "row", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))

    mixed = staged(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "repeat-mixed")
    wanted = kinds.join(mixed, "gram").select("at.id", "at.row", F.struct("at.lo", "at.hi", "at.anchor", "gram", (F.col("n") == 1).alias("once")).alias("cell"))
    asked = staged(wanted.groupBy("id", "row").agg(F.collect_list("cell").alias("cells")), "repeat-asked")
    sliced = rows.join(asked, ["id", "row"]).select("id", "row", "text", "cells").mapInArrow(_slices(length), "id long, row long, lo int, anchor int, gram long, once boolean, lefts binary, rights binary")
    sliced = staged(sliced, "repeat-sliced")
    large = staged(mixed.filter(F.col("m") > group).select("gram"), "repeat-large")

    few = sliced.join(large, "gram", "left_anti").select("id", "row", "anchor", "gram", "once", "lefts", "rights")
    tune(spark, 2000)
    parts = [full, few.repartition("gram").sortWithinPartitions("gram").mapInArrow(_covers(length), COVER)]
    if large.head(1):
        parts += counted_covers(sliced.join(large, "gram", "left_semi"), length)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    out = staged(out, "repeat-covers")
    tune(spark, 256)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out: list[list] = [[] for _ in range(5)]
        for i, text, spans in zip(ids, batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
            data = text.as_py()
            runs = merged([(s["start"], s["end"]) for s in spans]) if spans else []
            h, at = hashlib.sha256(), 0
            for a, b in runs:
                h.update(data[at:a])
                at = b
            h.update(data[at:])
            for k, v in enumerate((None if i == -(2**63) else i, len(data), sum(b - a for a, b in runs), len(runs), h.hexdigest())):
                out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [*(pa.array(v, k) for v, k in zip(out, kinds, strict=True)), batch.column(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_windows"])


def covered_texts(docs: DataFrame, covers: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """id, text, spans (null where nothing repeats) and n_shared_windows (0 where marks has none) of every row."""
    by_row = covers.groupBy("id", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    by_row = by_row.join(marks, ["id", "row"], "full") if marks is not None else by_row.withColumn("n_shared_windows", F.lit(0).cast("long"))
    joined = keyed(docs).join(staged(by_row, "repeat-rows"), ["id", "row"], "left")
    return joined.select("id", "text", "spans", F.coalesce("n_shared_windows", F.lit(0).cast("long")).alias("n_shared_windows"))


def removed(docs: DataFrame, length: int = LENGTH, marks: DataFrame | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and n_shared_windows of marks (id, row, n_shared_windows)."""
    tune(docs.sparkSession, 256)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_windows long"
    out = covered_texts(docs, repeat_covers(docs, length), marks).mapInArrow(_stripped, schema)
    return out if marks is not None else out.drop("n_shared_windows")
