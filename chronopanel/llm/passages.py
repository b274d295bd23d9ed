"""Word windows that other documents hold too: passages that repeat across documents, where a length in bytes says little.

Windows of WORDS words are sampled by content as in repeats: the anchor of a window is its smallest hash of GRAM words, which equal
windows share, and the windows of one anchor are a cell. Cells whose anchor no other document has are dropped after one count. Cells that
another document has as a whole are shared with all their windows. Only of anchors with cells that differ, and of each kind of cell
once, are the windows hashed and counted. Counts are partial sums, so a passage that many documents share is no task's burden, and
nothing is capped.

Words are runs without ASCII white space; passages are equal where their bytes are, white space between words included. Windows are
compared by 64-bit hashes. Defined cases: null texts are empty; texts of fewer words have no window; rows with equal id and text are one
document; whole texts are read, in parts of PART words that overlap; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, tune
from .repeats import TABLE, keyed, powers, sliding_min

WORDS, GRAM, PART = 51, 8, 1 << 15
FLUSH = 100_000  # rows of an Arrow batch
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class WordHashes:
    """Hashes of runs of words of one text, or of a part of it."""

    def __init__(self, data: np.ndarray):
        space = np.concatenate([[True], _SPACE[data], [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLE[data] * up[: len(data)], out=self.total[1:])

    def runs(self, first: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """Of the n words from each word of first."""
        a = self.starts[first]
        h = (self.total[self.ends[first + n - 1]] - self.total[a]) * self.down[a]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def parts(data: np.ndarray, words: int) -> Iterator[tuple[int, WordHashes]]:
    """(number of the first word, hashes) of parts of the text such that each window is in one of them."""
    space = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    for at in range(0, len(starts) - words + 1, PART):
        last = min(len(starts), at + PART + words - 1) - 1
        yield at, WordHashes(data[starts[at] : ends[last]])


def cells(hashes: WordHashes, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, anchor hash and hash of the whole (its place of the anchor too) of each cell."""
    h = hashes.runs(np.arange(len(hashes.starts) - GRAM + 1), GRAM)
    n = len(h)
    bits = np.uint64((PART + words).bit_length())
    least = sliding_min((h >> bits << bits) | np.arange(n - 1, -1, -1, dtype=np.uint64), words - GRAM + 1)
    anchor = (np.uint64(n - 1) - (least & ((np.uint64(1) << bits) - np.uint64(1)))).astype(np.int64)
    cuts = np.flatnonzero(np.diff(anchor)) + 1
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts - 1, [len(anchor) - 1]])
    whole = hashes.runs(lo, hi - lo + words) + (anchor[lo] - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return lo, hi, h[anchor[lo]].view(np.int64), whole.view(np.int64)


def _bytes_of(column: pa.Array) -> Iterator[np.ndarray]:
    for text in column.cast(pa.binary()):
        yield np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)


def _batch(columns: list[list[np.ndarray]], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])).cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _flushed(out: list[list[np.ndarray]], names: list[str], kinds: list[pa.DataType], least: int = 0) -> Iterator[pa.RecordBatch]:
    """The rows gathered so far as a batch, once there are as many."""
    if sum(map(len, out[0])) >= least:
        yield _batch(out, names, kinds)
        for c in out:
            c.clear()


def _cells(words: int):
    form = ["doc", "lo", "hi", "gram", "whole"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[] for _ in form[0]]
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), _bytes_of(batch.column(1)), strict=True):
                for at, hashes in parts(data, words):
                    lo, hi, gram, whole = cells(hashes, words)
                    for c, x in zip(out, (np.full(len(lo), doc), lo + at, hi + at, gram, whole), strict=True):
                        c.append(x)
                    yield from _flushed(out, *form, FLUSH)
        yield from _flushed(out, *form)

    return run


def _windows(words: int):
    """Hashes of the windows of the wanted cells of each document, with the mark of the cell."""
    form = ["doc", "start", "hash", "several"], [pa.int64(), pa.int32(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[] for _ in form[0]]
        for batch in batches:
            for doc, data, wanted in zip(batch.column(0).to_pylist(), _bytes_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                asked = np.concatenate([np.arange(c["lo"], c["hi"] + 1) for c in wanted])
                mark = np.concatenate([np.full(c["hi"] - c["lo"] + 1, c["several"]) for c in wanted])
                for at, hashes in parts(data, words):
                    inside = (asked >= at) & (asked < at + PART)
                    here = asked[inside]
                    for c, x in zip(out, (np.full(len(here), doc), here, hashes.runs(here - at, words).view(np.int64), mark[inside]), strict=True):
                        c.append(x)
                    yield from _flushed(out, *form, FLUSH)
        yield from _flushed(out, *form)

    return run


def shared_windows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, row, n_shared_windows) of the documents that hold windows which another document holds too."""
    tune(docs.sparkSession, 256)
    rows = keyed(docs)
    long = rows.filter(F.octet_length("text") >= 2 * words - 1).select(F.xxhash64("id", "row").alias("doc"), "text")
    found = staged(long.mapInArrow(_cells(words), "doc long, lo int, hi int, gram long, whole long"), "passage-cells")
    both = [F.min("doc").alias("a"), F.max("doc").alias("b")]
    grams = staged(found.groupBy("gram").agg(*both).filter("a <> b").select("gram"), "passage-grams")
    found = staged(found.join(grams, "gram"), "passage-common")
    kinds = found.groupBy("gram", "whole").agg(*both, F.min(F.struct("doc", "lo", "hi")).alias("at"))
    kinds = staged(kinds.select("gram", "whole", "at", (F.col("a") != F.col("b")).alias("several")), "passage-kinds")
    full = found.join(kinds.filter("several").select("gram", "whole"), ["gram", "whole"]).select("doc", "lo", "hi").distinct().select("doc", (F.col("hi") - F.col("lo") + 1).alias("n"))
    mixed = staged(kinds.groupBy("gram").count().filter("count > 1").select("gram"), "passage-mixed")
    asked = kinds.join(mixed, "gram").select("at.doc", F.struct("at.lo", "at.hi", "several").alias("cell")).groupBy("doc").agg(F.collect_list("cell").alias("cells"))
    again = long.join(staged(asked, "passage-asked"), "doc").select("doc", "text", "cells")
    windows = staged(again.mapInArrow(_windows(words), "doc long, start int, hash long, several boolean").distinct(), "passage-windows")
    shared = staged(windows.groupBy("hash").agg(*both, F.max("several").alias("several")).filter("several or a <> b").select("hash"), "passage-shared")
    single = windows.filter("not several").join(shared, "hash").select("doc", F.lit(1).alias("n"))
    counts = staged(full.unionByName(single).groupBy("doc").agg(F.sum("n").alias("n_shared_windows")), "passage-counts")
    return rows.select("id", "row", F.xxhash64("id", "row").alias("doc")).join(counts, "doc").select("id", "row", "n_shared_windows").distinct()
