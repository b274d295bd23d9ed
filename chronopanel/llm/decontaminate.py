"""Benchmark decontamination by a BM25 inverted index of test items, block-max WAND and overlap checks.

Training documents are cut into overlapping passages twice as long as the longest item part, so each item fits into one.
Every passage is a query against the index and everything at or above its item's threshold (a share of the score that the item has
against itself) is retrieved: bounds of the items, summed for a whole batch of passages at once from their essential terms,
discard passages that cannot reach any item's threshold; the rest go through block-max WAND, item at a time. An item of
which a document holds the longer of question and answer by shingles, wherever the rest is, is retrieved too. A hit counts when
the five-word shingles of the item's question and of its answer are contained in the document at MIN_OVERLAP or more.

An index holds SHARD_WORDS words of the benchmark at most and is broadcast; a larger benchmark is split into as many as needed,
which the documents pass one after the other. Document frequencies, mean length and passage width are those of the whole benchmark,
so scores, thresholds and results do not depend on the split.

Defined cases: null texts are empty and match nothing; items without words are ignored; items of fewer than five words count as
one shingle; items with equal texts are all reported, and of items with equal ids each text counts; a null item_id is reported as null,
after the others; repeated rows each have a result; whole texts are searched, however long; clean keeps all columns whatever their names;
no items leave every document clean, no documents give no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, kept_by_text, staged, text_or_empty, tune

K1, B = 1.2, 0.75
SHINGLE, MIN_OVERLAP = 5, 0.8
MIN_SHARE = 0.6
PART_WORDS = 256
BLOCK = 8
SHARD_WORDS = 500_000
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; a single sentence is cut at two thirds of its words."""
    parts = [w for s in SENTENCE.split(text.strip()) if (w := words_of(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = max(1, (2 * len(words) + 2) // 3)
    return words[:cut], words[cut:]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n terms in a row."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ ids[k : k + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def parts_of(words: list[str]) -> list[list[str]]:
    return [words[i : i + PART_WORDS] for i in range(0, len(words), PART_WORDS)]


class Statistics(NamedTuple):
    """Of all parts of a benchmark: their number, words and greatest length, and in how many of them a term is."""

    parts: int
    words: int
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, parts: list[list[str]]) -> "Statistics":
        return cls(len(parts), sum(map(len, parts)), max(map(len, parts), default=0), Counter(t for w in parts for t in set(w)))


class Index:
    """Impacts by term of item parts (at most PART_WORDS words each), in blocks of BLOCK parts. Items are told apart by position.

    whole: statistics of the whole benchmark, where items are only some of it.
    """

    def __init__(self, items: list[tuple[int | None, str]], whole: Statistics | None = None):
        self.parts: list[tuple[int, list[str]]] = []
        self.checks: list[tuple[set, set]] = []
        self.ids: list[int | None] = []
        for item, text in sorted(((i, t or "") for i, t in items), key=lambda x: (x[0] is None, x)):
            words = words_of(text)
            if words:
                q, a = question_and_answer(text)
                self.parts += [(len(self.ids), w) for w in parts_of(words)]
                self.checks.append((shingles(q), shingles(a)))
                self.ids.append(item)
        whole = whole or Statistics.of([w for _, w in self.parts])
        n, self.longest, df = whole.parts, whole.longest, whole.df
        mean = whole.words / max(n, 1)
        tf = [Counter(w) for _, w in self.parts]
        self.terms = {t: k for k, t in enumerate(sorted({t for c in tf for t in c}))}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for p, c in enumerate(tf):
            norm = K1 * (1 - B + B * len(self.parts[p][1]) / mean)
            for t, f in c.items():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                self.postings[self.terms[t]].append((p, idf * f * (K1 + 1) / (f + norm)))
        own = np.zeros(len(self.parts))
        for plist in self.postings:
            plist.sort()
            for p, impact in plist:
                own[p] += impact
        self.threshold = MIN_SHARE * own
        self._blocks(len(self.parts))
        self._direct()

    def _direct(self) -> None:
        """Hashes of the shingles of each item's longer part, by shingle length, with the items (by position) that have them."""
        longer = [max(c, key=len) for c in self.checks]
        self.enough = np.array([MIN_OVERLAP * len(s) for s in longer])
        rows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, s in enumerate(longer):
            for g in s:
                rows[len(g)].append((int(grams(np.array([self.terms[w] for w in g], np.int64), len(g))[0]), k))
        self.direct = {n: tuple(np.array(c) for c in zip(*sorted(r), strict=True)) for n, r in rows.items()}

    def held_by(self, ids: np.ndarray) -> list[int]:
        """Items (by position) whose longer part a document holds; ids: the terms of its words."""
        found = []
        for n, (keys, owner) in self.direct.items():
            if len(ids) >= n:
                there = np.unique(grams(ids, n)[np.lib.stride_tricks.sliding_window_view(ids, n).min(axis=1) >= 0])
                at = np.searchsorted(there, keys)
                hit = owner[(at < len(there)) & (there[np.minimum(at, len(there) - 1)] == keys)] if len(there) else owner[:0]
                count = np.bincount(hit, minlength=len(self.ids))
                found += np.flatnonzero((count > 0) & (count >= self.enough - 1e-9)).tolist()
        return found

    def best_score(self, item: int, ids: np.ndarray) -> float:
        """The best score of a part of the item in a passage."""
        mine, best = {p for p, (i, _) in enumerate(self.parts) if i == item}, 0.0
        for a in range(0, len(ids), self.longest):
            score: Counter = Counter()
            for t in set(ids[a : a + 2 * self.longest].tolist()) - {-1}:
                for p, impact in self.postings[t]:
                    if p in mine:
                        score[p] += impact
            best = max([best, *score.values()])
        return best

    def _blocks(self, n: int) -> None:
        """Block maxima of all terms, essential terms, and the sum that each part needs of them.

        Terms of more than a twentieth of the parts are inessential, unless a part's inessential terms alone reach its threshold:
        without an essential one the part is out of reach.
        """
        by_part: list[list[tuple[float, int]]] = [[] for _ in range(n)]
        for t, plist in enumerate(self.postings):
            for p, impact in plist:
                by_part[p].append((impact, t))
        self.block_max: list[dict[int, float]] = [{} for _ in self.terms]
        for t, plist in enumerate(self.postings):
            for p, impact in plist:
                b = p // BLOCK
                self.block_max[t][b] = max(self.block_max[t].get(b, 0.0), impact)
        common = {t for t, plist in enumerate(self.postings) if len(plist) > max(1, n // 20)}
        rest = np.zeros(n)
        for p, terms in enumerate(by_part):
            rest[p] = sum(i for i, t in terms if t in common)
            if rest[p] >= self.threshold[p]:  # a part of common words only: all its terms are essential
                common -= {t for _, t in terms}
        rest = np.array([sum(i for i, t in terms if t in common) for terms in by_part])
        self.need = self.threshold - rest
        self.first, parts_, impacts_ = np.zeros(len(self.terms) + 1, np.int64), [], []
        for t, plist in enumerate(self.postings):
            for p, impact in plist if t not in common else ():
                parts_.append(p)
                impacts_.append(impact)
            self.first[t + 1] = len(parts_)
        self.flat_part, self.flat_impact = np.array(parts_, np.int64), np.array(impacts_)
        self.essential = np.diff(self.first) > 0

    def candidates(self, windows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Windows that the bounds do not discard; windows, terms: one row per essential word of a window."""
        if not len(windows):
            return np.zeros(0, np.int64)
        pairs = np.unique(windows * len(self.terms) + terms)
        windows, terms = np.divmod(pairs, len(self.terms))
        count = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms] - np.cumsum(count) + count, count) + np.arange(count.sum())
        n = len(self.parts)
        cells, inverse = np.unique(np.repeat(windows, count) * n + self.flat_part[at], return_inverse=True)
        bound = np.bincount(inverse, self.flat_impact[at])
        return np.unique(cells[bound >= self.need[cells % n] - 1e-9] // n)

    def wand(self, terms: set[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every part whose score reaches its threshold, document at a time."""
        lists = [(t, self.postings[t]) for t in terms]
        at = {t: 0 for t in terms}
        top = {t: max(i for _, i in plist) for t, plist in lists}
        live, out = dict(lists), []
        while live:
            order = sorted(live, key=lambda t: live[t][at[t]][0])
            bound, pivot = 0.0, None
            least = self.threshold[live[order[0]][at[order[0]]][0] :].min()
            for t in order:
                bound += top[t]
                if bound >= least - 1e-9:
                    pivot = live[t][at[t]][0]
                    break
            if pivot is None:
                break
            block = pivot // BLOCK
            upper = sum(self.block_max[t].get(block, 0.0) for t in order if live[t][at[t]][0] < (block + 1) * BLOCK)
            if upper < self.threshold[block * BLOCK : (block + 1) * BLOCK].min() - 1e-9:
                target = (block + 1) * BLOCK
            else:
                score = 0.0
                for t in order:
                    k = bisect_left(live[t], (pivot, -1.0))
                    if k < len(live[t]) and live[t][k][0] == pivot:
                        score += live[t][k][1]
                if score >= self.threshold[pivot] - 1e-9:
                    out.append((pivot, score))
                target = pivot + 1
            for t in order:
                if live[t][at[t]][0] < target:
                    at[t] = bisect_left(live[t], (target, -1.0), at[t])
                    if at[t] == len(live[t]):
                        del live[t]
        return out

    def search(self, texts: list[str | None]) -> list[list[tuple[int | None, float]]]:
        """Of each text, the ids of the items that it contains with the best BM25 score, by id."""
        found: list[dict[int, float]] = [{} for _ in texts]
        if not self.parts:
            return [[] for _ in texts]
        stride = self.longest
        docs, get = [], self.terms.get
        rows, windows, first_window = [], [], [0]
        for text in texts:
            words = words_of(text)
            ids = np.array([get(w, -1) for w in words], np.int64)
            docs.append((words, ids))
            first_window.append(first_window[-1] + max(1, -(-len(words) // stride)))
            hit = np.flatnonzero(ids >= 0)
            hit = hit[self.essential[ids[hit]]]
            rows.append(ids[hit])
            windows.append(first_window[-2] + hit // stride)
        terms, window = np.concatenate(rows), np.concatenate(windows)
        # Window k covers the strides k and k + 1 of its document.
        starts = np.zeros(first_window[-1] + 1, bool)
        starts[np.array(first_window[:-1])] = True
        back = ~starts[window]
        live = self.candidates(np.concatenate([window, window[back] - 1]), np.concatenate([terms, terms[back]]))
        owner = np.searchsorted(np.array(first_window), live, side="right") - 1
        for d, w in zip(owner.tolist(), live.tolist(), strict=True):
            a = (w - first_window[d]) * stride
            ids = docs[d][1][a : a + 2 * stride]
            for part, score in self.wand(set(ids[ids >= 0].tolist())):
                item = self.parts[part][0]
                found[d][item] = max(score, found[d].get(item, 0.0))
        out = []
        for (words, ids), f in zip(docs, found, strict=True):
            more = {i: 0.0 for i in self.held_by(ids) if i not in f}
            got = self._verified(words, f | more) if f or more else []
            best: dict[int | None, float] = {}
            for i, s in got:
                s = s if i in f else self.best_score(i, ids)
                best[self.ids[i]] = max(s, best.get(self.ids[i], 0.0))
            out.append(list(best.items()))
        return out

    def _verified(self, words: list[str], found: dict[int, float]) -> list[tuple[int, float]]:
        wanted: dict[int, set] = defaultdict(set)
        for item in found:
            for s in (*self.checks[item][0], *self.checks[item][1]):
                wanted[len(s)].add(s)
        there = {g for n, s in wanted.items() for i in range(len(words) - n + 1) if (g := tuple(words[i : i + n])) in s}
        good = lambda s: not s or len(s & there) >= MIN_OVERLAP * len(s)
        return [(i, found[i]) for i in sorted(found) if all(map(good, self.checks[i]))]


def statistics(benchmark: DataFrame) -> DataFrame:
    """(term, parts, words, longest) of the parts of all items: sums by term, and of the parts themselves where term is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Statistics.of([w for t in batch.column(0).to_pylist() for w in parts_of(words_of(t))])
            none = [None] * len(s.df)
            columns = [[None, *s.df], [s.parts, *s.df.values()], [s.words, *none], [s.longest, *none]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["term", "parts", "words", "longest"])

    counts = benchmark.select("text").mapInArrow(run, "term string, parts long, words long, longest long")
    return staged(counts.groupBy("term").agg(F.sum("parts").alias("parts"), F.sum("words").alias("words"), F.max("longest").alias("longest")), "items-terms")


def shares(benchmark: DataFrame, words: int = SHARD_WORDS) -> Iterator[list[tuple[int | None, str]]]:
    """Items, one share after the other, each of about so many words of the benchmark at most (or one item)."""
    rows, size = [], 0
    for r in benchmark.select("item_id", text_or_empty().alias("text")).orderBy(F.col("item_id").asc_nulls_last(), "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1]) // 5 + 1
        if size >= words:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def indexes(benchmark: DataFrame, words: int = SHARD_WORDS) -> Iterator[Index]:
    """An index a share; the statistics of a share's terms are looked up among those of the whole benchmark."""
    spark, found, sums = benchmark.sparkSession, shares(benchmark, words), None
    now = next(found, None)
    while now is not None:
        after = next(found, None)
        if after is None and sums is None:
            yield Index(now)
            return
        sums = statistics(benchmark) if sums is None else sums
        terms = spark.createDataFrame([(t,) for t in sorted({t for _, x in now for t in words_of(x)})], "term string")
        df = {r["term"]: r["parts"] for r in sums.join(F.broadcast(terms), "term").collect()}  # both bounded by the share's words
        total = sums.filter("term is null").first()
        yield Index(now, Statistics(total["parts"], total["words"], total["longest"], df))
        now = after


def _passes(df: DataFrame, benchmark: DataFrame, words: int, one: Callable[[DataFrame, Broadcast, bool], DataFrame]) -> DataFrame:
    """df through one(df, index, last) for each index; between two the rows are written, so one index at a time is shipped."""
    shards = indexes(benchmark, words)
    now = next(shards, None)
    while now is not None:
        after = next(shards, None)
        held = df.sparkSession.sparkContext.broadcast(now)
        df = one(df, held, after is None)
        if after is not None:
            df = staged(df, "items")
            held.destroy()
        now = after
    return df


def matches(docs: DataFrame, benchmark: DataFrame, words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_ids (sorted), best_score, contaminated of every row."""

    def one(df: DataFrame, index: Broadcast, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before, best, out = batch.column(1).to_pylist(), batch.column(2).to_pylist(), [[], []]
                for items, score, found in zip(before, best, index.value.search(batch.column(3).to_pylist()), strict=True):
                    out[0].append(sorted({*items, *(i for i, _ in found)}, key=lambda i: (i is None, i)) if found else items)
                    out[1].append(max([s for _, s in found] + ([] if score is None else [score]), default=None))
                columns = [batch.column(0), pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns, *([] if last else [batch.column(3)])], names=["doc_id", "item_ids", "best_score", *([] if last else ["text"])])

        return df.mapInArrow(run, "doc_id long, item_ids array<long>, best_score double" + ("" if last else ", text string"))

    tune(docs.sparkSession)
    start = id_and_text(docs).select("doc_id", F.array().cast("array<long>").alias("item_ids"), F.lit(None).cast("double").alias("best_score"), "text")
    return _passes(start, benchmark, words, one).select("doc_id", "item_ids", "best_score", (F.size("item_ids") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs without any item, with all their columns; a pass an index."""
    tune(docs.sparkSession)
    return _passes(docs, benchmark, words, lambda df, index, last: kept_by_text(df, lambda texts: [not f for f in index.value.search(texts)]))
