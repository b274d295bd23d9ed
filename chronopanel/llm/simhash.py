"""Near duplicates by SimHash with Golay-code fuzzy hashing.

The 64 bits of a fingerprint are cut into BLOCKS segments. With at most 4 bits wrong and 5 segments one segment is equal; it
is part of the key as it is. The other segments hold all errors; two words of 23 of their bits have at most 2 errors in one
of them, and two words within 2 bits share a codeword of the perfect (23, 12) Golay code among those that decode from the word or
from its 23 neighbours (1 or 6 of them). So each fingerprint has about 5 keys for each of 10 choices, and each linked pair
shares one at least. Distinct fingerprints only are keyed. Buckets are sorted and verified with whole fingerprints in blocks; of
each bucket only a spanning forest leaves the task, so no pairs of a group are emitted; buckets of more than BUCKET
fingerprints are cut into chunks and all pairs of chunks are dealt over the cluster. Links become components by
alternating large-star and small-star steps on written tables.

Defined cases: null texts are empty; no words give fingerprint zero, linked like any other; a null doc_id has its
component's smallest id; a component of null ids only has null; repeated rows share their component; whole texts are hashed, however
long; no documents give no rows; near_duplicates ignores other columns, one_of_each keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, only_of_one, staged, tune

SHINGLE, SEED, MAX_BITS = 4, 42, 4
SEGMENTS = (13, 13, 13, 13, 12)
WORD_BITS = 23
BUCKET = 4096
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the (23, 12) Golay code


def fingerprint(text: str | bytes | None) -> int:
    data = text.encode() if isinstance(text, str) else bytes(text or b"")
    words = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):  # a byte a bit
        counts += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "row", "fp"])

    tune(docs.sparkSession)
    return id_and_text(docs).withColumn("row", F.xxhash64("text")).mapInArrow(run, "doc_id long, row long, fp long")


@cache
def decoder() -> np.ndarray:
    """The message (12 bits) of the codeword nearest to each of the 2^23 words, by syndrome."""

    def syndrome(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
        return words

    errors = np.array([sum(1 << b for b in c) for k in range(4) for c in combinations(range(23), k)], np.int64)
    leader = np.zeros(2048, np.int64)
    leader[syndrome(errors)] = errors
    out = np.empty(1 << WORD_BITS, np.uint16)
    for at in range(0, len(out), 1 << 18):  # a part at a time: the worker's memory is small
        words = np.arange(at, at + (1 << 18), dtype=np.int64)
        out[at : at + (1 << 18)] = (words ^ leader[syndrome(words)]) >> 11
    return out


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """(n, 24) codeword indices of each word and its neighbours; equal ones repeat."""
    table = decoder()
    masks = np.concatenate([[0], 1 << np.arange(WORD_BITS)])
    return table[words[:, None] ^ masks[None, :]]


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for size in SEGMENTS:
        out.append((fps >> np.uint64(at)) & np.uint64((1 << size) - 1))
        at += size
    return out


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all distinct keys of the fingerprints."""
    rows, found = [], []
    segments = _segments(fps)
    for i, exact in enumerate(segments):
        rest, at = np.zeros(len(fps), np.uint64), 0
        for j, size in enumerate(SEGMENTS):
            if j != i:
                rest |= segments[j] << np.uint64(at)
                at += size
        for w in range(2):
            word = ((rest >> np.uint64(WORD_BITS * w)) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
            code = np.sort(fuzzy_keys(word), axis=1)
            new = np.ones(code.shape, bool)
            new[:, 1:] = code[:, 1:] != code[:, :-1]
            row, _ = np.nonzero(new)
            rows.append(row)
            found.append(((2 * i + w) << 26 | exact[row].astype(np.int64) << 12 | code[new]))
    return np.concatenate(rows), np.concatenate(found)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(fps), 2000):
            row, key = keys(fps[i : i + 2000])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[i : i + 2000][row].view(np.int64))], names=["key", "fp"])


def forest(a: np.ndarray, b: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links within a, or of those between a and b."""
    nodes = a if b is None else np.concatenate([a, b])
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    right = a if b is None else b
    shift = 0 if b is None else len(a)
    for i in range(0, len(a), 256):
        near = np.bitwise_count(a[i : i + 256, None] ^ right[None, :]) <= MAX_BITS
        for x, y in zip(*(v.tolist() for v in np.nonzero(near)), strict=True):
            x, y = x + i, y + shift
            if y > x and (p := find(x)) != (q := find(y)):
                parent[q] = p
                out.append((x, y))
    return [(int(nodes[x]), int(nodes[y])) for x, y in out]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, then side (0, or 1 where a chunk meets another): links of each bucket."""

    def links(key: np.ndarray, side: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        size = ends - starts
        two = starts[size == 2]
        two = two[(np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS) & ((side[two] == side[two + 1]) | (side[two] == 0))]
        out = list(zip(fp[two].tolist(), fp[two + 1].tolist(), strict=True))
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            cut = s + int(np.searchsorted(side[s:e], 1))
            out += forest(fp[s:e]) if cut == e else forest(fp[s:cut], fp[cut:e])
        return out

    def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(list(dict.fromkeys(pairs)), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, side, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
        if not len(key):
            continue
        if held and key[0] == key[-1] == held[0][0][-1] and len(held) < 64:
            held.append((key, side, fp))
            continue
        key, side, fp = (np.concatenate([*(h[i] for h in held), x]) for i, x in enumerate((key, side, fp)))
        cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
        if cut:
            yield batch_of(links(key[:cut], side[:cut], fp[:cut]))
        held = [(key[cut:], side[cut:], fp[cut:])]
    if held:
        yield batch_of(links(*(np.concatenate([h[i] for h in held]) for i in range(3))))


def link_fingerprints(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all fingerprints (distinct, column fp) within MAX_BITS bits as far as they are connected."""
    spark = fps.sparkSession
    tune(spark, 20_000)
    keyed = staged(fps.mapInArrow(_keyed, "key long, fp long"), "simhash-keys")
    large = staged(keyed.groupBy("key").count().filter(F.col("count") > bucket), "simhash-large")
    rows = keyed.select("key", F.lit(0).alias("side"), "fp")
    if large.head(1):
        # Chunks of a large bucket by hash; each pair of chunks is a bucket of its own with two sides.
        cut = keyed.join(large, "key").withColumn("n", F.ceil(F.col("count") / (bucket / 2)).cast("int")).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        pairs = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("d"))
        lo, hi = F.least("c", "d"), F.greatest("c", "d")
        chunks = pairs.select(F.xxhash64("key", lo, hi).alias("key"), F.when(F.col("c") > F.col("d"), 1).otherwise(0).alias("side"), "fp")
        rows = rows.join(large, "key", "left_anti").unionByName(chunks)
    dealt = rows.repartition("key").sortWithinPartitions("key", "side")
    out = staged(dealt.mapInArrow(_verify, "a long, b long").distinct(), "simhash-links")
    discard(keyed, large)
    tune(spark)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) with root the smallest node (as a signed long) of its component; edges: a, b."""
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-low")
        large = staged(both.join(first, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "star-large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "star-low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        after = staged(small, "star")
        moved = after.join(edges, ["u", "v"], "left_anti").head(1) or edges.join(after, ["u", "v"], "left_anti").head(1)
        discard(edges, first, large, low)
        edges = after
        if not moved:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, row, fp, root (a fingerprint of the component), component_id of every row."""
    rows = staged(fingerprints(docs), "simhash-fps")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = components(link_fingerprints(distinct.select("fp")))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = staged(named.join(smallest, "root").select("fp", "root", "component_id"), "simhash-classes")
    return rows.join(named, "fp").select("doc_id", "row", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component one row with the smallest doc_id (of rows that share that
    id, the one whose text has the smallest hash). found: doc_id, row, root, component_id of every row, else those of this module."""
    rows = classes(docs) if found is None else found
    first = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("k"))
    return only_of_one(docs, first.select("k.*").distinct())
