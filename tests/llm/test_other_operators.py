"""Archives, packing, chats, sharding and the pipeline."""

import gzip
import hashlib
import random
from bisect import insort
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronopanel.llm import chat, packing, queries, sharding, warc


def test_warc_roundtrip_edges(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "http://c", big), (4, "d", None), (5, "e", ""), (6, "tab\t", "tiny"), (7, "g", "tiny"), (None, "h", big), (3, "http://c", big), (8, "i", "é\r\n\r\nWARC/1.1\r\n" + "y" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.roundtrip(pages).collect())
    want = [(1, 1500, "revisit", 3), (2, 1500, "revisit", 3), (3, 1500, "response", None), (3, 1500, "response", None), (None, 1500, "response", None)]
    want += [(4, 0, "response", None), (5, 0, "response", None), (6, 4, "response", None), (7, 4, "response", None), (8, len(rows[-1][2].encode()), "response", None)]
    assert got == Counter(want)
    assert warc.roundtrip(pages.limit(0)).count() == 0
    path = warc.write_archives(pages, str(tmp_path / "w"))
    records = [r for p in sorted((tmp_path / "w").glob("part-*")) for r in warc.parse_records(gzip.open(p))]
    assert len(records) == len(rows) == len({f["warc-record-id"] for f, _ in records})
    assert {f["warc-target-uri"] for f, _ in records} >= {"http://a/%0D%0AX:%20y", "urn:page:2", "tab%09"}
    for fields, block in records:
        payload = block.partition(b"\r\n\r\n")[2]
        if fields["warc-type"] == "response":
            import base64

            assert fields["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            assert not payload and fields["warc-profile"] == warc.PROFILE
    assert path


def test_warc_archives_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.range(300).selectExpr("id as page_id", "'http://x' as url", "concat(id, repeat('y', 20000)) as html", "1 as copy", "2 as digest")
    warc.write_archives(pages, str(tmp_path / "w"), file_bytes=1_000_000)
    sizes = [len(gzip.open(p).read()) for p in (tmp_path / "w").glob("part-*")]
    assert sum(sizes) > 6_000_000 and max(sizes) < 2_500_000 and len(sizes) >= 6
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 300


def cheapest(length, same, shorter, capacities, overhead):
    """Of the capacities that hold the piece, the one of least cost a token that it can be expected to hold; the smallest of equals."""
    costs = []
    for c in sorted(c for c in capacities if c >= length):
        alike = length * min(same, c // length)
        costs.append(((overhead + c + c * c / 65536) / min(c, alike + shorter), c))
    least = min(x for x, _ in costs)
    return next(c for x, c in costs if x <= least + 1e-12)


def brute_best_fit(lengths, capacities, overhead):
    """One piece at a time."""
    left = Counter(lengths)
    free, bins = [], []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, (room, _) in enumerate(free) if room >= n), None)
        if at is None:
            room = cheapest(n, left[n], sum(k * c for k, c in left.items() if k < n), capacities, overhead)
            bins.append([])
            b = len(bins) - 1
        else:
            room, b = free.pop(at)
        bins[b].append(n)
        left[n] -= 1
        insort(free, (room - n, b))
    return sorted(tuple(b) for b in bins)


@pytest.mark.parametrize("sizes", [(512,), (128, 256, 512)])
def test_packing_matches_sequential_best_fit(spark, sizes):
    rng = random.Random(1)
    tokens = [int(rng.lognormvariate(4, 1)) for _ in range(700)] + [100] * 300 + [0, None]
    items = spark.createDataFrame(list(enumerate(tokens)), "doc_id long, tokens long")
    rows = packing.pack(items, sizes, 16).collect()
    bins, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r["length"])
            spans[r["bin_id"]].append((r["bin_offset"], r["length"]))
    lengths = [r["length"] for r in rows if r["length"]]
    assert sum(lengths) == sum(t or 0 for t in tokens)
    for b, s in spans.items():
        at = 0
        for start, n in sorted(s):
            assert start == at
            at += n
    for r in rows:
        if r["bin_id"] is not None:
            assert r["bin_tokens"] == sum(bins[r["bin_id"]])
            assert r["bin_capacity"] == min(c for c in sizes if c >= r["bin_tokens"])
    want = brute_best_fit(lengths, sizes, 16)
    assert len(bins) == len(want)
    if len(sizes) == 1:  # of bins with equal room either may be taken, so contents can differ but not what bins hold
        assert sorted(map(sum, bins.values())) == sorted(map(sum, want))
    waste = 1 - sum(lengths) / sum(min(c for c in sizes if c >= sum(b)) for b in bins.values())
    assert waste < 0.05
    assert sum(r["length"] == 0 for r in rows) == sum(not t for t in tokens)


def test_tokens_of_a_vocabulary(spark):
    vocabulary = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "é" * 500)], "doc_id long, text string")
    path = vocabulary.path("byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: r["tokens"] for r in packing.vocabulary_tokens(docs, path, vocabulary.PATTERN).collect()}
    assert got[1] == 3 and got[2] == got[3] == 0 and got[4] > 10
    with pytest.raises(ValueError, match="bytes"):
        packing.vocabulary_tokens(docs, path, vocabulary.PATTERN, 10)


def test_packing_edges(spark):
    items = spark.createDataFrame([(None, 5), (1, 10**6), (1, 3), (1, 3)], "doc_id long, tokens long")
    rows = packing.pack(items, (1000, 300)).collect()
    assert sum(r["length"] for r in rows) == 10**6 + 11
    assert packing.pack(items.limit(0)).count() == 0


def test_bins_hold_every_byte_once(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").withColumn("bytes", F.lit(1)).withColumn("uid", F.lit(2))
    docs = table.unionByName(table.limit(5)).unionByName(spark.createDataFrame([(None, "no id", 1, 2), (7, None, 1, 2), (8, "", 1, 2), (-5, "é" * 30_000, 1, 2)], table.schema))
    want = Counter((r["doc_id"], r["text"].encode() + packing.END) for r in docs.collect() if r["text"])
    parts = defaultdict(list)
    for r in packing.sequences(docs).collect():
        assert len(r["tokens"]) == r["bin_tokens"] == sum(r["lengths"]) <= r["bin_capacity"]
        assert r["bin_capacity"] == min(c for c in packing.CAPACITIES if c >= r["bin_tokens"])
        at = 0
        for i, k, start, n in zip(r["doc_ids"], r["pieces"], r["starts"], r["lengths"], strict=True):
            assert start == k * max(packing.CAPACITIES)
            parts[i, k].append(bytes(r["tokens"][at : at + n]))
            at += n
    got = Counter()
    for (i, k), own in parts.items():
        if k == 0:
            rest = [b"".join(parts[i, x][0] for x in range(1, 100) if (i, x) in parts)] * len(own)
            got.update((i, a + b) for a, b in zip(own, rest, strict=True))
    assert got == want
    assert packing.sequences(docs.limit(0)).count() == 0


def test_shards_are_written(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    sharding.write_shards(docs, ["a", "b", "c"], str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r["doc_id"], r["shard"]) for r in back.collect()) == sorted((r["doc_id"], r["shard"]) for r in sharding.place(docs, ["a", "b", "c"]).collect())
    names = ["007", "2024-01-01", "x/y"]  # read back as they are
    rows = spark.createDataFrame([(None, "é"), (2, None), (2, None), (3, "x" * 100_000), *((7, str(i)) for i in range(5000))], "doc_id long, text string")
    got = sharding.sharded(rows, names, str(tmp_path / "t"))
    want = sharding.place(rows, names).select(*got.columns)
    assert got.schema["shard"].dataType.simpleString() == "string" and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert sharding.sharded(rows.limit(0), names, str(tmp_path / "u")).count() == 0


def test_sharding_is_balanced_and_stable(spark, sf):
    names = [f"s{i}" for i in range(7)]
    owner = sharding.fill(names, 1009)
    sizes = Counter(owner)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    less = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, less, strict=True) if a != 6)
    assert moved < 0.3 * 1009
    # Against a plain version: shards claim in turn the first free slot of their whole permutation.
    taken, turn = {}, 0
    order = [[(sharding._hash(n, "offset") % 1009 + k * (sharding._hash(n, "skip") % 1008 + 1)) % 1009 for k in range(1009)] for n in names]
    while len(taken) < 1009:
        i = turn % 7
        taken[next(s for s in order[i] if s not in taken)] = i
        turn += 1
    assert [taken[s] for s in range(1009)] == owner
    import xxhash

    table = sharding.fill(queries.SHARDS)
    for r in queries.op9_sharding(spark, sf).collect():
        slot = (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64(r["doc_id"].to_bytes(8, "little", signed=True), seed=42).intdigest()) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, queries.SHARDS[table[slot]])
    keys = spark.createDataFrame([(None, 1), (2, 2), (2, 3)], "doc_id long, x int")
    assert sharding.place(keys, names).count() == 3
    assert sharding.place(keys.limit(0), names).count() == 0
    clash = keys.selectExpr("*", "'mine' AS shard", "7 AS slot")
    assert {r["shard"] for r in sharding.place(clash, names).collect()} <= set(names)
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def test_reply_trees_choose_best_branches(spark):
    rows = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 3, "user", "more", 0.0), ("t", 5, 4, "assistant", "<|im_end|>\\\n", 2.0), ("u", 9, 8, "user", "orphan", 0.0)]
    rows += [("deep", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)]
    rows += [("cycle", 1, 2, "user", "x", 0.0), ("cycle", 2, 1, "user", "y", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["rank"]): r for r in chat.read_back(chat.formatted(df, per_tree=2)).collect()}
    said = lambda k: [t["text"] for t in got[k]["turns"]]
    assert said(("t", 1)) == ["hi", "b", "more", "<|im_end|>\\\n"] and said(("t", 2)) == ["hi", "a"]
    assert got["t", 1]["loss"] == "b<|im_end|>\\\n"
    assert said(("deep", 1)) == [str(i) for i in range(70)] and said(("u", 1)) == ["orphan"]
    assert not any(k[0] == "cycle" for k in got)
    for tree, rank, leaf, node, depth in chat.chosen_paths(df.select("tree", "node", "parent", "score"), 2).filter("tree = 'deep'").collect():
        assert depth == node + 1


def test_chat_edges(spark):
    rows = [(1, 0, "us\ner\\", None), (1, 1, "assistant", "\\"), (1, 1, "assistant", "\\"), (None, 0, None, "x<|"), (None, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.conversations_as_chats(df)).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("us\ner\\", ""), ("assistant", "\\"), ("assistant", "\\")]
    assert got[1]["loss"] == "\\\\" and got[None]["loss"] == ""
    assert [tuple(t) for t in got[None]["turns"]] == [("", "x<|"), ("assistant", "")]
    assert "<|" not in got[None]["formatted"].replace("<|im_start|>", "").replace("<|im_end|>", "")
    assert chat.conversations_as_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_warc_revisits", "op2_exact_dedup", "op8_chat_format"])
def test_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in cursor.description)
    order = [[c[0] for c in cursor.description].index(c) for c in columns]
    want = Counter(tuple(r[i] for i in order) for r in cursor.fetchall())
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from chronopanel.llm import decontaminate, toxicity
    from chronopanel.llm.common import table
    from tests.llm.test_near_copies import brute_kept
    from tests.llm.test_text_operators import brute_matches

    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if model.score(t) < 0.3}
    seen = {}
    for i in sorted(rows):
        seen.setdefault(" ".join("\x00" if not x else x for x in __import__("re").split("[\x20\x09-\x0d]+", rows[i])), i)
    rows = {i: rows[i] for i in seen.values()}
    ids = sorted(rows)
    rows = {ids[k]: rows[ids[k]] for k in brute_kept([rows[i] for i in ids])}
    rows = {i: t for i, t in rows.items() if not brute_matches(t, items)}
    got = corpus_pipeline.run(spark, sf)
    sizes = Counter()
    for r in got.collect():
        sizes.update(dict.fromkeys(r["doc_ids"], 0))
        for i, n in zip(r["doc_ids"], r["lengths"], strict=True):
            sizes[i] += n
    assert sizes == Counter({i: len(t.encode()) + 1 for i, t in rows.items()})
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and decontaminate


def test_chats_ignore_other_columns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "word " * 20_000)]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = plain
    for c in ("tree", "node", "parent", "score", "depth", "turns", "loss", "a.b"):
        more = more.withColumn(c, F.lit(c))
    both = [[tuple(map(tuple, r["turns"])) for r in chat.read_back(chat.conversations_as_chats(df)).collect()] for df in (plain, more)]
    assert both[0] == both[1] == [(("user", "hi"), ("assistant", "word " * 20_000))]


def test_pipeline_edges(spark, sf, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ("row", "norm", "key", "__copy", "id", "whole")
    rows = [(1, None), (2, ""), (3, " "), (None, "a text without an id " * 9), (5, "word " * 30_000), (6, "one two three"), (6, "one two three"), (7, "one  two\tthree")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("lang", "source", *names):
        docs = docs.withColumn(c, F.lit(c))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    for kind, df in (("some", docs), ("none", docs.limit(0))):
        df.write.parquet(str(tmp_path / kind / "documents.parquet"))
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / kind / f"{t}.parquet"))
        kept = spark.read.parquet(str(tmp_path / kind / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path / kind))
            assert kept.columns == docs.columns
        ids = [i for r in corpus_pipeline.run(spark, str(tmp_path / kind)).collect() for i in r["doc_ids"]]
        assert set(ids) == ({None, 5, 6} if kind == "some" else set())  # 1 stands for the texts without words and has no bin
