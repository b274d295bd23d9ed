"""Near copies against the Jaccard similarity of all pairs."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from chronopanel.llm import near_copies, simhash
from chronopanel.llm.common import shared_dir
from tests.llm.test_text_operators import EDGE, docs_of


def brute_kept(texts, similarity=0.8):
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if comp[i] != comp[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return sorted(min(i for i, c in enumerate(comp) if c == x) for x in set(comp))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def kept(docs, **sizes):
    return sorted(r["doc_id"] for r in simhash.one_of_each(docs, near_copies.classes(docs, **sizes)).collect())


@pytest.mark.parametrize("sizes", [{}, {"small": 4, "chunk": 1000}, {"small": 4, "chunk": 10}])
def test_near_copies_match_all_pairs(spark, sizes):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    line = rng.choices(vocabulary, k=40)
    texts = []
    for k in range(12):  # a common line, and copies around the threshold
        base = [*line, *rng.choices(vocabulary, k=rng.randint(8, 120))]
        texts += [edited(rng, base, rng.randint(0, 5)) for _ in range(25 if k < 2 else 3)]
    texts += [None, "", " ", "one two", "One  two", "a b c d e"]
    want = brute_kept(texts)
    assert 20 < len(want) < len(texts) - 10
    assert kept(docs_of(spark, texts), **sizes) == want


def test_pipeline_stage_removes_copies_beyond_four_bits(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [" ".join(base), *(edited(rng, base, 3) for _ in range(4)), " ".join(f"x{i}" for i in range(150))]
    assert max((simhash.fingerprint(texts[0]) ^ simhash.fingerprint(t)).bit_count() for t in texts[1:5]) > 4
    assert brute_kept(texts) == [0, 5]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs_of(spark, texts), sf).collect()) == [0, 5]


def around_the_bits(rng):
    """Texts of which some are linked by four bits, others by the similarity only, and some by four bits against the similarity."""
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        texts += [" ".join(base), *(edited(rng, base, k) for k in (0, 1, 1, 2, 3, 8))]
    return texts


def test_pipeline_stage_links_by_simhash_first(spark, sf, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts, tables = around_the_bits(random.Random(3)), {}
    monkeypatch.setattr(near_copies, "staged", lambda df, label, write=near_copies.staged: tables.setdefault(label, []).append(write(df, label)) or tables[label][-1])
    monkeypatch.setattr(near_copies, "discard", lambda *_: None)
    docs = docs_of(spark, texts)
    stage = corpus_pipeline.near_stage(spark, docs, sf)
    assert sorted(r["doc_id"] for r in stage.collect()) == brute_kept(texts)
    ids = {r["h"]: r["doc_id"] for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    fps = [simhash.fingerprint(t) for t in texts]
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    links = [[(ids[r["a"]], ids[r["b"]]) for r in t.collect()] for t in tables["near-links"]]
    assert len(links) >= 2 and links[0] and links[-1]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in links[0])
    linked = {frozenset(p) for p in links[0]}
    assert not any(frozenset((ids[r["a"]], ids[r["b"]])) in linked for r in tables["near-apart"][0].collect())


def test_near_copies_leave_little_on_disk(spark):
    """Of what is staged, only identifiers and links stay; the files of each shuffle go when it has been read."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark._jvm.System.gc()
    held = lambda: sum("shuffle_" in manager.getAllFiles().apply(i).getName() for i in range(manager.getAllFiles().size()))
    docs, before, had = docs_of(spark, around_the_bits(random.Random(4))).localCheckpoint(), held(), set(os.listdir(shared_dir(spark))) if os.path.isdir(shared_dir(spark)) else set()
    found = near_copies.classes(docs, small=4, chunk=10)
    until = time.time() + 20
    while held() > before and time.time() < until:
        time.sleep(0.2)
    assert held() <= before
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(shared_dir(spark))) - had}
    assert not left & {"near-prefixes", "near-sets", "near-candidates", "near-pairs", "near-groups", "near-wide", "simhash-keys"}, left
    assert found.count() == docs.count()


def test_near_copies_edges(spark):
    docs = docs_of(spark, EDGE, ids=[4, 5, 6, None, 8, 9, 9, 2])
    rows = simhash.one_of_each(docs, near_copies.classes(docs)).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 2, 4, 8]
    assert near_copies.classes(docs.limit(0)).count() == 0
