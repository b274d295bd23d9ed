"""Passages of over 50 words against a count of all windows."""

import random
import re
from collections import defaultdict

import numpy as np

from chronopanel.llm import passages
from tests.llm.test_text_operators import EDGE, docs_of


def brute(texts, words):
    where, windows = defaultdict(set), []
    for i, t in enumerate(texts):
        data = (t or "").encode()
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        windows.append([data[at[k][0] : at[k + words - 1][1]] for k in range(len(at) - words + 1)])
        for w in windows[-1]:
            where[w].add(i)
    return {i: n for i, own in enumerate(windows) if (n := sum(len(where[w]) > 1 for w in own))}


def sample_texts():
    rng = random.Random(11)
    some = lambda n: rng.choices([f"w{i}é" for i in range(40)] + ["of", " "], k=n)
    passage, short = some(70), some(50)
    texts = [" ".join([*some(rng.randint(0, 300)), *(passage if k % 3 == 0 else short if k % 3 == 1 else []), *some(rng.randint(0, 60))]) for k in range(40)]
    return [*texts, None, "", " ".join(passage), "\t".join(passage), texts[0], " ".join(["same"] * 300), " ".join(["same"] * 60)]


def test_shared_windows_match_brute_force(spark):
    texts = sample_texts()
    got = {r["id"]: r["n_shared_windows"] for r in passages.shared_windows(docs_of(spark, texts)).collect()}
    assert got == brute(texts, 51) and len(got) > 15


def test_parts_hold_every_window_once(monkeypatch):
    for text in sample_texts():
        data = np.frombuffer((text or "").encode(), np.uint8)
        whole = [h for _, p in passages.parts(data, 51) for h in p.runs(np.arange(len(p.starts) - 50), 51).tolist()]
        with monkeypatch.context() as m:
            m.setattr(passages, "PART", 64)
            cut = [h for _, p in passages.parts(data, 51) for h in p.runs(np.arange(len(p.starts) - 50), 51).tolist()]
        assert cut == whole


def test_shared_windows_on_table_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(rows)
    want = {ids[i]: n for i, n in brute([rows[i] for i in ids], 51).items()}
    assert {r["id"]: r["n_shared_windows"] for r in passages.shared_windows(docs).collect()} == want and want
    assert passages.shared_windows(docs_of(spark, EDGE, ids=[1, 2, 3, None, 5, 6, 6, 7])).count() == 0
    assert passages.shared_windows(docs.limit(0)).count() == 0
    twice = docs_of(spark, [" ".join(["a"] * 60)] * 3, ids=[1, 1, 2])
    assert sorted((r["id"], r["n_shared_windows"]) for r in passages.shared_windows(twice).collect()) == [(1, 10), (2, 10)]
