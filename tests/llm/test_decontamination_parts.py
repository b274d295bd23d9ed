"""Items that a document holds in parts."""

import random

from chronopanel.llm import decontaminate
from tests.llm.test_text_operators import brute_matches, docs_of


def test_question_and_answer_far_apart_are_found():
    question, answer = [f"q{i}" for i in range(12)], [f"a{i}" for i in range(12)]
    items = [(1, f"{' '.join(question)}. {' '.join(answer)}."), (2, "other words of another item. that nobody has used here.")]
    filler = " ".join(f"f{i}" for i in range(400))
    docs = [f"{' '.join(question)} {filler} {' '.join(answer)}", f"{' '.join(question)} {filler}"]
    assert [[i for i, _ in f] for f in decontaminate.Index(items).search(docs)] == [brute_matches(d, items) for d in docs] == [[1], []]


def test_results_do_not_depend_on_the_split(spark):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.expovariate(0.02))}" for _ in range(3000)]
    items = [(i // 2 if i < 6 else i, " ".join(rng.choices(vocabulary, k=rng.randint(6, 60))) + ". " + " ".join(rng.choices(vocabulary, k=7)) + ".") for i in range(30)]
    items.append((None, "an item without any id. it is found all the same by its words."))
    texts = [" ".join([*rng.choices(vocabulary, k=80), rng.choice(items)[1], *rng.choices(vocabulary, k=30)]) for _ in range(40)]
    texts += [items[0][1], items[1][1], items[-1][1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    want = {r["doc_id"]: (r["item_ids"], round(r["best_score"], 9)) for r in decontaminate.matches(docs, benchmark).collect() if r["item_ids"]}
    assert len(want) == len(texts) and want[40][0] == want[41][0] == [0] and want[42][0] == [None]  # two texts of one id
    for words in (1, 100, 400):
        got = {r["doc_id"]: (r["item_ids"], round(r["best_score"], 9)) for r in decontaminate.matches(docs, benchmark, words).collect() if r["item_ids"]}
        assert got == want
    assert decontaminate.clean(docs, benchmark, 400).count() == 0
