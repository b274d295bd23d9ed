"""The grammar against a plain evaluation of its rules, token by token."""

import math
import random

import pytest

from chronopanel.llm import toxicity


def clauses(text):
    out = [[]]
    for w in toxicity.TOKEN.findall(text.lower()):
        if w in toxicity.CLAUSE_END:
            out.append([])
        else:
            out[-1].append(w)
    return out


def clause_score(words, lexicon):
    own = [lexicon.weight(w) for w in words]
    kinds = ["I" if x else toxicity.CLASS_OF.get(w, "*") for w, x in zip(words, own, strict=True)]
    score, last, insulted, waiting = 0.0, 0.0, False, None
    for k, kind in enumerate(kinds):
        before = lambda c, n, k=k: c in kinds[max(0, k - n) : k]
        if kind == "U" and waiting is not None and k - waiting <= 4:
            score += last
            waiting = None
        if kind not in "IT":
            continue
        weight = own[k] or toxicity.THREAT_WEIGHT
        weight *= 0.6 if "R" in kinds[:k] else 1.0
        if before("N", 3):
            if kind == "I":
                last, insulted = 0.25 * weight, True
                score += last
            continue
        directed, threat = before("U", 4), kind == "T" and before("M", 3)
        if kind == "T" and not threat:
            continue
        weight *= (1.5 if directed else 1.0) * (2.0 if threat else 1.0)
        if kind == "I" and not directed and not insulted:
            weight *= toxicity.BARE
        if not directed:
            waiting = k
        insulted |= kind == "I"
        last = weight
        score += weight
    return score


def plain_features(text, lexicon):
    found = [clause_score(c, lexicon) for c in clauses(text)]
    n = len(toxicity.TOKEN.findall(text.lower()))
    return math.log1p(sum(found)), max(found), 30.0 * sum(found) / (n + 30)


def test_machine_equals_its_rules_on_random_clauses():
    rng = random.Random(9)
    lexicon, machine = toxicity.Lexicon({"idiot$": 2.0, "scum$": 3.0, "moro": 1.0}), toxicity.grammar()
    words = "idiot scum moronic kill hurt will gonna you your not never said wrote the a word . ! ;".split()
    for _ in range(4000):
        text = " ".join(rng.choices(words, k=rng.randint(0, 30)))
        assert toxicity.features(text, lexicon, machine) == pytest.approx(plain_features(text, lexicon)), text


def test_machine_equals_its_rules_on_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    scores = {}
    for i, t in texts.items():
        x = model.beta[0] + sum(b * f for b, f in zip(model.beta[1:], plain_features(t, model.lexicon), strict=True))
        scores[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    assert got == pytest.approx(scores) and len({round(s, 9) for s in scores.values()}) > 5


def test_reporting_verb_far_back_in_a_clause_counts():
    lexicon, machine = toxicity.Lexicon({"idiot$": 2.0}), toxicity.grammar()
    top = lambda t: toxicity.features(t, lexicon, machine)[1]
    assert top("she said " + "word " * 60 + "idiot") == top("she said idiot") < top("word " * 60 + "idiot")


def test_directions_and_bare_words():
    lexicon, machine = toxicity.Lexicon({"idiot$": 2.0}), toxicity.grammar()
    top = lambda t: toxicity.features(t, lexicon, machine)[1]
    assert top("idiot") == 1.0 < top("idiot you") == 2.0 < top("you idiot") == 3.0
    assert top("the idiot is an idiot") == 3.0
    assert top("she said it is not an idiot") == pytest.approx(0.6 * top("it is not an idiot"))
    assert top("i will kill you") > top("i will kill it") > top("kill") == 0
