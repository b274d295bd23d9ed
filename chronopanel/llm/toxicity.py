"""Toxicity by a weighted finite-state pattern grammar.

Tokens become classes (insult, threat verb, intent, second-person target, negation, reporting verb, other). Weighted transducers
rewrite the classes of a clause from left to right and are composed into one machine:

- negation: an insult or threat verb up to three tokens after it is weakened;
- reported speech: all that follows a reporting verb in its clause is weakened, negated or not;
- target: an insult or threat verb up to four tokens after a target is a directed one; a target up to four tokens after an insult or
  threat that was not directed before makes up for it;
- threat: an intent and up to three tokens later a threat verb are a threat; a threat verb alone is none;
- insult: accepts directed and negated insults, threats, and a second insult of a clause in full, a lone undirected insult at half weight.

The machine runs over whole clauses that hold an insult or threat verb; a document's score is a logistic function of its matched
clauses' weights, never of words alone, language or source.

The insult lexicon has seed stems and stems learned from labelled rows: word beginnings that occur in more toxic than clean
documents, weighted by log odds. Lexicon and logistic function are fitted on at most FIT_ROWS rows of either label (those
with the smallest hashes), which bounds the lexicon; counts are summed on the executors, only the kept stems and four numbers a row
reach the driver.

Defined cases: a null or empty text has no clause and the intercept's score; a null doc_id is never a fitting row; repeated
labels of a document count as toxic if any is; repeated rows score alike; whole texts are read, however long; no labels at all give the
seed lexicon and default coefficients; no documents give no rows; scored ignores other columns, clean keeps them whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, kept_by_text, staged, text_or_empty, tune

FIT_ROWS = 4000
MIN_SUPPORT = 4
MIN_LOG_ODDS = 1.8
THRESHOLD = 0.3
THREAT_WEIGHT = 1.5
SHORT, LONG = 4, 9  # letters of a stem; a whole word counts as a stem of its own

SEEDS = {w: 3.0 for w in "idiot moron stupid scum trash loser worthless pathetic disgusting clown imbecile idiota imbécile crétin dummkopf abschaum estúpido basura".split()}
CLASSES = {
    "T": "kill hurt destroy beat punish crush burn töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    "M": "will gonna shall werde werden vais allons voy vamos",
    "U": "you your you're u du dich dir ihr euch tu te toi vous votre ton tú ti usted ustedes vosotros",
    "N": "not no never isn't aren't don't neither nicht kein keine nie pas jamais aucun sin nunca ningún",
    "R": "said says say wrote called reported claims sagte sagt schrieb dit disait écrit dijo dice escribió",
}
CLASS_OF = {w: c for c, words in CLASSES.items() for w in words.split()}
TOKEN = re.compile(r"[^\W_]+(?:'[a-z]+)?|[.!?;:\n]")
CLAUSE_END = frozenset(".!?;:\n")


class Transducer:
    """Deterministic and weighted: (state, class) -> (state, class, factor); what is not listed stays as it is."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]]):
        self.arcs = arcs

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or self.arcs.get((state, "*"), (state, "*", 1.0))[:1] + (symbol, 1.0)


class Composed:
    """The machines in a row, with a memo of composite states: one lookup a token once a state has been seen."""

    def __init__(self, machines: list[Transducer]):
        self.machines = machines
        self.start = (0,) * len(machines)
        self.memo: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str, float]] = {}

    def step(self, states: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str, float]:
        got = self.memo.get((states, symbol))
        if got is None:
            out, weight, after = symbol, 1.0, []
            for machine, state in zip(self.machines, states, strict=True):
                state, out, w = machine.step(state, out)
                after.append(state)
                weight *= w
            got = self.memo[states, symbol] = (tuple(after), out, weight)
        return got


def _countdown(triggers: str, scope: int, effect: dict[str, tuple[str, float]], once: bool = False) -> Transducer:
    """After a trigger, for scope tokens, classes in effect are rewritten and weighted; once: the first of them ends the scope."""
    arcs = {(s, t): (scope, t, 1.0) for s in range(scope + 1) for t in triggers}
    for s in range(1, scope + 1):
        arcs |= {(s, k): (0 if once else s - 1, out, w) for k, (out, w) in effect.items()}
        arcs[s, "*"] = (s - 1, "*", 1.0)
    return Transducer(arcs)


BARE = 0.5
NEGATION = _countdown("N", 3, {"I": ("i", 0.25), "T": ("t", 0.25)})
REPORTED = Transducer({(0, "R"): (1, "R", 1.0), **{(1, k): (1, k, 0.6) for k in "IiTt"}})
TARGET_BEFORE = _countdown("U", 4, {"I": ("J", 1.5), "T": ("D", 1.5)})
THREAT = _countdown("M", 3, {"T": ("H", 2.0), "D": ("K", 2.0)})
TARGET_AFTER = _countdown("IH", 4, {"U": ("+", 1.0)}, once=True)  # adds as much again as the insult or threat has got
INSULT = Transducer({(0, "I"): (1, "!", BARE), (1, "I"): (1, "!", 1.0), **{(s, k): (1 if k in "iJ" else s, "!", 1.0) for s in (0, 1) for k in "iJHK"}})


def grammar() -> Composed:
    return Composed([NEGATION, REPORTED, TARGET_BEFORE, THREAT, TARGET_AFTER, INSULT])


def stems_of(word: str) -> list[str]:
    return [word[:k] for k in range(SHORT, min(LONG, len(word)) + 1)] + [word + "$"]


class Lexicon:
    """Weight of a word: that of its whole form, else of its longest known beginning."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.heads = frozenset(s.rstrip("$")[:SHORT] for s in weights)

    def weight(self, word: str) -> float:
        found = self.weights.get(word + "$")
        for k in range(min(LONG, len(word)), SHORT - 1, -1) if found is None else ():
            found = self.weights.get(word[:k])
            if found is not None:
                break
        return found or 0.0


def features(text: str, lexicon: Lexicon, machine: Composed) -> tuple[float, float, float]:
    """log(1 + sum), maximum and share of words of the matched clauses' weights."""
    words = TOKEN.findall(text.lower())
    heads, threats = lexicon.heads, CLASS_OF
    weights = {i: w for i, x in enumerate(words) if x[:SHORT] in heads and (w := lexicon.weight(x))}
    hits = sorted(weights.keys() | ({i for i, x in enumerate(words) if threats.get(x) == "T"} if not _THREATS.isdisjoint(words) else set()))
    total, top, done = 0.0, 0.0, -1
    for i in hits:
        if i <= done:
            continue
        lo = i
        while lo > 0 and words[lo - 1] not in CLAUSE_END:
            lo -= 1
        state, score, last, done = machine.start, 0.0, 0.0, len(words)
        for k in range(lo, len(words)):
            if words[k] in CLAUSE_END:
                done = k
                break
            own = weights.get(k, 0.0)
            state, out, w = machine.step(state, "I" if own else threats.get(words[k], "*"))
            if out == "!":
                last = w * (own or THREAT_WEIGHT)
                score += last
            elif out == "+":
                score += w * last
        total += score
        top = max(top, score)
    return math.log1p(total), top, 30.0 * total / (len(words) + 30)


_THREATS = frozenset(w for w, c in CLASS_OF.items() if c == "T")


class Model:
    def __init__(self, weights: dict[str, float], beta: list[float]):
        self.lexicon, self.beta, self.machine = Lexicon(weights), beta, grammar()

    def score(self, text: str) -> float:
        x = self.beta[0] + sum(b * f for b, f in zip(self.beta[1:], features(text, self.lexicon, self.machine), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))

    def __getstate__(self):
        return {"weights": self.lexicon.weights, "beta": self.beta}

    def __setstate__(self, s):
        self.__init__(s["weights"], s["beta"])


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fitting_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of at most rows documents of either label outside fold 2, and how many there are of each."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = staged(marks.filter(fold(F.col("doc_id")) != 2), "toxic-marks")
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    picked = parts[0].unionByName(parts[1])  # at most 2 * rows rows of two numbers
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic"), counts


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update({s for w in set(TOKEN.findall(text.lower())) if len(w) >= SHORT for s in stems_of(w)})
    for toxic, c in counts.items():
        keys = list(c)
        for i in range(0, len(keys), 20_000):
            part = keys[i : i + 20_000]
            n = pa.array([c[k] for k in part], pa.int64())
            zero = pa.array([0] * len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), n if toxic else zero, zero if toxic else n], names=["stem", "a", "b"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    spark = docs.sparkSession
    tune(spark)
    sample, counts = fitting_rows(docs, labels, rows)
    sample = staged(sample, "toxic-sample")
    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = seen.get(1, 0), seen.get(0, 0)
    if not n1 or not n0:
        return Model(dict(SEEDS), [-3.0, 1.5, 0.2, 0.0])
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    stems = sample.mapInArrow(_count_stems, "stem string, a long, b long").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") >= MIN_SUPPORT)
    kept = stems.withColumn("w", odds).filter((F.col("w") >= MIN_LOG_ODDS) & (F.col("w") > 2.5 * spread)).orderBy(F.desc(F.col("w") / spread), "stem")
    weights = {f"{k}$": v for k, v in SEEDS.items()} | {r["stem"]: float(r["w"]) for r in kept.select("stem", "w").collect()}
    model = Model(weights, [0.0, 0.0, 0.0, 0.0])
    rows_of = sample.mapInArrow(_featurise(model), "f1 double, f2 double, f3 double, toxic int").collect()
    x = np.array([[1.0, r[0], r[1], r[2]] for r in rows_of])
    y = np.array([float(r[3]) for r in rows_of])
    share = np.where(y == 1, counts[1] / n1, counts[0] / n0)  # undo the even sampling of labels
    return Model(weights, logistic(x, y, share))


def _featurise(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [features(t, model.lexicon, model.machine) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([v[i] for v in f], pa.float64()) for i in range(3)), batch.column(1).cast(pa.int32())], names=["f1", "f2", "f3", "toxic"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> list[float]:
    """Weighted ridge logistic regression by Newton steps."""
    beta, w = np.zeros(x.shape[1]), w / w.mean()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta = beta + step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return [float(b) for b in beta]


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([model.score(t) for t in batch.column(1).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    tune(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, in one pass."""
    tune(docs.sparkSession)
    return kept_by_text(docs, lambda texts: [model.score(t or "") < threshold for t in texts])
