"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

The base kinds (email, ip, card, phone) are leftmost non-overlapping matches that pass their validator; they always stay.
The method adds international bank account numbers (mod 97), social security numbers and secrets (runs of mixed letters and
digits, or keys of a published format), which need a score of at least MIN_SCORE: a pattern with a checksum or a format of its own
starts higher than one without, and words of its kind nearby raise it. So a number that only looks like a social security number, or a
long identifier, needs such a word.

Defined cases: a null text is empty and has no span; positions are code points with exclusive ends; repeated rows each
have a result; an empty table gives no rows; texts are searched whole, in time in proportion to their length; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, tune

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match begins where a run of digits does and takes whole runs, so nothing is tried twice, however long the runs.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,128}(?![A-Za-z0-9_-])")
#: Published formats of access keys and tokens.
FORMATS = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}")

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "bank", "account", "konto"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "key", "password", "passwd", "credential", "bearer"),
}
#: Of a span that its validator confirmed (or that has none), before its context.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
#: Of a secret in a published format.
START_FORMAT = 0.8
NEAR, PER_WORD, MIN_SCORE = 40, 0.2, 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def random_looking(run: str) -> bool:
    """Letters and digits mixed, of at least 2.5 bits a character: what 16 random hexadecimal digits practically always reach."""
    n = len(run)
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and -sum(k / n * math.log2(k / n) for k in Counter(run).values()) >= 2.5


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """EMAIL's matches, found from the at signs: trying the pattern at each place of a long word is quadratic."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            done = m.end()
            yield m.span()
        at = text.find("@", max(at + 1, done))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *span) for span in _emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def added_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("iban", *m.span()) for m in IBAN.finditer(text) if mod97(m.group())]
    found += [("ssn", *m.span()) for m in SSN.finditer(text) if m.group()[:3] not in ("000", "666") and m.group()[0] != "9"]
    found += [("secret", *m.span()) for m in SECRET.finditer(text) if FORMATS.fullmatch(m.group()) or random_looking(m.group())]
    return [x for x in found if span_score(text, *x) >= MIN_SCORE]


def span_score(text: str, kind: str, start: int, end: int) -> float:
    around = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
    words = set(re.findall(r"[^\W\d_]+", around))
    start_at = START_FORMAT if kind == "secret" and FORMATS.fullmatch(text, start, end) else START[kind]
    return min(1.0, start_at + PER_WORD * sum(w in words for w in CONTEXT[kind]))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, score), by kind as in BASE + ADDED, then start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                rows.append([{"kind": k, "start": a, "end": b, "score": span_score(t, k, a, b)} for k, a, b in base_spans(t) + added_spans(t)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    tune(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from spans(): counts and hash of the base kinds, all spans as text, how many the method added, and how many there are."""
    text = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) as n_{k}") for k in BASE]
    added = F.size(F.filter("spans", lambda s: s["kind"].isin(*ADDED))).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), added, F.size("spans").cast("long").alias("n_spans"))


def sha256_of(spans_text: str) -> str:
    return hashlib.sha256(spans_text.encode()).hexdigest()
