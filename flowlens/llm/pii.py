"""Personal data in texts (operator 5).

Regular expressions propose spans, validators confirm them, and words near a
span move its score; what reaches the threshold is kept. Four base kinds
(e-mail, IPv4 address, payment card, international phone number) are decided by
pattern and validator alone: their score starts at the threshold and context
only raises it. Further kinds need a checksum or context words to reach it.

Defined results: a null text counts as empty; offsets are code points, the end
is exclusive; each kind's spans do not overlap among themselves, the leftmost of two
that would winning; rows are independent, so repeated rows give repeated results and an
empty table an empty one; texts of any length are read whole, in time linear in it. Other
columns, whatever their names, are not read; ``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BASE = ("email", "ip", "card", "phone")
THRESHOLD, NEAR = 0.5, 48

# Possessive forms that match what the plain patterns match but stay linear on
# very long runs: a match never starts inside a run of its first character class,
# because a start further left would have matched as well.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{18,128})(?![A-Za-z0-9])")
ANY_WORD = re.compile(r"[^\W\d_]+")


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def n_digits(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from the @ outwards: the local part is the run to its left."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def spans_of(pattern: re.Pattern, needs: str = "") -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text)) if needs in text else iter(())


@dataclass(frozen=True)
class Kind:
    name: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    valid: Callable[[str], bool]
    score: float
    words: frozenset[str]
    boost: float = 0.3


KINDS = (
    Kind("email", emails, lambda s: True, 0.5, frozenset({"mail", "email", "contact", "write"})),
    Kind("ip", spans_of(IP, "."), lambda s: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in s.split(".")), 0.5, frozenset({"ip", "address", "host", "server"})),
    Kind("card", spans_of(CARD), lambda s: 12 <= n_digits(s) <= 19 and luhn(s), 0.5, frozenset({"card", "visa", "mastercard", "credit", "payment"})),
    Kind("phone", spans_of(PHONE, "+"), lambda s: 9 <= n_digits(s) <= 15, 0.5, frozenset({"phone", "call", "tel", "mobile", "fax"})),
    Kind("iban", spans_of(IBAN), mod97, 0.5, frozenset({"iban", "account", "bank"})),
    Kind("ssn", spans_of(SSN, "-"), lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000", 0.3, frozenset({"ssn", "social", "security"})),
    Kind("secret", spans_of(SECRET), lambda s: any(c.isdigit() for c in s) and not s.isdigit(), 0.3, frozenset({"password", "passwd", "token", "secret", "key", "apikey", "credential"})),
)


def in_context(text: str, start: int, end: int, words: frozenset[str]) -> bool:
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR // 2]
    return not words.isdisjoint(w.lower() for w in ANY_WORD.findall(around))


def find(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) of every span at or above the threshold, by start and then by kind."""
    if not text:
        return []
    found = []
    for order, kind in enumerate(KINDS):
        for start, end in kind.propose(text):
            piece = text[start:end]
            if kind.valid(piece):
                score = kind.score + kind.boost * in_context(text, start, end, kind.words)
                if kind.name == "secret" and piece.startswith("AKIA"):
                    score += 0.3
                if score >= threshold:
                    found.append((start, order, kind.name, end, round(score, 3)))
    return [(s, k, e, v) for s, _, k, e, v in sorted(found)]


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, entities (array of kind, start, end, score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "entities": [[(k, s, e, v) for s, k, e, v in find(t, threshold)] for t in batch["text"]]})

    small_batches(docs.sparkSession)
    schema = "doc_id long, entities array<struct<kind:string,start:int,`end`:int,score:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def joined(entities: Column) -> Column:
    return F.array_join(F.transform(entities, lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda k: k == kind


def digest(detected: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans."""
    base = F.filter("entities", lambda e: e["kind"].isin(*BASE))
    counts = [F.size(F.filter(F.transform("entities", lambda e: e["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return detected.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("entities")).alias("spans"))


def redacted(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """``text`` with every span replaced by its kind; of spans that overlap, the
    first names the replacement."""
    if not text:
        return text
    out, done = [], 0
    for start, kind, end, _ in find(text, threshold):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:] if out else text


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data replaced; n_chars, where present, follows."""

    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, threshold), na_action="ignore")

    small_batches(docs.sparkSession)
    out = docs.withColumn("text", F.pandas_udf(mask, "string")(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def base_digest_plain(text: str | None) -> str:
    """The base spans by the plain patterns, for tests."""
    text, out = text or "", []
    for order, (kind, pattern, ok) in enumerate(
        (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", KINDS[0].valid),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", KINDS[1].valid),
            ("card", r"[0-9]([\x20-]?[0-9])+", KINDS[2].valid),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", KINDS[3].valid),
        )
    ):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out)).encode()).hexdigest()
