"""The quality classifier: features and updates against plain Python, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowlens.llm import quality, queries
from flowlens.llm.common import WORD, table

from ..conftest import SF


def plain_tokens(text):
    """(token, shape) by a loop over characters."""
    out, before = [], None
    kind = lambda c: 0 if c.isspace() or c == "\0" else 2 if WORD.fullmatch(c) else 1
    i = 0
    while i < len(text):
        j = i
        while j < len(text) and kind(text[j]) == kind(text[i]):
            j += 1
        word = text[i:j]
        if kind(text[i]) == 2:
            caps = sum(c.isupper() for c in word)
            form = "low" if not caps else "all" if caps == len(word) > 1 else "first" if word[0].isupper() else "mixed"
            out.append((word, (form, any(c.isdigit() for c in word), word == before)))
            before = word
        elif kind(text[i]) == 1:
            out.append((word, word))
        i = j
    return out


TEXTS = ["", "One two two Two THREE 4th ab12 iPhone !! ## !!", "día Ñandú的 été — «x»\n\n\tend.", "Oneaea Oneaea Oneaea.", "###", "\0 a\0b"]


@pytest.mark.parametrize("text", TEXTS + [" ".join(TEXTS) * 50])
def test_features_against_plain_python(monkeypatch, text):
    want = Counter()
    parts = plain_tokens(text)
    for salt, (row, n) in enumerate((([t for t, _ in parts], 1), ([t for t, _ in parts], 2), ([s for _, s in parts], 2), ([s for _, s in parts], 3))):
        grams = Counter(tuple(row[i : i + n]) for i in range(len(row) - n + 1))
        want.update((salt, round(math.sqrt(k / grams.total()), 5)) for k in grams.values())
    for span in (quality.SPAN, 7):
        monkeypatch.setattr(quality, "SPAN", span)
        places, values = quality.features(text)
        assert sorted(round(float(v), 5) for v in values) == sorted(v for (_, v), k in want.items() for _ in range(k))
        only = np.zeros(quality.SPACE, bool)
        only[places[::2]] = True
        few, part = quality.features(text, only)
        assert sorted(zip(few.tolist(), part.tolist(), strict=True)) == sorted((p, v) for p, v in zip(places.tolist(), values.tolist(), strict=True) if only[p])


def test_updates_against_plain_python():
    rng = np.random.default_rng(3)
    learner, z, n = quality.Learner(), defaultdict(float), defaultdict(float)

    def weight(i):
        free = i != quality.SPACE
        if abs(z[i]) <= quality.L1 * free:
            return 0.0
        return -(z[i] - math.copysign(quality.L1 * free, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2 * free)

    for _ in range(60):
        x = {int(i): float(v) for i, v in zip(rng.integers(0, 30, 8), rng.random(8), strict=True)}
        y, k = float(rng.random() < 0.4), float(rng.random() + 0.5)
        learner.learn(np.array(list(x)), np.array(list(x.values())), y, k)
        x[quality.SPACE] = 1.0
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = k * (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
            n[i] += g * g
    got = learner.weights()
    assert all(abs(got[i] - weight(i)) < 1e-9 for i in z) and (got != 0).any()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    marks = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect() if r["quality"] is not None}
    rows = queries.op11_quality_classifier(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    judged = [(marks[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    good, bad = [s for m, s, _ in judged if m], [s for m, s, _ in judged if not m]
    assert sum(p for m, _, p in judged if m) >= 0.98 * len(good)
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_held_out_labels_do_not_teach(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    swapped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(docs, x).collect()} for x in (labels, swapped))
    assert a == b and len(set(a.values())) > 10
    # whatever the partitions of the documents
    assert {r["doc_id"]: r["score"] for r in quality.classify(docs.repartition(3), labels.repartition(5)).collect()} == a


def test_odd_rows(spark):
    junk, fine = "a## b!! c## d!! e##", "This is a plain text of some words."
    rows = [(i, junk + f" x{i}" if i % 2 else fine + f" y{i}", "en", "s", 1, 1.0, 3, "z") for i in range(1, 41)]
    odd = [(100, None, None, None), (101, "", "en", "s"), (102, junk * 5000, "en", "s"), (103, fine * 5000, "en", "s"), (None, fine, "en", "s"), (None, None, None, None), (1, rows[0][1], "en", "s"), (104, "?", "de", "t")]
    frame = spark.createDataFrame(rows + [(*r, 1, 1.0, 3, "z") for r in odd], "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, places string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(1, 41)] + [(1, 0), (999, 1), (2, None), (None, 1)], "doc_id long, quality int")
    out = quality.classify(frame, labels).collect()
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append(r["score"])
        assert r["predicted"] == (r["score"] >= 0.3) and r["held_out"] is not None
    assert Counter({k: len(v) for k, v in got.items()}) == Counter(r[0] for r in [*rows, *odd])
    assert got[100] == got[101] and len(set(got[1])) == 1 and got[102][0] < 0.3 < got[103][0]
    assert quality.classify(frame.limit(0), labels).collect() == []
    assert {r["score"] for r in quality.classify(frame, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in quality.classify(frame, labels.where("quality = 1")).collect()} == {1.0}
