"""The source divergence audit against plain Python, over odd rows; its SQL form is compared on the tables."""

import re
from collections import Counter, defaultdict

from flowlens.llm import divergence
from flowlens.llm.common import table

from ..conftest import SF


def brute(rows):
    """(lang, source, part, item, value, rank) with every term of every source spelled out."""
    docs = [(la or "", s or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for la, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, total = Counter(), Counter()
        by = defaultdict(Counter)
        for la, s, words in docs:
            if la == lang:
                df.update(set(words))
                by[s].update(words)
        kept = {w for w, k in df.items() if k >= 10}
        for c in by.values():
            total.update({w: k for w, k in c.items() if w in kept})

        def shares(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in by.items()}, shares(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by:
            pair = sorted(((o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in by if o != s), key=lambda x: (-x[1], x[0].encode()))
            term = sorted(((w, f(p[s][w], q[w])) for w in kept if by[s][w] and p[s][w] > q[w]), key=lambda x: (-x[1], x[0].encode()))[:10]
            out += [(lang, s, "pair", i, v, k) for k, (i, v) in enumerate(pair, 1)] + [(lang, s, "term", i, v, k) for k, (i, v) in enumerate(term, 1)]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in divergence.audit(frame).collect())


def test_against_brute_force(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    want = brute([(r["lang"], r["source"], r["text"]) for r in docs.collect()])
    assert got(docs) == want
    # few terms at once in a task, few cells at once in a block
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "CELLS", 7)
    assert got(docs.repartition(3)) == want


def test_tokens():
    assert divergence.terms_of("Ünïted STATES' e-mail 4x4\tÀ_b\x00c 日本".encode()) == ["Ünïted".encode(), b"states", b"e", b"mail", b"x", "À".encode(), b"b", b"c", "日本".encode()]


def test_odd_rows(spark):
    rows = [("en", "a", "The cat and THE dog")] * 12 + [("en", "b", "the bird ünd Ünd")] * 11 + [("en", None, None), ("en", "c", ""), ("en", "d", "123 ... 456"), (None, "a", "alone the"), (None, None, "le the"), ("", "x", None)]
    rows += [("de", "a", "das " * 50_000 + "Haus")] * 10 + [("de", "b", "das Haus")] * 3 + [("de", "c", "eins zwei")] + [("fr", "only", "un mot")]
    frame = spark.createDataFrame([(i % 7 or None, t, la, s, 1, "term", 2, 3) for i, (la, s, t) in enumerate(rows)], "doc_id int, text string, lang string, source string, n int, term string, docs int, p int")
    assert got(frame) == brute(rows)
    assert got(frame.limit(0)) == []
    assert got(frame.where("lang = 'fr'")) == []
