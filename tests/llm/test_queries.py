"""The SQL form of operator 8, and the pipeline against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb

import corpus_pipeline
from flowlens.llm import langid, mixing, pii, probminhash, queries
from flowlens.llm.common import table

from ..conftest import SF
from .test_spark import none, odd  # noqa: F401


def test_preferences_sql(spark):
    for folder in (SF, "/root/testdata/sf0.01"):
        con = duckdb.connect()
        for f in os.listdir(folder):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
        got = con.execute(queries.ORACLE_SQL["op8_preference_formatting"])
        names = [c[0] for c in got.description]
        out = queries.op8_preference_formatting(spark, folder).select(*names)
        assert sorted(map(tuple, out.collect())) == sorted(got.fetchall())


def test_pipeline_against_brute_force(spark):
    docs = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    frames, now = {}, table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.saved(stage(spark, now, SF), name)
        frames[name] = {r["doc_id"]: r for r in now.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == table(spark, SF, "documents").columns
    lang, near, clean, masked, mixed = (frames[n] for n, _ in corpus_pipeline.STAGES)
    assert set(lang) == {i for i, r in docs.items() if any(c.isalpha() for c in r["text"])}
    keys = {i: probminhash.Shingler().keys(probminhash.words_of(r["text"])) for i, r in lang.items()}
    alike = lambda i, j: 0.5 < len(keys[i]) / len(keys[j]) < 2 and probminhash.probability_jaccard(keys[i], keys[j]) >= 0.8
    ids = sorted(lang)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and root[i] != root[j] and alike(i, j):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert set(near) == {i for i in ids if root[i] == i}
    assert {i for i, r in near.items() if any(t in r["text"] for t in items)} <= set(near) - set(clean)
    assert len(near) - len(clean) <= 2 + sum(any(t[:40] in r["text"] for t in items) for r in near.values())
    assert set(masked) == set(clean) and all(r["text"] == pii.redacted(clean[i]["text"]) and r["n_chars"] == len(r["text"]) for i, r in masked.items())
    assert 0 < len(mixed) < len(masked) and all(mixed[i]["text"] == masked[i]["text"] for i in mixed)
    tokens = sum(len(r["text"].split()) for r in masked.values())
    assert 0.3 < sum(len(r["text"].split()) for r in mixed.values()) / tokens < 0.7
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(mixed)


def test_stages_on_odd_rows(spark, odd, none):  # noqa: F811
    for docs in (odd, none):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.saved(stage(spark, now, SF), name)
            assert now.columns[: len(odd.columns)] == odd.columns
    assert langid.held_out() is not None and mixing.NONE == "(none)"


def test_mixing_query_against_brute_force(spark):
    """Raking and calibration written out with plain dictionaries."""
    docs = [(r["doc_id"], r["source"], r["lang"], r["text"] or "") for r in table(spark, SF, "documents").collect()]

    def topic(text):
        return next((n for n, m in mixing.TOPICS if m in text), mixing.OTHER_TOPIC)

    cell_of = {i: (s or mixing.NONE, la or mixing.NONE, topic(t)) for i, s, la, t in docs}
    size = {i: len(t.split()) for i, _, _, t in docs}
    tokens = {}
    for i, c in cell_of.items():
        tokens[c] = tokens.get(c, 0) + size[i]
    tokens = {c: n for c, n in tokens.items() if n}
    whole = sum(tokens.values())
    targets = []
    for j, d in enumerate(mixing.DIMS):
        have = {}
        for c, n in tokens.items():
            have[c[j]] = have.get(c[j], 0) + n
        t = mixing.TARGETS[d]
        if isinstance(t, dict):
            rest = sum(n for k, n in have.items() if k not in t)
            want = {k: t[k] if k in t else t[mixing.REST] * n / rest for k, n in have.items()}
        else:
            want = {k: n**t for k, n in have.items()}
        targets.append({k: v / sum(want.values()) for k, v in want.items()})
    w = {c: n / whole for c, n in tokens.items()}
    for _ in range(mixing.SWEEPS):
        for j in range(3):
            have = {}
            for c, v in w.items():
                have[c[j]] = have.get(c[j], 0) + v
            w = {c: v * targets[j][c[j]] / have[c[j]] for c, v in w.items()}
    lo, hi = 0.0, 1e12
    for _ in range(200):  # the factor at which the expected tokens are half of all
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(n, mid * w[c]) for c, n in tokens.items()) < whole / 2 else (lo, mid)
    got = {r["doc_id"]: r for r in queries.op1_ipf_mixing(spark, SF).collect()}
    assert got.keys() == cell_of.keys()
    for i, r in got.items():
        p = min(1.0, lo * w[cell_of[i]] / tokens[cell_of[i]]) if size[i] else 0.0
        assert abs(r["probability"] - p) < 1e-5
        draw = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
        assert abs(draw - p) < 1e-5 or r["sampled"] == (draw < p)


def test_language_query_labels_every_document_alike(spark):
    """Whatever the partitions, each whole text gets the label of the model fitted on the other rows."""
    docs = table(spark, SF, "documents")
    model = langid.fit(docs.where("doc_id IS NOT NULL").where(~langid.held_out()))
    got = {r["doc_id"]: r["lang_pred"] for r in queries.op7_language_id(spark, SF).collect()}
    again = {r["doc_id"]: r["lang_pred"] for r in langid.label(docs.repartition(3), model).collect()}
    assert got == again and len(got) == docs.count()


def test_language_query_against_plain_python(spark):
    """Trigram counts, scores and the search over switches written out once more, for every document."""
    docs = [(r["doc_id"], r["text"] or "", r["lang"]) for r in table(spark, SF, "documents").collect()]
    learn = [(t, la) for i, t, la in docs if la is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({la for _, la in learn})
    count, scripts = {la: Counter() for la in langs}, {la: Counter() for la in langs}
    for text, la in learn:
        for w in re.findall(r"[^\W\d_]+", text):
            s = f"^{w.lower()}$"
            count[la].update(s[i : i + 3] for i in range(len(s) - 2))
            scripts[la][langid.script(w)] += sum(c.isalpha() for c in w)
    count = {la: dict(sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[: langid.GRAMS]) for la, n in count.items()}
    kinds = len({g for n in count.values() for g in n})
    norm = {la: math.log(sum(n.values()) + langid.SMOOTH * kinds) for la, n in count.items()}
    uses = {la: {k for k, v in n.items() if v >= langid.SCRIPT_SHARE * n.total()} for la, n in scripts.items()}
    cache = {}

    def scores(w):
        if w not in cache:
            s = f"^{w.lower()}$"
            of = [sum(math.log(count[la].get(s[i : i + 3], 0) + langid.SMOOTH) - norm[la] for i in range(len(s) - 2)) for la in langs]
            ok = [langid.script(w) in uses[la] for la in langs]
            top = max((x for x, o in zip(of, ok, strict=True) if o), default=0.0)
            cache[w] = [(x - top if o else langid.FOREIGN) if any(ok) else 0.0 for x, o in zip(of, ok, strict=True)]
        return cache[w]

    got = {r["doc_id"]: r for r in queries.op7_language_id(spark, SF).collect()}
    assert got.keys() == {i for i, _, _ in docs}
    for i, text, _ in docs:
        words = re.findall(r"[^\W\d_]+", text)
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["n_spans"]) == ("und", 0.0, 0)
            continue
        value, back = scores(words[0]), []
        for w in words[1:]:
            top = max(range(len(langs)), key=lambda k: (value[k], -k))
            back.append([k if value[k] >= value[top] - langid.SWITCH else top for k in range(len(langs))])
            value = [max(v, value[top] - langid.SWITCH) + s for v, s in zip(value, scores(w), strict=True)]
        path = [max(range(len(langs)), key=lambda k: (value[k], -k))]
        for step in reversed(back):
            path.append(step[path[-1]])
        path.reverse()
        held = Counter()
        for k, w in zip(path, words, strict=True):
            held[k] += len(w)
        best = min(held, key=lambda k: (-held[k], k))
        assert got[i]["lang_pred"] == langs[best] and math.isclose(got[i]["score"], held[best] / held.total(), rel_tol=1e-9)
        assert got[i]["n_spans"] == 1 + sum(a != b for a, b in zip(path, path[1:], strict=False))
