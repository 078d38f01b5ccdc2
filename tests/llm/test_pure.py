"""The parts that need no Spark, against brute force."""

import io
import itertools
import math
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import decontaminate, embed_dedup, langid, lm_score, mixing, pii, probminhash, tokens, toxicity, warc

ALPHABET = "a1.@+-_ ()%é\U0001f600\n4"


@given(st.text(alphabet=ALPHABET, max_size=80))
@settings(max_examples=400, deadline=None)
def test_pii_base_spans_equal_plain_patterns(text):
    spans = [(k, s, e) for s, k, e, _ in pii.find(text) if k in pii.BASE]
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    import hashlib

    assert hashlib.sha256(joined.encode()).hexdigest() == pii.base_digest_plain(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 50_000, "+1" * 50_000, "+" + " " * 100_000, "1 " * 100_000])
def test_pii_is_linear_on_long_runs(text):
    pii.find(text)


def test_pii_kinds_and_redaction():
    text = "Mail a.b@c.org, host 10.0.0.1 (not 10.0.0.999), card 4111 1111 1111 1111, call +1 (456) 555-2186, IBAN GB82 WEST 1234 5698 7654 32, password=7602ad27cf5550de1c x"
    kinds = [k for _, k, _, _ in pii.find(text)]
    assert kinds == ["email", "ip", "card", "phone", "iban", "secret"]
    out = pii.redacted(text)
    assert "a.b@c.org" not in out and "4111" not in out and "10.0.0.999" in out and "<IBAN>" in out
    assert pii.redacted(None) is None and pii.redacted("") == "" and pii.find(None) == []
    assert not any(k == "card" for _, k, _, _ in pii.find("4111 1111 1111 1112"))
    assert pii.find("7602ad27cf5550de1c alone") == []


def test_probability_jaccard_is_jaccard_for_sets_and_matches_definition():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a = rng.integers(0, 12, rng.integers(1, 20)).astype(np.uint64)
        b = rng.integers(0, 12, rng.integers(1, 20)).astype(np.uint64)
        x = {k: int((a == k).sum()) for k in set(a.tolist()) | set(b.tolist())}
        y = {k: int((b == k).sum()) for k in x}
        want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x) for i in x if x[i] and y[i])
        assert math.isclose(probminhash.probability_jaccard(a, b), want, abs_tol=1e-12)
        s, t = np.unique(a), np.unique(b)
        assert math.isclose(probminhash.probability_jaccard(s, t), len(set(s) & set(t)) / len(set(s) | set(t)), abs_tol=1e-12)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a = np.repeat(rng.integers(0, 2**62, 40).astype(np.uint64), rng.integers(1, 4, 40))
    b = np.concatenate([a[:60], rng.integers(0, 2**62, 12).astype(np.uint64)])
    sets = [np.unique(x, return_counts=True) for x in (a, b)]
    doc = np.repeat([0, 1], [len(k) for k, _ in sets])
    won = probminhash.registers(np.concatenate([k for k, _ in sets]), np.concatenate([n for _, n in sets]).astype(float), doc, 2, 4096)
    assert abs((won[0] == won[1]).mean() - probminhash.probability_jaccard(a, b)) < 0.04


def test_merges_join_what_brute_force_joins():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 60).astype(np.uint64)
    sets = []
    for _ in range(40):
        x = base.copy()
        x[rng.integers(0, 60, rng.integers(0, 16))] = rng.integers(0, 2**62)
        sets.append(np.concatenate([x, x[: rng.integers(0, 3)]]))
    ids = np.arange(40)

    def groups(links):
        root = list(range(40))
        for a, b in links:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        out = []
        for a in range(40):
            while root[a] != a:
                a = root[a]
            out.append(a)
        return out

    want = groups([(a, b) for a, b in itertools.combinations(range(40), 2) if probminhash.probability_jaccard(sets[a], sets[b]) >= 0.8])
    assert groups(probminhash.merges(ids, ids, sets, np.zeros(40, bool), 0.8)) == want
    left = ids < 20
    halves = probminhash.merges(ids[left], ids[left], sets[:20], np.zeros(20, bool), 0.8) + probminhash.merges(ids[~left], ids[~left], sets[20:], np.zeros(20, bool), 0.8)
    assert groups(halves + probminhash.merges(ids, ids, sets, left, 0.8)) == want


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.text(alphabet="abc", max_size=12))
@settings(max_examples=300, deadline=None)
def test_automaton_equals_levenshtein(word):
    terms = ["abcab", "aabbccaab", "cab", "bbbbb", "abcabcabca"]
    a = test_automaton_equals_levenshtein.__dict__.setdefault("a", toxicity.Automaton(terms))
    near = [(levenshtein(word, t), t) for t in terms if levenshtein(word, t) <= toxicity.edits_for(t)]
    got = a.match(word)
    assert (got is None) == (not near)
    if near:
        assert got[1] == min(near)[0]


def test_leet_records_and_quotation():
    m = toxicity.Matcher(toxicity.Model({"idiot": (50, 0), "moron": (50, 0), "vequille": (50, 1)}, base=0.1))
    assert [(t, e) for _, _, t, e, _ in m.matches("You ID10T, you mor0nn and vequile")] == [("idiot", 0), ("moron", 1), ("vequille", 1)]
    assert m.matches('she said "idiot" twice')[0][4] and not m.matches("what an idiot you are")[0][4]
    assert m.matches(None) == [] and m.matches("") == []
    # a word of clean documents is passed over, though it stands near a term; others near it are not
    m = toxicity.Matcher(toxicity.Model({"moron": (50, 0)}, slips={"morons": (9, 0), "morose": (0, 9), "moros": (1, 30)}, near={("moron", 1): (10, 30)}, all_near={1: (10, 30)}, base=0.1))
    w = m.model.weight
    assert [t for _, _, t, _, _ in m.matches("morons morose moros")] == ["moron"]
    assert w("moron") > w("moron", 1, "morons") > w("moron", 1, "moromn") > w("moron", 1, "moros") == 0
    # a document's own counts say nothing about it
    assert w("moron", 1, "morons", (1, 0)) < w("moron", 1, "morons")
    assert toxicity.Matcher(toxicity.Model({"moron": (50, 0)}, base=0.1, misspellings=False)).matches("morons") == []


def test_qgram_filter_finds_edited_passages_and_no_others():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(14, 70)).capitalize()) for i in range(40)]
    p = decontaminate.Patterns(items)
    for i, item in items:
        s = list(item)
        for _ in range(len(s) // 14):
            k = rng.randrange(len(s))
            if rng.random() < 0.5:
                s[k] = "z"
            else:
                del s[k]
        found = p.find(decontaminate.reduce(text(300) + ", " + "".join(s).upper() + "! " + text(200)))
        assert i in [f[0] for f in found]
    assert all(p.find(decontaminate.reduce(text(1500))) == [] for _ in range(20))
    assert p.find(decontaminate.reduce("")) == []
    assert decontaminate.Patterns([]).find(decontaminate.reduce("some text that is long enough")) == []


def test_align_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(8, 14)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(10, 30)))
        want = min(levenshtein(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        got = decontaminate.align(decontaminate.reduce(a), decontaminate.reduce(b), -20, 60, 6)
        assert (got[2] if got else 99) == (want if want <= 6 else 99)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(5)
    scores = rng.normal(size=(9, 3)) * 3
    lens = np.array([6, 4, 1])
    tokens = rng.integers(0, 9, lens.sum())
    path = langid.viterbi(scores, tokens, lens, 2.0)
    at = 0
    for n in lens:
        t = tokens[at : at + n]
        value = lambda p: sum(scores[w, k] for w, k in zip(t, p, strict=True)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))
        assert math.isclose(value(path[at : at + n]), max(value(p) for p in itertools.product(range(3), repeat=int(n))))
        at += n


def test_scripts_and_surt():
    assert [langid.script(w) for w in ("word", "мир", "λόγος", "한국", "漢字")] == ["latin", "cyrillic", "greek", "hangul", "han"]
    assert warc.surt("https://www.Example.com:8080/a?b=1#top") == "com,example)/a?b=1"
    assert warc.surt("https://m.ex.org") == "org,ex,m)/" and warc.surt(None) == "" and warc.surt("no url") == "no url"


def test_members_round_trip():
    records = [warc.record(i, "http://a.b/\n", f"é{i}".encode() * (i * 50), None if i % 2 else 0) for i in range(6)]
    data = warc.EMPTY_MEMBER.join([*records, b""])
    for step in (1, 7, 100, 1 << 18):
        found = list(warc.members(io.BytesIO(data), step))
        assert [data[o : o + n] for o, n, _ in found] == records
        assert [warc.page_of(warc.parse(c)["warc-record-id"]) for _, _, c in found] == list(range(6))
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data + records[0][:-3])))


def test_multi_index_walk_covers_its_reach():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = embed_dedup.Grid(x, 6, 0.98, 0.995)
    home, rows, cells = g.walk(x)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    y = 0.985 * x + np.sqrt(1 - 0.985**2) * noise / np.linalg.norm(noise, axis=1)[:, None]
    there, r2, c2 = g.walk(y)
    seen = set(zip(rows.tolist(), cells.tolist(), strict=True)) | set(enumerate(home.tolist()))
    back = set(zip(r2.tolist(), c2.tolist(), strict=True))
    hit = [(i, int(there[i])) in seen or (i, int(home[i])) in back for i in range(len(x))]
    assert np.mean(hit) > 0.98


def test_block_links_connects_what_is_linked():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(60)
    who, n, e = embed_dedup.block_links(ids, x, ids, x, True, 0.95)
    hit = np.triu(x @ x.T >= 0.95, 1)
    deg = np.zeros(60, int)
    np.add.at(deg, who, n)
    assert (deg == hit.sum(0) + hit.sum(1)).all()

    def parts(pairs):
        root = list(range(60))
        for a, b in pairs:
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
        return root

    assert parts(e.tolist()) == parts(np.argwhere(hit).tolist())


def test_raking_meets_marginals():
    import pandas as pd

    rng = np.random.default_rng(8)
    cells = pd.DataFrame([(s, la, t, int(rng.integers(1, 1000))) for s in "abc" for la in "xy" for t in "uv"], columns=["source", "lang", "topic", "tokens"])
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"u": 0.1, "v": 0.9, "w": 0.5}}
    w = mixing.rake_local(cells, targets)
    assert np.allclose(pd.Series(w).groupby(cells["source"]).sum(), [0.5, 0.3, 0.2], atol=1e-6)
    assert np.allclose(pd.Series(w).groupby(cells["topic"]).sum(), [0.1, 0.9], atol=1e-6)
    p = mixing.scale_local(cells["tokens"].to_numpy(float), w, 0.4 * cells["tokens"].sum())
    assert math.isclose((p * cells["tokens"]).sum(), 0.4 * cells["tokens"].sum(), rel_tol=1e-9) and p.max() <= 1


def test_word_ids():
    ids = lm_score.Ids(["the", "of"])
    assert ids("The word OF").tolist() == [0, 2, 1, 3] and ids("").tolist() == [0]


def test_leaks_in_part_rewrapped_or_decomposed():
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdeéfghiü") for _ in range(rng.randint(3, 8))) for _ in range(n))
    long, middle, short = text(60), text(40)[:190], text(14)[:80]
    p = decontaminate.Patterns([(1, long), (2, middle), (3, short)])
    before, after = text(30) + " \u0301 ", " ... " + text(30)
    found = lambda t: {f[0]: (t[f[1] : f[2]], f[3]) for f in decontaminate.located(p, t)}
    assert 2 in found(before + middle[:150] + after)
    for at in range(0, len(long) - 95, 7):
        assert 1 in found(before + long[at : at + 95] + after)
    for item, whole in ((1, long), (2, middle), (3, short)):
        for other in (whole.replace(" ", "  \n    "), unicodedata.normalize("NFD", whole)):
            passage, edits = found(before + other + after)[item]
            assert passage.strip() in other and edits == 0
    assert found(before + after) == {}


@given(st.lists(st.text(alphabet="aB1 _-\n\u0301éΣßİ漢\U0001f600\U00010400", max_size=40), max_size=6), st.integers(3, 50))
@settings(max_examples=300, deadline=None)
def test_word_keys_are_those_of_the_pattern(texts, span):
    before, tokens.SPAN = tokens.SPAN, span
    try:
        keys, counts = tokens.word_keys(texts)
    finally:
        tokens.SPAN = before
    found = [lm_score.words(t) for t in texts]
    flat = [w for f in found for w in f]
    assert counts.tolist() == [len(f) for f in found] and len(keys) == len(flat) and 0 not in keys
    assert len(set(zip(flat, keys.tolist(), strict=True))) == len(set(flat)) == len(set(keys.tolist()))


def test_packed_arrays_come_back():
    rng = np.random.default_rng(9)
    arrays = [rng.integers(0, 100, rng.integers(0, 50)) for _ in lm_score.PAIRS]
    arrays[12], arrays[7] = np.array([70_000, 3]), np.array([1 << 40])
    arrays[6].sort()
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, lm_score.unpack(lm_score.PAIRS, lm_score.pack(lm_score.PAIRS, arrays)), strict=True))


def test_rows_of_pairs_are_split_without_loss():
    """Every pair comes back in one finer bucket, with its word, document and counts."""
    rng = np.random.default_rng(10)
    docs, lights = np.unique(rng.integers(0, 90, 40)), np.unique(rng.integers(1, 1 << 60, 30))
    signed = rng.integers(-50, 50, len(docs))
    which = np.sort(rng.integers(0, len(lights), 200))
    light = [rng.integers(0, 1 << 32, 200), rng.integers(0, 1 << 16, 200), which, rng.integers(0, len(docs), 200), rng.integers(1, 5, 200)]
    far = [rng.integers(0, 1 << 32, 300), rng.integers(0, 1 << 16, 300), rng.integers(0, 60_000, 300), rng.integers(0, len(docs), 300), rng.integers(1, 9, 300), rng.integers(1, 400, 300)]
    closing = np.unique(light[3][:20] * len(lights) + which[:20])
    data = lm_score.pack(lm_score.PAIRS, [docs, signed, closing, lights, *light, *far])

    def told(d):
        docs, signed, closing, lights, a, b, which, place, n, *far = lm_score.unpack(lm_score.PAIRS, d)
        one = list(zip(a, b, lights[which], docs[place], signed[place], n, strict=True))
        two = list(zip(far[0], far[1], far[2], docs[far[3]], signed[far[3]], far[4], far[5], strict=True))
        return one, two, [(docs[c // len(lights)], lights[c % len(lights)]) for c in closing.tolist()]

    parts = lm_score.split(data, 7)
    assert len(parts) == 7
    whole = [sorted(x for _, d in parts for x in told(d)[k]) for k in range(3)]
    assert whole == [sorted(x) for x in told(data)]
    word = {x[2] for _, d in parts for x in told(d)[0]}
    assert sum(len({x[2] for x in told(d)[0]}) for _, d in parts) == len(word)  # a word has one place
    reply = lambda p, t: lm_score.pack(lm_score.REPLY, [np.array(p), np.array(t, float), np.array(t, float) * 2])
    place, t, b = lm_score.unpack(lm_score.REPLY, lm_score.summed([reply([1, 4], [1, 2]), reply([0, 4], [5, 7])]))
    assert place.tolist() == [0, 1, 4] and t.tolist() == [5, 1, 9] and b.tolist() == [10, 2, 18]
