import hashlib
import random
import re

import numpy as np
import pytest

from palimpsest.llm import secrets_crf as sc

TEXTS = [
    "", "plain words only", "password = hunter2abc", "PassWord:'abc123' x", "token: token: abcdefgh", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" end", "AKIA" + "A1" * 10 + " AKIAAKIA", "AKIAshort",
    "é" * 5 + "apikey=abcdef api_key : 'x.y/z+=-_' api__key=abcdef", "f" * 23 + " " + "e" * 24 + "G" + "0" * 30, "ſecret = abcdef toKen = abcdef", "secret=abcde secretabc=defghi", "token\t= abcdef",
]


def brute_base(text):
    out = []
    kinds = [r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"]
    for k, p in enumerate(kinds):
        for m in re.finditer(p, text, re.ASCII | re.IGNORECASE if k == 0 else 0):
            if (len(m[2]) >= 6) if k == 0 else (len(m[0]) >= (20 if k == 1 else 24)):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns():
    rng = random.Random(1)
    made = ["".join(rng.choice(["token", "=", ":", " ", "\"", "abc123", "AKIA", "0123456789ab", "Z", "é", "\n", "secret", "-"]) for _ in range(30)) for _ in range(500)]
    for t in TEXTS + made:
        assert sc.base_spans(t) == brute_base(t), t


def prose(rng, n):
    return " ".join(rng.choice("the river of stone and light near an old house with water. Or, by".split()) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def field():
    rng = random.Random(2)
    found = []
    for i in range(160):
        text = prose(rng, 60)
        if i % 4 == 0:
            secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            text = f"{text} token = \"{secret}\" {prose(rng, 30)}"
        elif i % 4 == 1:
            text += f" me.{i}@mail{i}.example.com 10.0.{i}.7 {rng.randrange(10**15)} " + prose(rng, 9)
        found += [tuple(w[c] for c in ("kind", "shapes", "tags", "file")) for w in sc.windows_of(text)]
    return sc.fit_field(found)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    from itertools import product

    for n in (1, 2, 5):
        scores, moves = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        value = lambda p: sum(scores[i, t] for i, t in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))
        assert value(sc.viterbi(scores, moves)) == pytest.approx(max(map(value, product(range(3), repeat=n))))


def test_stretches_give_the_whole_texts_path(field):
    rng, tagger = random.Random(4), sc.Tagger(field)
    for _ in range(100):
        words = (prose(rng, 50).split() + [sc._other_secret(rng), "token", "=", "x9Y8z7W6v5U4t3S2r1Q0", "password:", "1.2.3.4"] * 2)[: rng.randint(1, 62)]
        rng.shuffle(words)
        text = " ".join(words)
        raw = [w.encode() for w in words]
        assert tagger.tags(raw, text) == {k: t for k, t in enumerate(sc.viterbi(tagger.scores(raw, text), field.moves)) if t}


def test_field_adds_shapes_and_leaves_prose_alone(field):
    tagger, rng = sc.Tagger(field), random.Random(5)
    found = sum(any(k == 3 for _, k, _ in sc.find(f"{prose(rng, 12)} {sc._other_secret(rng)} {prose(rng, 12)}", tagger)) or bool(sc.base_spans(t := "")) for _ in range(60))
    assert found >= 35  # those of six shapes that no pattern knows
    assert sum(bool(sc.find(prose(rng, 200), tagger)) for _ in range(50)) <= 1


def test_windows_cover_all_marked_words_of_any_text():
    text = prose(random.Random(9), 30_000) + " " + " ".join(f"token = {'ab12' * 10} plain" for _ in range(50))
    rows = sc.windows_of(text)
    words, tags = sc._tags_of(text, sc.base_spans(text))
    assert sum(r["kind"] == sc.NEAR for r in rows) == tags.count(sc.B) == 50
    assert all(len(r["shapes"]) == len(r["tags"]) == sc.LENGTH and (r["kind"] != sc.NEAR or sc.B in r["tags"]) for r in rows)
    assert sc.windows_of("") == [] and sc.windows_of(" \n") == [] and len(sc.windows_of("one")) == 1


def test_overlaps_equal_all_pairs():
    rng = random.Random(10)
    for _ in range(300):
        spans = sorted((a, rng.randrange(3), a + rng.randint(1, 6)) for a in (rng.randrange(60) for _ in range(rng.randrange(8))))
        own = sorted({(a, a + 2) for a in range(rng.randrange(3), 60, 3) if rng.random() < 0.7})
        want = [(a, b) for a, b in own if not any(a < y and x < b for x, _, y in spans)]
        assert sc.apart(own, sc.joined(spans)) == want


def test_many_spans_take_linear_time(field):
    import time

    tagger, took = sc.Tagger(field), {}
    for n in (4000, 32_000):
        text = " ".join("0123456789abcdef" * 2 + f" Xy9{i}kLm0pQ7" for i in range(n))
        began = time.perf_counter()
        assert sum(k == 2 for _, k, _ in sc.find(text, tagger)) == n
        took[n] = time.perf_counter() - began
    assert took[32_000] < 8 * 4 * took[4000] + 0.5


def test_gradients_fit_the_tags():
    """The fitted field's tags are those of the windows it was fitted to."""
    rng = random.Random(12)
    rows = []
    for i in range(60):
        text = prose(rng, 20) + f" password: {sc._other_secret(rng)} " + prose(rng, 20) + f" order {rng.randrange(10**6)} " + prose(rng, 10)
        rows += [tuple(w[c] for c in ("kind", "shapes", "tags", "file")) for w in sc.windows_of(text)]
    field, hits = sc.fit_field(rows), 0
    for _, x, y, f in rows:
        table = np.array([[b >> k & 1 for k in range(sc.SHAPE)] for b in x], float)
        e = table @ field.own + np.array(f) @ field.file
        e[1:] += (table @ field.before)[:-1]
        e[:-1] += (table @ field.after)[1:]
        hits += sc.viterbi(e, field.moves) == y
    assert hits >= 0.95 * len(rows)
    assert sc.fit_field([r for r in rows if r[0] != sc.NEAR]).own[0, sc.O] == 100


def test_spans_and_redaction(spark, field):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (91, TEXTS[5]), (None, TEXTS[5]), (92, prose(random.Random(6), 40_000) + " " + TEXTS[5])]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars", "1 AS redacted", "2 AS spans")
    tagger = sc.Tagger(field)
    for r in sc.scan(d, model=field).collect():
        t = dict(rows)[r["doc_id"]] or ""
        base = brute_base(t)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{sc.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert r["spans"] == sc.spell(sc.find(t, tagger)) and set(sc.spell(base).split(",")) <= set(r["spans"].split(",")) | {""}
    out = sc.redact(d, model=field, length_col="n_chars").collect()
    assert list(out[0].asDict()) == d.columns
    for r in out:
        if r["text"]:
            assert r["n_chars"] == len(r["text"]) and not brute_base(r["text"])
    assert {r["text"] for r in out if r["doc_id"] == 90} == {None} and [r["text"] for r in out if r["doc_id"] == 1] == [TEXTS[1]]
    assert sc.redact_text("abcdef", [(1, 0, 3), (2, 1, 4)]) == "a[SECRET]ef"


def test_fit_on_tables(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 40) + (" token = " + "".join(rng.choice("0123456789abcdef") for _ in range(40)) if i % 3 == 0 else "")) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    a = sc.fit(d, max_docs=10, steps=20)
    b = sc.fit(d.repartition(5), max_docs=10, steps=20)
    assert np.array_equal(a.own, b.own)
    none = d.limit(0)
    assert sc.scan(none).count() == 0
    plain = spark.createDataFrame([(1, "plain words"), (2, None)], "doc_id long, text string")
    assert {r["spans"] for r in sc.scan(plain).collect()} == {""}
