import random
import re

import numpy as np
import pytest

from palimpsest.llm import quality

SPACE = " \t\n\v\f\r"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= {i, i + 1, i + 2}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(hit)}


@pytest.mark.parametrize("seed", range(30))
def test_base_statistics(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "b", "é", "#", "|", " ", " ", "\n", "\n", "\t", "\x1c", "\x85", "\U0001d518 ", "x y z\n"]) for _ in range(rng.randrange(150)))
    words = text.encode().split()
    ids, seen = quality.word_ids(words)
    assert quality.base_statistics(text, words, ids, len(seen)) == brute(text)


def test_wide_vocabularies_use_two_codes(monkeypatch):
    rng = random.Random(1)
    ids, seen = quality.word_ids([b"%d" % rng.randrange(40) for _ in range(500)])
    plain = quality.repeated_words(ids, len(seen))
    monkeypatch.setattr(quality, "ONE_CODE", 10)
    assert quality.repeated_words(ids, len(seen)) == plain


def corpus(rng, n=120):
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [rng.choice("the of and river stone house water light".split()) for _ in range(120)]
        if not good:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(good)))
    return docs, labels


def brute_ratio(docs, labels, bits):
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    good = {i for i, q in labels if q == 1}
    for i, t in docs:
        for b in quality.ngram_buckets(*quality.word_ids((t or "").encode().split()), bits):
            raw[b] += 1
            target[b] += i in good
    prior = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target + len(raw) * prior) / (target.sum() + len(raw))) - np.log(prior)


def test_model_and_verdicts_equal_brute_force(spark):
    docs, labels = corpus(random.Random(4))
    docs += [(900, None), (901, ""), (902, "few words only"), (None, docs[0][1]), (903, "same three words " * 60)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS id", "'y' AS label_id")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (1, 0)], "doc_id long, quality int")
    ratio = quality.fit(d, lab, bits=10)
    assert np.allclose(ratio, brute_ratio(docs, labels, 10))
    # more ids than are sent to every task: the same counts by another way
    assert np.array_equal(ratio, quality.fit(d, lab, bits=10, broadcast_ids=0))
    out = {r["doc_id"]: r for r in quality.quality_rules(d, lab, bits=10).collect()}
    for i, t in docs:
        r, want = out[i], brute(t or "")
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        buckets = quality.ngram_buckets(*quality.word_ids((t or "").encode().split()), 10)
        score = ratio[buckets].mean() if len(buckets) else 0.0
        assert r["base_failed"] == failed and r["score"] == pytest.approx(score) and r["kept"] == (not failed and score >= -0.1)
    clean = [i for i, _ in docs[:120] if i % 3 > 0 and not out[i]["base_failed"]]
    assert all(out[i]["kept"] for i in clean) and not any(out[i]["kept"] for i in range(0, 120, 3))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_rules(none, lab, bits=6).count() == 0
    assert quality.quality_rules(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), lab, bits=6).count() == 1
