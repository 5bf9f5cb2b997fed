import random

import public_tokenizers as P
import pytest

from palimpsest.llm import bpe, sentencepiece_codec, token_counts

MODEL, TOKENIZER = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
TEXTS = [
    "", " ", "   ", "a   b", "  lead", "trail  ", "\n\n x", "The quick brown fox, 123,456.78 abc123def", "日本語テキスト 執", "𝔘nicode ñandú – “q”", "x" * 300, "ab" * 200, " " * 77 + "x",
    "\t\ttab", "!!!???...;;;", "ü²½x", "का हिन्दी", "don't stop'em", "token = \"04dbebab91ab\"\n",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdethinorus   .,#é\n1'") for _ in range(rng.randint(1, 60))) for _ in range(n)]


# ------------------------------------------------ SentencePiece


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.codec(MODEL)


def test_ids_equal_the_library(codec):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in [*TEXTS, "▁", "a▁b", "<s> </s> <unk>", *random_texts(500, 1)]:
        assert codec.encode(t) == lib.encode(t), t
        assert codec.decode(codec.encode(t)) == lib.decode(lib.encode(t)), t


def test_round_trip_is_exact(codec):
    for t in [*TEXTS, *random_texts(300, 2)]:
        assert codec.decode(codec.encode(t)) == t


def test_dynamic_program_equals_merging(codec):
    for t in random_texts(200, 3):
        word = "".join(c for c in "▁" + t if c in codec.chars and c != "▁") or "a"
        assert codec._known(word) == codec.merges.encode_by_merging([codec.own[c] for c in word])


def brute_best(text, pieces, score, unknown):
    """Greatest score sum over all segmentations."""
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            s = score[pieces[text[i:j]]] if text[i:j] in pieces else unknown if j == i + 1 else None
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_viterbi_finds_the_best_score():
    rng = random.Random(5)
    pieces = {p: i for i, p in enumerate(sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(25)}))}
    score = [-rng.random() * 9 for _ in pieces]
    auto = bpe.automaton(pieces)
    for _ in range(200):
        text = "".join(rng.choice("abcz") for _ in range(rng.randint(0, 20)))
        got = bpe.best_pieces(auto, text, score, -1, -20.0)
        assert "".join(text[a:b] for _, a, b in got) == text
        assert sum(-20.0 if x < 0 else score[x] for x, _, _ in got) == pytest.approx(brute_best(text, pieces, score, -20.0))


def test_memo_turns_over():
    made = []
    memo = bpe.Memo(lambda k: made.append(k) or k, 2)
    for k in (1, 2, 3, 1, 4, 5, 1):
        assert memo(k) == k
    assert len(memo.young) <= 2 and made.count(1) <= 2


def test_columns(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS x")
    out = {r["doc_id"]: r for r in sentencepiece_codec.encode_documents(d, MODEL).collect()}
    c = sentencepiece_codec.codec(MODEL)
    assert len(out) == len(TEXTS) + 1 and all(r["round_trip"] for r in out.values())
    assert all(out[i]["ids"] == c.encode(t) and out[i]["n_tokens"] == len(out[i]["ids"]) for i, t in enumerate([*TEXTS, None]))
    from pyspark.sql import functions as F

    back = d.select("text", sentencepiece_codec.decode_column(sentencepiece_codec.encode_column(F.col("text"), MODEL), MODEL).alias("t")).collect()
    assert all(r["t"] == (r["text"] or "") for r in back)
    assert sentencepiece_codec.encode_documents(d.limit(0), MODEL).count() == 0


# ------------------------------------------------ token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(TOKENIZER)


def test_counts_equal_the_library(counter, library):
    for t in [*TEXTS, "a<|endoftext|>b <|startoftext|>", "<|EndOfText|>", "ΣΑΣ ΟΔΟΣ", "İstanbul", "é", "\x1c\x85　y", *random_texts(500, 4)]:
        assert counter.count(t) == library(t), t


def test_counts_over_all_of_unicode(counter, library):
    rng = random.Random(8)
    for _ in range(1500):
        t = "".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x250, 0xD7FF), rng.randint(0xE000, 0x323FF), rng.randint(0xA700, 0xA7FF)])) for _ in range(30))
        assert counter.count(t) == library(t), ascii(t)


HARD = [
    "Don't re-encode: it's the 22nd TEXT'RE of ñandú!! 've 'll'", "cafe\u0301 na\u0308\u0323ive \u1100\u1161\u11a8 \u0958x", "İstanbul ΣΑΣ ΟΔΟΣ", "a<|endoftext|>b c<|startoftext|> <|endoftext|><|endoftext|>x<|endof",
    "x\u0301" * 20 + " e\u0301<|endoftext|>\u0301a", "  lead and trail \x1c\x85　 ", "Ǆ ﬁ ½ Å \u212b 日本語 \U0001d518",
]


def test_every_prefix(counter, library):
    """Each prefix of the text as it is given, special strings included."""
    for t in ["", *HARD, *random_texts(25, 6)]:
        p, want = counter.prefixes(t), [library(t[:k]) for k in range(len(t) + 1)]
        assert [p.count(k) for k in range(len(t) + 1)] == want, ascii(t)
        assert p.table().tolist() == want, ascii(t)
        assert p.total == want[-1] == counter.count(t)
        for limit in (-1, 0, 1, 2, 5, 9, want[-1], 10_000):
            assert p.truncate(limit) == max(k for k, n in enumerate(want) if n <= max(limit, 0)), (ascii(t), limit)


def test_tables_of_long_words_are_linear(counter, library):
    import time

    rng, took = random.Random(3), {}
    for n in (20_000, 160_000):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.perf_counter()
        table = counter._table(word)
        took[n] = time.perf_counter() - began
        for k in (1, 2, n // 3, n):
            if k <= 20_000:
                assert table[k] == library(word[:k])
    assert took[160_000] < 8 * 4 * took[20_000] + 0.5
    assert counter.count("é" * 5000 + "😀" * 3000) == library("é" * 5000 + "😀" * 3000)


def test_count_columns(spark, counter):
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None, "w " * 3000])], "doc_id long, text string").selectExpr("*", "1 AS n_tokens")
    out = {r["doc_id"]: r for r in token_counts.token_counts(d, TOKENIZER).collect()}
    for i, t in enumerate([*TEXTS, None, "w " * 3000]):
        assert (out[i]["n_bytes"], out[i]["n_tokens"]) == (len((t or "").encode()), counter.count(t)) and out[i]["over_limit"] == (counter.count(t) > 2048)
    from pyspark.sql import functions as F

    for i, t in enumerate([*TEXTS, None, "w " * 3000]):
        assert out[i]["limit_chars"] == counter.prefixes(t).truncate(2048)
    stored = d.select("doc_id", "text", token_counts.prefix_counts_column(F.col("text"), TOKENIZER).alias("p"))
    for r in stored.select("*", token_counts.chars_within(F.col("p"), 5).alias("k")).collect():
        assert r["p"] == counter.prefixes(r["text"]).table().tolist() and r["k"] == counter.prefixes(r["text"]).truncate(5)
    assert token_counts.token_counts(d.limit(0), TOKENIZER).count() == 0


def test_very_long_words_round_trip(counter, library):
    c = sentencepiece_codec.codec(MODEL)
    rng = random.Random(11)
    for t in ("ab" * 50_000, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "é" * 20_000, " " * 30_000 + "x"):
        assert c.decode(c.encode(t)) == t
