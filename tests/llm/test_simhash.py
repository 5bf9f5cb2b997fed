import random

import numpy as np
import pytest
import xxhash

from palimpsest.llm import simhash

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, radius=4):
    """Smallest id reachable, from (id, fingerprint) pairs."""
    fps = sorted({f for _, f in items})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, f in items:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f): least.get(find(f)) for d, f in items}


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "a b c", "A b C d", "a b c d e f", "x y z w v", "Ä É ä word " * 9, "same " * 50, "\U0001d518 b c d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_text():
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "Beta", "g", "delta."]) + str(rng.randrange(99)) for _ in range(70_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 4])
@pytest.mark.parametrize("salt", [0, 1, 2])
def test_masks_cover_every_pair(radius, salt):
    masks = np.array(simhash.covering_masks(radius, salt), np.int64).view(np.uint64)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    if radius <= 2:
        from itertools import combinations

        sets = [s for k in range(radius + 1) for s in combinations(range(64), k)]
    else:
        sets = [rng.sample(range(64), rng.randint(0, radius)) for _ in range(20_000)]
    for s in sets:
        diff = np.uint64(sum(1 << i for i in s))
        assert ((masks & diff) == 0).any()


def near(rng, base, bits):
    for b in rng.sample(range(64), bits):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("bucket_rows", [2, 5, 8192])
def test_components_equal_brute_force(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    fps = []
    for _ in range(40):
        f = rng.getrandbits(64)
        fps.append(f)
        for _ in range(rng.choice((0, 0, 1, 3, 12))):
            f = near(rng, f, rng.randint(0, 6))  # chains, some of them broken
            fps.append(f)
    rng.shuffle(fps)
    items = [(i if i % 17 else None, f) for i, f in enumerate(fps)]
    d = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in items], "doc_id long, fp long")
    got = {(r["doc_id"], r["fp"] % (1 << 64)): r["component_id"] for r in simhash.label_components(d, 4, bucket_rows).collect()}
    assert got == brute_components(items)


def test_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(200)]
        rows.append((3 * i, " ".join(text)))
        for k in range(i % 4):
            text = list(text)
            text[rng.randrange(200)] = "changed"
            rows.append((3 * i + 1 + k * 1000, " ".join(text)))
    rows += [(5000, None), (5001, ""), (5002, "Same Text here now"), (5003, "same text HERE now"), (None, "same text here now"), (5002, "Same Text here now")]
    d = spark.createDataFrame(rows, SCHEMA)
    items = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(items)
    out = simhash.components(d).collect()
    assert len(out) == len(rows)
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in out) == sorted((str(i), f, want[i, f]) for i, f in items)
    kept = simhash.deduplicate(d.selectExpr("*", "'x' AS fp", "1 AS h", "2 AS nth"))
    assert kept.columns == ["doc_id", "text", "fp", "h", "nth"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_rows_without_ids_and_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.components(none).count() == 0 and simhash.deduplicate(none).count() == 0
    d = spark.createDataFrame([(None, "a b c d e")] * 3 + [(None, "completely other words in this one here")], SCHEMA)
    assert all(r["component_id"] is None for r in simhash.components(d).collect())
    assert simhash.deduplicate(d).count() == 2


def test_large_group_makes_no_pairs(spark):
    """A star of many near copies: links stay near their number."""
    rng = random.Random(1)
    base = rng.getrandbits(62)
    fps = sorted({near(rng, base, 2) for _ in range(600)})
    d = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.links(d, 4, 8192)
    assert links.count() < 40 * len(fps)
    assert simhash.join_components(links).select("root").distinct().count() == 1


def test_long_chain(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (700, 701)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.join_components(d).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[701] == 700 and 500 not in got


def test_two_families_leave_few_bits_free():
    """The bound on a bucket of the second family."""
    for radius in (1, 2, 4):
        first, second = (np.array(simhash.covering_masks(radius, k), np.int64).view(np.uint64) for k in (0, 1))
        free = np.bitwise_count(~first[:, None] & ~second[None, :]).max()
        assert radius < 4 or free == simhash.FREE_BITS


def test_least_of_a_hot_group(spark):
    rows = [("hot", i, 5000 - i) for i in range(3000)] + [(f"g{i % 50}", i, i) for i in range(3000, 3200)] + [("none", 9999, None)]
    d = spark.createDataFrame(rows, "g string, n long, v long")
    least = {}
    for g, _, v in rows:
        least[g] = v if g not in least or v < least[g] else least[g]
    got = simhash.least_of_group(d, "g", "n", "v", "m").collect()
    assert {(r["g"], r["n"], r["v"], r["m"]) for r in got} == {(*r, least[r[0]]) for r in rows} and len(got) == len(rows)


def test_copies_and_near_copies_by_the_thousand(spark):
    """A third of all rows of one text, a third in one component."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(9999)}" for _ in range(300)]
    rows = [(i, " ".join(base)) for i in range(600)]
    for i in range(600):
        own = list(base)
        own[rng.randrange(300)] = f"x{i}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000 + i, " ".join(f"y{rng.randrange(9999)}" for _ in range(30))) for i in range(600)]
    out = simhash.components(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_components([(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in out])
    assert {(r["doc_id"], r["fp"] & (1 << 64) - 1): r["component_id"] for r in out} == want and len(out) == 1800
