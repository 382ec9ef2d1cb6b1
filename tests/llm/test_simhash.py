import random

import numpy as np
import pytest
import xxhash

from kinweave.llm import simhash


def brute(texts):
    out = []
    for t in texts:
        words = [w for w in (t or "").encode().lower().split()]
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    return out


def components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("kinds", [simhash.SHORT_KEYS, simhash.LONG_KEYS])
def test_every_near_pair_shares_a_key(kinds):
    rng = random.Random(5)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << bit
        keys, owner = simhash.keys_of(np.array([a, b], np.uint64), kinds)
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


@pytest.mark.parametrize("kinds", [simhash.SHORT_KEYS, simhash.LONG_KEYS])
def test_links_span_chains(spark, kinds):
    rng = random.Random(1)
    fps = []
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 40])):
            fps.append(x)
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), kinds).collect()
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        root[find(a)] = find(b)
    got = {}
    for x in signed:
        got.setdefault(find(x), set()).add(x)
    want = {}
    for x, c in zip(signed, components(list(range(len(fps))), fps), strict=True):
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(300)]
    texts = [None, "", "  \n", "one", "One two", "ONE two three"]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 30, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append("\t".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    rows = [(i * 3 + 1, t, "en") for i, t in enumerate(texts)] + [(1, texts[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = brute([t for _, t, _ in rows])
    assert got == sorted(zip([r[0] for r in rows], fps, components([r[0] for r in rows], fps), strict=True))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got})


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(docs).collect()) == ["4", "None", "None"]
    assert simhash.keep_one(docs).count() == 3
