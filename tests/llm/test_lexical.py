import math
import random
import re
from collections import Counter

import pytest

from kinweave.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, length = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m, score = 25 + 75 * c.total() * n_docs // max(length, 1), 0
            for t in terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(n):
    rng = random.Random(5)
    vocabulary = ["the", "The", "é", "naïve", "x1", "x2", "İstanbul", "中文", "𝄞", *[f"w{i}" for i in range(60)]]
    text = lambda most: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "_", "\n", "\x00", "\x7f", "·"]) for _ in range(rng.randint(0, most)))
    docs = [(rng.randint(0, 10**12) if i % 3 else i, text(40)) for i in range(n)]
    docs += [(7, docs[3][1])] * 5 + [(None, "the w1 w2"), (None, "w3"), (1, None), (2, ""), (3, "... !"), (4, "w5 " * 30_000), (5, "the w7"), (6, "the w7")]
    items = [(i, text(12)) for i in range(30)] + [(30, None), (31, ""), (None, "w1 w1 w2"), (32, "the the w5"), (32, "w7"), (33, "nowhere")]
    return docs, items


def frames(spark, docs, items):
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, row int").repartition(3)
    return table, spark.createDataFrame(items, "item_id long, text string")


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("window", [lexical.WINDOW, 37])
def test_like_brute_force(spark, window, monkeypatch):
    docs, items = corpus(300)
    monkeypatch.setattr(lexical, "WINDOW", window)
    assert got(lexical.search(*frames(spark, docs, items))) == brute(docs, items)


def test_queries_in_blocks_and_other_k(spark, monkeypatch):
    docs, items = corpus(120)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 40)
    assert got(lexical.search(*frames(spark, docs, items), k=3)) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = frames(spark, *corpus(5))
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("text IS NULL"), items).count() == 0
