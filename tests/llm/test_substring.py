import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.functions import durable
from kinweave.llm import substring


def brute(texts, span):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + span]) for w in words for i in range(len(w) - span + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - span + 1):
            if seen[tuple(w[i : i + span])] > 1:
                gone |= set(range(i, i + span))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["é", "ß x"]
    fresh = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [fresh(rng.choice([34, 35, 36, 60, 200, 900])) for _ in range(12)]
    texts = [None, "", " \n ", "one", " ".join(["a"] * 300), " ".join(["a"] * 40), " ".join(["x", "y"] * 30), " ".join(fresh(4000))]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) - 30))
            parts += fresh(rng.choice([0, 1, 3, 50])) + p[a : a + rng.choice([20, 34, 35, 50, 1000])]
        texts.append(" ".join(parts))
        if rng.random() < 0.3:
            texts.append("\n".join(parts) + " ")
        if rng.random() < 0.3:
            parts[rng.randrange(len(parts))] = "edit"
            texts.append("  ".join(parts))
    return texts


@pytest.mark.parametrize("seed,span", [(1, 35), (2, 35), (3, 9), (4, 5)])
def test_matches_brute_force(spark, seed, span):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.row.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.factored(docs, span).collect()}
    want = brute(texts, span)
    assert [got[i] for i in range(len(texts))] == want


def test_columns_repeats_and_empty(spark):
    text = " ".join("w%d" % i for i in range(50))
    rows = [(1, text, 7, "x", "y", 5), (1, text, 7, "x", "y", 5), (None, None, None, None, None, None), (3, "a  b", 4, "k", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, row string, spans string, doc_key int")
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, "", 0, "x", "y", 5)] * 2 + [rows[2], rows[3]], key=str)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomial_hashes_confuse(spark):
    """Two words of 1024 letters, complements of each other, and two runs of words alike keep apart."""
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rest = ["w%d" % i for i in range(34)]
    run = lambda a, b, tag: " ".join({"a": a, "b": b}[c] for c in thue_morse(2048)) + tag
    texts = [" ".join([*rest[:17], one, *rest[17:]]), " ".join([*rest[:17], two, *rest[17:]]), one, two, "x" * 5000, "x" * 5001]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sum(r.n_removed for r in substring.factored(docs).collect()) == 0
    texts = [run("left", "right", ""), run("right", "left", " end")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.factored(docs).collect()}
    assert [got[i] for i in range(2)] == brute(texts, 35)


def test_factors_say_where_their_words_are(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(5))), "doc_id long, text string").repartition(5)
    rows = substring.factored(docs).withColumn("key", F.xxhash64("row.doc_id", "row.text")).collect()
    words = {r.key: (r.row.text or "").encode().split() for r in rows}
    n = 0
    for r in rows:
        own, covered = words[r.key], set()
        for f in r.factors:
            assert f.length >= 35 and own[f.start : f.start + f.length] == words[f.ref_key][f.ref_start : f.ref_start + f.length]
            assert (f.ref_key, f.ref_start) != (r.key, f.start)
            covered |= set(range(f.start, f.start + f.length))
            n += 1
        assert len(covered) == r.n_removed
        assert sum(s.length for s in r.spans) == r.n_removed
    assert n > 50


def test_parse_extends_along_one_text():
    found = [(3, 4, 7, 103), (7, 1, 7, 107), (8, 1, 9, 0), (9, 2, 9, 1), (5, 1, 1, 1), (40, 1, 7, 140)]
    assert substring.parse(found, 35) == [(3, 39, 7, 103), (8, 37, 9, 0), (40, 35, 7, 140)]


def test_matches_of_another_row_are_dropped():
    texts = pa.array([" ".join("w%d" % i for i in range(50)), "few words"])
    parsed = substring._Parsed(texts, 35)
    check = int(parsed.checks(np.array([4]))[0])
    match = lambda start, check, n=1: {"start": start, "n_windows": n, "check": check, "ref_key": 1, "ref_start": 0}
    assert substring._true_matches(parsed, [[match(4, check), match(5, check), match(4, check, 100)], [match(0, check)]]) == [[(4, 1, 1, 0)], []]


def test_repeated_rows_cost_their_length_only(spark):
    """Hundreds of equal rows, longer and shorter than a window, among texts that share passages with them."""
    rng = random.Random(9)
    fresh = lambda n: [rng.choice(["w%d" % i for i in range(900)]) for _ in range(n)]
    long, short, own = fresh(3000), fresh(20), fresh(200)
    rows = [(1, " ".join(long))] * 320 + [(2, " ".join(short))] * 50 + [(None, " ".join(long[:100]))] * 3
    rows += [(3, " ".join(fresh(80) + long[500:700] + fresh(50))), (4, " ".join(own)), (5, " ".join(fresh(60) + short)), (6, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    began = time.time()
    got = sorted((str(r.row.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring.factored(docs).collect())
    assert time.time() - began < 60
    assert got == sorted((str(d), *x) for (d, _), x in zip(rows, brute([t for _, t in rows], 35), strict=True))
    factors = {tuple(map(tuple, r.factors)) for r in substring.factored(docs).where("row.doc_id = 1").collect()}
    assert len(factors) == 1 and next(iter(factors))[0][:2] == (0, 3000)


def test_blocks_and_windows_are_gone_before_the_texts_are_shuffled_again(spark):
    text = " ".join("w%d" % i for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, "before " + text)], "doc_id long, text string")
    since = durable.mark()
    out = substring.factored(docs)
    assert durable.mark() - since <= 2  # repeated rows and matches; blocks, their counts, the index and windows stayed before
    assert {r.n_removed for r in out.collect()} == {80}
