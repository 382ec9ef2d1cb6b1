import random
import re

import duckdb
import pytest

from kinweave.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {k for at in where.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 60, "é\x0bß\x0cü\r\n😀 #1 <b>|&%$*", "l\nl\n\nl\n \n"]
    texts += [rng.choice([" ", "\n", "\t "]).join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")
    got = {r.row.doc_id: tuple(r)[1:4] + tuple(r)[5:7] for r in quality.measure(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


def test_clean_stays_and_junk_goes(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(900):
        source = "big" if i % 3 else rng.choice(["s%d" % k for k in range(40)])
        rows.append((i, " ".join(word() for _ in range(rng.randint(12, 200))), None if i % 50 == 0 else "en", source))
    for i in range(900, 960):
        rows.append((i, " ".join(word() + "***" for _ in range(80)), "en", "big"))
    rows += [(1000, "few words", "en", "big"), (1001, None, None, None), (5, rows[5][1], "en", rows[5][3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = [r.doc_id for r in quality.keep_good(docs).collect()]
    assert sorted(kept) == sorted([*range(900), 5])
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_sketch_is_close_to_exact_and_merges(spark):
    rows = [(i, "w" * (1 + i % 97) + " b", "en", f"s{i % 5}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured, rules = quality.measure(docs), quality.QualityRules(min_words=1, min_group=1000)
    one = quality.sketch(measured, rules).groupBy("measure", "value").sum("n")
    assert one.where("measure = 'word_length'").agg({"sum(n)": "sum"}).first()[0] == 2000
    exact = sorted(quality.PER * (2 + i % 97) // 2 for i in range(2000))
    row = quality.fences(quality.sketch(measured, rules), rules).first()
    low, mid, high = exact[199], exact[999], exact[1799]
    assert abs(row.high_word_length - (high + 3 * (high - mid))) < high / 4
    assert abs(row.low_word_length - (low - 3 * (mid - low))) < high / 4


def test_thresholds_adapt_to_the_source(spark):
    """A source whose texts always hold symbols and repeated lines keeps them; the same text elsewhere goes."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    prose = lambda: " ".join(word() for _ in range(150))
    code = lambda: "\n".join([" ".join(word() + rng.choice(["#", "|", ""]) for _ in range(10)) for _ in range(15)] + ["}"] * rng.randint(10, 20))
    rows = [(i, prose(), "en", "books") for i in range(300)] + [(i, code(), "en", "code") for i in range(300, 600)]
    rows += [(600, code(), "en", "books"), (601, prose(), "en", "books")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {*range(600), 601}
    rules = quality.QualityRules()
    own = {r.source: r for r in quality.fences(quality.sketch(quality.measure(docs), rules), rules).collect()}
    for name in ("high_symbols", "high_dup_lines"):
        assert own["code"][name] > own["books"][name]


def corpus(seed, long_text=False):
    """Prose of several languages and sources, texts with symbols and repeated lines, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(700):
        lines = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 12))]
        if i % 9 == 0:
            lines += rng.choices(lines, k=rng.randint(1, 6))
        if i % 13 == 0:
            lines = [x.replace(" ", rng.choice(["# ", " | ", "$"])) for x in lines]
        rows.append((i, "\n".join(lines), rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", None])))
    rows += [(1000, None, "en", "a"), (1001, "", "de", None), (1002, "short", None, None), (1003, rows[9][1], "xx", "lonely")]
    return rows


@pytest.mark.parametrize("min_group", [20, 60, 200])
def test_like_sql_with_sketches_of_every_level(spark, min_group):
    docs = spark.createDataFrame(corpus(6), "doc_id long, text string, lang string, source string")
    rules = quality.QualityRules(min_group=min_group)
    groups = [r["count"] for r in docs.groupBy("lang", "source").count().collect()]
    assert max(groups) > 60 and (min_group < 200 or max(groups) < 200) and min(groups) < 20
    judged = quality.judge(docs, rules).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    with duckdb.connect() as db:
        db.register("documents", docs.toArrow())
        want = db.sql(quality.oracle(min_group)).fetchall()
    assert sorted(map(tuple, judged.collect())) == sorted(want)
    kept = {x[-1] for x in want if not x[-2]}
    assert kept == {True, False}


def test_no_fence_is_zero_and_length_counts(spark):
    """In a source without any symbol or repeated line a long clean text with a few of them stays; texts full of them go."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    line = lambda n=12: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(5, 60))), "en", "books") for i in range(400)]
    long = [line(20) for _ in range(1000)]
    for k in range(14):
        long[50 * k] = long[50 * k].replace(" ", " & ", 1)
    for k in range(12):
        long[60 * k + 7] = "a heading"
    rows += [(500, "\n".join(long), "en", "books")]
    rows += [(501, "\n".join(x.replace(" ", " # ") for x in long), "en", "books"), (502, line(40).replace(" ", " | "), "en", "books")]
    rows += [(503, "\n".join(x for k in range(400) for x in (line(2), "menu", "home")), "en", "books")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    rules = quality.QualityRules()
    own = quality.fences(quality.sketch(quality.measure(docs), rules), rules).first()
    assert min(own.high_symbols, own.high_dup_lines, own.high_repeats) > 0
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {*range(400), 500}
