import random
import time
from itertools import chain, combinations, product

import pytest
from pyspark.sql import functions as F

from kinweave.llm import urlrules


def test_host_path_and_rule(spark):
    cases = [
        ("https://m.Example.COM/en/7?x=1", "m.example.com", "/en/7", "example.com/en/7", "allow"),
        ("http://example.com/en/8#t", "example.com", "/en/8", "com/en/", "block"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("http://a.example.net/de/81", "a.example.net", "/de/81", "example.net/de/8", "block"),
        ("http://a.net/de/9", "a.net", "/de/9", "net/de/", "allow"),
        ("http://x.org/es/", "x.org", "/es/", "org/es/", "block"),
        ("http://com?a", "com", "", None, None), ("no scheme/en/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
        ("a://b\nC/en/\n?q://z/", "b\nc", "/en/\n", None, None), ("http://org", "org", "", None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "url string")
    url = F.col("url")
    got = df.select(urlrules.host(url), urlrules.path(url), *urlrules.explicit_rule(url)).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def brute(rows, params):
    sets = [(set(t), b) for t, b in rows]
    total, bad = len(sets), sum(b for _, b in sets)
    items = sorted({x for t, _ in sets for x in t})
    least = max(params.min_support, min(1.0, params.min_count / total)) * total
    rules = {}
    for n in range(1, params.max_tokens + 1):
        for combo in combinations(items, n):
            hit = [b for t, b in sets if set(combo) <= t]
            if sum(hit) >= least and sum(hit) >= params.min_count:
                confidence = sum(hit) / len(hit)
                if confidence >= params.min_confidence and confidence >= params.min_lift * bad / total:
                    rules[combo] = (round(confidence, 9), sum(hit))
    return rules


def expanded(rules, params):
    """Every combination of tokens that a rule stands for: one or more of each item."""
    out = {}
    for r in rules:
        some = [list(chain.from_iterable(combinations(members, n) for n in range(1, len(members) + 1))) for members in r.needs]
        for parts in product(*some):
            combo = tuple(sorted(chain.from_iterable(parts)))
            if len(combo) <= params.max_tokens:
                out[combo] = (round(r.confidence, 9), r.support)
    return out


@pytest.mark.parametrize("longest", [12, 0])
def test_rules_match_enumeration(spark, longest):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        host, lang = rng.choice(["ads", "news", "blog"]), rng.choice(["en", "de"])
        url = f"http://{host}.x/{lang}/{rng.randrange(99)}{rng.choice(['', '?utm=1', '#t'])}"
        rows.append((url, rng.random() < (0.9 if host == "ads" and lang == "en" else 0.15)))
    df = spark.createDataFrame(rows + [("http://ads.x/en/1", None)], "url string, bad boolean")
    params = urlrules.MiningParams(min_support=0.02, min_count=5, longest=longest)
    tokens = df.where("bad IS NOT NULL").select(urlrules.tokens(F.col("url")), "bad").collect()
    got = expanded(urlrules.mine(df, params).collect(), params)
    want = brute([tuple(r) for r in tokens], params)
    assert got == want and ("host=ads", "path=en") in got
    pages = spark.createDataFrame([(1, "http://ads.x/en/5"), (1, "http://ads.x/en/5"), (2, "http://blog.x/de/5"), (3, None)], "page_id long, url string")
    verdicts = sorted((r.page_id, r.verdict) for r in urlrules.judge_urls(pages, df, params=params).collect())
    assert verdicts == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow")]


def test_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/1")], "page_id long, url string")
    labelled = spark.createDataFrame([], "url string, bad boolean")
    assert urlrules.judge_urls(pages, labelled).first().verdict == "block"
    assert urlrules.judge_urls(pages.limit(0), labelled).count() == 0


@pytest.mark.parametrize("share", [1.0, 0.5])
def test_many_common_parameters(spark, share):
    """Forty parameters, always together or each in half of the URLs, don't multiply without bound."""
    rng = random.Random(4)
    keys = ["k%02d" % k for k in range(40 if share == 1 else 20)]
    rows = []
    for i in range(400):
        bad = i % 2 == 0
        own = "&".join(k + "=1" for k in keys if rng.random() < share) if bad else "z=1"
        rows.append((f"http://a.x/en/{i}?{own}", bad))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    params = urlrules.MiningParams(min_support=0.005, min_count=5, max_tokens=4 if share == 1 else 2)
    began = time.time()
    rules = urlrules.mine(df, params).collect()
    assert time.time() - began < 90
    if share == 1:
        assert {r.rule_id for r in rules} == {"query=k00", *(r.rule_id for r in rules if "query=k00" in r.rule_id)} and rules
        pages = spark.createDataFrame([(1, "http://b.y/q?k07=3"), (2, "http://b.y/q?z=3")], "page_id long, url string")
        assert {r.page_id: r.verdict for r in urlrules.judge_urls(pages, df, params=params).collect()} == {1: "block", 2: "allow"}
    else:
        tokens = [tuple(r) for r in df.select(urlrules.tokens(F.col("url")), "bad").collect()]
        assert expanded(rules, params) == brute(tokens, params)
