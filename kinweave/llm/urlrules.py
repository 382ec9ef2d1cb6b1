"""URL filters mined as association rules, in DataFrame operations only.

URLs become token sets. Frequent-pattern growth over the labelled URLs of the bad label finds token combinations
that go with it; tokens that always occur together are one item there, so that a template's parameters don't
multiply, and where URLs have many items combinations are grown level by level instead. Combinations below a support or
confidence are pruned. The rules left are posted in an inverted index under their rarest item: a URL meets only
rules posted under one of its own tokens, and a candidate fires if all its items are there. Hand-written host
and path rules go first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.durable import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the query: action, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


@dataclass(frozen=True)
class MiningParams:
    """min_support: share of labelled URLs; min_count: and at least so many; min_confidence: share of a
    combination's labelled URLs that are bad; min_lift: times the share among all labelled URLs.
    max_tokens: of a combination. longest: items of a URL up to which all its combinations are mined at once."""

    min_support: float = 0.005
    min_count: int = 5
    min_confidence: float = 0.7
    min_lift: float = 1.5
    max_tokens: int = 4
    longest: int = 12


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "^(?s).*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """The sorted set of a URL's tokens: scheme, host labels, path segments with digits folded, query keys, fragment."""
    scheme = F.regexp_extract(url, "^(?s)(.*?)://", 1)
    query = F.regexp_extract(url, "^(?s)[^?#]*\\?([^#]*)", 1)
    folded = F.regexp_replace(path(url), "[0-9]+", "0")
    parts = F.concat(
        F.array(F.concat(F.lit("scheme="), scheme)),
        F.transform(F.split(host(url), "\\."), lambda x: F.concat(F.lit("host="), x)),
        F.transform(F.split(folded, "/"), lambda x: F.concat(F.lit("path="), x)),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query="), F.regexp_extract(x, "^([^=]*)", 1))),
        F.array(F.when(url.contains("#"), "fragment")),
    )
    kept = F.filter(parts, lambda x: x.isNotNull() & ~x.isin("scheme=", "host=", "path=", "query="))
    return F.array_sort(F.array_distinct(F.coalesce(kept, F.array().cast("array<string>"))))


RULE = "rule_id string, needs array<array<string>>, confidence double, support long, anchors array<string>"


def items_of(rows: DataFrame, least: int) -> DataFrame:
    """item, members: the tokens that at least ``least`` bad rows of ``rows(tokens, bad)`` have, those that occur in the same rows as one.

    An item is named by its first token. Rows are compared by their number and two sums of 64-bit hashes.
    """
    where = [F.sum(F.xxhash64("tokens", F.lit(k)).cast("decimal(38,0)")).alias(f"sum_{k}") for k in (1, 2)]
    seen = rows.select("tokens", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bad"), 1)).alias("n_bad"), *where
    )
    alike = seen.where(F.col("n_bad") >= least).groupBy("n", "sum_1", "sum_2").agg(F.array_sort(F.collect_set("token")).alias("members"))
    return alike.select(F.col("members")[0].alias("item"), "members")


def frequent(rows: DataFrame, least: int, params: MiningParams) -> DataFrame:
    """items, support: the sets of at most max_tokens items that at least ``least`` of ``rows(items)`` hold."""
    longest, n = rows.agg(F.max(F.size("items")), F.count(F.lit(1))).first()
    if (longest or 0) <= params.longest:
        found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, n))).fit(rows).freqItemsets
        return found.where(F.size("items") <= params.max_tokens).select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))
    numbered = durable(rows.select("items", F.monotonically_increasing_id().alias("row")))
    held = numbered.select("row", F.col("items").alias("all"), F.explode("items").alias("x")).select("row", "all", F.array("x").alias("items"))
    out = None
    for size in range(1, params.max_tokens + 1):
        counted = durable(held.groupBy("items").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least))
        out = counted if out is None else out.unionByName(counted)
        if size < params.max_tokens:
            kept = held.join(counted.select("items"), "items", "left_semi")
            later = F.filter("all", lambda x: x > F.element_at("items", -1))
            held = kept.select("row", "all", "items", F.explode(later).alias("x")).select("row", "all", F.concat("items", F.array("x")).alias("items"))
    return out


def mine(labelled: DataFrame, params: MiningParams | None = None) -> DataFrame:
    """Rules from ``labelled(url, bad)``: rule_id, needs, confidence, support (bad URLs that hold it), anchors.

    ``needs`` are the items of the combination, each a list of tokens of which a URL must have one: on the labelled
    URLs they occur together. ``anchors`` are the tokens of the item that the fewest labelled URLs have (ties: the first
    in order). Rows with a null label are left out, null URLs have few tokens. Without any bad URL, or none at
    all, there are no rules. Repeated rows count as often as they occur.
    """
    params = params or MiningParams()
    rows = durable(labelled.where(F.col("bad").isNotNull()).select(tokens(F.col("url")).alias("tokens"), "bad", F.monotonically_increasing_id().alias("row")))
    total, bad = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("bad"), 1))).first()
    least = max(params.min_count, math.ceil(params.min_support * total - 1e-9))
    if bad < least:
        return rows.sparkSession.createDataFrame([], RULE)
    known = durable(items_of(rows, least))
    token = known.select("item", F.explode("members").alias("token"))
    sets = durable(
        rows.select("row", "bad", F.explode("tokens").alias("token"))
        .join(token, "token")
        .groupBy("row", "bad")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = durable(frequent(sets.where("bad").select("items"), least, params))
    share = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("all"))
    posted = durable(
        found.select("items", "support", F.explode("items").alias("item"))
        .join(share, "item")
        .groupBy("items", "support")
        .agg(F.min(F.struct("all", "item"))["item"].alias("anchor"))
    )
    met = sets.select("items", F.explode("items").alias("anchor")).groupBy("items", "anchor").agg(F.count(F.lit(1)).alias("n"))
    met = met.withColumnRenamed("items", "own").join(posted, "anchor").where(F.size(F.array_except("items", "own")) == 0)
    whole = met.groupBy("items", "support", "anchor").agg(F.sum("n").alias("all"))
    confidence = F.col("support") / F.col("all")
    rules = whole.where((confidence >= params.min_confidence) & (confidence >= params.min_lift * bad / total))
    parts = (
        rules.select("items", confidence.alias("confidence"), "support", "anchor", F.explode("items").alias("item"))
        .join(known, "item")
        .groupBy("items", "confidence", "support", "anchor")
        .agg(F.array_sort(F.collect_list(F.struct("item", "members"))).alias("parts"))
    )
    anchors = F.filter("parts", lambda x: x["item"] == F.col("anchor"))[0]["members"]
    needs = F.transform("parts", lambda x: x["members"])
    return parts.select(F.array_join("items", " ").alias("rule_id"), needs.alias("needs"), "confidence", "support", anchors.alias("anchors"))


def fired(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Token sets that a rule fires on: ``key`` and its best rule_id and confidence. ``keys``: key, items (distinct).

    Each set meets only the rules posted under its tokens. Spark broadcasts the index while it is known to be small.
    """
    index = durable(rules.select("rule_id", "needs", "confidence", F.explode("anchors").alias("anchor")))
    met = keys.select("key", "items", F.explode("items").alias("anchor")).join(index, "anchor")
    return (
        met.where(F.forall("needs", lambda x: F.arrays_overlap(x, F.col("items"))))
        .groupBy("key")
        .agg(F.max(F.struct("confidence", "rule_id")).alias("best"))
        .select("key", "best.rule_id", "best.confidence")
    )


def explicit_rule(url: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest hand-written rule that fits the URL's host and path; nulls if none does."""
    h, p = host(url), path(url)
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, at, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((h == at) | h.endswith("." + at)) & p.startswith(start)
        name, action = F.when(fits, at + start).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def judge_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, params: MiningParams | None = None) -> DataFrame:
    """Judges every row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, mined_rule, confidence.

    The verdict is the hand-written rule's, else ``block`` where a mined rule fires and ``allow``
    elsewhere. A null URL, or one without ``://``, has an empty host and path and few tokens; it is judged
    like any other. Repeated rows are judged alike.
    """
    url = F.col("url")
    found = mine(labelled, params)
    key = F.array_join(tokens(url), " ")
    keys = pages.select(key.alias("key"), tokens(url).alias("items")).distinct()
    hits = durable(fired(keys, found))
    name, action = explicit_rule(url, rules)
    judged = pages.select(
        "page_id", host(url).alias("host"), path(url).alias("path"), name.alias("rule"), action.alias("action"), key.alias("key")
    )
    return judged.join(hits, "key", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(F.col("rule_id").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.col("rule_id").alias("mined_rule"), "confidence",
    )


def op10_url_rules(spark, sf_dir: str) -> DataFrame:
    """Pages with the id of a labelled document take its label: bad if it is toxic or of low quality."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))
    labelled = pages.join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id").select("url", "bad")
    return judge_urls(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "mined_rule")
