"""Quality rules with adaptive thresholds, in DataFrame operations only.

Every document gets a few whole-number measures. Per language and source, each measure is summed up in a
mergeable quantile sketch: counts of values rounded to a relative precision of 1/32. Sketches are tables of
counts, so merging is addition and the result does not depend on partitioning. Instead of fixed cutoffs a
document is held against fences of its own group: an outer decile plus a multiple of its distance from the
median. Rates of rare things are taken with half a count more than there are, so that a document without any stands
for what its length can tell, and a fence is never 0. A document's count is held against what the fence lets expect of its length plus
the error of that number, so that a short text does not fail by one line and a long one not by a handful. A group with too few documents uses its language's
merged sketch, then the merged sketch of all. Fences are joined back to the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.durable import durable

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SALTS = 16


@dataclass(frozen=True)
class QualityRules:
    """percent: the outer quantile of a fence. reach: how often its distance from the median is added to it. errors:
    standard errors of the expected count that a document may lie beyond a fence. min_group: documents below which a
    group uses the sketch merged one level up."""

    min_words: int = 10
    max_repeat_percent: int = 20
    percent: int = 90
    reach: int = 3
    errors: int = 3
    min_group: int = 200


@dataclass(frozen=True)
class Measure:
    """PER times ``count`` by ``base``, rounded down. clump: how many come together, as the words of a repeated window do.
    rare: half a count is added. both: there is a low fence too."""

    count: str
    base: str
    clump: int = 1
    rare: bool = True
    both: bool = False


PER = 100_000
MEASURES = {
    "dup_lines": Measure("n_dup_lines", "n_words"),
    "repeats": Measure("n_repeat_words", "n_words", clump=10),
    "symbols": Measure("n_symbols", "word_chars"),
    "word_length": Measure("word_chars", "n_words", rare=False, both=True),
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


#: Positions of 5-word windows whose hash is found twice or more, turned into the number of words they cover.
_COVERED = """
CASE WHEN size(hashes) = size(array_distinct(hashes)) THEN 0 ELSE
  transform(array(sort_array(transform(hashes, (x, i) -> struct(x AS x, i AS i)))), s ->
    transform(array(sort_array(filter(transform(s, (e, k) ->
        CASE WHEN k > 0 AND s[greatest(k - 1, 0)].x = e.x THEN e.i
             WHEN k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].x = e.x THEN e.i END), p -> p IS NOT NULL))), q ->
      aggregate(transform(q, (p, k) ->
        CASE WHEN k < size(q) - 1 THEN least(5, q[least(k + 1, size(q) - 1)] - p) ELSE 5 END), 0, (a, b) -> a + b))[0])[0]
END
"""
_HASHES = """
CASE WHEN size(words) < 5 THEN array() ELSE
  transform(array(words), w -> transform(sequence(0, size(w) - 5), i ->
    xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])))[0]
END
"""


def measure(docs: DataFrame) -> DataFrame:
    """Adds the counts of each document beside ``row``, a struct of all its columns.

    Words are runs of other than ASCII white space; a null text has none. Columns: row, n_words,
    word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long). Windows are compared by
    64-bit hash inside one document.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    counted = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row",
        _words(text).alias("words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    hashed = counted.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_HASHES).alias("hashes"),
    )
    return hashed.select(
        "row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.expr(_COVERED).cast("long").alias("n_repeat_words"),
    )


def base_failed(rules: QualityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )


def sketch(measured: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """Quantile sketches by lang and source of the documents that pass the base rules: lang, source, measure, value, n.

    Add ``n`` to merge sketches.
    """
    exact = {name: F.expr(f"{PER} * (2 * {m.count} + {int(m.rare)}) div (2 * greatest({m.base}, 1))") for name, m in MEASURES.items()}
    values = F.explode(F.create_map(*[x for name, c in exact.items() for x in (F.lit(name), c)])).alias("measure", "exact")
    shift = F.greatest(F.length(F.bin("exact")) - 6, F.lit(0))
    return (
        measured.where(~base_failed(rules or QualityRules()))
        .select(F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), values)
        .withColumn("value", _rounded("exact", shift))
        .groupBy("lang", "source", "measure", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _rounded(name: str, shift: Column) -> Column:
    """Keeps the six leading binary digits."""
    step = F.pow(F.lit(2.0), shift).cast("long")
    return F.col(name) - F.col(name) % step


def fences(sketches: DataFrame, rules: QualityRules) -> DataFrame:
    """One row for each (lang, source) with its fences: lang, source, low_<m> (where the measure has one), high_<m>."""
    found = sketches.select("lang", "source").distinct()
    names = [f"{side}_{m}" for m in sorted(MEASURES) for side in ("low", "high") if side == "high" or MEASURES[m].both]
    levels = []
    for keys in (["lang", "source"], ["lang"], []):
        merged = sketches.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
        by = Window.partitionBy(*keys, "measure")
        ranked = merged.select(
            *keys, "measure", "value",
            F.sum("n").over(by.orderBy("value")).alias("upto"), F.sum("n").over(by).alias("total"),
        )
        at = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.col("value")))  # noqa: E731, B023
        middle = ranked.groupBy(*keys, "measure").agg(
            at(100 - rules.percent).alias("low"), at(50).alias("mid"), at(rules.percent).alias("high"), F.max("total").alias("total")
        )
        fence = lambda side, m: F.max(
            F.when(F.col("measure") == m, F.col(side) + rules.reach * (F.col(side) - F.col("mid")))
        ).alias(f"{side}_{m}")
        wide = [fence(*n.split("_", 1)) for n in names]
        levels.append(middle.groupBy(*keys).agg(*wide, F.max("total").alias("total")))
    own, by_lang, whole = levels
    flat = lambda df, n: df.select(*[c for c in ("lang", "source") if c in df.columns], F.struct(*names, "total").alias(n))
    a, b, c = flat(own, "own"), flat(by_lang, "mid"), flat(whole, "top")
    joined = (
        found.alias("f")
        .join(a.alias("a"), F.expr("f.lang <=> a.lang AND f.source <=> a.source"))
        .join(b.alias("b"), F.expr("f.lang <=> b.lang"))
        .join(c, F.lit(True))
    )
    chosen = F.when(F.col("own.total") >= rules.min_group, F.col("own")).when(
        F.col("mid.total") >= rules.min_group, F.col("mid")
    ).otherwise(F.col("top"))
    return joined.select(F.col("f.lang").alias("lang"), F.col("f.source").alias("source"), chosen.alias("x")).select(
        "lang", "source", *[f"x.{n}" for n in names]
    )


def _beyond(rules: QualityRules) -> Column:
    """Whether a document's count lies beyond what a fence lets expect by more than the error of that. Null without fences."""
    out = F.lit(False)
    for name, m in sorted(MEASURES.items()):
        # the low fence of a wide group may lie below 0
        expected = lambda side: F.greatest(F.col(f"{side}_{name}") * F.col(m.base) / F.lit(float(PER)), F.lit(0.0))  # noqa: E731, B023
        error = lambda side: rules.errors * F.sqrt(m.clump * (expected(side) + 1))  # noqa: E731, B023
        out |= F.col(m.count) - expected("high") > error("high")
        if m.both:
            out |= expected("low") - F.col(m.count) > error("low")
    return out


def judge(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """Judges every row of ``docs`` (doc_id, text, lang, source, and any others).

    Returns ``row`` (a struct of all input columns), the counts of `measure`, base_failed and kept. A row
    is kept if it passes the base rules and does not lie beyond a fence of its language and source. Null
    languages and sources are groups of their own; a null or empty text fails the base rules, a text of any length
    is measured whole. Repeated rows are judged alike; an empty table gives an empty result. The fences go to the
    documents salted, so that a group of any size is spread; Spark broadcasts them only while their table is
    known to be small.
    """
    return _judged(durable(measure(docs)), rules or QualityRules())


def _judged(measured: DataFrame, rules: QualityRules) -> DataFrame:
    table = durable(
        fences(durable(sketch(measured, rules)), rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salt = F.pmod(F.xxhash64("row.doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    joined = measured.withColumn("salt", salt).alias("d").join(
        table.alias("t"), F.expr("d.row.lang <=> t.lang AND d.row.source <=> t.source AND d.salt = t.salt"), "left"
    )
    failed = base_failed(rules)
    return joined.select(
        "row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(_beyond(rules), F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """The rows that `judge` keeps, with the columns of ``docs``. Nulls, empty and long texts, repeated rows: as there."""
    return judge(docs, rules).where("kept").select("row.*")


def op8_adaptive_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    counts = measure(docs).withColumn("row", F.struct("row.doc_id", "row.lang", "row.source"))
    return _judged(durable(counts), QualityRules()).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def oracle(min_group: int) -> str:
    """The query in DuckDB SQL."""
    return _ORACLE.replace("MIN_GROUP", str(min_group))


_ORACLE = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS g
        FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
x AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m),
u AS (SELECT lang, source, unnest([{'k': 1, 'v': 100000 * (2 * n_symbols + 1) // (2 * greatest(word_chars, 1))}, {'k': 2, 'v': 100000 * (2 * n_dup_lines + 1) // (2 * greatest(n_words, 1))},
        {'k': 3, 'v': 100000 * (2 * n_repeat_words + 1) // (2 * greatest(n_words, 1))}, {'k': 4, 'v': 100000 * word_chars // greatest(n_words, 1)}]) AS z
      FROM x WHERE NOT base_failed),
s AS (SELECT lang, source, z.k AS k, z.v - z.v % (1::BIGINT << greatest(length(bin(z.v)) - 6, 0)) AS value FROM u),
g AS (SELECT DISTINCT lang, source FROM s),
l AS (SELECT 1 AS lv, g.lang, g.source, k, value FROM g JOIN s ON g.lang IS NOT DISTINCT FROM s.lang AND g.source IS NOT DISTINCT FROM s.source
      UNION ALL SELECT 2, g.lang, g.source, k, value FROM g JOIN s ON g.lang IS NOT DISTINCT FROM s.lang
      UNION ALL SELECT 3, g.lang, g.source, k, value FROM g CROSS JOIN s),
q AS (SELECT lv, lang, source, k, quantile_disc(value, 0.1) AS lo, quantile_disc(value, 0.5) AS mid, quantile_disc(value, 0.9) AS hi, count(*) AS n FROM l GROUP BY ALL),
c AS (SELECT lang, source, k, (lo - 3 * (mid - lo))::DOUBLE AS low, (hi + 3 * (hi - mid))::DOUBLE AS high
      FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, k ORDER BY (n < MIN_GROUP AND lv < 3)::INT, lv) AS r FROM q) WHERE r = 1),
f AS (SELECT lang, source, map_from_entries(list((k, {'low': low, 'high': high}))) AS f FROM c GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(NOT (n_symbols - e1 > 3 * sqrt(e1 + 1) OR n_dup_lines - e2 > 3 * sqrt(e2 + 1) OR n_repeat_words - e3 > 3 * sqrt(10 * (e3 + 1))
    OR word_chars - e4 > 3 * sqrt(e4 + 1) OR e5 - word_chars > 3 * sqrt(e5 + 1)), true) AS kept
FROM (SELECT x.*, greatest(f[1].high * word_chars / 100000::DOUBLE, 0) AS e1, greatest(f[2].high * n_words / 100000::DOUBLE, 0) AS e2, greatest(f[3].high * n_words / 100000::DOUBLE, 0) AS e3,
  greatest(f[4].high * n_words / 100000::DOUBLE, 0) AS e4, greatest(f[4].low * n_words / 100000::DOUBLE, 0) AS e5
  FROM x LEFT JOIN f ON x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source)
"""
ORACLE = oracle(QualityRules.min_group)
