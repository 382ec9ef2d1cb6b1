"""Repeated passages by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into blocks: runs of windows of ``span`` words that start between two
content-defined cuts, with the words those windows reach. Each distinct block is indexed once, at its first
place, by its hash and by seeds (short word runs that are least among the neighbours in some window). A document is
factored against that index. Matches are whole blocks that occur elsewhere, and, where a block occurs once, the
windows whose seed occurs in another reference block, compared one by one, so that a passage is found however
it lies across block boundaries. The parse is greedy: a factor (reference text, offset, length) is extended as
long as the next match continues at the next word of the same reference text. Its matches are checked against the
words once more; factors are at least ``span`` words long, and what they cover are the duplicate spans.

Blocks and windows are told apart by 128 and 96 bits of hash. Only blocks (one per 70 words or so), the seeds of
reference blocks, and their windows with a shared seed are shuffled; the text is shuffled twice, by document.
Counts are combined before each shuffle; joins on a hash that very many texts share are left to adaptive execution,
which splits such a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.durable import durable, mark, release
from kinweave.llm.memory import forget
from kinweave.llm.words import Runs, U64, Words, mixed, slices, sliding

SPAN = 35
SEED = 8
CUT_ONE_IN = 5
LONGEST_BLOCK = 512
PLACE = U64(0x9E3779B97F4A7C15)


class _Parsed:
    """Window starts, seeds and blocks of all rows of a text array."""

    def __init__(self, texts: pa.Array, span: int):
        words = Words(texts)
        self.doc, n = words.doc, len(words.doc)
        self.first = np.searchsorted(self.doc, np.arange(words.n_docs))
        hashes = words.hashes()
        self.runs, self.other = Runs(hashes), Runs(hashes, 1)
        self.seeds = self.runs.windows(min(SEED, span))
        self.reach = span - min(SEED, span) + 1
        least = sliding(self.seeds, self.reach)
        whole = self.doc[: max(0, n - span + 1)] == self.doc[span - 1 :] if n >= span else np.zeros(0, bool)
        self.least = least[: len(whole)]
        self.starts = np.flatnonzero(whole)
        edge = np.zeros(self.reach - 1, U64)
        most = sliding(np.concatenate([edge, np.where(whole, self.least, U64(0)), edge]), self.reach, np.maximum)
        self.chosen = self.seeds[: len(most)] == most[: len(self.seeds)]
        self.span = span

    def blocks(self):
        """Per block: first window, number of windows, and two hashes of its windows in their order."""
        at = self.starts
        if not len(at):
            return at, at, np.zeros(0, U64), np.zeros(0, U64)
        new_doc = np.append(True, self.doc[at[1:]] != self.doc[at[:-1]])
        cut = self.chosen[at] & (mixed(self.seeds[at] + U64(1)) % U64(CUT_ONE_IN) == 0)
        begin = np.flatnonzero(new_doc | cut)
        lengths = np.diff(np.append(begin, len(at)))
        pieces = -(-lengths // LONGEST_BLOCK)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(begin, pieces) + step * LONGEST_BLOCK
        lengths = np.diff(np.append(begin, len(at)))
        order = (np.arange(len(at)) - np.repeat(begin, lengths)).astype(U64) * PLACE
        one, two = (np.add.reduceat(mixed(r.of(at, at + self.span) + order), begin) for r in (self.runs, self.other))
        return at[begin], lengths, one, two

    def block_seeds(self, begin: np.ndarray, lengths: np.ndarray):
        """List offsets, and the place of each chosen seed in reach of each block."""
        places = np.flatnonzero(self.chosen)
        low = np.searchsorted(places, begin)
        counts = np.searchsorted(places, begin + lengths + self.reach - 1) - low
        offsets = np.append(0, np.cumsum(counts))
        return offsets, places[np.repeat(low - offsets[:-1], counts) + np.arange(offsets[-1])]

    def checks(self, at: np.ndarray) -> np.ndarray:
        """32 bits of the second hash of the windows that start at ``at``."""
        return (self.other.of(at, at + self.span) & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _blocks(docs: DataFrame, span: int) -> DataFrame:
    """``check`` is the second hash of the block's first window, for the last look at the words."""
    schema = "doc_key long, start int, n_windows int, block long, twin long, check int, seeds array<long>, places array<int>"

    def run(batches):
        forget()
        for batch in slices(batches):
            parsed = _Parsed(batch.column("text"), span)
            begin, lengths, one, two = parsed.blocks()
            offsets, places = parsed.block_seeds(begin, lengths)
            doc = parsed.doc[begin] if len(begin) else begin
            lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)  # noqa: E731, B023
            yield pa.record_batch({
                "doc_key": batch.column("doc_key").take(pa.array(doc)), "start": pa.array(begin - parsed.first[doc], pa.int32()),
                "n_windows": pa.array(lengths, pa.int32()), "block": _signed(one), "twin": _signed(two), "check": pa.array(parsed.checks(begin)),
                "seeds": lists(_signed(parsed.seeds[places])),
                "places": lists(pa.array(places - parsed.first[parsed.doc[places]] if len(places) else places, pa.int32())),
            })

    return docs.mapInArrow(run, schema)


def _windows(docs: DataFrame, span: int) -> DataFrame:
    """Two hashes of every window that starts in one of its row's ``own`` blocks and whose seed is among its ``seeds``."""

    def run(batches):
        forget()
        for batch in slices(batches):
            parsed = _Parsed(batch.column("text"), span)
            wanted, blocks = batch.column("seeds"), batch.column("own")
            ends = np.searchsorted(parsed.starts, np.append(parsed.first, len(parsed.doc)))
            found = [np.zeros(0, np.int64)]
            for row in range(batch.num_rows):
                own = parsed.starts[ends[row] : ends[row + 1]]
                if len(own):
                    inside = np.zeros(len(own) + 1, np.int32)
                    spans = blocks[row].values
                    start, n = (spans.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    np.add.at(inside, start, 1)
                    np.add.at(inside, start + n, -1)
                    own = own[np.cumsum(inside[:-1]) > 0]
                    found.append(own[np.isin(parsed.least[own], np.array(wanted[row].values.to_numpy(zero_copy_only=False), np.int64).view(U64))])
            at = np.concatenate(found)
            doc = parsed.doc[at] if len(at) else at
            yield pa.record_batch({
                "doc_key": batch.column("doc_key").take(pa.array(doc)), "start": pa.array(at - parsed.first[doc], pa.int32()),
                "window": _signed(parsed.runs.of(at, at + span)), "check": pa.array(parsed.checks(at)),
            })

    return docs.mapInArrow(run, "doc_key long, start int, window long, check int")


def _once(rows: DataFrame, again: DataFrame | None, *by: str) -> DataFrame:
    """``rows`` with those of equal ``by`` once, among texts that are there ``again``."""
    if again is None:
        return rows
    keys = again.select("doc_key")
    return durable(rows.join(keys, "doc_key", "left_anti").unionByName(rows.join(keys, "doc_key", "left_semi").dropDuplicates(["doc_key", *by])))


def matches(docs: DataFrame, span: int = SPAN, again: DataFrame | None = None) -> DataFrame:
    """Where windows of ``span`` words of ``docs(doc_key, text)`` occur again: doc_key, start, n_windows, check, ref_key, ref_start.

    Each row says that the windows starting at word ``start`` and the n_windows - 1 next ones also start
    in the text ``ref_key`` at ``ref_start``; a place never refers to itself, unless a row with the same key
    repeats it. Rows may overlap. Texts of the keys in ``again(doc_key)`` count once, however many rows have them, and
    get no matches of their own.
    """
    blocks = _once(durable(_blocks(docs, span)), again, "start", "block", "twin")
    at = F.struct("doc_key", "start")
    status = durable(blocks.groupBy("block", "twin").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at"), F.max(at).alias("last")))
    first = status.select("block", "twin", F.col("at.doc_key").alias("doc_key"), F.col("at.start").alias("start"))
    indexed = durable(blocks.join(first, ["block", "twin", "doc_key", "start"]).select("doc_key", "start", "n_windows", "seeds", "places"))
    seeds = (
        indexed.select("doc_key", F.explode(F.arrays_zip("seeds", "places")).alias("x"))
        .select("doc_key", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"))
    )
    place = F.struct("doc_key", "place")
    shared = (
        seeds.groupBy("seed").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most").select("seed")
    )
    wanted = seeds.join(shared, "seed", "left_semi").groupBy("doc_key").agg(F.collect_set("seed").alias("seeds"))
    own = indexed.groupBy("doc_key").agg(F.collect_list(F.struct("start", "n_windows")).alias("own"))
    asked = docs.join(wanted, "doc_key").join(own, "doc_key").select("doc_key", "text", "seeds", "own")
    windows = _once(durable(_windows(asked, span)), again, "start", "window")
    shown = windows.groupBy("window", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = durable(windows.join(shown, ["window", "check"], "left_semi"))
    ends = twice.groupBy("window", "check").agg(F.min(at).alias("at"), F.max(at).alias("last"))
    single = twice.join(ends, ["window", "check"]).withColumn("n_windows", F.lit(1))
    whole = blocks.select("doc_key", "start", "n_windows", "block", "twin", "check").join(status.where("n > 1"), ["block", "twin"])
    other = F.when((F.col("at.doc_key") == F.col("doc_key")) & (F.col("at.start") == F.col("start")), F.col("last")).otherwise(F.col("at"))
    columns = ["doc_key", "start", "n_windows", "check", other["doc_key"].alias("ref_key"), other["start"].alias("ref_start")]
    found = whole.select(*columns).unionByName(single.select(*columns))
    return found if again is None else found.join(again.select("doc_key"), "doc_key", "left_anti")


def parse(found: list[tuple], span: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, ref_key, ref_start), in words, from matches (start, n_windows, ref_key, ref_start).

    A match on the diagonal of the factor at hand extends it; one that lies inside it is passed over; any other
    that reaches beyond it begins the next factor.
    """
    out: list[tuple[int, int, int, int]] = []
    start = until = ref = at = -1
    for s, n, key, place in sorted(found, key=lambda m: (m[0], -m[1], m[2], m[3])):
        if out and key == ref and place - s == at - start and s <= until:
            until = max(until, s + n)
        elif not out or s + n > until:
            start, until, ref, at = s, s + n, key, place
            out.append(())
        else:
            continue
        out[-1] = (start, until - start + span - 1, ref, at)
    return out


def factored(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Every row of ``docs`` with its repeated passages removed.

    Returns ``row`` (a struct of all input columns), n_words, n_removed (long), factors (array of (start,
    length, ref_key, ref_start): the parse; ref_key is the 64-bit hash of another row's doc_id and text), spans (array of
    (start, length): the words that factors cover), and kept_text (the kept words joined by one space). A
    word is removed if a window of ``span`` consecutive words over it also starts anywhere else, in the same
    text included; all copies go, the first too. Null and empty texts have no words; texts shorter than
    ``span`` words keep all; words and texts may be of any length. A row that repeats another row's doc_id and
    text is one factor, that other row, so copies cost no more than their own length. Rows that share a ref_key by chance get each other's matches; those that
    don't fit a row's own words are dropped.
    """
    kept = "row struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in docs.schema) + ">"
    schema = (
        f"{kept}, n_words long, n_removed long, factors array<struct<start:int,length:int,ref_key:long,ref_start:int>>, "
        "spans array<struct<start:int,length:int>>, kept_text string"
    )
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.xxhash64("row.doc_id", "row.text").alias("doc_key"), F.xxhash64("row.text", "row.doc_id").alias("other_key")
    )
    again = durable(held.groupBy("doc_key", "other_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_key", "other_key"))
    some = bool(again.limit(1).count())
    since = mark()
    found = matches(held.select("doc_key", F.col("row.text").alias("text")), span, again if some else None)
    # written, so that blocks, seeds and windows are off the disk before the texts are shuffled again
    own = durable(found.groupBy("doc_key").agg(F.collect_list(F.struct("start", "n_windows", "ref_key", "ref_start", "check")).alias("matches")))
    release(since, last=False)
    factor = pa.struct({"start": pa.int32(), "length": pa.int32(), "ref_key": pa.int64(), "ref_start": pa.int32()})

    def run(batches):
        forget()
        for batch in slices(batches):
            found, whole = batch.column("matches").to_pylist(), batch.column("whole").to_pylist()
            hits = np.flatnonzero([bool(x) for x in found])
            parsed = _Parsed(batch.column("text").take(pa.array(hits)), span)
            true = dict(zip(hits.tolist(), _true_matches(parsed, [found[i] for i in hits]), strict=True))
            n_words, n_removed, factors, spans, kept_text = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = text.encode().split()
                own = parse(true.get(k, []), span)
                if whole[k] is not None:
                    own = [(0, len(words), whole[k], 0)] if len(words) >= span else []
                gone = np.zeros(len(words) + 1, np.int64)
                for start, length, _, _ in own:
                    gone[start] += 1
                    gone[start + length] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                factors.append([dict(zip(("start", "length", "ref_key", "ref_start"), f, strict=True)) for f in own])
                spans.append([{"start": int(a), "length": int(b - a)} for a, b in edges.reshape(-1, 2)])
                kept_text.append(b" ".join(np.array(words, object)[~gone].tolist() if own else words).decode())
            yield pa.record_batch({
                "row": batch.column("row"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "factors": pa.array(factors, pa.list_(factor)),
                "spans": pa.array(spans, pa.list_(pa.struct({"start": pa.int32(), "length": pa.int32()}))),
                "kept_text": pa.array(kept_text, pa.string()),
            })

    joined = held.join(own, "doc_key", "left")
    if some:
        joined = joined.join(again.withColumn("whole", F.col("doc_key")), ["doc_key", "other_key"], "left")
    else:
        joined = joined.withColumn("whole", F.lit(None).cast("long"))
    return joined.select("row", F.col("row.text").alias("text"), "matches", "whole").mapInArrow(run, schema)


def _true_matches(parsed: _Parsed, found: list[list[dict]]) -> list[list[tuple]]:
    """The matches of each row that its words bear out: the first window's hash is computed again."""
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    start, n, check = (np.array([m[k] for own in found for m in own], np.int64) for k in ("start", "n_windows", "check"))
    at = parsed.first[row] + start if len(row) else row
    last = at + n + parsed.span - 2
    fits = np.flatnonzero(last < len(parsed.doc))
    fits = fits[parsed.doc[last[fits]] == row[fits]]
    fits = fits[parsed.checks(at[fits]) == check[fits]]
    true: list[list[tuple]] = [[] for _ in found]
    flat = [m for own in found for m in own]
    for i in fits.tolist():
        m = flat[i]
        true[row[i]].append((m["start"], m["n_windows"], m["ref_key"], m["ref_start"]))
    return true


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with the repeated passages cut from text and n_chars set anew; a text without any stays as it is."""
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("row.text"))
    columns = []
    for name, kind in docs.dtypes:
        own = F.col(f"row.`{name}`")
        if name == "text":
            own = text
        elif name == "n_chars":
            own = F.when(changed, F.length("kept_text").cast(kind)).otherwise(own)
        columns.append(own.alias(name))
    return factored(docs, span).select(*columns)


def op2_rlz_repeats(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return factored(docs).select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").alias("n_spans")
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i, md5(list_aggregate(words[i:i + 34], 'string_agg', ' ')) AS g
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 34)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM r) GROUP BY doc_id),
p AS (SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w),
x AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.k) AS kept FROM p
      LEFT JOIN (SELECT doc_id, unnest(gone) AS k FROM c) AS c ON p.doc_id = c.doc_id AND p.k = c.k WHERE c.k IS NULL GROUP BY p.doc_id),
runs AS (SELECT doc_id, count(*) AS n_spans FROM
  (SELECT doc_id, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS step FROM (SELECT doc_id, unnest(gone) AS k FROM c)) WHERE step IS NULL OR step > 1 GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0)::INT AS n_spans
FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN x ON w.doc_id = x.doc_id LEFT JOIN runs ON w.doc_id = runs.doc_id
"""
