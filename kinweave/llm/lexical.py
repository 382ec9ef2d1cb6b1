"""Ranked lexical search with windowed bucket scoring.

Documents become rows of counts of the terms that some query has; terms are looked up by a 64-bit hash. The rows are
dealt out in ranges of doc_id and stand in that order. A task takes WINDOW documents at a time, turns their counts
into postings, and for each query adds what its terms are worth into an array of one number for each document of the
window, small enough for a core's cache. Flags tell which places were touched; those whose score can still
enter are harvested into the query's heap. Heaps of all tasks meet in two steps at the end.

Queries are worked through in blocks of at most QUERY_TERMS terms, each a pass over the documents, so what a task
holds of them is bounded however many there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.durable import durable
from kinweave.llm.words import Words, slices

#: Documents of a window: 64 KB of scores and 8 KB of flags.
WINDOW = 1 << 13
#: Terms of queries that are searched in one pass, repeats in a query not counted; 24 bytes each go to every task.
QUERY_TERMS = 1 << 20
TOP = 10
#: Groups that heaps of the ranges go through before they meet.
SALTS = 32

#: Lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 0x20
FOLD[65:91] += 32


class Terms(Words):
    """Runs of ASCII letters, digits and all other than ASCII characters, lower-cased in A-Z."""

    def __init__(self, texts: pa.Array):
        _, offsets, data = texts.buffers()
        folded = FOLD[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint8)
        super().__init__(pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(folded)], 0, texts.offset))

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash, times) of each distinct term of each row, in order."""
        hashes = self.hashes()
        order = np.lexsort((hashes, self.doc))
        doc, hashes = self.doc[order], hashes[order]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]))) if len(doc) else order
        return doc[first], hashes[first], np.diff(np.append(first, len(doc)))


def query_terms(items: DataFrame) -> DataFrame:
    """row, item_id, term (hash as long), times of each distinct term of each row of ``items(item_id, text)``."""

    def run(batches):
        for batch in slices(batches):
            doc, hashes, times = Terms(batch.column("text")).counted()
            at = pa.array(doc)
            yield pa.record_batch(
                [batch.column("row").take(at), batch.column("item_id").take(at), pa.array(hashes.view(np.int64)), pa.array(times)],
                names=["row", "item_id", "term", "times"],
            )

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "row long, item_id long, term long, times long")


def term_counts(docs: DataFrame, wanted) -> DataFrame:
    """doc_id, n (all terms), places, times of every row of ``docs(doc_id, text)``.

    ``wanted`` is a broadcast sorted array of term hashes; places (array<int>) are those that a text has, times how often.
    """

    def run(batches):
        known = wanted.value
        for batch in slices(batches):
            terms = Terms(batch.column("text"))
            doc, hashes, times = terms.counted()
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[place] == hashes
            offsets = pa.array(np.searchsorted(doc[hit], np.arange(terms.n_docs + 1)).astype(np.int32))
            yield pa.record_batch(
                [
                    batch.column("doc_id"), pa.array(terms.counts().astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(place[hit].astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(times[hit].astype(np.int32))),
                ],
                names=["doc_id", "n", "places", "times"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, places array<int>, times array<int>")


class Scorer:
    """Scores windows of documents against queries and keeps each query's best.

    ``starts`` cuts ``places`` (of terms) and ``worth`` (weight times repeats) into queries. Documents come in ascending order.
    """

    def __init__(self, starts: np.ndarray, places: np.ndarray, worth: np.ndarray, n_terms: int, n_docs: int, length: int, k: int):
        # terms of no weight add nothing to a score
        self.queries = []
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            good = np.flatnonzero(worth[low:high] > 0) + low
            self.queries.append((places[good].tolist(), worth[good].tolist()))
        self.n_terms, self.n_docs, self.length, self.k = n_terms, n_docs, length, k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in self.queries]
        self.docs: dict[int, int | None] = {}
        self.seen = 0

    def window(self, doc_ids: list, n: np.ndarray, sizes: np.ndarray, places: np.ndarray, times: np.ndarray) -> None:
        """``sizes`` cuts ``places`` and ``times`` into the documents, at most WINDOW."""
        slot = np.repeat(np.arange(len(n)), sizes)
        m = 100 - 75 + (75 * n * self.n_docs) // max(self.length, 1)
        impact = (1_000_000_000 * times) // (1000 * times + 8 * m[slot])
        order = np.argsort(places, kind="stable")
        slot, impact = slot[order], impact[order]
        ends = np.searchsorted(places[order], np.arange(self.n_terms + 1)).tolist()
        scores, touched = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
        for q, (terms, worth) in enumerate(self.queries):
            for term, weight in zip(terms, worth, strict=True):
                low, high = ends[term], ends[term + 1]
                if low < high:
                    own = slot[low:high]  # a document is there once, so plain indexing adds right
                    scores[own] += weight * impact[low:high]
                    touched[own] = True
            self.harvest(q, scores, np.flatnonzero(touched), doc_ids)
            scores[:] = 0
            touched[:] = False
        self.seen += len(n)
        held = {-x[1] for heap in self.heaps for x in heap}
        self.docs = {s: d for s, d in self.docs.items() if s in held}

    def harvest(self, q: int, scores: np.ndarray, found: np.ndarray, doc_ids: list) -> None:
        """Puts the places ``found`` into the heap of query q. Later documents lose ties."""
        heap, values = self.heaps[q], scores[found]
        least = heap[0][0] if len(heap) == self.k else 0
        found, values = found[values > least], values[values > least]
        if len(found) > self.k:
            best = np.argsort(-values, kind="stable")[: self.k]
            found, values = found[best], values[best]
        for place, value in zip(found.tolist(), values.tolist(), strict=True):
            entry = (value, -(self.seen + place))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                continue
            self.docs[self.seen + place] = doc_ids[place]


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """doc_id (list), n, sizes, places, times of windows of documents in turn."""
    held, rows = [], 0
    for batch in batches:
        low = 0
        while low < batch.num_rows:
            part = batch.slice(low, WINDOW - rows)
            held.append(part)
            rows += part.num_rows
            low += part.num_rows
            if rows == WINDOW:
                yield _joined(held)
                held, rows = [], 0
    if rows:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple:
    whole = pa.Table.from_batches(held)
    flat = lambda name: np.concatenate([c.flatten().to_numpy() for c in whole[name].chunks]).astype(np.int64)
    sizes = np.concatenate([c.value_lengths().to_numpy() for c in whole["places"].chunks])
    return whole["doc_id"].to_pylist(), whole["n"].to_numpy().astype(np.int64), sizes, flat("places"), flat("times")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each row of ``items(item_id, text)`` the ``k`` best rows of ``docs(doc_id, text)``.

    Terms and scores are those of the module's query: an integer form of BM25 with k1 = 0.8 and b = 0.75. Only scores
    above 0 count; of equal ones the smaller doc_id is first, null before all. Documents that repeat a doc_id are ranked each for itself,
    and so are repeated queries. Null and empty texts have no terms: no document of that kind is found or counted, no query
    of that kind finds any. Texts of any length are counted whole. Empty tables give an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    asked = durable(query_terms(items))
    blocks = -(-asked.count() // QUERY_TERMS)
    parts = [
        _search_block(docs, asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b) if blocks > 1 else asked, k) for b in range(blocks)
    ]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _search_block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    context = docs.sparkSession.sparkContext
    asked = asked.orderBy("row", "term").toArrow()  # QUERY_TERMS rows
    if not asked.num_rows:
        return None
    rows, terms, times = (asked[c].to_numpy() for c in ("row", "term", "times"))
    known = np.unique(terms.view(np.uint64))
    counts = durable(term_counts(docs, context.broadcast(known)))
    n_docs, length = counts.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(known), np.int64)
    held = counts.select(F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df[held["place"].to_numpy()] = held["df"].to_numpy()
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    places = np.searchsorted(known, terms.view(np.uint64))
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    cuts = np.append(starts, len(rows))
    queries = context.broadcast((cuts, places, weight[places] * times, rows[starts].tolist(), asked["item_id"].take(starts).to_pylist()))

    def run(batches):
        cuts, own, worth, names, item_ids = queries.value
        scorer = Scorer(cuts, own, worth, len(known), n_docs, length, k)
        for window in _columns(batches):
            scorer.window(*window)
        out = [(names[q], item_ids[q], scorer.docs[-s], score) for q, heap in enumerate(scorer.heaps) for score, s in heap]
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["row", "item_id", "doc_id", "score"])

    # only documents with a term of some query can have a score
    live = counts.where(F.size("places") > 0).withColumn("copy", F.monotonically_increasing_id())
    dealt = live.repartitionByRange("doc_id", "copy").sortWithinPartitions("doc_id")
    best = dealt.select("doc_id", "n", "places", "times").mapInArrow(run, "row long, item_id long, doc_id long, score long")
    best = best.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for keys in (["row", "salt"], ["row"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_windowed_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM len),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // total) AS m FROM len, corpus),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), corpus),
s AS (SELECT item_id, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM b JOIN w ON b.term = w.term JOIN tf ON b.term = tf.term JOIN m ON tf.doc_id = m.doc_id GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
