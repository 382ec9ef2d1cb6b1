"""SimHash near-duplicates by fuzzy Golay keys.

A 64-bit fingerprint is cut into three segments, padded to 23 bits. The binary Golay code decodes a segment
to the code words within distance 4 of it: at most six, given by one table over its 2048 syndromes. Two
segments that differ in at most two bits share one of them. Four differing bits leave two of the three
segments with at most two each, so a pair of code words is a common key of any two fingerprints to be
linked. Keys are joined and each bucket's fingerprints are verified.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.durable import durable
from kinweave.llm.words import slices, text_bytes
from kinweave.operators.components import connected_components

DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Per kind of key, what it holds of each segment: g a code word, x the bits themselves, - nothing.
SHORT_KEYS = ("gg-", "g-g", "-gg")
LONG_KEYS = ("xg-", "x-g", "gx-", "-xg", "g-x", "-gx", "ggg")
#: Distinct fingerprints above which keys of at least 33 bits replace those of 24 bits.
LONG_FROM = 1 << 23
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
PAIRWISE = 16


def fingerprint(words: list[bytes], size: int = 4) -> int:
    """The SimHash of the words' shingles; 0 without words."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    starts = np.append(0, ends[: n - 1] + 1)
    ends = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    values = np.fromiter(
        (digest(text[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, n
    )
    ones = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 14):
        part = values[low : low + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for batch in slices(batches):
            fps = [fingerprint(x.lower().split()) for x in text_bytes(batch.column("text"))]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long")


@cache
def _decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; for each syndrome, the error patterns of up to four bits and their number."""

    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    low = np.array([remainder(v) for v in range(1 << 12)], np.int32)
    high = np.array([remainder(v << 12) for v in range(1 << 11)], np.int32)
    patterns, number = np.zeros((2048, 6), np.int32), np.zeros(2048, np.int32)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = low[e & 4095] ^ high[e >> 12]
            if weight < 4 or number[s] and bin(patterns[s][0]).count("1") == 3:
                patterns[s][number[s]] = e
                number[s] += 1
    return low, high, patterns, number


def code_words(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices (12 bits) of the code words near each 23-bit segment, and how many of the six count."""
    low, high, patterns, number = _decoder()
    syndrome = low[segment & 4095] ^ high[segment >> 12]
    return (segment[:, None] ^ patterns[syndrome]) >> 11, number[syndrome]


def keys_of(fps: np.ndarray, kinds=SHORT_KEYS) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints (uint64), and the index of the fingerprint of each."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    words = [code_words(p) for p in parts]
    keys, owners = [], []
    for kind, form in enumerate(kinds):
        key = np.full((len(fps), 1), kind, np.uint64)
        valid = np.ones((len(fps), 1), bool)
        for how, part, (near, number) in zip(form, parts, words, strict=True):
            if how == "x":
                key = key * np.uint64(1 << 22) + part.astype(np.uint64)[:, None]
            elif how == "g":
                key = (key[:, :, None] * np.uint64(4096) + near.astype(np.uint64)[:, None, :]).reshape(len(fps), -1)
                valid = (valid[:, :, None] & (np.arange(6) < number[:, None])[:, None, :]).reshape(len(fps), -1)
        owner, _ = np.nonzero(valid)
        keys.append(key[valid])
        owners.append(owner)
    return np.concatenate(keys), np.concatenate(owners)


def stars(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint of one bucket to the first of those it reaches inside the bucket."""
    left, heads, tails = np.unique(fps), [], []
    while len(left) > 1:
        head, left = left[0], left[1:]
        queue = [head]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= distance
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                heads.append(np.full(len(found), head))
                tails.append(found)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *heads]), np.concatenate([none, *tails])


def bucket_links(keys: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of sorted keys. Small buckets are compared pair by pair, large ones by `stars`."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(first, len(keys)))
    size = np.repeat(sizes, sizes)
    heads, tails = [], []
    keep = (size > 1) & (size <= PAIRWISE)
    k, f = keys[keep], fps[keep]
    for apart in range(1, PAIRWISE):
        near = (k[apart:] == k[:-apart]) & (f[apart:] != f[:-apart]) & (np.bitwise_count(f[apart:] ^ f[:-apart]) <= distance)
        heads.append(f[:-apart][near])
        tails.append(f[apart:][near])
    for at in np.flatnonzero(sizes > PAIRWISE):
        a, b = stars(fps[first[at] : first[at] + sizes[at]], distance)
        heads.append(a)
        tails.append(b)
    pairs = np.unique(np.stack([np.concatenate(heads), np.concatenate(tails)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(distinct: DataFrame, kinds=SHORT_KEYS, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that span every group of fingerprints reachable over at most ``distance`` bits.

    ``distinct(fp)`` holds each fingerprint once. A bucket yields fewer links than it has members, not all
    pairs; a task holds one bucket's distinct fingerprints (8 bytes each) at a time.
    """

    def post(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for low in range(0, len(fps), 1 << 15):
                part = fps[low : low + (1 << 15)].view(np.uint64)
                keys, owner = keys_of(part, kinds)
                yield pa.record_batch({"key": pa.array(keys.view(np.int64)), "fp": pa.array(part[owner].view(np.int64))})

    def verify(batches):
        keys = fps = np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.append(keys, batch.column("key").to_numpy().view(np.uint64))
            fps = np.append(fps, batch.column("fp").to_numpy().view(np.uint64))
            whole = np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]) if len(keys) else 0
            if whole:
                yield _linked(*bucket_links(keys[:whole], fps[:whole], distance))
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield _linked(*bucket_links(keys, fps, distance))

    posted = distinct.select("fp").mapInArrow(post, "key long, fp long")
    ordered = posted.repartition("key").sortWithinPartitions("key", "fp")
    return ordered.mapInArrow(verify, "a long, b long").distinct()


def _linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over links of at most four differing bits. Null and empty
    texts have fingerprint zero and are linked like others. Rows without a doc_id take no part: their
    component_id is null. Copies are reduced to one fingerprint before keys are made, so groups of any
    size cost one row each; components are found over fingerprints, never over documents.
    """
    signed = durable(signatures(docs))
    distinct = durable(signed.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("least")))
    kinds = LONG_KEYS if distinct.count() > LONG_FROM else SHORT_KEYS
    found = connected_components(links(distinct, kinds))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    linked = rooted.where(F.col("root") != F.col("fp")).groupBy("root").agg(F.min("least").alias("other"))
    ids = rooted.join(linked, "root", "left").select("fp", F.least("least", "other").alias("own"), "root")
    heads = ids.where(F.col("fp") == F.col("root")).select("root", F.col("own").alias("component_id"))
    table = durable(rooted.join(heads, "root").select("fp", "component_id"))
    return signed.join(table, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest doc_id (of repeated rows, any one). Rows without a doc_id stay."""
    stay = near_duplicates(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("stay_id")).distinct()
    number = F.row_number().over(Window.partitionBy("id").orderBy("text_hash"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    held = held.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("text_hash"))
    alone = held.where(F.col("id").isNull()).select("row.*")
    chosen = held.join(stay, F.col("id") == F.col("stay_id"), "left_semi").withColumn("number", number)
    return chosen.where("number = 1").select("row.*").unionByName(alone)


def op7_golay_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
