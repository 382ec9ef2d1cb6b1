"""Packing of token pieces into sequences by multiway differencing.

Each document is encoded and cut into full sequences and a rest of smaller pieces. Pieces are dealt by hash
into cells of a bounded number of tokens. Inside a cell, Karmarkar-Karp differencing keeps a heap of
partial partitions into k windows; the two with the largest spread are merged, the fullest windows of one
with the emptiest of the other, until one partition into near-equal windows is left. k starts at the
least possible and rises while a window exceeds the capacity.
"""

from __future__ import annotations

import gc
import heapq
import re
import zlib
from contextlib import contextmanager
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.functions.durable import durable
from kinweave.llm.bpe import ENTRY_BYTES, LONG, MEMO_BYTES, MEMO_UNIT, MergeTable
from kinweave.llm.encoding import tokenizer_path
from kinweave.llm.memory import remembers
from kinweave.llm.words import slices

CAPACITY = 4096
END_ID = 2
#: A rest is cut into pieces of at most so many tokens, so that windows can be evened out.
PIECE = 256
#: Mean windows in a cell; what a task holds is a few times this.
CELL_WINDOWS = 128
#: Words of Latin-1 without white space or controls: for them lower-casing is all there is to normalization.
PLAIN = re.compile("[!-~\xa1-\xff]+")
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


@contextmanager
def uncollected():
    """Without the cyclic garbage collector, which finds nothing among millions of byte strings and takes a tenth of the time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class WordEncoder:
    """Token ids of texts, word by word, with a memo of recent words of bounded bytes. Very long words stay in it for one call only.

    No pre-token of this tokenizer has white space in it, so a text's ids are those of its words in turn. New
    words are merged many at a time; words beyond Latin-1, long ones, and those with special tokens are
    encoded by the tokenizers library.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.table = MergeTable(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        self.passing: list[bytes] = []

    def learn(self, wanted: set[bytes]) -> None:
        if self.held > MEMO_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        missing = wanted.difference(self.young)
        known = missing.intersection(self.old)
        self.young.update(zip(known, map(self.old.__getitem__, known), strict=True))
        plain = [w for w in missing.difference(known) if w.isalpha() and len(w) <= LONG]
        coded = self.table.encode_many(list(map(bytes.lower, plain)))
        self.young.update(zip(plain, coded, strict=True))
        split, other = {}, []
        for word in missing.difference(known, plain):
            text = word.decode()
            if len(word) <= LONG and PLAIN.fullmatch(text) and "<|" not in text:
                text = text.lower()
                split[word] = (text.encode(),) if text.isalpha() else tuple([p.encode() for p in PRETOKEN.findall(text)])
            else:
                other.append(word)
        parts = list(set().union(*split.values()))
        ids = dict(zip(parts, self.table.encode_many(parts), strict=True))
        rest = {w: self.young[w] for w in known}
        for word, several in split.items():
            self.young[word] = rest[word] = ids[several[0]] if len(several) == 1 else b"".join(map(ids.__getitem__, several))
        for word, found in zip(other, self.library.encode_batch([w.decode() for w in other], add_special_tokens=False), strict=True):
            self.young[word] = rest[word] = np.array(found.ids, "<u4").tobytes()
        self.passing = [w for w in other if len(w) > MEMO_UNIT]
        for own, words in ((coded, plain), (rest.values(), rest)):
            self.held += ENTRY_BYTES * len(words) + sum(map(len, words)) + sum(map(len, own))
        self.held -= sum(len(w) + len(self.young[w]) + ENTRY_BYTES for w in self.passing)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [t.encode().split() for t in texts]
        with uncollected():
            self.learn(set().union(*split))
        out = [b"".join(map(self.young.__getitem__, words)) for words in split]
        for word in self.passing:
            del self.young[word]
        return out


@cache
def word_encoder(path: str) -> WordEncoder:
    """One for each file and worker process."""
    return WordEncoder(path)


remembers(word_encoder.cache_clear)


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full sequences first, then the rest in parts of at most ``piece``."""
    full = n // capacity * capacity
    return [(i, capacity) for i in range(0, full, capacity)] + [(i, min(piece, n - i)) for i in range(full, n, piece)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece of ``docs(doc_id, text)``; the end id closes each document."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, text_key long"

    def run(batches):
        encoder = word_encoder(path)
        close = END_ID.to_bytes(4, "little")
        for batch in slices(batches):
            owner, rows = [], []
            for k, ids in enumerate(encoder.encode(batch.column("text").to_pylist())):
                ids += close
                n = len(ids) // 4
                for start, length in cuts(n, capacity):
                    owner.append(k)
                    rows.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            at = pa.array(owner, pa.int64())
            yield pa.record_batch([
                batch.column("doc_id").take(at), *map(pa.array, columns), batch.column("text_key").take(at),
            ], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "text_key"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("text_key")
    )
    return rows.mapInArrow(run, schema)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k windows of near-equal sums: lists of indices into ``sizes``. It begins with the k greatest sizes as one partial partition, the next k as another, and so on."""
    if not sizes:
        return [[] for _ in range(k)]
    heap = []
    # a partial partition: sums in falling order, and of each window the tree of what is in it
    order = np.argsort(sizes, kind="stable")[::-1].tolist()
    for low in range(0, len(order), k):
        group = order[low : low + k]
        sums = np.zeros(k, np.int64)
        sums[: len(group)] = [sizes[i] for i in group]
        heap.append((int(sums[-1] - sums[0]), low, sums, [*group, *[None] * (k - len(group))]))
    heapq.heapify(heap)
    serial = len(order)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        sums = a + b[::-1]
        joined = [(x, y) if x is not None and y is not None else (y if x is None else x) for x, y in zip(left, right[::-1], strict=True)]
        place = np.argsort(-sums, kind="stable")
        sums = sums[place]
        serial += 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial, sums, [joined[i] for i in place.tolist()]))
    return [_leaves(tree) for tree in heap[0][3]]


def _leaves(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        elif x is not None:
            out.append(x)
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As few windows as differencing can fill without exceeding the capacity; full pieces have windows of their own."""
    full = [[i] for i, n in enumerate(sizes) if n == capacity]
    rest = [i for i, n in enumerate(sizes) if n < capacity]
    k = -(-sum(sizes[i] for i in rest) // capacity)
    while rest:
        found = difference([sizes[i] for i in rest], k)
        if max(sum(sizes[rest[i]] for i in w) for w in found) <= capacity:
            return full + [[rest[i] for i in w] for w in found if w]
        k += 1
    return full


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs every row of ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty
    text is one piece, its end id. Repeated rows are packed like any others. Sequences are named by
    their cell and their place in it, so the numbers have gaps.
    """
    cut = durable(pieces(docs, path, capacity))
    total = cut.agg(F.sum("length")).first()[0] or 0
    cells = max(1, total // (CELL_WINDOWS * capacity))
    dealt = cut.withColumn("cell", F.pmod(F.xxhash64("text_key", "start"), F.lit(cells)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "text_key", "start"], ascending=False, kind="stable").reset_index(drop=True)
        sizes = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for number, members in enumerate(windows(sizes, capacity)):
            at = 0
            for i in sorted(members):
                sequence[i], offset[i] = number, at
                at += sizes[i]
        rows["sequence_id"] = rows["cell"].to_numpy() * (1 << 24) + sequence
        rows["offset"] = offset
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return dealt.groupBy("cell").applyInPandas(fill, schema)


def op5_differencing_pack(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, tokenizer_path("word_bpe_49k.json"))
