"""BPE encoding and decoding of document tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.bpe import Decoder, transducer
from kinweave.llm.words import slices


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row of ``docs(doc_id, text)``. Null and empty texts have no ids."""

    def run(batches):
        coder = transducer(path)
        for batch in slices(batches):
            ids = [np.frombuffer(b"".join(x), "<u4") for x in coder.encode(batch.column("text").to_pylist())]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ``encoded(doc_id, ids)``. Null ids decode to the empty text; bad byte runs to U+FFFD."""

    def run(batches):
        table = transducer(path).table
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                coder, own = Decoder(table), np.array(ids.as_py() or [], np.int64)
                parts = [coder.feed(own[i : i + 4096]) for i in range(0, len(own), 4096)]
                texts.append("".join([*parts, coder.feed(own[:0], True)]))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every row of ``docs(doc_id, text)`` as a stream of pieces, keeping digests only.

    doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers) and decoded_sha256 (UTF-8), both
    lowercase hex. Null and empty texts have no tokens. Special tokens in a text get their own ids.
    """

    def run(batches):
        coder = transducer(path)
        for batch in slices(batches):
            count, before, after = [], [], []
            for pieces in coder.encode(batch.column("text").to_pylist()):
                n, ids_hash, text_hash, back = 0, hashlib.sha256(), hashlib.sha256(), Decoder(coder.table)
                for piece in pieces:
                    n += len(piece) // 4
                    ids_hash.update(piece)
                    text_hash.update(back.feed(np.frombuffer(piece, "<u4")).encode())
                text_hash.update(back.feed(np.zeros(0, np.int64), True).encode())
                count.append(n)
                before.append(ids_hash.hexdigest())
                after.append(text_hash.hexdigest())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(count, pa.int64()),
                "ids_sha256": pa.array(before, pa.string()), "decoded_sha256": pa.array(after, pa.string()),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_streaming_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, tokenizer_path("byte_bpe_50k.json"))
