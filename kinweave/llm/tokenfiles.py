"""Token ids in binary files of fixed-width integers, as a Spark data source.

`PackedIds` is the format ``packed_ids``. A table is a folder of shards, one for each task that wrote, and a manifest
that is written last. Every id takes the same number of bits, the least that the vocabulary needs. 64 ids fill whole
64-bit words, so numpy packs and unpacks columns of lanes. A shard is

    magic | blocks | block offsets, block checksums, document ids, null flags, document ends | sizes as JSON | its length | magic

A block holds BLOCK ids (the last one fewer, filled up to a whole group of 64) and has its own offset and CRC-32, so a
reader fetches any range of ids by reading the blocks it touches. Ranges of ids that are asked for with the options
``start`` and ``stop`` skip all other shards and blocks.

Tasks write files of names of their own, and the manifest names those of the tasks that succeeded, so a task that is
run again after an executor was lost does no harm. Files are reached by pyarrow's file systems: local and shared folders,
and the object stores and HDFS that pyarrow has a client for.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from kinweave.functions.durable import reserved
from kinweave.llm.encoding import tokenizer_path
from kinweave.llm.packing import END_ID, word_encoder
from kinweave.llm.words import slices

MAGIC = b"PKIDS\x00\x01\n"
#: Ids in a block and, roughly, in a batch of a reader.
BLOCK, BATCH = 1 << 16, 1 << 20
LANES = 64
U64 = np.uint64


def width_of(size: int) -> int:
    """The least number of bits that holds all ids of a vocabulary of ``size``."""
    return max(1, (size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """The ids one after the other in ``width`` bits each, low bits first, filled up with zeros to a multiple of 64 ids."""
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> width):
        raise ValueError(f"an id does not fit into {width} bits")
    lanes = np.zeros(-(-len(ids) // LANES) * LANES, U64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, LANES)
    out = np.zeros((len(lanes), width), U64)
    for j in range(LANES):
        word, bit = divmod(j * width, 64)
        out[:, word] |= lanes[:, j] << U64(bit)
        if bit + width > 64:
            out[:, word + 1] |= lanes[:, j] >> U64(64 - bit)
    return out.astype("<u8").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of what `pack_bits` made, as 32-bit integers."""
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    out, mask = np.empty((len(words), LANES), np.uint32), U64((1 << width) - 1)
    for j in range(LANES):
        word, bit = divmod(j * width, 64)
        lane = words[:, word] >> U64(bit)
        if bit + width > 64:
            lane = lane | (words[:, word + 1] << U64(64 - bit))
        out[:, j] = lane & mask
    return out.ravel()[:n]


class ShardWriter:
    """Writes one shard. Blocks go out as they fill; what stays in memory are document ids, ends and block offsets."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.at = stream, width, len(MAGIC)
        self.pending: list[np.ndarray] = []
        self.held, self.n_ids = 0, 0
        self.offsets, self.sums, self.docs, self.nulls, self.ends = [], [], [], [], []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ends.append(self.n_ids)
        if self.held >= BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for low in range(0, whole, BLOCK):
            data = pack_bits(ids[low : min(low + BLOCK, whole)], self.width)
            self.offsets.append(self.at)
            self.sums.append(zlib.crc32(data))
            self.stream.write(data)
            self.at += len(data)
        self.pending, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self.flush(True)
        tables = (
            np.array([*self.offsets, self.at], "<u8"), np.array(self.sums, "<u4"),
            np.array(self.docs, "<i8"), np.array(self.nulls, "u1"), np.array(self.ends, "<u8"),
        )
        for table in tables:
            self.stream.write(table.tobytes())
        sizes = {"width": self.width, "block": BLOCK, "n_ids": self.n_ids, "n_docs": len(self.docs), "n_blocks": len(self.sums), "tables": self.at}
        trailer = json.dumps(sizes).encode()
        self.stream.write(trailer + len(trailer).to_bytes(4, "little") + MAGIC)


class Shard:
    """A shard that is open for reading."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = file.read_at(4 + len(MAGIC), size - 4 - len(MAGIC))
        if tail[4:] != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("this is no file of packed ids")
        n = int.from_bytes(tail[:4], "little")
        sizes = json.loads(file.read_at(n, size - 4 - len(MAGIC) - n))
        self.width, self.block, self.n_ids, self.n_docs = (sizes[k] for k in ("width", "block", "n_ids", "n_docs"))
        at, found = sizes["tables"], []
        for kind, count in (("<u8", sizes["n_blocks"] + 1), ("<u4", sizes["n_blocks"]), ("<i8", self.n_docs), ("u1", self.n_docs), ("<u8", self.n_docs)):
            found.append(np.frombuffer(file.read_at(np.dtype(kind).itemsize * count, at), kind))
            at += found[-1].nbytes
        self.offsets, self.sums, self.docs, self.nulls = found[:4]
        self.ends = found[4].astype(np.int64)

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids low to high - 1 of the shard, from the blocks that hold them."""
        if low >= high:
            return np.zeros(0, np.uint32)
        first, last = low // self.block, (high - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            own = data[int(self.offsets[b] - self.offsets[first]) : int(self.offsets[b + 1] - self.offsets[first])]
            if zlib.crc32(own) != self.sums[b]:
                raise ValueError(f"block {b} is damaged")
            parts.append(unpack_bits(own, self.width, min(self.block, self.n_ids - b * self.block)))
        return np.concatenate(parts)[low - first * self.block : high - first * self.block]


@dataclass
class Written(WriterCommitMessage):
    """A task's shard."""

    part: int
    name: str
    n_ids: int
    n_docs: int


@dataclass
class ShardRange(InputPartition):
    """Ids low to high - 1 of a shard whose first id is number ``base`` of the table."""

    path: str
    base: int
    low: int
    high: int


class PackedIds(DataSource):
    """Format ``packed_ids``: doc_id long, start long (ids before the document's), ids binary (little-endian 32-bit integers).

    To write, order rows (doc_id, ids) by partition and within it as they are to be numbered. Option ``width``: bits of an id. With
    option ``tokenizer``, the file of one of the kind that `packing.WordEncoder` reads, rows are (doc_id, text) and are encoded here, option
    ``end_id`` behind each. To read, ``start`` and ``stop`` leave only the parts of documents with ids from
    number ``start`` up to ``stop``. Only mode "append" to a new folder and mode "overwrite" are there.
    """

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return "doc_id long, start long, ids binary"

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"], int(self.options["width"]), overwrite, self.options.get("tokenizer"), self.options.get("end_id"))

    def reader(self, schema) -> PackedReader:
        low, high = self.options.get("start"), self.options.get("stop")
        return PackedReader(self.options["path"], int(low or 0), None if high is None else int(high))


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, overwrite: bool, tokenizer: str | None = None, end_id: str | None = None):
        self.path, self.width, self.tokenizer = path, width, tokenizer
        self.close = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        files, folder = fs.FileSystem.from_uri(path)
        if not overwrite and files.get_file_info(f"{folder}/manifest.json").type != fs.FileType.NotFound:
            raise ValueError(f"{path} has a table already")

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        """doc_id and ids as little-endian 32-bit integers."""
        for batch in batches if self.tokenizer is None else slices(batches):
            if self.tokenizer is None:
                ids = ((x.as_py() or b"") for x in batch.column("ids"))
            else:
                ids = (x + self.close for x in word_encoder(self.tokenizer).encode(batch.column("text").to_pylist()))
            yield from zip(batch.column("doc_id").to_pylist(), ids, strict=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = fs.FileSystem.from_uri(self.path)
        part, name, shard = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.ids", None
        for doc_id, ids in self.rows(iterator):
            if shard is None:
                files.create_dir(folder, recursive=True)
                stream = files.open_output_stream(f"{folder}/{name}")
                shard = ShardWriter(stream, self.width)
            shard.add(doc_id, np.frombuffer(ids, "<u4"))
        if shard is None:
            return Written(part, "", 0, 0)
        shard.close()
        stream.close()
        return Written(part, name, shard.n_ids, len(shard.docs))

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = fs.FileSystem.from_uri(self.path)
        shards, base = [], 0
        for m in sorted((m for m in messages if m and m.name), key=lambda m: m.part):
            shards.append({"name": m.name, "base": base, "n_ids": m.n_ids, "n_docs": m.n_docs})
            base += m.n_ids
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps({"width": self.width, "n_ids": base, "shards": shards}).encode())
        self.sweep({s["name"] for s in shards})

    def abort(self, messages: list[Written | None]) -> None:
        self.sweep(self.named())

    def named(self) -> set[str]:
        """The shards of the table that was there before."""
        files, folder = fs.FileSystem.from_uri(self.path)
        if files.get_file_info(f"{folder}/manifest.json").type == fs.FileType.NotFound:
            return set()
        return {s["name"] for s in manifest(self.path)["shards"]}

    def sweep(self, keep: set[str]) -> None:
        """Deletes shards that no manifest names: of an overwritten table, or of tasks that failed."""
        files, folder = fs.FileSystem.from_uri(self.path)
        for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.endswith(".ids") and info.base_name not in keep:
                files.delete_file(info.path)


def manifest(path: str) -> dict:
    """width, n_ids and the shards (name, base, n_ids, n_docs) of a table."""
    files, folder = fs.FileSystem.from_uri(path)
    with files.open_input_file(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


class PackedReader(DataSourceReader):
    def __init__(self, path: str, low: int = 0, high: int | None = None):
        self.path, self.low, self.high = path, low, high

    def partitions(self) -> list[ShardRange]:
        found = manifest(self.path)
        stop = found["n_ids"] if self.high is None else self.high
        out = []
        for s in found["shards"]:
            low, high = max(0, self.low - s["base"]), min(s["n_ids"], stop - s["base"])
            if low < high or (self.high is None and not self.low):
                out.append(ShardRange(f"{self.path}/{s['name']}", s["base"], low, high))
        return out or [ShardRange("", 0, 0, 0)]

    def read(self, partition: ShardRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, path = fs.FileSystem.from_uri(partition.path)
        with files.open_input_file(path) as file:
            shard = Shard(file)
            starts = np.append(0, shard.ends[:-1]) if shard.n_docs else shard.ends
            whole = partition.low == 0 and partition.high == shard.n_ids
            first = 0 if whole else int(np.searchsorted(shard.ends, partition.low, "right"))
            stop = shard.n_docs if whole else int(np.searchsorted(starts, partition.high, "left"))
            while first < stop:
                last = max(first + 1, min(stop, int(np.searchsorted(shard.ends, starts[first] + BATCH, "right"))))
                low, high = np.maximum(starts[first:last], partition.low), np.minimum(shard.ends[first:last], partition.high)
                data = shard.ids(int(low[0]), int(high[-1])).astype("<u4").tobytes()
                cut = 4 * np.append(low - low[0], high[-1] - low[0])
                ids = pa.Array.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(cut.astype("<i8")), pa.py_buffer(data)])
                docs = pa.array(shard.docs[first:last], pa.int64(), mask=shard.nulls[first:last].astype(bool))
                yield pa.record_batch([docs, pa.array(partition.base + low), ids.cast(pa.binary())], names=["doc_id", "start", "ids"])
                first = last


def write_corpus(docs: DataFrame, path: str, folder: str, end_id: int | None = END_ID) -> None:
    """Encodes every row of ``docs(doc_id, text)`` and writes the ids as format ``packed_ids``, in ascending doc_id order.

    Rows are dealt out in ranges of doc_id before they are encoded, so texts are encoded once and ids are not shuffled.
    Null ids come first. Rows of one doc_id stand in the order of a hash of their text, and a doc_id of any number of
    rows is split among ranges. Null and empty texts have no ids but the end. An empty table gives a manifest without
    shards. Other columns are not read.
    """
    library = Tokenizer.from_file(path)
    width = width_of(max([*library.get_vocab(with_added_tokens=True).values(), end_id or 0]) + 1)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = keyed.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    docs.sparkSession.dataSource.register(PackedIds)
    writer = rows.write.format("packed_ids").option("width", width).option("tokenizer", path)
    (writer if end_id is None else writer.option("end_id", end_id)).mode("append").save(folder)


def read_corpus(spark: SparkSession, folder: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """doc_id, start, ids of the table in ``folder``, or of ids number ``start`` to ``stop`` - 1 alone."""
    spark.dataSource.register(PackedIds)
    reader = spark.read.format("packed_ids").option("start", start)
    return (reader if stop is None else reader.option("stop", stop)).load(folder)


def op13_packed_ids(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = reserved(spark)
    write_corpus(docs, tokenizer_path("word_bpe_49k.json"), folder)
    return read_corpus(spark, folder).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
