import zlib

import numpy as np
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from kinweave.functions.durable import reserved
from kinweave.llm import tokenfiles
from kinweave.llm.encoding import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("width", [1, 2, 5, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64)
        data = tokenfiles.pack_bits(ids, width)
        assert len(data) == -(-n // 64) * 8 * width
        assert tokenfiles.unpack_bits(data, width, n).tolist() == ids.tolist()
        stream = "".join(f"{b:08b}"[::-1] for b in data)
        assert [int(stream[i * width : (i + 1) * width][::-1], 2) for i in range(n)] == ids.tolist()
    with pytest.raises(ValueError, match="fit"):
        tokenfiles.pack_bits(np.array([1 << width], np.uint64), width)


def test_widths():
    assert [tokenfiles.width_of(n) for n in (1, 2, 3, 256, 257, 49_408, 65_537)] == [1, 1, 2, 8, 9, 16, 17]


def table(spark):
    rows = [(i * 3 % 101, f"word{i} Some TEXT {i} É" * (i % 7)) for i in range(101)]
    rows += [(500, "token " * 150_000), (501, None), (502, ""), (503, "same"), (503, "same"), (503, "other words"), (None, "no id"), (-4, "negative")]
    return rows, spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, start int, ids binary").repartition(5)


def ids_of(rows, end=(2,)):
    library = Tokenizer.from_file(PATH)
    return [(d, [*library.encode(t or "", add_special_tokens=False).ids, *end]) for d, t in rows]


def test_files_like_the_library(spark):
    rows, docs = table(spark)
    folder = reserved(spark)
    tokenfiles.write_corpus(docs, PATH, folder)
    got = sorted(tokenfiles.read_corpus(spark, folder).collect(), key=lambda r: r.start)
    order = [-1000 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    want = ids_of(rows)
    assert sorted((str(r.doc_id), zlib.crc32(r.ids)) for r in got) == sorted((str(d), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want)
    meta = tokenfiles.manifest(folder)
    assert meta["width"] == 16 and meta["n_ids"] == at
    whole = np.frombuffer(b"".join(r.ids for r in got), "<u4")
    for low, high in ((0, 1), (5, 5), (1000, 1003), (65_530, 131_080), (at - 3, at), (0, at)):
        part = sorted(tokenfiles.read_corpus(spark, folder, low, high).collect(), key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in part), "<u4").tolist() == whole[low:high].tolist()
        assert not part or part[0].start == low


def test_damage_is_seen(spark):
    _, docs = table(spark)
    folder = reserved(spark)
    tokenfiles.write_corpus(docs, PATH, folder)
    files, path = fs.FileSystem.from_uri(folder)
    name = f"{path}/{tokenfiles.manifest(folder)['shards'][0]['name']}"
    with files.open_input_file(name) as f:
        data = bytearray(f.read())
    data[len(tokenfiles.MAGIC) + 5] ^= 1
    with files.open_output_stream(name) as f:
        f.write(bytes(data))
    with files.open_input_file(name) as f, pytest.raises(ValueError, match="damaged"):
        tokenfiles.Shard(f).ids(0, 10)


def test_modes_and_empty_table(spark):
    _, docs = table(spark)
    folder = reserved(spark)
    tokenfiles.write_corpus(docs.limit(0), PATH, folder)
    assert tokenfiles.read_corpus(spark, folder).count() == 0
    with pytest.raises(Exception, match="already"):
        tokenfiles.write_corpus(docs, PATH, folder)
    rows = spark.createDataFrame([(5, bytes(range(8))), (None, b""), (7, None), (9, b"\x01\x00\x0f\x00" * 70_000)], "doc_id long, ids binary")
    for _ in range(2):
        rows.coalesce(2).write.format("packed_ids").option("width", 27).mode("overwrite").save(folder)
        got = tokenfiles.read_corpus(spark, folder)
        assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == sorted((str(r.doc_id), r.ids or b"") for r in rows.collect())
    files, path = fs.FileSystem.from_uri(folder)
    assert sum(x.base_name.endswith(".ids") for x in files.get_file_info(fs.FileSelector(path))) == len(tokenfiles.manifest(folder)["shards"])
