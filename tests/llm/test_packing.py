import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from kinweave.llm import memory, packing
from kinweave.llm.encoding import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def texts():
    rng = random.Random(1)
    alphabet = list("abcdefgh ETAOIN 12 \n\t.,!'") + ["é", "É", "ß", "Σ", "İ", "中", "🙂", "é", "\xa0", "\xad", "\x1c", "\x85", "²", "ª"]
    out = [None, "", " ", "It's WE'LL", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "ΟΔΟΣ οδος", "x" * 3000, "word " * 9000, "naïve Ünïcode ÀÉ"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(150)]


def test_ids_like_the_library():
    library, own = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    for t, ids in zip(texts(), own.encode([t or "" for t in texts()]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_windows_are_near_equal_and_within_capacity():
    rng = random.Random(3)
    for n in (0, 1, 2, 50, 900):
        sizes = [rng.choice([4096, rng.randint(1, 256), 256]) for _ in range(n)]
        found = packing.windows(sizes)
        assert sorted(i for w in found for i in w) == list(range(n))
        sums = [sum(sizes[i] for i in w) for w in found]
        assert max(sums, default=0) <= 4096
        assert len(found) <= sum(sizes) / 4096 * 1.03 + 1.5
    sizes = [8, 7, 6, 5, 4]
    assert sorted(sum(sizes[i] for i in w) for w in packing.difference(sizes, 2)) == [14, 16]


def test_every_id_is_in_one_piece(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t, 0) for i, t in enumerate(texts())] + [(None, None, 0), (3, "It's WE'LL", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cell int").repartition(3)
    got = packing.pack(docs, PATH).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t, _ in rows:
        if i in (3, None):
            continue
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in by_doc[3]) == 2 * by_doc[3][0].doc_tokens
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_memos_are_forgotten():
    encoder = packing.word_encoder(PATH)
    assert packing.word_encoder(PATH) is encoder
    memory.forget()
    assert packing.word_encoder(PATH) is not encoder
