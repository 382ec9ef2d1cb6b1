import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinweave.llm import bpe, encoding

PATH = encoding.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(7)
    out = ["", " ", "  ", "\n", " \n\n a", "a  b", "x y  z", "it's we'll I'M don't'", "<|endoftext|>", "a <|endoftext|>b<|endoftext|><|endo", "tab\tx \t y\r\n", "\0 a\0", "日本語 テスト😀😀", "é" * 50, "a" * 5000, "ab" * 3000, "".join(rng.choice("abcdefghij") for _ in range(9000)), "1234567890" * 400, " " * 3000 + "x", "!?" * 700, "\x1c\x1d a\x85b c"]
    alphabet = list("abcdefgh THE the ing er 12 \n\t.,!'") + ["é", "ß", "ñ", "中", "🙂", "́", "　"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(150)]
    out += ["word " * 40000, "x" * 70000 + " y z " * 5]
    return out


def test_like_the_library(library):
    coder = bpe.Transducer(PATH)
    for t, pieces in zip(texts(), coder.encode(texts()), strict=True):
        ids = np.frombuffer(b"".join(pieces), "<u4")
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]
        back = bpe.Decoder(coder.table)
        assert "".join([back.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)] + [back.feed(ids[:0], True)]) == t


def test_memo_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20 * 180)
    coder = bpe.Transducer(PATH)
    rng = random.Random(2)
    for _ in range(30):
        t = " ".join("".join(rng.choice("abc") for _ in range(3)) for _ in range(8))
        (pieces,) = coder.encode([t])
        assert np.frombuffer(b"".join(pieces), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(coder.young) <= 40 and len(coder.old) <= 40


def test_long_units_stay_out_of_the_memo(library):
    coder = bpe.Transducer(PATH)
    text = "a " + "".join(random.Random(3).choice("abc1.") for _ in range(20_000)) + " b"
    (pieces,) = coder.encode([text])
    assert np.frombuffer(b"".join(pieces), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, coder.young)) <= bpe.MEMO_UNIT


@pytest.mark.parametrize("gap", [" ", "\n", ""])
def test_ids_come_before_the_end_is_read(library, gap):
    """Of a text of many groups, the first ids are there when only the first group was looked at."""
    words = ["w%d" % (i % 977) for i in range(60_000)]
    text, coder, seen = gap.join(words), bpe.Transducer(PATH), []
    learn, short = coder.learn, coder._short
    coder.learn = lambda wanted: (seen.append(sum(len(u) for u in wanted if len(u) <= bpe.MEMO_UNIT)), learn(wanted))[1]
    coder._short = lambda pretokens: (seen.append(sum(map(len, pretokens))), short(pretokens))[1]
    stream = coder.stream(text, size=10_000)
    first = next(x for x in stream if x)
    assert first and sum(seen) < 60_000 < len(text) / 3
    ids = np.frombuffer(first + b"".join(stream), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_lookahead_is_sufficient():
    table = bpe.MergeTable(PATH)
    assert 0 < table.lookahead < 5000
    rng = random.Random(4)
    for _ in range(12):
        letters = rng.choice(["ab", "abcdefghijklmnopqrstuvwxyz", "etaoin", "=-"])
        word = "".join(rng.choice(letters) for _ in range(table.lookahead + 300)).encode()
        whole = np.cumsum(table.length[table.encode_one(word)]).tolist()
        for cut in (len(word) - 1, len(word) - 7, len(word) - 100):
            part = np.cumsum(table.length[table.encode_one(word[:cut])])
            stable = part[part <= cut - table.lookahead].tolist()
            assert whole[: len(stable)] == stable


def test_small_lookahead_by_hand():
    assert bpe.sufficient_lookahead([(b"a", b"b")]) == 1 + 2
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 2 + 2


def test_table(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, None, None), (0, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in encoding.round_trip(docs, PATH).collect()}
    import hashlib

    assert got == {
        (i, len(library.encode(t or "", add_special_tokens=False).ids), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows
    }
    back = encoding.decode(encoding.encode(docs, PATH), PATH)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t, _ in rows)
    assert encoding.round_trip(docs.limit(0), PATH).count() == 0


def test_heap_merges_like_the_library_and_the_matrix(monkeypatch):
    rng = random.Random(12)
    library, coder = Tokenizer.from_file(PATH), bpe.transducer(PATH)
    words = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "etaoinshr", "的一是不了人我在有他", "é🙂x") for n in (1, 2, 3, 40, 700)]
    for word in words:
        data = word.encode()
        assert coder.table.merge_long(data).tolist() == coder.table.encode_one(data).tolist()
    for stride in (64, 8192):
        monkeypatch.setattr(bpe, "STRIDE", stride)
        for word in words:
            if word.isalpha():
                got = [i for part in coder.table.encode_long(word.encode()) for i in part.tolist()]
                assert got == library.encode(word, add_special_tokens=False).ids


def test_a_megabyte_of_letters_takes_seconds():
    rng = random.Random(13)
    library, coder = Tokenizer.from_file(PATH), bpe.transducer(PATH)
    for alphabet, n in (("etaoinshrdlu", 1_000_000), ("的一是不了人我在有他这中大来上", 330_000)):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        began = time.process_time()
        ids = b"".join(next(coder.encode([text])))
        assert time.process_time() - began < 25
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
