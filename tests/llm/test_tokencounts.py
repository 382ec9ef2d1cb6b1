import random

from tokenizers import Tokenizer

from kinweave.llm import tokencounts
from kinweave.llm.bpe import transducer
from kinweave.llm.encoding import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def apply(text, edits):
    for at, removed, inserted in edits:
        at = max(0, min(at, len(text)))
        text = text[:at] + (inserted or "") + text[max(at, min(at + removed, len(text))) :]
    return text


def tree_of(coder, text):
    parts = tokencounts.cut(coder, text)
    tokencounts.learn(coder, [parts])
    return tokencounts.Tree(parts, tokencounts.counts(coder, parts))


def test_edits_match_full_encoding():
    rng = random.Random(1)
    library, coder = Tokenizer.from_file(PATH), transducer(PATH)
    alphabet = list("abc the ing \n\t.,'s1") + ["é", "🙂", "  ", "<|endoftext|>", "<|endof", "text|>"]
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [make(rng.choice([0, 1, 5, 60, 400])) for _ in range(150)]
    trees = [tree_of(coder, t) for t in texts]
    for _ in range(6):
        for text, tree in zip(texts, trees, strict=True):
            assert "".join(tree.texts) == text
            assert (tree.tokens[1], tree.chars[1]) == (len(library.encode(text, add_special_tokens=False).ids), len(text))
        edits = [(rng.randint(-2, len(t) + 3), rng.choice([0, 1, 5, 50, 10**6]), make(rng.choice([0, 0, 1, 3, 30]))) if rng.random() < 0.9 else None for t in texts]
        tokencounts.edit_all(coder, trees, edits)
        texts = [t if e is None else apply(t, [e]) for t, e in zip(texts, edits, strict=True)]


def test_only_the_region_is_encoded_again():
    coder = transducer(PATH)
    tree = tree_of(coder, "some words here and there " * 4000)
    assert tokencounts.edit_all(coder, [tree], [(50_000, 3, "x")])[0] < 120


def test_text_without_white_space():
    """Code in one line: an edit encodes little again, and counts stay those of the library through hundreds of edits."""
    rng = random.Random(8)
    library, coder = Tokenizer.from_file(PATH), transducer(PATH)
    pieces = ["function", "if(x){", "return", "a", "12", "'s", "don't", "!!'re", "=", ";", "}", "é", "中文", "_", "''ll", "0x1f", "²"]
    text = "".join(rng.choice(pieces) for _ in range(20_000))
    tree = tree_of(coder, text)
    assert tokencounts.edit_all(coder, [tree], [(len(text) // 2, 0, "x")])[0] < 2000
    text = apply(text, [(len(text) // 2, 0, "x")])
    for k in range(400):
        edit = (rng.randint(0, len(text)), rng.choice([0, 1, 1, 2, 9]), rng.choice(["", *pieces]))
        text = apply(text, [edit])
        assert tokencounts.edit_all(coder, [tree], [edit])[0] < 2500
        if k % 40 == 0:
            assert (tree.tokens[1], tree.chars[1]) == (len(library.encode(text, add_special_tokens=False).ids), len(text))
    assert "".join(tree.texts) == text and tree.tokens[1] == len(library.encode(text, add_special_tokens=False).ids)


def test_thousands_of_edits_at_one_place():
    """Each encodes a bounded number of characters again, after a large paste too."""
    rng = random.Random(6)
    library, coder = Tokenizer.from_file(PATH), transducer(PATH)
    text = "some words here and there " * 200
    tree = tree_of(coder, text)
    for k in range(3_000):
        edit = (2600 + k, 0, rng.choice("ab c"))
        assert tokencounts.edit_all(coder, [tree], [edit])[0] < 5 * tokencounts.CROWDED
        text = apply(text, [edit])
    paste = (100, 0, "pasted text " * 20_000)
    text = apply(text, [paste])
    tokencounts.edit_all(coder, [tree], [paste])
    for edit in ((120_000, 1, "x"), (120_003, 0, " y"), (50, 100_000, "")):
        assert tokencounts.edit_all(coder, [tree], [edit])[0] < 5 * tokencounts.CROWDED or edit[1] > 10
        text = apply(text, [edit])
    assert "".join(tree.texts) == text
    assert tree.tokens[1] == len(library.encode(text, add_special_tokens=False).ids)


def test_table(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(
        [(1, "one two three", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (1, "one two three", 0)], "doc_id long, text string, edits int"
    )
    edits = spark.createDataFrame(
        [(1, 2, 0, 0, "zero "), (1, 1, 4, 3, "2"), (2, 1, 5, 5, "new"), (9, 1, 0, 0, "x"), (3, 1, 0, 1, None)],
        "doc_id long, edit_no int, at int, removed int, inserted string",
    )
    got = sorted((str(r.doc_id), r.n_tokens, r.n_tokens_after) for r in tokencounts.recount(tokencounts.with_edits(docs, edits), PATH).collect())
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    one = ("1", n("one two three"), n("zero one 2 three"))
    assert got == sorted([one, one, ("2", 0, n("new")), ("3", 0, 0), ("None", n("x"), n("x"))])
    assert tokencounts.recount(docs.limit(0).withColumn("e", tokencounts.sample_edits()), PATH, "e").count() == 0
