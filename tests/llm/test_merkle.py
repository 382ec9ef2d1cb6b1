import hashlib
import zlib

from kinweave.llm import merkle

LOWER = str.maketrans(merkle.UPPER, merkle.UPPER.lower())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def own(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def ways(nodes):
    """The root of a list of digests, and of each the (digests left, digests right) of its run on every level."""
    found, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, p in enumerate(at):
            found[k].append((runs[p // 8][: p % 8], runs[p // 8][p % 8 + 1 :]))
        at, nodes = [p // 8 for p in at], [sha("".join(r)) for r in runs]
    return nodes[0], found


def brute(rows):
    """Manifest rows of (doc_id, source, lang, n_chars, text), sorted."""
    key = lambda x: (x is not None, b"" if x is None else str(x).encode())
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, own(*r), r))
    order, out = sorted(trees, key=key), []
    roots = [ways([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])]) for lang in order]
    root, above = ways([r for r, _ in roots])
    for lang, (subroot, found), up in zip(order, roots, above, strict=True):
        for (_, _, leaf, r), way in zip(sorted(trees[lang], key=lambda x: x[:3]), found, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            now = own(*r[:4], r[4].translate(LOWER)) if changed else leaf
            for left, right in [*way, *up]:
                now = sha("".join([*left, now, *right]))
            proof = sha("".join("".join([*left, *right]) for left, right in [*way, *up]))
            out.append((r[0], leaf, subroot, root, proof, now, now == root))
    return sorted(out, key=str)


def check(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, merkle.build(table.repartition(3)).collect()), key=str) == brute(rows)


def test_like_brute_force(spark):
    rows = [(i * 7, f"s{i % 3}", ["en", "de", "ü", "zz"][min(i % 10, 3)] if i % 11 else None, i, f"Text {i} É") for i in range(700)]
    rows += [(5, None, None, None, None), (None, "s", "en", 1, "Null id"), (None, "s", "en", 1, "Other"), (14, "s", "en", 2, "again")]
    rows += [(21, "s", "solo", 0, ""), (9, "s", "en", 4, "Same row")] + [(9, "s", "en", 4, "Same row")] * 20 + [(3, "s", "", 9, "X" * 70_000)]
    check(spark, rows)


def test_runs_of_all_sizes(spark):
    for n in (1, 2, 8, 9, 17, 65):
        check(spark, [(i, "s", "en", i, f"A{i}") for i in range(n)])


def test_many_trees_and_clashing_columns(spark):
    rows = [(i, "s", f"l{i % 70}", i, "Word") for i in range(150)]
    check(spark, rows)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place int, leaf string")
    assert sorted(map(tuple, merkle.build(table).collect()), key=str) == brute(rows)
    assert merkle.build(table.limit(0)).count() == 0
