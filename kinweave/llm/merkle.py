"""A Merkle manifest of a table, in Pregel-style supersteps over RDDs of nodes.

Every row is a leaf of the tree of its language; up to FAN consecutive nodes become one of the next level until a
tree is a single node. The roots of the trees, in order of language, are the leaves of one more tree.

Going up, each node sends its digest to its parent. A parent that has heard from all its children hashes them and sends
on; a tree that has come down to one node stops. Going down, each parent sends its children the digests of their
siblings in front of what it was sent itself, until every leaf has its way to the root and can be verified alone.

Nodes below level NEAR are partitioned by their ancestor of that level, so messages there stay in their partition
both ways; only one node in FAN^NEAR is ever sent over the network.
"""

from __future__ import annotations

import hashlib

from pyspark import RDD, StorageLevel
from pyspark.rdd import portable_hash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.durable import durable
from kinweave.functions.ordered import ranged

FAN = 8
#: Levels whose messages stay in a partition: subtrees of FAN^3 = 512 leaves.
NEAR = 3
#: Number of the tree over all roots.
TOP = -1
#: Leaves of a partition, about; more where the session has more shuffle partitions.
LEAVES = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(parts: list[bytes]) -> bytes:
    """SHA-256 of the digests as lowercase hex text."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as its UTF-8 byte count, a colon and its value, or as - if it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree_key, leaf and, where a row is to be tampered with, changed (the leaf of its text in lower case)."""
    plain = {f: F.col(f).cast("string") for f in FIELDS}
    lowered = plain | {"text": F.translate("text", UPPER, UPPER.lower())}
    touched = F.crc32(F.encode(plain["doc_id"], "UTF-8")) % 3 == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        # null first, then by bytes
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree_key"),
        leaf(list(plain.values())).alias("leaf"),
        F.when(touched, leaf(list(lowered.values()))).alias("changed"),
        F.monotonically_increasing_id().alias("copy"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """Each leaf with tree (its language's number), place in it and size of it.

    Leaves ascend by doc_id, null first; those of one doc_id by their digest. Places are counted in ranges, which are
    numbered on from each other, so a tree of any size is spread.
    """
    table = ranged(rows, "tree_key", "doc_id", "leaf", "copy")
    parts = durable(table.groupBy("tree_key", "range_no").agg(F.count(F.lit(1)).alias("part")))
    keys = parts.groupBy("tree_key").agg(F.sum("part").alias("size"))
    named = ranged(keys, "tree_key")
    ahead = named.groupBy("range_no").agg(F.count(F.lit(1)).alias("trees"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ahead = ahead.select("range_no", F.coalesce(F.sum("trees").over(before), F.lit(0)).alias("ahead"))
    number = F.row_number().over(Window.partitionBy("range_no").orderBy("tree_key")) - 1
    trees = named.withColumn("number", number).join(ahead, "range_no").select("tree_key", "size", (F.col("number") + F.col("ahead")).alias("tree"))
    earlier = Window.partitionBy("tree_key").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("part").over(earlier), F.lit(0))).drop("part").join(trees, "tree_key")
    own = F.row_number().over(Window.partitionBy("tree_key", "range_no").orderBy("doc_id", "leaf", "copy")) - 1
    found = table.withColumn("own", own).join(offsets, ["tree_key", "range_no"])
    return found.select("tree", (F.col("own") + F.col("offset")).alias("place"), "size", "doc_id", "leaf", "changed")


def home(key: tuple[int, int, int]) -> int:
    """Partitioning of nodes (tree, level, place): those below level NEAR lie with their ancestor of that level."""
    tree, level, place = key
    return portable_hash((tree, max(level, NEAR), place // FAN ** max(0, NEAR - level)))


def moved(messages: RDD, near: bool, partitions: int) -> RDD:
    """Messages at the partition of the node they are for; ``near`` ones are there already."""
    return messages if near else messages.partitionBy(partitions, home)


def meeting(a: RDD, b: RDD, partitions: int) -> RDD:
    """(key, (value in a, value in b)) of two RDDs that lie at home and have every key once; a key that only one has is an error."""

    def both(met):
        key, found = met[0], dict(met[1])
        if len(found) < 2:
            raise ValueError(f"node {key} lacks its own part or its message")
        return key, (found[0], found[1])

    tagged = a.mapValues(lambda v: (0, v)).union(b.mapValues(lambda v: (1, v)))
    return tagged.groupByKey(partitions, home).map(both, preservesPartitioning=True)


def up(nodes: RDD, level: int, partitions: int) -> RDD:
    """One superstep: (parent, (nodes on its level, its children's digests in order)) of ``level``'s nodes (key, (nodes on the level, digest)).

    Nodes that are alone on their level send nothing. A parent that does not hear from all its children is an error.
    """
    near = level < NEAR

    def send(node):
        (tree, _, place), (size, own) = node
        return (tree, level + 1, place // FAN), (size, place % FAN, own)

    def complete(parent):
        key, heard = parent[0], sorted((place, size, own) for size, place, own in parent[1])
        size = heard[0][1]
        if [x[0] for x in heard] != list(range(min(FAN, size - FAN * key[2]))):
            raise ValueError(f"node {key} did not hear from all its children once")
        return key, (-(-size // FAN), [x[2] for x in heard])

    sent = moved(nodes.filter(lambda node: node[1][0] > 1).map(send, preservesPartitioning=near), near, partitions)
    return sent.groupByKey(partitions, home).map(complete, preservesPartitioning=True)


def climb(nodes: RDD, size: int, partitions: int) -> tuple[list[RDD], RDD]:
    """Parents of each level from below, and the roots (key, digest). ``size``: leaves of the largest tree.

    Levels are kept for the way down. Should an executor be lost with its part, it is computed again from the leaves, which are a written table.
    """
    level, levels, roots = 0, [], []
    while True:
        roots.append(nodes.filter(lambda node: node[1][0] == 1).mapValues(lambda x: x[1]))
        if size <= 1:
            return levels, nodes.context.union(roots)
        parents = up(nodes, level, partitions).persist(StorageLevel.MEMORY_AND_DISK)
        levels.append(parents)
        nodes = parents.mapValues(lambda x: (x[0], digest(x[1])))
        level, size = level + 1, -(-size // FAN)


def descend(levels: list[RDD], starts: RDD, partitions: int) -> RDD:
    """(leaf, (root, path)) of all leaves below ``starts``, which are (key of a tree's root, (root, path)).

    A path is, from the node up, its place among its siblings and their digests in a row.
    """

    def send(met):
        (tree, level, place), (children, (root, path)) = met
        for i, _ in enumerate(children):
            yield (tree, level - 1, FAN * place + i), (root, ((i, b"".join(children[:i] + children[i + 1 :])), *path))

    starts = starts.partitionBy(partitions, home).persist(StorageLevel.MEMORY_AND_DISK)
    paths = None
    for level in range(len(levels), -1, -1):
        own = starts.filter(lambda x, level=level: x[0][1] == level)
        paths = own if paths is None else own.union(paths)
        if level:
            met, near = meeting(levels[level - 1].mapValues(lambda x: x[1]), paths, partitions), level <= NEAR
            paths = moved(met.flatMap(send, preservesPartitioning=near), near, partitions)
    return paths


def fold(own: bytes, path: tuple) -> bytes:
    """The root that follows from a leaf and the digests of the siblings on its way."""
    for place, others in path:
        cut = 32 * place
        own = hashlib.sha256((others[:cut].hex() + own.hex() + others[cut:].hex()).encode()).digest()
    return own


SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def build(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs(doc_id, source, lang, n_chars, text)`` and the check of every row against it.

    doc_id, leaf, subroot (of its language), root, proof_sha256 (of the siblings on the way up), folded_root and verified.
    Rows whose crc32(doc_id) is divisible by 3 are checked with their text in lower case (A-Z), all others as they are. A null
    field counts as -, an empty text as 0:. A null language is a tree of its own and the first; a null doc_id comes first in
    its tree and is not tampered with. Rows of one doc_id stand in the order of their digests, and repeated rows are
    leaves of their own. Texts of any length are hashed whole, outside Python. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    table = durable(placed(durable(leaves(docs))))
    sizes = table.groupBy("tree").agg(F.max("size").alias("size"))
    largest, trees, n = sizes.agg(F.max("size"), F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAVES))
    known = table.rdd.map(lambda r: ((r.tree, 0, r.place), (r.size, bytes(r.leaf), r.doc_id, r.changed and bytes(r.changed))))
    known = known.partitionBy(partitions, home).persist(StorageLevel.MEMORY_AND_DISK)
    levels, roots = climb(known.mapValues(lambda x: (x[0], x[1])), largest, partitions)
    # each language's root with its key, as a leaf of the tree over the roots
    above = roots.map(lambda x: ((TOP, 0, x[0][0]), x)).partitionBy(partitions, home).persist(StorageLevel.MEMORY_AND_DISK)
    tops, top = climb(above.mapValues(lambda x: (trees, x[1])), trees, partitions)
    ((key, root),) = top.collect()  # one digest
    ways = descend(tops, spark.sparkContext.parallelize([(key, (root, ()))], 1), partitions)
    starts = meeting(above, ways, partitions).map(lambda x: (x[1][0][0], (x[1][0][1], x[1][1][1])))

    def judge(met):
        (_, own, doc_id, changed), (subroot, path) = met[1]
        proof = hashlib.sha256("".join([others.hex() for _, others in path]).encode()).hexdigest()
        folded = fold(changed or own, path)
        return doc_id, own.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root

    judged = meeting(known, descend(levels, starts, partitions), partitions).map(judge)
    return spark.createDataFrame(judged, SCHEMA, verifySchema=False)


def op11_pregel_merkle(spark, sf_dir: str) -> DataFrame:
    return build(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS))


def _levels(name: str, first: str, depth: int) -> str:
    """SQL of the levels above ``first`` (tree, place, d): nodes name0, name1, ... with what stands left and right of each in its run."""
    sql = ""
    for level in range(depth + 1):
        rows = f"SELECT tree, place, d, count(*) OVER (PARTITION BY tree) AS n FROM {first}"
        if level:
            rows = f"""SELECT tree, place // 8 AS place, CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY place)) END AS d,
  count(*) OVER (PARTITION BY tree) AS n FROM {name}{level - 1} GROUP BY tree, place // 8"""
        part = "OVER (PARTITION BY tree, place // 8 ORDER BY place ROWS BETWEEN"
        sql += f""", {name}{level} AS (SELECT *, coalesce(string_agg(d, '') {part} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
  coalesce(string_agg(d, '') {part} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM ({rows}))"""
    return sql


def _folds(name: str, first: str, nodes: str, depth: int) -> str:
    """SQL of the ways up from ``first`` (doc_id, leaf, tree, place, cur, proof) through the levels of `_levels`."""
    sql, last = "", first
    for level in range(depth):
        sql += f""", {name}{level} AS (SELECT f.doc_id, f.leaf, f.tree, f.place // 8 AS place, CASE WHEN n = 1 THEN cur ELSE sha256(lft || cur || rgt) END AS cur,
  CASE WHEN n = 1 THEN proof ELSE proof || lft || rgt END AS proof FROM {last} f JOIN {nodes}{level} s ON f.tree = s.tree AND f.place = s.place)"""
        last = f"{name}{level}"
    return sql


_DEPTH = 6


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(generate_series(1, length(doc_id::VARCHAR)), lambda i: [ascii(substr(doc_id::VARCHAR, i::INT, 1))::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, e: xor(xor(c, e) >> 1, 3988292384::UBIGINT * (xor(c, e) & 1::UBIGINT))), 4294967295::UBIGINT)"""
ORACLE = (
    f"""WITH hashed AS (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf, {_CRC} % 3 = 0 AS touched,
  {_leaf_sql(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} AS lowered FROM documents),
trees AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) AS tree FROM (SELECT DISTINCT lang FROM documents)),
own AS (SELECT doc_id, tree, leaf, CASE WHEN touched THEN lowered ELSE leaf END AS cur, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM hashed JOIN trees ON hashed.lang IS NOT DISTINCT FROM trees.lang), firsts AS (SELECT tree, place, leaf AS d FROM own)"""
    + _levels("a", "firsts", _DEPTH)
    + f", roots AS (SELECT 0 AS tree, tree - 1 AS place, d FROM a{_DEPTH})"
    + _levels("b", "roots", _DEPTH)
    + ", ways AS (SELECT doc_id, leaf, tree, place, cur, '' AS proof FROM own)"
    + _folds("f", "ways", "a", _DEPTH)
    + f", upper AS (SELECT doc_id, leaf, tree, cur, proof, d AS subroot FROM f{_DEPTH - 1} JOIN a{_DEPTH} USING (tree)), ways2 AS (SELECT doc_id, leaf || subroot AS leaf, 0 AS tree, tree - 1 AS place, cur, proof FROM upper)"
    + _folds("g", "ways2", "b", _DEPTH)
    + f""" SELECT doc_id, leaf[1:64] AS leaf, leaf[65:] AS subroot, d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = d AS verified FROM g{_DEPTH - 1}, b{_DEPTH}"""
)
