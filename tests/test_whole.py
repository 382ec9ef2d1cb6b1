"""The graph queries see every line, not a slice."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three components."""
    d = str(tmp_path_factory.mktemp("whole"))
    lines = [(k, 5 + 10 * (k % 3), n, 0.05, "R", "F") for k in range(1, 10) for n in (1, 2)] + [(50, 11, 2, 0.05, "N", "F"), (51, 11, 1, 0.05, "N", "F"), (52, 12, 3, 0.05, "N", "F")]
    orders = [(k, 100 + k // 3, "1-URGENT") for k in range(1, 10)] + [(50, 200, "5-LOW"), (51, 201, "5-LOW"), (52, 202, "5-LOW")]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    e = spark.range(40).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(60)), lambda x: F.sin(x * (F.col("id") + 1)).cast("float")).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    e.write.parquet(f"{d}/embeddings.parquet")
    customer = dict((k, c) for k, c, _ in orders)
    return d, {(f"C{customer[k]}", f"S{s}") for k, s, *_ in lines}, {(s, k) for k, s, *_ in lines}


def brute(edges):
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_graph_queries(spark, tables):
    d, edges, _ = tables
    got = lambda name: entry.queries()[name](spark, d).collect()
    assert {tuple(r) for r in got("adjacency")} == edges | {(b, a) for a, b in edges}
    label = brute(edges)
    assert len(set(label.values())) == 3
    assert {r.node: r.component for r in got("components")} == label
    sizes = {c: sum(x == c for x in label.values()) for c in label.values()}
    largest = min(sizes, key=lambda c: (-sizes[c], c))
    assert {tuple(r) for r in got("largest_component")} == {(a, b) for a, b in edges if label[a] == largest}
    walks = got("random_walks")
    assert {(r.start, r.walk_no) for r in walks} == {(n, w) for n in label for w in (1, 2)}
    assert all((a, b) in edges or (b, a) in edges for r in walks for a, b in zip(r.path.split(), r.path.split()[1:], strict=False))
    model, degree = got("configuration_model"), lambda pairs, n: sum((a == n) + (b == n) for a, b in pairs)
    pairs = [(r["from"], r["to"]) for r in model]
    assert pairs and all(degree(pairs, n) <= degree(edges, n) for n in label)


def test_degrees_of_all_suppliers(spark, tables):
    d, _, ends = tables
    got = {r.gene: r.degree for r in entry.queries()["enrichment_ratio"](spark, d).collect()}
    tested = [v for v in range(0, 40, 5) if any(w % 5 for w in range(v + 8, min(40, v + 31)))]  # genes with pathways behind them
    assert len(tested) == 7 and got == {f"V{v}": 2 * sum(s == v for s, _ in ends) for v in tested}
