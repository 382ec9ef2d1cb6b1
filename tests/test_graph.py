import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinweave.functions.durable import durable
from kinweave.operators import components, graph, walks
from kinweave.operators.components import connected_components


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "from string, to string")


def test_prepare_edges(spark):
    df = spark.createDataFrame([("1", "2", 0.5), ("2", "1", 0.9), ("3", "3", 1.0)], "from string, to string, weight double")
    assert sorted(map(tuple, graph.prepare_edges(df).collect())) == [("1", "2", 0.9), ("3", "3", 1.0)]
    assert graph.prepare_edges(df, directed=True).count() == 3
    assert {r.weight for r in graph.prepare_edges(df.drop("weight")).collect()} == {1.0}


def test_adjacency_and_degree(spark):
    df = edges(spark, [("a", "b"), ("b", "a"), ("a", "a"), ("b", "c")])
    assert sorted(map(tuple, graph.adjacency(df).collect())) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    assert {r.node: r.degree for r in graph.node_degree(df).collect()} == {"a": 4, "b": 3, "c": 1}


def test_largest_component(spark):
    df = edges(spark, [("0", "1"), ("1", "2"), ("3", "4"), ("5", "5")])
    assert sorted(map(tuple, graph.largest_component(df).collect())) == [("0", "1"), ("1", "2")]
    assert {r.node: r.component for r in graph.components(df).collect()}["5"] == "5"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + i) for i in range(40)]
    pairs += [(rng.randrange(1000), rng.randrange(1000)) for _ in range(300)]
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs + [(None, 1)], "a long, b long")).collect()}
    assert all(find(n) == c for n, c in got.items())
    assert set(got) == {n for a, b in pairs if a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_configuration_model(spark):
    rng = random.Random(5)
    pairs = [("hub", f"n{i}") for i in range(12)] + [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(150)]
    df = edges(spark, pairs)
    one = sorted(map(tuple, graph.configuration_model(df, 1).collect()))
    assert one == sorted(map(tuple, graph.configuration_model(df.repartition(7), 1).collect()))
    assert one != sorted(map(tuple, graph.configuration_model(df, 2).collect()))
    assert all(a < b for a, b, _ in one) and len({(a, b) for a, b, _ in one}) == len(one)
    assert len(one) >= 0.85 * len(pairs)
    before = {r.node: r.degree for r in graph.node_degree(df).collect()}
    for r in graph.node_degree(graph.configuration_model(df, 1)).collect():
        assert r.degree <= before[r.node]
    assert graph.configuration_model(df.limit(0), 1).count() == 0


def test_walks_follow_links(spark):
    df = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")])
    near = {(r.node, r.neighbour) for r in graph.neighbours(df).collect()}
    found = walks.random_walks(graph.neighbours(df), 3, 7, p=0.25, q=4.0, seed=9).collect()
    assert len(found) == 3 * 6 and {len(r.path) for r in found} == {7}
    assert all((a, b) in near for r in found for a, b in zip(r.path, r.path[1:], strict=False))
    again = walks.random_walks(graph.neighbours(df.repartition(5)), 3, 7, p=0.25, q=4.0, seed=9).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    directed = walks.random_walks(graph.neighbours(df, directed=True), 1, 5).collect()
    assert {tuple(r.path) for r in directed if r.start == "x"} == {("x", "y")}


def test_return_bias(spark):
    df = graph.neighbours(edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]))
    back = lambda p: df.transform(lambda x: walks.random_walks(x, 60, 3, p=p, seed=3)).where(F.get("path", F.lit(0)) == F.get("path", F.lit(2))).count()
    assert back(0.05) > 200 > 40 > back(20.0)


#: Upper limits of chi-square by degrees of freedom at a chance of one in a thousand.
CHI = {5: 20.5, 12: 32.9}


@pytest.mark.parametrize("p,q", [(0.4, 2.5), (3.0, 0.5)])
def test_draws_follow_weights_and_bias(spark, p, q):
    weights = {("a", "b"): 1.0, ("b", "c"): 5.0, ("a", "c"): 0.3, ("b", "d"): 2.5, ("d", "e"): 1.0}
    weights |= {(b, a): w for (a, b), w in weights.items()}
    near = {n: {b: w for (a, b), w in weights.items() if a == n} for n in "abcde"}
    links = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "node string, neighbour string, weight double")
    paths = Counter(tuple(r.path) for r in walks.random_walks(links, 3000, 3, p=p, q=q, seed=5).collect())
    assert sum(paths.values()) == 15_000 and {len(x) for x in paths} == {3}
    first, chi, free = Counter(), 0.0, 0
    for (a, b, _), n in paths.items():
        first[a, b] += n
    for a in near:
        for b, w in near[a].items():
            expected = 3000 * w / sum(near[a].values())
            chi += (first[a, b] - expected) ** 2 / expected
        free += len(near[a]) - 1
    assert chi < CHI[free]
    chi, free = 0.0, 0
    for a, b in first:
        bias = {c: w * (1 / p if c == a else 1 if c in near[a] else 1 / q) for c, w in near[b].items()}
        for c, w in bias.items():
            expected = first[a, b] * w / sum(bias.values())
            chi += (paths[a, b, c] - expected) ** 2 / expected
        free += len(bias) - 1
    assert chi < CHI[free]


def test_a_hub_makes_no_more_rows(spark):
    links = spark.createDataFrame([("hub", f"n{i}", 1.0) for i in range(2000)], "node string, neighbour string, weight double")
    both = links.union(links.select("neighbour", "node", "weight")).selectExpr("0L AS net", "*")
    found = walks.transitions(both)
    assert found.flat and found.slots.count() == 4000 and found.nodes.where("node = 'hub'").first().board[0].n == 2000
    state = found.nodes.selectExpr("1L AS graph", "net", "node AS start", "1 AS walk_no", "struct(node, board, mass) AS at")
    none = F.lit(None).cast(state.schema["at"].dataType)
    state = state.select("graph", "start", "walk_no", "net", "at", none.alias("was"), F.lit(0.0).alias("taken"), F.lit(0.0).alias("back"), F.array("start").alias("trace"))
    tried = walks._round(state, found, 0.5, 2.0, 1, 0, walks.TRIALS)
    assert tried.count() == 2001
    ends = [r.path[-1] for r in walks.random_walks(links.union(links.select("neighbour", "node", "weight")), 3, 2).where("start = 'hub'").collect()]
    assert len(ends) == 3 and all(e.startswith("n") for e in ends)


def test_walks_share_jobs_and_stay_the_same(spark):
    links = graph.neighbours(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")]))
    nets = links.selectExpr("0L AS net", "*").union(links.where("node <> 'x' AND neighbour <> 'x'").selectExpr("1L AS net", "*"))
    found = walks.walks_of_graphs(nets, [(9, 0), (10, 0), (11, 1)], 2, 6, p=0.5, q=2.0)
    for seed, own in ((9, links), (10, links), (11, links.where("node <> 'x' AND neighbour <> 'x'"))):
        alone = walks.random_walks(own, 2, 6, p=0.5, q=2.0, seed=seed)
        assert sorted(map(tuple, found.where(f"graph = {seed}").drop("graph").collect())) == sorted(map(tuple, alone.collect()))


def test_dead_ends_and_bad_links(spark):
    rows = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "c", 0.0), ("a", None, 1.0), (None, "a", 1.0), ("a", "z", -1.0), ("b", "z", float("nan")), ("b", "y", None)]
    links = spark.createDataFrame(rows, "node string, neighbour string, weight double")
    for p in (1.0, 0.5):
        assert {tuple(r.path) for r in walks.random_walks(links, 2, 6, p=p).collect()} == {("a", "b", "c"), ("b", "c")}
    assert {tuple(r.path) for r in walks.random_walks(links, 1, 1).collect()} == {("a",), ("b",)}
    assert walks.random_walks(links.limit(0), 2, 5).count() == 0


def test_configuration_models_and_components_of_several_graphs(spark):
    rng = random.Random(8)
    df = edges(spark, [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)])
    both = graph.configuration_models(df, [1, 2])
    largest = graph.largest_components(both)
    for seed in (1, 2):
        own = graph.configuration_model(df, seed)
        assert sorted(map(tuple, both.where(f"graph = {seed}").drop("graph").collect())) == sorted(map(tuple, own.collect()))
        got = sorted(tuple(r) for r in largest.where(f"graph = {seed}").select("from", "to").collect())
        assert got == sorted(map(tuple, graph.largest_component(own.select("from", "to")).collect()))


def test_first_of(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "z", 5)], "k string, v string, priority int")
    assert sorted(map(tuple, graph.first_of(df, ["k"], "priority").collect())) == [("a", "y", 1), ("b", "z", 5)]


def test_stubs_of_a_hub(spark):
    df = spark.range(10000).selectExpr("'hub' AS `from`", "cast(id AS string) AS `to`")
    found = graph.stubs(df).where("node = 'hub'").agg({"stub": "max", "*": "count"}).first()
    assert set(found) == {10000} and graph.stubs(df).count() == 20000


def test_a_draw_reads_rows_of_many_links(spark, monkeypatch):
    """A row for each link used to be joined in every round of draws. The walks are the same for any size of the chunks."""
    links = spark.createDataFrame([(f"n{i}", f"n{j}", 1.0 + i % 3) for i in range(40) for j in range(40) if i != j and (i * j) % 3], "node string, neighbour string, weight double")
    found = walks.transitions(links.selectExpr("0L AS net", "*"))
    assert found.chunks.count() < found.slots.count() / 4
    told = lambda: sorted((r.start, r.walk_no, tuple(r.path)) for r in walks.random_walks(links, 2, 4, p=0.5, q=2.0).collect())
    first = told()
    monkeypatch.setattr(walks, "CHUNK", 3)
    assert first == told()


def test_edges_are_passed_over_once_a_level_not_in_each_contraction(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(f"C{rng.randrange(300)}", f"S{rng.randrange(40)}") for _ in range(6000)]
    written = []
    keep = lambda df: written.append(durable(df)) or written[-1]
    monkeypatch.setattr(components, "durable", keep)
    got = connected_components(spark.createDataFrame(pairs, "a string, b string"))
    assert {r.component for r in got.collect()} == {min(a for a, _ in pairs)} and got.count() == len({x for p in pairs for x in p})
    assert sum(t.count() > 1000 for t in written) == 1  # the edges themselves; every round wrote them before


def test_places_take_one_shuffle_and_no_window_of_the_rows(spark):
    from kinweave.functions.ordered import placed_in_order

    rows = [(i % 3, f"n{i % 50}", (i * 7919) % 101 / 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "g long, node string, u double")
    placed = placed_in_order(df, ["g"], ["u", "node"], ["node"], "place", 7)
    got = placed.collect()
    assert placed.columns == ["g", "node", "place"]
    for g in range(3):
        assert sorted(r.place for r in got if r.g == g) == list(range(sum(x[0] == g for x in rows)))
    keyed = placed_in_order(df, ["g"], ["u", "node"], ["u"], "place", 7).orderBy("g", "place").collect()
    assert [(r.g, r.u) for r in keyed] == [(g, u) for g, _, u in sorted(rows, key=lambda x: (x[0], x[2], x[1]))]
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and "Aggregate" in plan.split("Window ")[1]  # of one row a range
