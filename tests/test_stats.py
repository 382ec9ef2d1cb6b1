import math
import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions.columns import cosine, log_stats, uniform
from kinweave.functions.ordered import following_min, ranged, running_sum
from kinweave.operators import stats


def test_bh_by_hand(spark):
    p = [0.01, 0.04, 0.04, 0.2, 0.9, 1e-16]
    want = [0.03, 0.06, 0.06, 0.24, 0.9, 6e-16]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(p)] + [("b", 9, 0.5)], "g string, i int, pval double")
    rows = {(r.g, r.i): r.fdr for r in stats.benjamini_hochberg(df, ["g"], "fdr").collect()}
    assert all(math.isclose(rows["a", i], w, rel_tol=1e-12) for i, w in enumerate(want))
    assert rows["b", 9] == 0.5
    whole = stats.benjamini_hochberg(df.where("g = 'a'"), [], "fdr")
    assert math.isclose(min(r.fdr for r in whole.collect()), 6e-16, rel_tol=1e-12)
    assert stats.benjamini_hochberg(df.limit(0), ["g"], "fdr").count() == 0


def test_bh_on_random_values(spark):
    rng = random.Random(1)
    p = [round(rng.random(), 2) for _ in range(300)]
    order = sorted(range(300), key=lambda i: p[i])
    want, least = [0.0] * 300, 1.0
    for rank in range(300, 0, -1):
        least = min(least, p[order[rank - 1]] * 300 / rank)
        want[order[rank - 1]] = least
    df = spark.createDataFrame(list(enumerate(p)), "i int, pval double").repartition(7)
    got = {r.i: r.fdr for r in stats.benjamini_hochberg(df, [], "fdr").collect()}
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in range(300))


def test_empirical_p_by_hand(spark):
    null = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.2, 0.5, float("nan"), None)], "similarity double")
    observed = spark.createDataFrame([(0.05,), (0.2,), (0.5,), (0.9,), (float("nan"),)], "similarity double")
    got = [r.pval for r in stats.empirical_p(observed, null).orderBy(F.isnan("similarity"), "similarity").collect()]
    assert got == [1.0, 0.75, 0.25, 1e-16, 1.0]
    with pytest.raises(ValueError):
        stats.empirical_p(observed, null.limit(0))


def test_columns_of_any_name_stay(spark):
    null = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.2, 0.5)], "similarity double")
    observed = spark.createDataFrame([(0.2, "v", 7, "r"), (0.9, "w", 8, "s")], "similarity double, value string, rank int, inside string")
    got = sorted(map(tuple, stats.empirical_p(observed, null).select("similarity", "value", "rank", "inside", "pval").collect()))
    assert got == [(0.2, "v", 7, "r", 0.75), (0.9, "w", 8, "s", 1e-16)]
    table = spark.createDataFrame([(i, 1, "a", "b", "c") for i in range(9)], "i int, one int, inside string, part string, offset string")
    made = running_sum(ranged(table, "i"), [], "i", "one", "upto").collect()
    assert sorted((r.i, r.upto, r.inside, r.part, r.offset) for r in made) == [(i, i + 1, "a", "b", "c") for i in range(9)]
    made = following_min(ranged(table, "i"), [], "i", "i", "least").collect()
    assert sorted((r.i, r["least"], r.inside, r.offset) for r in made) == [(i, i, "a", "c") for i in range(9)]


def test_following_min_has_no_frame_to_the_last_row(spark):
    """Such a frame is computed anew for each row: quadratic in the rows of a range."""
    table = ranged(spark.range(1, 1001).select(F.col("id").alias("i"), (F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 1009).alias("v")), "g", "i")
    made = following_min(table, ["g"], "i", "v", "least")
    assert "unboundedfollowing" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    rows = sorted((r.g, r.i, r.v, r.least) for r in made.collect())
    assert all(least == min(v for h, j, v, _ in rows if h == g and j >= i) for g, i, _, least in rows)


def test_empirical_p_extremes(spark):
    null = spark.range(1000).select((F.col("id") / 1000).alias("similarity"))
    observed = spark.createDataFrame([(0.999,), (0.001,), (0.5,)], "similarity double")
    low, mid, high = (r.pval for r in stats.empirical_p(observed, null).orderBy(F.desc("similarity")).collect())
    assert low < 0.01 and high > 0.99 and abs(mid - 0.5) < 0.01


def test_log_stats_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.02), ("a", 0.04), ("b", 0.3)], "g string, v double")
    rows = {r.g: r for r in df.groupBy("g").agg(*log_stats("v", "v")).collect()}
    assert abs(rows["a"].avg_v - 0.02) < 1e-9
    assert abs(rows["a"].v_ci_lower - 0.009128) < 1e-6 and abs(rows["a"].v_ci_upper - 0.043821) < 1e-6
    assert abs(rows["b"].avg_v - 0.3) < 1e-12 and rows["b"].v_ci_lower == rows["b"].v_ci_upper == 1e-16


def test_cosine_and_uniform(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    x, y = (r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect())
    assert abs(x - 2**-0.5) < 1e-12 and math.isnan(y)
    u = [r[0] for r in spark.range(2000).select(uniform(1, F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 2000 - 0.5) < 0.03


def test_association_statistics(spark):
    embeddings = spark.createDataFrame(
        [(r, n, v) for r in (1, 2) for n, v in (("g", [1.0, 0.0]), ("p", [1.0, 0.1 * r]), ("q", [0.0, 1.0]))], "rep int, node string, embedding array<float>"
    )
    pairs = spark.createDataFrame([("g", "p"), ("g", "q"), ("g", "p"), ("g", "unknown")], "gene string, pathway string")
    null = spark.range(100).select((F.col("id") / 100).alias("similarity"))
    got = {r.pathway: r for r in stats.association_statistics(pairs, embeddings, null).collect()}
    assert tuple(stats.association_statistics(pairs, embeddings, null).columns) == stats.STATISTICS
    assert set(got) == {"p", "q"} and got["p"].avg_pval < 0.05 < got["q"].avg_pval
    one = stats.association_statistics(pairs, embeddings.where("rep = 1"), null).first()
    assert one.sem_sim == 0 and one.pval_ci_lower == 1e-16


def test_cluster_means_equal_pair_means(spark):
    rng = random.Random(4)
    rows = [(str(i), [rng.gauss(0, 1) for _ in range(5)], i % 3) for i in range(30)] + [("z", [0.0] * 5, 1)]
    df = spark.createDataFrame(rows, "node string, embedding array<double>, cluster int")
    got = stats.evaluate_clusters(df.select("node", "embedding"), df.select("node", "cluster")).first()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    same, other = [], []
    for i in range(30):
        for j in range(i):
            (same if rows[i][2] == rows[j][2] else other).append(cos(rows[i][1], rows[j][1]))
    assert abs(got.within_mean - sum(same) / len(same)) < 1e-9 and abs(got.between_mean - sum(other) / len(other)) < 1e-9


def test_group_cosine_is_pair_cosine_of_all_pairs_of_a_group(spark):
    rng = random.Random(3)
    vectors = spark.createDataFrame([(r, f"n{i}", [rng.gauss(0, 1) for _ in range(5)]) for r in (1, 2) for i in range(60)], "rep int, node string, embedding array<double>")
    ends = spark.range(60).select(F.concat(F.lit("n"), F.col("id")).alias("node"), (F.col("id") % 3).alias("group"), (F.col("id") % 5 == 0).alias("gene"))
    genes, pathways = ends.where("gene").select(F.col("node").alias("gene"), "group"), ends.where("NOT gene").select(F.col("node").alias("pathway"), "group")
    found = stats.group_cosine(genes, pathways, vectors)
    wanted = stats.pair_cosine(genes.join(pathways, "group"), vectors)
    rows = lambda df: sorted((r.rep, r.gene, r.pathway, round(r.similarity, 12)) for r in df.collect())
    assert rows(found) == rows(wanted) and found.count() == 2 * 12 * 16


def test_bh_in_groups_equals_bh_over_ranges(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([0.0, 0.01, 0.01, rng.random()])) for g in range(4) for i in range(150)]
    df = spark.createDataFrame(rows, "g int, i int, pval double")
    told = lambda: {(r.g, r.i): r.fdr for r in stats.benjamini_hochberg(df, ["g"], "fdr").collect()}
    grouped = told()
    monkeypatch.setattr(stats, "IN_ONE", 0)
    assert grouped == pytest.approx(told()) and len(grouped) == 600
