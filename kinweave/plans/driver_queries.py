"""The registered queries over the driver's tables, with their DuckDB oracles.

Stand-ins: customers and suppliers are genes, nations and regions pathways. Customer to supplier through orders
is an interaction, to nation an annotation; nation to region is the hierarchy. Slices of the embeddings are
replicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.columns import cosine, log_stats
from kinweave.functions.dealing import dealt
from kinweave.functions.durable import durable, shared_folder
from kinweave.functions.stages import Stages
from kinweave.operators import embed, graph, network, stats, walks
from kinweave.params import SyntheticParams, association_params, node2vec_params
from kinweave.plans import report, synthetic
from kinweave.plans.analysis import Analysis, node2vec
from kinweave.sources import catalog, ingest

QUERIES: dict = {}
ORACLES: dict = {}


def registrar(queries: dict, oracles: dict):
    """A decorator that registers a function under its name, with its oracle if there is one."""

    def query(sql: str | None = None):
        def register(function):
            queries[function.__name__] = function
            if sql:
                oracles[function.__name__] = sql
            return function

        return register

    return query


query = registrar(QUERIES, ORACLES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summing does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def named(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


# ---------------------------------------------------------------- stand-in tables


def n_lines(spark, d) -> int:
    """Order lines, from the footers of their files."""
    return read(spark, d, "lineitem").count()


def trade(spark, d) -> DataFrame:
    """Orders with their lines: from (customer), to (supplier), and the line's columns."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_linestatus")
    orders, rows = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), n_lines(spark, d)
    both = dealt(lines, rows, "l_orderkey").join(dealt(orders, rows, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("*", named("C", "o_custkey").alias("from"), named("S", "l_suppkey").alias("to"))


def interactions(spark, d) -> DataFrame:
    """from, to, score, physical."""
    score = F.sum(F.round(F.col("l_discount") * 100).cast("long")) / (F.count(F.lit(1)) * F.lit(10.0))
    return dealt(trade(spark, d), n_lines(spark, d), "from", "to").groupBy("from", "to").agg(score.alias("score"), F.bool_or(F.col("l_returnflag") == "R").alias("physical"))


def annotations(spark, d) -> DataFrame:
    customers = read(spark, d, "customer").select(named("C", "c_custkey").alias("from"), named("N", "c_nationkey").alias("to"))
    return customers.union(read(spark, d, "supplier").select(named("S", "s_suppkey"), named("N", "s_nationkey")))


def hierarchy(spark, d) -> DataFrame:
    return read(spark, d, "nation").select(named("N", "n_nationkey").alias("from"), named("R", "n_regionkey").alias("to"))


def bundle(spark, d) -> network.EdgeBundle:
    return network.EdgeBundle(interactions(spark, d), annotations(spark, d), hierarchy(spark, d))


def some_genes(spark, d) -> DataFrame:
    """Every third customer, every second supplier, and two that don't exist."""
    customers = read(spark, d, "customer").where("c_custkey % 3 = 0").select(named("C", "c_custkey").alias("gene"))
    suppliers = read(spark, d, "supplier").where("s_suppkey % 2 = 0").select(named("S", "s_suppkey"))
    return customers.union(suppliers).union(spark.createDataFrame([("X1",), ("X2",)], "gene string"))


def whole(spark, d) -> DataFrame:
    """The interaction graph with all its edges."""
    return interactions(spark, d).select("from", "to")


_TRADE = """trade AS (SELECT 'C' || o_custkey AS "from", 'S' || l_suppkey AS "to", l_orderkey, l_linenumber, l_discount, l_returnflag, l_linestatus, o_orderpriority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_INTER = _TRADE + """, inter AS (SELECT "from", "to", sum(round(l_discount * 100)::BIGINT)::DOUBLE / (count(*) * 10::DOUBLE) AS score, bool_or(l_returnflag = 'R') AS physical
  FROM trade GROUP BY 1, 2)"""
_NET = _INTER + """, ann AS (SELECT 'C' || c_custkey AS "from", 'N' || c_nationkey AS "to" FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier),
  hier AS (SELECT 'N' || n_nationkey AS "from", 'R' || n_regionkey AS "to" FROM nation),
  net AS (SELECT "from", "to", 'interaction' AS type FROM inter UNION SELECT "from", "to", 'part_of' FROM ann UNION SELECT "from", "to", 'hierarchy' FROM hier)"""
_GENES = """genes AS (SELECT 'C' || c_custkey AS gene FROM customer WHERE c_custkey % 3 = 0 UNION SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 UNION VALUES ('X1'), ('X2'))"""
_FILTERED = _NET + ", " + _GENES + """, p AS (SELECT "from", "to" FROM inter WHERE "from" IN (FROM genes) AND "to" IN (FROM genes)), a AS (SELECT * FROM ann WHERE "from" IN (FROM genes)),
  f AS (SELECT "from", "to", 'interaction' AS type FROM p UNION SELECT "from", "to", 'part_of' FROM a UNION SELECT "from", "to", 'hierarchy' FROM hier)"""
_WHOLE = _TRADE + """, links AS (SELECT DISTINCT "from", "to" FROM trade)"""


def _u(*parts: str) -> str:
    """The hash uniform in SQL."""
    return "(('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 13))::BIGINT / pow(2.0, 52))"


hash_uniform = _u

# ---------------------------------------------------------------- tables and ingest


@query("SELECT DISTINCT 'S' || s_suppkey AS ensembl_id, s_name AS symbol, 'n' || s_nationkey AS biotype FROM supplier")
def gene_dim_distinct(spark, d):
    s = read(spark, d, "supplier")
    targets = s.select(named("S", "s_suppkey").alias("id"), F.col("s_name").alias("approvedSymbol"), named("n", "s_nationkey").alias("biotype"))
    return ingest.gene_main(targets.union(targets))


@query(f'WITH {_INTER} SELECT "from", "to", score FROM inter WHERE score >= 0.6')
def score_threshold(spark, d):
    return catalog.scored(interactions(spark, d).select("from", "to", "score"), "score", 0.6)


@query(f'WITH {_INTER} SELECT "from", "to", score FROM inter WHERE score >= 0.6 AND physical')
def score_and_flag(spark, d):
    return catalog.scored(interactions(spark, d), "score", 0.6).where("physical").select("from", "to", "score")


@query("""SELECT 'C' || o_custkey AS "from", 'O' || o_orderkey AS "to", o_orderpriority AS relationship FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def relationship_in(spark, d):
    o = read(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return o.select(named("C", "o_custkey").alias("from"), named("O", "o_orderkey").alias("to"), F.col("o_orderpriority").alias("relationship"))


@query("""SELECT * FROM (SELECT 'ENSG' || CASE WHEN l_suppkey % 7 = 0 THEN 'GOG' ELSE '' END || l_suppkey AS "from", CASE WHEN l_partkey % 5 = 0 THEN 'MUS' ELSE 'ENSG' END || l_partkey AS "to" FROM lineitem)
WHERE contains("from", 'ENSG') AND contains("to", 'ENSG') AND NOT contains("from", 'ENSGGOG') AND NOT contains("to", 'ENSGGOG')""")
def name_contains_not(spark, d):
    odd = F.when(F.col("l_suppkey") % 7 == 0, "GOG").otherwise("")
    a = F.concat(F.lit("ENSG"), odd, F.col("l_suppkey").cast("string"))
    b = F.concat(F.when(F.col("l_partkey") % 5 == 0, "MUS").otherwise("ENSG"), F.col("l_partkey").cast("string"))
    return ingest.human_edges(read(spark, d, "lineitem").select(a.alias("from"), b.alias("to")))


@query("""SELECT vec_id AS "from", unnest(embedding)::DOUBLE AS "to" FROM embeddings""")
def unnest_list(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.struct(x.cast("double").alias("value"))).alias("items"))
    return ingest.unnested(e, "vec_id", "items", "value")


@query("""SELECT 'N' || n_nationkey AS "from", 'R' || n_regionkey AS "to", 'child_of' AS relationship FROM nation
UNION ALL SELECT 'N' || n_nationkey, unnest(['R' || n_regionkey, 'W']), 'descendant_of' FROM nation UNION ALL SELECT 'N' || n_nationkey, 'X' || n_nationkey, 'parent_of' FROM nation WHERE n_nationkey % 2 = 0""")
def unpivot_relations(spark, d):
    up, none = named("R", "n_regionkey"), F.array().cast("array<string>")
    n = read(spark, d, "nation").select(
        named("N", "n_nationkey").alias("id"), F.array(up).alias("parents"), F.array(up, F.lit("W")).alias("ancestors"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(named("X", "n_nationkey"))).alias("children"), none.alias("descendants"),
    )
    return ingest.unpivoted_relations(n)


@query("""SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events""")
def nested_expand(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("interactionResources"))
    return ingest.expanded(e)


@query("""WITH ids AS (SELECT c_name AS symbol, min('C' || c_custkey) AS id FROM customer WHERE c_name IS NOT NULL GROUP BY 1),
raw AS (SELECT a.c_name AS a, o_orderpriority AS type, b.c_name AS b FROM orders JOIN customer a ON o_custkey = a.c_custkey LEFT JOIN customer b ON b.c_custkey = o_orderkey % 200)
SELECT DISTINCT x.id AS "from", y.id AS "to", type FROM raw JOIN ids x ON a = x.symbol JOIN ids y ON b = y.symbol""")
def symbol_translate(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    o = read(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 200).alias("other"), F.col("o_orderpriority").alias("INTERACTION_TYPE"))
    raw = o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("PARTICIPANT_A")), "o_custkey")
    raw = raw.join(c.select(F.col("c_custkey").alias("other"), F.col("c_name").alias("PARTICIPANT_B")), "other", "left")
    return ingest.interactions_pc(raw, c.select(named("C", "c_custkey").alias("ensembl_id"), F.col("c_name").alias("symbol")))


@query("""SELECT 'ENSG' || l_suppkey AS "from", 'ENSG' || l_partkey % 50 AS "to", l_discount AS intact_score, bool_or(l_returnflag = 'R') AS physical_association
FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2, 3""")
def any_type_contains(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "physical association (test)").otherwise("colocalization")
    base = F.when(F.col("l_linestatus") == "F", "intact").otherwise("string")
    rows = read(spark, d, "lineitem").select(
        named("ENSG", "l_suppkey").alias("targetA"), F.concat(F.lit("ENSG"), (F.col("l_partkey") % 50).cast("string")).alias("targetB"),
        F.col("l_discount").alias("interactionScore"), kind.alias("interactionTypeShortName"), F.struct(base.alias("sourceDatabase")).alias("interactionResources"),
    )
    return ingest.interactions_intact(rows)


@query(f"""WITH {_TRADE} SELECT "from", "to", bool_or(l_returnflag = 'A') AS "A", bool_or(l_returnflag = 'N') AS "N", bool_or(l_returnflag = 'R') AS "R" FROM trade GROUP BY 1, 2""")
def combined_pivot(spark, d):
    return ingest.source_flags(trade(spark, d).select("from", "to", F.col("l_returnflag").alias("source")), ("A", "N", "R"))


# ---------------------------------------------------------------- networks


@query(f'WITH {_NET} SELECT "from", "to", type FROM net')
def typed_network(spark, d):
    return bundle(spark, d).network()


@query(f'WITH {_FILTERED} SELECT "from", "to", type FROM f')
def filtered_network(spark, d):
    return bundle(spark, d).filtered(some_genes(spark, d), warn=False).graph


@query(f"""WITH {_FILTERED}, r AS (SELECT "from" AS name FROM p UNION SELECT "to" FROM p UNION SELECT "from" FROM a)
SELECT 'gene' AS kind, name FROM r UNION ALL SELECT 'missing', gene FROM genes WHERE gene NOT IN (FROM r)
UNION ALL SELECT 'pathway', x FROM (SELECT "to" AS x FROM a UNION SELECT "from" FROM hier UNION SELECT "to" FROM hier)""")
def represented_and_missing(spark, d):
    f = bundle(spark, d).filtered(some_genes(spark, d), warn=False)
    kind = lambda df, name, what: df.select(F.lit(what).alias("kind"), F.col(name).alias("name"))
    return kind(f.represented_genes, "gene", "gene").union(kind(f.missing_genes, "gene", "missing")).union(kind(f.represented_pathways, "pathway", "pathway"))


@query(f"""WITH {_NET} SELECT (SELECT count(*) FROM inter) + (SELECT count(*) FROM ann) + (SELECT count(*) FROM hier) AS n_edges,
(SELECT count(*) FROM (SELECT "from" FROM net UNION SELECT "to" FROM net)) AS n_nodes""")
def network_size(spark, d):
    return bundle(spark, d).size()


@query(f"""WITH {_TRADE} SELECT "from", "to", min(o_orderpriority) AS source FROM trade GROUP BY 1, 2""")
def first_source_wins(spark, d):
    order = tuple(sorted(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))
    return network.first_source_wins(trade(spark, d).select("from", "to", F.col("o_orderpriority").alias("source")), order)


@query(f"WITH {_NET} SELECT type, count(*) AS n FROM net GROUP BY 1")
def edge_type_counts(spark, d):
    return bundle(spark, d).network().groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_INTER} SELECT least("from", "to") AS "from", greatest("from", "to") AS "to", max(score) AS weight FROM
(SELECT "from", "to", score FROM inter UNION ALL SELECT "to", "from", score / 2 FROM inter) GROUP BY 1, 2""")
def prepared_edges(spark, d):
    i = interactions(spark, d).select("from", "to", F.col("score").alias("weights"))
    return graph.prepare_edges(i.union(i.select("to", "from", F.col("weights") / 2)))


@query(f"""WITH {_NET} SELECT node, count(*) AS degree FROM (SELECT "from" AS node FROM net WHERE type = 'interaction' UNION ALL SELECT "to" FROM net WHERE type = 'interaction') GROUP BY 1""")
def node_degree(spark, d):
    return graph.node_degree(bundle(spark, d).network().where("type = 'interaction'"))


@query(f"""WITH {_NET}, dg AS (SELECT type, node, count(*) AS n FROM (SELECT type, "from" AS node FROM net UNION ALL SELECT type, "to" FROM net) GROUP BY 1, 2)
SELECT type, min(n) AS minimum, round(quantile_cont(n::DOUBLE, 0.25), 6) AS q1, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median, round(quantile_cont(n::DOUBLE, 0.75), 6) AS q3, max(n) AS maximum, round(avg(n), 6) AS mean FROM dg GROUP BY 1""")
def degree_summary(spark, d):
    return rounded(graph.degree_summary(bundle(spark, d).network()))


@query(f"""WITH {_WHOLE} SELECT "from" AS node, "to" AS neighbour FROM links WHERE "from" <> "to" UNION SELECT "to", "from" FROM links WHERE "from" <> "to" """)
def adjacency(spark, d):
    return graph.adjacency(whole(spark, d))


#: Labels sink to the smallest node in reach, one for each node.
_COMPONENTS = f"""WITH RECURSIVE {_WHOLE}, adj AS (SELECT "from" AS a, "to" AS b FROM links UNION SELECT "to", "from" FROM links),
comp(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM adj
  UNION SELECT n.b, min(x.component) FROM comp x JOIN adj n ON x.node = n.a JOIN recurring.comp r ON r.node = n.b WHERE x.component < r.component GROUP BY n.b)"""


@query(f"{_COMPONENTS} SELECT node, component FROM comp")
def components(spark, d):
    return graph.components(whole(spark, d))


@query(f"""{_COMPONENTS}, big AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
SELECT "from", "to" FROM links JOIN comp ON "from" = node JOIN big USING (component)""")
def largest_component(spark, d):
    return graph.largest_component(whole(spark, d))


# ---------------------------------------------------------------- similarity and statistics


def replicates(spark, d) -> DataFrame:
    """rep, vec_id, label, embedding: two slices of 21 and one of 22 dimensions."""
    e = read(spark, d, "embeddings")
    parts = F.explode(F.array(*[F.struct(F.lit(r).alias("rep"), F.slice("embedding", 1 + 21 * (r - 1), 21 + r // 3).alias("embedding")) for r in (1, 2, 3)])).alias("x")
    return e.select("vec_id", "label", parts).select("x.rep", "vec_id", "label", "x.embedding")


def tested_ends(spark, d) -> tuple[DataFrame, DataFrame]:
    """(gene, group) and (pathway, group): of the vectors of a label those divisible by five, and the others."""
    e = read(spark, d, "embeddings")
    end = lambda which, name: e.where(which).select(named("V", "vec_id").alias(name), F.col("label").alias("group"))
    return end("vec_id % 5 = 0", "gene"), end("vec_id % 5 <> 0", "pathway")


def tested_pairs(spark, d) -> DataFrame:
    """gene, pathway: the vectors of a label, those divisible by five against the others."""
    genes, pathways = tested_ends(spark, d)
    return genes.join(pathways, "group").select("gene", "pathway")


def vectors(spark, d) -> DataFrame:
    """rep, node, embedding."""
    return replicates(spark, d).select("rep", named("V", "vec_id").alias("node"), "embedding")


def observed(spark, d) -> DataFrame:
    """rep, gene, pathway, similarity of the tested pairs."""
    return stats.group_cosine(*tested_ends(spark, d), vectors(spark, d))


def null_values(spark, d) -> DataFrame:
    """similarity of a gene and the pathways among the seven next vectors, whatever their label."""
    r = replicates(spark, d)
    genes = r.where("vec_id % 5 = 0").select("rep", F.col("embedding").alias("a"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 7)).alias("vec_id"))
    return genes.join(r.where("vec_id % 5 <> 0"), ["rep", "vec_id"]).select(cosine(F.col("a"), F.col("embedding")).alias("similarity"))


def tested(spark, d, column: str) -> DataFrame:
    """rep, gene, pathway, and one of pval, global_fdr and gene_fdr, to six decimals."""
    return stats.group_tests(*tested_ends(spark, d), vectors(spark, d), null_values(spark, d), column, 6)


def association(spark, d, columns: tuple[str, ...] = stats.STATISTICS[2:], top: int | None = None) -> DataFrame:
    """gene, pathway and ``columns`` of the statistics, to six decimals."""
    return stats.group_statistics(*tested_ends(spark, d), vectors(spark, d), null_values(spark, d), columns, 6, top)


_COS = "list_dot_product(g.e, p.e) / (sqrt(list_dot_product(g.e, g.e)) * sqrt(list_dot_product(p.e, p.e)))"
_SIM = f"""emb AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
rep AS (SELECT r::INT AS rep, vec_id, label, e[1 + 21 * (r - 1):21 * r + r // 3] AS e FROM emb, generate_series(1, 3) AS t(r)),
sim AS (SELECT g.rep, 'V' || g.vec_id AS gene, 'V' || p.vec_id AS pathway, {_COS} AS similarity FROM rep g JOIN rep p ON g.rep = p.rep AND g.label = p.label WHERE g.vec_id % 5 = 0 AND p.vec_id % 5 <> 0),
nul AS (SELECT round({_COS}, 9) AS v FROM rep g JOIN rep p ON g.rep = p.rep AND p.vec_id - g.vec_id BETWEEN 1 AND 7 WHERE g.vec_id % 5 = 0 AND p.vec_id % 5 <> 0)"""
_P = _SIM + """, run AS (SELECT v, z, sum(z) OVER (ORDER BY v, z ROWS UNBOUNDED PRECEDING) AS rank FROM (SELECT v, 1 AS z FROM nul UNION ALL SELECT DISTINCT round(similarity, 9), 0 FROM sim)),
pv AS (SELECT sim.*, greatest(1 - rank::DOUBLE / (SELECT count(*) FROM nul), 1e-16) AS pval FROM sim JOIN run ON round(similarity, 9) = v AND z = 0)"""
_BH = _P + """, raw AS (SELECT *, (count(*) OVER (PARTITION BY rep))::DOUBLE / count(*) OVER (PARTITION BY rep ORDER BY pval) * pval AS raw1,
  (count(*) OVER (PARTITION BY rep, gene))::DOUBLE / count(*) OVER (PARTITION BY rep, gene ORDER BY pval) * pval AS raw2 FROM pv),
bh AS (SELECT *, least(1.0::DOUBLE, min(raw1) OVER (PARTITION BY rep ORDER BY pval RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS global_fdr,
  least(1.0::DOUBLE, min(raw2) OVER (PARTITION BY rep, gene ORDER BY pval RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS gene_fdr FROM raw)"""


def _log_stats_sql(value: str, name: str) -> str:
    g = f"greatest(0::DOUBLE, least(1::DOUBLE, exp(avg(ln({value} + 1e-16))) - 1e-16))"
    step = f"exp(coalesce(stddev_samp(ln({value} + 1e-16)), 0) * 1.96 / sqrt(count({value})))"
    bound = lambda x: f"round(CASE WHEN count({value}) <= 1 THEN 1e-16 ELSE greatest(0::DOUBLE, least(1::DOUBLE, {x})) END, 6)"
    return f"round({g}, 6) AS avg_{name}, {bound(f'{g} / {step}')} AS {name}_ci_lower, {bound(f'{g} * {step}')} AS {name}_ci_upper"


_STATS = _BH + f""", st AS (SELECT gene, pathway, round(avg(similarity), 6) AS similarity, round(coalesce(stddev_samp(similarity) / sqrt(count(*)), 0), 6) AS sem_sim,
{_log_stats_sql('pval', 'pval')}, {_log_stats_sql('global_fdr', 'global_fdr')}, {_log_stats_sql('gene_fdr', 'gene_fdr')} FROM bh GROUP BY gene, pathway)"""


STATS_SQL = _STATS


@query(f"WITH {_SIM} SELECT rep, gene, pathway, round(similarity, 6) AS similarity FROM sim")
def pair_cosine(spark, d):
    return stats.group_cosine(*tested_ends(spark, d), vectors(spark, d), 6)


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.label = b.label AS same, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS c FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT round(avg(c) FILTER (same), 6) AS within_mean, round(avg(c) FILTER (NOT same), 6) AS between_mean FROM p""")
def within_between(spark, d):
    e = read(spark, d, "embeddings")
    return rounded(stats.evaluate_clusters(e.select(F.col("vec_id").alias("node"), "embedding"), e.select(F.col("vec_id").alias("node"), F.col("label").alias("cluster"))))


@query(f"WITH {_P} SELECT rep, gene, pathway, round(pval, 6) AS pval FROM pv")
def empirical_pvalue(spark, d):
    return tested(spark, d, "pval")


@query(f"WITH {_BH} SELECT rep, gene, pathway, round(global_fdr, 6) AS global_fdr FROM bh")
def bh_global(spark, d):
    return tested(spark, d, "global_fdr")


@query(f"WITH {_BH} SELECT rep, gene, pathway, round(gene_fdr, 6) AS gene_fdr FROM bh")
def bh_per_gene(spark, d):
    return tested(spark, d, "gene_fdr")


@query(f"WITH {_STATS} SELECT * FROM st")
def association_stats(spark, d):
    return association(spark, d)


@query(f"""WITH {_INTER} SELECT "from" AS gene, {_log_stats_sql('score', 'score')} FROM inter GROUP BY 1""")
def log_statistics(spark, d):
    return rounded(interactions(spark, d).groupBy(F.col("from").alias("gene")).agg(*log_stats("score", "score")))


@query(f"WITH {_STATS} SELECT * FROM st ORDER BY similarity DESC, gene, pathway LIMIT 10")
def top_associations(spark, d):
    return association(spark, d, top=10).orderBy(F.desc("similarity"), "gene", "pathway").limit(10)


@query(f"""WITH {_STATS}, dg AS (SELECT 'V' || l_suppkey AS gene, 2 * count(*) AS degree FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) GROUP BY 1)
SELECT st.gene, round(avg((avg_gene_fdr <= 0.25)::INT), 6) AS ratio, count(*) AS connections, coalesce(max(degree), 0) AS degree FROM st LEFT JOIN dg ON st.gene = dg.gene GROUP BY 1""")
def enrichment_ratio(spark, d):
    lines = read(spark, d, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    loops = lines.select(named("V", "l_suppkey").alias("from"), named("V", "l_suppkey").alias("to"))
    return rounded(report.enrichment(association(spark, d, ("avg_gene_fdr",)), loops))


@query(f"""WITH {_SIM}, v AS (SELECT 'null' AS sample, v AS x FROM nul UNION ALL SELECT 'actual', round(similarity, 9) FROM sim),
w AS (SELECT min(x) AS low, (max(x) - min(x)) / 50 AS w FROM v), t AS (SELECT sample, count(*) AS n FROM v GROUP BY 1),
b AS (SELECT sample, least(floor((x - low) / w), 49)::INT AS bin, max(w) AS w, count(*) AS c FROM v, w GROUP BY 1, 2)
SELECT b.sample, bin, c AS "count", round(c / (n * w), 6) AS density FROM b JOIN t ON b.sample = t.sample""")
def similarity_histogram(spark, d):
    return rounded(report.group_histogram(*tested_ends(spark, d), vectors(spark, d), null_values(spark, d)))


# ---------------------------------------------------------------- synthetic graphs, null graphs, walks

#: Customers as numbers from 1, on which the synthetic graphs are planted.
_EDGES = """WITH s AS (SELECT c_custkey + 1 AS i FROM customer), a AS (SELECT i AS u FROM s), b AS (SELECT i AS v FROM s)
SELECT printf('node_%04d', u) AS "from", printf('node_%04d', v) AS "to", 'interaction' AS edge_type FROM """


def numbers(spark, d) -> DataFrame:
    return read(spark, d, "customer").select((F.col("c_custkey") + 1).alias("i"))


@query(_EDGES + "(SELECT u, v FROM a JOIN b ON (u - 1) // 40 = (v - 1) // 40 WHERE u < v AND ((u - 1) // 20 = (v - 1) // 20 OR ((u - 1) % 40 = 19 AND v = u + 1)))")
def barbell(spark, d):
    """Forty customers in a row are a barbell."""
    return synthetic.planted(numbers(spark, d), "barbell", 20, 2).edges


@query(_EDGES + f"""(SELECT u, v FROM a JOIN b ON (u - 1) // 10 = (v - 1) // 10 WHERE u < v
UNION ALL SELECT u, v FROM (SELECT (a - 1) * 10 + 1 + floor({_u("'42'", "'left'", "a", "b")} * 10)::BIGINT AS u, (b - 1) * 10 + 1 + floor({_u("'42'", "'right'", "a", "b")} * 10)::BIGINT AS v
FROM (SELECT DISTINCT (i - 1) // 10 + 1 AS a FROM s) AS x JOIN (SELECT DISTINCT (i - 1) // 10 + 1 AS b FROM s) AS y ON (a - 1) // 5 = (b - 1) // 5 WHERE a < b AND {_u("'42'", "'bridge'", "a", "b")} < 0.5)
WHERE u IN (SELECT i FROM s) AND v IN (SELECT i FROM s))""")
def caveman(spark, d):
    """Fifty customers in a row are five caves."""
    return synthetic.planted(numbers(spark, d), "caveman", 10, 5, p_between=0.5).edges


@query(_EDGES + f"""(SELECT u, v FROM a JOIN b ON (u - 1) // 30 = (v - 1) // 30 WHERE u < v AND {_u("'42'", "u", "v")} < CASE WHEN (u - 1) // 10 = (v - 1) // 10 THEN 0.8 ELSE 0.05 END)""")
def stochastic_block(spark, d):
    """Thirty customers in a row are three blocks."""
    return synthetic.planted(numbers(spark, d), "stochastic_block", 10, 3).edges


@query(f"""WITH {_WHOLE}, dg AS (SELECT node, count(*) AS n FROM (SELECT "from" AS node FROM links UNION ALL SELECT "to" FROM links) GROUP BY 1),
stubs AS (SELECT node, unnest(generate_series(1, n)) AS stub FROM dg), placed AS (SELECT node, row_number() OVER (ORDER BY {_u("'7'", "node", "stub")}, node) - 1 AS i FROM stubs),
pairs AS (SELECT max(node) FILTER (i % 2 = 0) AS a, max(node) FILTER (i % 2 = 1) AS b FROM placed GROUP BY i // 2)
SELECT DISTINCT least(a, b) AS "from", greatest(a, b) AS "to", 1.0::DOUBLE AS weight FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b""")
def configuration_model(spark, d):
    return graph.configuration_model(whole(spark, d), 7)


def _walk_sql(steps: int) -> str:
    """p = 0.5, q = 2: forty draws a step, the first accepted one counts."""
    sql = f"""WITH {_WHOLE}, adj AS (SELECT "from" AS node, "to" AS nb FROM links UNION SELECT "to", "from" FROM links),
slots AS (SELECT node, nb, row_number() OVER (PARTITION BY node ORDER BY nb) AS place, count(*) OVER (PARTITION BY node) AS deg FROM adj), deg AS (SELECT DISTINCT node, deg FROM slots),
w0 AS (SELECT node AS start, w::INT AS walk_no, [node] AS path FROM deg, generate_series(1, 2) AS t(w))"""
    for i in range(1, steps):
        u = lambda at, n: f"(('0x' || substr(h, {at}, {n}))::BIGINT / pow(16.0, {n}))"
        sql += f""", t{i} AS (SELECT start, walk_no, path, deg, trial, md5('42|' || start || '|' || walk_no || '|{i}|' || trial) AS h FROM w{i - 1} JOIN deg ON node = path[-1], generate_series(0, 39) AS g(trial)),
a{i} AS (SELECT *, {u(1, 13)} * (deg + (len(path) > 1)::INT) >= deg AS returns, least(floor({u(14, 13)} * deg), deg - 1)::BIGINT + 1 AS place FROM t{i}),
c{i} AS (SELECT start, walk_no, path, trial, CASE WHEN returns THEN path[-2] ELSE s.nb END AS nb, returns OR {u(27, 6)} < CASE WHEN len(path) < 2 OR s.nb = path[-2] OR z.node IS NOT NULL THEN 1 ELSE 0.5 END AS good
  FROM a{i} JOIN slots s ON s.node = path[-1] AND s.place = a{i}.place LEFT JOIN adj z ON z.node = path[-2] AND z.nb = s.nb),
w{i} AS (SELECT start, walk_no, list_append(any_value(path), arg_min(nb, trial)) AS path FROM c{i} WHERE good GROUP BY 1, 2)"""
    return sql + f" SELECT start, walk_no, array_to_string(path, ' ') AS path FROM w{steps - 1}"


@query(_walk_sql(5))
def random_walks(spark, d):
    found = walks.random_walks(graph.neighbours(whole(spark, d)), 2, 5, p=0.5, q=2.0)
    return found.select("start", "walk_no", F.array_join("path", " ").alias("path"))


# ---------------------------------------------------------------- trained results: rows only


def analysed(spark, d) -> Analysis:
    """The whole network: customers and suppliers as genes, their nations as pathways."""
    pairs = annotations(spark, d)
    return Analysis(bundle(spark, d).network(), pairs, pairs.select(F.col("from").alias("gene")).distinct(), pairs.select(F.col("to").alias("pathway")).distinct())


@query()
def node2vec_embedding(spark, d):
    """Of the whole network, with the walks of a standalone embedding and four of its twenty epochs."""
    return node2vec(bundle(spark, d).network(), params=node2vec_params(n_epochs=4))


@query()
def null_similarities(spark, d):
    """Of the whole network, with the defaults of the association pipeline and its three permutations."""
    return embed.null_similarities(bundle(spark, d).network(), association_params(), 8, 3, 42)


@query()
def gene_walk(spark, d):
    """Network, replicates, permutations and statistics at default parameters, in stages that a second call reads."""
    return analysed(spark, d).staged(Stages(spark, f"{shared_folder(spark)}/stages")).stats()


@query()
def synthetic_association_data(spark, d):
    """With as many genes of each kind as there are suppliers."""
    n = read(spark, d, "supplier").count()
    return synthetic.association_data(spark, SyntheticParams(n_signal_genes=n, n_noise_genes=n)).full_data


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
z AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_samp(x) OVER (PARTITION BY i) AS z FROM x),
c AS (SELECT a.i, b.i AS j, covar_samp(a.z, b.z) AS c FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM embeddings)
SELECT 'nodes' AS what, n::DOUBLE AS value FROM n UNION ALL SELECT 'sum', 0 UNION ALL SELECT 'cross', 0
UNION ALL SELECT 'whole', round(sum(c) FILTER (i = j), 3) FROM c UNION ALL SELECT 'loadings', 0""")
def pca_check(spark, d):
    """The two components of `pca_2d`, held against the covariance of the vectors.

    What must be so of principal components: ``sum`` and ``cross`` (means and covariance of the components) are 0, and the covariance matrix times each
    loading is the loading times the component's variance, up to ``loadings``. ``whole`` is the variance of all scaled dimensions.
    """
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("node"), "embedding")
    return report.pca_check(e, durable(report.pca_2d(e)))


@query()
def pca_2d(spark, d):
    return report.pca_2d(read(spark, d, "embeddings").select(F.col("vec_id").alias("node"), "embedding"))
