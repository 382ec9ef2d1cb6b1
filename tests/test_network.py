import pytest

from kinweave.operators.network import EdgeBundle, NetworkBuilder, first_source_wins
from kinweave.params import SyntheticParams, WalkParams, association_params
from kinweave.schema import check_edges, check_graph
from kinweave.sources.catalog import TABLES, Catalog


def pairs(spark, rows):
    return spark.createDataFrame(rows, "from string, to string")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    c = Catalog(spark, str(tmp_path_factory.mktemp("catalog")))
    frame = spark.createDataFrame
    tables = {
        "gene_main": frame([("g1", "S1", "x"), ("g2", "S2", "x")], "ensembl_id string, symbol string, biotype string"),
        "gene_ontology_main": frame([("t1", "n", "biological_process"), ("t2", "n", "molecular_function"), ("t3", "n", "biological_process")], "go_id string, go_name string, name_space string"),
        "gene_ontology_genes": pairs(spark, [("g1", "t1"), ("g2", "t2"), ("g9", "t3")]),
        "reactome_genes": pairs(spark, [("g1", "r1"), ("g1", "t1")]),
        "reactome_ontology": frame([("r1", "r2", "parent_of"), ("r2", "r1", "child_of")], "from string, to string, relationship string"),
        "gene_ontology_dag": frame([("t1", "t3", "is_a"), ("t1", "t2", "is_a")], "from string, to string, relationship string"),
        "interactions_string": frame([("g1", "g2", 0.9, True), ("g2", "g3", 0.4, False)], "from string, to string, string_score double, string_high_quality boolean"),
        "interactions_signor": frame([("g1", "g2", "up"), ("g3", "g4", "up")], "from string, to string, interaction_type string"),
        "interactions_intact": frame([("g5", "g6", 0.9, True), ("g6", "g7", 0.9, False), ("g7", "g8", 0.1, True)], "from string, to string, intact_score double, physical_association boolean"),
    }
    assert c.write(tables)["interactions_intact"] == 3
    return c


def test_getters(catalog):
    assert catalog.interactions_string(0.85).count() == 1 and catalog.interactions_string().count() == 2
    assert [catalog.interactions_intact(t, p).count() for t in (None, 0.5) for p in (False, True)] == [3, 2, 2, 1]
    assert rows(catalog.reactome_hierarchy("child_of")) == [("r2", "r1", "child_of")]
    assert catalog.reactome_hierarchy(head_only=True).count() == 2
    for bad in (lambda: catalog.reactome_hierarchy("sibling_of"), lambda: catalog.interactions_string(1.5), lambda: catalog.table("nope")):
        with pytest.raises(ValueError):
            bad()
    catalog.register("test_")
    assert catalog.spark.sql("SELECT count(*) FROM test_gene_main").first()[0] == 2
    catalog.refresh()
    assert len(TABLES) == 13


def test_builder(catalog):
    b = NetworkBuilder(catalog)
    with pytest.raises(ValueError):
        b.build()
    with pytest.warns(UserWarning):
        assert b.full_network() is None
    with pytest.raises(ValueError):
        b.add_ppi("nothing")
    b.add_pathways("go", "biological_process").add_pathways("reactome").add_ppi("signor").add_ppi("string").build()
    assert "built: yes" in repr(b)
    assert rows(b.bundle.ppis) == [("g1", "g2", "string"), ("g2", "g3", "string"), ("g3", "g4", "signor")]
    assert rows(b.bundle.gene_to_pathways) == [("g1", "r1", "reactome"), ("g1", "t1", "go"), ("g9", "t3", "go")]
    assert rows(b.bundle.pathway_hierarchy.select("from", "to", "edge_type")) == [("r1", "r2", "parent_of"), ("t1", "t3", "is_a")]
    assert b.bundle.n_edges == 8 and b.bundle.n_nodes == 9
    a = b.create_for_genes(catalog.spark.createDataFrame([("g1",), ("g2",)], "gene string"))
    assert {r.type: r.n for r in a.edge_counts().collect()} == {"interaction": 1, "part_of": 2, "hierarchy": 2}
    b.reset_choices()
    assert "built: no" in repr(b) and not b.ppi_sources


def test_filtered_network(spark):
    b = EdgeBundle(pairs(spark, [("g1", "g2"), ("g1", "x")]), pairs(spark, [("g1", "t1"), ("x", "t2")]), pairs(spark, [("t3", "t4")]))
    with pytest.warns(UserWarning, match="g9"):
        f = b.filtered(spark.createDataFrame([("g1",), ("g2",), ("g9",)], "gene string"))
    assert rows(f.graph.select("from", "to")) == [("g1", "g2"), ("g1", "t1"), ("t3", "t4")]
    assert rows(f.missing_genes) == [("g9",)] and rows(f.represented_pathways) == [("t1",), ("t3",), ("t4",)]
    assert rows(f.represented_genes) == [("g1",), ("g2",)]


def test_first_source_wins(spark):
    df = spark.createDataFrame([("A", "B", "signor"), ("A", "B", "string"), ("B", "A", "other")], "from string, to string, source string")
    assert rows(first_source_wins(df)) == [("A", "B", "string"), ("B", "A", "other")]


def test_checks(spark):
    with pytest.raises(ValueError):
        check_edges(spark.createDataFrame([(1,)], "from int"))
    g = spark.createDataFrame([("a", "b", "part_of")], "from string, to string, type string")
    with pytest.warns(UserWarning):
        check_graph(g)
    with pytest.raises(ValueError):
        check_graph(g, strict=True)
    assert association_params().walks_per_node == 100 and SyntheticParams().depth == 3
    with pytest.raises(ValueError, match="walk_length"):
        WalkParams(walk_length=1.5)
    with pytest.raises(ValueError, match="p "):
        WalkParams(p="x")
