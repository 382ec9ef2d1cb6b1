import pytest
from pyspark.sql import Observation, Row
from pyspark.sql import functions as F

from kinweave.sources import ingest, ontology
from kinweave.sources.catalog import Catalog

OBO = """format-version: 1.2
ontology: test

[Term]
id: T:1
name: one: with a colon
namespace: biological_process
alt_id: T:11
subset: slim
synonym: "first \\"one\\"" EXACT [X:1]
xref: DB:5 "text"
is_a: T:2 ! two
relationship: part_of T:3 ! three

[Term]
id: T:2
name: two
namespace: biological_process
is_obsolete: true

[Term]
id: E:9
name: outside
namespace: external

[Typedef]
id: part_of
name: part of
namespace: external
"""


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_obo(spark, tmp_path):
    for name, text in (("a", OBO), ("b", OBO.replace("\n", "\r\n"))):
        path = tmp_path / f"{name}.obo"
        path.write_bytes(text.encode())
        t = ontology.parse_obo(spark, str(path))
        assert rows(t["names"]) == [("T:1", "one: with a colon"), ("T:2", "two")]
        assert rows(t["term_relations"]) == [("T:1", "T:2", "is_a"), ("T:1", "T:3", "part_of")]
        assert rows(t["term_obsolete"]) == [("T:2",)]
        assert rows(t["alt_ids"]) == [("T:1", "T:11")]
        assert rows(t["external_ref"]) == [("T:1", "DB:5")]
        assert [r.type for r in t["synonyms"].collect()] == ["EXACT"]
        assert [(r.name_space, sorted(r.ids)) for r in t["namespace"].collect()] == [("biological_process", ["T:1", "T:2"])]
        assert [(r.value, r.subset) for r in t["term_subsets"].collect()] == [("slim", ["T:1"])]


def test_unpivot_and_unnest(spark):
    df = spark.createDataFrame([("r", ["a", "b"], None, [], ["c"])], "id string, parents array<string>, children array<string>, ancestors array<string>, descendants array<string>")
    assert rows(ingest.unpivoted_relations(df)) == [("r", "a", "child_of"), ("r", "b", "child_of"), ("r", "c", "ancestor_of")]
    t = spark.createDataFrame([("g", [("p1",), ("p1",)]), ("h", None), ("i", [])], "id string, pathways array<struct<pathwayId:string>>")
    assert rows(ingest.reactome_genes(t)) == [("g", "p1"), ("g", "p1")]


def interactions(spark, nested):
    kind = "struct<sourceDatabase:string>"
    wrap = (lambda s: [(s,)]) if nested else (lambda s: (s,))
    data = [
        ("ENSG1", "ENSG2", 0.9, "association", wrap("intact")), ("ENSG1", "ENSG2", 0.9, "physical association", wrap("intact")),
        ("ENSG1", "ENSGGOG2", 0.9, "x", wrap("string")), ("ENSG3", "ENSG4", 0.9, "x", wrap("string")), ("ENSG3", "ENSG5", 0.2, "x", wrap("string")),
        ("ENSG6", None, 0.9, "x", wrap("string")), ("ENSG6", "ENSG7", None, "up", wrap("signor")), ("ENSG6", "ENSG7", None, "reaction", wrap("reactome")),
    ]
    kind = f"array<{kind}>" if nested else kind
    return spark.createDataFrame(data, f"targetA string, targetB string, interactionScore double, interactionTypeShortName string, interactionResources {kind}")


def test_interactions(spark, tmp_path):
    for nested in (False, True):
        df = interactions(spark, nested)
        assert rows(ingest.interactions_intact(df)) == [("ENSG1", "ENSG2", 0.9, True)]
        assert rows(ingest.interactions_string(df)) == [("ENSG3", "ENSG4", 0.9, True), ("ENSG3", "ENSG5", 0.2, False)]
        assert rows(ingest.typed_interactions(df, "signor")) == [("ENSG6", "ENSG7", "up")]
    path = tmp_path / "pc.tsv"
    path.write_text("PARTICIPANT_A\tINTERACTION_TYPE\tPARTICIPANT_B\nA\tbinds\tB\nA\tbinds\tunknown\nA\tbinds\tB\textra\n")
    genes = spark.createDataFrame([("ENSG3", "A"), ("ENSG0", "A"), ("ENSG4", "B"), ("ENSG8", None)], "ensembl_id string, symbol string")
    pc = ingest.interactions_pc(ingest.read_delimited(spark, str(path)), genes)
    assert rows(pc) == [("ENSG0", "ENSG4", "binds")]
    df = interactions(spark, False)
    both = ingest.interactions_combined({"string": ingest.interactions_string(df), "pc": pc, "signor": ingest.typed_interactions(df, "signor")})
    assert both.columns == ["from", "to", "intact", "pc", "reactome", "signor", "string"]
    assert rows(both) == [("ENSG0", "ENSG4", False, True, False, False, False), ("ENSG3", "ENSG4", False, False, False, False, True), ("ENSG6", "ENSG7", False, False, False, True, False)]


def test_all_tables(spark, tmp_path):
    from kinweave.sources.catalog import TABLES, Catalog

    path = tmp_path / "go.obo"
    path.write_text(OBO)
    targets = spark.createDataFrame([("ENSG0", "A", "coding", [("r1",)], [("T:1",)])], "id string, approvedSymbol string, biotype string, pathways array<struct<pathwayId:string>>, go array<struct<id:string>>")
    reactome = spark.createDataFrame([("r1", "pathway", ["r2"], None, None, None)], "id string, label string, parents array<string>, children array<string>, ancestors array<string>, descendants array<string>")
    raw = spark.createDataFrame([("A", "binds", "A")], "PARTICIPANT_A string, INTERACTION_TYPE string, PARTICIPANT_B string")
    tables = ingest.build_tables(targets, reactome, interactions(spark, False), raw, ontology.parse_obo(spark, str(path)))
    assert set(tables) == set(TABLES)
    counts = Catalog(spark, str(tmp_path / "catalog")).write(tables)
    assert counts["gene_ontology_main"] == 2 and counts["interactions_combined"] == 4


BARE = [
    "format-version: 1.2", "[Term]", "id: T:1", "name: one", "is_a: T:2 ! two", "[Term]", "id: T:2", "name: two: more", "note without colon", "comment:  wide  ",
    "id: T:3", "name: three", "[Term]", "id: E:1", "namespace: external", "name: gone", "[Term]", "id: T:4", "[Typedef]", "id: E:1", "name: gone too", "[Term]", "id: T:5", "name: five",
]


def by_rows(lines):
    """id, key, value by row intervals: a term has the rows from the one before its id to two before the next id."""
    cut = [(a, b.strip()) for a, _, b in (x.partition(":") for x in lines)]
    ids = [i for i, (k, _) in enumerate(cut) if k == "id"]
    out = []
    for i, (k, v) in enumerate(cut):
        own = [j for j in ids if i >= j - 1]
        if own:
            out.append((cut[own[-1]][1], k, v))
    external = {t for t, k, v in out if (k, v) == ("namespace", "external")}
    return sorted(x for x in out if x[0] not in external)


def test_lines_belong_to_terms_by_row_intervals(spark, tmp_path):
    ends = ["\n", "\r\n"]
    mixed = "".join(x + ends[i % 2] for i, x in enumerate(BARE))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.obo").write_bytes(mixed.encode())
    for size in ("1000000", "100", "23"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = rows(ontology.stanza_lines(spark, str(tmp_path / "one")))
            splits = ontology.numbered_lines(spark, str(tmp_path / "one")).select("block").distinct().count()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == by_rows(BARE)
        assert (splits > 10) == (size == "23")
    (tmp_path / "one" / "b.obo").write_text("name: before any term\n[Term]\nid: T:9\nname: nine")
    (tmp_path / "one" / "c.obo").write_text("")
    assert rows(ontology.stanza_lines(spark, str(tmp_path / "one"))) == sorted(by_rows(BARE) + [("T:9", "[Term]", ""), ("T:9", "id", "T:9"), ("T:9", "name", "nine")])


def test_recursive_expansion(spark):
    kind = "a:struct<x:int, y:struct<x:int, z:array<struct<id:string, tags:array<string>>>>>, w:array<int>"
    data = [
        ("p", ((1, (2, [("i", ["t", "u"]), ("j", ["v"])])), [7, 8, 9])),
        ("q", ((3, (4, [("k", None), ("l", [])])), None)),
        ("r", ((5, None), [6])),
        ("s", (None, [])),
        ("t", None),
    ]
    df = spark.createDataFrame(data, f"id string, n struct<{kind}>")
    got = ingest.expanded(df, "n")
    assert got.columns == ["id", "n_a_x", "n_a_y_x", "n_a_y_z_id", "tags", "w"]
    # w and z go on together; then the tags of each
    assert rows(got) == [("p", 1, 2, "i", "t", 7), ("p", 1, 2, "i", "u", 7), ("p", 1, 2, "j", "v", 8)]
    flat = spark.createDataFrame([("a", 1)], "id string, interactionResources int")
    assert rows(ingest.expanded(flat)) == [("a", 1)]
    odd = spark.createDataFrame([(1, 2, (3, 4))], "r0 int, n0 int, interactionResources struct<r0:int, b:int>")
    assert ingest.expanded(odd).columns == ["r0", "n0", "interactionResources_r0", "b"] and rows(ingest.expanded(odd)) == [(1, 2, 3, 4)]


def test_malformed_rows_are_counted_in_the_one_job(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("A\tB\tmalformed\n1\t2\t3\n1\t2\n4\t5\t6\t7\n8\t9\t\n")
    (tmp_path / "b.tsv").write_text("A\tB\tmalformed\nx\ty\tz\n")
    counts = Observation()
    df = ingest.read_delimited(spark, str(tmp_path), counts)
    assert df.columns == ["A", "B", "malformed"]
    assert sorted(map(str, df.collect())) == sorted(map(str, [Row(A="1", B="2", malformed="3"), Row(A="8", B="9", malformed=None), Row(A="x", B="y", malformed="z")]))
    assert counts.get == {"good": 3, "bad": 2}


def test_catalog_changes_at_once(spark, tmp_path):
    root = str(tmp_path / "catalog")
    genes = spark.createDataFrame([("g1", "A", "x"), ("g2", "B", "y")], "ensembl_id string, symbol string, biotype string")
    paths = spark.createDataFrame([("r1", "one")], "reactome_id string, reactome_name string")
    writer, early = Catalog(spark, root), Catalog(spark, root)
    assert writer.write({"gene_main": genes, "reactome_main": paths}) == {"gene_main": 2, "reactome_main": 1}
    held = early.gene_info()
    fails = genes.withColumn("symbol", F.raise_error("broken in mid-write"))
    with pytest.raises(Exception, match="broken"):
        writer.write({"reactome_main": paths.limit(0), "gene_main": fails})
    for c in (writer, early, Catalog(spark, root)):
        assert c.gene_info().count() == 2 and c.reactome_info().count() == 1
    assert writer.versions() == [1]
    assert writer.write({"gene_main": genes.limit(1)}) == {"gene_main": 1}
    assert held.count() == early.gene_info().count() == 2 and writer.gene_info().count() == 1
    assert writer.reactome_info().count() == 1
    early.refresh()
    assert early.gene_info().count() == 1
    assert len(writer.vacuum()) == 1 and writer.versions() == [2]
    assert Catalog(spark, root).gene_info().count() == 1 and Catalog(spark, root).reactome_info().count() == 1
    with pytest.raises(RuntimeError, match="meanwhile"):
        writer._put(2, {})
    with pytest.raises(ValueError):
        writer.write({"unknown": genes})
    plain = tmp_path / "plain"
    genes.write.parquet(str(plain / "gene_main"))
    assert Catalog(spark, str(plain)).gene_info().count() == 2


def test_combined_at_once_is_what_the_sources_give(spark):
    raw = [("ENSG1", "ENSG2", s, k, d) for s in (0.2, 0.85, 0.9, None) for k in ("physical association", None) for d in ("string", "intact", "signor", "reactome", "other", None)]
    raw += [("ENSG3", x, 0.99, "a", d) for x in ("ENSG4", None, "ENSGGOG1", "MUS") for d in ("string", "intact")] + [("ENSG5", "ENSG6", 0.5, "a", "string"), ("ENSG7", "ENSG8", None, "a", "string")]
    df = spark.createDataFrame(raw, "targetA string, targetB string, interactionScore double, interactionTypeShortName string, d string")
    df = df.select("*", F.struct(F.col("d").alias("sourceDatabase")).alias("interactionResources")).drop("d")
    genes = spark.createDataFrame([("ENSG1", "a", "x"), ("ENSG9", "b", "x")], "ensembl_id string, symbol string, biotype string")
    pc = spark.createDataFrame([("a", "b", "t"), ("a", "b", "u"), ("a", "z", "t"), ("a", None, "t")], "PARTICIPANT_A string, PARTICIPANT_B string, INTERACTION_TYPE string")
    parts = {"intact": ingest.interactions_intact(df), "pc": ingest.interactions_pc(pc, genes), "string": ingest.interactions_string(df)}
    parts |= {x: ingest.typed_interactions(df, x) for x in ("reactome", "signor")}
    want, got = (sorted(map(tuple, x.collect())) for x in (ingest.interactions_combined(parts), ingest.combined_at_once(df, pc, genes)))
    assert got == want and len(got) == 3
    plan = ingest.combined_at_once(df, pc, genes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 4  # interactions once, the file once and the genes for each end


def test_the_delimited_file_has_a_file_a_task(spark):
    from kinweave.plans import catalog_queries

    path = catalog_queries.delimited_file(spark, "/root/testdata/sf0.001").removeprefix("file:")
    frame = spark.read.text(path)
    assert frame.where("value = 'PARTICIPANT_A\tINTERACTION_TYPE\tPARTICIPANT_B'").count() == len(frame.inputFiles())
    assert "part=" not in frame.inputFiles()[0]
