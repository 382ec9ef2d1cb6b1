from kinweave.functions import dealing
from kinweave.plans import driver_queries
from kinweave.sources import ingest

SMALL = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_rows(spark):
    few, many = 4 * dealing.TASK_ROWS, 40 * dealing.TASK_ROWS
    assert dealing.tasks(spark.range(1), few) is None and dealing.tasks(spark.range(1), many) == 40
    df = spark.range(100)
    assert dealing.dealt(df, few, "id") is df and dealing.dealt(df, many, "id").rdd.getNumPartitions() == 40


def test_links_are_grouped_in_tasks_of_bounded_rows(spark, monkeypatch):
    def exchanges():
        plan = driver_queries.node_degree(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        return plan.count("REPARTITION_BY_NUM")

    assert exchanges() == 0
    want = {tuple(r) for r in driver_queries.node_degree(spark, SMALL).collect()}
    monkeypatch.setattr(dealing, "TASK_ROWS", 200)
    assert exchanges() == 3  # lines, orders, and their links by both ends
    assert {tuple(r) for r in driver_queries.node_degree(spark, SMALL).collect()} == want


def test_translated_rows_are_grouped_in_tasks_of_bounded_rows(spark):
    genes = spark.createDataFrame([("ENSG1", "a", "x"), ("ENSG9", "b", "x")], "ensembl_id string, symbol string, biotype string")
    pc = spark.createDataFrame([("a", "b", "t"), ("a", "b", "t")], "PARTICIPANT_A string, PARTICIPANT_B string, INTERACTION_TYPE string")
    out = ingest.interactions_pc(pc, genes, 40 * dealing.TASK_ROWS)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("ENSG1", "ENSG9", "t")]
