import datetime

from kinweave.streaming import edges

T = datetime.datetime(2024, 1, 1)


def test_degrees_follow_arriving_files(spark, tmp_path):
    path = str(tmp_path / "in")

    def arrive(rows):
        spark.createDataFrame([(a, b, "interaction", T + datetime.timedelta(hours=h)) for a, b, h in rows], edges.EDGE_SCHEMA).write.mode("append").parquet(path)

    def run(name, df, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()

    arrive([("a", "b", 0), ("a", "b", 1), ("a", "a", 2)])
    arrive([("b", "c", 3)])
    stream = edges.edge_stream(spark, path)
    run("degrees", edges.running_degrees(stream), "complete")
    assert {r.node: r.degree for r in spark.table("degrees").collect()} == {"a": 4, "b": 3, "c": 1}
    run("fresh", edges.new_edges(stream), "append")
    assert sorted((r["from"], r["to"]) for r in spark.table("fresh").collect()) == [("a", "a"), ("a", "b"), ("b", "c")]
    run("windows", edges.degrees_in_windows(stream, "2 hours", "1 hour"), "complete")
    assert sum(r.degree for r in spark.table("windows").collect()) == 8
