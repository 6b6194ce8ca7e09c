from readloom.plans.fixtures import reads_synth


def test_chunks_are_not_broadcast(spark, tmp_path):
    """The chunks of the genome grow with the input: they are joined by a shuffle, only the one row with their number is broadcast."""
    spark.range(50).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(400).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    found = reads_synth(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert found.count() == 400
