import __spark_entry__ as entry

from readloom.streaming.dedup import duplicate_stream, unique_stream


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    for part in ([(0, "ACGT"), (1, "AAAA"), (2, "ACGT")], [(3, "acgt"), (4, "AAAA"), (5, "nnnn")]):
        spark.createDataFrame(part, "read_id long, seq string").coalesce(1).write.mode("append").parquet(src)

    def run(build, name):
        stream = spark.readStream.schema("read_id long, seq string").option("maxFilesPerTrigger", 1).parquet(src)
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    assert sorted(s for _, s in run(unique_stream, "uniq")) == ["AAAA", "ACGT", "NNNN"]
    dups = run(duplicate_stream, "dups")
    assert len(dups) == 3 and {frozenset(d) for d in dups} == {frozenset((0, 2)), frozenset((1, 4)), frozenset((3, 5))}


def test_streams_with_a_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    for day, part in ((1, [(0, "ACGT"), (1, "AAAA"), (2, "ACGT"), (9, None)]), (1, [(3, "ACGT")]), (5, [(4, "CCCC")]), (9, [(5, "ACGT"), (6, "ACGT")])):
        spark.createDataFrame(part, "read_id long, seq string").selectExpr("*", f"timestamp'2024-01-0{day} 00:00:00' as at").coalesce(1).write.mode("append").parquet(src)

    def run(build, name):
        stream = spark.readStream.schema("read_id long, seq string, at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(lambda s: duplicate_stream(s, "at"), "dups_w") == [(0, 2), (0, 3), (5, 6)]  # four days later the sequence is new
    assert run(lambda s: unique_stream(s, "at"), "uniq_w") == [(0, "ACGT"), (1, "AAAA"), (4, "CCCC"), (5, "ACGT")]


def test_registry(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 35
    df = entry.entry(spark)
    assert df.columns == ["a_id", "b_id", "k"] and df.count() > 0
