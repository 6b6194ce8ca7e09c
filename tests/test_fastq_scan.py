from readloom.sources import fastq


def test_records_cut_by_splits_and_batches(spark, tmp_path):
    """Splits and batches end anywhere in a record; each record comes once, at its byte, and no line is sorted."""
    records = [(f"@r{i}", "ACGTN"[: 1 + i % 5] * (1 + i % 3), "+" if i % 7 else "-", "I" * (i % 11)) for i in range(300)]
    for name, held in (("a", records[:170]), ("b", records[170:])):
        (tmp_path / f"{name}.fq").write_text("".join("\n".join(r) + "\n" for r in held))
    at, places = 0, []
    for r in records:
        places.append(at)
        at += len("\n".join(r)) + 1
    want = [(i, *r, places[i], (places + [at])[i + 1]) for i, r in enumerate(records)]
    changed = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for size in ("397", "100000"):
            for k, v in (changed | {"spark.sql.files.maxPartitionBytes": size}).items():
                spark.conf.set(k, v)
            found = fastq._records(spark, str(tmp_path / "*.fq"))
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert "Window [" not in plan or "mid" not in plan.split("Window [")[1].splitlines()[0]
            got = sorted(map(tuple, found.select("read_id", "header", "seq", "plus", "qual", "byte_offset", "byte_end").collect()))
            assert got == want
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
