import hashlib
import math
from collections import Counter

import pytest

from readloom.llm.mixing import mix_sources


def count(doc_id, rate, seed=42):
    u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    n, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        n += 1
        p *= rate / n
        total += p
    return n


def test_counts_and_order(spark):
    rows = [(i, "x" * (i % 9), f"s{i % 3}" if i % 10 else None, 7) for i in range(900)] + [(1000, None, "big", 7), (None, "abc", "s1", 7), (5, "x" * 5, "s2", 7), (1001, "y" * 300_000, "s0", 7), (1002, "z", "none", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int").repartition(4)
    out = mix_sources(df, {"s0": 3.0, "s1": 1.0, "none": 0.0}, default_weight=0.5, null_weight=2.0, epochs=0.05)
    assert out.columns == ["doc_id", "text", "source", "copy", "mix_key"]
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += max(len(t or ""), 1)
    weight = {"s0": 3.0, "s1": 1.0, "s2": 0.5, "big": 0.5, None: 2.0, "none": 0.0}
    rate = {s: weight[s] / sum(weight.values()) * (sum(size.values()) * 0.05) / size[s] for s in size}
    want = Counter()
    for i, t, s, _ in rows:
        if weight[s]:
            want[(i, t, s)] += count(i, rate[s]) if rate[s] < 700 else 0
    got = Counter((r.doc_id, r.text, r.source) for r in out.where("source is null or source <> 'big'").collect())
    assert got == Counter({k: n for k, n in want.items() if n and k[2] != "big"})
    big = out.where("source = 'big'").count()  # a rate of 2000 and more: no underflow
    assert abs(big - rate["big"]) < 8 * math.sqrt(rate["big"])
    copies = [r.copy for r in out.where("source = 'big'").orderBy("copy").collect()]
    assert copies == list(range(big))
    keys = out.rdd.glom().map(lambda p: [r.mix_key for r in p]).collect()
    assert all(k == sorted(k) for k in keys)
    assert out.exceptAll(mix_sources(df, {"s0": 3.0, "s1": 1.0, "none": 0.0}, 0.5, 2.0, 0.05)).count() == 0


def test_sources_follow_weights(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "repeat('a', 10) as text", "if(id % 10 < 7, 'hot', 'rare') as source")
    n = {r.source: r["count"] for r in mix_sources(df, {"hot": 1.0, "rare": 1.0}).groupBy("source").count().collect()}
    assert abs(n["hot"] - 10_000) < 500 and abs(n["rare"] - 10_000) < 500


def test_many_sources_are_joined_by_a_shuffle(spark, monkeypatch):
    from readloom.llm import mixing

    df = spark.range(3000).selectExpr("id as doc_id", "'t' as text", "cast(id % 50 as string) as source")
    want = sorted(map(tuple, mix_sources(df, {"3": 4.0}).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    monkeypatch.setattr(mixing, "MAX_RATE", 50.0)
    assert sorted(map(tuple, mix_sources(df, {"3": 4.0}).collect())) == want


def test_empty_and_refused(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(df, {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mix_sources(spark.createDataFrame([(1, "a", "s"), (2, "b" * 100_000, "t")], df.schema), {"s": 1.0}).count()


def test_rates_above_the_bound_of_a_draw(spark):
    from readloom.llm import mixing

    schema = "doc_id long, text string, lang string, source string"
    rows = [(1, "a", "en", "src7"), (2, "b" * 100_000, "en", "src0"), (3, "c", "en", None)]
    out = mix_sources(spark.createDataFrame(rows, schema), mixing.WEIGHTS, any_rate=True).cache()
    rate = 100_002 / 6  # weights 4, 1 and 1
    for i in (1, 3):
        copies = [r.copy for r in out.where(f"doc_id = {i}").orderBy("copy").collect()]
        assert copies == list(range(len(copies))) and abs(len(copies) - rate) < 6 * math.sqrt(rate)
    assert out.schema["copy"].dataType.typeName() == "integer" and out.select("mix_key").distinct().count() == out.count()


def test_sums_of_draws_are_poisson(spark, monkeypatch):
    from readloom.llm import mixing

    monkeypatch.setattr(mixing, "MAX_RATE", 3.0)
    df = spark.range(4000).selectExpr("id as doc_id", "'tt' as text", "if(id < 3900, 'hot', 'rare') as source")
    for bound in (20_000, 1):  # broadcast and joined by a shuffle
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
        n = {r.doc_id: r["count"] for r in mix_sources(df, {"hot": 1.0, "rare": 1.0}, any_rate=True).where("source = 'rare'").groupBy("doc_id").count().collect()}
        mean = sum(n.values()) / 100
        var = sum((x - mean) ** 2 for x in n.values()) / 99
        assert len(n) == 100 and abs(mean - 20) < 2.5 and 10 < var < 36
        with pytest.raises(ValueError):
            mix_sources(df, {"hot": 1.0, "rare": 1.0})


def test_very_many_sources_and_one_high_rate(spark):
    df = spark.range(25_000).selectExpr("id as doc_id", "repeat('t', 400) as text", "cast(id as string) as source").unionByName(spark.sql("SELECT 30000L AS doc_id, 't' AS text, 'rare' AS source"))
    n = {r.doc_id: r["count"] for r in mix_sources(df, {"rare": 30.0}, any_rate=True).groupBy("doc_id").count().collect()}
    size, weight = 25_000 * 400 + 1, 25_030
    rate = 30 / weight * size
    assert rate > 10_000 and abs(n.pop(30_000) - rate) < 6 * math.sqrt(rate)
    want = {i: c for i in range(25_000) if (c := count(i, size / weight / 400))}
    assert n == want


def test_added_columns_may_be_named(spark):
    df = spark.createDataFrame([(i, "text", "s", f"c{i}") for i in range(50)], "doc_id long, text string, source string, copy string")
    out = mix_sources(df, {"s": 1.0}, added=("nth", "place"))
    assert out.columns == [*df.columns, "nth", "place"] and all(r.copy == f"c{r.doc_id}" for r in out.collect())
