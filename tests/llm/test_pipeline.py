import random

import corpus_pipeline
from brute import components_of
from pyspark.sql import functions as F

from readloom.llm import simhash
from readloom.llm.simhash import keep_one


def grams(text, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)}


def test_keep_one_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for base in range(30):
        text = rng.choices(words, k=rng.choice([8, 60, 300]))
        rows.append((len(rows), " ".join(text)))
        for _ in range(rng.choice([0, 1, 5, 20])):
            copy = [*text]
            for _ in range(rng.randint(0, len(copy) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    hot = " ".join(rng.choices(words, k=100))
    rows += [(1000 + i, hot) for i in range(200)] + [(2000, ""), (2001, None), (2002, "Solo"), (2003, "solo")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, d double").repartition(5)
    kept = {r.doc_id for r in keep_one(df).collect()}
    sets = [grams(t) for _, t in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = components_of(range(len(rows)), linked)
    want = {rows[r][0] for r in set(root.values())}
    assert want <= kept and len(kept - want) <= 0.02 * len(rows)


def test_keep_one_repeated_and_missing_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (1, a), (1, b), (2, b), (None, a), (None, "x y z"), (None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, keep_one(df).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (None, "x y z")], key=repr)
    assert keep_one(df.limit(0)).count() == 0


def test_stages_one_by_one(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").cache()
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d).cache()
        assert out.columns == columns, name
        if name != "mixing":
            assert out.exceptAll(docs).count() == 0 and 0.5 * docs.count() < out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert packed.groupBy("sequence_id").count().where("count > 1").count() == 0
    assert 0 < docs.count() < 3 * n and [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_dedup", "mixing", "packing"]
    assert corpus_pipeline.run(spark, d).select("doc_id", "start", "length", "ids_crc32").exceptAll(packed.select("doc_id", "start", "length", "ids_crc32")).count() == 0


def test_keep_one_keeps_texts_that_share_a_repeated_line(spark):
    rng = random.Random(6)
    line = [f"hot{i}" for i in range(9)]
    texts = [" ".join(line * 40 + [f"w{rng.randrange(10**6)}" for _ in range(100)]) for _ in range(16)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert keep_one(df).count() == 16


def test_keep_one_misses_no_pair_of_the_similarity(spark):
    rng = random.Random(7)
    rows = []
    for pair in range(150):
        text = [f"p{pair}w{rng.randrange(10**6)}" for _ in range(300)]
        copy = [*text]
        for at in rng.sample(range(10, 290), 6):  # up to 30 of 296 shingles: a similarity of 0.81 and more
            copy[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * pair, " ".join(text)), (2 * pair + 1, " ".join(copy))]
    line = " ".join(f"hot{i}" for i in range(12))
    rows = [(i, f"{t} {line}") for i, t in rows]
    once = " ".join(f"o{i}" for i in range(60))
    rows += [(1000, once), (1001, once + " " + " ".join([*once.split()[10:18]] * 30))]  # differ in how often a passage comes
    sets = [grams(t) for _, t in rows]
    linked = [(a, a + 1) for a in range(0, len(rows), 2) if len(sets[a] & sets[a + 1]) >= 0.8 * len(sets[a] | sets[a + 1])]
    want = {rows[r][0] for r in set(components_of(range(len(rows)), linked).values())}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(linked) >= 150 and {r.doc_id for r in keep_one(df).collect()} == want


def test_long_texts_that_share_a_part_are_compared(spark):
    rng = random.Random(8)
    part = [f"s{i}" for i in range(300)]
    base = [f"b{rng.randrange(10**7)}" for _ in range(4000)]
    texts = [part + [f"d{d}w{rng.randrange(10**7)}" for _ in range(3000)] for d in range(6)] + [base, base[:3300], base[:3100]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    # 3296 of 3996 shingles are 0.82; 3096 of 3996 are 0.77, but 0.94 of the second's
    assert sorted(r.doc_id for r in keep_one(df).collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_keep_one_finds_variants_of_a_common_text_and_variants_of_variants(spark):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base)), (1, " ".join(base))]
    for i in range(300):  # each 0.8 to 0.9 from the first, not from each other
        copy = [*base]
        for at in rng.sample(range(5, 145), 3):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((10 + i, " ".join(copy)))
        if i % 10 == 0:
            copy[74] = f"y{i}"
            rows.append((1000 + i, " ".join(copy)))
    common = " ".join(f"c{i}" for i in range(50))
    rows += [(2000 + i, common + " " + " ".join(f"o{i}w{j}" for j in range(60))) for i in range(300)]
    sets = [grams(t) for _, t in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {rows[r][0] for r in set(components_of(range(len(rows)), linked).values())}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r.doc_id for r in keep_one(df).collect()} == want and len(want) >= 301


def test_short_sets_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for base in range(150):
        text = [f"t{base}x{i}" for i in range(rng.randint(5, 16))]
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join([*text, f"e{base}"])), (len(rows) + 2, " ".join([f"s{base}", *text]))]
    sets = [grams(t) for _, t in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(max(0, a - 3), a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {rows[r][0] for r in set(components_of(range(len(rows)), linked).values())}
    assert linked and {r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_no_cap_drops_a_link(spark, monkeypatch):
    """Where the capped steps bring nothing together, the last one finds every link; large keys go in blocks."""
    capped = simhash._to_compare
    for name, value in (("MOST", -1), ("_to_compare", lambda *of: capped(*of).limit(0)), ("SMALL", 3), ("BLOCK", 5), ("COMMON", 4)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(13)
    rows, line = [], [f"hot{i}" for i in range(30)]
    for base in range(40):
        text = [f"p{base}w{i}" for i in range(rng.choice([6, 40, 150]))]
        for _ in range(rng.randint(1, 8)):
            copy = [*text]
            for at in rng.sample(range(len(copy)), rng.randint(0, max(1, len(copy) // 40))):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy + line * (base % 2))))
    rows += [(len(rows) + i, " ".join([*line, f"end{i}", *"ab"[: i % 3]])) for i in range(30)]  # nearly nothing but the line
    sets = [grams(t) for _, t in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {rows[r][0] for r in set(components_of(range(len(rows)), linked).values())}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert linked and {r.doc_id for r in keep_one(df).collect()} == want


def test_stages_take_nulls_empty_and_repeated_rows(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(None, None), (None, ""), (10**9, None), (10**9, None), (10**9 + 1, "word " * 30_000)], "doc_id long, text string")
    for c in columns[2:]:
        odd = odd.withColumn(c, F.lit(None).cast(docs.schema[c].dataType))
    full = docs.unionByName(odd.select(*columns)).withColumn("copy", F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, full, d)
        assert out.columns == full.columns and {r[0] for r in out.select("copy").distinct().collect()} == {"mine"}, name
        assert stage(spark, full.limit(0), d).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, full, d)
    assert packed.where("doc_id = 1000000000").count() == 2 and packed.where("doc_id is null").count() == 2
