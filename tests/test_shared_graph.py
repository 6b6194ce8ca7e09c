"""One graph for all rounds of an assembly, tiles without a row for each length of a read, and no shuffle files left behind."""

import random
import time

from pyspark.sql import functions as F

from readloom.operators import extend, states
from readloom.sources.tables import cut, forget, written


def held(spark, seqs):
    return spark.createDataFrame(list(enumerate(sorted(seqs))), "read_id long, seq string").repartition(3).cache()


def made(length, n, letters="ACGT", extra=()):
    rng = random.Random(length * n)
    genome = "".join(rng.choices(letters, k=300))
    return sorted({genome[i : i + length] for i in (rng.randrange(300 - length) for _ in range(n))} | {*extra})


def test_rounds_share_the_graph(spark, monkeypatch):
    u, calls, found = held(spark, made(24, 90, extra=["A" * 24])), [], states._found

    def counted(*args):
        calls.append(args[1])
        return found(*args)

    want, left = [], u
    for number in range(3):
        seeds = cut(left.orderBy("read_id").limit(4).selectExpr("read_id AS seed_id", "seq"))
        contigs = cut(extend.extend(u, seeds, vote_floor=6))
        want += [(number, r.seed_id, r.seq, r.ext_len) for r in contigs.collect()]
        left = cut(extend.unused_reads(left, extend.tiles(u, contigs.selectExpr("seed_id AS contig_id", "seq"))))
    monkeypatch.setattr(states, "_found", counted)
    assert sorted(map(tuple, extend.assemble(u, None, 4, 3, vote_floor=6).collect())) == sorted(want)
    assert sum(texts is None for texts in calls) == 1


def test_longest_tiles(spark):
    """longest leaves out what best_tiles() doesn't take; all tiles are those of a plain search."""
    seqs = made(20, 60, "ACGTN", ["A" * 20, "A" * 19 + "C"])
    u, floor = held(spark, seqs), 8
    texts = [seqs[3] + seqs[5][4:], "A" * 30, "ACG" * 9, seqs[7]]
    contigs = spark.createDataFrame(list(enumerate(texts)), "contig_id long, seq string")
    want = set()
    for c, text in enumerate(texts):
        for to in range(20, len(text) + 1):
            window = text[to - 20 : to]
            lengths = [m for m in range(21) if any(s.startswith(window[20 - m :]) for s in seqs)]
            for m in [m for m in lengths if m >= floor] + [m for m in lengths if m < floor][-1:]:
                want |= {(c, i, to - m, 0, m) for i, s in enumerate(seqs) if s.startswith(window[20 - m :])}
    assert sorted(map(tuple, extend.tiles(u, contigs, floor).collect())) == sorted(want)
    few = extend.tiles(u, contigs, floor, longest=True)
    assert few.count() < len(want)
    rows = lambda df: sorted(map(tuple, extend.best_tiles(df).collect()))
    assert rows(few) == rows(extend.tiles(u, contigs, floor))


def test_longest_begins(spark):
    seqs = made(16, 80, "ACGTN")
    texts = sorted({s[i : i + n] for s in seqs[:20] for i in (0, 3) for n in (1, 5, 11)} | {"", "NNNNNNNNNNN", "TTTTTTTTTTT"})
    asked = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.land for r in states.longest_begins(held(spark, seqs), asked, 11).collect()}
    assert got == {t: max(m for m in range(len(t) + 1) if any(s.startswith(t[len(t) - m :]) for s in seqs)) for t in texts}


def shuffled(spark):
    time.sleep(1)  # files are removed in the background
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle")}


def test_no_shuffle_files_stay(spark):
    rows = spark.range(5000).repartition(4, F.col("id") % 7).groupBy("id").count()
    before = shuffled(spark)
    a, b = cut(rows), written(rows, "test")
    assert shuffled(spark) <= before
    assert a.count() == b.count() == 5000
    forget(b)
    assert rows.count() == 5000  # the plan that was written may run again
