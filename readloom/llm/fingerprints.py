"""Document fingerprints by a homomorphic multiset hash.

A document is the multiset of its paragraphs, the pieces between line ends. Every paragraph is hashed to a wide vector and
a document's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo 2 ** 32. So the order of paragraphs
doesn't matter, and a paragraph is put in or taken out by adding or subtracting its vector (`added`, `removed`), without
the rest of the text. A vector has two zones: the first IDENTITY lanes are the paragraph's SHA-512, cut up, and tell
equal multisets from others; the next LIKENESS lanes count, for each of as many hash bits, the paragraph's sentences
that have the bit set, and the last counts its sentences. Centred, the counts are a sketch of inner products:
`likeness` is 2ab / (aa + bb), 1 for equal fingerprints and about the share of common sentences otherwise.

Only DataFrame functions run here. Rows are exploded to sentences and summed by sums of plain columns, in the task that
holds the row; a document is never a list of its pieces.

The query needs each document's successor in descending doc_id order. Documents are dealt by ranges of that order into
buckets, whose borders are found on the keys alone; the first row of each bucket goes to the one before as well, as its
last, so that every row finds its successor inside its bucket. Whole texts are shuffled once.

Defined cases: a null text counts as empty; an empty text is one empty paragraph; texts of any length are hashed whole;
rows without doc_id come last, equal doc_ids in the order of their texts' hashes; repeated rows follow one another; a
single row is its own successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import table

#: Lanes of the two zones; the likeness zone has a multiple of 64.
IDENTITY, LIKENESS = 16, 128
#: Where a sentence ends.
SENTENCE = "(?<=[.!?]) "
#: Two bits of a hash, in the two halves of a long: up to 2 ** 31 sentences they are summed without a carry.
PAIR = 0x0000000100000001
#: Buckets for each shuffle partition, and rows of the keys that a bucket has about, at the least.
BUCKETS, ROWS = 2, 64


def _sums(paragraph: str, sentence: str, first: Column) -> list[Column]:
    """Sums of a group of sentence rows; `first` marks one row for each paragraph, with its SHA-512 in `paragraph`."""
    out = [F.sum(F.when(first, F.conv(F.substring(paragraph, 8 * i + 1, 8), 16, 10).cast("long")).otherwise(0)).alias(f"__i{i}") for i in range(IDENTITY)]
    for part in range(LIKENESS // 64):
        out += [F.sum(F.shiftrightunsigned(f"{sentence}{part}", j).bitwiseAND(F.lit(PAIR))).alias(f"__s{part}_{j}") for j in range(32)]
    return [*out, F.count("*").alias("__n")]


def _lanes() -> Column:
    """The array of lanes, each modulo 2 ** 32, of the columns made by _sums."""
    low = F.lit(0xFFFFFFFF)
    sums = [f"__s{part}_{j}" for part in range(LIKENESS // 64) for j in range(32)]
    return F.array(*[F.col(f"__i{i}").bitwiseAND(low) for i in range(IDENTITY)], *[F.col(s).bitwiseAND(low) for s in sums], *[F.shiftrightunsigned(s, 32) for s in sums], F.col("__n").bitwiseAND(low))


def vectors(rows: DataFrame, keys: list[str], text: str = "text", name: str = "lanes") -> DataFrame:
    """keys and the lanes (array of longs) of each row's text. keys name a row; rows with equal keys are summed."""
    paragraphs = rows.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("__p"))
    sentences = paragraphs.select(*keys, F.sha2(F.col("__p"), 512).alias("__d"), F.posexplode(F.split("__p", SENTENCE)).alias("__at", "__t"))
    hashed = sentences.select(*keys, "__at", "__d", *[F.xxhash64("__t", F.lit(part)).alias(f"__h{part}") for part in range(LIKENESS // 64)])
    return hashed.groupBy(*keys).agg(*_sums("__d", "__h", F.col("__at") == 0)).select(*keys, _lanes().alias(name))


def added(a: Column, b: Column) -> Column:
    """The fingerprint of two texts' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(0xFFFFFFFF)))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of what is left of a text when the paragraphs of b, which it holds, are taken out."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(0xFFFFFFFF)))


def text_of(lanes: Column) -> Column:
    """Eight hexadecimal digits for each lane of the identity zone, a colon, and the other lanes in base 64."""
    digits = lambda part: F.array_join(F.transform(part, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    rest = F.base64(F.unhex(digits(F.slice(lanes, IDENTITY + 1, LIKENESS + 1))))
    return F.concat(digits(F.slice(lanes, 1, IDENTITY)), F.lit(":"), F.translate(rest, "\r\n", ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints' lanes; 1 if they are equal, below 1 otherwise."""
    centred = lambda v: F.transform(F.slice(v, IDENTITY + 1, LIKENESS), lambda x: (2 * x - F.element_at(v, -1)).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    x, y = centred(a), centred(b)
    both = dot(x, x) + dot(y, y)
    share = F.when(both > 0, 2 * dot(x, y) / both).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(share, F.lit(1.0 - 2.0**-52))))


def _bucketed(docs: DataFrame) -> DataFrame:
    """doc_id, text, __h, __bucket, __guard of every row and of the guards: the first row of a bucket, in the one before.

    Buckets follow each other in descending doc_id order. Borders are the first keys of ranges of the keys; they go
    into the plan as an array that has as many elements as there are buckets, searched by halving.
    """
    spark = docs.sparkSession
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("__h", F.xxhash64("text"))
    # a null doc_id comes after all others
    key = F.struct(F.col("doc_id").isNull().alias("n"), (-F.coalesce(F.col("doc_id"), F.lit(0)).cast("decimal(20,0)")).alias("d"), F.col("__h").alias("h"))
    keys = held.select(key.alias("__key"))
    parts = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(parts, "__key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("__key").alias("first"), F.count("*").alias("rows"))
    found = ranged.orderBy("first").collect()  # a row for each bucket
    borders, rows = [], ROWS
    for r in found:
        if rows >= ROWS:
            borders.append(r["first"])
            rows = 0
        rows += r["rows"]
    if not borders:
        return held.withColumns({"__bucket": F.lit(0), "__guard": F.lit(0)})
    firsts = spark.createDataFrame([(i, b) for i, b in enumerate(borders)], "i int, b struct<n boolean, d decimal(20,0), h long>")
    all_ = F.broadcast(firsts.agg(F.array_sort(F.collect_list("b")).alias("__borders")))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        up = F.element_at("__borders", middle) <= F.col("__key")
        return F.struct(F.when(up, middle).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(middle - 1).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(borders).bit_length() + 1))
    bucket = F.aggregate(steps, F.struct(F.lit(1).alias("lo"), F.lit(len(borders)).alias("hi")), halve, lambda s: s["lo"] - 1)
    placed = held.withColumn("__key", key).crossJoin(all_)  # one row, of as many elements as there are buckets
    rows_ = placed.select("doc_id", "text", "__h", bucket.alias("__bucket"), F.lit(0).alias("__guard"))
    before = firsts.select(F.col("b").alias("__key"), F.pmod(F.col("i") - 1, F.lit(len(borders))).alias("__bucket"))
    guards = held.withColumn("__key", key).join(F.broadcast(before), "__key").dropDuplicates(["__key"])
    return rows_.unionByName(guards.select("doc_id", "text", "__h", "__bucket", F.lit(1).alias("__guard")))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, own and edited texts and __bucket, __row of every document and, as __guard 1, of every guard."""
    order = Window.partitionBy("__bucket").orderBy("__guard", F.desc_nulls_last("doc_id"), "__h", "text")
    n = F.length("text")
    rows = _bucketed(docs).withColumns({"__next": F.coalesce(F.lead("text").over(order), F.lit("")), "__row": F.row_number().over(order)})
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.expr("substring(__next, 1, length(text) div 2)"))
    return rows.select("__bucket", "__row", "__guard", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    keys = ["__bucket", "__row", "__guard", "doc_id", "n_chars"]
    pairs = with_next(docs).select(*keys, F.when(F.col("__guard") == 0, F.sha2("edited", 256)).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("text").alias("t")), F.struct(F.lit(1).alias("w"), F.col("edited").alias("t")))).alias("__x"))
    pairs = pairs.select(*keys, "edited_sha256", F.col("__x.w").alias("__w"), F.col("__x.t").alias("__text"))
    lanes = vectors(pairs, [*keys, "edited_sha256", "__w"], "__text")
    pick = lambda w: F.max(F.when(F.col("__w") == w, F.col("lanes")))
    both = lanes.groupBy(*keys, "edited_sha256").agg(pick(0).alias("own"), pick(1).alias("edited"))
    order = Window.partitionBy("__bucket").orderBy("__row")
    both = both.withColumn("next", F.lead("own").over(order)).where("__guard = 0")
    return both.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("own")).alias("fingerprint"), text_of(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


def query(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
