"""Near-duplicates by SimHash, candidates by pigeonring filtering.

Fingerprint: XXH64 (seed 42) of every word shingle, repeats included; a bit is set where over half the hashes set it.
Copies collapse first: links are searched between distinct fingerprints. For at most t differing bits the fingerprint
is a ring of t + 1 segments. By the pigeonring principle two linked fingerprints have a segment from which every chain
of l consecutive segments differs in at most floor(l * t / (t + 1)) = l - 1 bits: the first is equal, the first two
differ in at most one bit, and so on. The first two segments make the join key (one side is expanded by the one-bit
changes of the second segment), the third prefix is checked next, and the full distance last. All of this is exact:
no bucket is capped. Links go through components(); no pairs of copies are made.

Defined cases: a null text counts as empty; texts without a word have fingerprint zero and link like any other; a
null doc_id never becomes a component_id unless no member has one; repeated rows are members each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from readloom.llm.common import cut, table, tidy
from readloom.llm.components import components

#: Hashes unpacked to bits at a time.
STEP = 1 << 16


def shingles(text: str, k: int) -> list[bytes]:
    """The k-word shingles of a text, A-Z in lower case; the whole sequence if it has fewer words."""
    words = text.encode().lower().split()  # on bytes both know ASCII only: A-Z, and 0x20 and 0x09-0x0D
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return [*map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))]


def fingerprint(text: str, k: int) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles(text, k)], dtype="<u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and __rl_fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t or "", k) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "__rl_fp"])
        tidy()

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, "doc_id long, __rl_fp long")


def _ring(t: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the t + 1 segments."""
    edges = [64 * i // (t + 1) for i in range(t + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bits(value: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) of the distinct values of column __rl_fp that differ in 1 to t bits; a pair may come up twice."""
    if not 1 <= t <= 7:
        raise ValueError("t must be 1 to 7: segments of 8 bits at least")
    ring = _ring(t)
    m, fp = len(ring), F.col("__rl_fp")

    def key(i: int, flip: Column | None) -> Column:
        """Segment number, segment i and the one after it, whose bits may be changed."""
        (low, width), (low2, width2) = ring[i], ring[(i + 1) % m]
        second = _bits(fp, low2, width2)
        second = second if flip is None else second.bitwiseXOR(flip)
        return F.lit(i << 58).bitwiseXOR(F.shiftleft(_bits(fp, low, width), 29)).bitwiseXOR(second)

    def chain(i: int, length: int, x: Column) -> Column:
        return sum((F.bit_count(_bits(x, *ring[(i + j) % m])) for j in range(length)), F.lit(0))

    stored = prints.select(fp.alias("b"), F.explode(F.array(*[key(i, None) for i in range(m)])).alias("key"))
    # flip number 0 is no change
    most = max(width for _, width in ring)
    flips = prints.select("__rl_fp", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("n"))
    change = F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, n - 1)"))
    wide = lambda i: ring[(i + 1) % m][1]
    probes = flips.select(fp.alias("a"), F.explode(F.array(*[F.when(F.col("n") <= wide(i), key(i, change)) for i in range(m)])).alias("key")).where("key is not null")
    x, number = F.col("a").bitwiseXOR(F.col("b")), F.shiftrightunsigned(F.col("key"), 58)
    third = F.lit(True)
    for i in range(m) if m > 2 else []:
        third = third & ((number != i) | (chain(i, 3, x) <= 2))
    return probes.join(stored, "key").where((F.col("a") < F.col("b")) & third & (F.bit_count(x) <= t)).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 3, t: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable by links) of every row."""
    prints = cut(fingerprints(docs, k))
    groups = cut(prints.groupBy("__rl_fp").agg(F.min("doc_id").alias("__rl_least")))
    roots = components(links(groups, t))
    groups = groups.join(roots.withColumnRenamed("node", "__rl_fp"), "__rl_fp", "left").withColumn("root", F.coalesce("root", "__rl_fp"))
    names = groups.groupBy("root").agg(F.min("__rl_least").alias("component_id"))
    named = groups.join(names, "root").select("__rl_fp", "component_id")
    return prints.join(named, "__rl_fp").select("doc_id", F.lower(F.lpad(F.hex("__rl_fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, t=3)


# --- documents of a similarity or more, for cleaning a corpus -----------------------------------------------------

#: Bits of the long fingerprint, of a segment, and how many consecutive segments make a key.
LONG, SEGMENT, CHAIN = 256, 8, 2
#: Beyond MOST differing bits documents are no candidates by their fingerprints.
MOST = 56
#: In a bucket of at most so many documents each is held against each, in a larger one against its hub.
SMALL = 16
#: Rows with one key that a row is held against in one task, see _rest().
BLOCK = 4096
#: Documents, and hashes of each, that tell which hashes are common, and how many of them have such a hash at least.
COMMON_DOCS, COMMON_HASHES, COMMON = 10_000, 512, 8
#: Ids up to which a list of them is broadcast (16 MB); beyond it the join is a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows whose sets of shingles are held at a time.
ROWS = 1024
PARTS = [f"__rl_f{i}" for i in range(LONG // 64)]
#: Bits of a set's parities, see parities().
PARITIES = 1024
#: Ranges of the hashes in which the members of long sets are counted, see counts().
RANGES = 2048
#: The 128-bit digest of a document's set of shingles.
SET = ["__rl_s0", "__rl_s1"]


def shingle_set(text: str, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the distinct shingles of a text, in ascending order."""
    import xxhash

    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, k)], dtype="<u8"))


def set_digest(hashes: np.ndarray) -> list[int]:
    """128 bits of a set of shingles as two signed numbers."""
    import xxhash

    return np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), dtype="<i8").tolist()


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The 256-bit SimHash of a set of shingles as four unsigned numbers: each hash is spread to 256 bits by a mixer."""
    ones = np.zeros(LONG, dtype=np.int64)
    for at in range(0, len(hashes), STEP):
        some = hashes[at : at + STEP, None] + np.arange(LONG // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            some = (some ^ some >> np.uint64(shift)) * np.uint64(factor)
        some = np.ascontiguousarray(some ^ some >> np.uint64(31))
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, LONG // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def _common(held: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Common hashes in ascending order and their ranks (from 1, the more common the higher), told by some COMMON_DOCS documents.

    They only set the order of a set's hashes, see prefix(): whatever is common here, no pair is missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            sets = [shingle_set(t or "", k)[:COMMON_HASHES].view(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else [], pa.int64())], ["h"])
        tidy()

    some = held.select("text").sample(min(1.0, COMMON_DOCS / max(held.count(), 1)), seed=1)
    found = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).toArrow()
    hashes, n = found["h"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy()
    rank = np.empty(len(n), dtype=np.int64)
    rank[np.lexsort((hashes, n))] = np.arange(1, len(n) + 1)
    order = np.argsort(hashes)
    return hashes[order], rank[order]


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first hashes of a set, rare ones before common ones: so many that two similar sets have one of them in common.

    Of n hashes at least similarity * n are in a similar set. So of the first n - similarity * n + 1 one is, and the
    first hash that two such sets share is among these of both.
    """
    n = len(hashes)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.argsort(np.where(common[at] == hashes, rank[at], 0), kind="stable")]
    return hashes[: n - math.ceil(similarity * n - 1e-6) + 1]


def _distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))) for p in PARTS), F.lit(0))


def _keys(nodes: DataFrame) -> DataFrame:
    """nodes with a row for each place of the ring: __rl_key is the place and the CHAIN segments from there."""
    m = LONG // SEGMENT
    segment = lambda i: F.shiftrightunsigned(F.col(PARTS[i * SEGMENT // 64]), i * SEGMENT % 64).bitwiseAND(F.lit((1 << SEGMENT) - 1).cast("long"))
    keys = []
    for i in range(m):
        key = F.lit(i).cast("long")
        for j in range(CHAIN):
            key = F.shiftleft(key, SEGMENT).bitwiseXOR(segment((i + j) % m))
        keys.append(key)
    return nodes.withColumn("__rl_key", F.explode(F.array(*keys)))


def parities(hashes: np.ndarray) -> list[int]:
    """PARITIES bits as signed numbers: whether an odd number of the hashes falls into each of as many ranges.

    Two sets differ in at least as many elements as these bits do.
    """
    odd = np.bincount((hashes >> np.uint64(64 - (PARITIES.bit_length() - 1))).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def counts(hashes: np.ndarray) -> bytes:
    """How many of the hashes fall into each of RANGES ranges, a byte each, 255 for more.

    Two sets differ in at least as many elements as these numbers do in sum.
    """
    found = np.bincount((hashes >> np.uint64(64 - (RANGES.bit_length() - 1))).astype(np.int64), minlength=RANGES)
    return np.minimum(found, 255).astype(np.uint8).tobytes()


def _small(rows: DataFrame) -> DataFrame:
    """rows of ids, to be broadcast where there are at most BROADCAST_IDS of them."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _of_sets(pairs: DataFrame, held: DataFrame, nodes: DataFrame, k: int, what, kind: str) -> DataFrame:
    """node and value, what(set), of each node of the pairs (a, b)."""
    to = pa.binary() if kind == "binary" else pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            found, values = [], []
            for node, *digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = shingle_set(text or "", k)
                if set_digest(hashes) == digest:  # else another row with this doc_id
                    found.append(node)
                    values.append(what(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(values, to)], ["node", "value"])
        tidy()

    firsts = nodes.select(F.col("node").alias("__rl_node"), F.col("least.doc_id").alias("__rl_id"), *SET)
    involved = pairs.select(F.col("a").alias("__rl_node")).unionByName(pairs.select(F.col("b").alias("__rl_node"))).distinct()
    wanted = _small(cut(firsts.join(involved, "__rl_node")))
    texts = held.join(wanted, held["doc_id"].eqNullSafe(wanted["__rl_id"])).select("__rl_node", *SET, "text")
    return texts.mapInArrow(run, f"node long, value {kind}").dropDuplicates(["node"])


def _alike(pairs: DataFrame, held: DataFrame, nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets of shingles are similar enough.

    held: doc_id and text of the documents; nodes: node, least (with doc_id, a document that has its set), SET, size
    and parities of the set. Pairs whose parities or counts prove them too different end there.
    """
    known = nodes.select("node", "size", "parities")
    both = pairs.join(known.toDF("a", "na", "pa"), "a").join(known.toDF("b", "nb", "pb"), "b")
    pairs = cut(both.where(_differ("pa", "pb") <= (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-6).select("a", "b", "na", "nb"))
    short = PARITIES  # parities tell less of larger sets: counts come before the sets, which are large
    long_ = pairs.where(F.col("na") + F.col("nb") > short)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            a, b, na, nb, ca, cb = (batch.column(c) for c in ("a", "b", "na", "nb", "ca", "cb"))
            x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(-1, RANGES).astype(np.int16) for c in (ca, cb))
            near = np.abs(x - y).sum(axis=1) <= (1 - similarity) / (1 + similarity) * (na.to_numpy() + nb.to_numpy()) + 1e-6
            yield pa.RecordBatch.from_arrays([pa.array(c.to_numpy()[near]) for c in (a, b)], ["a", "b"])

    told = _of_sets(long_, held, nodes, k, counts, "binary")
    long_ = long_.join(told.toDF("a", "ca"), "a").join(told.toDF("b", "cb"), "b").mapInArrow(near, "a long, b long")
    pairs = cut(pairs.where(F.col("na") + F.col("nb") <= short).select("a", "b").unionByName(long_))
    sets = _of_sets(pairs, held, nodes, k, lambda hashes: hashes.view(np.int64), "array<long>")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _held_against_smallest(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's smallest node and its others: no more than there are places for each node."""
    keyed = _keys(nodes).withColumn("m", F.min(F.struct("node", *PARTS)).over(Window.partitionBy("__rl_key"))).where("node <> m.node")
    return keyed.where(_distance("", "m.") <= MOST).select(F.col("node").alias("a"), F.col("m.node").alias("b")).distinct()


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ROWS rows: sets of shingles are as large as the texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with the root of each one's group; a node without a link is its own."""
    return nodes.join(_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _in_several_groups(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (node, size, pos, __rl_key) whose key nodes of several groups have, with their root."""
    rows = _rooted(rows, roots)
    # partial sums take care of keys that many have; most keys have one group and end here
    told = rows.groupBy("__rl_key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("__rl_key")
    return cut(rows.join(_small(cut(told)), "__rl_key").select("node", "size", "pos", "__rl_key", "root"))


def _with_fame(rows: DataFrame) -> DataFrame:
    """node, size, root, __rl_key and fame, see _to_compare()."""
    many = rows.groupBy("__rl_key").agg(F.count("*").alias("n"))
    fame = rows.join(many, "__rl_key").groupBy("node").agg(F.sum("n").alias("fame"))
    return cut(rows.drop("pos").join(fame, "node"))


def _to_compare(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes in different groups that have a key in common and fit in size.

    All such pairs of a key that at most SMALL rows have. In a larger one every node is held against one, its hub:
    that whose keys the most nodes have, which is the text that the others vary. So there are no more than SMALL
    pairs for each row. What a hub doesn't bring together is left to _rest().
    """
    fits = F.least("size", "o.size") >= similarity * F.greatest("size", "o.size") - 1e-9
    hub = F.max(F.struct("fame", "node", "root", "size")).alias("o")
    told = rows.groupBy("__rl_key").agg(F.count("*").alias("n"), F.min("root").alias("lowest"), F.max("root").alias("highest"), hub).where("lowest < highest").drop("lowest", "highest")
    held = rows.join(_small(cut(told)), "__rl_key").where((F.col("n") <= SMALL) | (F.col("root") != F.col("o.root")) & fits)
    pair = [F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")]
    large = held.where(F.col("n") > SMALL).select(*pair)
    members = held.where(F.col("n") <= SMALL).groupBy("__rl_key").agg(F.collect_list(F.struct("node", "root", "size")).alias("all"))
    two = members.select("all", F.explode("all").alias("x")).select("x.*", F.explode("all").alias("o")).where((F.col("node") < F.col("o.node")) & (F.col("root") != F.col("o.root")) & fits)
    return large.unionByName(two.select(*pair)).distinct()


def _differ(a: str, b: str) -> Column:
    """In how many of their parities two sets differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(PARITIES // 64)), F.lit(0))


def _rest(rows: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of nodes in different groups that may be similar: no cap, so that the groups found with it are exact.

    rows: node, size, pos and __rl_key of the nodes' prefixes.

    Similar nodes have a hash of their prefixes in common. All nodes of different groups that have one are held against
    each other, those of a key that very many have in blocks: a task holds BLOCK of its rows and passes the others by. Only
    pairs become rows whose sizes, places of the first common hash and parities don't prove them too different.
    """
    rows = _in_several_groups(rows, roots)
    rows = cut(rows.join(rows.groupBy("__rl_key").agg(F.count("*").alias("n")), "__rl_key"))
    # a key that few have makes few pairs, which are looked at by _alike(): only with large keys do the parities travel
    few = rows.where(F.col("n") <= SMALL).withColumn("parities", F.lit(None).cast("array<long>"))
    rows = few.unionByName(rows.where(F.col("n") > SMALL).join(nodes.select("node", "parities"), "node").select(*few.columns))
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = cut(rows.select("__rl_key", F.struct("node", "root", "size", "pos", "parities").alias("x"), blocks.cast("int").alias("blocks")))
    passed = rows.select("__rl_key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("x").alias("o"))
    held = rows.select("__rl_key", F.pmod(F.xxhash64("x.node"), F.col("blocks")).cast("int").alias("block"), "x")
    both = F.col("x.size") + F.col("o.size")
    # before the first common hash the two have nothing in common
    enough = F.least(F.col("x.size") - F.col("x.pos"), F.col("o.size") - F.col("o.pos")) >= similarity / (1 + similarity) * both - 1e-6
    near = F.col("x.parities").isNull() | (_differ("x.parities", "o.parities") <= (1 - similarity) / (1 + similarity) * both + 1e-6)
    apart = (F.col("o.node") < F.col("x.node")) & (F.col("o.root") != F.col("x.root"))
    return passed.join(held, ["__rl_key", "block"]).where(apart & enough & near).select(F.col("o.node").alias("a"), F.col("x.node").alias("b")).distinct()


def _all_links(nodes: DataFrame, held: DataFrame, k: int, similarity: float) -> DataFrame:
    """node, root of every node that is joined to another by links."""
    links = cut(_alike(_held_against_smallest(nodes.select("node", *PARTS)), held, nodes, k, similarity))
    roots = components(links)
    rows = _in_several_groups(nodes.select("node", "size", F.posexplode("prefix").alias("pos", "__rl_key")), roots)
    pairs = cut(_to_compare(_with_fame(rows), similarity))
    links = cut(links.unionByName(_alike(pairs, held, nodes, k, similarity)))
    roots = components(links)
    pairs = cut(_rest(rows.drop("root"), nodes, roots, similarity))
    return roots if pairs.isEmpty() else components(links.unionByName(_alike(pairs, held, nodes, k, similarity)))


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest doc_id.

    Groups are joined by links between documents whose sets of k-word shingles have a Jaccard similarity of
    `similarity` or more. Documents with equal sets are one from the start; every other link is compared on its two
    sets. Most links are found by SimHash: documents with CHAIN consecutive equal segments somewhere on the ring of a
    256-bit fingerprint of their distinct shingles, and at most MOST differing bits, are candidates; each bucket's
    members are held against the bucket's smallest. What this leaves in different groups is looked up by the hashes of
    its prefix, see prefix(), first with hubs in place of what many have in common. These two steps are capped (they make
    no more than 32 pairs for a document and SMALL for each hash) and only spare the last one work: all that is still in
    different groups and has a hash of its prefix in common is compared, see _rest(), which misses no link.

    Null and empty texts are alike; rows without doc_id stay only if their group has no doc_id; of repeated rows one
    stays; an empty table gives no rows.
    """
    names = docs.columns
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common, rank = _common(held, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            sets = [shingle_set(t or "", k) for t in batch.column("text").to_pylist()]
            prints = np.array([long_fingerprint(x) for x in sets], dtype=np.uint64).reshape(-1, len(PARTS)).view(np.int64)
            digests = np.array([set_digest(x) for x in sets], dtype=np.int64).reshape(-1, len(SET))
            columns = [*(pa.array(digests[:, i]) for i in range(len(SET))), *(pa.array(prints[:, i]) for i in range(len(PARTS))), pa.array([len(x) for x in sets], pa.int64())]
            columns += [pa.array([parities(x) for x in sets], pa.list_(pa.int64())), pa.array([prefix(x, similarity, common, rank).view(np.int64) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *SET, *PARTS, "size", "parities", "prefix"])
        tidy()

    prints = cut(held.mapInArrow(run, "doc_id long, " + ", ".join(f"{p} long" for p in (*SET, *PARTS)) + ", size long, parities array<long>, prefix array<long>"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    # what depends on the set alone is the same in all rows of a group
    nodes = prints.groupBy(*SET).agg(F.min(order).alias("least"), *(F.first(c).alias(c) for c in (*PARTS, "size", "parities", "prefix")), F.count("*").alias("copies"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    rooted = cut(_rooted(nodes.select("node", "least", *SET, "copies"), _all_links(nodes, held, k, similarity)))
    kept = rooted.groupBy("root").agg(F.min(F.struct("least", *SET)).alias("w"), F.sum("copies").alias("copies"))
    # rows to leave out: all of a group but one; only groups of several are looked at
    of_several = rooted.join(kept.where("copies > 1").select("root", F.col("w.least.doc_id").alias("__rl_id")), "root").select(*SET, "__rl_id")
    out = prints.select("doc_id", *SET).join(_small(cut(of_several)), SET).where(~F.col("doc_id").eqNullSafe(F.col("__rl_id"))).select("doc_id")
    # a doc_id that is null or on several rows doesn't tell which row it is: the text does
    unsure = cut(prints.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"))
    many = _small(cut(out.where("doc_id is not null").unionByName(unsure.where("doc_id is not null")).distinct()).withColumnRenamed("doc_id", "__rl_out"))
    sure = docs.where("doc_id is not null").join(many, F.col("doc_id").cast("long") == F.col("__rl_out"), "left_anti").select(*names)
    if unsure.isEmpty():
        return sure
    ids = _small(unsure.withColumnRenamed("doc_id", "__rl_out"))
    rest = _with_digest(docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("__rl_out")), "left_semi"), k)
    kept = kept.select(F.col("w.least.doc_id").alias("__rl_id"), *(F.col(f"w.{s}").alias(f"__rl_w{i}") for i, s in enumerate(SET)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__rl_id")) & (F.col(SET[0]) == F.col("__rl_w0")) & (F.col(SET[1]) == F.col("__rl_w1"))
    return sure.unionByName(rest.join(kept, same).dropDuplicates(["__rl_id", *SET]).select(*names))


def _with_digest(docs: DataFrame, k: int) -> DataFrame:
    """docs with the digest of each text's set of shingles in the columns SET."""
    schema = StructType([*docs.schema.fields, *(StructField(s, LongType()) for s in SET)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.string()).to_pylist()
            digests = np.array([set_digest(shingle_set(t or "", k)) for t in texts], dtype=np.int64).reshape(-1, len(SET))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(digests[:, i]) for i in range(len(SET)))], [*batch.schema.names, *SET])
        tidy()

    return docs.mapInArrow(run, schema)
