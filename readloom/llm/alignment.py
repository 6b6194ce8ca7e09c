"""Alignment of two tokenizers' tokens: groups between common byte offsets, links between tokens that end together.

Inside mapInPandas both tokenizers cut each text. A two-pointer merge of their cumulative token ends emits a group
wherever both end, and a link between the two tokens that end there. Where both cut at spaces anyway (proved from the
files, as in op7 and op10), the merge runs once for each distinct word that a worker meets, and texts are put together
from their words; all other texts are merged whole.

A task deals its documents into chunks of bounded size. A chunk keeps for each document the numbers of its distinct
pairs in the chunk's list of pairs, and hands on that list with its totals. Spark's groupBy sums the totals to counts of
pairs over the corpus, takes each side's largest count, joins all three back to the chunks' lists, and a cogroup by
chunk sums them for the documents. A frequent pair is one row for each chunk, never one for each link.

Defined cases: null and empty texts have no tokens, nor have texts that one tokenizer's tokens don't spell; texts of any
length are aligned whole; rows with a null or repeated doc_id are rows each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import scratch, table, tidy
from readloom.llm.token_counts import MARK, Counter
from readloom.llm.tokenizing import ByteBpe

#: Links and rows of a chunk, and words that a worker keeps.
LINKS, ROWS, KEPT = 1 << 21, 4096, 500_000
SIDE = 32


def merged(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int]) -> tuple[int, str, list[int]]:
    """Number of groups, the groups as text, and a link (b id << SIDE | a id) for each pair of tokens that end together."""
    groups, links = [], []
    i = j = from_i = from_j = end_a = end_b = 0
    while i < len(a) and j < len(b):
        next_a, next_b = end_a + a_sizes[i], end_b + b_sizes[j]
        if next_a <= next_b:
            end_a, i = next_a, i + 1
        if next_b <= next_a:
            end_b, j = next_b, j + 1
        if end_a == end_b:
            links.append(b[j - 1] << SIDE | a[i - 1])
            groups.append(",".join(map(str, a[from_i:i])) + "|" + ",".join(map(str, b[from_j:j])))
            from_i, from_j = i, j
    return len(groups), ";".join(groups), links


class Aligner:
    """Tokens of a byte-level BPE file and of a sentencepiece model, aligned."""

    def __init__(self, a_path: str, b_path: str):
        self.bpe, self.counter = ByteBpe(a_path), Counter(b_path)
        self.bpe.library.encode_special_tokens = True  # their strings are plain text
        self.library = self.counter.library
        byte = {c: i for i, c in enumerate(self.bpe.alphabet)}
        n = self.bpe.library.get_vocab_size()
        spelt = lambda t: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.a_bytes = [spelt(self.bpe.library.id_to_token(i) or "") for i in range(n)]
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.by_words = self.bpe.plain and self.counter.split
        self.kept: dict[str, tuple[int, int, int, str, bytes] | None] = {}

    def _aligned(self, a: list[int], b: list[int], spelt: bytes) -> tuple[int, int, int, str, bytes] | None:
        """n_a, n_b, n_groups, groups, links (longs); None if the tokens of one side don't spell the text."""
        a_bytes, b_bytes = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_bytes) != spelt or b"".join(b_bytes) != spelt:
            return None
        n, groups, links = merged(a, b, [*map(len, a_bytes)], [*map(len, b_bytes)])
        return len(a), len(b), n, groups, np.array(links, dtype="<i8").tobytes()

    def whole(self, text: str) -> tuple[int, int, int, str, bytes] | None:
        a = np.frombuffer(self.bpe._whole(" " + text), dtype=self.bpe.type).tolist()
        return self._aligned(a, self.library.encode(text, num_threads=1), (" " + text).encode())

    def learn(self, texts: list[str]) -> None:
        """Aligns the words of texts that aren't known yet."""
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        if len(self.bpe.parts) > KEPT:
            self.bpe.parts.clear()
        words = [w for w in {w for t in texts for w in t.split(" ")} if w not in kept]
        for w, b in zip(words, self.library.encode(words, num_threads=1), strict=True):
            a = np.frombuffer(self.bpe._word(" " + w), dtype=self.bpe.type).tolist()
            kept[w] = self._aligned(a, b, (" " + w).encode())

    def align(self, text: str) -> tuple[int, int, int, str, bytes] | None:
        """As _aligned() for a text whose words learn() has seen, if it is one to be aligned by words."""
        if not self.simple(text):
            return self.whole(text)
        parts = [*map(self.kept.__getitem__, text.split(" "))]
        if None in parts:
            return self.whole(text)
        a, b, n, groups, links = zip(*parts, strict=True)
        return sum(a), sum(b), sum(n), ";".join(groups), b"".join(links)

    def simple(self, text: str) -> bool:
        return self.by_words and not (MARK in text or "  " in text or text[:1] == " " or text[-1:] == " " or "\0" in text)


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


FOUND = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, codes array<long>, totals array<long>"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a"]
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_a long"


def _chunks(a_path: str, b_path: str, most_links: int, most_rows: int):
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        number, both = (task.partitionId() if task else 0) << 32, aligner(a_path, b_path)
        rows: list[list] = []
        size = 0

        def chunk() -> pd.DataFrame:
            nonlocal number, size
            own = [r[7] for r in rows]
            codes, at = np.unique(np.concatenate([*own, np.zeros(0, "<i8")]), return_inverse=True)
            totals = np.bincount(at, weights=np.concatenate([*(r[8] for r in rows), np.zeros(0)]), minlength=len(codes)).astype("<i8")
            edges = np.cumsum([len(x) for x in own])
            for r, places in zip(rows, np.split(at.astype("<u4"), edges[:-1]), strict=True):
                r[0], r[7], r[8] = number, places.tobytes(), r[8].astype("<u4").tobytes()
            rows.append([number, None, *[None] * 7, codes, totals])
            out = pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[1:6]})
            rows.clear()
            number, size = number + 1, 0
            return out

        for frame in frames:
            for at in range(0, len(frame), 256):
                some = frame.iloc[at : at + 256]
                texts = [t if isinstance(t, str) else "" for t in some["text"]]
                both.learn([t for t in texts if t and both.simple(t)])
                for doc_id, text in zip(some["doc_id"], texts, strict=True):
                    found = both.align(text) if text else None
                    n_a, n_b, n, groups, links = found or (0, 0, 0, "", b"")
                    pairs, times = np.unique(np.frombuffer(links, dtype="<i8"), return_counts=True)
                    sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                    rows.append([None, None if pd.isna(doc_id) else int(doc_id), n_a, n_b, n, len(links) // 8, sha, pairs, times, None, None])
                    size += len(pairs)
                    if size >= most_links or len(rows) >= most_rows:
                        yield chunk()
        if rows:
            yield chunk()
        tidy()

    return run


def _summed(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """A chunk's documents with the sums over their links; pairs: what is known of the chunk's pairs, by place."""
    n = len(pairs)
    count, best, best_a = (np.zeros(n, dtype=np.int64) for _ in range(3))
    place = pairs["place"].to_numpy()
    count[place], best[place], best_a[place] = pairs["n"].to_numpy(), pairs["best"].to_numpy(), pairs["best_a"].to_numpy()
    out = []
    for own, times in zip(docs["pairs"], docs["times"], strict=True):
        at, k = np.frombuffer(own, dtype="<u4"), np.frombuffer(times, dtype="<u4").astype(np.int64)
        out.append((int(k @ best[at]), int(k @ count[at]), int(k @ best_a[at])))
    return docs.assign(**{c: [x[i] for x in out] for i, c in enumerate(["n_best", "count_sum", "n_best_a"])})[COLUMNS].astype({"doc_id": "Int64"})


def aligned(docs: DataFrame, a_path: str, b_path: str, links: int = LINKS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a (links whose count is
    their A id's highest). And the pairs of ids: a, b, n, best (of b), best_a.
    """
    spark = docs.sparkSession
    path = scratch(spark, "aligned")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held.mapInPandas(_chunks(a_path, b_path, links, rows), FOUND).write.parquet(path)
    found = spark.read.parquet(path)
    listed = found.where("codes is not null").select("chunk", F.posexplode(F.arrays_zip("codes", "totals")).alias("place", "x")).select("chunk", "place", "x.codes", "x.totals")
    low = F.lit((1 << SIDE) - 1)
    counts = listed.groupBy("codes").agg(F.sum("totals").alias("n")).select("codes", F.shiftright("codes", SIDE).alias("b"), F.col("codes").bitwiseAND(low).alias("a"), "n")
    counted = scratch(spark, "pairs")
    counts.write.parquet(counted)
    counts = spark.read.parquet(counted)
    tops = [counts.groupBy(side).agg(F.max("n").alias(f"top_{side}")) for side in "ab"]
    pairs = counts.join(tops[1], "b").join(tops[0], "a").select("codes", "a", "b", "n", (F.col("n") == F.col("top_b")).alias("best"), (F.col("n") == F.col("top_a")).alias("best_a"))
    known = listed.select(F.col("chunk").alias("of"), "place", "codes").join(pairs.select("codes", "n", F.col("best").cast("int").alias("best"), F.col("best_a").cast("int").alias("best_a")), "codes").drop("codes")
    texts = found.where("codes is null").drop("codes", "totals")
    return texts.groupBy("chunk").cogroup(known.groupBy("of")).applyInPandas(_summed, RESULT), pairs.drop("codes")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
