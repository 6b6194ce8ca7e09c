"""Toxicity: a counterfactual-regularised linear classifier.

Features are the distinct words of a text, in lower case, and their prefixes of 4 to 6 letters (invented endings and
obfuscations keep the stem). In labelled texts the identity terms are swapped for others of their group; besides
the logistic loss and an L1 penalty, training penalises the square of the score's change under the swap, so that a
neutral mention of a group does not raise the score. Learning uses a bounded sample of labelled rows: at most about
`per_class` of each label by hash, weighted back to the true shares. Scoring reads every whole text, once.

Defined cases: a null or empty text gets the score of no features; labels whose doc_id is null, whose `toxic` is null
or that have no document teach nothing, a document with several labels counts as toxic if one says so, a doc_id on several rows teaches its smallest text; a row with
null doc_id is scored and held out; without any usable labels every score is 0; repeated rows are scored each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from readloom.llm.common import table, tidy, unit

#: Labelled rows of each class to learn from, about.
PER_CLASS = 3_000
#: Terms of a group stand for each other in counterfactuals.
IDENTITY = (
    "women men girls boys females males",
    "woman man girl boy female male",
    "she he",
    "her his",
    "muslims christians jews hindus buddhists atheists catholics protestants",
    "muslim christian jewish hindu buddhist atheist catholic protestant",
    "black white asian latino hispanic african european arab indian native",
    "blacks whites asians latinos africans europeans arabs indians",
    "gay lesbian straight bisexual transgender queer heterosexual",
    "gays lesbians",
    "immigrant refugee foreigner citizen",
    "immigrants refugees foreigners citizens",
    "disabled deaf blind autistic",
    "old young elderly",
    "mexican chinese german french spanish american russian british turkish polish italian japanese",
    "mexicans germans americans russians turks poles italians",
    "frauen männer mädchen jungen",
    "frau mann",
    "muslime christen juden hindus",
    "ausländer flüchtlinge deutsche franzosen spanier türken polen",
    "femmes hommes filles garçons",
    "femme homme fille garçon",
    "musulmans chrétiens juifs",
    "mujeres hombres niñas niños",
    "mujer hombre niña niño",
    "musulmanes cristianos judíos",
)
SWAPS = {w: [x for x in group.split() if x != w] for group in IDENTITY for w in group.split()}
WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 22
PREFIXES = (4, 5, 6)


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(word: str) -> tuple[int, ...]:
    """The hashed features of a word: itself and its prefixes."""
    data = [f"w {word}"] + [f"{n} {word[:n]}" for n in PREFIXES if len(word) > n]
    return tuple(zlib.crc32(x.encode()) % BUCKETS for x in data)


def features(distinct: set[str]) -> np.ndarray:
    return np.unique(np.array([f for w in distinct for f in features_of(w)], dtype=np.uint32))


def swapped(distinct: set[str]) -> set[str] | None:
    """The words with every identity term replaced by another of its group, by hash; None without such terms."""
    terms = {w for w in distinct if w in SWAPS}
    if not terms:
        return None
    return (distinct - terms) | {SWAPS[w][zlib.crc32(w.encode()) % len(SWAPS[w])] for w in terms}


class Sparse:
    """Rows of 0/1 features."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        # numbers of half the width: they are most of what the driver holds
        self.cols = np.concatenate([*rows, np.zeros(0, dtype=np.int32)], dtype=np.int32, casting="unsafe")
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(self.at))
        self.shape = (len(rows), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.cols], minlength=self.shape[0])

    def dot_t(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=r[self.row], minlength=self.shape[1])


def train(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, swaps: list[np.ndarray | None], counterfactual: float = 1.0, l1: float = 4e-4, steps: int = 150, rate: float = 0.08) -> tuple[dict[int, float], float]:
    """({feature: weight}, bias); swaps: the features of each row after the swap of identity terms, or None."""
    if not len(labels) or not weights.sum():
        return {}, float("-inf")
    df = np.zeros(BUCKETS, dtype=np.int32)
    for r in rows:  # a row's features are distinct
        df[r] += 1
    kept = np.nonzero((df >= 3) & ((df <= 0.5 * len(rows)) | (len(rows) < 50)))[0]
    useful = np.zeros(BUCKETS, dtype=bool)
    useful[kept] = True
    rows = [r[useful[r]] for r in rows]
    w, b = _descend(rows, labels, weights, swaps, kept, counterfactual, l1, steps, rate)
    # the features found, once more with little of the penalty that had shrunk them
    kept = kept[np.abs(w) >= 0.05]
    w, b = _descend(rows, labels, weights, swaps, kept, counterfactual, l1 / 20, 2 * steps, 2 * rate)
    return {int(f): float(x) for f, x in zip(kept, w, strict=True) if x}, float(b)


def _descend(rows, labels, weights, swaps, kept: np.ndarray, counterfactual: float, l1: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Weights of the kept features and bias, by Adam on all rows with the penalty's zeros held."""
    index = np.full(BUCKETS, -1, dtype=np.int32)
    index[kept] = np.arange(len(kept))
    compact = lambda r: (c := index[r])[c >= 0]
    x = Sparse([compact(r) for r in rows], len(kept))
    changed = [i for i, s in enumerate(swaps) if s is not None]
    before, after = Sparse([compact(rows[i]) for i in changed], len(kept)), Sparse([compact(swaps[i]) for i in changed], len(kept))
    share, part = weights / weights.sum(), counterfactual * weights[changed] / max(weights[changed].sum(), 1e-12)
    w, prior = np.zeros(len(kept)), np.clip((share * labels).sum(), 1e-4, 1 - 1e-4)
    b, m, v, mb, vb = float(np.log(prior / (1 - prior))), np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + b, -40, 40)))
        r = share * (p - labels)
        g, gb = x.dot_t(r) + l1 * np.sign(w), r.sum()
        if changed:
            d = 2 * part * (before.dot(w) - after.dot(w))
            g += before.dot_t(d) - after.dot_t(d)
        # where the loss can't pay for the penalty a zero weight stays zero
        g[(w == 0) & (np.abs(g) <= l1)] = 0
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        pace = rate * min(1.0, 4 * (1 - t / (steps + 1)))
        fresh = w - pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        fresh[(w != 0) & (np.sign(fresh) != np.sign(w))] = 0  # the penalty stops at zero
        w, b = fresh, b - pace * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, counterfactual: float = 1.0) -> tuple[dict[int, float], float]:
    """A model from the labelled documents that are not held out."""
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__rl_toxic")).where(~held_out())
    sizes = {r[0]: r[1] for r in known.groupBy(F.col("__rl_toxic") == 1).count().collect()}
    limit = F.when(F.col("__rl_toxic") == 1, per_class / max(sizes.get(True, 0), 1)).otherwise(per_class / max(sizes.get(False, 0), 1))
    u = unit(11, "doc_id")
    chosen = known.where(u < limit).orderBy(u, "doc_id").limit(4 * per_class)  # about 2 * per_class rows of three columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distinct = [words(t or "") for t in batch.column("text").to_pylist()]
            other = [swapped(d) for d in distinct]
            yield pa.RecordBatch.from_arrays([
                batch.column("toxic"), pa.array([features(d).tobytes() for d in distinct], pa.binary()), pa.array([None if o is None else features(o).tobytes() for o in other], pa.binary()),
            ], ["toxic", "features", "swapped"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # a doc_id on several rows teaches once, with the smallest text
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max(F.col("__rl_toxic").cast("int")).alias("toxic"))
    found: pd.DataFrame = sample.select("text", "toxic").mapInArrow(run, "toxic int, features binary, swapped binary").toPandas()
    found = found.sort_values(["toxic", "features"], kind="stable")
    array = lambda b: None if b is None else np.frombuffer(b, dtype=np.uint32)
    y = (found["toxic"] == 1).to_numpy().astype(np.float64)
    rows, swaps = [array(b) for b in found["features"]], [array(b) for b in found["swapped"]]
    del found
    scale = {True: sizes.get(True, 0) / max(y.sum(), 1), False: sizes.get(False, 0) / max((1 - y).sum(), 1)}
    model = train(rows, y, np.where(y == 1, scale[True], scale[False]), swaps, counterfactual)
    del rows, swaps
    tidy()
    return model


class Scorer(dict):
    """The features with a weight of each word seen so far."""

    def __init__(self, weights: dict[int, float], bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(f for f in features_of(word) if f in self.weights)
        if len(self) > 200_000:
            self.clear()
        self[word] = found
        return found

    def score(self, text: str) -> float:
        on = set().union(*map(self.__getitem__, words(text)))
        z = self.bias + sum(sorted(self.weights[f] for f in on))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40)))) if z > float("-inf") else 0.0


def score(docs: DataFrame, model: tuple[dict[int, float], float], threshold: float = 0.7) -> DataFrame:
    """docs' rows with the columns __rl_score and __rl_predicted (1 from the threshold on)."""
    schema = StructType([*docs.schema.fields, StructField("__rl_score", DoubleType())])
    packed = json.dumps([sorted(model[0].items()), model[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = json.loads(packed)
        scorer = Scorer(dict(map(tuple, weights)), bias)
        for batch in batches:
            scores = pa.array([scorer.score(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "__rl_score"])
        del scorer
        tidy()

    out = docs.mapInArrow(run, schema)
    return out.withColumn("__rl_predicted", (F.col("__rl_score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels, per_class)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, threshold)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__rl_score").alias("score"), F.col("__rl_predicted").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.7)
