"""Language identification by a linear-chain conditional random field over words.

A text's words (runs of letters) are a chain; each has a language. A run of more than PIECE letters, as in scripts
without spaces, is several elements of the chain that together hold all its trigrams. Scores of an element for a
language come from hashed features: the word in a lexicon of words seen often in training, the word's first and last
1, 3 and 4 letters with the boundary, character trigrams. Transition weights between languages are learned with them, by gradient ascent on the
likelihood, from code-switched sequences that are spliced from labelled texts. Labelling is by forward-backward over
the whole text; a document's language is the one with the highest mean marginal, which is its score.

Forward-backward runs on all words of a batch at a time: chunks of words give transfer matrices, a short scan over
each text's chunks gives the messages that enter them, and a second pass fills the chunks. This is exact.

Learning uses a bounded sample of the rows allowed: about `sample` documents by hash, evenly over the languages, and of
their texts `sequences` sequences of `length` words. Labelling reads every word of every text to its end.

Defined cases: a null text or one without a letter is `und` with score 0; rows with null doc_id are labelled and held
out; without labelled rows everything is `und`; repeated rows are labelled each; ties go to the first language in
alphabet order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from readloom.llm.common import table, tidy, unit

#: Documents to learn from, about.
SAMPLE = 2_400
BUCKETS = 1 << 16
CHUNK = 32
#: Letters of a run that are one element of a chain.
PIECE = 40
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Words of a batch that are labelled at a time.
AT_ONCE = 1 << 18


def elements(text: str) -> list[str]:
    """The chain of a text: its words in lower case; of a long run its pieces, each with two letters of the next."""
    words = WORD.findall(text.lower())
    if max(map(len, words), default=0) <= PIECE:
        return words
    out = []
    for word in words:
        w = f"^{word}$"
        out += [word] if len(word) <= PIECE else [f"+{w[at : at + PIECE + 2]}" for at in range(0, len(w) - 2, PIECE)]
    return out


def features_of(word: str, lexicon: frozenset[str] | dict) -> list[int]:
    """Hashed features of an element of a chain; ^ and $ stand for a word's ends."""
    w = word[1:] if word[0] == "+" else f"^{word}$"
    found = [w[i : i + 3] for i in range(len(w) - 2)]
    found += [f"p{w[:n]}" for n in (2, 4, 5) if len(w) > n and w[0] == "^"] + [f"s{w[-n:]}" for n in (2, 4, 5) if len(w) > n and w[-1] == "$"]
    if word in lexicon:
        found.append(f"l{word}")
    return [zlib.crc32(f.encode()) % BUCKETS for f in found]


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray, lexicon: list[str]):
        self.languages, self.weights, self.transitions, self.lexicon = languages, weights, transitions, frozenset(lexicon)


def _forward_backward(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (n, length, k), expected transitions (k, k) and the log likelihoods' normalisers of equal sequences.

    e: factors (n, length, k) of the words; t: factors (k, k) of the transitions."""
    n, length, k = e.shape
    a, b, scale = np.empty_like(e), np.empty_like(e), np.empty((n, length))
    for i in range(length):
        x = e[:, i] if i == 0 else (a[:, i - 1] @ t) * e[:, i]
        scale[:, i] = x.sum(axis=1)
        a[:, i] = x / scale[:, i, None]
    b[:, -1] = 1
    for i in range(length - 2, -1, -1):
        b[:, i] = ((b[:, i + 1] * e[:, i + 1]) @ t.T) / scale[:, i + 1, None]
    right = b[:, 1:] * e[:, 1:] / scale[:, 1:, None]
    return a * b, np.einsum("nik,nil->kl", a[:, :-1], right) * t, np.log(scale).sum(axis=1)


def learn(texts: list[str], langs: list[str], steps: int = 60, seed: int = 0, length: int = 48, sequences: int = 3000, rate: float = 0.1, l2: float = 1e-5) -> Model:
    """A model from labelled texts: sequences of `length` words, each spliced from one to three windows of texts."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    words = [elements(t) for t in texts]
    usable = [i for i, w in enumerate(words) if w]
    if not usable:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), [])
    counts = Counter(w for i in usable for w in set(words[i]))
    lexicon = sorted(w for w, n in counts.items() if n >= 3)
    number = {x: i for i, x in enumerate(languages)}
    of_language = [[i for i in usable if langs[i] == x] for x in languages]
    of_language = [x for x in of_language if x]
    index: dict[str, int] = {}
    ids, gold = np.zeros((sequences, length), dtype=np.int64), np.zeros((sequences, length), dtype=np.int64)
    for s in range(sequences):
        at = 0
        while at < length:
            doc = int(rng.choice(of_language[rng.integers(len(of_language))]))
            want = min(length - at, int(rng.integers(6, length + 1)))
            start = int(rng.integers(0, max(1, len(words[doc]) - want + 1)))
            for w in words[doc][start : start + want]:
                ids[s, at], gold[s, at] = index.setdefault(w, len(index)), number[langs[doc]]
                at += 1
    known = frozenset(lexicon)
    lists = [features_of(w, known) for w in index]
    flat, starts = np.array([f for x in lists for f in x]), np.cumsum([0, *map(len, lists)])[:-1]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    k = len(languages)
    w, t, first = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.ones(BUCKETS, dtype=bool)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    hits = np.bincount(gold[:, :-1].ravel() * k + gold[:, 1:].ravel(), minlength=k * k).reshape(k, k)
    for step in range(1, steps + 1):
        scores = np.add.reduceat(w[flat], starts, axis=0)[ids]
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        marginal, switched, _ = _forward_backward(e, np.exp(t))
        miss = marginal
        np.subtract.at(miss.reshape(-1, k), (np.arange(ids.size), gold.ravel()), 1)
        by_word = np.stack([np.bincount(ids.ravel(), weights=miss[:, :, j].ravel(), minlength=len(lists)) for j in range(k)], axis=1)
        gw = np.stack([np.bincount(flat, weights=by_word[owner, j], minlength=BUCKETS) for j in range(k)], axis=1) / sequences + l2 * w
        gt = (switched - hits) / sequences + l2 * t
        for g, x, m, v in ((gw, w, 0, 1), (gt, t, 2, 3)):
            moments[m], moments[v] = 0.9 * moments[m] + 0.1 * g, 0.99 * moments[v] + 0.01 * g * g
            x -= rate * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[v] / (1 - 0.99**step)) + 1e-6)
    return Model(languages, w.astype(np.float32), t, lexicon)


class Labeller:
    """Marginals of whole texts; keeps the scores of the words seen."""

    def __init__(self, model: Model):
        self.model, self.index, self.factors = model, {}, np.zeros((0, len(model.languages)))

    def _ids(self, words: list[list[str]]) -> np.ndarray:
        new = [*set().union(*map(set, words)).difference(self.index)]
        if len(self.index) + len(new) > 200_000:
            self.index, self.factors = {}, self.factors[:0]
            new = [*set().union(*map(set, words))]
        if new:
            lists = [features_of(w, self.model.lexicon) for w in new]
            scores = np.add.reduceat(self.model.weights[np.concatenate(lists)].astype(np.float64), np.cumsum([0, *map(len, lists)])[:-1], axis=0)
            self.index.update(zip(new, range(len(self.factors), len(self.factors) + len(new)), strict=True))
            self.factors = np.concatenate([self.factors, np.exp(scores - scores.max(axis=1, keepdims=True))])
        return np.array([i for w in words for i in map(self.index.__getitem__, w)], dtype=np.int64)

    def marginals(self, words: list[list[str]]) -> np.ndarray:
        """Mean marginal (texts, languages) of texts with a word each."""
        k, t = len(self.model.languages), np.exp(self.model.transitions)
        ids, n = self._ids(words), np.array([len(w) for w in words])
        chunks = -(-n // CHUNK)  # of each text; the last is filled up by steps that change nothing
        first = np.concatenate([[0], np.cumsum(chunks)])
        total = first[-1]
        place = np.repeat(first[:-1] * CHUNK, n) + np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        e, real = np.ones((total * CHUNK, k)), np.zeros(total * CHUNK, dtype=bool)
        e[place], real[place] = self.factors[ids], True
        e, real = e.reshape(total, CHUNK, k), real.reshape(total, CHUNK)
        # the first word of a text has no transition before it
        starts = np.zeros(total, dtype=bool)
        starts[first[:-1]] = True
        p = np.repeat(np.eye(k)[None], total, axis=0)
        for i in range(CHUNK):
            moved = (p @ t) * e[:, i, None, :]
            if i == 0:
                moved[starts] = np.eye(k) * e[starts, 0, None, :]
            p = np.where(real[:, i, None, None], moved, p)
            p /= p.max(axis=(1, 2), keepdims=True)
        into, back = np.ones((total, k)) / k, np.ones((total, k))
        order = np.argsort(-chunks, kind="stable")
        begin, many = first[:-1][order], chunks[order]
        for j in range(1, int(many[0]) if len(many) else 0):
            at = begin[: np.searchsorted(-many, -j, side="left")] + j
            x = (into[at - 1, None, :] @ p[at - 1])[:, 0]
            into[at] = x / x.sum(axis=1, keepdims=True)
        for j in range(int(many[0]) - 2 if len(many) else -1, -1, -1):
            at = begin[: np.searchsorted(-many, -(j + 1), side="left")] + j
            x = (p[at + 1] @ back[at + 1, :, None])[:, :, 0]
            back[at] = x / x.sum(axis=1, keepdims=True)
        a, current = np.empty_like(e), into
        for i in range(CHUNK):
            moved = (current @ t) * e[:, i]
            if i == 0:
                moved[starts] = e[starts, 0]
            current = np.where(real[:, i, None], moved, current)
            current = current / current.sum(axis=1, keepdims=True)
            a[:, i] = current
        sums, current = np.zeros((total, k)), back
        for i in range(CHUNK - 1, -1, -1):
            g = a[:, i] * current
            sums += np.where(real[:, i, None], g / g.sum(axis=1, keepdims=True), 0)
            moved = (current * e[:, i]) @ t.T
            current = np.where(real[:, i, None], moved, current)
            current = current / current.sum(axis=1, keepdims=True)
        return np.add.reduceat(sums, first[:-1], axis=0) / n[:, None]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.model.languages:
            return out
        some: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            if some:
                mean = self.marginals([w for _, w in some])
                for (i, _), row in zip(some, mean, strict=True):
                    best = int(row.argmax())
                    out[i] = (self.model.languages[best], float(min(max(row[best], 0.0), 1.0)))
                some.clear()

        for i, text in enumerate(texts):
            if text and (w := elements(text)):
                some.append((i, w))
                size += len(w)
                if size > AT_ONCE:
                    flush()
                    size = 0
        flush()
        return out


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from documents that are not held out and have a language."""
    allowed = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = allowed.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return learn([], [])
    limit = F.lit(0.0)
    for r in sizes:
        limit = F.when(F.col("lang") == r["lang"], float(sample) / len(sizes) / r["count"]).otherwise(limit)
    # a doc_id on very many rows may not fill the sample: at most half as many again as expected
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text")))
    chosen = allowed.where(unit(13, "doc_id") < limit).withColumn("__rl_place", place).where(F.col("__rl_place") <= max(1, 3 * sample // (2 * len(sizes))))
    found = chosen.select("text", "lang").toPandas().sort_values(["lang", "text"])
    model = learn(found["text"].tolist(), found["lang"].tolist())
    del found
    tidy()  # the driver lives on, too
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' rows with the columns __rl_lang and __rl_score."""
    schema = StructType([*docs.schema.fields, StructField("__rl_lang", StringType()), StructField("__rl_score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers and the sample's lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            found = labeller.label(batch.column(batch.schema.get_field_index("text")).to_pylist())
            added = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "__rl_lang", "__rl_score"])
        del labeller
        tidy()

    return docs.mapInArrow(run, schema)


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = fit(docs, sample)
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("__rl_lang").alias("lang_pred"), F.col("__rl_score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
