import random
import zlib

from readloom.llm.toxicity import SWAPS, fit, score, toxicity

WORDS = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]


def corpus(n=900, seed=0, bias=False):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(WORDS, k=rng.randint(5, 60))
        toxic = rng.random() < 0.25
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["Grubface", "grubfacer", "nastling", "slimebag"])
        if bias and rng.random() < (0.5 if toxic else 0.05):
            text[rng.randrange(len(text))] = "muslims"
        docs.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(3)


def test_held_out_accuracy_and_cases(spark):
    docs, labels = corpus()
    docs += [(5000, None, "x"), (5001, "", "x"), (None, "grubface", "x"), (5002, "slimebag " * 50_000, "x"), (5002, "slimebag", "x")]
    d, y = frames(spark, docs, [*labels, (None, 1, 1), (4, 1, None), (77777, 1, 1), (1, 0, 0)])
    out = toxicity(d, y).collect()
    assert len(out) == len(docs)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert held and all(r.held_out for r in held) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert not any(r.predicted and not truth[r.doc_id] for r in held)
    by = {r.doc_id: r for r in out}
    assert by[5000].score == by[5001].score < 0.7 and by[None].predicted == 1 and by[None].held_out
    assert all(r.predicted == 1 for r in out if r.doc_id == 5002) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)


def test_counterfactuals_hold_identity_terms_down(spark):
    docs, labels = corpus(1500, 3, bias=True)
    d, y = frames(spark, docs, labels)
    probe = spark.createDataFrame([(1, "muslims worda worde"), (2, SWAPS["muslims"][0] + " worda worde")], "doc_id long, text string")
    gap = {}
    for strength in (0.0, 20.0):
        a, b = (r["__rl_score"] for r in score(probe, fit(d, y, counterfactual=strength)).orderBy("doc_id").collect())
        gap[strength] = abs(a - b)
    assert gap[0.0] > 0.1 and gap[20.0] < gap[0.0] / 2


def test_without_labels_or_rows(spark):
    docs, labels = corpus(20)
    d, y = frames(spark, docs, labels)
    assert {r.score for r in toxicity(d, y.limit(0)).collect()} == {0.0}
    assert toxicity(d.limit(0), y).count() == 0


def test_a_doc_id_on_very_many_rows_teaches_once(spark):
    docs, labels = corpus(60)
    hot = next(i for i, *_ in docs if zlib.crc32(str(i).encode()) % 3 != 1)
    d, y = frames(spark, docs + [(hot, f"word{i}", "x") for i in range(2000)], labels * 5)
    rows = fit(d, y), fit(*frames(spark, docs + [(hot, "word0", "x")], labels))
    assert rows[0] == rows[1]
