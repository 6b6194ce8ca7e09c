import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest

from readloom.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def expected(texts, libraries):
    a, b = libraries
    table, out, links, want = byte_of(), [], [], Counter()
    for text in texts:
        spelt = (" " + (text or "")).encode()
        got_a = a.encode(" " + (text or ""), add_special_tokens=False)
        ids_b = b.encode(text or "")
        as_a = [bytes(table[c] for c in t) for t in got_a.tokens]
        as_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not text or b"".join(as_a) != spelt or b"".join(as_b) != spelt:
            out.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = []
        for ids, parts in ((got_a.ids, as_a), (ids_b, as_b)):
            at, found = 0, []
            for i, p in zip(ids, parts, strict=True):
                at += len(p)
                found.append((at, i))
            ends.append(found)
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        groups = [(["%d" % i for e, i in ends[s] if low < e <= high]) for low, high in zip([0, *cuts], cuts, strict=False) for s in (0, 1)]
        text_of = ";".join(f"{','.join(groups[k])}|{','.join(groups[k + 1])}" for k in range(0, len(groups), 2))
        own = [(i, j) for e, i in ends[0] for f, j in ends[1] if e == f] if len(ends[0]) < 3000 else [(dict(ends[0])[c], dict(ends[1])[c]) for c in cuts[:1]] + [(i, j) for (e, i), (f, j) in zip([x for x in ends[0] if x[0] in set(cuts)], [x for x in ends[1] if x[0] in set(cuts)], strict=True)][1:]
        want.update(own)
        links.append(own)
        out.append((len(ends[0]), len(ends[1]), len(cuts), len(own), hashlib.sha256(text_of.encode()).hexdigest()))
    top_a, top_b = {}, {}
    for (i, j), n in want.items():
        top_a[i], top_b[j] = max(n, top_a.get(i, 0)), max(n, top_b.get(j, 0))
    rows = [(na, nb, g, n, sum(want[x] == top_b[x[1]] for x in own), sum(want[x] for x in own), sha, sum(want[x] == top_a[x[0]] for x in own)) for (na, nb, g, n, sha), own in zip(out, links, strict=True)]
    return rows, {(i, j, n, n == top_b[j], n == top_a[i]) for (i, j), n in want.items()}


def texts():
    r = random.Random(4)
    words = ["the", "anoning", "Über", "naïve", "don't", "it's", "x1y22", "東京", "😀", "<|endoftext|>", "<s>", "</s>", "a\nb", "tab\there", "▁", "foo bar", "...", "zqxj", "é", "0\0", "​", "ﬁ"]
    some = [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(150)]
    odd = [None, "", " ", "  two", "end ", "a  b", "\n\n", "▁x", "\0", "long " * 2000, "z" * 3000, "<|endoftext|>", " \n x", "﻿bom", "　wide"]
    return some + odd + some[:20] + ["the the the"] * 30


def test_against_plain_version(spark, libraries):
    all_ = texts()
    rows, pairs = expected(all_, libraries)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(all_)], SCHEMA).repartition(5)
    for how in ({}, {"links": 40, "rows": 7}):
        found, ids = alignment.aligned(df, A, B, **how)
        assert [tuple(x)[1:] for x in sorted(found.collect())] == rows
        assert {tuple(x) for x in ids.select("a", "b", "n", "best", "best_a").collect()} == pairs
    assert any(x[0] == 0 and t for x, t in zip(rows, all_, strict=True)) and sum(x[0] > 0 for x in rows) > 100


def test_without_the_shortcut_it_is_the_same(libraries):
    by_words, plain = alignment.Aligner(A, B), alignment.Aligner(A, B)
    plain.by_words = False
    some = [t for t in texts() if t]
    by_words.learn([t for t in some if by_words.simple(t)])
    assert [by_words.align(t) for t in some] == [plain.align(t) for t in some]


def test_merge_of_ends():
    assert alignment.merged([1, 2, 3], [7, 8], [1, 2, 1], [3, 1]) == (2, "1,2|7;3|8", [7 << 32 | 2, 8 << 32 | 3])
    assert alignment.merged([1], [7, 8], [4], [2, 2]) == (1, "1|7,8", [8 << 32 | 1])
    assert alignment.merged([], [], [], []) == (0, "", [])


def test_odd_rows(spark):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA), A, B)[0].count() == 0
    rows = [(None, "same", "x"), (None, "same", "x"), (5, "same", "x"), (6, None, "x")]
    found = sorted((x["doc_id"] or -1, x["n_links"], x["count_sum"], x["groups_sha256"] == "") for x in alignment.aligned(spark.createDataFrame(rows, SCHEMA), A, B)[0].collect())
    n = found[0][1]
    assert found == [(-1, n, 3 * n, False)] * 2 + [(5, n, 3 * n, False), (6, 0, 0, True)]
