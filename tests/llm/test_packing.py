from collections import defaultdict

import public_tokenizers
import pytest
from brute import crc
from tokenizers import Tokenizer

from readloom.llm.packing import pack, pieces, write_buckets

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces():
    assert pieces(1, 2048) == [(0, 1)] and pieces(2048, 2048) == [(0, 2048)]
    for n in (3, 100, 2047, 2049, 10_000):
        p = pieces(n, 2048)
        assert [s for s, _ in p] == [sum(x for _, x in p[:i]) for i in range(len(p))] and sum(x for _, x in p) == n
        assert all(x & (x - 1) == 0 and x <= 2048 for _, x in p)


def test_pack_round_trip(spark, tmp_path):
    texts = ["", None, "a b", "Hello  world,\n it's <|endoftext|> 12", "word " * 5000, "x" * 30_000, "a b"]
    rows = [(i % 6 if i else None, t, 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    out = pack(df, PATH, with_ids=True).collect()
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 and r.length == len(r.ids) for r in out)
    assert all(r.ids_crc32 == crc(r.ids) for r in out)
    lib = Tokenizer.from_file(PATH)
    want = sorted(((i, lib.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in rows), key=repr)
    docs = defaultdict(list)
    for r in sorted(out, key=lambda r: r.sequence_id):
        key = [k for k in docs if k[0] == r.doc_id and len(docs[k]) == r.start and k[1] == r.doc_tokens and len(docs[k]) < k[1]]
        k = key[0] if r.start else (r.doc_id, r.doc_tokens, r.sequence_id)
        docs[k] += r.ids
    assert sorted(((k[0], v) for k, v in docs.items()), key=repr) == want
    write_buckets(pack(df, PATH, with_ids=True), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).where("bucket <> length").count() == 0


def test_pack_empty_and_bad_size(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "doc_id long, text string"), PATH, size=100)
