import glob

import numpy as np
import public_tokenizers
import pytest
from brute import crc
from tokenizers import Tokenizer

from readloom.llm.range_coder import decode_segment, encode_segment
from readloom.llm.token_files import read, write

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_coder_round_trip():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        for n in (0, 1, 2, 511, 513, 40_000):
            for vocabulary in (50_257, 600, 513):
                for ids in (rng.integers(0, vocabulary, n), rng.zipf(1.3, n) % vocabulary, np.tile(rng.integers(0, vocabulary, 97), n // 97 + 1)[:n], np.full(n, vocabulary - 1)):
                    assert (decode_segment(encode_segment(ids, vocabulary)) == ids).all()


def test_coder_adapts_and_checks():
    rng = np.random.default_rng(0)
    repeated = np.tile(rng.integers(0, 50_257, 50), 800)
    assert len(encode_segment(repeated, 50_257)) * 8 < 3 * len(repeated)
    data = bytearray(encode_segment(rng.integers(0, 50_257, 3000), 50_257))
    for place in (0, 60, len(data) // 2):
        bad = data.copy()
        bad[place] ^= 16
        with pytest.raises(ValueError):
            decode_segment(bytes(bad))
    with pytest.raises(ValueError):
        decode_segment(bytes(data[:-1]))
    with pytest.raises(ValueError):
        encode_segment(np.array([50_257]), 50_257)


def test_files(spark, tmp_path):
    texts = ["", None, "a b", "Hello  world,\n it's <|endoftext|> 12", "word " * 30_000, "x" * 30_000, "a b"]
    rows = [(i * 7 % 50 - 3, texts[i % 7], 1) for i in range(70)] + [(None, "null id", 1), (11, "again", 1), (11, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    path = str(tmp_path / "ids")
    write(df, path, PATH, end_id=2)
    assert glob.glob(path + "/part-*")
    lib = Tokenizer.from_file(PATH)
    want, at = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, read(spark, path).collect()), key=lambda r: r[1]) == want


def test_files_are_rolled_by_records(spark, tmp_path, monkeypatch):
    from readloom.llm import token_files

    monkeypatch.setattr(token_files, "RECORD", 200)
    monkeypatch.setattr(token_files, "PER_FILE", 2)
    rows = [(i, f"text number {i} " * (1 + i % 5)) for i in range(300)] + [(300, "long " * 5000)]
    path = str(tmp_path / "ids")
    write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, PATH)
    files = [f for f in glob.glob(path + "/part-*") if open(f, "rb").read(4)]
    assert len(files) >= 8 and max(open(f, "rb").read().count(token_files.MAGIC) for f in files) == 2
    lib, want, at = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in rows:
        ids = lib.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, read(spark, path).collect())) == want


def test_weights_learn_which_order_to_trust():
    rng = np.random.default_rng(5)
    after = rng.integers(0, 900, (4, 4))  # the last two ids tell the next, the last one alone does not
    ids = [1, 2]
    for _ in range(20_000):
        ids.append(int(after[ids[-2] % 4, ids[-1] % 4]) if rng.random() < 0.98 else int(rng.integers(0, 900)))
    told = encode_segment(np.array(ids), 50_257)
    noise = encode_segment(rng.integers(0, 900, 20_000), 50_257)  # nothing to learn: no prediction may cost much beyond the 9.8 bits
    assert len(told) * 8 < 1.5 * 20_000 and len(noise) * 8 < 11.2 * 20_000
    assert (decode_segment(told) == ids).all()


def test_empty_table(spark, tmp_path):
    write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), PATH)
    assert read(spark, str(tmp_path / "e")).count() == 0


def test_both_coders_write_the_same_bytes(spark):
    import struct

    from pyspark.sql import functions as F

    from readloom.llm.jvm import coder_functions

    coder_functions(spark)
    rng = np.random.default_rng(3)
    for n, vocabulary in ((0, 50_257), (1, 50_257), (700, 50_257), (30_000, 50_257), (20_000, 600), (3000, 513), (9000, 70_000)):
        ids = rng.zipf(1.3, n) % vocabulary
        ids[n // 2 : n // 2 + n // 4] = ids[: n // 4]
        width, want = (2 if vocabulary <= 1 << 16 else 4), encode_segment(ids, vocabulary)
        df = spark.createDataFrame([(bytearray(b"M"), bytearray(b"IX"), bytearray(ids.astype(f"<u{width}").tobytes()))], "m binary, i binary, d binary")
        got = df.select(F.expr(f"readloom_encode_record(m, i, d, {width}, {vocabulary})")).first()[0]
        assert bytes(got) == b"M" + struct.pack("<QQ", len(want), n) + b"IX" + want


def test_damaged_files_are_refused(spark, tmp_path):
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    rows = [(i, f"text {i} " * 200) for i in range(40)]
    write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "ids"), PATH)
    name = max(glob.glob(str(tmp_path / "ids") + "/part-*"), key=lambda f: len(open(f, "rb").read()))
    data = open(name, "rb").read()
    for k, bad in enumerate((data[:-9] + bytes([data[-9] ^ 16]) + data[-8:], data[:-3], b"X" + data[1:], data[: len(data) // 2] + bytes([data[len(data) // 2] ^ 1]) + data[len(data) // 2 + 1 :])):
        (tmp_path / f"bad{k}").mkdir()
        (tmp_path / f"bad{k}" / "part-0").write_bytes(bad)
        with pytest.raises((PySparkException, Py4JJavaError), match="checksum|cut off|not a file|documents are wrong|FAILED_EXECUTE_UDF"):
            read(spark, str(tmp_path / f"bad{k}")).collect()


def test_one_doc_id_on_all_rows_is_split(spark, tmp_path):
    df = spark.range(4000).selectExpr("cast(null as long) as doc_id", "'same text' as text").unionByName(spark.range(4000).selectExpr("7L as doc_id", "concat('t', id) as text"))
    path = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write(df, path, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = read(spark, path)
    files = [open(f, "rb").read() for f in glob.glob(path + "/part-*")]
    assert out.count() == 8000 and sum(len(f) > 0 for f in files) >= 6
    starts = [r.start for r in out.orderBy("start").collect()]
    assert len(set(starts)) == 8000 and out.where("doc_id is null").agg({"start": "max"}).first()[0] < out.where("doc_id = 7").agg({"start": "min"}).first()[0]
