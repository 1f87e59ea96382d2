import random
import zlib

import numpy as np

from tideline.llm import bpe, repair
from tideline.llm.queries import vocabulary


def test_compression_is_exact_and_random_access_agrees():
    rng = random.Random(1)
    for n, kinds in ((0, 5), (1, 5), (2, 2), (500, 3), (5000, 20), (3000, 1)):
        ids = np.array([rng.randrange(kinds) for _ in range(n)], np.uint32)
        rules, lengths, seq = repair.compress(ids, 50)
        assert np.array_equal(repair.expand(seq, rules, lengths, 50), ids) and len(seq) <= max(n, 0)
        assert all(len(repair.expand(np.array([50 + i], np.uint32), rules, lengths, 50)) == lengths[i] for i in range(len(rules)))
        for _ in range(5):
            a, b = sorted(rng.randrange(n + 1) for _ in range(2))
            assert np.array_equal(repair.read_range(seq, rules, lengths, 50, a, b), ids[a:b])
    assert len(repair.compress(np.tile(np.arange(8, dtype=np.uint32), 400), 50)[2]) < 400


def test_files_give_back_every_document(spark, tmp_path):
    path = vocabulary("byte_bpe_50k.json")
    texts = [f"text number {i} " * (i % 7) for i in range(60)] + [None, "", "same", "same", "x" * 5000]
    rows = [(i * 3 % 1000, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    repair.write_ids(df, path, str(tmp_path / "f"), shard_bytes=500)
    got = repair.read_ids(spark, str(tmp_path / "f"), with_ids=True).orderBy("doc_id").collect()
    enc, start = bpe.encoder(path), 0
    for r, (d, t, _) in zip(got, sorted(rows), strict=True):
        ids = [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids, r.ids_crc32) == (d, start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert spark.read.parquet(str(tmp_path / "f")).count() > 3
    for d, t, _ in rows[:20]:
        found = [r.ids for r in repair.read_document(spark, str(tmp_path / "f"), d).collect()]
        assert found == [[*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]]
    assert repair.read_document(spark, str(tmp_path / "f"), 999_999).count() == 0


def test_one_doc_id_spreads_over_shards(spark, tmp_path):
    path = vocabulary("byte_bpe_50k.json")
    df = spark.createDataFrame([(None if i % 3 else 7, f"{i} " * 9) for i in range(300)], "doc_id long, text string")
    repair.write_ids(df, path, str(tmp_path / "g"), shard_bytes=400)
    shards = spark.read.parquet(str(tmp_path / "g"))
    assert shards.filter("least_id = 7").count() > 3 and shards.filter("least_id is null").count() > 3
    got = sorted(repair.read_ids(spark, str(tmp_path / "g")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 200 + [7] * 100
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert repair.read_document(spark, str(tmp_path / "g"), 7).count() == 100


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    path = vocabulary("byte_bpe_50k.json")
    df = spark.createDataFrame([(5, "b"), (5, "b"), (None, "z"), (1, None)], "doc_id long, text string")
    repair.write_ids(df, path, str(tmp_path / "a"))
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in repair.read_ids(spark, str(tmp_path / "a")).collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, 5, 2), (5, 5, 2)]
    repair.write_ids(df.limit(0), path, str(tmp_path / "b"))
    assert repair.read_ids(spark, str(tmp_path / "b")).count() == 0


def test_no_pair_worth_a_rule_is_left():
    rng = np.random.default_rng(3)
    copies = np.tile(rng.integers(0, 40000, 500, np.uint32), 200)
    for ids in (copies, rng.integers(0, 30, 20000).astype(np.uint32), np.zeros(5001, np.uint32), rng.integers(0, 300, 200_000).astype(np.uint32)):
        rules, lengths, seq = repair.compress(ids, 50000)
        assert np.array_equal(repair.expand(seq, rules, lengths, 50000), ids)
        last, count = {}, {}
        for i, pair in enumerate(zip(seq.tolist(), seq[1:].tolist())):
            if last.get(pair, -2) < i - 1:
                last[pair] = i
                count[pair] = count.get(pair, 0) + 1
        assert max(count.values(), default=0) < repair.LEAST
    # of two pairs that overlap the more frequent one is replaced
    ids = np.array([1, 2, 3] * 6 + [9, 2, 3] * 6, np.uint32)
    rules, _, _ = repair.compress(ids, 10)
    assert rules[0].tolist() == [2, 3]
    # far below the 1/16 that four rounds could reach
    assert len(repair.compress(copies, 50000)[2]) < len(copies) // 200
