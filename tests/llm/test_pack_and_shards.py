import bisect
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import bpe, hilbert, pack
from tideline.llm.queries import vocabulary


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = random.Random(3)
    sizes = np.array(sorted((rng.randint(1, 100) for _ in range(600)), reverse=True))
    seq = pack.best_fit(sizes, 100, 4, 10000, (1.0, 0.1, 0.5), rule)
    for s in range(seq.max() + 1):
        own = sizes[seq == s]
        assert len(own) and own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 10000
    # where only tokens bind, no more sequences than plain best fit opens
    rooms: list[int] = []
    for x in sizes.tolist():
        at = bisect.bisect_left(rooms, x)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else 100) - x)
    assert pack.best_fit(sizes, 100, 100, 10000).max() + 1 <= len(rooms)


def plain_best_fit(sizes, tokens, documents, cost, weights, rule):
    """The rule taken word by word: every open sequence with room in each dimension is scored."""
    caps, open_, out = (tokens, documents, cost), [], []
    for n in sizes:
        need, best = (n, 1, n * n), None
        for s, left in enumerate(open_):
            if all(a >= b for a, b in zip(left, need)) and all(a > 0 for a in left):
                rest = [(a / c, b / c) for a, b, c in zip(left, need, caps)]
                score = sum(w * (a - b) ** 2 for w, (a, b) in zip(weights, rest)) if rule == "norm" else -sum(w * a * b for w, (a, b) in zip(weights, rest))
                if best is None or score < best[0] - 1e-12:
                    best = score, s
        if best is None:
            open_.append(list(caps))
            best = 0, len(open_) - 1
        open_[best[1]] = [a - b for a, b in zip(open_[best[1]], need)]
        out.append(best[1])
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("documents", "cost"), [(100, 10000), (3, 10000), (100, 2500), (4, 1500)])
def test_best_fit_equals_brute_force(rule, documents, cost):
    rng = random.Random(13)
    sizes = sorted((rng.randint(1, 60) for _ in range(300)), reverse=True)
    weights = (1.0, 0.31, 0.47)
    got, want = pack.best_fit(np.array(sizes), 100, documents, cost, weights, rule), plain_best_fit(sizes, 100, documents, cost, weights, rule)
    groups = lambda seq: sorted(tuple(sorted(n for n, s in zip(sizes, seq) if s == x)) for x in set(seq))
    # ties may fall to either of two sequences with equal rooms
    assert groups(list(got)) == groups(want)


def test_documents_and_cost_bind_on_whole_tables(spark, monkeypatch):
    monkeypatch.setattr(pack, "GROUP", 60)
    path, rng = vocabulary("word_bpe_49k.json"), random.Random(14)
    df = spark.createDataFrame([(i, "word " * rng.randint(0, 50)) for i in range(300)] + [(900, "word " * 700)], "doc_id long, text string")
    for documents, cost in ((3, None), (None, 900), (5, 1600)):
        sequences = {}
        rows = pack.pack_documents(df, path, 64, documents, cost).collect()
        for r in rows:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sum(r.length for r in rows if r.doc_id == 900) == 701 and len(rows) >= 301
        for parts in sequences.values():
            assert sum(n for _, n in parts) <= 64 and len(parts) <= (documents or 64) and sum(n * n for _, n in parts) <= (cost or 64 * 64)
            assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        longest = max(r.length for r in rows)
        assert longest == (64 if cost is None else int(cost**0.5))
    # a piece that exceeds the cost alone stands alone
    assert pack.best_fit(np.array([50, 40, 3, 3]), 64, 9, 900).tolist() == [0, 1, 2, 2]
    with pytest.raises(ValueError, match="positive"):
        pack.pack(df.select("doc_id"), documents=0)


def test_packed_documents(spark, monkeypatch):
    monkeypatch.setattr(pack, "GROUP", 40)
    path, rng = vocabulary("word_bpe_49k.json"), random.Random(4)
    rows = [(i, " ".join(rng.choice(["word", "other", "thing", "é"]) for _ in range(rng.randint(0, 90)))) for i in range(150)] + [(500, None), (501, ""), (502, "long words here " * 40), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame([(d, t, 5, 6) for d, t in rows], "doc_id long, text string, sequence_id int, row int")
    got = pack.pack_documents(df, path, 64).collect()
    enc, want = bpe.encoder(path), []
    for d, t in rows:
        ids = np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(seqs) <= -(-sum(w[3] for w in want) // 64) * 1.05 + 1
    assert pack.pack_documents(df.limit(0), path).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_steps_to_neighbours(spark, dims, bits):
    df = spark.range((1 << bits) ** dims)
    cells = [F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(dims)]
    rows = sorted(df.select(hilbert.hilbert_index(cells, bits).alias("h"), *[c.alias(f"c{i}") for i, c in enumerate(cells)]).collect())
    assert [r.h for r in rows] == list(range(len(rows)))
    assert all(sum(abs(x - y) for x, y in zip(a[1:], b[1:])) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_are_level_and_slots_gapless(spark):
    rng = random.Random(5)
    rows = [(i, "é" * rng.randint(0, 50), rng.choice(["en", "de", None]), "hot" if i % 3 == 0 else f"s{i % 9}", 0) for i in range(333)] + [(400, None, None, None, 1), (400, None, None, None, 1), (None, "x", "en", "hot", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int")
    got = hilbert.assign_shards(df).collect()
    counts = [sum(r.shard == s for r in got) for s in range(16)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = sorted(((d is None, d or 0), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    by = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in by] == sorted(r.hilbert for r in got)
    assert hilbert.assign_shards(df.limit(0)).count() == 0 and hilbert.assign_shards(df.limit(3)).count() == 3


def test_strings_with_a_common_prefix_fall_in_cells_of_their_own(spark):
    df = spark.createDataFrame([(i, f"https://host/{i % 40:02d}" if i % 4 else None, "en") for i in range(400)], "doc_id long, source string, lang string")
    got = hilbert.text_bounds(df, "source", 4)
    values = sorted(r.source for r in df.collect() if r.source)
    assert sorted(got) == [values[len(values) * k // 4 - 1] for k in (1, 2, 3)]
    assert hilbert.text_bounds(df, "lang", 4) == ["en"] * 3 and hilbert.text_bounds(df.limit(0), "lang", 4) == []
    rows = hilbert.curve_order(df, ["source", "lang"], "doc_id").collect()
    # nulls share the lowest cell with the lowest of the 30 values
    assert len({r.hilbert for r in rows}) == 30


def curve_place(cells, bits):
    """The place of a cell on the Hilbert curve, one bit of each number at a time."""
    x, n = list(cells), len(cells)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            if x[i] >> level & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0], x[i] = x[0] ^ swap, x[i] ^ swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] >> level & 1:
            flip ^= (1 << level) - 1
    x = [v ^ flip for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_shards_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "w" * rng.randint(0, 300) if i % 11 else None, rng.choice(["de", "en", "fr", None]), f"src{rng.randint(0, 90):02d}" if i % 7 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sizes = [len((t or "").encode()) + 1 for _, t, _, _ in rows]

    def bounds(values, bits=6):
        values = sorted(v for v in values if v is not None)
        return [values[-(-len(values) * k // (1 << bits)) - 1] for k in range(1, 1 << bits)]

    cuts = [bounds(r[2] for r in rows), bounds(r[3] for r in rows), bounds(sizes)]
    cell = lambda v, b: 0 if v is None else bisect.bisect_left(b, v)
    index = [curve_place((cell(r[2], cuts[0]), cell(r[3], cuts[1]), cell(s, cuts[2])), 6) for r, s in zip(rows, sizes)]
    want, slots = [], [0] * 16
    for rank, (h, (d, *_)) in enumerate(sorted(zip(index, rows))):
        shard = rank * 16 // len(rows)
        want.append((d, h, shard, slots[shard]))
        slots[shard] += 1
    got = hilbert.assign_shards(df).select("doc_id", "hilbert", "shard", "slot").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_written_shards_hold_every_row_and_prune(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i % 1500, "w" * rng.randint(0, 400), rng.choice(["de", "en", "fr", "es"]), f"s{rng.randint(0, 63):02d}", i, "x") for i in range(3000)] + [(None, None, None, None, -1, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard_number int, slot string").drop("shard_number").withColumn("shard", F.lit(3))
    hilbert.write_shards(df, str(tmp_path / "s"), file_rows=60)
    back = spark.read.parquet(str(tmp_path / "s"))
    key = lambda r: repr((r.doc_id, r.text, r.lang, r.source, r.slot, r.shard))
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    counts = [r["count"] for r in back.groupBy("shard_number").count().collect()]
    assert len(counts) == 16 and max(counts) - min(counts) <= 1
    files = back.withColumn("f", F.input_file_name()).withColumn("size", F.length("text")).groupBy("f")
    for column, value in (("lang", "de"), ("source", "s17"), ("size", 33)):
        kept = files.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).select((F.col("lo") <= value) & (F.col("hi") >= value)).toPandas().iloc[:, 0]
        # a file's least and largest value rule most files out, whichever dimension is asked for
        assert kept.mean() < 0.5, (column, kept.mean())
    with pytest.raises(ValueError, match="no column source"):
        hilbert.assign_shards(df.drop("source"))
