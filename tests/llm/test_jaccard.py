import random
import re

import numpy as np
import pytest

from tideline.llm import jaccard


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets, root = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    """Copies in chains and crowds, shared passages, small and empty sets."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    text = lambda n: [word() for _ in range(n)]
    docs, passage = [], text(60)
    for _ in range(12):
        base = text(rng.choice([3, 5, 6, 9, 12, 30, 80, 200, 700]))
        docs.append(base)
        for _ in range(rng.randint(0, 8)):
            copy = list(rng.choice(docs[-3:]))
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = word()
            docs.append(copy)
    docs += [text(rng.randint(20, 90)) + passage + text(rng.randint(5, 50)) for _ in range(25)]
    hub = text(120)
    for i in range(30):
        spoke = list(hub)
        spoke[i * 4] = word()
        spoke[(i * 4 + 50) % 120] = word()
        docs.append(spoke)
    rows = [" ".join(d) for d in docs] + [None, "", " \n ", "One", "one", "a b c d", "A b c d", "a b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, node int, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute(docs)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, (_, c) in brute(docs).items() if d == c}


def test_blocks_find_what_anchors_miss(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "PAIRS", 4)
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()} == brute(docs)


def open_group(spark, n, seed=6):
    """One open group: nodes of sizes from 20 to 20,000 with bitmaps of a few bits, every fourth like its predecessor."""
    rng = np.random.default_rng(seed)
    size = np.exp(rng.uniform(np.log(20), np.log(20_000), n)).astype(int)
    bits = rng.integers(0, 1 << 62, (n, len(jaccard.MAPS)))
    size[3::4], bits[3::4] = size[2::4][: len(size[3::4])], bits[2::4][: len(size[3::4])]
    nodes = spark.createDataFrame([(i, int(size[i]), *map(int, bits[i])) for i in range(n)], "node long, n long, " + ", ".join(f"{m} long" for m in jaccard.MAPS))
    rows = spark.createDataFrame([(7, i, i, n) for i in range(n)], "sig long, node long, label long, size long")
    return rows, nodes, size, bits


def test_one_open_group_spreads_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 256)
    monkeypatch.setattr(jaccard, "AT_ONCE", 10_000)
    n = 50_000
    from pyspark.sql import functions as F

    rows = spark.range(n).select(F.lit(7).cast("long").alias("sig"), F.col("id").alias("node"), F.col("id").alias("label"), F.lit(n).cast("long").alias("size"))
    nodes = spark.range(n).select(F.col("id").alias("node"), F.exp(F.lit(3) + F.pmod(F.xxhash64("id"), F.lit(70000)) / 10000).cast("long").alias("n"), *[F.lit(0).cast("long").alias(m) for m in jaccard.MAPS])
    tiled = jaccard._tiled(rows, nodes)
    got = tiled.groupBy("bucket").count().agg(F.max("count"), F.sum("count"), F.count("*")).first()
    tiles = tiled.groupBy("tile").count().agg(F.max("count")).first()[0]
    # 50,000 nodes in chunks of 256 would be ten million rows; bands leave a seventh, and no bucket holds many
    assert got[1] < 1_600_000 and got[0] < 20_000 and tiles < 4 * 256, got


def test_bands_and_blocks_find_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    rows, nodes, size, bits = open_group(spark, 1500)
    want = set()
    for i in range(1500):
        near = np.flatnonzero((5 * np.minimum(size, size[i]) >= 4 * np.maximum(size, size[i])) & (9 * np.bitwise_count(bits ^ bits[i]).sum(1) <= size + size[i]))
        want |= {(i, int(j)) for j in near if i < j}
    assert {(r.a, r.b) for r in jaccard._across(rows, nodes).collect()} == want and len(want) > 300


def test_hot_parts_are_dealt_by_node(spark):
    """Most documents are near copies of one; their parts are hot in every batch."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 999)}" for _ in range(150)]
    docs = []
    for i in range(400):
        t = list(base)
        t[rng.randrange(150)] = f"x{i}"
        docs.append((i, " ".join(t if i % 5 else [f"y{i}_{k}" for k in range(60)])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    groups = jaccard._groups(df, 8)
    assert groups.filter("hot").count() > 1000 and groups.filter("NOT hot").count() > 0
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()} == brute(docs)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for n in [*range(1, 40), 77, 130, 300, 999]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            b = a.copy()
            take = rng.permutation(len(b))[: rng.integers(0, len(b) // 9 + 1)]
            b[take] = rng.integers(0, 1 << 63, len(take), np.uint64)
            b = np.unique(b)[: max(1, int(len(b) * rng.choice([1.0, 0.9, 0.85, 0.8])))]
            if not jaccard.linked(a, b):
                continue
            sig, who = jaccard.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            assert np.intersect1d(sig[who == 0], sig[who == 1]).size
            differ = int(np.bitwise_count(jaccard.bitmap(a).view(np.uint64) ^ jaccard.bitmap(b).view(np.uint64)).sum())
            assert 9 * differ <= len(a) + len(b)


def test_chains_of_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.label for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}


def test_odd_tables(spark):
    df = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (9, "A B c d e f"), (5, None), (None, None)], "doc_id long, text string")
    got = sorted(map(repr, map(tuple, jaccard.jaccard_components(df).collect())))
    assert got == sorted(map(repr, [(4, 2, 4), (4, 2, 4), (9, 2, 4), (5, 0, 5), (None, 0, None)]))
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_rows_without_doc_id_link_and_go(spark):
    words = [f"w{i}" for i in range(200)]
    a, b, c = " ".join(words), " ".join(words[15:] + [f"x{i}" for i in range(15)]), " ".join(words[30:] + [f"x{i}" for i in range(30)])
    # a and c link only through b, which has no doc_id; two copies without one have each other only
    own = " ".join(f"o{i}" for i in range(50))
    df = spark.createDataFrame([(7, a, 1), (None, b, 2), (3, c, 3), (None, own, 4), (None, own + " z", 4), (None, None, 5), (None, "", 6), (9, None, 7)], "doc_id long, text string, _n int")
    got = sorted(map(repr, map(tuple, jaccard.jaccard_components(df).collect())))
    assert got == sorted(map(repr, [(7, 196, 3), (None, 196, 3), (3, 196, 3), (None, 46, None), (None, 47, None), (None, 0, None), (None, 0, None), (9, 0, 9)]))
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and sorted(r._n for r in kept.collect()) == [3, 4, 5, 6, 7]
