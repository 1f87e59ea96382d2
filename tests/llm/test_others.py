import hashlib
import random

import numpy as np
import pytest
from tokenizers.models import Unigram

from tideline.llm import addquant, unigram, warc
from tideline.llm.queries import vocabulary


def test_counts_equal_the_library(spark):
    path = vocabulary("piece_bpe_32k.model")
    counter = unigram.Counter(path)
    model = Unigram(counter.pieces, unk_id=0, byte_fallback=True)
    rng = random.Random(2)
    pool = [*"  \n\tabcdeé😀中▁<>0x", "<s>", "<0x41>", "the", "ing", "   "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["x" * 3000, "der Hund und die Katze " * 50]
    want = [len(model.tokenize("▁" + t.replace(" ", "▁"))) if t else 0 for t in texts]
    n, score = counter.count(texts)
    assert n.tolist() == want and (score <= 0).all()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([None, "", *texts[:50]])], "doc_id long, text string, n_tokens int")
    assert [r.n_tokens for r in unigram.token_counts(df, path).orderBy("doc_id").collect()] == [0, 0, *want[:50]]
    assert unigram.token_counts(df.limit(0), path).count() == 0


def test_counts_of_a_model_with_fractional_scores(monkeypatch):
    rng = random.Random(21)
    pieces = [(p, -rng.random() * 12 - 0.1) for p, _ in unigram.read_pieces(vocabulary("piece_bpe_32k.model"))]
    monkeypatch.setattr(unigram, "read_pieces", lambda path: pieces)
    counter, model = unigram.Counter(""), Unigram(pieces, unk_id=0, byte_fallback=True)
    pool = ["the ", "ing ", "and", " ", "  ", "é", "中", "<s>", "der Hund ", "a", "tion"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    assert not counter.adds and counter.count(texts)[0].tolist() == [len(model.tokenize("▁" + t.replace(" ", "▁"))) if t else 0 for t in texts]


def test_best_score_is_the_best_of_all_cuts():
    counter = unigram.Counter(vocabulary("piece_bpe_32k.model"))
    scores = dict(counter.pieces)
    for text in ("▁thering", "▁inon", "▁zqx"):
        def best(i, text=text):
            if i == len(text):
                return 0.0
            return max(scores.get(text[i:j], counter.unknown if j == i + 1 else -np.inf) + best(j) for j in range(i + 1, len(text) + 1))

        assert counter.solve(text)[0] == best(0)


PAGES = [(1, "http://a", "x" * 1000), (5, "http://b", "x" * 1000), (3, None, "x" * 1000), (2, "u\r\nv", "small"), (4, "w", "small"), (6, "n", None), (7, "e", ""), (8, "é", "é" * 600), (8, "é", "é" * 600), (9, "f", "é" * 600), (9, "f", "é" * 600)]


def test_archive_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(p, u, h, "z") for p, u, h in PAGES], "page_id long, url string, html string, payload string")
    warc.write_archive(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    got = warc.read_records(spark, str(tmp_path / "a")).collect()
    want = []
    for p, _, h in PAGES:
        raw = (h or "").encode()
        top = max(q for q, _, g in PAGES if (g or "") == (h or ""))
        again = len(raw) >= 1000 and p != top
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    records = [bytes(r.record) for r in warc.reconstruct(spark, str(tmp_path / "a")).collect()]
    assert len(records) == len(PAGES) and all(r.startswith(b"WARC/1.1\r\nWARC-Type: ") and r.endswith(b"\r\n\r\n") for r in records)
    for r in records:
        head, _, rest = r.partition(b"\r\n\r\n")
        assert len(rest) - 4 == int(head.split(b"Content-Length: ")[1])
    warc.write_archive(df.limit(0), str(tmp_path / "b"))
    assert warc.read_records(spark, str(tmp_path / "b")).count() == 0


def test_archive_refuses_damage(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"))
    rows = spark.read.parquet(str(tmp_path / "a/payloads"))
    rows.selectExpr("address", "cast('broken' as binary) payload", "holder").write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="doesn't fit its address"):
        warc.read_records(spark, str(tmp_path / "b")).collect()


def exact(rows, k):
    out = []
    for q, x in rows:
        if q % 20:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_search_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in addquant.nearest(df).collect()]
    want = exact(rows, 20)
    assert len(got) == len(want)
    hits = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want})
    assert hits >= 0.95 * len(want)
    for q in {g[0] for g in got}:
        own = sorted(g[1:] for g in got if g[0] == q)
        assert [r for r, _, _ in own] == list(range(1, 21)) and own == [(n + 1, i, s) for n, (s, i) in enumerate(sorted(((s, i) for _, i, s in own), key=lambda t: (-t[0], t[1])))]


def test_search_with_copies_ties_and_unusable_rows(spark):
    hot, other = [1.0, 0.0, 0.5], [0.9, 0.1, 0.5]
    rows = [(i, hot) for i in range(300)] + [(1000 + i, [v * (1 - i / 100) for v in other]) for i in range(30)]
    bad = [(2000, None), (2020, [0.0, 0.0, 0.0]), (2040, [float("nan"), 1.0, 1.0]), (2060, [None, 1.0, 1.0]), (2080, [1.0]), (2100, [float("inf"), 0.0, 1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in addquant.nearest(df).collect()) == exact(rows, 20)
    few = rows[:3] + bad
    assert sorted(tuple(r) for r in addquant.nearest(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()) == exact(rows[:3], 20)
    assert addquant.nearest(df.limit(0)).count() == 0


def _nearby(d, n=8000, seed=2):
    """Rows around a few hundred centres, and the true neighbours of every 40th."""
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(300, d))[rng.integers(0, 300, n)] + 0.7 * rng.normal(size=(n, d))).astype(np.float32)
    return x


def _truth(x, every, measure="inner", k=20):
    wide, asked = x.astype(np.float64), np.arange(0, len(x), every)
    score = wide[asked] @ wide.T if measure == "inner" else -((wide[asked, None] - wide[None]) ** 2).sum(2)
    score[np.arange(len(asked)), asked] = -np.inf
    return {int(q): set(np.argsort(-score[i], kind="stable")[:k].tolist()) for i, q in enumerate(asked)}


def _recall(found, want):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(got.get(q, set()) & want[q]) for q in want) / sum(map(len, want.values()))


def _vectors(spark, x, parts=2):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(parts)


@pytest.mark.parametrize("d", [64, 256])
def test_codes_find_what_a_twentieth_of_the_block_holds(spark, monkeypatch, d):
    x = _nearby(d)
    df, want = _vectors(spark, x), _truth(x, 40)
    monkeypatch.setattr(addquant, "SAMPLE", 3000)
    assert _recall(addquant.nearest(df, every=40, block=4000, shortlist=200), want) >= 0.9
    # the test is worth something only if codes that say nothing fail it
    blind = np.random.default_rng(1).normal(size=(addquant.BOOKS, addquant.WORDS, d)).astype(np.float32)
    assert _recall(addquant.search(*_noisy(df, blind * 0.01), blind * 0.01, 20, 200), want) < 0.5


def _noisy(df, books):
    from pyspark.sql import functions as F

    from tideline.llm.common import stored

    ready = addquant.usable(df, "vec_id", "embedding")
    index = stored(addquant.build_index(ready, books, 4000))
    # codes dealt at random
    shuffled = F.pandas_udf(lambda s: s.map(lambda raw: np.random.default_rng(5).integers(0, 256, len(raw)).astype(np.uint8).tobytes()), "binary")
    return index.withColumn("codes", shuffled("codes")), ready.filter("id % 40 = 0")


@pytest.mark.parametrize("measure", addquant.MEASURES)
def test_measured_shortlist_holds_the_recall(spark, monkeypatch, measure):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    df, want = _vectors(spark, x), _truth(x, 20, measure)
    monkeypatch.setattr(addquant, "SAMPLE", 1500)
    used = []
    full = addquant.measured_shortlist
    monkeypatch.setattr(addquant, "measured_shortlist", lambda *a: used.append(full(*a)) or used[-1])
    assert _recall(addquant.nearest(df, measure=measure, block=2000), want) >= 0.93
    # random vectors need a long one, near ones a short one
    assert 20 < used[0] < 1500
    near = _nearby(64, 4000)
    assert _recall(addquant.nearest(_vectors(spark, near), measure=measure, block=2000), _truth(near, 20, measure)) >= 0.93 and used[1] < used[0]
    with pytest.raises(ValueError, match="measure"):
        addquant.nearest(df.limit(50), measure="other")


@pytest.mark.parametrize("measure", addquant.MEASURES)
def test_exact_search_rests_on_its_bound(spark, monkeypatch, measure):
    x = _nearby(64, 3000)
    df, want = _vectors(spark, x), _truth(x, 20, measure)
    monkeypatch.setattr(addquant, "SAMPLE", 1500)
    assert _recall(addquant.nearest(df, measure=measure, exact=True, block=1500, shortlist=20), want) == 1
    books = addquant.fit(x[:1500])
    ready = addquant.usable(df, "vec_id", "embedding")
    index = addquant.build_index(ready, books, 1500)
    assert _recall(addquant.search(index, ready.filter("id % 20 = 0"), books, 20, 20, measure=measure), want) < 1


def test_repeated_query_ids_rank_apart(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [3.0, 0.5]), (2, [0.5, 3.0])]
    got = sorted(tuple(r) for r in addquant.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(20, 1, 1, 3.0), (20, 1, 2, 3.0), (20, 2, 1, 0.5), (20, 2, 2, 0.5)]


def test_scratch_folders_with_and_without_the_setting():
    from types import SimpleNamespace as Session

    from tideline.llm.common import shared_dir

    def session(master, base):
        return Session(conf=Session(get=lambda key, default: base), sparkContext=Session(master=master))

    assert shared_dir(session("yarn", "hdfs://x/shared/")).startswith("hdfs://x/shared/tideline-")
    assert "tideline-scratch" in shared_dir(session("local", None)) and "tideline-scratch" in shared_dir(session("local[4]", None))
    for master in ("yarn", "spark://host:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            shared_dir(session(master, None))


def test_pipeline_on_the_small_tables(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "").cache()
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
