"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one vector from each of several full-dimensional codebooks, found by a beam search over the
residuals; beside the code stand the norm of the sum and the norm of what it leaves of the vector. A search builds a lookup table
of inner products per query and codebook, scores all codes of a block by adding table entries (for distances less half the
squared norm), keeps the best `size` distinct vectors of every block and reranks them exactly in double precision. Every row is
indexed and every query meets every block; equal vectors of a block share a code and one place in the shortlist, so copies don't
crowd out others.

How many vectors of a block have to be reranked depends on the data, so it is measured: for the PROBES queries with the least hash
of their id the true k nearest of all rows are found, and where the codes rank each of them within its block; the shortlist is
the least that holds the RECALL of them. It grows up to whole blocks where codes say nothing. Both are parameters of `nearest`.

With exact=True nothing is left out: a vector's inner product is at most its table score and the query's norm times the stored
rest, so whatever may still reach the k-th best is reranked too.

Queries and blocks meet in tiles whose sizes follow memory, not the table: a block goes out once per QUERIES queries, with its
vectors in single precision where that is exact, and a query once per block. What a tile does grows with its area, what is
shuffled for it with its sides.

The codebooks are fitted on the SAMPLE vectors with the least hash of their id, a fixed bound; all else covers all rows.
Defined results: vectors that are null, zero, or hold a null, NaN or infinity take no part, nor do those of another length
than most; with fewer candidates than k all are returned; ties go to the smaller vec_id; repeated ids are separate rows, none of
which is a candidate for its like. An empty table, or one without a usable vector, gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import on_workers, stored

BOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors the codebooks are fitted on.
SAMPLE = 8192
#: Rows of a code block and of a query block.
BLOCK, QUERIES = 16384, 8192
#: Queries by which the shortlist is measured, and the share of their nearest that it must hold.
PROBES, RECALL = 128, 0.97
#: The shortlist of an exact search, which opens what it needs beyond it.
FIRST = 100
#: What nearness is: the largest inner product, or the least distance (its square, negative, is the score).
MEASURES = ("inner", "distance")


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, turns: int = 6, seed: int = 7) -> np.ndarray:
    """Residual codebooks (books, words, dimensions) by k-means on what the books before leave."""
    rng, rest, out = np.random.default_rng(seed), x.astype(np.float32).copy(), []
    for _ in range(books):
        c = rest[rng.permutation(len(rest))[:words]].copy()
        if len(c) < words:
            c = np.concatenate((c, np.zeros((words - len(c), x.shape[1]), np.float32)))
        for _ in range(turns):
            near = np.argmax(rest @ c.T - (c**2).sum(1) / 2, 1)
            total = np.zeros_like(c)
            np.add.at(total, near, rest)
            n = np.bincount(near, minlength=words)
            c[n > 0] = total[n > 0] / n[n > 0, None]
        rest = rest - c[np.argmax(rest @ c.T - (c**2).sum(1) / 2, 1)]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (one word of each book), the norms of their sums and of what they leave, by beam search."""
    n, (m, words, d) = len(x), books.shape
    rest, cost = x[:, None].astype(np.float32), (x**2).sum(1)[:, None]
    codes = np.zeros((n, 1, 0), np.uint8)
    for c in books:
        # |r - c|^2 = |r|^2 - 2 r.c + |c|^2
        grown = cost[:, :, None] - 2 * (rest.reshape(-1, d) @ c.T).reshape(n, -1, words) + (c**2).sum(1)
        flat = grown.reshape(n, -1)
        k = min(beam, flat.shape[1])
        best = np.argpartition(flat, k - 1, 1)[:, :k]
        from_, word = best // words, best % words
        cost = np.take_along_axis(flat, best, 1)
        rest = np.take_along_axis(rest, from_[:, :, None], 1) - c[word]
        codes = np.concatenate((np.take_along_axis(codes, from_[:, :, None], 1), word[:, :, None].astype(np.uint8)), 2)
    top = np.argmin(cost, 1)
    chosen = codes[np.arange(n), top]
    total = books[np.arange(m), chosen].astype(np.float64).sum(1)
    return chosen, np.linalg.norm(total, axis=1), np.linalg.norm(x - total, axis=1)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products along the last axis in double precision, added from left to right."""
    total = np.zeros(np.broadcast_shapes(x.shape[:-1], q.shape[:-1]))
    for i in range(x.shape[-1]):
        total += x[..., i].astype(np.float64) * q[..., i].astype(np.float64)
    return total


def distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, negative, in double precision, added from left to right."""
    total = np.zeros(np.broadcast_shapes(x.shape[:-1], q.shape[:-1]))
    for i in range(x.shape[-1]):
        total -= (x[..., i].astype(np.float64) - q[..., i].astype(np.float64)) ** 2
    return total


def table_scores(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The inner products of queries and sums, (queries, codes), by adding table entries."""
    score = np.zeros((len(table), len(codes)), np.float32)
    for m in range(codes.shape[1]):
        score += table[:, m][:, codes[:, m]]
    return score


def largest(score: np.ndarray, size: int) -> np.ndarray:
    """Per row the places of the largest scores, (rows, size)."""
    size = min(size, score.shape[1])
    return np.argpartition(-score, size - 1, 1)[:, :size]


def best_case(rough: np.ndarray, half: np.ndarray, rest: np.ndarray, query: np.ndarray, measure: str) -> np.ndarray:
    """The largest score that each coded vector can have: its rest may point along the query. Rounding of single precision is allowed for."""
    length = float(np.linalg.norm(query))
    if measure == "inner":
        return rough + (1 + 1e-5) * length * rest + 1e-4 * (length * (np.sqrt(2 * half) + rest) + 1e-30)
    # |q - x| is |q - sum| less |rest| at least
    away = np.sqrt(np.maximum(length**2 - 2 * rough.astype(np.float64) + 2 * half, 0))
    return -(np.maximum(away - rest - 1e-3 * (length + np.sqrt(2 * half) + rest), 0) ** 2)


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """key and vector (array<double> of one length, finite, not zero)."""
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast(T.ArrayType(T.DoubleType())).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    limit = float(np.finfo(np.float64).max)
    v = v.filter(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) <= limit)) & F.exists("v", lambda x: x != 0))
    most = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.filter(F.size("v") == (most["n"] if most else 0))


def build_index(vectors: DataFrame, books: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Blocks of all rows of vectors (id, v): ids, place of each row's distinct vector, vectors, codes, norms of sums and of rests."""
    on_workers(vectors.sparkSession)
    d = books.shape[2]

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, vs, held = [], [], 0

        def flush():
            nonlocal number
            i, v = np.concatenate(ids), np.concatenate(vs)
            order = np.argsort(i, kind="stable")
            i, v = i[order], v[order]
            _, lead, place = np.unique(np.ascontiguousarray(v).view(f"V{8 * d}").ravel(), return_index=True, return_inverse=True)
            distinct = v[lead]
            codes, norms, rests = (np.concatenate(x) for x in zip(*(encode(distinct[k : k + 2048], books) for k in range(0, len(distinct), 2048))))
            narrow = distinct.astype(np.float32)
            kept = narrow if np.array_equal(narrow, distinct) else distinct
            number += 1
            ids.clear()
            vs.clear()
            return pa.RecordBatch.from_pylist([{"block": number, "ids": i.tobytes(), "place": place.astype(np.int32).tobytes(), "vectors": kept.tobytes(), "codes": codes.tobytes(), "norms": norms.astype(np.float32).tobytes(), "rests": rests.astype(np.float32).tobytes()}])

        for b in batches:
            values = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            keys = b.column("id").to_numpy()
            for k in range(0, len(keys), block):
                ids.append(keys[k : k + block])
                vs.append(values[k : k + block])
                held += len(ids[-1])
                if held >= block:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return vectors.mapInArrow(run, "block long, ids binary, place binary, vectors binary, codes binary, norms binary, rests binary")


def least_hashed(rows: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """The n rows with the least hash of their id. Rows whose hash is far from the least are left out before they are sorted, so that tasks hand over about n rows together, not each."""
    hashed = F.xxhash64("id", F.lit(salt))
    share = 2 * n / max(1, rows.count())
    # over the whole range of a long, from its least value
    some = rows if share >= 1 else rows.filter(hashed < int(-(2**63) + share * 2**64))
    if share < 1 and some.limit(n).count() < n:
        some = rows
    return some.orderBy(hashed, "id").limit(n)


def opened(part: dict, d: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, place of each row's distinct vector, codes, vectors and half the squared norms of their sums."""
    codes = np.frombuffer(part["codes"], np.uint8).reshape(-1, m)
    vectors = np.frombuffer(part["vectors"], np.float32 if len(part["vectors"]) == 4 * d * len(codes) else np.float64).reshape(-1, d)
    return np.frombuffer(part["ids"], np.int64), np.frombuffer(part["place"], np.int32), codes, vectors, np.frombuffer(part["norms"], np.float32) ** 2 / 2


def measured_shortlist(index: DataFrame, queries: DataFrame, books: np.ndarray, k: int, recall: float = RECALL, measure: str = "inner", probes: int = PROBES) -> int:
    """Distinct vectors of a block that have to be reranked so that the share `recall` of the true k nearest of some queries is found."""
    d, m = books.shape[2], books.shape[0]
    some = least_hashed(queries, probes, 1).select("id", "v").toPandas()
    if not len(some):
        return k
    own, q = some["id"].to_numpy(), np.array(some["v"].tolist())
    measured = inner if measure == "inner" else distance

    def run(batches):
        best = [np.zeros((0, 3)) for _ in own]
        for b in batches:
            for part in b.to_pylist():
                ids, place, codes, vectors, half = opened(part, d, m)
                rough = table_scores(np.einsum("qd,mwd->qmw", q.astype(np.float32), books, optimize=True), codes)
                rough = rough if measure == "inner" else rough - half
                for i, key in enumerate(own):
                    rows = np.bincount(place[ids != key], minlength=len(vectors))
                    score = measured(vectors, q[i])
                    there = np.flatnonzero(rows)
                    top = there[largest(score[there][None], k)[0]] if len(there) else there
                    # a tie counts as ranked ahead
                    rank = len(codes) - np.searchsorted(np.sort(rough[i]), rough[i][top])
                    found = np.concatenate((best[i], np.stack((score[top], rank, rows[top]), 1)))
                    best[i] = found[np.argsort(-found[:, 0], kind="stable")[:k]]
        probe = np.repeat(np.arange(len(own)), [len(x) for x in best])
        flat = np.concatenate(best)
        yield pa.RecordBatch.from_pydict({"probe": pa.array(probe, pa.int32()), "score": pa.array(flat[:, 0]), "place": pa.array(flat[:, 1].astype(np.int64)), "n": pa.array(flat[:, 2].astype(np.int64))})

    tops = index.select("ids", "place", "vectors", "codes", "norms").mapInArrow(run, "probe int, score double, place long, n long")
    tops = tops.withColumn("r", F.expr("row_number() OVER (PARTITION BY probe ORDER BY score DESC, place)")).filter(F.col("r") <= k)
    # rows up to the k-th of each probe; the last vector's copies count as far as they are needed
    before = F.coalesce(F.expr("sum(n) OVER (PARTITION BY probe ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    got = tops.withColumn("n", F.least("n", F.lit(k) - before)).filter("n > 0").groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").toPandas()
    reached = got["n"].cumsum().to_numpy()
    return max(k, int(got["place"].to_numpy()[np.searchsorted(reached, recall * reached[-1])])) if len(got) else k


def search(index: DataFrame, queries: DataFrame, books: np.ndarray, k: int, size: int, per_tile: int = QUERIES, measure: str = "inner", exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest other rows; queries: id, v. exact: by proof, not by shortlist."""
    d, m = books.shape[2], books.shape[0]
    # a block's number is its place in its partition behind the blocks of partitions before; the driver gets a count of each
    per = index.groupBy((F.shiftright("block", 32)).cast("int").alias("of")).agg(F.count("*").alias("n")).orderBy("of").collect()
    blocks, turns, starts = sum(r["n"] for r in per), max(1, -(-queries.count() // per_tile)), np.r_[0, np.cumsum([r["n"] for r in per])]
    numbered = index.sparkSession.createDataFrame([(r["of"], int(s)) for r, s in zip(per, starts)], "of int, start long")
    numbered = index.select("block").join(F.broadcast(numbered), F.shiftright("block", 32).cast("int") == F.col("of")).select("block", (F.col("start") + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))).cast("int").alias("b"))
    asked = queries.withColumn("ask", F.monotonically_increasing_id()).withColumn("q", F.pmod(F.xxhash64("id", "ask"), F.lit(turns)).cast("int"))
    # distinct queries of one vector id keep apart by ask
    columns = ["ids", "place", "vectors", "codes", "norms", *["rests"] * exact]
    left = index.join(numbered, "block").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).select("b", "q", F.struct(*columns).alias("part"), *[F.lit(None).cast("long").alias(c) for c in ("ask", "id")], F.lit(None).cast("array<double>").alias("v"))
    right = asked.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(max(1, blocks))))).select("b", "q", F.lit(None).cast(left.schema["part"].dataType).alias("part"), "ask", "id", "v")
    measured = inner if measure == "inner" else distance

    def tile(t: pa.Table) -> pa.Table:
        out = {"ask": [], "query_id": [], "vec_id": [], "score": []}
        parts = [p for p in t.column("part").to_pylist() if p and p["ids"] is not None]
        asks = t.filter(t.column("id").is_valid())
        if parts and asks.num_rows:
            ask, qid = asks.column("ask").to_numpy(), asks.column("id").to_numpy()
            q = asks.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for p in parts:
                ids, place, codes, vectors, half = opened(p, d, m)
                order = np.argsort(place, kind="stable")
                first = np.searchsorted(place[order], np.arange(len(vectors) + 1))
                for at in range(0, len(qid), 64):
                    some = q[at : at + 64]
                    rough = table_scores(np.einsum("qd,mwd->qmw", some.astype(np.float32), books, optimize=True), codes)
                    near = largest(rough if measure == "inner" else rough - half, size)
                    score = measured(vectors[near], some[:, None])
                    for i in range(len(near)):
                        chosen, value = near[i], score[i]
                        if exact and len(chosen) < len(vectors):
                            # the own row's vector may be among the best, so the (k + 1)-th best of the shortlist is the mark
                            mark = np.sort(value)[-min(k + 1, len(value))]
                            rest = np.frombuffer(p["rests"], np.float32)
                            chosen = np.union1d(chosen, np.flatnonzero(best_case(rough[i], half, rest, some[i], measure) >= mark))
                            value = measured(vectors[chosen], some[i])
                        best = np.argsort(-value, kind="stable")
                        # rows of one score compete by id, so all vectors that reach the k-th score are opened
                        ranked = value[best]
                        upto = int(np.searchsorted(-ranked, -ranked[min(k, len(ranked) - 1)], "right"))
                        rows = [order[first[x] : first[x + 1]] for x in chosen[best[:upto]]]
                        own, s = ids[np.concatenate(rows)], np.repeat(ranked[:upto], [len(r) for r in rows])
                        keep = own != qid[at + i]
                        own, s = own[keep], s[keep]
                        top = np.lexsort((own, -s))[:k]
                        out["ask"].append(np.full(len(top), ask[at + i]))
                        out["query_id"].append(np.full(len(top), qid[at + i]))
                        out["vec_id"].append(own[top])
                        out["score"].append(s[top])
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.float64 if c == "score" else np.int64)) for c, v in out.items()})

    found = left.unionByName(right).groupBy("b", "q").applyInArrow(tile, "ask long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id, ask ORDER BY score DESC, vec_id)")).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", column: str = "embedding", measure: str = "inner", exact: bool = False, block: int | None = None, shortlist: int | None = None, recall: float = RECALL) -> DataFrame:
    """The k nearest of every row whose key is divisible by `every`, against all other rows.

    shortlist: distinct vectors of a block that are reranked for a query; without it as many as the share `recall` of a sample's true
    nearest needs. exact: none is missed, at the cost of more reranking.
    """
    if measure not in MEASURES:
        raise ValueError(f"no measure {measure}")
    ready = usable(vectors, key, column)
    sample = least_hashed(ready, SAMPLE).select("v").toPandas()
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit(np.array(sample["v"].tolist()))
    index, queries = stored(build_index(ready, books, block or BLOCK)), ready.filter(F.col("id") % every == 0)
    if shortlist is None:
        shortlist = FIRST if exact else measured_shortlist(index, queries, books, k, recall, measure)
    return search(index, queries, books, k, max(k, shortlist), measure=measure, exact=exact)
