"""Token ids in grammar-compressed files: per shard, frequent id pairs are replaced again and again by new symbols (Re-Pair).

A file is a table of shards in ascending doc_id order. A shard holds the rules (left and right symbol of each nonterminal), how
many ids each nonterminal expands to, the compressed sequence, each document's doc_id and id count, and its least and largest
doc_id. A document, or any range of ids, is decoded by finding its symbols through the running sum of expansion lengths and
expanding only those; shards that can't hold a doc_id are not read.

Each round counts the pairs of the shard that may stand LEAST times without overlap. Where two such pairs overlap, the more
frequent one is replaced; then the next round counts only pairs at places that changed or that lost. A shard is done when no
pair stands LEAST times without overlap; no round, rule or expansion is capped.

Rows are dealt by ranges of doc_id, text hash and row place, so one doc_id, or rows without any, spread over as many shards as
they need. A task encodes its range once and closes a shard whenever SHARD_BYTES of text are together, so memory follows neither
the corpus nor a range; a document longer than that has a shard of its own.

Defined results: a null or empty text has only the end id; rows that share a doc_id follow each other, ordered by text hash;
null doc_ids come first; other columns are not read; an empty table makes an empty file.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .common import on_workers, shared_dir, shuffle_partitions

#: Bytes of text that a shard covers, and bytes of text that a task of the writer takes.
SHARD_BYTES, TASK_BYTES = 4 << 20, 256 << 20
#: Occurrences without overlap that a pair must have.
LEAST = 4
#: Times that places which lost to a neighbour strive again within a round.
TRIES = 2
_U, _ODD, _SLOTS = np.uint64, 0x9E3779B97F4A7C15, 20


def _chosen(place: np.ndarray) -> np.ndarray:
    """Which of the ascending places are taken where neighbours overlap: in a row, every other one from the left."""
    start = np.flatnonzero(np.diff(place, prepend=-2) != 1)
    return (np.arange(len(place)) - np.repeat(start, np.diff(np.append(start, len(place))))) % 2 == 0


def _winners(place: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending) that overlap no place of a better rank, and their ranks."""
    won = []
    for _ in range(TRIES):
        touch = place[1:] == place[:-1] + 1
        take = np.ones(len(place), bool)
        take[1:] &= ~(touch & (rank[:-1] <= rank[1:]))
        take[:-1] &= ~(touch & (rank[1:] < rank[:-1]))
        won.append((place[take], rank[take]))
        rest = ~take
        rest[1:] &= ~(touch & take[:-1])
        rest[:-1] &= ~(touch & take[1:])
        place, rank = place[rest], rank[rest]
        if not len(place):
            break
    return np.concatenate([p for p, _ in won]), np.concatenate([r for _, r in won])


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (two symbols each), their expansion lengths, and the sequence over ids below base and nonterminals from base on."""
    seq, rules, lengths = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], [np.zeros(0, np.int64)]
    size = np.ones(base, np.int64)
    # places whose pair may still stand LEAST times: a pair of old symbols never grows more frequent
    live = np.arange(max(len(seq) - 1, 0))
    while len(live):
        pair = seq[live].astype(_U) << _U(32) | seq[live + 1]
        # a hash of few bits rules out most rare pairs; what it leaves is counted exactly
        slot = ((pair * _U(_ODD)) >> _U(64 - _SLOTS)).astype(np.int32)
        some = (np.bincount(slot, minlength=1 << _SLOTS) >= LEAST)[slot]
        live, pair = live[some], pair[some]
        table = pa.array(pair).dictionary_encode()
        kind, kinds = table.indices.to_numpy(), table.dictionary.to_numpy()
        # equal symbols in a row overlap themselves
        own = np.ones(len(live), bool)
        if (double := (pair >> _U(32)) == (pair & _U(0xFFFFFFFF))).any():
            own[double] = _chosen(live[double])
        count = np.bincount(kind[own] if double.any() else kind, minlength=len(kinds))
        frequent = np.flatnonzero(count >= LEAST)
        if not len(frequent):
            break
        # the more frequent pair is better; a hash decides ties, since an order along the text would let one place of a row win at a time
        order = np.argsort((-count[frequent] << 24) + ((kinds[frequent] * _U(_ODD)) >> _U(40)).astype(np.int64))
        rank = np.full(len(kinds), -1, np.int32)
        rank[frequent[order]] = np.arange(len(frequent), dtype=np.int32)
        rank = rank[kind]
        many = rank >= 0
        live, rank, own = live[many], rank[many], own[many]
        # from here a kind is its rank
        kinds = kinds[frequent[order]]
        place, found = _winners(live[own], rank[own])
        # the best pair loses nowhere, so a round replaces one pair at least
        good = np.bincount(found, minlength=len(kinds)) >= LEAST - 1
        used = good[found]
        place, found, kinds = place[used], (np.cumsum(good) - 1)[found[used]], kinds[good]
        open_ = np.zeros(len(seq), bool)
        open_[live] = True
        open_[place] = open_[np.maximum(place - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[place + 1] = False
        seq[place] = (len(size) + found).astype(np.uint32)
        seq, open_ = seq[keep], open_[keep]
        live = np.flatnonzero(open_[:-1])
        first, second = (kinds >> _U(32)).astype(np.int64), (kinds & _U(0xFFFFFFFF)).astype(np.int64)
        rules.append(np.stack((first, second), 1).astype(np.uint32))
        lengths.append(size[first] + size[second])
        size = np.concatenate((size, lengths[-1]))
    return np.concatenate(rules), np.concatenate(lengths), seq


def _sizes(seq: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    return np.where(seq < base, 1, lengths[np.maximum(seq.astype(np.int64) - base, 0)] if len(lengths) else 1).astype(np.int64)


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that the symbols stand for. Every symbol is written to its place, so depth costs nothing."""
    each = _sizes(seq, lengths, base)
    ends = np.cumsum(each)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    at = ends - each
    while len(seq):
        low = seq < base
        out[at[low]] = seq[low]
        seq, at = seq[~low], at[~low]
        pair = rules[seq.astype(np.int64) - base]
        seq, at = np.concatenate((pair[:, 0], pair[:, 1])), np.concatenate((at, at + _sizes(pair[:, 0], lengths, base)))
    return out


def read_range(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """The ids from start to stop of a shard, expanding only the symbols that hold them."""
    ends = np.cumsum(_sizes(seq, lengths, base))
    i, j = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    before = int(ends[i - 1]) if i else 0
    return expand(seq[i:j], rules, lengths, base)[start - before : stop - before]


def _narrow(seq: np.ndarray) -> bytes:
    return seq.astype("<u2" if not len(seq) or seq.max() < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


_FORMAT = "shard long, base long, n_rules long, n_symbols long, rules binary, lengths binary, symbols binary, doc_ids binary, no_id binary, counts binary, n_ids long, least_id long, largest_id long"
_SHARD = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.binary()) for f in _FORMAT.split(", ")])


def _shard(number: int, base: int, docs: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
    """One shard of the documents whose doc_ids and ids (with the end id) are given."""
    ids, doc = np.concatenate(parts), pa.concat_arrays(docs)
    rules, lengths, seq = compress(ids, base)
    known = doc.drop_null().to_numpy()
    row = {
        "shard": number, "base": base, "n_rules": len(rules), "n_symbols": len(seq), "rules": _narrow(rules.ravel()), "lengths": lengths.astype("<u4").tobytes(), "symbols": _narrow(seq),
        "doc_ids": doc.fill_null(0).to_numpy().astype("<i8").tobytes(), "no_id": doc.is_null().to_numpy(zero_copy_only=False).tobytes(), "counts": np.array([len(p) for p in parts], "<u4").tobytes(), "n_ids": len(ids),
        "least_id": int(known[0]) if len(known) else None, "largest_id": int(known[-1]) if len(known) else None,
    }
    return pa.RecordBatch.from_pylist([row], schema=_SHARD)


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes every text, appends end_id and writes the ids in ascending doc_id order to the file at path."""
    spark = docs.sparkSession
    on_workers(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", "hash", "place"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    ranges = rows.repartitionByRange(max(shuffle_partitions(spark), int(total // TASK_BYTES)), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        enc, number = encoder(tokenizer), TaskContext.get().partitionId() << 32
        base, end = len(enc.token_bytes), np.array([end_id], np.uint32)
        held, doc, parts = 0, [], []
        for whole in batches:
            for b in slices(whole, "text", shard_bytes):
                if parts and held + b.column("text").nbytes > shard_bytes:
                    yield _shard(number, base, doc, parts)
                    number, held, doc, parts = number + 1, 0, [], []
                ids, at = enc.encode(b.column("text").to_pylist())
                doc.append(b.column("doc_id"))
                parts += [np.concatenate((ids[at[i] : at[i + 1]], end)) for i in range(b.num_rows)]
                held += b.column("text").nbytes
        if parts:
            yield _shard(number, base, doc, parts)

    ranges.mapInArrow(run, _FORMAT).write.parquet(path)


def _starts(files: DataFrame) -> DataFrame:
    """How many ids stand before each shard: within its task's shards, and in all tasks before."""
    shards = files.select("shard", "n_ids", F.shiftright("shard", 32).alias("_task"))
    within = shards.withColumn("_in", F.expr("sum(n_ids) OVER (PARTITION BY _task ORDER BY shard) - n_ids"))
    # one row per task of the writer
    tasks = shards.groupBy("_task").agg(F.sum("n_ids").alias("_n")).select("_task", F.expr("sum(_n) OVER (ORDER BY _task) - _n").alias("_before"))
    return within.join(tasks, "_task").select("shard", (F.col("_before") + F.col("_in")).alias("before"))


_READ = ("shard", "base", "n_rules", "n_symbols", "rules", "lengths", "symbols", "doc_ids", "no_id", "counts")


def _open(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules, expansion lengths and the places where documents begin (and the last one's end) of a shard."""
    rules, lengths = _wide(r["rules"], 2 * r["n_rules"]).reshape(-1, 2), np.frombuffer(r["lengths"], "<u4").astype(np.int64)
    return _wide(r["symbols"], r["n_symbols"]), rules, lengths, np.concatenate(([0], np.cumsum(np.frombuffer(r["counts"], "<u4").astype(np.int64))))


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document of the file at path."""
    on_workers(spark)
    files = spark.read.parquet(path)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                seq, rules, lengths, at = _open(r)
                ids, n = expand(seq, rules, lengths, r["base"]).astype("<u4"), len(at) - 1
                doc = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["no_id"], bool))
                crc = [zlib.crc32(ids[at[i] : at[i + 1]].data) for i in range(n)]
                cols = {"shard": pa.array(np.full(n, r["shard"])), "doc_id": doc, "start": pa.array(at[:-1]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array([ids[at[i] : at[i + 1]].astype(np.int32) for i in range(n)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    more = ", ids array<int>" * with_ids
    rows = files.select(*_READ).mapInArrow(run, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long" + more)
    # the documents' narrow rows meet the shards' starts, so no ids are moved
    joined = rows.join(_starts(files), "shard").withColumn("start", F.col("start") + F.col("before"))
    return joined.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """doc_id and ids of the documents with that doc_id; only shards that may hold it are read, and only its symbols expanded."""
    on_workers(spark)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                seq, rules, lengths, at = _open(r)
                hit = np.flatnonzero((np.frombuffer(r["doc_ids"], "<i8") == doc_id) & ~np.frombuffer(r["no_id"], bool))
                ids = [read_range(seq, rules, lengths, r["base"], int(at[i]), int(at[i + 1])).astype(np.int32) for i in hit]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.full(len(hit), doc_id, np.int64)), "ids": pa.array(ids, pa.list_(pa.int32()))})

    near = spark.read.parquet(path).filter((F.col("least_id") <= doc_id) & (F.col("largest_id") >= doc_id))
    return near.select(*_READ).mapInArrow(run, "doc_id long, ids array<int>")


def write_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = shared_dir(docs.sparkSession)
    write_ids(docs, tokenizer, path)
    return read_ids(docs.sparkSession, path)
