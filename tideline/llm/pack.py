"""Best-fit packing by several capacities: residual tokens, document count and attention cost.

Documents are encoded, cut only where they are longer than a sequence, and the pieces packed in decreasing length. Of the open
sequences that have room in every dimension, a piece goes to the one with the largest weighted dot product of its demand and
the residual, or (the default) the one whose residual norm after placing is smallest. Pieces are dealt by a hash of their
row into groups of bounded size that are packed side by side. What a group leaves in badly filled sequences is packed again
with other groups' rest.

A piece of n tokens costs n squared. Where documents or cost are given, they bind beside the tokens: pack_documents cuts at the
largest length that tokens and cost allow, and a piece handed to pack that exceeds a capacity by itself gets a sequence of its own.

Defined results: a null or empty text is one piece that holds only the end id; ties go to the earlier document, then to the
older sequence; repeated rows are packed each; an empty table gives an empty result; other columns are not read; a text may be
as long as memory allows, its pieces are packed apart.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .common import on_workers, stored

#: Pieces that are packed together at most on average; a group's work grows with its square.
GROUP = 6000
#: Sequences filled to less than this are opened again and packed with others'.
FULL = 0.97


def cut_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, a row number and, if asked for, ids."""
    on_workers(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        enc, row = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in slices(whole, "text"):
                ids, at = enc.encode(b.column("text").to_pylist())
                doc, piece, start, size, crc, parts = [], [], [], [], [], []
                for i, d in enumerate(b.column("doc_id").to_pylist()):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), length)):
                        part = own[s : s + length]
                        doc.append(d)
                        piece.append(k)
                        start.append(s)
                        size.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            parts.append(part.astype(np.int32))
                cols = {"doc_id": pa.array(doc, b.column("doc_id").type), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "row": pa.array(np.arange(row, row + len(doc)))}
                if with_ids:
                    cols["ids"] = pa.array(parts, pa.list_(pa.int32()))
                row += len(doc)
                yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long" + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, tokens: int, documents: int, cost: int, weights=(1.0, 0.05, 0.05), rule: str = "norm") -> np.ndarray:
    """The sequence of each piece; lengths must fall. What exceeds a capacity by itself gets a sequence of its own."""
    cap, w = np.array([tokens, documents, cost], np.float64), np.array(weights, np.float64)
    out = np.empty(len(lengths), np.int64)
    left, ids, open_, made, rooms = np.empty((3, 256), np.int64), np.empty(256, np.int64), 0, 0, -1
    for i, size in enumerate(lengths.tolist()):
        need = (size, 1, size * size)
        at = -1
        if size <= rooms:
            have = left[:, :open_]
            fits = np.flatnonzero((have[0] >= need[0]) & (have[1] >= need[1]) & (have[2] >= need[2]))
            if len(fits):
                rest = have[:, fits] / cap[:, None]
                demand = (np.array(need) / cap)[:, None]
                score = (w[:, None] * (rest - demand) ** 2).sum(0) if rule == "norm" else -(w[:, None] * rest * demand).sum(0)
                at = fits[np.argmin(score)]
        if at < 0:
            if open_ == left.shape[1]:
                left, ids = np.concatenate((left, np.empty_like(left)), 1), np.concatenate((ids, np.empty_like(ids)))
            at, open_ = open_, open_ + 1
            left[:, at], ids[at] = (tokens, documents, cost), made
            made += 1
        left[:, at] -= need
        out[i] = ids[at]
        if left[0, at] <= 0 or left[1, at] <= 0 or left[2, at] <= 0:
            # a full sequence leaves; the last open one takes its place
            open_ -= 1
            left[:, at], ids[at] = left[:, open_], ids[open_]
        rooms = int(left[0, :open_].max()) if open_ else -1
    return out


def pack(pieces: DataFrame, tokens: int = 2048, documents: int | None = None, cost: int | None = None, weights=(1.0, 0.05, 0.05), rule: str = "norm", rounds: int = 2) -> DataFrame:
    """pieces (doc_id, piece, length, row and more) with sequence_id and offset. Without documents and cost only tokens bind."""
    spark = pieces.sparkSession
    on_workers(spark)
    documents, cost = tokens if documents is None else documents, tokens * tokens if cost is None else cost
    if min(tokens, documents, cost) < 1:
        raise ValueError("capacities must be positive")
    done: list[DataFrame] = []
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, again boolean"

    def packer(last: bool, turn: int):
        def run(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
            size = t.column("length").to_numpy()
            seq = best_fit(size, tokens, documents, cost, weights, rule)
            order = np.argsort(seq, kind="stable")
            seq, size, t = seq[order], size[order], t.take(pa.array(order))
            head = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            total = np.concatenate(([0], np.cumsum(size)[:-1]))
            offset = total - np.repeat(total[head], np.diff(np.append(head, len(seq))))
            fill = np.bincount(seq, weights=size, minlength=seq.max() + 1)
            again = np.zeros(len(seq), bool) if last else fill[seq] < FULL * tokens
            sid = (int(key[0].as_py()) * 4 + turn << 24) + seq
            return t.append_column("sequence_id", pa.array(sid)).append_column("offset", pa.array(offset)).append_column("again", pa.array(again))

        return run

    rest = pieces
    for turn in range(rounds):
        count = rest.count()
        groups = max(1, -(-count // GROUP))
        last = turn == rounds - 1 or groups == 1
        dealt = rest.withColumn("_group", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)).cast("long"))
        packed = stored(dealt.groupBy("_group").applyInArrow(_without_group(packer(last, turn), names), schema))
        done.append(packed.filter(~F.col("again")).drop("again"))
        if last:
            break
        rest = packed.filter("again").select(*names)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _without_group(run, names):
    def call(key: tuple, t: pa.Table) -> pa.Table:
        return run(key, t.select(names))

    return call


def pack_documents(docs: DataFrame, tokenizer: str, tokens: int = 2048, documents: int | None = None, cost: int | None = None) -> DataFrame:
    """Every document's pieces with their sequence and their place in it."""
    longest = tokens if cost is None else min(tokens, max(1, math.isqrt(cost)))
    pieces = stored(cut_pieces(docs, tokenizer, longest))
    return pack(pieces, tokens, documents, cost).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
