"""Token counts of a unigram tokenizer without its tokens: Viterbi that carries best score and piece count only.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at a position; dynamic programming keeps the
best score and its number of pieces. Ties go as in the tokenizers library's unigram model: of equal scores for a position
the piece that starts first stays, and a character without a piece of its own may be unknown at ten below the least score,
counted as its bytes. No piece spans the place before a space mark that follows another character, nor a character that
occurs in no piece, so texts fall apart there; each distinct part of a batch is solved once and its score and count added.
That is exact while scores add without rounding, as whole-number scores do up to 2**53; under a model with other scores, whose
sums round as they grow, a text is solved whole from its first character on, as the library does.

Defined results: null and empty texts have no tokens and score 0; repeated rows are counted each; other columns are dropped; a
text is held whole, in arrays of its length, but no other than it.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import CACHE, CHUNK, distinct_spans, slices
from .common import on_workers

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece model file, in the order of their ids."""

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = raw[at]
            n |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return n, at

    def fields(at: int, end: int):
        while at < end:
            tag, at = varint(at)
            if tag & 7 == 2:
                n, at = varint(at)
                yield tag >> 3, (at, at + n)
                at += n
            elif tag & 7 == 5:
                yield tag >> 3, (at, at + 4)
                at += 4
            else:
                _, at = varint(at)

    raw = open(path, "rb").read()
    out = []
    for number, span in fields(0, len(raw)):
        if number == 1:
            parts = dict(fields(*span))
            text, score = parts.get(1, (0, 0)), parts.get(2)
            out.append((raw[text[0] : text[1]].decode(), struct.unpack("<f", raw[score[0] : score[1]])[0] if score else 0.0))
    return out


class Counter:
    def __init__(self, path: str):
        import ahocorasick

        self.pieces = read_pieces(path)
        self.automaton = ahocorasick.Automaton()
        last = {}
        for piece, score in self.pieces:
            last[piece] = score
        for piece, score in last.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.alone = {p for p in last if len(p) == 1}
        self.unknown = min(s for _, s in self.pieces) - UNKNOWN_PENALTY
        self.foreign = np.ones(0x110000, bool)
        self.foreign[[ord(c) for c in {c for p in last for c in p}]] = False
        if any(MARK in p.lstrip(MARK) for p in last):
            raise ValueError("a piece has a space mark after another character")
        #: Whether parts of a text may be solved apart.
        self.adds = all(score == int(score) for score in last.values())
        self.known: dict[str, tuple[float, int]] = {}

    def solve(self, text: str) -> tuple[float, int]:
        """Best score and number of tokens of a part."""
        if (got := self.known.get(text)) is not None:
            return got
        n = len(text)
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (size, value) in self.automaton.iter(text):
            ends[end + 1].append((end + 1 - size, value))
        for end in range(1, n + 1):
            best, pieces = None, 0
            for start, value in sorted(ends[end]):
                if best is None or score[start] + value > best:
                    best, pieces = score[start] + value, count[start] + 1
            if text[end - 1] not in self.alone and (best is None or score[end - 1] + self.unknown > best):
                best, pieces = score[end - 1] + self.unknown, count[end - 1] + len(text[end - 1].encode())
            score[end], count[end] = best, pieces
        if len(self.known) > CACHE:
            self.known.clear()
        self.known[text] = score[n], count[n]
        return score[n], count[n]

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens and score of every text."""
        n, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") < CHUNK):
                size += len(texts[to] or "")
                to += 1
            n[at:to], score[at:to] = self._chunk([(MARK + t.replace(" ", MARK)) if t else "" for t in texts[at:to]])
            at = to
        return n, score

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        every = "".join(texts)
        if not every:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts))
        cp = np.frombuffer(every.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        mark, foreign = cp == ord(MARK), self.foreign[cp]
        cut = np.ones(len(cp), bool)
        cut[1:] = ((mark[1:] & ~mark[:-1]) | foreign[1:] | foreign[:-1]) & self.adds
        cut[ends[:-1][ends[:-1] < len(cp)]] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(cp))
        codes, lead = distinct_spans(cp, s, e)
        solved = [self.solve(every[i:j]) for i, j in zip(s[lead].tolist(), e[lead].tolist())]
        each_score, each = np.array([x for x, _ in solved]), np.array([x for _, x in solved], np.int64)
        owner = np.searchsorted(ends, s, "right")
        return np.bincount(owner, each[codes], len(texts)).astype(np.int64), np.bincount(owner, each_score[codes], len(texts))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and score of every text under the unigram vocabulary of the model file."""
    on_workers(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for b in slices(whole, text):
                n, score = counter(model).count(b.column(text).to_pylist())
                yield pa.RecordBatch.from_pydict({key: b.column(key), "n_tokens": pa.array(n), "score": pa.array(score)})

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, score double")
