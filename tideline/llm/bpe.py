"""Byte-level BPE encoding and decoding by forced boundaries.

A text is first cut into pre-tokens by the tokenizer's own pattern. Inside a pre-token, two neighbouring bytes that stand
together in no vocabulary token mark a certain cut: no token can span them, so the fragments on both sides are encoded
independently and their ids concatenated. Pre-tokens repeat, so a batch is cut and grouped with array operations and each
distinct pre-token is encoded once by the tokenizer's BPE model.

Fragments up to LONG bytes are merged side by side, a step of all at a time; longer ones one by one through a heap of their pairs.
Both apply the merges in the order of their ranks, leftmost first. The string of a special token in a text becomes its id, and
the text before and behind it is encoded apart.

Defined results: null and empty texts have no ids and decode to ''. A text may be as long as memory allows: it is handled in
chunks that end where a pre-token does in any script. Repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import on_workers

#: Code points handled at a time; a longer text is cut behind a letter, where a mark or a space with a letter behind it begins a pre-token.
CHUNK = 1 << 20
#: Distinct pre-tokens whose ids a worker keeps.
CACHE = 400_000
#: Bytes of a fragment up to which fragments are merged side by side.
LONG = 48
LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 0
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(1)
def classes() -> np.ndarray:
    """Each code point's class as the tokenizers library sees it, asked from its own regular expressions."""
    from tokenizers import Regex, normalizers

    cps = np.r_[1:0xD800, 0xE000:0x110000].astype(np.uint32)
    every = cps.astype("<u4").tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        got = normalizers.Replace(Regex(pattern), "\x00").normalize_str(every)
        out[cps[np.frombuffer(got.encode("utf-32-le"), np.uint32) == 0]] = kind
    return out


@lru_cache(1)
def _mixed() -> np.ndarray:
    x = np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, _MULT, np.uint64), np.full(size, pow(_MULT, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def safe_end(text: str, at: int) -> int:
    """The first place from at on where a text may be cut without changing its pre-tokens; its end if there is none."""
    kinds = classes()
    while at < len(text) - 2:
        cp = np.frombuffer(text[at : at + (1 << 16) + 2].encode("utf-32-le"), np.uint32)
        kind = kinds[cp]
        ends = (kind[:-2] == LETTER) & ((kind[1:-1] == OTHER) | ((cp[1:-1] == 32) & (kind[2:] == LETTER)))
        if ends.any():
            return at + int(np.argmax(ends)) + 1
        at += len(cp) - 2
    return len(text)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def distinct_spans(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans [s, e) of code points that rise: the number of each one's text, and a span that has the text of each number."""
    up, down = powers(len(cp))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed()[cp] * up, dtype=np.uint64)))
    key = (total[e] - total[s]) * down[s]
    key ^= key >> np.uint64(31)
    codes, _ = pd.factorize(key)
    lead = np.empty(codes.max() + 1, np.int64)
    lead[codes[::-1]] = np.arange(len(codes))[::-1]
    size = e - s
    # equal keys are held against their texts, so a clash of keys can't pass
    same = np.array_equal(size, size[lead][codes])
    if same:
        place = np.repeat((s[lead][codes] - s).astype(np.int32), size)
        if len(place) == len(cp):
            place += np.arange(len(cp), dtype=np.int32)
            same = np.array_equal(cp.take(place), cp)
        else:
            own = np.repeat((s - np.concatenate(([0], np.cumsum(size)[:-1]))).astype(np.int32), size) + np.arange(len(place), dtype=np.int32)
            same = np.array_equal(cp.take(own + place), cp.take(own))
    if not same:
        codes, lead = np.arange(len(s)), np.arange(len(s))
    return codes, lead


class PairTable:
    """Finds the ranks of pairs of ids by open addressing over arrays."""

    def __init__(self, pairs: list[tuple[int, int]]):
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        keys = np.array([x << 32 | y for x, y in pairs], np.int64)
        for key, at, rank in zip(keys.tolist(), self._slots(keys).tolist(), range(len(pairs))):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_MULT)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray, never: int) -> np.ndarray:
        keys = left << 32 | right
        at = self._slots(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.ranks[at], never)
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out


class Encoder:
    """Encodes texts as the tokenizers library does with the given file and add_special_tokens=False."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the first of several that begin at one place is the longest
        self._split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else re.compile("(?!)")
        self.suffix = spec["model"]["end_of_word_suffix"]
        #: Word tokenizers lower the text, drop white space and take digits one by one; they end words by a suffix.
        self.by_word = bool(self.suffix)
        self.chars = byte_chars()
        back = {c: i for i, c in enumerate(self.chars)}
        ids = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.token_bytes = [b""] * (max(ids.values()) + 1)
        self.joined = np.zeros((256, 256), bool)
        for token, i in ids.items():
            if not self.by_word:
                raw = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
                self.token_bytes[i] = raw
                if token not in self.special:
                    b = np.frombuffer(raw, np.uint8)
                    self.joined[b[:-1], b[1:]] = True
        self._byte_id = np.array([ids[c] for c in self.chars], np.int64)
        self._last_id = np.array([ids[c + (self.suffix or "")] for c in self.chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self._merges = PairTable([(ids[x], ids[y]) for x, y in merges])
        self._made = np.array([ids[x + y] for x, y in merges], np.int64)
        self._forget()
        self._lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self._starts = np.concatenate(([0], np.cumsum(self._lengths)[:-1]))
        self._flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)

    def _forget(self) -> None:
        """The ids of the pre-tokens met so far: number n has size[n] ids from start[n] in flat."""
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pre-tokens, after encoding those not met before."""
        if len(self.known) > CACHE:
            self._forget()
        get = self.known.get
        found = np.array([get(p, -1) for p in pieces], np.int64)
        fresh = np.flatnonzero(found < 0)
        if new := [pieces[i] for i in fresh.tolist()]:
            ids, each = self.encode_pieces(new)
            begin = len(self.flat) + np.concatenate(([0], np.cumsum(each)[:-1]))
            at = len(self.start)
            self.flat, self.start, self.size = np.concatenate((self.flat, ids)), np.concatenate((self.start, begin)), np.concatenate((self.size, each))
            self.known.update(zip(new, range(at, at + len(new))))
            found[fresh] = np.arange(at, at + len(new))
        return found

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pre-tokens, one after another, and how many each has."""
        raws = [p.encode() for p in pieces]
        b = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        cut = np.zeros(len(b), bool)
        if not self.by_word:
            cut[1:] = ~self.joined[b[:-1], b[1:]]
        cut[0], cut[ends[:-1]] = True, True
        starts = np.flatnonzero(cut)
        sym, size = self._merge(b, starts)
        per = np.add.reduceat(size, np.searchsorted(starts, np.concatenate(([0], ends[:-1]))))
        return sym.astype(np.uint32), per

    def _merge(self, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each fragment's bytes, lowest rank first and leftmost on ties; all short fragments take a step at a time."""
        width = np.diff(np.append(starts, len(b)))
        sym = self._byte_id[b]
        sym[starts + width - 1] = self._last_id[b[starts + width - 1]]
        owner = np.repeat(np.arange(len(starts)), width)
        done_sym, done_owner = [], []
        for i in np.flatnonzero(width > LONG):
            ids = self._merge_one(sym[starts[i] : starts[i] + width[i]])
            done_sym.append(ids)
            done_owner.append(np.full(len(ids), i))
        keep = width[owner] <= LONG
        sym, owner = sym[keep], owner[keep]
        never = len(self._made)
        while len(sym):
            rank = np.full(len(sym), never, np.int64)
            rank[:-1] = self._merges.find(sym[:-1], sym[1:], never)
            head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            rank[head[1:] - 1] = never
            best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), head)
            going = best >> 32 < never
            live = np.repeat(going, np.diff(np.append(head, len(sym))))
            done_sym.append(sym[~live])
            done_owner.append(owner[~live])
            at = best[going] & 0xFFFFFFFF
            sym[at] = self._made[best[going] >> 32]
            live[at + 1] = False
            sym, owner = sym[live], owner[live]
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        return sym[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(starts))

    def _merge_one(self, symbols: np.ndarray) -> np.ndarray:
        """Merges one fragment; its pairs wait in a heap by rank and place, so time follows its length and not the square of it."""
        never, sym = len(self._made), symbols.tolist()
        n = len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks = self._merges.find(symbols[:-1], symbols[1:], never).tolist()
        heap = [(rank, i, sym[i], sym[i + 1]) for i, rank in enumerate(ranks) if rank < never]
        heapq.heapify(heap)
        rank_of = lambda x, y: int(self._merges.find(np.array([x]), np.array([y]), never)[0])
        known: dict[tuple[int, int], int] = {}
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i]
            # a pair of which a symbol is gone
            if sym[i] != x or j < 0 or sym[j] != y:
                continue
            sym[i], sym[j] = int(self._made[rank]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0:
                    pair = sym[left], sym[right]
                    if (found := known.get(pair)) is None:
                        found = known[pair] = rank_of(*pair)
                    if found < never:
                        heapq.heappush(heap, (found, left, *pair))
        return np.array([x for x in sym if x >= 0], np.int64)

    def normal(self, text: str) -> str:
        if not self.by_word:
            return text
        if not text.isascii():
            import unicodedata

            # lower() looks at what stands beside a final sigma; the library lowers each character alone
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def spans(self, cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end positions of the pre-tokens of texts that lie one after another, non-empty, beginning at starts."""
        n, kind = len(cp), classes()[cp]
        first = np.zeros(n, bool)
        first[starts] = True
        begin = first.copy()
        begin[1:] |= kind[1:] != kind[:-1]
        run = begin.copy()
        if self.by_word:
            begin |= kind == NUMBER
        else:
            after = np.flatnonzero(run[1:] & ~first[1:] & (kind[1:] != WHITE) & (kind[:-1] == WHITE)) + 1
            begin[after - 1] = True
            begin[after[cp[after - 1] == 32]] = False
        end = np.append(first, [True, True, True])
        run = np.append(run, True)
        at = np.flatnonzero((cp == 39) & begin)
        at = at[run[at + 1] & ~end[at + 1]]
        at = at[kind[at + 1] == LETTER]
        one, padded = cp[at + 1], np.append(cp, [0, 0])
        two = np.where(end[at + 2], 0, padded[at + 2])
        short = np.isin(one, [115, 116, 109, 100])
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        begin = np.append(begin, [True, True, True])
        for chosen, size in ((at[short], 2), (at[long & ~short], 3)):
            begin[chosen + 1] = False
            begin[chosen + size] = True
        s = np.flatnonzero(begin[:n])
        e = np.append(s[1:], n)
        if self.by_word:
            keep = kind[s] != WHITE
            s, e = s[keep], e[keep]
        return s, e

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one more than there are texts)."""
        count, out, owner = np.zeros(len(texts), np.int64), [], []
        group: list[tuple[int, str]] = []
        size = 0

        def flush():
            nonlocal size
            if group:
                ids, per = self._chunk([t for _, t in group])
                out.append(ids)
                np.add.at(count, [i for i, _ in group], per)
            group.clear()
            size = 0

        for i, text in enumerate(texts):
            for part in self._split.split(text or ""):
                if part in self._special:
                    flush()
                    out.append(np.array([self._special[part]], np.uint32))
                    count[i] += 1
                    continue
                part, at = self.normal(part), 0
                while at < len(part):
                    to = len(part) if len(part) - at <= CHUNK else safe_end(part, at + CHUNK)
                    if size + to - at > CHUNK:
                        flush()
                    group.append((i, part[at:to]))
                    size += to - at
                    at = to
        flush()
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate(([0], np.cumsum(count)))

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        every = "".join(texts)
        cp = np.frombuffer(every.encode("utf-32-le"), np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1])).astype(np.int64)
        s, e = self.spans(cp, starts)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        codes, lead = distinct_spans(cp, s, e)
        number = self.numbers([every[i:j] for i, j in zip(s[lead].tolist(), e[lead].tolist())])
        flat, begin, each = self.flat, self.start[number], self.size[number]
        n = each[codes]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[codes] - (ends - n), n) + np.arange(ends[-1])]
        upto = np.concatenate(([0], ends))[np.searchsorted(s, np.append(starts, len(cp)))]
        return ids, np.diff(upto)

    def decode_bytes(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids stand for, and where each text's bytes begin."""
        n = self._lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        raw = self._flat[np.repeat(self._starts[ids] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.uint8)
        return raw, np.concatenate(([0], ends))[bounds]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `limit` bytes at most, so that memory doesn't follow the batch size."""
    import pyarrow.compute as pc

    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def encode_decode(docs: DataFrame, tokenizer: str, *, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids again: key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded."""
    on_workers(docs.sparkSession)

    def run(batches):
        enc = encoder(tokenizer)
        for whole in batches:
            for b in slices(whole, text):
                ids, at = enc.encode(b.column(text).to_pylist())
                raw, to = enc.decode_bytes(ids, at)
                n = b.num_rows
                hashes, decoded = [], []
                little = ids.astype("<u4", copy=False)
                for i in range(n):
                    hashes.append(hashlib.sha256(little[at[i] : at[i + 1]].data).hexdigest())
                    decoded.append(raw[to[i] : to[i + 1]].tobytes().decode("utf-8", "replace"))
                cols = {key: b.column(key), "n_tokens": pa.array(np.diff(at)), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())}
                if with_ids:
                    cols |= {"ids": pa.array([little[at[i] : at[i + 1]].astype(np.int32) for i in range(n)], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)
