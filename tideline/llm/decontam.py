"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items, which every text passes once.

Text is normalised byte by byte: A-Z become small, bytes that no word holds become spaces, runs of spaces become one. A window
is SIZE consecutive words of an item, or the whole of a shorter one, with a space on both sides, so that it only matches whole
words. A match's place is an index into the normalised bytes; that of the bytes kept leads back to the original, so spans are
given in words and in characters of the text as it came.

The automaton goes to every worker, so its windows are counted first: beyond PART_BYTES they are dealt into several parts, and
texts pass one after another, each adding what it finds. Nothing else is shuffled or gathered.

Defined results: null, empty and wordless texts have no words and no hits; items without a word have no window. Repeated items
and windows count once, repeated documents are scanned each. An item without an id marks words, but names nothing. Texts of any
length are scanned whole, handed to the automaton in pieces that it takes as one. Other columns are not read. Empty tables give
no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, stored

#: Words of a window.
SIZE = 10
#: Bytes of windows and their items that one automaton holds; some 500 MB in a worker.
PART_BYTES = 16 << 20
#: Normalised bytes handed to the automaton at a time.
PIECE = 1 << 22
SPANS = "array<struct<first: bigint, last: bigint, begin: bigint, stop: bigint>>"

#: What each byte becomes: digits, small letters and bytes of longer characters stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def normalised(raw: bytes) -> tuple[bytes, np.ndarray]:
    """Words with one space before, between and behind them, and the original place of every byte; a text without words is one space."""
    a = np.frombuffer(b" " + raw.translate(TABLE) + b" ", np.uint8)
    gap = a == 32
    kept = np.flatnonzero(~(gap & np.r_[False, gap[:-1]]))
    return a[kept].tobytes(), kept - 1


def windows(raw: bytes, size: int = SIZE) -> set[tuple[bytes, int]]:
    """An item's windows with their numbers of words."""
    words = normalised(raw)[0].split()
    if not words:
        return set()
    n = min(size, len(words))
    return {(b" " + b" ".join(words[i : i + n]) + b" ", n) for i in range(len(words) - n + 1)}


class Matcher:
    """The automaton of a part's windows: (window, words, item ids)."""

    def __init__(self, part: list[tuple[bytes, int, list[str]]]):
        self.machine = ahocorasick.Automaton()
        for i, (window, _, _) in enumerate(part):
            self.machine.add_word(window.decode("latin-1"), i)
        self.machine.make_automaton()
        self.bytes, self.words = (np.array([f(p) for p in part], np.int64) for f in (lambda p: len(p[0]), lambda p: p[1]))
        self.items = [p[2] for p in part]

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray, set[str]]:
        """First words and numbers of words of all matches in a normalised text, and the items they belong to."""
        ends, which = array("q"), array("q")
        if self.items:
            found = self.machine.iter("")
            for at in range(0, len(text), PIECE):
                found.set(text[at : at + PIECE].decode("latin-1"), False)
                for end, i in found:
                    ends.append(end)
                    which.append(i)
        ends, which = np.frombuffer(ends, np.int64), np.frombuffer(which, np.int64)
        if not len(ends):
            return ends, ends, set()
        first = np.searchsorted(spaces(text), ends - self.bytes[which] + 1)
        return first, self.words[which], {x for i in np.unique(which) for x in self.items[i]}


def spaces(text: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(text, np.uint8) == 32)


def merged(first: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Covered words as ranges without overlap, first included and last excluded."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate((first + n)[order])
    new = np.r_[True, first[1:] > last[:-1]]
    return list(zip(first[new].tolist(), last[np.r_[new[1:], True]].tolist()))


def located(ranges: list[tuple[int, int]], raw: bytes, text: bytes, place: np.ndarray) -> list[dict[str, int]]:
    """Ranges of words with the characters of the original that they begin at and stop before."""
    gaps = spaces(text)
    heads = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    char = lambda at: int(heads[place[at]])
    return [{"first": a, "last": b, "begin": char(gaps[a] + 1), "stop": char(gaps[b])} for a, b in ranges]


_held: dict[int, Matcher] = {}


def _matcher(part) -> Matcher:  # noqa: ANN001
    """A broadcast part's automaton, built once in a worker."""
    if part.value[0] not in _held:
        _held.clear()
        _held[part.value[0]] = Matcher(part.value[1])
    return _held[part.value[0]]


def _pass(found: DataFrame, part) -> DataFrame:  # noqa: ANN001
    """found (key, text, n_words, items, spans) with what one part's automaton adds."""
    schema = found.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(part)
        for b in batches:
            counts, items, spans = [], [], []
            for raw, had, held in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("items").to_pylist(), b.column("spans").to_pylist()):
                text, place = normalised(raw := raw or b"")
                first, n, more = matcher.scan(text)
                counts.append(len(spaces(text)) - 1)
                items.append(sorted(more.union(had)))
                if len(first):
                    first, n = np.r_[first, [s["first"] for s in held]].astype(np.int64), np.r_[n, [s["last"] - s["first"] for s in held]].astype(np.int64)
                    held = located(merged(first, n), raw, text, place)
                spans.append(held)
            types = {f.name: f.type for f in b.schema}
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "text": b.column("text"), "n_words": pa.array(counts, pa.int64()), "items": pa.array(items, types["items"]), "spans": pa.array(spans, types["spans"])})

    return found.mapInArrow(run, schema)


def item_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Distinct (window, n, item) of a benchmark."""
    on_workers(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, n, i) for raw, i in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("item").to_pylist()) for w, n in windows(raw or b"", size)]
            yield pa.RecordBatch.from_pydict({"window": pa.array([r[0] for r in rows], pa.binary()), "n": pa.array([r[1] for r in rows], pa.int32()), "item": pa.array([r[2] for r in rows], pa.string())})

    named = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(run, "window binary, n int, item string").distinct()


def scan(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", size: int = SIZE, part_bytes: int = PART_BYTES) -> DataFrame:
    """key, n_words, items (of windows that occur, as strings) and spans (words first to last, characters begin to stop) of every document."""
    spark = documents.sparkSession
    pairs = stored(item_windows(benchmark, item, "text", size))
    total = pairs.agg(F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0)) + 16)).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("window", "item"), F.lit(parts)))
    found = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"), F.array().cast(SPANS).alias("spans"))
    for p in range(parts):
        held: dict[tuple[bytes, int], list[str]] = defaultdict(list)
        # at most about part_bytes
        for r in dealt.filter(F.col("part") == p).toLocalIterator():
            held[bytes(r.window), r.n] += [r.item] * (r.item is not None)
        part = spark.sparkContext.broadcast((hash((total, parts, p, tuple(sorted(held)))), [(w, n, ids) for (w, n), ids in held.items()]))
        found = _pass(found if p == 0 else stored(found), part)
    return found.select(F.col("key").alias(key), "n_words", "items", "spans")


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of each document's hits."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    found = scan(documents, benchmark).withColumn("n_hit", hit)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
places AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
met AS (SELECT r, i, places.n, item_id FROM places JOIN win ON places.n = win.n AND places.g = win.g),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM met GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""
