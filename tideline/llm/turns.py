"""Conversation structure repair: the cheapest edits that make roles alternate, by dynamic programming over runs.

A conversation's rows stand by turn, nulls first; ties by role, text (the first HEAD characters of each) and then by hash. A
row's fault is blank, duplicate or truncated, or none; with its role's initial that makes its symbol. Equal symbols in a row are
a run. Four states (nothing yet, system, user, assistant) and the costs of a row's edits make a symbol's min-plus transition; a
run advances by its binary powers, which are cached, and so are products and steps that recur. Costs to go are found from the
end, then choices are unrolled from the start: among edits that cost no more the one with the least letter.

Equal rows are counted before anything else, duplicates found by the least turn of role and text, and rows dealt by ranges of
their order, so a conversation of any size spreads over tasks. One that lies inside a range is solved there. Of one that crosses
ranges each segment gives its transition, the products of later segments give it the costs to go at its end, and it is unrolled
for every state that it may begin in; the segments' ends then tell in which it did. Texts are not needed for any of this: they
join the kept rows at the end.

Defined results: null roles and texts are one space, in `damage` also null ids and turns in its key. A row without an id belongs
to the conversation without an id. A role's initial is its first character; roles of other initials, and empty ones, have to go
or change. Rows of equal turn, role and text are duplicates after the first. A number of gaps beyond a long is null. Other
columns are not read. An empty table gives no rows. Texts and conversations may have any length, but a conversation's audit and
the digest of its repaired text are one value each, which one task puts together, from a stream that holds one batch of rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_workers, stored

#: Costs of edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED, NONE = "bdt-"
#: Nothing yet, system, user, assistant.
STATES = range(4)
START = 0
#: What a state may be followed by: initial and state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Who is missing in a state: what an insertion, or a new role, becomes.
WANTED = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 60
#: Characters of role and text by which ties are ordered before the hash decides.
HEAD = 64
_WHITE = " \t\n\x0b\x0c\r"
Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def _closed(costs: Vector) -> Vector:
    """Costs to go where insertions may come first; two are the most that can help."""
    for _ in range(2):
        costs = tuple(min(costs[q], INSERT + costs[NEXT[q][WANTED[q]]]) for q in STATES)
    return costs


#: Costs to go behind the last row.
END = _closed((0, FAR, FAR, 0))


def _edits(symbol: str, q: int) -> list[tuple[str, int, int]]:
    """Letter, cost and state of what can be done with a row in a state, least letter first."""
    initial, fault = symbol[:-1], symbol[-1]
    out = [("D", DELETE, q)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = CUT if fault == TRUNCATED else 0
    if initial in NEXT[q]:
        out.append(("K", KEEP + more, NEXT[q][initial]))
    return [*out, ("R", REROLE + more, NEXT[q][WANTED[q]])]


def _lowered(x: Vector) -> tuple[Vector, int]:
    low = min(x)
    return tuple(v - low for v in x), low


@lru_cache(100_000)
def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[p][q] + b[q][r] for q in STATES) for r in STATES) for p in STATES)


@lru_cache(10_000)
def power(symbol: str, k: int) -> Matrix:
    """The transition of 2**k rows of a symbol, insertions before each included."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    out = []
    for p in STATES:
        reached = [FAR] * 4
        q, cost = p, 0
        for _ in range(3):
            for _, c, r in _edits(symbol, q):
                reached[r] = min(reached[r], cost + c)
            q, cost = NEXT[q][WANTED[q]], cost + INSERT
        out.append(tuple(reached))
    return tuple(out)


IDENTITY: Matrix = tuple(tuple(0 if p == q else FAR for q in STATES) for p in STATES)


def advance(m: Matrix, symbol: str, n: int) -> Matrix:
    """A transition followed by a run of n equal symbols."""
    k = 0
    while n:
        if n & 1:
            m = _times(m, power(symbol, k))
        n, k = n >> 1, k + 1
    return m


@lru_cache(100_000)
def _before(symbol: str, after: Vector) -> Vector:
    """Costs to go before a row, the least of `after` being 0."""
    return _closed(tuple(min(c + after[r] for _, c, r in _edits(symbol, q)) for q in STATES))


@lru_cache(100_000)
def _choice(symbol: str, q: int, after: Vector) -> tuple[str, int]:
    """The letters of a row, insertions before it included, and the state behind it."""
    go, letters = _before(symbol, after), ""
    while True:
        best = [(a, r) for a, c, r in _edits(symbol, q) if c + after[r] == go[q]]
        inserted = NEXT[q][WANTED[q]]
        if INSERT + go[inserted] == go[q] and (not best or best[0][0] > "I"):
            letters, q = letters + "I", inserted
            continue
        return letters + best[0][0], best[0][1]


def costs_before(runs: list[tuple[str, int]], after: Vector) -> list[Vector]:
    """Costs to go behind each run, each less its least."""
    out = []
    for symbol, n in reversed(runs):
        out.append(after)
        if symbol[-1] in (BLANK, DUPLICATE):
            continue
        m = advance(IDENTITY, symbol, n)
        after = _lowered(_closed(tuple(min(m[p][q] + after[q] for q in STATES) for p in STATES)))[0]
    return out[::-1]


def unroll(runs: list[tuple[str, int]], q: int, after: Vector, last: bool) -> tuple[list[str], int]:
    """Each row's letters (a run that must go has one string for all its rows), those behind the last row, and the state at the end."""
    letters = []
    for (symbol, n), behind in zip(runs, costs_before(runs, _lowered(after)[0])):
        if symbol[-1] in (BLANK, DUPLICATE):
            # deleting comes before inserting, in cost and in letter
            letters.append("D" * n)
            continue
        steps = [behind]
        for _ in range(n - 1):
            steps.append(_lowered(_before(symbol, steps[-1]))[0])
        for behind in reversed(steps):
            piece, q = _choice(symbol, q, behind)
            letters.append(piece)
    tail = ""
    while last and not (q in (START, 3)):
        tail, q = tail + "I", NEXT[q][WANTED[q]]
    return [*letters, tail], q


# one conversation's rows in a task


class Segment:
    """Rows of one conversation in their order: (turn, digest, role, fault, copies)."""

    def __init__(self):
        self.rows: list[tuple] = []

    def runs(self) -> list[tuple[str, int]]:
        out: list[list] = []
        for _, _, role, fault, n in self.rows:
            # copies of a row are duplicates, but of a blank one blank
            rest = BLANK if fault == BLANK else DUPLICATE
            for symbol, k in ((role[:1] + fault, 1), (rest, n - 1)):
                if symbol[-1] in (BLANK, DUPLICATE):
                    symbol = symbol[-1]
                if k and out and out[-1][0] == symbol:
                    out[-1][1] += k
                elif k:
                    out.append([symbol, k])
        return [(s, n) for s, n in out]

    def stats(self) -> dict:
        """Counts, and what the neighbours of a segment must know of it."""
        count, illegal, before, turns, distinct = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, NONE: 0}, 0, None, [], 0
        for turn, _, role, fault, n in self.rows:
            count[fault] += 1
            count[BLANK if fault == BLANK else DUPLICATE] += n - 1
            pair = role[:1] * 2
            illegal += (before is not None and before + role[:1] not in LEGAL) + (n - 1) * (pair not in LEGAL)
            before = role[:1]
            if turn is not None:
                distinct += not turns or turns[-1] != turn
                turns = [turns[0] if turns else turn, turn]
        return {"blank": count[BLANK], "duplicate": count[DUPLICATE], "truncated": count[TRUNCATED], "illegal": illegal, "first": self.rows[0][2][:1], "last": before, "lo": turns[0] if turns else None, "hi": turns[-1] if turns else None, "distinct": distinct}

    def edits(self, runs: list[tuple[str, int]], q: int, after: Vector, last: bool) -> tuple[str, int, list[tuple]]:
        """Audit, end state and repaired rows (turn, digest, letter, new role; without a digest for inserted ones)."""
        letters, end = unroll(runs, q, after, last)
        out, kept = [], iter([x for x, (s, _) in zip(letters, self._spread(runs)) if s[-1] not in (BLANK, DUPLICATE)])
        for turn, digest, role, fault, _ in self.rows:
            if fault in (BLANK, DUPLICATE):
                continue
            for letter in next(kept):
                if letter == "I":
                    out.append((None, None, "I", NAMES[WANTED[q]]))
                    q = NEXT[q][WANTED[q]]
                elif letter != "D":
                    become = role if letter == "K" else NAMES[WANTED[q]]
                    out.append((turn, digest, letter, become))
                    q = NEXT[q][become[:1]]
        for _ in letters[-1]:
            out.append((None, None, "I", NAMES[WANTED[q]]))
            q = NEXT[q][WANTED[q]]
        return "".join(letters), end, out

    @staticmethod
    def _spread(runs: list[tuple[str, int]]) -> Iterator[tuple[str, int]]:
        for s, n in runs:
            for _ in range(1 if s[-1] in (BLANK, DUPLICATE) else n):
                yield s, n


LEGAL = ("su", "ua", "au")


def joined(parts: list[dict]) -> dict:
    """The counts of a conversation from those of its segments in order."""
    total = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
    dated = [p for p in parts if p["lo"] is not None]
    distinct = total.pop("distinct") - sum(a["hi"] == b["lo"] for a, b in zip(dated, dated[1:]))
    gaps = dated[-1]["hi"] - dated[0]["lo"] + 1 - distinct if dated else 0
    return total | {"gaps": gaps if gaps < 1 << 63 else None}


# over tables


def standard(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and copies (1) of any table of turns."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(key).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(1).cast("long").alias("copies"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of `standard` with faults put in by a hash of id and turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(part("conv"), F.lit(":"), part("turn"))) % 20
    text = F.when(F.col("_hit") == 1, F.lit("")).when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = rows.withColumn("_hit", hit).filter("_hit != 0")
    return hurt.select("conv", "turn", F.when(F.col("_hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_hit") == 3, F.col("copies") * 2).otherwise(F.col("copies")).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def _place(digest: Column) -> Column:
    """One key, never null, for a conversation's turn and a digest."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(F.hex(digest), text("turn"), text("conv"))))


def _joined(a: DataFrame, b: DataFrame, names: tuple[str, ...], how: str) -> DataFrame:
    """A join by columns of which nulls equal each other; they come from a."""
    right = b.withColumnsRenamed({n: f"_{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return a.join(right, on, how).drop(*[f"_{n}" for n in names])


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv, turn, digest, role, head of text, fault, copies), without their texts."""
    bare = F.expr(f"trim(TRAILING '{_WHITE}' FROM text)")
    own = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    light = rows.select("conv", "turn", _digest().alias("digest"), "role", F.substring("text", 1, HEAD).alias("head"), own.alias("own"), "copies")
    one = light.groupBy("conv", "turn", "digest").agg(F.max("role").alias("role"), F.max("head").alias("head"), F.max("own").alias("own"), F.sum("copies").alias("copies"))
    first = one.groupBy("conv", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("t")).select("conv", F.col("t.turn").alias("turn"), "digest", F.lit(True).alias("leads"))
    marked = _joined(one, first, ("conv", "turn", "digest"), "left")
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("leads").isNull(), DUPLICATE).otherwise(F.col("own"))
    return marked.select("conv", "turn", "digest", "role", "head", fault.alias("fault"), "copies")


_OUT = "kind string, conv {conv}, block int, state int, at long, turn long, digest binary, role string, fault string, copies long, letter string, audit string, data string"
_ROW = ("turn", "digest", "role", "fault", "copies")


class _Writer:
    """Rows of several kinds in one table: row and segment of a conversation that may go on, edit and audit of one that is solved."""

    def __init__(self, conv_type: pa.DataType, block: int):
        self.columns = {n: [] for n in ("kind", "conv", "block", "state", "at", *_ROW, "letter", "audit", "data")}
        self.types = {"conv": conv_type, "block": pa.int32(), "state": pa.int32(), "at": pa.int64(), "turn": pa.int64(), "copies": pa.int64(), "digest": pa.binary()}
        self.block, self.at = block, block << 33

    def add(self, kind: str, conv, **values) -> None:  # noqa: ANN001
        for n, c in self.columns.items():
            c.append(values.get(n))
        self.columns["kind"][-1], self.columns["conv"][-1], self.columns["at"][-1], self.at = kind, conv, self.at, self.at + 1
        self.columns["block"][-1] = values.get("block", self.block)

    def solved(self, conv, segment: Segment, runs, q: int, after: Vector, last: bool, data: dict, block: int | None = None) -> None:  # noqa: ANN001
        audit, end, out = segment.edits(runs, q, after, last)
        block = self.block if block is None else block
        for turn, digest, letter, role in out:
            self.add("edit", conv, turn=turn, digest=digest, letter=letter, role=role, state=q, block=block)
        self.add("audit", conv, audit=audit, state=q, data=json.dumps(data | {"end": end}), block=block)

    def flush(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({n: pa.array(c, self.types.get(n, pa.string())) for n, c in self.columns.items()})
        for c in self.columns.values():
            c.clear()
        return out

    def full(self) -> bool:
        return len(self.columns["kind"]) >= 10_000


def _conversations(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], by: tuple[str, ...] = ("conv",)) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted stream, group by group."""
    now, rows = None, []
    for b in batches:
        for group, row in zip(zip(*(b.column(c).to_pylist() for c in by)), zip(*(b.column(c).to_pylist() for c in names))):
            if group != now:
                if rows:
                    yield now, rows
                now, rows = group, []
            rows.append(row)
    if rows:
        yield now, rows


def _within(sorted_rows: DataFrame, schema: str) -> DataFrame:
    """Solves conversations inside a range; the first and the last of a range may go on beyond it and come out as rows and a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first_batch = next(batches, None)
        if first_batch is None:
            return
        out = _Writer(first_batch.schema.field("conv").type, TaskContext.get().partitionId())

        def every() -> Iterator[pa.RecordBatch]:
            yield first_batch
            yield from batches

        held = None
        for i, ((conv,), rows) in enumerate(_conversations(every(), _ROW)):
            if held:
                finish(out, *held, inner=i > 1)
            held = conv, rows
            if out.full():
                yield out.flush()
        if held:
            finish(out, *held, inner=False)
        yield out.flush()

    def finish(out: _Writer, conv, rows: list[tuple], inner: bool) -> None:  # noqa: ANN001
        segment = Segment()
        segment.rows = rows
        runs, stats = segment.runs(), segment.stats()
        if inner:
            total = costs_of(runs)
            out.solved(conv, segment, runs, START, END, True, joined([stats]) | {"cost": total})
            return
        m = IDENTITY
        for symbol, n in runs:
            m = advance(m, symbol, n)
        for r in rows:
            out.add("row", conv, **dict(zip(_ROW, r)))
        out.add("segment", conv, data=json.dumps({"m": m, "stats": stats}))

    return sorted_rows.mapInArrow(run, schema)


def costs_of(runs: list[tuple[str, int]]) -> int:
    """The least cost of a whole conversation."""
    m = IDENTITY
    for symbol, n in runs:
        m = advance(m, symbol, n)
    return min(m[START][q] + END[q] for q in STATES)


def _ahead(parts: list[Matrix]) -> list[Vector]:
    """The costs to go at the end of every segment."""
    out, v = [], END
    for m in reversed(parts):
        out.append(v)
        v = _closed(tuple(min(m[p][q] + v[q] for q in STATES) for p in STATES))
    return out[::-1]


def _across(found: DataFrame, schema: str) -> DataFrame:
    """Edits and audits of conversations that begin or end a range, segment by segment."""
    # several tens of bytes per range and conversation that crosses one
    segments = found.filter("kind = 'segment'").select("conv", "block", "data")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rebatched(_conversations(batches, ("block", "data"))):
            out = {"conv": [], "block": [], "data": []}
            for (conv,), parts in b:
                known = [json.loads(d) for _, d in parts]
                matrices = [tuple(map(tuple, k["m"])) for k in known]
                total = joined([k["stats"] for k in known])
                m = IDENTITY
                for x in matrices:
                    m = _times(m, x)
                total["cost"] = min(m[START][q] + END[q] for q in STATES)
                for i, ((block, _), v) in enumerate(zip(parts, _ahead(matrices))):
                    out["conv"].append(conv)
                    out["block"].append(block)
                    out["data"].append(json.dumps({"after": v, "first": i == 0, "last": i == len(parts) - 1, "total": total if i == 0 else {}}))
            yield pa.RecordBatch.from_pydict({"conv": pa.array(out["conv"], types["conv"]), "block": pa.array(out["block"], pa.int32()), "data": pa.array(out["data"], pa.string())})

    types = {"conv": _arrow(found.schema["conv"].dataType)}
    plans = segments.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(plan, f"conv {found.schema['conv'].dataType.simpleString()}, block int, data string")
    both = found.filter("kind = 'row'").select("conv", "block", "at", *_ROW, F.lit(None).cast("string").alias("data"))
    both = both.unionByName(plans.select("conv", "block", F.lit(-1).cast("long").alias("at"), *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in _ROW], "data"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(types["conv"], 0)
        for (conv, block), rows in _conversations(batches, (*_ROW, "data"), ("conv", "block")):
            plan, segment = json.loads(rows[0][-1]), Segment()
            segment.rows = [r[:-1] for r in rows[1:]]
            runs = segment.runs()
            out.at = block << 33
            for q in (START,) if plan["first"] else STATES:
                out.solved(conv, segment, runs, q, tuple(plan["after"]), plan["last"], plan["total"], block)
            yield out.flush()

    tried = stored(both.repartition("conv", "block").sortWithinPartitions("conv", "block", "at").mapInArrow(solve, schema))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), ends in _conversations(batches, ("block", "state", "data")):
            q, blocks, states = START, [], []
            by: dict[int, dict[int, int]] = {}
            for block, state, data in ends:
                by.setdefault(block, {})[state] = json.loads(data)["end"]
            for block in sorted(by):
                blocks.append(block)
                states.append(q)
                q = by[block][q]
            yield pa.RecordBatch.from_pydict({"conv": pa.array([conv] * len(blocks), types["conv"]), "block": pa.array(blocks, pa.int32()), "state": pa.array(states, pa.int32())})

    ends = tried.filter("kind = 'audit'").select("conv", "block", "state", "data")
    path = ends.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(follow, f"conv {found.schema['conv'].dataType.simpleString()}, block int, state int")
    return _joined(tried, path, ("conv", "block", "state"), "left_semi")


def _rebatched(groups: Iterator, size: int = 1000) -> Iterator[list]:
    held = []
    for g in groups:
        held.append(g)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _arrow(data_type) -> pa.DataType:  # noqa: ANN001
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


_ORDER = ("conv", "dated", "turn", "r", "head", "role", "digest")


def solved(rows: DataFrame) -> DataFrame:
    """Rows of `standard` to edits (kind edit: conv, at, letter, role, turn and digest of the row) and audits (kind audit: conv, block, audit, data), stored."""
    on_workers(rows.sparkSession)
    schema = _OUT.format(conv=rows.schema["conv"].dataType.simpleString())
    marked = faults(rows).withColumns({"dated": F.col("turn").isNotNull(), "r": F.substring("role", 1, HEAD)})
    found = stored(_within(marked.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("conv", *_ROW), schema))
    return found.filter("kind IN ('edit', 'audit')").unionByName(_across(found, schema))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that stay or were put in, in their order (at): conv, at, letter, role, text."""
    edits = found.filter("kind = 'edit'").select("conv", "turn", "digest", "at", "letter", "role")
    texts = rows.select(_place(_digest()).alias("place"), "text").groupBy("place").agg(F.max("text").alias("text"))
    kept = edits.filter("digest IS NOT NULL").withColumn("place", _place(F.col("digest")))
    kept = kept.join(texts, "place").select("conv", "at", "letter", "role", "text")
    return kept.unionByName(edits.filter("digest IS NULL").select("conv", "at", "letter", "role", F.lit("").alias("text")))


def digests(turns: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its lines `role:text`, joined by newlines; a conversation passes as a stream."""
    conv = turns.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, convs, hashes = None, None, [], []
        for b in batches:
            for c, role, text in zip(b.column("conv").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
                if h is None or c != now:
                    if h is not None:
                        convs.append(now)
                        hashes.append(h.hexdigest())
                    now, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pydict({"conv": pa.array(convs, kind), "repaired_sha256": pa.array(hashes, pa.string())})
            convs, hashes = [], []
        if h is not None:
            yield pa.RecordBatch.from_pydict({"conv": pa.array([now], kind), "repaired_sha256": pa.array([h.hexdigest()], pa.string())})

    kind = _arrow(conv)
    return turns.repartition("conv").sortWithinPartitions("conv", "at").select("conv", "role", "text").mapInArrow(run, f"conv {conv.simpleString()}, repaired_sha256 string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(conversations: DataFrame, key: str = "conv_id", hurt: bool = True) -> DataFrame:
    """One row per conversation of the table: its faults, the cheapest edits, and the digest of what they make. hurt: damage comes first."""
    given = standard(conversations, key)
    rows = damage(given) if hurt else given
    found = solved(rows)
    audits = found.filter("kind = 'audit'").select("conv", "block", "audit", F.from_json("data", ", ".join(f"{c} long" for c in COUNTS)).alias("d"))
    audits = audits.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"), *[F.max(f"d.{c}").alias(c) for c in COUNTS], F.lit(True).alias("any"))
    every, sums = given.select("conv").distinct(), digests(repaired(rows, found))
    out = _joined(_joined(every, audits, ("conv",), "left"), sums, ("conv",), "left")
    none = F.col("any").isNull()
    return out.select(
        F.col("conv").alias(key), *[F.when(none, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in COUNTS[:-1]], F.when(none, F.lit(0).cast("long")).otherwise(F.col("cost")).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
