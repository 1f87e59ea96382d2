"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Sets are the distinct 5-word shingles of a text, held as sorted 64-bit hashes. Documents with equal sets are one node.

Tiles. With similarity of 0.8 or more, sizes a <= b differ by a factor of 1.25 at most and the sets differ in (a + b) / 9
elements at most. Tile k takes the pairs whose smaller set is in size band k (factor 1.25 wide), so a set stands in its own
band's tile and in the one below, and there two linked sets differ in at most d elements. A tile deals elements by hash to
more than d parts; two linked sets agree on at least one whole part. So nodes are candidates only if they agree on all
elements of a part of a tile, which shared passages of otherwise different texts hardly ever do. A set with so many empty
parts that the agreeing ones could all be empty also stands under each hash of its prefix, which is complete for such pairs.

Signatures. A node's bitmaps hold the parity of its elements per hashed bit, a short one and a long one. The bits in which two
bitmaps differ bound the overlap from above; pairs beyond the bound of either are dropped, the rest are intersected exactly.

Groups. In a group that shares a part every node is first held against one anchor, then against the node that stands in the
most and largest groups, which links copies of one text through it with as many pairs as nodes. Only groups that still hold
several components are compared throughout, in blocks, and only across components, so no group of copies is expanded into
its pairs and no link between different texts is lost. Groups larger than a block are cut by size bands first, of which only
neighbours can link. Texts are fetched once, for nodes with a pair that the bitmaps allow.

Hot parts. Where a part stands in more than a sixteenth of the documents that a worker has at hand, its nodes are dealt by node
instead of by part, each with the least of them as anchor; these least ones meet under the part. Joins by part deal such rows,
and those of large open groups, by a share of the node too, and repeat the one row per part on the other side.

Defined results: null, empty and blank texts have no set and are their own component; repeated rows share a node and rows that share
a doc_id share its links; rows without a doc_id are documents of their own and link as others do; the smallest doc_id of a component
names it, and one of such rows alone has no name. Hashes of 64 bits stand for shingles: for a corpus of 10**12 distinct shingles the
chance that any two of one pair of documents clash stays under 10**-10.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import powers, slices
from .common import on_workers, shuffle_partitions, stored

SIZE = 5
#: Bits of the short and the long bitmap.
BITS, LONG_BITS = 2048, 8192
#: Nodes of a side of a tile in the block comparison, and pairs compared at a time.
BLOCK, PAIRS = 1024, 1 << 20
#: Shares that a hot part's nodes are dealt to, rows of a block comparison that one group of an Arrow batch holds, and the ratio of a large group's size bands.
SHARES, AT_ONCE, RATIO = 32, 50_000, 1.3
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(0, 1 << 64, 256, _U, False)
_BYTE[65:91] = _BYTE[97:123]
_SLOT = _rng.integers(0, 1 << 64, SIZE, _U, False) | _U(1)
_COUNT = _rng.integers(0, 1 << 64, SIZE + 1, _U, False)
#: Least sizes of the bands: powers of 1.25.
_BANDS = [-(-(5**k) // 4**k) for k in range(150)]
_LOW = np.array(_BANDS, np.float64)
_DIFFER = np.array([(_BANDS[k + 1] - 1) // 4 if k + 1 < len(_BANDS) else 0 for k in range(150)], np.float64)
_PARTS = np.ceil(1.12 * _DIFFER) + 3


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, one after another, and where each text's begin."""
    raws = [(t or "").encode() for t in texts]
    b = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    first = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
    up, down = powers(len(b) + 1)
    space = _SPACE[b]
    s = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    e = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    total = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[b] * up[: len(b)], dtype=_U)))
    word = mix((total[e] - total[s]) * down[s])
    at = np.searchsorted(s, first)
    n = np.diff(at)
    full = np.zeros(max(len(word) - SIZE + 1, 0), _U)
    for k in range(SIZE):
        full += word[k : k + len(full)] * _SLOT[k]
    full = mix(full + _COUNT[SIZE])
    parts = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        if j - i >= SIZE:
            parts.append(np.sort(full[i : j - SIZE + 1]))
        elif j > i:
            parts.append(mix(np.array([(word[i:j] * _SLOT[: j - i]).sum(dtype=_U)]) + _COUNT[j - i : j - i + 1]))
    have = np.where(n >= SIZE, n - SIZE + 1, np.minimum(n, 1))
    flat = np.concatenate(parts) if parts else np.zeros(0, _U)
    owner = np.repeat(np.arange(len(texts)), have)
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[fresh], np.concatenate(([0], np.cumsum(np.bincount(owner[fresh], minlength=len(texts)))))


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bitmap(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    odd = np.bincount((hashes >> _U(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures under which each set stands in its tiles, and the set's number beside each."""
    size = np.diff(at)
    band = np.searchsorted(_LOW, np.maximum(size, 1), "right") - 1
    owner = np.repeat(np.arange(len(size)), size)
    spread, value = mix(flat ^ _U(0x5851F42D4C957F2D)) >> _U(16), mix(flat + _U(0x14057B7EF767814F))
    out, who = [], []
    for down in (0, 1):
        tile = np.maximum(band - down, 0)
        parts = _PARTS[tile].astype(np.int64)
        base = np.concatenate(([0], np.cumsum(parts)))
        place = base[:-1][owner] + (spread % parts.astype(_U)[owner]).astype(np.int64)
        total = np.zeros(base[-1], _U)
        np.add.at(total, place, value)
        count = np.bincount(place, minlength=base[-1])
        some = np.flatnonzero(count)
        mine = np.repeat(np.arange(len(size)), parts)[some]
        key = total[some] + (some - base[mine]).astype(_U) * _U(0x2545F4914F6CDD1D) + tile[mine].astype(_U) * _U(0x9E3779B97F4A7C15) + count[some].astype(_U)
        use = (band[mine] >= down) & (size[mine] > 0)
        out.append(mix(key[use]))
        who.append(mine[use])
        filled = np.bincount(mine, minlength=len(size))
        for i in np.flatnonzero((band >= down) & (size > 0) & (filled <= _DIFFER[tile])):
            own = flat[at[i] : at[i + 1]]
            prefix = own[: len(own) - -(-4 * len(own) // 5) + 1]
            out.append(mix(prefix * _U(3) + tile[i : i + 1].astype(_U) * _U(0xD1342543DE82EF95)))
            who.append(np.full(len(prefix), i))
    return np.concatenate(out), np.concatenate(who)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


#: 48 bits of a digest or a signature: what candidates are found by; clashes only add candidates.
_SHORT = (1 << 48) - 1
MAPS = [f"m{i}" for i in range(BITS // 64)]


def _nodes(docs: DataFrame) -> DataFrame:
    """Every document's set: its size, digest (u, v), and bitmaps."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                flat, at = shingle_sets(b.column("text").to_pylist())
                n = np.diff(at)
                sets = [flat[at[i] : at[i + 1]] for i in range(len(n))]
                d = [set_digest(x) if len(x) else (None, None) for x in sets]
                bits = np.array([bitmap(x) for x in sets]).reshape(len(sets), -1)
                # for small sets the short bitmap says enough
                long = [bitmap(x, LONG_BITS).tobytes() if len(x) > BITS // 2 else None for x in sets]
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n": pa.array(n), "u": pa.array([x for x, _ in d], pa.int64()), "v": pa.array([x for _, x in d], pa.int64())} | {m: pa.array(bits[:, i]) for i, m in enumerate(MAPS)} | {"long": pa.array(long, pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n long, u long, v long, " + ", ".join(f"{m} long" for m in MAPS) + ", long binary")


def _groups(docs: DataFrame, buckets: int) -> DataFrame:
    """The parts (sig) on which several nodes agree, with their nodes (u), one of them as anchor, and whether the part was dealt by node (hot)."""

    def emit(batches):
        sigs, us, held, docs = [], [], 0, 0

        def flush():
            sig, u = np.concatenate(sigs) & _U(_SHORT), np.concatenate(us) & _SHORT
            order = np.lexsort((u, sig))
            sig, u = sig[order], u[order]
            fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (u[1:] != u[:-1])))
            sig, u = sig[fresh], u[fresh]
            head = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
            size = np.diff(np.append(head, len(sig)))
            hot = np.repeat(size >= max(16, docs // 16), size)
            least = np.repeat(u[head], size)
            plain = ~hot
            plain[head] = True
            sigs.clear()
            us.clear()
            return pa.concat_batches([dealt(sig[plain], sig[plain], u[plain]), dealt(mix(sig[hot] ^ u[hot].view(_U)), sig[hot], u[hot], least[hot])])

        for whole in batches:
            for b in slices(whole, "text"):
                flat, at = shingle_sets(b.column("text").to_pylist())
                digest = np.array([set_digest(flat[at[i] : at[i + 1]])[0] if at[i + 1] > at[i] else 0 for i in range(b.num_rows)], np.int64)
                sig, who = signatures(flat, at)
                sigs.append(sig)
                us.append(digest[who])
                held, docs = held + len(sig), docs + b.num_rows
                if held >= 4_000_000:
                    yield flush()
                    held = docs = 0
        if held:
            yield flush()

    def dealt(by: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        """Six bytes of each column per row, in one piece per bucket; three columns are rows of hot parts."""
        to = (by % _U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edge = np.searchsorted(to[order], np.arange(buckets + 1))
        six = np.concatenate([np.ascontiguousarray(c[order]).view(np.uint8).reshape(-1, 8)[:, :6] for c in columns], 1)
        some = np.flatnonzero(np.diff(edge))
        return pa.RecordBatch.from_pydict({"bucket": pa.array(some), "hot": pa.array([len(columns) == 3] * len(some), pa.bool_()), "rows": pa.array([six[edge[i] : edge[i + 1]].tobytes() for i in some], pa.binary())})

    def read(t: pa.Table, hot: bool) -> np.ndarray:
        k = 3 if hot else 2
        six = np.concatenate([np.zeros((0, 6 * k), np.uint8), *[np.frombuffer(x, np.uint8).reshape(-1, 6 * k) for x, h in zip(t.column("rows").to_pylist(), t.column("hot").to_pylist()) if h == hot]])
        wide = np.zeros((k, len(six), 8), np.uint8)
        for i in range(k):
            wide[i, :, :6] = six[:, 6 * i : 6 * i + 6]
        return wide.view(np.int64)[:, :, 0]

    def meet(t: pa.Table) -> pa.Table:
        parts = [met(*read(t, False)), read(t, True)]
        return pa.table({n: pa.array(np.concatenate([p[i] for p in parts])) for i, n in enumerate(("sig", "u", "anchor"))} | {"hot": pa.array(np.repeat([False, True], [len(p[0]) for p in parts]))})

    def met(sig: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(sig):
            return sig, u, u
        order = np.argsort(sig, kind="stable")
        sig, u = sig[order], u[order]
        head = np.concatenate(([True], sig[1:] != sig[:-1]))
        size = np.diff(np.append(np.flatnonzero(head), len(sig)))
        many = np.repeat(size > 1, size)
        sig, u = sig[many], u[many]
        if not len(sig):
            return sig, u, u
        head = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(head, len(sig)))
        least, most = np.minimum.reduceat(u, head), np.maximum.reduceat(u, head)
        keep = np.repeat(least != most, size)
        return sig[keep], u[keep], np.repeat(least, size)[keep]

    blobs = docs.select("text").mapInArrow(emit, "bucket long, hot boolean, rows binary").repartition(buckets, "bucket")
    return stored(blobs.groupBy("bucket").applyInArrow(meet, "sig long, u long, anchor long, hot boolean"))


def _hashes(docs: DataFrame) -> DataFrame:
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                flat, at = shingle_sets(b.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"node": b.column("doc_id"), "hashes": pa.array([flat[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())})

    return docs.mapInArrow(run, "node long, hashes binary")


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow a link."""
    side = lambda p, more: nodes.select(F.col("node").alias(p), *[F.col(m).alias(p + m) for m in more])
    both = pairs.join(side("a", ["n", *MAPS]), "a").join(side("b", ["n", *MAPS]), "b")
    differ = sum((F.bit_count(F.col("a" + m).bitwiseXOR(F.col("b" + m))) for m in MAPS), F.lit(0))
    near = both.filter((5 * F.least("an", "bn") >= 4 * F.greatest("an", "bn")) & (9 * differ <= F.col("an") + F.col("bn"))).select("a", "b")

    def run(batches):
        for t in batches:
            keep = []
            for x, y, n in zip(t.column("along"), t.column("blong"), t.column("n").to_pylist()):
                known = x.is_valid and y.is_valid
                keep.append(not known or 9 * int(np.bitwise_count(np.frombuffer(x.as_py(), _U) ^ np.frombuffer(y.as_py(), _U)).sum()) <= n)
            yield pa.RecordBatch.from_pydict({k: t.column(k) for k in ("a", "b")}).filter(pa.array(keep, pa.bool_()))

    both = near.join(side("a", ["n", "long"]), "a").join(side("b", ["n", "long"]), "b")
    return both.select("a", "b", "along", "blong", (F.col("an") + F.col("bn")).alias("n")).mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by intersection of their sorted hashes."""

    def run(batches):
        for t in batches:
            keep = [linked(np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)) for x, y in zip(t.column("ha"), t.column("hb"))]
            yield pa.RecordBatch.from_pydict({k: t.column(k) for k in ("a", "b")}).filter(pa.array(keep, pa.bool_()))

    side = lambda p: hashes.select(F.col("node").alias(p), F.col("hashes").alias("h" + p))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and label (the least id it reaches) of every id that reaches a smaller one by links (a, b), by alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = stored(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # done when every id has one edge and none leads to an id that has one itself
        ids = edges.groupBy("u").agg(F.count("*").alias("n"))
        if not edges.select(F.col("v").alias("u"), F.lit(2).alias("n")).join(ids.select("u"), "u", "left_semi").unionByName(ids.filter("n > 1").select("u", F.col("n").cast("int").alias("n"))).take(1):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _share() -> Column:
    return F.pmod(F.xxhash64("node"), F.lit(SHARES)).cast("int")


def _by_part(rows: DataFrame, facts: DataFrame, hot: Column | None = None) -> DataFrame:
    """rows (sig, node) with the facts of their sig, joined by sig and, on rows that are hot (all, if not said), a share of the node; facts need a column hot then."""
    every = F.sequence(F.lit(0), F.lit(SHARES - 1))
    shares = every if hot is None else F.when(F.col("hot"), every).otherwise(F.array(F.lit(0)))
    dealt = facts.withColumn("_share", F.explode(shares)).drop("hot")
    return rows.withColumn("_share", _share() if hot is None else F.when(hot, _share()).otherwise(0)).join(dealt, ["sig", "_share"]).drop("_share")


def _open(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, node, label and the group's size (rows) of the groups whose nodes have several labels."""
    named = groups.select("sig", "node", "hot").join(labels.select(F.col("id").alias("node"), F.col("label").alias("_l")), "node", "left").select("sig", "node", "hot", F.coalesce("_l", "node").alias("label"))
    mixed = named.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.max("hot").alias("hot")).filter("lo != hi").select("sig", "size", "hot")
    return stored(_by_part(named, mixed, F.col("hot")).drop("hot"))


def _central(rows: DataFrame) -> DataFrame:
    """The pairs of each node with the one of its group that meets the most nodes."""
    size = rows.groupBy("sig").agg(F.count("*").alias("size"), F.max("hot").alias("hot"))
    degree = _by_part(rows, size, F.col("hot")).groupBy("node").agg(F.sum("size").alias("degree"))
    top = rows.join(degree, "node").groupBy("sig").agg(F.max(F.struct("degree", "node", "label")).alias("top"), F.max("hot").alias("hot"))
    met = _by_part(rows, top, F.col("hot")).filter(F.col("label") != F.col("top.label"))
    return met.select(F.col("node").alias("a"), F.col("top.node").alias("b")).distinct()


def _tiled(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows as _open gives, once for every tile in which they are compared, dealt to buckets of about AT_ONCE."""
    light = rows.join(nodes.select("node", "n"), "node")
    # in a large group a set meets those of its own size band, and as the upper one of a pair those of the band below
    band = F.floor(F.log("n") / F.log(F.lit(RATIO))).cast("int")
    large = F.col("size") > BLOCK
    light = light.withColumn("_band", band).withColumn("band", F.explode(F.when(large, F.array(F.col("_band"), F.col("_band") - 1)).otherwise(F.array(F.lit(-1)))))
    light = light.withColumn("own", ~large | (F.col("band") == F.col("_band"))).drop("_band")
    banded = light.filter(large).groupBy("sig", "band").agg(F.count("*").alias("n_band"), F.max(F.col("own")).alias("_any")).filter("_any").select("sig", F.col("band").alias("_b"), F.ceil(F.col("n_band") / BLOCK).cast("int").alias("chunks"))
    big = _by_part(light.filter(large), banded).filter("band = _b").drop("_b")
    light = stored(light.filter(~large).withColumn("chunks", F.lit(1)).unionByName(big))
    # rows as the comparison will see them, one for every chunk that they meet
    count = light.agg(F.sum("chunks")).first()[0] or 0
    buckets = max(shuffle_partitions(rows.sparkSession), count // AT_ONCE + 1)
    rows = light.join(nodes.select("node", *MAPS), "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    return rows.withColumn("tile", F.xxhash64("sig", "band", "i", "j")).withColumn("bucket", F.pmod("tile", F.lit(buckets)))


def _across(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that share a part but no label and that sizes and short bitmaps allow, from block comparisons. rows: as _open gives."""
    maps = MAPS

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("tile")
        tile, node, label, n, chunk = (t.column(c).to_numpy() for c in ("tile", "node", "label", "n", "chunk"))
        own = t.column("own").to_numpy(zero_copy_only=False)
        bits = np.stack([t.column(m).to_numpy() for m in maps], 1).view(_U)
        head = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
        size = np.diff(np.append(head, len(tile)))
        crossed = np.repeat(t.column("i").to_numpy()[head] != t.column("j").to_numpy()[head], size)
        later = np.repeat(head + size, size) - np.arange(len(tile)) - 1
        upto, found, at = np.cumsum(later), [], 0
        while at < len(tile):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            x = np.repeat(np.arange(at, to), later[at:to])
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later[at:to]) - later[at:to], later[at:to])
            ok = (label[x] != label[y]) & (node[x] != node[y]) & (own[x] | own[y]) & ~(crossed[x] & (chunk[x] == chunk[y])) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
            x, y = x[ok], y[ok]
            ok = 9 * np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= n[x] + n[y]
            found.append(np.stack([node[x[ok]], node[y[ok]]]))
            at = to
        got = np.unique(np.sort(np.concatenate(found, 1), 0), axis=1)
        return pa.table({"a": pa.array(got[0]), "b": pa.array(got[1])})

    return _tiled(rows, nodes).groupBy("bucket").applyInArrow(compare, "a long, b long").distinct()


def _identified(docs: DataFrame) -> DataFrame | None:
    """docs with _id, the doc_id or, in rows without one, a hash of the row's place; None if no row lacks its doc_id."""
    if not docs.filter("doc_id IS NULL").take(1):
        return None
    # written once, so places stay
    return stored(docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("row"), F.monotonically_increasing_id()))))


def _found(marked: DataFrame) -> DataFrame:
    """_id, doc_id (NULL as in marked), n_shingles and the component, by one of its _id, of every row of marked."""
    out = _components(marked.select(F.col("_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_id")
    lost = marked.filter("doc_id IS NULL").select("_id", F.lit(True).alias("_lost"))
    return stored(out.join(lost, "_id", "left").select("_id", F.when(F.col("_lost").isNull(), F.col("_id")).alias("doc_id"), "n_shingles", "component_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = _identified(docs)
    if marked is None:
        return _components(docs)
    found = _found(marked)
    names = found.groupBy("component_id").agg(F.min("doc_id").alias("_name"))
    return found.join(names, "component_id").select("doc_id", "n_shingles", F.col("_name").alias("component_id"))


def _components(docs: DataFrame) -> DataFrame:
    """The same where every row has its doc_id."""
    spark = docs.sparkSession
    on_workers(spark)
    placed = stored(_nodes(docs))
    elements = placed.agg(F.sum("n")).first()[0] or 0
    groups = _groups(docs, max(shuffle_partitions(spark), int(elements // 2_000_000) + 1))
    sets = placed.filter("u IS NOT NULL")
    names = stored(sets.groupBy("u", "v").agg(F.min("doc_id").alias("node")))
    # one row of each node: rows that share its doc_id but not its set have another digest
    nodes = stored(sets.join(names, ["u", "v"]).filter(F.col("doc_id") == F.col("node")).select("node", "u", "v", "n", *MAPS, "long").dropDuplicates(["node", "u", "v"]))
    key = names.select(F.col("u").bitwiseAND(F.lit(_SHORT)).alias("u"), "node")
    first = groups.filter("u != anchor").select("u", "anchor").distinct()
    first = first.join(key.withColumnRenamed("node", "a"), "u").join(key.select(F.col("u").alias("anchor"), F.col("node").alias("b")), "anchor").select("a", "b")
    stars = _bounded(first, nodes)
    members = groups.join(key, "u").select("sig", "node", "hot")
    # pairs that the bitmaps allow, through anchors, central nodes and, where both leave several components, blocks
    stars = stored(stars.unionByName(_bounded(_central(members.withColumn("label", F.col("node"))), nodes)).distinct())
    rows = _open(members, components(stars))
    across = stored(_bounded(_across(rows, nodes), nodes))
    pairs = stored(stars.unionByName(across).distinct())
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # nothing bounds how many nodes have such a pair, so this side is never broadcast and the plan is the same at every size
    hashes = stored(_hashes(docs.join(wanted.hint("merge"), "doc_id", "left_semi")))
    links = stored(_exact(pairs, hashes))
    labels = components(links)
    # nodes joined by bitmaps alone may have come apart
    apart = _open(members.join(wanted.withColumnRenamed("doc_id", "node"), "node", "left_semi"), labels)
    more = stored(_exact(_bounded(_across(apart, nodes), nodes).join(pairs, ["a", "b"], "left_anti"), hashes))
    if more.take(1):
        labels = components(links.unionByName(more))
    root = names.join(labels.select(F.col("id").alias("node"), "label"), "node", "left").select("u", "v", F.coalesce("label", "node").alias("root"))
    found = sets.join(root, ["u", "v"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    # documents without a set, which may be many, meet nothing and stay out of the join
    return found.unionByName(placed.filter("u IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that name their component, in the columns of docs; of rows with one doc_id all stay, of components without any one row."""
    marked = _identified(docs)
    if marked is None:
        named = _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
        return docs.join(named, docs["doc_id"].eqNullSafe(named["doc_id"]), "left_semi")
    stay = _found(marked).groupBy("component_id").agg(F.coalesce(F.min("doc_id"), F.min("_id")).alias("_id")).select("_id")
    return marked.join(stay, "_id", "left_semi").select(docs.columns)
