"""Hilbert-curve ordering: several metadata dimensions are quantised, rows sorted by their index on the curve and cut into runs.

Rows that lie near each other in every dimension come to lie in the same run, so a reader prunes whole shards by the least
and largest value of any of them. Quantile bounds come from all rows. Numbers order by value, strings as whole
strings, each distinct one weighted by its rows. Rows of one cell, however many, are ordered by key, so a hot cell spreads over as many tasks as its rows need.

Defined results: nulls fall in the lowest cell of their dimension; a null text has no bytes; ties on the curve order by key,
repeated rows each get a slot; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, stored

_ROW = (1 << 33) - 1


def text_bounds(df: DataFrame, column: str, count: int) -> list[str]:
    """The values of a string column at the quantiles 1 / count to (count - 1) / count of all rows, one value as often as it is met; nulls don't count."""
    values = df.select(F.col(column).cast("string").alias("_v")).filter("_v IS NOT NULL").groupBy("_v").agg(F.count("*").alias("_n"))
    ranges = stored(values.repartitionByRange(shuffle_partitions(df.sparkSession), "_v").withColumn("_part", F.spark_partition_id()))
    sums = ranges.groupBy("_part").agg(F.sum("_n").alias("_s"))
    # as many rows as there are shuffle partitions, so a broadcast is bounded
    before = sums.select("_part", F.expr("sum(_s) OVER (ORDER BY _part) - _s").alias("_before"), F.expr("sum(_s) OVER ()").alias("_total"))
    running = ranges.withColumn("_upto", F.expr("sum(_n) OVER (PARTITION BY _part ORDER BY _v)")).join(F.broadcast(before), "_part").withColumn("_upto", F.col("_before") + F.col("_upto"))
    # quantile k is the value of row ceil(k * _total / count)
    passed = F.expr(f"least(_upto * {count} DIV _total, {count - 1}) - least((_upto - _n) * {count} DIV _total, {count - 1})")
    return [r[0] for r in running.select("_v", passed.alias("_k")).filter("_k > 0").collect() for _ in range(r[1])]


def cell(value: Column, bounds: list, kind: str = "double") -> Column:
    """How many bounds lie below the value, so that the cells of a dimension with few values still reach over the whole range."""
    distinct = sorted(set(bounds))
    below = [sum(b < d for b in bounds) for d in distinct] + [len(bounds)]
    passed = F.size(F.filter(F.array(*[F.lit(b) for b in distinct]).cast(f"array<{kind}>"), lambda b: b < value))
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in below]), F.when(value.isNotNull(), passed)), F.lit(0)).cast("long")


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell given by one number of that many bits in each dimension."""
    n = len(cells)
    names = [f"x{i}" for i in range(n)]
    masks = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]).cast("array<bigint>")

    def packed(xs: list[Column]) -> Column:
        return F.struct(*[x.cast("long").alias(k) for x, k in zip(xs, names)])

    def turned(s: Column, q: Column) -> Column:
        xs, p = [s[k] for k in names], q - 1
        for i in range(n):
            on = xs[i].bitwiseAND(q) != 0
            if i == 0:
                xs[0] = F.when(on, xs[0].bitwiseXOR(p)).otherwise(xs[0])
                continue
            t = xs[0].bitwiseXOR(xs[i]).bitwiseAND(p)
            xs[0], xs[i] = F.when(on, xs[0].bitwiseXOR(p)).otherwise(xs[0].bitwiseXOR(t)), F.when(on, xs[i]).otherwise(xs[i].bitwiseXOR(t))
        return packed(xs)

    def gray(s: Column) -> Column:
        xs = [s[k] for k in names]
        for i in range(1, n):
            xs[i] = xs[i].bitwiseXOR(xs[i - 1])
        flip = F.aggregate(masks, F.lit(0).cast("long"), lambda t, q: F.when(xs[-1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return packed([x.bitwiseXOR(flip) for x in xs])

    def woven(s: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(s[k], b).bitwiseAND(F.lit(1).cast("long")), b * n + n - 1 - i) for b in range(bits) for i, k in enumerate(names)])

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    return once(once(F.aggregate(masks, packed(cells), turned), gray), woven)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with their rank (from 0) in the given order: ranges are sorted side by side and offset by the counts before them."""
    parts = shuffle_partitions(rows.sparkSession)
    ranges = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = ranges.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    # as many rows as there are shuffle partitions, so a broadcast is bounded
    before = counts.select("_part", F.expr("sum(_n) OVER (ORDER BY _part) - _n").alias("_before"), F.expr("sum(_n) OVER ()").alias("_total"))
    return (
        ranges.withColumn("_part", F.shiftright("_at", 33))
        .join(F.broadcast(before), "_part")
        .withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit(_ROW)))
        .drop("_part", "_at", "_before")
    )


def curve_order(df: DataFrame, dimensions: list[str], key: str, bits: int = 6) -> DataFrame:
    """df, which should be narrow, with columns hilbert, rank and _total, in the order of the curve over the dimensions."""
    df = stored(df)
    numbers = [c for c in dimensions if isinstance(df.schema[c].dataType, T.NumericType)]
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = df.agg(*[F.percentile_approx(F.col(c).cast("double"), cuts, 10000).alias(c) for c in numbers]).first().asDict() if numbers else {}
    cells = [cell(F.col(c).cast("double"), bounds[c] or []) if c in numbers else cell(F.col(c).cast("string"), text_bounds(df, c, 1 << bits), "string") for c in dimensions]
    rest = [c for c in df.columns if c != key]
    return ranked(df.withColumn("hilbert", hilbert_index(cells, bits)), ["hilbert", key, *rest])


def assign_shards(docs: DataFrame, shards: int = 16, dimensions: tuple[str, ...] = ("lang", "source", "size"), bits: int = 6, carry: tuple[str, ...] = ()) -> DataFrame:
    """A shard and slot for every document, by the law "rows": counts of shards differ by one at most.

    docs must have the dimensions as columns, but for size, which is taken from the text. carry: columns that come along.
    """
    named = [c for c in dimensions if c != "size"]
    if missing := [c for c in ("doc_id", "text", *named) if c not in docs.columns]:
        raise ValueError(f"no column {missing[0]} to order documents by")
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    narrow = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *named, *carry)
    placed = curve_order(narrow, list(dimensions), "doc_id", bits).withColumn("shard", F.expr(f"(rank * {shards}) DIV _total").cast("int"))
    first = F.expr(f"(shard * _total + {shards - 1}) DIV {shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert", *carry)


def write_shards(docs: DataFrame, path: str, shards: int = 16, dimensions: tuple[str, ...] = ("lang", "source", "size"), bits: int = 6, file_rows: int = 100_000) -> None:
    """Writes every row of docs, whole, into a folder per shard (shard_number=N), in curve order, in files of file_rows rows.

    Rows are told apart by their place, so rows that share a doc_id, or have none, are written once each.
    """
    columns = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    # written once, so places stay
    marked = stored(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()], F.monotonically_increasing_id().alias("_row")))
    needed = ["doc_id", "text", *[c for c in dimensions if c != "size"]]
    assigned = assign_shards(marked.select("_row", *[F.col(columns[c]).alias(c) for c in needed if c in columns]), shards, dimensions, bits, ("_row",))
    joined = marked.join(assigned.select("_row", F.col("shard").alias("shard_number"), "slot"), "_row")
    dealt = joined.repartition("shard_number", F.floor(F.col("slot") / file_rows)).sortWithinPartitions("shard_number", "slot")
    dealt.select(*[F.col(n).alias(c) for c, n in columns.items()], "shard_number").write.option("maxRecordsPerFile", file_rows).partitionBy("shard_number").parquet(path)
