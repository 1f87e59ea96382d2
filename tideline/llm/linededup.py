"""Line dedup by a deletion-neighbourhood join: within one edit, the earliest line stays.

A line is removed if an equal line or one within one edit (a character put in, taken out or replaced) stands earlier, by
doc_id and line number; lines without a word always stay, and near pairs are those of lines with
`floor` characters or more (NEAR unless told otherwise: in a shorter line one character is often the whole difference, as between
two numbered headings); shorter lines go only for equal ones. `bound` is 1, or 0 for equal lines alone.

Distinct lines are found by digest. Two lines within one edit share their first or last half (halves of the shorter one), so
only lines that share a half with another enter the join; for the rest it could find nothing. An entering line emits the
hashes of its variants with one character deleted from its other half. Variants that lack the same place of lines of one
length differ by a replacement; a line that equals another's variant differs by a deletion. Groups of equal variants are
small whatever the corpus: lines are distinct, so at most one per character of the alphabet and place can meet. Each line is
held against the earliest of its groups, and the edit distance of the two texts is verified.

A variant's hash combines the hashes of its blocks, of about the square root of its length but BLOCK characters at least. Only
the block that lacks the character is hashed anew; the hashes of those before it, and of those behind it, which stand one place
further, are combined once a block. So a line of n characters costs n blocks and its n / block blocks costs their square, and
its places are spread over rows block by block.

Only DataFrame functions run. Defined results: null texts have no lines; rows that share a doc_id share their decisions, and
if their texts differ a line goes only where it equals the judged one; ties can't occur among distinct places; an empty table
stays empty; other columns are kept; a line may be as long as a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored
from .quality import let

#: Characters that both lines of a near pair must have if nothing else is asked for.
NEAR = 16
WORDED = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


#: The halves under which a line meets others, by code: its first or last half as the shorter line, and as the longer one.
CODES = ("p0", "s0", "p1", "s1")
#: What tells a distinct line: the place of its first row and, where rows share a doc_id, its hash.
LINE = ("doc_id", "line_no", "check")


def _halves(line: Column, n: Column, floor: int) -> list[Column]:
    """The hashes of a line's halves in the order of CODES, NULL where it is too short."""
    out = []
    for part in (0, 1):
        short = n - part
        cut = F.floor(short / 2).cast("int")
        for k, x in (("p", F.substring(line, F.lit(1), cut)), ("s", F.substring(line, n - (short - cut) + 1, short - cut))):
            out.append(F.when(short >= floor, F.xxhash64(F.lit(k), short, x)).alias(f"{k}{part}"))
    return out


#: Least characters of a block of a variant.
BLOCK = 256
_XOR = "aggregate({}, 0L, (x, y) -> x ^ y)"


def _size(n: str) -> str:
    """Characters of a block in a text of n."""
    return f"greatest({BLOCK}L, CAST(ceil(sqrt({n})) AS BIGINT))"


def _blocks(line: str, size: str) -> str:
    """A line cut into blocks, in one pass."""
    return f"regexp_extract_all({line}, concat('(?s).{{1,', {size}, '}}'), 0)"


def _hashes(blocks: str) -> str:
    return f"transform({blocks}, (s, k) -> xxhash64(k, s))"


def _variants(texts: DataFrame) -> DataFrame:
    """me, kind, place and hash of the variants of lines in one of their groups (code). Kind 0: one place of equal lengths; 1: taken from the longer; 2: the shorter itself."""
    lines = texts.select(F.struct(*LINE).alias("me"), "line", (F.col("code") % 2 == 0).alias("front"), F.expr("code DIV 2").alias("part"), F.length("line").cast("long").alias("n"))
    whole = lines.filter("part = 0").select("me", F.lit(2).alias("kind"), F.lit(None).cast("int").alias("place"), F.expr(f"xxhash64('d', n, {_XOR.format(_hashes(_blocks('line', _size('n'))))})").alias("hash"))
    # the places of the other half
    placed = lines.selectExpr("*", f"{_size('n - 1')} AS size", "CASE WHEN front THEN (n - part) DIV 2 ELSE 0L END AS low", "CASE WHEN front THEN n - 1 ELSE (n - part) DIV 2 - 1 + part END AS high").filter("low <= high")
    cut = placed.selectExpr("*", f"{_blocks('line', 'size')} AS own", f"{_hashes(_blocks('substring(line, 2)', 'size'))} AS behind").selectExpr("*", f"{_hashes('own')} AS before")
    rest = f"{_XOR.format('slice(before, 1, CAST(b AS INT))')} ^ {_XOR.format('slice(behind, CAST(b + 2 AS INT), size(behind))')}"
    around = f"named_struct('b', CAST(b AS INT), 'rest', {rest}, 'chunk', concat(get(own, CAST(b AS INT)), coalesce(substring(get(own, CAST(b + 1 AS INT)), 1, 1), '')))"
    spread = cut.selectExpr("me", "part", "n", "size", "low", "high", f"explode(transform(sequence(low DIV size, high DIV size), b -> {around})) AS x")
    lacking = "concat(substring(x.chunk, 1, CAST(i - x.b * size AS INT)), substring(x.chunk, CAST(i - x.b * size + 2 AS INT), CAST(size AS INT)))"
    # a last character that begins a block leaves no such block
    total = f"x.rest ^ CASE WHEN x.b * size >= n - 1 THEN 0L ELSE xxhash64(x.b, {lacking}) END"
    places = "sequence(greatest(low, x.b * size), least(high, x.b * size + size - 1))"
    both = f"transform({places}, i -> named_struct('kind', CAST(part AS INT), 'place', CAST(i AS INT), 'hash', CASE WHEN part = 0 THEN xxhash64('r', n, i, {total}) ELSE xxhash64('d', n - 1, {total}) END))"
    return spread.selectExpr("me", f"inline({both})").unionByName(whole)


def _removed_near(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The distinct lines (LINE) that have an earlier line within one edit."""
    codes = F.array(*[F.struct(F.lit(i).cast("byte").alias("code"), F.col(c).alias("half")) for i, c in enumerate(CODES)])
    halves = first.select(*LINE, F.inline(F.filter(codes, lambda x: x["half"].isNotNull())))
    shared = halves.groupBy("half").agg(F.count("*").alias("n"), F.min("code").alias("least")).filter("n > 1 AND least < 2").select("half")
    entering = halves.join(shared, "half").select(*LINE, "code")
    wanted = stored(entering.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "check", "code")).alias("lines")))
    # nothing bounds how many lines enter, so this side is never broadcast and the plan is the same at every size
    named = docs.select(F.col("doc_id").alias("_doc"), _lines(F.col("text")).alias("texts")).join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")))
    got = let(F.col("texts"), lambda t: F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), x["check"].alias("check"), x["code"].alias("code"), F.get(t, x["line_no"]).alias("line"))))
    texts = named.select("doc_id", F.explode(got).alias("x")).select("doc_id", "x.line_no", "x.check", "x.code", "x.line").filter(F.xxhash64("line") == F.col("check"))
    # a few texts make many variants, so they are dealt out by number and not by size
    texts = stored(texts.repartition(shuffle_partitions(docs.sparkSession), *LINE, "code"))
    rows = _variants(texts)
    group = "OVER (PARTITION BY hash)"
    met = rows.withColumns({
        "same": F.expr(f"min(CASE WHEN kind = 0 THEN me END) {group}"),
        "longer": F.expr(f"min(CASE WHEN kind = 1 THEN struct(me, place) END) {group}"),
        "shorter": F.expr(f"min(CASE WHEN kind = 2 THEN me END) {group}"),
    })
    other = F.when(F.col("kind") == 0, F.col("same")).when(F.col("kind") == 1, F.col("shorter")).otherwise(F.col("longer.me"))
    pairs = met.select("me", other.alias("earlier"), "kind", F.coalesce("place", "longer.place").alias("place")).filter("earlier < me").groupBy("me", "earlier", "kind").agg(F.min("place").alias("place"))
    line = texts.select(F.struct(*LINE).alias("me"), "line").dropDuplicates(["me"])
    both = pairs.join(line, "me").join(line.select(F.col("me").alias("earlier"), F.col("line").alias("before")), "earlier")
    # one edit at that place makes one of the other; the edit distance by its table would cost the square of a line
    lacking = lambda x: f"concat(substring({x}, 1, place), substring({x}, place + 2))"
    fits = f"CASE kind WHEN 0 THEN {lacking('line')} = {lacking('before')} AND length(line) = length(before) WHEN 1 THEN {lacking('line')} = before ELSE {lacking('before')} = line END"
    return both.filter(fits).select("me").distinct().select("me.*")


def decisions(docs: DataFrame, floor: int = NEAR, bound: int = 1) -> DataFrame:
    """doc_id, keep (the numbers of the worded lines that stay) and n_near (how many go for an unequal one) of every document with either."""
    if bound not in (0, 1) or floor < 1:
        raise ValueError("bound must be 0 or 1, and floor 1 or more")
    body = docs.select("doc_id", F.posexplode(_lines(F.col("text"))).alias("line_no", "line")).filter(F.col("line").rlike(WORDED))
    keyed = body.select(F.unhex(F.md5("line")).alias("digest"), "doc_id", "line_no", F.xxhash64("line").alias("check"), *_halves(F.col("line"), F.length("line"), floor))
    first = stored(keyed.groupBy("digest").agg(F.min(F.struct(*LINE, *CODES)).alias("m")).select("m.*"))
    if bound:
        near = _removed_near(docs, first).withColumn("near", F.lit(True))
        same = [first[c].eqNullSafe(near[c]) for c in LINE]
        judged = first.join(near, same, "left").select(first["doc_id"], first["line_no"], F.coalesce("near", F.lit(False)).alias("near"))
    else:
        judged = first.select("doc_id", "line_no", F.lit(False).alias("near"))
    return judged.groupBy("doc_id").agg(F.collect_list(F.when(~F.col("near"), F.col("line_no"))).alias("keep"), F.count(F.when(F.col("near"), 1)).alias("n_near"))


def _kept_lines(texts: Column, keep: Column) -> Column:
    """The lines that stay: those without a word and those whose numbers are in keep."""
    numbers = F.transform(texts, lambda _, i: i * 2 + 1)
    # in the sorted numbers a line's odd one follows its even one exactly if it is kept
    merged = F.sort_array(F.concat(F.transform(keep, lambda k: k * 2), numbers))

    def flags(s: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
        marks = F.zip_with(s, before, lambda a, b: F.when(a % 2 == 1, a - 1 == b))
        return F.filter(marks, lambda m: m.isNotNull())

    paired = F.zip_with(texts, let(merged, flags), lambda t, k: F.when(k | ~t.rlike(WORDED), t))
    return F.filter(paired, lambda t: t.isNotNull())


def dedup_lines(docs: DataFrame, floor: int = NEAR, bound: int = 1) -> DataFrame:
    """docs with the columns clean (the text without removed lines), n_lines, n_removed and n_near."""
    marks = decisions(docs, floor, bound).withColumnRenamed("doc_id", "_doc")
    joined = docs.join(marks, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    keep = F.coalesce("keep", F.array().cast("array<int>"))
    out = joined.withColumn("_texts", _lines(F.col("text"))).withColumn("_kept", _kept_lines(F.col("_texts"), keep))
    return out.withColumns({
        "clean": F.array_join("_kept", "\n"),
        "n_lines": F.size("_texts").cast("long"),
        "n_removed": (F.size("_texts") - F.size("_kept")).cast("long"),
        "n_near": F.coalesce("n_near", F.lit(0)).cast("long"),
    }).drop("_texts", "_kept", "keep")


def filter_documents(docs: DataFrame) -> DataFrame:
    """docs without their removed lines, in the columns of docs; documents that lost all their words go."""
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")], "doc_id", "text")
    out = dedup_lines(plain).filter((F.col("n_removed") == 0) | F.col("clean").rlike(WORDED))
    named = []
    for i, c in enumerate(docs.columns):
        if c == "text":
            named.append(F.when(F.col("text").isNotNull(), F.col("clean")).alias(c))
        elif c == "n_chars":
            named.append(F.when(F.col("n_removed") > 0, F.length("clean")).otherwise(F.col(f"_c{i}")).cast(docs.schema[c].dataType).alias(c))
        else:
            named.append(F.col("doc_id" if c == "doc_id" else f"_c{i}").alias(c))
    return out.select(named)


def report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "n_near", F.md5("clean").alias("clean_md5"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS n, unnest(ls) AS line FROM d),
w AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS k FROM a WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT doc_id, n, line, length(line) AS c FROM w WHERE k = 1),
h AS (
  SELECT f.*, c AS s, 'p' AS side, left(line, c // 2) AS half FROM f WHERE c >= 16
  UNION ALL SELECT f.*, c, 's', right(line, c - c // 2) FROM f WHERE c >= 16
  UNION ALL SELECT f.*, c - 1, 'p', left(line, (c - 1) // 2) FROM f WHERE c > 16
  UNION ALL SELECT f.*, c - 1, 's', right(line, c - 1 - (c - 1) // 2) FROM f WHERE c > 16),
p AS (
  SELECT DISTINCT x.line AS x, y.line AS y, x.c AS cx, y.c AS cy
  FROM h x JOIN h y ON x.s = y.s AND x.side = y.side AND x.half = y.half AND (x.doc_id, x.n) > (y.doc_id, y.n) AND least(x.c, y.c) = x.s),
e AS (
  SELECT DISTINCT x FROM (SELECT *, unnest(range(1, greatest(cx, cy) + 1)) AS i FROM p)
  WHERE CASE WHEN cx = cy THEN left(x, i - 1) || substr(x, i + 1) = left(y, i - 1) || substr(y, i + 1)
             WHEN cx > cy THEN left(x, i - 1) || substr(x, i + 1) = y
             ELSE left(y, i - 1) || substr(y, i + 1) = x END),
m AS (SELECT a.*, w.k > 1 OR e.x IS NOT NULL AS gone, coalesce(w.k = 1 AND e.x IS NOT NULL, false) AS near
      FROM a LEFT JOIN w ON a.doc_id = w.doc_id AND a.n = w.n LEFT JOIN e ON e.x = w.line)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (coalesce(gone, false)) AS BIGINT) AS n_removed, CAST(count(*) FILTER (near) AS BIGINT) AS n_near,
       md5(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT coalesce(gone, false)), '')) AS clean_md5
FROM m GROUP BY doc_id
"""
