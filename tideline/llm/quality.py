"""Line-first cleaning: rules per line remove failures, then documents that lose too much text are rejected.

A line that has a word fails if no sentence ends in it (punctuation rule: a mark with white space or the line's end behind it,
quotes and brackets between them allowed, so that no dot of an address or number counts), is mostly marks or exclamations (symbol
rule), is a row of separated labels (navigation rule), holds a boilerplate phrase of any of the languages in BOILERPLATE, or
repeats few words (repetition rule). Lines without a word stay. A document goes if its base signals fail, if its remaining lines hold less than half of its word
characters, or if fewer than ten words remain.

Only expressions on the row itself: no shuffle, and one long document costs no more than its own length.
Defined results: a null or blank text has no words, so base_failed is true. Repeated rows and ties are judged each alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
#: A sentence's end: marks of scripts that put a space behind them, or those that don't.
ENDS = r"""[.!?…][.!?…"'”’»)\]]*([\x20\x09-\x0D]|\z)|[。！？]"""
#: Phrases of web pages and licences, in small letters, by language.
BOILERPLATE = {
    "en": ("cookie policy", "we use cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved", "licensed under", "released under the", "enable javascript", "subscribe to our", "click here", "sign up for"),
    "de": ("diese website verwendet cookies", "wir verwenden cookies", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "lizenziert unter", "veröffentlicht unter der", "javascript aktivieren", "newsletter abonnieren", "klicken sie hier", "jetzt anmelden", "allgemeine geschäftsbedingungen"),
    "fr": ("ce site utilise des cookies", "nous utilisons des cookies", "politique de confidentialité", "conditions d'utilisation", "conditions générales d'utilisation", "tous droits réservés", "sous licence", "mentions légales", "activer javascript", "abonnez-vous à", "cliquez ici", "inscrivez-vous"),
    "es": ("este sitio utiliza cookies", "utilizamos cookies", "política de cookies", "política de privacidad", "términos de uso", "condiciones de uso", "todos los derechos reservados", "bajo la licencia", "aviso legal", "habilitar javascript", "suscríbete a", "haga clic aquí"),
}
PHRASES = tuple(p for language in BOILERPLATE.values() for p in language)
NAVIGATION = r" (\||>|»|•|/) "
MIN_WORDS = 10
#: Percent of a document's words that may stand in repeated 5-word windows.
MAX_REPEATED = 20
#: Percent of a document's word characters that its lines must keep.
MIN_KEPT = 50
WINDOW = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plain(text: Column) -> Column:
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(plain(text), " "), "")


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _shift(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def repeated_words(words: Column) -> Column:
    """How many words stand in 5-word windows that the array holds twice or more, the first one included."""

    def covered(positions: Column) -> Column:
        step = F.zip_with(positions, _shift(positions, 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda s, x: s + x)

    def exact(ws: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(ws) - WINDOW), lambda i: F.struct(F.concat_ws(" ", F.slice(ws, i + 1, WINDOW)).alias("w"), i.alias("p")))

        def marked(s: Column) -> Column:
            follows = F.zip_with(s, _shift(s, 1), lambda a, b: F.struct(a["w"].alias("w"), a["p"].alias("p"), F.coalesce(a["w"] == b["w"], F.lit(False)).alias("n")))
            both = F.zip_with(follows, F.concat(F.array(F.lit(False)), F.transform(follows, lambda x: x["n"])), lambda a, b: F.struct(a["p"].alias("p"), (a["n"] | b).alias("d")))
            return F.sort_array(F.transform(F.filter(both, lambda x: x["d"] & x["p"].isNotNull()), lambda x: x["p"]))

        return let(let(F.sort_array(windows), marked), covered)

    def counted(ws: Column) -> Column:
        # windows with distinct hashes are distinct; only texts with equal hashes pay for the exact count
        hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
        clash = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(ws) < WINDOW, F.lit(0)).when(clash, exact(ws)).otherwise(F.lit(0))

    return let(words, counted)


def line_facts(line: Column) -> Column:
    """A line, its words (n), their characters, and whether it has a word and fails a rule; its words are cut once."""

    def fails(ws: Column) -> Column:
        n = F.size(ws)
        separators = F.regexp_count(line, F.lit(NAVIGATION))
        return (
            ~line.rlike(ENDS)
            | (F.regexp_count(line, F.lit(f"[{SYMBOLS}]")) * 10 >= F.length(line))
            | (F.regexp_count(line, F.lit("!!")) * 3 >= n)
            | ((separators >= 3) & (separators * 3 >= n))
            | let(F.lower(line), lambda x: reduce(lambda a, b: a | b, [x.contains(p) for p in PHRASES]))
            | ((n >= 10) & (F.size(F.array_distinct(ws)) * 3 < n))
        )

    def facts(ws: Column) -> Column:
        chars = F.aggregate(ws, F.lit(0).cast("long"), lambda s, w: s + F.length(w))
        return F.struct(line.alias("line"), F.size(ws).cast("long").alias("n"), chars.alias("chars"), ((F.size(ws) > 0) & fails(ws)).alias("fails"))

    return let(word_array(line), facts)


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns clean (its text without failed lines), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    kept_chars, base_failed and kept; columns of these names are replaced (filter_documents and report keep a caller's)."""
    body = F.coalesce(F.col(text), F.lit(""))
    total = lambda of, c: F.aggregate(of, F.lit(0).cast("long"), lambda s, x: s + x[c])

    def summed(all_: Column) -> Column:
        def of(stay: Column) -> Column:
            worded = F.transform(F.filter(all_, lambda x: x["n"] > 0), lambda x: x["line"])
            return F.struct(
                F.array_join(F.transform(stay, lambda x: x["line"]), "\n").alias("clean"), total(all_, "n").alias("n_words"), total(all_, "chars").alias("word_chars"), total(stay, "n").alias("kept_words"), total(stay, "chars").alias("kept_chars"),
                let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            )

        return let(F.filter(all_, lambda x: ~x["fails"]), of)

    lines = let(F.transform(F.split(body, "\n"), line_facts), summed)
    measured = docs.withColumn("_lines", lines).withColumns({c: F.col("_lines").getField(c) for c in ("clean", "n_words", "word_chars", "n_dup_lines", "kept_chars", "kept_words")}).drop("_lines")
    measured = measured.withColumns({"n_symbols": (F.length(body) - F.length(without(body, SYMBOLS))).cast("long"), "n_repeat_words": repeated_words(word_array(body)).cast("long")})
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (100 * F.col("kept_chars") >= MIN_KEPT * F.col("word_chars")) & (F.col("kept_words") >= MIN_WORDS))


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with their failed lines removed, in the columns of docs, whatever their names; n_chars follows the text.

    Null and blank texts, and short ones, go, since their base signals fail; repeated rows are judged each; an empty table stays empty.
    """
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    kept = signals(docs.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in own.items() if c != text])).filter("kept")
    out = {text: F.col("clean")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return kept.select([out.get(c, F.col(n)).alias(c) for c, n in own.items()])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its base signals and whether it is kept."""
    return signals(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
w AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM b WHERE len(ws) >= 5)),
p AS (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM w) WHERE n > 1),
q AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM p GROUP BY r),
l AS (
  SELECT r, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
         len(list_distinct(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS nd,
         len(regexp_extract_all(x, ' (\||>|»|•|/) ')) AS sep
  FROM (SELECT r, unnest(ls) AS x FROM b)),
k AS (
  SELECT r, sum(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) AS kept_chars, sum(n) AS kept_words
  FROM l
  WHERE regexp_matches(x, '""" + ENDS.replace("'", "''") + r"""')
    AND len(regexp_extract_all(x, '[#*$%&|<>]')) * 10 < length(x)
    AND len(regexp_extract_all(x, '!!')) * 3 < n
    AND NOT (sep >= 3 AND sep * 3 >= n)
    AND NOT regexp_matches(lower(x), '""" + "|".join(PHRASES).replace("'", "''") + r"""')
    AND NOT (n >= 10 AND nd * 3 < n)
  GROUP BY r),
s AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars, coalesce(kept_words, 0) AS kept_words
  FROM b LEFT JOIN q USING (r) LEFT JOIN k USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * kept_chars >= 50 * word_chars AND kept_words >= 10 AS kept,
       kept_chars
FROM s
"""
