import hashlib
import random
import re

import duckdb

from tideline.llm import decontam

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [(m.group(), m.start(), m.end()) for m in WORDS.finditer(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]


def brute(docs, items, size=10):
    out = []
    for d, text in docs:
        w = [x[0] for x in words(text)]
        hit, ids = set(), set()
        for i, t in items:
            v = [x[0] for x in words(t)]
            n = min(size, len(v))
            for k in range(len(v) - n + 1 if v else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[k : k + n]:
                        hit.update(range(at, at + n))
                        ids |= {str(i)} - {"None"}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(5)
    pool = ["a", "B", "Ça", "中", "x1", "7", "été", "É"]
    text = lambda n: rng.choice([" ", "\n", "--", "\x00", "`{"]).join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.randint(8, 25))) for i in range(20)] + [(2, "the end"), (10, "The--END!"), (30, None), (31, "?!"), (None, "solo word"), (2, "the end")]
    docs = [(i, text(rng.randint(0, 300))) for i in range(40)]
    docs += [(100 + i, f"{text(30)}. {t} {text(3)}{t}") for i, (_, t) in enumerate(items)] + [(None, None), (7, ""), (7, "so the end. solo WORD"), (7, "so the end. solo WORD"), (8, "the ending; othe end")]
    return docs, items


def tables(spark):
    docs, items = cases()
    return spark.createDataFrame([(d, t, "n", [1]) for d, t in docs], "doc_id long, text string, n_words string, items array<int>"), spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, window int")


def test_hits_equal_brute_force_with_one_automaton_and_with_many(spark, monkeypatch):
    docs, items = tables(spark)
    want = brute(*cases())
    assert sum(r[5] for r in want) > 20
    got = lambda: sorted(map(tuple, decontam.report(docs, items).collect()), key=repr)
    assert got() == want
    total = decontam.item_windows(items).count()
    full = decontam.scan
    monkeypatch.setattr(decontam, "scan", lambda d, b: full(d, b, part_bytes=40 * total // 3))
    assert got() == want


def test_hits_equal_sql(spark):
    docs, items = cases()
    c = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        c.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?)", [r for r in rows if "\x00" not in (r[1] or "")])
    clean = [[r for r in rows if "\x00" not in (r[1] or "")] for rows in (docs, items)]
    assert sorted(c.sql(decontam.SQL).fetchall(), key=repr) == brute(*clean)


def test_spans_lead_back_to_the_text(spark):
    docs, items = tables(spark)
    text = dict(r for r in cases()[0] if r[0] is not None and r[0] >= 100)
    seen = 0
    for r in decontam.scan(docs, items).filter("doc_id >= 100").collect():
        w = words(text[r.doc_id])
        for s in r.spans:
            assert (s.begin, s.stop) == (w[s.first][1], w[s.last - 1][2])
            seen += 1
    assert seen > 20


def test_pieces_of_a_long_text_are_scanned_as_one(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 7)
    matcher = decontam.Matcher([(w, n, ["q"]) for w, n in decontam.windows(b"one two three four", 3)])
    text = decontam.normalised(b"One, two, three; four " * 500 + b"one two")[0]
    first, n, ids = matcher.scan(text)
    assert ids == {"q"} and decontam.merged(first, n) == [(4 * i, 4 * i + 4) for i in range(500)] or decontam.merged(first, n) == [(0, 2000)]
    assert sum(b - a for a, b in decontam.merged(first, n)) == 2000


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert decontam.report(docs.limit(0), items).count() == 0
    rows = decontam.report(docs, items.limit(0)).collect()
    assert len(rows) == len(cases()[0]) and not any(r.contaminated or r.n_items for r in rows)
