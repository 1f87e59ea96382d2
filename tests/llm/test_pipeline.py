"""The pipeline held against plain Python on a small corpus, and the entry without the subpackage."""

import os
import random
import re
import shutil
import subprocess
import sys

import numpy as np
import pytest
from test_lines_and_quality import near, repeated, words

from tideline.llm import bpe, quality
from tideline.llm.queries import vocabulary

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, clean string, n int"


def corpus(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    sentence = lambda: " ".join(rng.choice(pool) for _ in range(rng.randint(6, 14))) + "."
    shared = [sentence() for _ in range(6)]
    bad = ["Home | News | About. | Map", "WOW!! BUY!! NOW!!", "all rights reserved.", "no stop here", "### $$$ %%% ***.", ""]
    texts = []
    for _ in range(70):
        lines = [sentence() for _ in range(rng.randint(0, 6))]
        for extra in (shared, bad, bad):
            if rng.random() < 0.4:
                lines.insert(rng.randint(0, len(lines)), rng.choice(extra))
        texts.append("\n".join(lines))
    for t in rng.sample(texts[:60], 20):
        # a copy in one line survives line dedup
        ws = (t.replace("\n", " ") if rng.random() < 0.6 else t).split(" ")
        if rng.random() < 0.7 and len(ws) > 3:
            ws[rng.randrange(len(ws))] = "other"
        texts.append(" ".join(ws) + rng.choice(["", "\nOne more line that is new here."]))
    texts += [None, "", "short.", texts[0], "a b c d e. " * 30]
    return [(i * 7 % 1000, t, "en", "s", len(t or ""), "mine", i) for i, t in enumerate(texts)]


def line_goes(line):
    ws = words(line)
    if not ws:
        return False
    separators = len(re.findall(r" (?:\||>|»|•|/) ", line))
    return (
        not re.search(quality.ENDS.replace(r"\z", r"\Z"), line) or sum(line.count(c) for c in quality.SYMBOLS) * 10 >= len(line) or line.count("!!") * 3 >= len(ws)
        or separators >= 3 and separators * 3 >= len(ws) or any(p in line.lower() for p in quality.PHRASES) or len(ws) >= 10 and len(set(ws)) * 3 < len(ws)
    )


def cleaned(docs):
    out = {}
    for d, t in docs.items():
        ws, rest = words(t), "\n".join(x for x in (t or "").split("\n") if not line_goes(x))
        size = lambda x: sum(map(len, words(x)))
        if len(ws) >= 10 and 100 * repeated(ws) <= 20 * len(ws) and 100 * size(rest) >= 50 * size(t) and len(words(rest)) >= 10:
            out[d] = rest
    return out


def deduplicated(docs):
    seen, out = [], {}
    for d in sorted(docs):
        kept, before = [], docs[d].split("\n")
        for x in before:
            again = words(x) and any(x == y or len(x) >= 16 and len(y) >= 16 and near(x, y) for y in seen)
            seen += [x] if words(x) else []
            kept += [] if again else [x]
        if len(kept) == len(before) or words("\n".join(kept)):
            out[d] = "\n".join(kept)
    return out


def one_of_each(docs):
    def shingles(t):
        ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())

    sets, top = {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                top[max(root(a), root(b))] = min(root(a), root(b))
    return {d: t for d, t in docs.items() if root(d) == d}


@pytest.mark.parametrize("seed", [1, 2])
def test_stages_equal_plain_python(spark, seed):
    import corpus_pipeline

    rows = corpus(seed)
    docs, want = spark.createDataFrame(rows, SCHEMA), {d: t for d, t, *_ in rows}
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (cleaned, deduplicated, one_of_each)):
        before, want = len(want), plain(want)
        assert 0 < len(want) and (len(want) < before or name == "line_dedup")
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), SCHEMA)
        got = docs.collect()
        assert {r.doc_id: r.text for r in got} == want and len(got) == len(want), name
        assert all((r.lang, r.source, r.clean, r.n_chars) == ("en", "s", "mine", len(r.text)) for r in got)
    enc, sequences = bpe.encoder(vocabulary("word_bpe_49k.json")), {}
    packed = corpus_pipeline.STAGES[3][1](spark, docs, "").collect()
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    lengths = {d: len(enc.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    assert {r.doc_id: r.length for r in packed} == lengths
    assert len(sequences) == -(-sum(lengths.values()) // 2048)
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= 2048


def test_stages_take_nulls_and_empty_tables(spark):
    import corpus_pipeline

    good = "One line of ten words or more that ends well, it does."
    rows = [(None, good, None, None, None, None, None), (None, good + "\nAnd another line that is kept here.", None, None, None, None, None), (3, None, None, None, None, None, None), (4, good, "en", None, 1, "x", 1), (4, good, "en", None, 1, "x", 1)]
    for docs, counts in ((spark.createDataFrame(rows, SCHEMA), (4, 4)), (spark.createDataFrame([], SCHEMA), (0, 0))):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), SCHEMA)
            assert i or docs.count() == counts[0]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_entry_works_without_the_subpackage(tmp_path):
    """Both folders and corpus_pipeline.py taken away: the entry imports and keeps the engine's own queries."""
    for name in ("tideline", "tests"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()) and len(q) > 30 and not [x for x in q if x.startswith('op') or x == 'pipeline']; assert not e.HAS_LLM"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()} and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
