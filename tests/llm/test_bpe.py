import hashlib
import random

import numpy as np
import pytest

from tideline.llm import bpe
from tideline.llm.queries import vocabulary

POOL = [*" \n\t'' abstdmrevlSTRE.,!?012éΣσςİßNǅ中文😀　\r\x1c\x85½²٣", "́", "'s", "'ll", "'re", "  ", "<|endoftext|>", "<|startoftext|>", "don't", "ﬁ", "x" * 70, "1234567890" * 12, "äöü" * 30]


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def encoder(request):
    return bpe.Encoder(vocabulary(request.param))


def test_equals_the_library(encoder):
    rng = random.Random(5)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    ids, at = encoder.encode([*texts, None, ""])
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [w.ids for w in want] and at[-1] == at[-3]


def test_long_texts_are_cut_where_it_is_safe(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 500)
    monkeypatch.setattr(bpe, "CACHE", 50)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcd'sé.1") for _ in range(rng.randint(1, 9))) for _ in range(800)), "ab" * 3000, "short"]
    ids, at = encoder.encode(texts)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(3)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_fragments_and_texts_without_spaces(encoder, monkeypatch):
    rng = random.Random(7)
    letters = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(300))
    texts = ["".join(rng.choice("aeioulnstr") for _ in range(5000)), "=" * 3000, "é" * 999, "".join(rng.choice("abc=_/") for _ in range(4000)), "ab<|endoftext|><|endoftext|>" + "x" * 200, "<|endoftext|", "。".join(letters[rng.randint(0, 200) :][: rng.randint(1, 60)] for _ in range(90)), "привет мир " * 300, "x" * 2000 + "<|endoftext|>" + "y " * 900]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for chunk in (1 << 20, 150):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        ids, at = encoder.encode(texts)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want
    assert bpe.safe_end("ab" * 50 + "。cd", 3) == 100 and bpe.safe_end("привет мир", 2) == 6 and bpe.safe_end("abcdef", 1) == 6


def test_round_trip_query(spark):
    path = vocabulary("byte_bpe_50k.json")
    texts = [None, "", "Hello world, it's <|endoftext|> fine", "ÄÖ 中文\n\n  x", "Hello world, it's <|endoftext|> fine"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string")
    enc = bpe.encoder(path)
    for r in bpe.encode_decode(df, path, with_ids=True).collect():
        ids = enc.tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == enc.tokenizer.decode(ids, skip_special_tokens=False) == (texts[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), path).count() == 0
