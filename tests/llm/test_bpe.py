import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnfold.llm import bpe, byte_bpe, wavelet

WORD, BYTE = bpe.word_vocabulary(), wavelet.byte_vocabulary()
word_library, byte_library = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
word, byte = bpe.load(open(WORD).read()), byte_bpe.load(open(BYTE).read())

TEXTS = [
    "", " ", "a", "Hello, WORLD's 1234 don't", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|> a<|endoftext|>", "ΟΔΟΣ Σ İI", "é ́x ẛ̣", "a\x1cb\x1d \x1e", "a\x85b\xa0c　d",
    "tab\t\tnl\n\n x  y   z \n w\n", "日本語 テスト 🙂👩‍👩‍👧 ½ ² Ⅷ", "_under_score __ 's 'T 'll", "​᠎﻿", "x" * 3000, "no space" * 400, " lead", "trail ", "a \nb\n c \n\n d", "  q",
]


@pytest.mark.parametrize("text", TEXTS)
def test_texts_as_the_library(text):
    ids = word_library.encode(text, add_special_tokens=False).ids
    assert word.encode(text) == ids and word.decode(ids) == word_library.decode(ids, skip_special_tokens=False)
    assert np.frombuffer(byte.packed(text), np.uint16).tolist() == byte_library.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdlre1A.é<|")), max_size=60))
def test_random_texts_as_the_library(text):
    ids = word_library.encode(text, add_special_tokens=False).ids
    assert word.encode(text) == ids and word.decode(ids) == word_library.decode(ids, skip_special_tokens=False)
    assert np.frombuffer(byte.packed(text), np.uint16).tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_digests_and_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(98, None, "x"), (3, TEXTS[3], "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(df, WORD).collect()
    assert len(got) == len(rows) and bpe.digests(df.limit(0), WORD).count() == 0
    by = {r["doc_id"]: r for r in got}
    for i, t, _ in rows:
        ids = word_library.encode(t or "", add_special_tokens=False).ids
        text = word_library.decode(ids, skip_special_tokens=False)
        assert tuple(by[i])[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode(bpe.encode(df, WORD), WORD).collect()
    assert {r["doc_id"]: r["decoded"] for r in back}[3] == word_library.decode(word_library.encode(TEXTS[3], add_special_tokens=False).ids)


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (7, 2), (1000, 300), (5000, 50257), (513, 1)])
def test_wavelet_matrix(n, top):
    rng = np.random.default_rng(n)
    x = np.minimum(rng.integers(0, top, n), rng.integers(0, top, n)).astype(np.uint16)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(x).to_bytes())
    assert w.values().tolist() == x.tolist()
    for i in rng.integers(0, n, 30) if n else []:
        assert w.access(int(i)) == x[i]
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert w.count(int(x[i]), a, b) == int((x[a:b] == x[i]).sum())
        assert w.occurrences(int(x[i])) == np.flatnonzero(x == x[i]).tolist()
    assert w.count(65535) == 0 or top > 65535


def test_shards_hold_every_document_in_order(spark, tmp_path):
    rows = [(i * 3, TEXTS[i % len(TEXTS)] + str(i), 1) for i in range(200)] + [(5, None, 1), (None, "z", 1), (9, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    wavelet.write(df, str(tmp_path / "w"), BYTE, shard_tokens=500)
    got = sorted(wavelet.with_starts(spark, str(tmp_path / "w")).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    order, at = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())), 0
    for r, (k, t, _) in zip(got, order):
        ids = byte_library.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert max(r["seq"] for r in got) > 0
    wavelet.write(df.limit(0), str(tmp_path / "e"), BYTE)
    assert wavelet.with_starts(spark, str(tmp_path / "e")).count() == 0
