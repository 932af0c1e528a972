"""Pluggable functions: embedders, rerankers, custom scorers and codecs as Arrow-batched UDFs. The built-in ones are
deterministic stand-ins that need no model."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Texts whose words are hashed together.
TEXTS = 500


def hash_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """Words hashed to signed dimensions, unit length: equal texts have equal vectors on every machine. A word is hashed once
    a block of texts."""
    out = np.zeros((len(texts), dim))
    for a in range(0, len(texts), TEXTS):
        split = [(text or "").lower().split() for text in texts[a : a + TEXTS]]
        coded = pa.array([word for words in split for word in words], pa.large_string()).dictionary_encode()
        hashes = [int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") for word in coded.dictionary.to_pylist()]
        place, sign = np.array([h % dim for h in hashes], np.int64), np.array([1.0 if h >> 63 else -1.0 for h in hashes])
        code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(split)), [len(words) for words in split])
        if len(code):
            out[a : a + TEXTS] = np.bincount(row * dim + place[code], weights=sign[code], minlength=len(split) * dim).reshape(-1, dim)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def word_overlap(query: str, texts: list[str]) -> list[float]:
    q = set(query.lower().split())
    return [len(q & set((t or "").lower().split())) / len(q) if q else 0.0 for t in texts]


def embed_all(docs: DataFrame, text: str = "text", into: str = "embedding", encode: Callable[[list[str]], np.ndarray] = hash_embedding, only_missing: bool = True) -> DataFrame:
    """Adds vectors in batches; rows that have one keep it."""
    has = into in docs.columns and only_missing

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            missing = pdf[into].isna() if has else pd.Series(True, index=pdf.index)
            old = pdf[into].tolist() if has else [None] * len(pdf)
            new = iter(encode(pdf.loc[missing, text].fillna("").tolist()).tolist() if missing.any() else [])
            pdf[into] = [next(new) if m else o for m, o in zip(missing, old)]
            yield pdf

    base = docs if has else docs.drop(into)
    fields = [(n, t) for n, t in base.dtypes if n != into] + [(into, "array<double>")]
    return base.select(*[n for n, _ in fields if n in base.columns]).mapInPandas(work, ", ".join(f"`{n}` {t}" for n, t in fields))


def rerank(candidates: DataFrame, query: str, k: int, text: str = "text", key: str = "doc_id", score: Callable[[str, list[str]], list[float]] = word_overlap) -> DataFrame:
    """(key, rerank_score) of a bounded candidate list, best k."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "rerank_score": score(query, pdf[text].tolist())})

    kind = dict(candidates.dtypes)[key]
    return candidates.select(key, text).mapInPandas(work, f"{key} {kind}, rerank_score double").orderBy(F.desc("rerank_score"), key).limit(k)


CODECS = {"zlib": (lambda b: zlib.compress(b, 6), zlib.decompress), "gzip": (lambda b: gzip.compress(b, 6, mtime=0), gzip.decompress), "none": (bytes, bytes)}


def compress(rows: DataFrame, key: str, text: str, codec: str = "zlib", least: int = 100) -> DataFrame:
    """(key, algorithm, data, checksum, original, compressed): none below ``least`` bytes or where nothing is gained."""
    pack = CODECS[codec][0]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text]):
                raw = (t or "").encode()
                small = pack(raw) if len(raw) >= least else raw
                gain = len(small) < len(raw)
                out.append((k, codec if gain else "none", small if gain else raw, hashlib.sha256(raw).hexdigest(), len(raw), len(small) if gain else len(raw)))
            yield pd.DataFrame(out, columns=[key, "algorithm", "data", "checksum", "original", "compressed"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(work, f"{key} {kind}, algorithm string, data binary, checksum string, original long, compressed long")


def decompress(packed: DataFrame, key: str) -> DataFrame:
    """(key, text, intact): intact compares checksums."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [CODECS[a][1](bytes(d)) for a, d in zip(pdf["algorithm"], pdf["data"])]
            yield pd.DataFrame({key: pdf[key], "text": [r.decode() for r in raw], "intact": [hashlib.sha256(r).hexdigest() == c for r, c in zip(raw, pdf["checksum"])]})

    kind = dict(packed.dtypes)[key]
    return packed.mapInPandas(work, f"{key} {kind}, text string, intact boolean")


def codec_stats(packed: DataFrame) -> DataFrame:
    return packed.groupBy("algorithm").agg(F.count("*").alias("n"), F.sum("original").alias("original"), F.sum("compressed").alias("compressed"), (F.sum("compressed") / F.sum("original")).alias("ratio"))
