"""BPE encoding and decoding of whole texts by a word-level vocabulary file.

Merging uses a priority queue of merge ranks over a doubly linked list of symbols; entries that a merge has made stale
are skipped when they surface. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.llm.text import each, tidy

#: White space as Unicode has it; str.split() also splits at 0x1C-0x1F.
_CHUNK = re.compile(r"[^\t-\r \x85\xa0  -     　]+")
_ODD = re.compile(r"[\x1c-\x1f]")
CACHE = 600_000


def byte_alphabet() -> dict[int, str]:
    """Each byte's printable stand-in: itself where printable in Latin-1, else the code points from 256 in order."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in set(kept) else chr(next(rest)) for b in range(256)}


def newer(text: str) -> bool:
    """Whether a character is unassigned in Python's Unicode tables: libraries of other versions may class it."""
    return any(unicodedata.category(c) == "Cn" for c in set(text))


def merge(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The symbols after all merges: lowest rank first, leftmost among equals. ``ranks`` has the rank of a pair a, b as
    ``a << 32 | b``, ``made`` the symbol of a rank. A queue entry is one number: rank, then place."""
    n = len(ids)
    queue = []
    for i in range(n - 1):
        rank = ranks.get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            queue.append(rank << 32 | i)
    if not queue:
        return ids
    ids, after, before = ids[:], [*range(1, n), -1], [*range(-1, n - 1)]
    heapq.heapify(queue)
    pop, push, get = heapq.heappop, heapq.heappush, ranks.get
    while queue:
        entry = pop(queue)
        rank, i = entry >> 32, entry & 0xFFFFFFFF
        left = ids[i]
        j = after[i]
        if left < 0 or j < 0 or get(left << 32 | ids[j]) != rank:
            continue  # stale: a merge has taken or changed one of the two
        ids[i] = new = made[rank]
        ids[j] = -1
        after[i] = j = after[j]
        if j >= 0:
            before[j] = i
            rank = get(new << 32 | ids[j])
            if rank is not None:
                push(queue, rank << 32 | i)
        j = before[i]
        if j >= 0:
            rank = get(ids[j] << 32 | new)
            if rank is not None:
                push(queue, rank << 32 | j)
    return [x for x in ids if x >= 0]


class WordBPE:
    """From the JSON of the file: vocabulary, merges, added tokens, normaliser steps, split pattern and word suffix."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in {**self.vocab, **self.added}.items()}
        steps = spec.get("normalizer") or {}
        self.steps = {s["type"] for s in (steps.get("normalizers") or [steps])}
        split = next(s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        letters = byte_alphabet()
        self.inner = [self.vocab[letters[b]] for b in range(256)]
        self.last = [self.vocab[letters[b] + self.suffix] for b in range(256)]
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.limit = CACHE
        self.source = source

    def word(self, piece: bytes) -> list[int]:
        """One pre-token: its bytes, the last with the word's suffix, merged."""
        inner = self.inner
        ids = [inner[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        return merge(ids, self.ranks, self.made)

    def _library_pieces(self, part: str) -> list[bytes]:
        """Normalised and split by the library, for characters that only its Unicode tables may know."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(self.source)
        back = {c: b for b, c in byte_alphabet().items()}
        return [bytes(back[c] for c in p) for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))]

    def _ids(self, chunk: str) -> list[int]:
        """Of a run without white space: tokens never span white space, so runs encode alone."""
        if chunk.isascii() and chunk.isalpha():  # one pre-token, whose normal form is its lower case
            return self.word((chunk.lower() if "Lowercase" in self.steps else chunk).encode())
        ids: list[int] = []
        for part in self.special.split(chunk) if self.special and "<" in chunk else [chunk]:
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                if not part.isascii():
                    if newer(part):
                        for piece in self._library_pieces(part):
                            ids += self.word(piece)
                        continue
                    if "NFC" in self.steps:
                        part = unicodedata.normalize("NFC", part)
                if "Lowercase" in self.steps:
                    part = part.lower() if part.isascii() else "".join(map(str.lower, part))  # by character: no final sigma
                for piece in [part] if part.isalpha() else self.pieces.findall(part):
                    ids += self.word(piece.encode("utf-8", "surrogatepass"))
        return ids

    def runs(self, text: str | None) -> list[str]:
        if not text:
            return []
        return _CHUNK.findall(text) if _ODD.search(text) else text.split()

    def encode(self, text: str | None) -> list[int]:
        return [i for run in self.runs(text) for i in self._ids(run)]

    def decode(self, ids) -> str:
        return " ".join([self.strings[i] for i in ids])

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids as text, sha256 of the decoded text)."""
        cache, n, ids, decoded = self.cache, 0, [], []
        get, strings = cache.get, self.strings
        for run in self.runs(text):
            found = get(run)
            if found is None:
                own = self._ids(run)
                found = (len(own), " ".join(map(str, own)), " ".join([strings[i] for i in own]))
                if len(cache) < self.limit:
                    cache[run] = found
            if found[0]:
                n += found[0]
                ids.append(found[1])
                decoded.append(found[2])
        return n, hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(decoded).encode()).hexdigest()


_loaded: dict[str, WordBPE] = {}


def load(source: str) -> WordBPE:
    """Once a Python worker and file: the word cache outlives the task."""
    key = hashlib.md5(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBPE(source)
    return _loaded[key]


def _mapped(df: DataFrame, path: str, keep: tuple[str, ...], column: str, made: list[T.StructField], run, cache: int = CACHE) -> DataFrame:
    """``run(tokenizer, value)`` -> a tuple for ``made``, row by row in Arrow batches. The file (a few MB, whatever the
    corpus) is read by the driver and broadcast, so executors need no folder of the driver's."""
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(*keep, F.col(column).alias("__value"))
    schema = T.StructType([rows.schema[k] for k in keep] + made)
    types = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.ArrayType(T.IntegerType()): pa.list_(pa.int32())}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(shared.value)
        tokenizer.limit = cache
        for batch in batches:
            got = [run(tokenizer, v) for v in each(batch.column("__value"))]
            new = [pa.array([g[i] for g in got], types[f.dataType]) for i, f in enumerate(made)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + new, names=[*keep, *[f.name for f in made]])
        tidy()

    return rows.mapInArrow(work, schema)


def encode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(*keep, ids array<int>). Null and empty texts have no ids; whole texts; a projection without a shuffle."""
    return _mapped(df, path, keep, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], lambda t, v: (t.encode(v),))


def decode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """(*keep, decoded string): the vocabulary strings, joined as the file (without a decoder) asks: by spaces."""
    return _mapped(df, path, keep, ids, [T.StructField("decoded", T.StringType())], lambda t, v: (t.decode(v or ()),))


def digests(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", cache: int = CACHE) -> DataFrame:
    """(*keep, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding each text in one pass.

    ``cache``: runs that a Python worker remembers. Null is read as the empty text; both have 0 tokens and the digests of nothing. Repeated rows come back each, an
    empty table gives no rows, columns not in ``keep`` are dropped.
    """
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(df, path, keep, text, made, lambda t, v: t.digest(v), cache)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_vocabulary())
