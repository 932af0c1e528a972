"""Byte-level BPE ids of whole texts, equal to the tokenizers library's for the same file, by tiktoken."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import tiktoken

from tarnfold.llm.bpe import byte_alphabet, newer

# Fixed value: the split pattern of the file's byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBPE:
    """``packed(text)``: the ids as little-endian 16-bit numbers, so vocabularies up to 65,536."""

    def __init__(self, source: str):
        spec = json.loads(source)
        byte_of = {c: b for b, c in byte_alphabet().items()}
        raw = lambda s: bytes(byte_of[c] for c in s)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        single = sorted((s for s in vocab if len(s) == 1), key=lambda s: vocab[s])
        ranked = dict.fromkeys(single + [a + b for a, b in pairs])
        ranks = {raw(s): i for i, s in enumerate(ranked)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if max([*vocab.values(), *added.values()]) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        special = {s: len(ranks) + i for i, s in enumerate(added)}
        self.ids = np.array([vocab[s] for s in ranked] + list(added.values()), np.uint16)
        self.same = bool((self.ids == np.arange(len(self.ids))).all())
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.source, self.library = source, None

    def packed(self, text: str) -> bytes:
        if not text.isascii() and newer(text):  # characters that only the library's Unicode tables may know
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.source)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()
        found = self.encoding.encode_to_numpy(text, allowed_special="all" if "<" in text else set(), disallowed_special=())
        return (found.astype(np.uint16) if self.same else self.ids[found]).tobytes()


_loaded: dict[str, ByteBPE] = {}


def load(source: str) -> ByteBPE:
    key = hashlib.md5(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(source)
    return _loaded[key]
