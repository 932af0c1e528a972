"""Porter's suffix stripping (1980, with his later departures), for words that are lower case already."""

from __future__ import annotations

import re
from functools import lru_cache

# Suffixes and what replaces them, as published.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """A letter a character: v or c. A y after a consonant is a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s) and len(word) > len(s)), key=len, default=None)


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for s in ("ed", "ing"):
        root = word.removesuffix(s)
        if root != word and "v" in _shape(root):
            if root.endswith(("at", "bl", "iz")):
                return root + "e"
            if len(root) > 1 and root[-1] == root[-2] and root[-1] not in "aeioulsz":
                return root[:-1]
            return root + "e" if _measure(root) == 1 and _short_end(root) else root
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Words of fewer than 3 or more than 64 bytes stay as they are."""
    if not 3 <= len(word.encode()) <= 64:
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    word = _past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        s = _longest(word, table)
        if s and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    s = _longest(word, STEP4)
    if s and _measure(word[: -len(s)]) > 1 and (s != "ion" or word[-4] in "st"):
        word = word[: -len(s)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
