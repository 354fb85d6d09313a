"""The text functions of ``tessella.functions.text`` for one Python string, for use inside Arrow batches.

Tests hold both against each other. Stems are kept for some words met before: a worker that has seen many texts holds no more than one that has seen few.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from tessella.functions import text as T

PLAIN = str.maketrans({"–": "-", "—": "-", "’": "'", "‘": "'", "“": '"', "”": '"', "€": " eur "})
WORD = re.compile(T.WORD)
STOP = frozenset(T.STOP_WORDS)
# An ending, what replaces it, the least length of a word that loses it.
ENDINGS = (("ies", "y", 5), ("sses", "ss", 6), ("ing", "", 6), ("edly", "", 7), ("ed", "", 5), ("es", "", 6), ("s", "", 4))
KEPT = ("ss", "us", "is")


def fold(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).translate(PLAIN).lower()


def words(text: str) -> list[str]:
    return WORD.findall(fold(text))


@lru_cache(32_768)
def stem(word: str) -> str:
    if len(word) <= 3 or word[0] in "0123456789":
        return word
    end, new = next(((e, n) for e, n, least in ENDINGS if len(word) >= least and word.endswith(e)), ("", ""))
    if end == "s" and word.endswith(KEPT):
        return word
    short = word.removesuffix(end) + new
    return short[:-1] if len(short) >= 5 and short.endswith("e") else short


def content_words(text: str) -> list[str]:
    return [w for w in words(text) if w not in STOP]


def terms(text: str) -> list[str]:
    return [stem(w) for w in words(text) if w not in STOP]


def numbers(text: str) -> set[str]:
    """Words with a digit, without the commas between digits."""
    return {re.sub(r"(?<=\d),(?=\d)", "", w) for w in words(text) if any(c.isdigit() for c in w)}


def without_citations(text: str) -> str:
    return re.sub(r"\s+([.,;:!?])", r"\1", re.sub(T.CITATION, "", text)).strip()


def citations(text: str) -> list[str]:
    labels = (f"S{n}" for group in re.findall(T.CITATION, text) for n in re.findall(r"\d+", group))
    return list(dict.fromkeys(labels))


def is_abstention(text: str) -> bool:
    said = fold(text)
    return not said.strip() or any(p in said[:200] for p in T.ABSTENTIONS)
