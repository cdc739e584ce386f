"""The words of whole texts by frequency, counted in one Arrow stage: no word is shuffled."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlens.functions import text as T

_STOP = frozenset(T.STOP_WORDS)
_BREAK = re.compile(T.WORD_BREAKS)
_WORD = re.compile(f"[^{T.WORD_BREAKS[1:-2]}]{{{T.MIN_KEYWORD_LENGTH},}}")
SLICE = 1_000_000


def _invariant(word: str) -> str:
    """Lower case but for the dotted capital İ, which stays."""
    return "İ".join(part.lower() for part in word.split("İ"))


def counted(text: str, size: int = SLICE) -> Counter[str]:
    """How often each word of at least four characters stands in ``text``, in the order of their first places.

    A long text is taken in slices that end where a word does, so that only its different words are held.
    """
    words, start = Counter(), 0
    while start < len(text):
        end = _BREAK.search(text, start + size)
        stop = end.start() if end else len(text)
        words.update(_WORD.findall(text, start, stop))
        start = max(stop, start + 1)
    return words


def ranked(text: str, spelled: Callable[[str], str] = str, most: int | None = None, size: int = SLICE) -> list[str]:
    """The words of letters that are no stop words, most frequent first, then by spelling.

    Case is ignored in counting; a word stands as ``spelled`` from its first place.
    """
    groups: dict[str, list] = {}
    for word, n in counted(text, size).items():
        if word.isalpha():
            own = spelled(word)
            key = own.lower()
            if key in groups:
                groups[key][0] -= n
            elif len(own) >= T.MIN_KEYWORD_LENGTH and own not in _STOP and key not in _STOP:
                groups[key] = [-n, own]
    return [w for _, w in sorted(groups.values())[:most]]


def keywords(text: Column, most: int) -> Column:
    """The ``most`` frequent words in lower case."""

    @F.arrow_udf("array<string>")
    def top(texts: pa.Array) -> pa.Array:
        return pa.array([ranked(t.as_py() or "", _invariant, most) for t in texts], pa.list_(pa.string()))

    return top(text)


def by_frequency(text: Column) -> Column:
    """All words in their own spelling."""

    @F.arrow_udf("array<string>")
    def every(texts: pa.Array) -> pa.Array:
        return pa.array([ranked(t.as_py() or "") for t in texts], pa.list_(pa.string()))

    return every(text)
