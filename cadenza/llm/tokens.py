"""Shared helpers of the token operators: where vocabularies are, and word memos of bounded size."""

from __future__ import annotations

import functools
import gc
import itertools
import os
from collections.abc import Callable, Iterable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of a worker's word memo; a full memo loses its older half, so results never depend on it.
MEMO_ENTRIES = 400_000


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordMemo(dict):
    """Remembers what ``encode`` gave for each distinct word of earlier batches."""

    def __init__(self, encode: Callable[[list], list], entries: int = MEMO_ENTRIES):
        super().__init__()
        self.encode = encode
        self.entries = entries

    def learn(self, words: Iterable) -> None:
        words = set(words)
        new = words.difference(self)
        if len(self) + len(new) > self.entries:
            for word in list(itertools.islice(self, (len(self) + 1) // 2)):
                del self[word]
            if len(self) + len(new) > self.entries:
                self.clear()
            new = words.difference(self)
        if new:
            new = list(new)
            self.update(zip(new, self.encode(new), strict=True))


def in_chunks(items: list, weight: Callable, most: int = 4_000_000):
    """Consecutive parts of ``items`` whose weights sum to about ``most``; a larger item stands alone."""
    part, total = [], 0
    for x in items:
        if part and total + weight(x) > most:
            yield part
            part, total = [], 0
        part.append(x)
        total += weight(x)
    if part:
        yield part


#: What workers hold from task to task, by the function that made it.
_HELD: list = []


def held(make: Callable) -> Callable:
    """``make``, whose results a worker keeps for its next tasks, until ``release``."""
    kept = functools.cache(make)
    _HELD.append(kept)
    return kept


def release() -> None:
    """Gives back what this worker holds for other operators, before one that needs the memory itself."""
    for kept in _HELD:
        kept.cache_clear()
    gc.collect()
