"""Clients for ``structured.with_client`` that need no service: they answer from the text alone."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable

_WORD, _LOWERED = re.compile(rb"[a-z]+"), bytes(range(256)).lower()


def words(text: str | None) -> list[bytes]:
    """Runs of the letters a to z, A-Z lower-cased."""
    return _WORD.findall((text or "").encode("utf-8", "replace").translate(_LOWERED))


def hashed_words(size: int) -> Callable[[], Callable[[list[str | None]], list[list[float]]]]:
    """Makes a client that embeds texts as counts of words, each counted where the MD5 of it falls among ``size`` places.

    A batch's words are hashed once each, however often they occur. A null
    or wordless text has zeros.
    """

    def make() -> Callable[[list[str | None]], list[list[float]]]:
        def embed(texts: list[str | None]) -> list[list[float]]:
            counted = [Counter(words(t)) for t in texts]
            place = {w: int.from_bytes(hashlib.md5(w, usedforsecurity=False).digest()[8:], "little") % size for w in set().union(*counted)}
            out = [[0.0] * size for _ in texts]
            for row, counts in zip(out, counted, strict=True):
                for w, n in counts.items():
                    row[place[w]] += n
            return out

        return embed

    return make


def longest_word() -> Callable[[list[str | None]], list[str]]:
    """A client that completes a prompt with its longest word, the first by alphabet of equals; nothing where it has none."""
    return lambda prompts: [min(set(words(p)), key=lambda w: (-len(w), w), default=b"").decode() for p in prompts]
