"""Hashes of the word shingles of a text, a bounded part of the text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

SEED = 42
# Bytes of a text whose words are held at a time.
SEGMENT_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def segments(data: bytes, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """Parts of about ``size`` bytes, cut at white space; a longer word is not cut."""
    at = 0
    while len(data) - at > size and (space := _SPACE.search(data, at + size)):
        yield data[at : space.start()]
        at = space.end()
    yield data[at:]


def _hashed(tokens: list[bytes], words: int, seed: int) -> np.ndarray:
    joined = b" ".join(tokens)
    last = np.cumsum([len(t) + 1 for t in tokens]) - 1
    first = np.concatenate(([0], last[:-1] + 1))
    first, last = first[: len(tokens) - words + 1].tolist(), last[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)], dtype=np.uint64)


def shingle_hashes(text: str | None, words: int, seed: int = SEED, size: int = SEGMENT_BYTES) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of ``words`` space-joined words, repeats included, in blocks.

    A-Z is lower-cased; a text of fewer words is one shingle, one without words has none.
    """
    held, short = [], True
    for part in segments((text or "").encode().lower(), size):
        held += part.split()
        if len(held) >= words:
            yield _hashed(held, words, seed)
            held, short = held[len(held) - words + 1 :], False
    if short and held:
        yield _hashed(held, len(held), seed)
