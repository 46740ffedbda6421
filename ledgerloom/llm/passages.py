"""Byte-string helpers of the repeated-passage operator: hashes, samples and windows."""

from __future__ import annotations

import hashlib

import numpy as np

# Bytes handled at a time, so that long texts need bounded memory.
CHUNK = 1 << 20
_U = np.uint64
_mix = np.random.default_rng(20_240_607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < size:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [
            np.multiply.accumulate(np.concatenate(([_U(1)], np.full(size - 1, b, dtype=np.uint64))))
            for b in (_BASE, inverse)
        ]
    return _powers[0], _powers[1]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Prefix:
    """Hashes of any substring of ``data`` in constant time; equal strings have equal hashes."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _power_table(max(len(data) + 1, 4_096))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_mix[data] * powers[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        return scramble((self.sums[end] - self.sums[start]) * self.inverse[start] + size * _U(0xD1B54A32D192ED03))


def seed_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` (a power of two) bytes from each position, built by doubling."""
    found, width, factor = _mix[data], 1, _BASE
    while width < size:
        found = found[:-width] * _U(factor) + found[width:]
        found ^= found >> _U(29)
        width, factor = 2 * width, factor * factor % (1 << 64)
    return scramble(found)


def first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value of every run of ``width`` values, the first of equal ones."""
    index = np.arange(len(values), dtype=np.int32)
    reach = 1

    def merge(values, index, shift):
        right = values[shift:] < values[:-shift]
        return np.where(right, values[shift:], values[:-shift]), np.where(right, index[shift:], index[:-shift])

    while 2 * reach <= width:
        values, index = merge(values, index, reach)
        reach *= 2
    if reach < width:
        values, index = merge(values, index, width - reach)
    return index


def samples(data: np.ndarray, window: int, seed: int):
    """Sampled positions of a text and the windows each stands for.

    Every window of ``window`` bytes is represented by the position in it at which the hash of
    ``seed`` bytes is smallest, so equal windows have their sample at the same place. Returns arrays ``at``,
    ``low``, ``high`` (first and last window start represented) and ``seed`` (hash at the sample).
    """
    n_windows = len(data) - window + 1
    at, low, high, value = [], [], [], []
    for start in range(0, max(0, n_windows), CHUNK):
        stop = min(start + CHUNK, n_windows)
        hashes = seed_hashes(data[start : stop + window - 1], seed)
        best = first_minimum(hashes, window - seed + 1)
        change = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        at.append(best[change].astype(np.int64) + start)
        low.append(change + start)
        high.append(np.append(change[1:], len(best)) - 1 + start)
        value.append(hashes[best[change]])
    if not at:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    at, low, high, value = map(np.concatenate, (at, low, high, value))
    new = np.concatenate(([True], at[1:] != at[:-1]))  # a sample may go on in the next chunk
    last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
    return at[new], low[new], high[last], value[new]


class SpanHasher:
    """``span_hashes`` of one text, with its prefix sums computed once if the text is short."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.prefix = Prefix(data) if len(data) <= CHUNK else None

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.prefix.hashes(start, end) if self.prefix else span_hashes(self.data, start, end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every span ``start..end``; starts are ascending and spans far shorter than a chunk."""
    out = np.zeros(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(start, start[i] + CHUNK, side="left"))
        base, top = int(start[i]), int(end[i:j].max())
        out[i:j] = Prefix(data[base:top]).hashes(start[i:j] - base, end[i:j] - base)
        i = j
    return out


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans; touching spans are one run."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def cut_spans(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    """The bytes outside of the spans (disjoint, ascending)."""
    edges = [0, *[x for pair in zip(start.tolist(), end.tolist(), strict=True) for x in pair], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
