"""Statistics of whole texts for the quality operators."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ledgerloom.llm.common import WORD_PATTERN, map_frames, text_slices

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word_chars", "long_word_share", "short_word_share", "distinct_word_share",
    "top_word_share", "top_pair_share", "repeat_word_share", "symbol_share", "upper_share",
    "digit_share", "punct_share", "space_share", "non_ascii_share", "bang_share", "dup_line_share",
    "words_per_line", "words_per_stop", "byte_entropy", "packed_share", "title_word_share",
)
_WORD = re.compile(WORD_PATTERN)
_DROP_SYMBOLS = str.maketrans("", "", SYMBOLS)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window which occurs at least twice in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hit = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def base_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """The counts named in BASE; a null text has no words."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        len(text) - len(text.translate(_DROP_SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def features(text: str | None) -> list[float]:
    """The shares named in FEATURES; an empty or null text gives zeros."""
    text = text or ""
    n_words, word_chars, n_symbols, n_dup, n_repeat = base_stats(text)
    if not n_words:
        return [0.0] * len(FEATURES)
    words = _WORD.findall(text)
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    some = counts[counts > 0] / len(raw)
    by_word = Counter(words)
    by_pair = Counter(zip(words, words[1:], strict=False))
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n_words)
    n_lines = max(1, text.count("\n") + 1)
    stops = counts[ord(".")] + counts[ord("!")] + counts[ord("?")]
    return [
        float(np.log1p(n_words)),
        word_chars / n_words,
        float((lens > 12).mean()),
        float((lens <= 3).mean()),
        len(by_word) / n_words,
        max(by_word.values()) / n_words,
        max(by_pair.values(), default=0) / n_words,
        n_repeat / n_words,
        n_symbols / word_chars,
        counts[65:91].sum() / len(raw),
        counts[48:58].sum() / len(raw),
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / len(raw),
        (counts[32] + counts[9:14].sum()) / len(raw),
        counts[128:].sum() / len(raw),
        counts[ord("!")] / n_words,
        n_dup / n_lines,
        n_words / n_lines,
        n_words / (stops + 1),
        float(-(some * np.log2(some)).sum()),
        len(zlib.compress(raw, 1)) / len(raw),
        sum(map(str.istitle, words)) / n_words,
    ]


def with_base_stats(docs: DataFrame, extra: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the columns named in ``extra`` and the BASE counts (long) of every row."""
    slim = docs.select(id_col, *extra, text_col)

    def run(batches):
        for part in text_slices(batches, text_col):
            out = part[[id_col, *extra]].copy()
            out[list(BASE)] = pd.DataFrame([base_stats(t) for t in part[text_col]], columns=BASE, index=part.index)
            yield out

    kinds = [f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in (id_col, *extra)]
    return map_frames(slim, run, ", ".join([*kinds, *[f"{c} long" for c in BASE]]))


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``features``, an array of FEATURES, of every row."""
    slim = docs.select(id_col, text_col)

    def run(batches):
        for part in text_slices(batches, text_col):
            yield pd.DataFrame({id_col: part[id_col], "features": [features(t) for t in part[text_col]]})

    return map_frames(slim, run, f"{id_col} {slim.schema[id_col].dataType.simpleString()}, features array<float>")
