"""Phrase mining: pairs of frequency-ranked ids counted in tiles, frequent pairs ranked and paired again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, ship
from ledgerloom.llm.ordering import range_sorted, running_total
from ledgerloom.llm.shingles import segments
from ledgerloom.session import stage, staging_scope

MOST_WORDS = 3
LEAST_COUNT = 10
# A phrase goes where a longer one that holds it has at least half of its occurrences.
HELD_PERCENT = 50
PHRASES = 2_000
UNKNOWN = "und"
# Characters of texts whose ids are counted together; ids of a tile's side, as a power of two; cells that one occurrence must
# fill on average for a tile to be counted in full.
RUN_CHARS = 16_000_000
TILE_BITS = 10
CELLS_A_HIT = 8
# Words of a part that are handed over at a time.
WORD_ROWS = 50_000
# Pieces end at these characters: all become line feeds, and a line feed is a token of its own.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d", b"\n" * 9)
_TOKEN = re.compile(rb"[^ \t\n]+|\n")


class _Codes(dict):
    """Codes of words in the order in which they are met; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def encoded(text: str | None, codes: _Codes) -> Iterator[np.ndarray]:
    """Codes of the words of a text and of the ends of its pieces, a part at a time."""
    for part in segments((text or "").encode().lower()):
        tokens = _TOKEN.findall(part.translate(_ENDS))
        yield np.fromiter(map(codes.__getitem__, tokens), dtype=np.int32, count=len(tokens))


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i4").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="<i4")


def _coded_runs(slim: DataFrame) -> DataFrame:
    """For every run of texts of one language, a ``part``: one row with its ``stream`` of codes, one for each ``word``.

    Word rows hold ``code`` and ``n``, the word's occurrences in the part.
    """

    schema = pa.schema(
        [("part", pa.int64()), ("lang", pa.string()), ("stream", pa.binary()), ("word", pa.string()), ("code", pa.int64()), ("n", pa.int64())]
    )

    def rows(part: int, lang: str, codes: _Codes, streams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        stream = np.concatenate(streams)
        yield pa.RecordBatch.from_pylist([{"part": part, "lang": lang, "stream": _packed(stream)}], schema)
        n, words = np.bincount(stream, minlength=len(codes)), list(codes)
        for at in range(1, len(words), WORD_ROWS):
            own = [w.decode() for w in words[at : at + WORD_ROWS]]
            count = len(own)
            columns = [
                pa.array(np.full(count, part)), pa.array([lang] * count, pa.string()), pa.nulls(count, pa.binary()),
                pa.array(own, pa.string()), pa.array(np.arange(at, at + count)), pa.array(n[at : at + count]),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        part, held, chars = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if lang not in held:
                    held[lang] = (_Codes(), [])
                codes, streams = held[lang]
                text = text.as_py()
                streams += encoded(text, codes)
                streams.append(np.zeros(1, dtype=np.int32))
                chars += len(text or "") + 1
                if chars >= RUN_CHARS:
                    for own, (codes, streams) in held.items():
                        yield from rows(part, own, codes, streams)
                        part += 1
                    held, chars = {}, 0
        for own, (codes, streams) in held.items():
            yield from rows(part, own, codes, streams)
            part += 1

    return map_batches(slim, run, "part long, lang string, stream binary, word string, code long, n long")


def counted_pairs(left: np.ndarray, right: np.ndarray, bits: int = TILE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of two lists of ranks with their counts, and the number of each position's pair.

    Pairs fall into square tiles of ranks. A tile with enough occurrences is counted in full by its cells' addresses,
    all others together as a sorted list of coordinates. Low ranks are frequent, so the first tiles are the full ones.
    """
    size = 1 << bits
    side = int(max(left.max(initial=0), right.max(initial=0)) >> bits) + 1
    tile = (left >> bits) * side + (right >> bits)
    # tiles are numbered among those that occur, so that many ranks don't make a long list of empty ones
    tiles, tile = np.unique(tile, return_inverse=True)
    full = np.flatnonzero(np.bincount(tile, minlength=len(tiles)) * CELLS_A_HIT >= size * size)
    number = np.empty(len(left), dtype=np.int64)
    lefts, rights, counts, known = [], [], [], 0
    rest = np.ones(len(left), dtype=bool)
    for t in full:
        inside = np.flatnonzero(tile == t)
        rest[inside] = False
        cells = ((left[inside] & (size - 1)) << bits) | (right[inside] & (size - 1))
        n = np.bincount(cells, minlength=size * size)
        filled = np.flatnonzero(n)
        place = np.zeros(size * size, dtype=np.int64)
        place[filled] = np.arange(known, known + len(filled))
        number[inside] = place[cells]
        lefts.append((int(tiles[t]) // side << bits) + (filled >> bits))
        rights.append((int(tiles[t]) % side << bits) + (filled & (size - 1)))
        counts.append(n[filled])
        known += len(filled)
    rest = np.flatnonzero(rest)
    width = side << bits
    keys, place, n = np.unique(left[rest] * width + right[rest], return_inverse=True, return_counts=True)
    number[rest] = place + known
    lefts.append(keys // width)
    rights.append(keys % width)
    counts.append(n)
    return np.concatenate(lefts), np.concatenate(rights), np.concatenate(counts), number


def _paired(streams: DataFrame, answers: DataFrame, last: bool) -> DataFrame:
    """Adjacent frequent ids of every part: rows of ``code``, ``l``, ``r``, ``n``, and one of the ``stream`` of pair codes.

    ``answers`` (``part``, ``code``, ``id``) names the frequent codes of a part. The last level needs no stream.
    """

    def count(key, frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        names = ["part", "stream", "code", "l", "r", "n"]
        if not len(frame) or not len(known):
            return pd.DataFrame(columns=names)
        stream = _unpacked(frame["stream"].iloc[0])
        # ranks among the ids of this part, in the order of the ids: the most frequent first
        known = known.sort_values("id")
        ids = known["id"].to_numpy()
        rank_of = np.full(max(int(stream.max(initial=0)), int(known["code"].max())) + 1, -1, dtype=np.int64)
        rank_of[known["code"].to_numpy()] = np.arange(len(ids))
        ranks = np.where(stream >= 0, rank_of[np.maximum(stream, 0)], -1)
        at = np.flatnonzero((ranks[:-1] >= 0) & (ranks[1:] >= 0))
        l, r, n, number = counted_pairs(ranks[at], ranks[at + 1])
        out = pd.DataFrame({"part": key[0], "stream": None, "code": None if last else np.arange(len(l)), "l": ids[l], "r": ids[r], "n": n})
        if not last:
            pairs = np.full(len(stream), -1, dtype=np.int32)
            pairs[at] = number
            out = pd.concat([out, pd.DataFrame({"part": [key[0]], "stream": [_packed(pairs)]})], ignore_index=True)
        return out[names].astype({c: "Int64" for c in ("part", "code", "l", "r", "n")})

    ship(streams.sparkSession)
    schema = "part long, stream binary, code long, l long, r long, n long"
    known = answers.withColumnRenamed("part", "of")
    return streams.groupBy("part").cogroup(known.groupBy("of")).applyInPandas(count, schema)


def _ranked(counts: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``counts`` with ``id``: the place of each row by frequency, then by ``order``."""
    by = [F.col("f").desc(), *order]
    numbered = running_total(range_sorted(counts.withColumn("one", F.lit(1).cast("long")), by, name), by, "one", "id")
    return stage(numbered.drop("one"), name)


def _frequent(asked: DataFrame, keys: list[str], least: int, name: str) -> DataFrame:
    """``part``, ``code`` and ``keys`` of what occurs ``least`` times in all, with its occurrences ``f``.

    Parts have counted before, so a key has as many rows as parts hold it; one shuffle brings them together and keeps
    the way back.
    """
    total = F.sum("n").over(Window.partitionBy(*keys))
    return stage(asked.withColumn("f", total).where(F.col("f") >= least).select("part", "code", *keys, "f"), name, codec="zstd")


def _level(ranked: DataFrame, before: DataFrame, words: int) -> DataFrame:
    """Phrases of ``words`` words from the ranked pairs of phrases ``before``."""
    left = before.select(
        F.col("id").alias("l"), "lang", F.col("words").alias("l_words"), F.col("f").alias("l_f"), F.col("heads").alias("l_heads")
    )
    right = before.select(
        F.col("id").alias("r"), F.col("words").alias("r_words"), F.col("f").alias("r_f"), F.col("tails").alias("r_tails")
    )
    last_word = F.slice("r_words", F.lit(words - 1), F.lit(1))
    return ranked.join(left, "l").join(right, "r").select(
        "id", "l", "r", "lang", F.concat("l_words", last_word).alias("words"), "f",
        F.concat("l_heads", F.array("l_f")).alias("heads"), F.concat(F.array("r_f"), "r_tails").alias("tails"),
    )


def phrase_levels(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_words: int = MOST_WORDS, least: int = LEAST_COUNT
) -> tuple[DataFrame, list[DataFrame]]:
    """Words of every language, ``n``, and a table of the phrases of 1, 2, ... words that occur ``least`` times.

    Phrases: ``id``, ``lang``, ``words``, ``f`` (occurrences), ``heads`` and ``tails`` (occurrences of the first part and of the
    rest for each cut, from the first word on), and for two words and more ``l`` and ``r``, the ids of the phrases without the last
    and without the first word. A phrase can only occur so often if these two do, so only those are paired.
    """
    slim = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    none = F.array().cast("array<long>")
    with staging_scope(docs.sparkSession) as scope:
        rows = stage(_coded_runs(slim), "coded", codec="zstd")
        asked = rows.where("stream IS NULL").select("part", "lang", "word", "code", "n")
        sizes = scope.keep(stage(asked.groupBy("lang").agg(F.sum("n").alias("n")), "sizes"))
        seen = _frequent(asked, ["lang", "word"], least, "seen_words")
        level = seen.groupBy("lang", "word").agg(F.max("f").alias("f"))
        level = scope.keep(_ranked(level, [F.col("lang"), F.col("word")], "ranked_words"))
        answers = seen.join(level.select("lang", "word", "id"), ["lang", "word"]).select("part", "code", "id")
        levels = [level.select("id", "lang", F.array("word").alias("words"), "f", none.alias("heads"), none.alias("tails"))]
        for words in range(2, most_words + 1):
            last, read = words == most_words, list(scope.paths)
            streams = rows.where("stream IS NOT NULL").select("part", "stream")
            rows = stage(_paired(streams, answers, last), "paired", codec="zstd")
            # the level before has been read for the last time
            scope.drop(read)
            asked = rows.where("stream IS NULL").select("part", "code", "l", "r", "n")
            if last:
                counts = asked.groupBy("l", "r").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
            else:
                seen = _frequent(asked, ["l", "r"], least, "seen_pairs")
                counts = seen.groupBy("l", "r").agg(F.max("f").alias("f"))
            ranked = _ranked(counts, [F.col("l"), F.col("r")], "ranked_pairs")
            levels.append(scope.keep(stage(_level(ranked, levels[-1], words), "phrases")))
            if not last:
                answers = seen.join(ranked.select("l", "r", "id"), ["l", "r"]).select("part", "code", "id")
    return sizes, levels


def phrases(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    most_words: int = MOST_WORDS,
    least: int = LEAST_COUNT,
    first: int = PHRASES,
) -> DataFrame:
    """The ``first`` phrases of every language by the score of their weakest cut.

    A cut after some words gives ``l`` and ``r``, the occurrences of the first part and of the rest, and the score
    floor(10**6 * a**2 / (l * r)) in exact decimals; the lowest one counts, the earliest of equal ones. Phrases with half of their occurrences
    inside a longer phrase (itself given or not) are left out. Returns ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``
    (words of the language) and ``score``; ties go by ``a`` and the phrase's bytes. Null languages are ``und``, null texts
    are empty, repeated rows count, other columns are not read, an empty table gives no rows.

    Texts are encoded by the distinct words of a run of them; a run asks for the ranks of its words, then of its
    pairs, and Spark brings back those that are frequent. No vocabulary is gathered in one place.
    """
    sizes, levels = phrase_levels(docs, lang_col, text_col, most_words, least)
    found = []
    for k, level in enumerate(levels[1:], 1):
        if k + 1 < len(levels):
            longer = levels[k + 1]
            inside = longer.select(F.col("l").alias("id"), "f").unionByName(longer.select(F.col("r").alias("id"), "f"))
            most = inside.groupBy("id").agg(F.max("f").alias("longest"))
            level = level.join(most, "id", "left").where(
                F.col("longest").isNull() | (100 * F.col("longest") < HELD_PERCENT * F.col("f"))
            )
        found.append(level.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "heads", "tails"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # a and the parts as decimals of 38 digits: products of two counts of up to 16 digits and a million fit
    wide = "CAST({} AS DECIMAL(19,0))"
    a, head, tail = wide.format("a"), wide.format("element_at(heads, k)"), wide.format("element_at(tails, k)")
    score = f"CAST(1000000 AS DECIMAL(7,0)) * ({a} * {a}) div ({head} * {tail})"
    cut = f"struct({score} AS score, k AS k, element_at(heads, k) AS l, element_at(tails, k) AS r)"
    cuts = F.expr(f"array_min(transform(sequence(1, size(heads)), k -> {cut}))")
    scored = every.withColumn("cut", cuts).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    placed = range_sorted(scored.withColumn("one", F.lit(1).cast("long")), order, "scored")
    placed = stage(running_total(placed, order, "one", "place").drop("one"), "placed")
    starts = placed.groupBy("lang").agg((F.min("place") - 1).alias("before"))
    ranked = placed.join(starts, "lang").withColumn("rank", F.col("place") - F.col("before")).where(F.col("rank") <= first)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
