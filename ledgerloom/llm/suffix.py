"""Repeated passages by distributed prefix doubling over sampled text positions.

Two positions have equal rank at length k if the k bytes at them are equal. Ranking every
position of a corpus at k = 1, 2, 4... would sort all of them several times; here the first rank
is taken at positions sampled by content, so that equal windows have their sample at the same place,
and a rank is the hash of the string it stands for. Spark sorts pairs of ranks
(of the known string and of the longer one), positions whose rank is unique leave, those whose
longer string occurs earlier are settled as repeats, and the rest goes on to the next length:

1. seed: 32 bytes at a sample, paired with the hull, all bytes of the windows the sample stands for.
2. core: bytes common to a third of those windows, paired with the hull of that third.
3. the single windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import passages as P
from ledgerloom.llm.common import map_batches, map_frames, text_slices
from ledgerloom.llm.ordering import range_sorted, running_total
from ledgerloom.session import stage

WINDOW = 100
SEED = 32
THIRDS = 3
# Characters whose samples are combined before they are shuffled.
COMBINED_CHARS = 16_000_000
_OPEN, _SENT, _REPEAT, _SPLIT = range(4)  # states of a sample, see _sample_frames


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``ord`` (place in the order of ids), ``id``, ``text`` and all columns as struct ``rest``.

    Unique non-negative integers are their own place.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        F.struct([c for c in docs.columns if c != text_col]).alias("rest"),
    )
    if isinstance(base.schema["id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        twice = base.groupBy("id").agg(F.count("*").alias("n")).where("id IS NULL OR id < 0 OR n > 1")
        if twice.isEmpty():
            return base.select(F.col("id").cast("long").alias("ord"), "id", "text", "rest")
    rows = stage(base.withColumn("row", F.monotonically_increasing_id()), "texts")
    order = [F.col("id").asc_nulls_last(), F.col("row")]
    slim = range_sorted(rows.select("id", "row", F.lit(1).alias("one")), order, "order")
    places = running_total(slim, order, "one", "ord").select("row", F.col("ord").cast("long").alias("ord"))
    return rows.join(stage(places, "places"), "row").select("ord", "id", "text", "rest")


def _pack(at, low, high, state):
    return (at << 16) | ((at - low) << 9) | ((at - high) << 2) | state


def _sample_frames(batches, window: int, seed: int):
    """Samples of whole texts with their first two ranks, combined within a run of texts.

    Of equal (seed, hull) only the first sample stays open, the others are repeats. If a seed has
    several hulls here, its samples must be split anyway: they are put out as such, and just
    two of them are sent to show the other runs that the seed has several hulls. So
    a seed has at most two open rows per run, however often it occurs.
    """
    for part in text_slices(batches, most=COMBINED_CHARS):
        found = []
        for order, text in zip(part["ord"], part["text"], strict=True):
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            if len(data) >= window:
                at, low, high, value = P.samples(data, window, seed)
                shape = P.scramble((((at - low) << 8) + (at - high)).astype(np.uint64))
                hull = P.span_hashes(data, low, high + window) ^ shape
                found.append((value, hull, np.full(len(at), order, dtype=np.int64), at, low, high))
        if not found:
            continue
        value, hull, order, at, low, high = map(np.concatenate, zip(*found, strict=True))
        sort = np.lexsort((at, order, hull, value))
        value, hull, order, at, low, high = (x[sort] for x in (value, hull, order, at, low, high))
        new_value = np.concatenate(([True], value[1:] != value[:-1]))
        first = new_value | np.concatenate(([True], hull[1:] != hull[:-1]))
        group = np.cumsum(new_value) - 1
        several = np.bincount(group, first)[group] > 1
        state = np.where(first, np.where(several, _SPLIT, _OPEN), _REPEAT)
        place = np.flatnonzero(first & several)
        edge = np.concatenate(([True], group[place][1:] != group[place][:-1])) if len(place) else place
        shown = place[edge | np.append(edge[1:], True)] if len(place) else place
        key = np.where(state >= _REPEAT, P.scramble((order * 1_000_003 + at).astype(np.uint64)), value)
        frames = [
            pd.DataFrame({"key": key, "seed": value, "hull": hull, "ord": order, "at": _pack(at, low, high, state)}),
            pd.DataFrame(
                {
                    "key": value[shown],
                    "seed": value[shown],
                    "hull": hull[shown],
                    "ord": order[shown],
                    "at": _pack(at[shown], low[shown], high[shown], _SENT),
                }
            ),
        ]
        out = pd.concat(frames)
        # settled rows need no seed beside their key unless they are split later
        yield out.astype({"key": np.int64, "seed": np.int64, "hull": np.int64})


def _ranked_samples(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """Samples that are repeats (``split`` false) or have to be split further: ``ord``, ``at``, ``seed``."""

    def run(batches):
        for frame in _sample_frames(batches, window, seed):
            settled = (frame["at"] & 3) >= _REPEAT
            # the column that orders hulls holds the seed for settled rows, which are alone with their key
            yield pd.DataFrame(
                {
                    "key": frame["key"],
                    "rank": np.where(settled, frame["seed"], frame["hull"]),
                    "ord": frame["ord"],
                    "at": frame["at"],
                }
            )

    rows = map_frames(texts.select("ord", "text"), run, "key long, rank long, ord long, at long")
    state = F.col("at").bitwiseAND(3)
    rows = rows.withColumn("settled", state >= _REPEAT)
    by_rank = Window.partitionBy("key", "settled").orderBy("rank", "ord", "at")
    whole = by_rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "again": F.coalesce(F.lag("rank").over(by_rank) == F.col("rank"), F.lit(False)),
            "several": F.first("rank").over(whole) != F.last("rank").over(whole),
        }
    )
    repeat = F.when(F.col("settled"), state == _REPEAT).otherwise(F.col("again"))
    split = F.when(F.col("settled"), state == _SPLIT).otherwise(~F.col("again") & F.col("several") & (state == _OPEN))
    return rows.select(
        "ord", "at", F.when(F.col("settled"), F.col("rank")).otherwise(F.col("key")).alias("seed"),
        repeat.alias("repeat"), split.alias("split"),
    ).where("repeat OR split").select("ord", "at", "seed", "split")


def _packed_texts(texts: DataFrame) -> DataFrame:
    """``ord`` and the text's UTF-8 bytes, compressed for the shuffle."""

    def run(batches):
        coder = zstandard.ZstdCompressor(level=3)
        for part in text_slices(batches):
            yield pd.DataFrame({"ord": part["ord"], "packed": [coder.compress(t.encode()) for t in part["text"]]})

    return map_frames(texts.select("ord", "text"), run, "ord long, packed binary")


def _thirds(texts: DataFrame, split: DataFrame, window: int, seed: int) -> DataFrame:
    """A row for each third of the windows of the samples to split, with the hashes of all its windows.

    Every window of a third holds its core, so the core never reaches over an end of the text.
    """
    step = -(-(window - seed + 1) // THIRDS)
    by_doc = split.groupBy("ord").agg(F.collect_list(F.struct("at", "seed")).alias("samples"))
    joined = _packed_texts(texts).join(by_doc, "ord").select("ord", "packed", "samples")

    def one_text(order, data, code, seeds):
        sort = np.argsort(code, kind="stable")
        code, seeds = code[sort], seeds[sort]
        at = code >> 16
        low, high = at - (code >> 9 & 127), at - (code >> 2 & 127)
        hashes = P.SpanHasher(data)
        for k in range(THIRDS):
            near, far = k * step, min(window - seed, (k + 1) * step - 1)
            first, last = np.maximum(low, at - far), np.minimum(high, at - near)
            some = first <= last
            if not some.any():
                continue
            a, x, y, s = at[some], first[some], last[some], seeds[some].astype(np.uint64)
            core = hashes(a - near, a - far + window) ^ P.scramble(s + np.uint64(k))
            hull = hashes(x, y + window) ^ P.scramble((((a - x) << 8) + (a - y)).astype(np.uint64))
            count = y - x + 1
            starts = np.repeat(x - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            yield core, hull, np.full(len(x), order), x, count, hashes(starts, starts + window)

    def run(batches):
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            own = batch.column("samples")
            edges = own.offsets.to_numpy().tolist()
            code, seeds = (own.values.field(c).to_numpy() for c in ("at", "seed"))
            found = []
            for i, (order, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ord", "packed")), strict=True)):
                data = np.frombuffer(coder.decompress(packed), dtype=np.uint8)
                found += one_text(order, data, code[edges[i] : edges[i + 1]], seeds[edges[i] : edges[i + 1]])
            if found:
                core, hull, order, low, count, each = map(np.concatenate, zip(*found, strict=True))
                ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(each.astype(np.int64)))
                flat = [pa.array(x.astype(np.int64)) for x in (core, hull, order, low)]
                yield pa.RecordBatch.from_arrays([*flat, lists], ["core", "hull", "ord", "low", "windows"])

    return map_batches(joined, run, "core long, hull long, ord long, low long, windows array<long>")


def _repeated_windows(thirds: DataFrame, window: int) -> DataFrame:
    """Spans ``ord``, ``start``, ``end`` of windows that occur earlier."""
    by_hull = Window.partitionBy("core").orderBy("hull", "ord", "low")
    whole = by_hull.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = thirds.withColumns(
        {
            "again": F.coalesce(F.lag("hull").over(by_hull) == F.col("hull"), F.lit(False)),
            "several": F.first("hull").over(whole) != F.last("hull").over(whole),
        }
    ).where("again OR several")
    # equal windows have equal cores, so the single windows need no further shuffle
    single = ranked.select(
        "core", "ord", "low", "again", F.size("windows").alias("n"),
        F.posexplode(F.when(F.col("again"), F.array(F.lit(0).cast("long"))).otherwise(F.col("windows"))).alias("nth", "rank"),
    )
    start = F.col("low") + F.col("nth")
    by_rank = Window.partitionBy("core", "again", "rank").orderBy("ord", "low", "nth")
    earlier = F.row_number().over(by_rank) > 1
    return (
        single.withColumn("repeat", F.col("again") | earlier)
        .where("repeat")
        .select("ord", start.alias("start"), (start + window + F.when(F.col("again"), F.col("n") - 1).otherwise(0)).alias("end"))
    )


def _cut(texts: DataFrame, window: int, seed: int, carry: str) -> DataFrame:
    """Column ``carry`` of numbered texts with ``n_bytes``, ``spans`` and ``kept``."""
    if seed & (seed - 1) or not 0 <= window - seed <= 127:
        raise ValueError("seed must be a power of two, at most 127 below window")
    marks = stage(_ranked_samples(texts, window, seed), "marks")
    single = _repeated_windows(_thirds(texts, marks.where("split"), window, seed), window)
    at = F.shiftright("at", 16)
    whole = marks.where("NOT split").select(
        "ord",
        (at - F.shiftright("at", 9).bitwiseAND(127)).alias("start"),
        (at - F.shiftright("at", 2).bitwiseAND(127) + window).alias("end"),
    )
    spans = whole.unionByName(single).groupBy("ord").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")
    )

    def cut(batches):
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, runs, kept = [], [], []
            for packed, own in zip(*(batch.column(c).to_pylist() for c in ("packed", "spans")), strict=True):
                raw = coder.decompress(packed)
                pairs = np.array([(x["start"], x["end"]) for x in own or ()], dtype=np.int64)
                start, end = P.merge_spans(*pairs.reshape(-1, 2).T)
                sizes.append(len(raw))
                runs.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                kept.append(P.cut_spans(raw, start, end))
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(carry), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(span)), pa.array(kept, pa.binary())],
                [carry, "n_bytes", "spans", "kept"],
            )

    # everything is joined before the texts are unpacked, so they are shuffled once here
    joined = _packed_texts(texts).join(spans, "ord", "left").join(texts.select("ord", carry), "ord")
    field = texts.schema[carry]
    schema = T.StructType([field]).add("n_bytes", "long").add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "binary")
    return map_batches(joined.select(carry, "packed", "spans"), cut, schema)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    seed: int = SEED,
) -> DataFrame:
    """Texts without the bytes covered by a ``window``-byte string that also starts earlier.

    Earlier is a smaller id, or an earlier start in the same text; strings are judged on the
    input and may overlap. Returns per row ``id_col``, ``n_bytes``, ``spans`` (maximal removed
    runs, array of start and end) and ``kept`` (the other bytes; cut anywhere, so maybe within
    a character). Null texts are empty. Rows that repeat an id are texts in the order of their
    reading, rows without an id come last. ``seed`` is a power of two below ``window`` (at most
    127 less). Memory of a task follows its longest text.
    """
    texts = _numbered(docs, id_col, text_col)
    return _cut(texts, window, seed, "id").withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with repeated passages cut out of the text; a column ``n_chars`` follows it.

    A character that a cut leaves incomplete goes too. Texts that are repeats throughout stay
    as empty texts, as do null ones. No row goes: rows that repeat an id are texts in the order of their reading,
    null ids come last. Other columns stay as they are, whatever their names; an empty table stays empty.
    """
    texts = _numbered(docs, id_col, text_col)
    cut = _cut(texts, WINDOW, SEED, "rest").select("rest", "kept")

    def decode(batches):
        for batch in batches:
            text = pa.array([k.decode(errors="ignore") for k in batch.column("kept").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("rest"), text], ["rest", "text"])

    joined = map_batches(cut, decode, T.StructType([texts.schema["rest"]]).add("text", "string"))
    columns = {c: F.col("text") if c == text_col else F.col("rest")[c] for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return joined.select(*[value.alias(name) for name, value in columns.items()])
