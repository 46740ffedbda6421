"""LM scoring by prediction by partial matching over a byte-context trie.

The trie is a set of Spark tables, one for each context length: edges (context and next symbol) with
their counts and nodes (contexts) with totals. It is learned from all training texts and never
gathered in one place: each run of texts asks for the symbols-in-context it holds, Spark joins these with the
trie, and the code lengths go back to the run that asked.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_frames
from ledgerloom.session import stage

# Longest context in bytes; a symbol and its context are packed into 9 bits each.
ORDER = 5
BITS = 9
END, START = 256, 257
SYMBOLS = 257  # bytes and the end of the text
# Texts of a run are counted and scored together; arrays are built over STEP symbols at a time.
RUN_CHARS = 24_000_000
STEP = 1 << 20
_WORD_ROW, _GRAM_ROW = 0, 1
_END_TOKEN = b" "  # no word holds a space


def _runs(batches):
    """Frames of about RUN_CHARS characters with a number that follows from their content."""
    held, chars = [], 0
    for frame in batches:
        frame = frame.assign(text=frame["text"].fillna(""))
        for _, part in frame.groupby(frame["text"].str.len().cumsum() // RUN_CHARS, sort=False):
            held.append(part)
            chars += int(part["text"].str.len().sum())
            if chars >= RUN_CHARS:
                yield _run(held)
                held, chars = [], 0
    if chars or held:
        yield _run(held)


def _run(held: list[pd.DataFrame]) -> tuple[int, pd.DataFrame]:
    frame = pd.concat(held, ignore_index=True)
    digest = xxhash.xxh3_64()
    for row, text in zip(frame["id"], frame["text"], strict=True):
        digest.update(f"{row}:{len(text)}:".encode())
        digest.update(text.encode())
    return digest.intdigest() >> 1, frame


def lowered(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased."""
    return text.encode().lower()


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _train_words(texts: list[bytes], train: np.ndarray) -> Counter:
    """Training count of every word of the texts, 0 for words of other texts alone."""
    counts, others = Counter(), set()
    for text, used in zip(texts, train, strict=True):
        counts.update(text.split()) if used else others.update(text.split())
    for word in others:
        counts.setdefault(word, 0)
    counts[_END_TOKEN] = int(train.sum())
    return counts


def _gram_steps(texts: list[bytes], order: int):
    """Symbols in context of all texts, about STEP at a time: ``(grams, owner)``, owner being the text.

    A gram packs the symbol into the lowest bits and the bytes before it above, nearest lowest. The first
    symbols of a text have START as context; its last symbol is END.
    """
    pending, size = [], 0

    def flush():
        symbols = np.concatenate([s for _, s, _ in pending])
        owner = np.concatenate([np.full(len(s), i, dtype=np.int64) for i, s, _ in pending])
        counted = np.concatenate([np.arange(len(s)) >= skip for _, s, skip in pending])
        grams = symbols.astype(np.uint64)
        for back in range(1, order + 1):
            grams[back:] |= symbols[:-back].astype(np.uint64) << np.uint64(BITS * back)
        return grams[counted].astype(np.int64), owner[counted]

    start = np.full(order, START, dtype=np.uint16)
    for i, text in enumerate(texts):
        data = np.frombuffer(text, dtype=np.uint8).astype(np.uint16)
        data = np.concatenate((start, data, np.array([END], dtype=np.uint16)))
        for at in range(order, len(data), STEP):
            piece = data[at - order : at + STEP]
            pending.append((i, piece, order))
            size += len(piece)
            if size >= STEP:
                yield flush()
                pending, size = [], 0
    if pending:
        yield flush()


class _Places(dict):
    """Places of words among sorted hashes, found when first asked for."""

    def __init__(self, keys: np.ndarray):
        super().__init__()
        self.keys = array("q", keys.astype(np.int64).tobytes())

    def __missing__(self, word: bytes) -> int:
        key = word_key(word)
        place = bisect_left(self.keys, key)
        if place == len(self.keys) or self.keys[place] != key:
            raise RuntimeError("the texts were cut into other runs than when they were counted")
        self[word] = place
        return place


def _requests(order: int):
    """Rows ``kind``, ``key``, ``run``, ``n``: training count in a run of each word and gram it holds."""

    def run_rows(batches):
        for number, frame in _runs(batches):
            texts = [lowered(t) for t in frame["text"]]
            train = frame["train"].to_numpy(dtype=bool)
            words = _train_words(texts, train)
            keys = np.fromiter(map(word_key, words), dtype=np.int64, count=len(words))
            n = np.fromiter(words.values(), dtype=np.int64, count=len(words))
            yield pd.DataFrame({"kind": _WORD_ROW, "key": keys, "run": number, "n": n})
            del words
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for grams, owner in _gram_steps(texts, order):
                code, distinct = pd.factorize(grams)
                found.append((distinct, np.bincount(code, train[owner], len(distinct)).astype(np.int64)))
                if sum(len(k) for k, _ in found) > 4 * STEP:
                    found = [_summed(found)]
            keys, n = _summed(found)
            yield pd.DataFrame({"kind": _GRAM_ROW, "key": keys, "run": number, "n": n})

    return run_rows


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    code, distinct = pd.factorize(keys)
    return distinct, np.bincount(code, n, len(distinct)).astype(np.int64)


def trie_levels(counted: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """Edges and nodes of each context length 0..order, from the grams' training counts.

    Edges: ``edge`` (context and symbol), ``c``. The longest contexts count occurrences, shorter ones
    (update exclusion) the different longer contexts that the symbol follows. Nodes: ``ctx``, ``t`` (sum of c), ``d`` (symbols seen)
    and ``x``, the counts that those symbols have in the next shorter context: what symbol exclusion takes off there.
    """
    edges = [stage(counted.where("c > 0").select(F.col("key").alias("edge"), "c"), "edges")]
    for k in range(order - 1, -1, -1):
        shorter = F.col("edge").bitwiseAND((1 << (BITS * (k + 1))) - 1)
        edges.insert(0, stage(edges[0].groupBy(shorter.alias("edge")).agg(F.count("*").alias("c")), "edges"))
    levels = []
    for k, own in enumerate(edges):
        ctx = F.shiftright("edge", BITS).alias("ctx")
        if k == 0:
            seen = own.withColumn("less", F.lit(0).cast("long"))
        else:
            parents = edges[k - 1].select(F.col("edge").alias("parent"), F.col("c").alias("less"))
            parent = F.col("edge").bitwiseAND((1 << (BITS * k)) - 1)
            seen = own.withColumn("parent", parent).join(F.broadcast(parents) if k <= 2 else parents, "parent")
        nodes = seen.groupBy(ctx).agg(F.sum("c").alias("t"), F.count("*").alias("d"), F.sum("less").alias("x"))
        levels.append((own, stage(nodes, "nodes")))
    return levels


def code_lengths(keys: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """log10 probability (``lp``) of each gram ``key``.

    From the longest context down: a symbol seen in the context gets (c - 1/2) / t; otherwise the
    coder escapes with (d / 2) / t (escape estimation D), and the symbols of that context are excluded from the next shorter one's
    t and d. Contexts never seen are skipped. Behind the empty context, all symbols that were never seen
    are equally likely. Levels with at most 2**18 rows by construction are broadcast.
    """
    pending = keys.select("key", F.lit(0.0).alias("lp"), F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("d0"))
    done = []
    for k in range(len(levels) - 1, -1, -1):
        edges, nodes = levels[k]
        edges, nodes = (F.broadcast(edges) if k <= 1 else edges), (F.broadcast(nodes) if k <= 2 else nodes)
        edge = F.col("key").bitwiseAND((1 << (BITS * (k + 1))) - 1)
        joined = (
            pending.withColumn("edge", edge)
            .withColumn("ctx", F.shiftright("edge", BITS))
            .join(edges, "edge", "left")
            .join(nodes, "ctx", "left")
        )
        t, d = F.col("t") - F.col("x0"), F.col("d") - F.col("d0")
        step = stage(
            joined.select(
                "key",
                (
                    F.col("lp")
                    + F.when(F.col("c").isNotNull(), F.log10((F.col("c") - 0.5) / t))
                    .when(d > 0, F.log10(d / 2 / t))
                    .otherwise(0.0)
                ).alias("lp"),
                F.coalesce("x", F.lit(0)).alias("x0"),
                F.coalesce("d", F.lit(0)).alias("d0"),
                F.col("c").isNotNull().alias("found"),
            ),
            "step",
        )
        done.append(step.where("found").select("key", "lp"))
        pending = step.where("NOT found").drop("found")
    unseen = F.greatest(F.lit(SYMBOLS) - F.col("d0"), F.lit(1))
    out = pending.select("key", (F.col("lp") - F.log10(unseen)).alias("lp"))
    for part in done:
        out = out.unionByName(part)
    return out


def score_texts(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER
) -> DataFrame:
    """Code length of every whole text under a model learned from the rows where ``train`` holds.

    Returns per row ``id_col``, ``train``, ``n_tokens`` (words and one end), ``n_known`` (tokens that training
    texts hold), ``train_tokens``, ``base_score`` (add-one unigram log10 probability of the tokens)
    and ``score`` (log10 probability of the lower-cased bytes and the end by partial matching).
    Null texts are empty; where ``train`` is null the row is not learned from. Repeated rows
    count and are scored one by one. Without training texts all symbols are equally likely.
    """
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    kind = slim.schema["id"].dataType.simpleString()
    asked = map_frames(slim, _requests(order), "kind int, key long, run long, n long")
    by_key = Window.partitionBy("kind", "key")
    counts = stage(
        asked.withColumns(
            {
                "c": F.sum("n").over(by_key),
                "head": F.row_number().over(by_key.orderBy("run")) == 1,
            }
        ).select("kind", "key", "run", "n", "c", "head"),
        "counts",
    )
    words = counts.where(F.col("kind") == _WORD_ROW)
    n_train, n_distinct = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("head") & (F.col("c") > 0)).cast("long")), F.lit(0))
    ).first()
    grams = counts.where(F.col("kind") == _GRAM_ROW)
    heads = grams.where("head").select("key", "c")
    lengths = code_lengths(heads.select("key"), trie_levels(heads, order))
    answers = (
        words.select("run", "kind", "key", F.col("c").cast("double").alias("value"))
        .unionByName(grams.select("run", "kind", "key").join(lengths.withColumnRenamed("lp", "value"), "key"))
    )

    def packed(batches):
        coder = zstandard.ZstdCompressor(level=3)
        for number, frame in _runs(batches):
            yield pd.DataFrame(
                {
                    "run": number,
                    "id": frame["id"],
                    "train": frame["train"],
                    "packed": [coder.compress(lowered(t)) for t in frame["text"]],
                }
            )

    texts = map_frames(slim, packed, f"run long, id {kind}, train boolean, packed binary")

    def score(key, frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(known) and len(frame):
            raise RuntimeError("the texts were cut into other runs than when they were counted")
        coder = zstandard.ZstdDecompressor()
        data = [coder.decompress(p) for p in frame["packed"]]
        is_word = (known["kind"] == _WORD_ROW).to_numpy()
        words, grams = known[is_word].sort_values("key"), known[~is_word]
        counts, places = words["value"].to_numpy(copy=True), _Places(words["key"].to_numpy())
        lp, index = grams["value"].to_numpy(copy=True), pd.Index(grams["key"].to_numpy(copy=True))
        del known, words, grams, is_word
        base_of = np.log10((counts + 1) / (n_train + n_distinct + 1))
        n_tokens, n_known, base = [], [], []
        for text in data:
            own = text.split()
            own.append(_END_TOKEN)
            at = np.fromiter(map(places.__getitem__, own), dtype=np.int64, count=len(own))
            n_tokens.append(len(own))
            n_known.append(int(np.count_nonzero(counts[at])))
            base.append(float(base_of[at].sum()))
        del places, counts, base_of
        scores = np.zeros(len(data))
        for found, owner in _gram_steps(data, order):
            scores += np.bincount(owner, lp[index.get_indexer(found)], len(data))
        return pd.DataFrame(
            {
                "id": frame["id"],
                "train": frame["train"],
                "n_tokens": n_tokens,
                "n_known": n_known,
                "train_tokens": n_train,
                "base_score": base,
                "score": scores,
            }
        )

    schema = f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = texts.groupBy("run").cogroup(answers.groupBy("run")).applyInPandas(score, schema)
    return scored.withColumnRenamed("id", id_col)
