"""SimHash near-duplicates: meet-in-the-middle ball hashing of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_frames, text_slices
from ledgerloom.llm.components import components
from ledgerloom.llm.shingles import SEED, shingle_hashes
from ledgerloom.session import stage

SHINGLE_WORDS = 3
RADIUS = 2


def fingerprint(blocks: Iterable[np.ndarray]) -> int:
    """SimHash of 64-bit hashes, as a signed 64-bit integer; zero for none."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for block in blocks:
        total += len(block)
        for at in range(0, len(block), 65_536):
            raw = block[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(bits.view("<i8")[0])


def text_fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit integer.

    A-Z is lower-cased, repeats count, a text of fewer words is one shingle, none gives zero. A long text is
    hashed a part at a time.
    """
    return fingerprint(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``id_col``, ``fp`` (signed long) per document. Null texts count as empty."""

    def run(batches):
        for part in text_slices(batches, text_col):
            yield pd.DataFrame({id_col: part[id_col], "fp": [text_fingerprint(t) for t in part[text_col]]})

    slim = docs.select(id_col, text_col)
    return map_frames(slim, run, f"{id_col} {slim.schema[id_col].dataType.simpleString()}, fp long")


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``u``, ``v`` that connect all fingerprints within ``radius`` (2) differing bits.

    ``fps`` has one distinct ``fp`` per row. Each fingerprint is dealt to itself and its 64
    one-bit variants. Two fingerprints within two bits meet at a variant one bit from both, and
    whatever meets at a variant is at most two bits apart, so at most 65 distinct fingerprints
    share a variant and linking each to the smallest of them loses no connection. The distance
    is verified all the same.
    """
    if radius != 2:
        raise ValueError("balls of half the radius are built for a radius of 2 bits")
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long") for b in range(64)])
    dealt = fps.select("fp", F.explode(flips).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp"
    )
    met = dealt.groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v").distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def _rooted(classes: DataFrame) -> DataFrame:
    """``classes`` (distinct ``fp``) with the ``root`` of each one's component."""
    roots = components(ball_links(classes.select("fp"))).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and near-duplicate class of every document.

    Returns ``id_col``, ``fingerprint`` (16 lower-case hex digits) and ``component_id`` (smallest
    id reachable over links of at most two differing bits, itself included; null only if every
    id of the class is null). Equal fingerprints are collapsed before any comparison, so
    copies of one text cost one row. Repeated rows stay, an empty table gives no rows, other
    columns of ``docs`` are not read.
    """
    staged = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stage(staged.groupBy("fp").agg(F.min(id_col).alias("first_id")), "classes")
    linked = stage(_rooted(classes), "rooted")
    firsts = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = linked.join(firsts, "root").select("fp", "component_id")
    return staged.join(by_fp, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
