"""Near copies by five-word shingles: SimHash balls, completed by an exact prefix join."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, with_row
from ledgerloom.llm.components import components
from ledgerloom.llm.shingles import SEED, shingle_hashes
from ledgerloom.llm.simhash import ball_links, fingerprint
from ledgerloom.session import stage, staging_scope

SHINGLE_WORDS = 5
# Texts are near copies from a Jaccard similarity of 4/5 on; compared in integers.
SIMILARITY = (4, 5)
# Texts without a band in common with another are left out: 0.007 % of the pairs at a similarity of 0.8, less above.
BANDS, BAND_ROWS = 24, 5
# Shingles that are min-hashed at a time.
STEP = 1_024
# Bits, as a power of two, of the parity map of a set: two sets differ in at least as many shingles as their maps in bits.
MAP_BITS = 10
# Rounds of comparisons with up to PIVOTS nodes each, before all pairs that are still apart are compared;
# that comes at once where it takes no more than FEW pairs a row.
PIVOT_ROUNDS, PIVOTS, FEW = 3, 4, 4

_rng = np.random.default_rng(SEED)
_MASKS = _rng.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64)
_FACTORS = _rng.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    return _distinct(list(shingle_hashes(text, words)))


def _distinct(blocks: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, dtype=np.uint64)


def band_keys(shingles: np.ndarray) -> list[int]:
    """One signed 64-bit key a band of min-hashes; none for no shingles."""
    if not len(shingles):
        return []
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), STEP):
        hashed = (shingles[at : at + STEP, None] ^ _MASKS) * _FACTORS
        np.minimum(low, hashed.min(axis=0), out=low)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(low.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _signatures(own: DataFrame) -> DataFrame:
    """``row``, ``id``, ``ident`` (hash of the set of shingles), ``fp`` (SimHash) and ``bands`` of every text."""

    def run(batches):
        for batch in batches:
            idents, fps, bands = [], [], []
            for text in batch.column("text"):
                blocks = list(shingle_hashes(text.as_py(), SHINGLE_WORDS))
                shingles = _distinct(blocks)
                fps.append(fingerprint(blocks))
                idents.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                bands.append(band_keys(shingles))
            made = [pa.array(idents, pa.binary()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), *made], names=["row", "id", "ident", "fp", "bands"]
            )

    kind = own.schema["id"].dataType.simpleString()
    return map_batches(own, run, f"row long, id {kind}, ident binary, fp long, bands array<long>")


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """Longs of 2**MAP_BITS bits; a bit says whether an odd number of shingles fell on it."""
    odd = np.bincount((shingles >> np.uint64(64 - MAP_BITS)).astype(np.int64), minlength=1 << MAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sets(own: DataFrame) -> DataFrame:
    """``node``, ``size``, ``shingles`` and their parity ``map`` of every text."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(text.as_py()) for text in batch.column("text")]
            sizes = pa.array([len(x) for x in found], pa.int64())
            lists, maps = (
                pa.array(x, pa.list_(pa.int64())) for x in ([f.view(np.int64) for f in found], list(map(parity_map, found)))
            )
            columns = [batch.column("row"), sizes, lists, maps]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "shingles", "map"])

    return map_batches(own.select("row", "text"), run, "node long, size long, shingles array<long>, map array<long>")


def _met(classes: DataFrame, balls: DataFrame) -> DataFrame:
    """Nodes that share a band or a SimHash ball with another node."""
    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    in_band = keys.join(shared, "key", "left_semi").select("node")
    return in_band.unionByName(balls.select(F.explode(F.array("u", "v")).alias("node"))).distinct()


def _simhash_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of nodes ``u`` > ``v`` whose fingerprints meet in a ball, or are equal, linked to the smallest.

    Equal fingerprints of different texts are linked to the smallest node among them.
    """
    firsts = classes.groupBy("fp").agg(F.min("node").alias("low"))
    same = classes.join(firsts, "fp").select(F.col("node").alias("a"), F.col("low").alias("b"))
    links = ball_links(firsts.select("fp"))
    ends = links.join(firsts.select(F.col("fp").alias("u"), F.col("low").alias("a")), "u")
    ends = ends.join(firsts.select(F.col("fp").alias("v"), F.col("low").alias("b")), "v")
    both = same.unionByName(ends.select("a", "b")).where("a <> b")
    return both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _reaches(common: Column, a: Column, b: Column) -> Column:
    """Whether ``common`` shared shingles of sets of sizes ``a`` and ``b`` reach the similarity."""
    return SIMILARITY[1] * common >= SIMILARITY[0] * (a + b - common)


def _prefix_keys(sets: DataFrame) -> DataFrame:
    """``key``, ``node``, ``size``, ``at``: the shingles of each set by which a near copy can be found.

    Shingles are put in one order, the rarest first. Sets that reach the similarity share one of the first
    fifth of either's, and of the first ninth of the smaller one's. Shingles of one set alone come first
    and need no row; a set with too many of them has no near copy and no row.
    """
    rows = sets.select("node", "size", F.explode("shingles").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    held = rows.join(shared, "key").groupBy("node", "size")
    held = held.agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    # as many of a set's shingles come before its shared ones as are not shared
    alone = F.col("size") - F.size("keys")
    most = (F.col("size") * (SIMILARITY[1] - SIMILARITY[0])) / SIMILARITY[1] - alone
    first = F.slice("keys", 1, F.greatest(F.floor(most) + 1, F.lit(0)).cast("int"))
    placed = held.select("node", "size", alone.alias("alone"), F.posexplode(first).alias("pos", "own"))
    return placed.select(F.col("own.key").alias("key"), "node", "size", (F.col("alone") + F.col("pos")).alias("at"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``u``, ``v`` and ``near`` of every pair, from the whole sets of shingles."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    known = sets.join(wanted, "node", "left_semi")
    both = pairs.join(known.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = both.join(known.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.select("u", "v", _reaches(common, F.size("a"), F.size("b")).alias("near"))


def _possible(x: str, y: str) -> Column:
    """Whether sets ``x`` and ``y`` can reach the similarity if this key is the first that they share."""
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    return _reaches(F.least(a - F.col(f"{x}.at"), b - F.col(f"{y}.at")), a, b)


def _open_keys(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of keys whose nodes have different roots, with the ``root``, the ``big`` root there and the ``rest`` outside it."""
    rooted = keys.join(roots, "node")
    counted = rooted.groupBy("key", "root").agg(F.count("*").alias("own"))
    by_key = counted.groupBy("key").agg(
        F.count("*").alias("roots"),
        F.max_by("root", F.struct("own", -F.col("root"))).alias("big"),
        (F.sum("own") - F.max("own")).alias("rest"),
    )
    return rooted.join(by_key.where("roots > 1").drop("roots"), "key")


def _pivot_pairs(now: DataFrame, turn: int) -> DataFrame:
    """Each node outside the largest root of a key with one node of that root; up to PIVOTS of them a node."""
    member = F.struct("node", "size", "at")
    inside = now.where("root = big").groupBy("key").agg(F.min_by(member, F.xxhash64("node", F.lit(turn))).alias("y"))
    met = now.where("root <> big").select("key", member.alias("x")).join(inside, "key").where(_possible("x", "y"))
    choice = F.struct(F.xxhash64("y.node", F.lit(turn)).alias("mark"), F.col("y.node").alias("other"))
    chosen = met.groupBy(F.col("x.node").alias("node")).agg(F.slice(F.sort_array(F.collect_set(choice)), 1, PIVOTS).alias("c"))
    return chosen.select("node", F.explode("c.other").alias("other"))


def _all_pairs(now: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of a key with different roots that can reach the similarity.

    One of the two is outside the largest root, and the smaller set meets the other in its first ninth. Pairs whose
    parity maps differ in more bits than such sets can differ in shingles are not formed.
    """
    now = now.join(sets.select("node", "map"), "node")
    member = F.struct("node", "size", "at", "root", "map")
    low, high = SIMILARITY
    apart = " + ".join(f"bit_count(x.map[{i}] ^ y.map[{i}])" for i in range(1 << (MAP_BITS - 6)))
    alike = F.expr(f"({apart}) * {low + high} <= (x.size + y.size) * {high - low}")
    probes = F.col("at") * (low + high) <= F.col("size") * (high - low)
    outside, inside = F.col("root") != F.col("big"), F.lit(True)
    found = []
    for small, large in ((outside, inside), (inside, outside)):
        x = now.where(small & probes).select("key", member.alias("x"))
        y = now.where(large).select("key", member.alias("y"))
        ordered = F.expr("x.root <> y.root AND (x.size < y.size OR (x.size = y.size AND x.node <> y.node))")
        found.append(x.join(y, "key").where(ordered & _possible("x", "y") & alike))
    return found[0].unionByName(found[1]).select(F.col("x.node").alias("node"), F.col("y.node").alias("other"))


def _hooked(roots: DataFrame, near: DataFrame) -> DataFrame:
    """``roots`` after each root has taken the smallest one within two links; what is linked farther stays apart."""
    a = near.join(roots.select(F.col("node").alias("u"), F.col("root").alias("a")), "u")
    ends = a.join(roots.select(F.col("node").alias("v"), F.col("root").alias("b")), "v").where("a <> b").select("a", "b")
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    lowest = both.join(low.select(F.col("a").alias("b"), "low"), "b").groupBy("a").agg(F.min("low").alias("new"))
    moved = roots.join(lowest.withColumnRenamed("a", "root"), "root", "left")
    return moved.select("node", F.coalesce("new", "root").alias("root"))


def _links(sets: DataFrame, balls: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` that connect what pairs of enough similarity connect.

    What is connected already needs no comparison. So the pairs of SimHash balls are compared first, then
    every node with a few pivots, which connects large groups of near copies, and in the last round every pair
    of a key that is still apart: the result is that of comparing all pairs.
    """
    keys = stage(_prefix_keys(sets), "keys")
    checked = stage(_compared(balls, sets), "compared")
    roots = keys.select("node", F.col("node").alias("root")).distinct()
    roots = stage(_hooked(roots, checked.where("near")), "roots")
    for turn in range(PIVOT_ROUNDS + 1):
        now = stage(_open_keys(keys, roots), "open")
        pairs_at_most, rows = now.agg(F.sum("rest"), F.count("*")).first()
        if not rows:
            break
        # a key's rest is summed once for each of its rows: as many pairs as its last comparison would have
        last = turn == PIVOT_ROUNDS or pairs_at_most <= FEW * rows
        found = _all_pairs(now, sets) if last else _pivot_pairs(now, turn)
        pairs = found.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()
        new = stage(_compared(stage(pairs.join(checked, ["u", "v"], "left_anti"), "pairs"), sets), "compared")
        checked = checked.unionByName(new)
        if last:
            break
        roots = stage(_hooked(roots, new.where("near")), "roots")
    return checked.where("near").select("u", "v")


def near_roots(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets of ``own`` (``row``, ``id``, ``text``), and the roots of near copies among them.

    Classes: ``node`` and ``first`` (no_id, id, row of the smallest id). Roots: ``node`` and ``root`` of the
    nodes that have a near copy. Both are staged.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    with staging_scope(own.sparkSession) as scope:
        made = _signatures(own).groupBy("ident").agg(
            first, F.min("row").alias("node"), F.first("fp").alias("fp"), F.first("bands").alias("bands")
        )
        classes = stage(made, "classes")
        balls = stage(_simhash_pairs(classes.where(F.size("bands") > 0)), "balls")
        met = own.join(_met(classes, balls).withColumnRenamed("node", "row"), "row", "left_semi")
        links = _links(stage(_sets(met), "sets"), balls)
        roots = scope.keep(stage(components(links), "near_roots"))
        kept = scope.keep(stage(classes.select("node", "first"), "classes"))
    return kept, roots


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with one document of each class of near copies: that of the smallest id.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8,
    and what such pairs connect. Texts of equal sets are one before any comparison; null texts count as
    empty, and all texts without words are one class. Null ids come last; rows that repeat an id count one
    by one, so exactly one row stays. An empty table stays empty; other columns are kept as they are, whatever
    their names. Words of a long text are hashed a part at a time; its set of hashes is held whole.
    """
    rows, row = with_row(docs, "documents")
    own = rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    classes, roots = near_roots(own)
    kept = classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = kept.agg(F.min("first").alias("first"))
    return rows.join(kept.select(F.col("first.row").alias(row)), row, "left_semi").select(docs.columns)
