"""Near-duplicate embeddings by PCA-ordered tiled comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_frames
from ledgerloom.llm.components import components
from ledgerloom.llm.ordering import range_sorted, running_total
from ledgerloom.session import stage

THRESHOLD = 0.93
TILE = 1_024
# Leading dimensions after which pairs that can't reach the threshold are dropped.
STOPS = (4, 8, 16, 32)
# Rounding that the bound may have; pairs so near the threshold are computed anew from the vectors.
SLACK = 1e-9
# Rows of a tile compared at a time, which bounds the pairs in memory.
STRIP = 128


def principal_axes(units: DataFrame) -> dict[int, np.ndarray]:
    """Axes of largest second moment, as columns, by vector length.

    ``units`` has ``dim`` and ``unit``. Sums of outer products over all rows are added up per
    partition and then per cell; the driver gets one square matrix for each length.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for frame in batches:
            for dim, group in frame.groupby("dim"):
                x = np.stack(group["unit"].to_numpy())
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, total in sums.items():
            yield pd.DataFrame({"dim": dim, "row": range(len(total)), "values": list(total)})

    rows = map_frames(units.select("dim", "unit"), run, "dim int, row int, values array<double>")
    cells = rows.select("dim", "row", F.posexplode("values").alias("col", "value"))
    summed = cells.groupBy("dim", "row", "col").agg(F.sum("value").alias("value")).toPandas()
    axes = {}
    for dim, group in summed.groupby("dim"):
        moment = np.zeros((dim, dim))
        moment[group["row"], group["col"]] = group["value"]
        values, vectors = np.linalg.eigh((moment + moment.T) / 2)
        axes[int(dim)] = vectors[:, np.argsort(-values, kind="stable")]
    return axes


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, exact_a: np.ndarray, exact_b: np.ndarray):
    """Index pairs of rows of ``a`` and ``b`` with cosine of at least ``threshold``.

    Rows are unit vectors in axis order. Products are accumulated over the leading axes; what
    the other axes can add is at most the product of the suffix norms, so a pair leaves as soon as
    both together miss the threshold. Pairs within rounding of it are decided by ``exact_*``.
    """
    dim = a.shape[1]
    stops = [s for s in STOPS if s < dim] + [dim]

    def suffix(x, s):
        return np.sqrt(np.maximum(0, (x[:, s:] ** 2).sum(axis=1)))

    low = threshold - SLACK
    part = a[:, : stops[0]] @ b[:, : stops[0]].T
    i, j = np.nonzero(part + np.outer(suffix(a, stops[0]), suffix(b, stops[0])) >= low)
    part = part[i, j]
    for start, stop in zip(stops, stops[1:], strict=False):
        part = part + np.einsum("ij,ij->i", a[i, start:stop], b[j, start:stop])
        keep = part + suffix(a, stop)[i] * suffix(b, stop)[j] >= low
        i, j, part = i[keep], j[keep], part[keep]
    near = np.flatnonzero(np.abs(part - threshold) <= SLACK)
    if len(near):
        x, y = exact_a[i[near]], exact_b[j[near]]
        dots = (x * y).sum(axis=1)
        part[near] = dots / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    found = part >= threshold
    return i[found], j[found]


class Forest:
    """Connected parts of a bounded set of numbered nodes."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]


def compare_tiles(frame: pd.DataFrame, same: bool, threshold: float) -> pd.DataFrame:
    """Links of the vectors of two tiles, or of one with itself.

    Returns per vector with a link ``cls``, ``links`` (rows linked, copies counted) and ``root``, a
    vector of the same connected part. Pairs themselves are never put out.
    """
    frame = frame.sort_values(["side", "label", "dim", "cls"], kind="stable").reset_index(drop=True)
    links = np.zeros(len(frame), dtype=np.int64)
    forest = Forest(len(frame))
    copies = frame["copies"].to_numpy()
    for _, group in frame.groupby(["label", "dim"], sort=False):
        at = group.index.to_numpy()
        first = at[group["side"] == 0]
        second = first if same else at[group["side"] == 1]
        if not len(first) or not len(second):
            continue
        a, b = (np.stack(frame["axes"].to_numpy()[x]) for x in (first, second))
        raw_a, raw_b = (np.stack(frame["embedding"].to_numpy()[x]).astype(np.float64) for x in (first, second))
        for low in range(0, len(first), STRIP):
            strip = slice(low, low + STRIP)
            i, j = close_pairs(a[strip], b, threshold, raw_a[strip], raw_b)
            i = i + low
            if same:
                i, j = i[i < j], j[i < j]
            i, j = first[i], second[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            forest.link(i, j)
    cls = frame["cls"].to_numpy()
    out = pd.DataFrame({"cls": cls, "links": links, "root": cls[forest.root]})
    return out[out["links"] > 0]


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    tile: int = TILE,
) -> DataFrame:
    """Links and components of vectors with equal label and cosine of at least ``threshold``.

    Returns per row ``id_col``, ``n_links``, ``component_id`` (smallest id reachable, itself
    included) and ``kept`` (the id is the component's). Equal vectors of a label are one class
    and compared once; copies link with each other. Vectors that are null, empty, zero or hold null or non-finite
    components, and those without a label, link with nothing; neither do vectors of different
    length. Repeated rows are vectors of their own; a null id is never kept.

    Classes are range-sorted by label and leading principal axis and cut into tiles. Tiles are paired only
    if they share a label and their ranges on that axis are near enough: unit vectors
    at cosine t are at most sqrt(2 - 2t) apart on every axis. Each pair of tiles is one
    bounded group.
    """
    base = vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label")
    )
    rows = stage(base.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sound = rows.where(
        F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0)
    )
    classes = stage(
        sound.groupBy("label", "embedding")
        .agg(F.min("row").alias("cls"), F.count("*").alias("copies"), F.min("id").alias("first_id")),
        "classes",
    )

    def to_units(batches):
        for frame in batches:
            units = []
            for vector in frame["embedding"]:
                x = np.asarray(vector, dtype=np.float64)
                x = x / np.abs(x).max()
                units.append(x / np.sqrt((x * x).sum()))
            yield pd.DataFrame({"cls": frame["cls"], "dim": [len(u) for u in units], "unit": units})

    units = map_frames(classes.select("cls", "embedding"), to_units, "cls long, dim int, unit array<double>")
    axes = principal_axes(units)
    sizes = ", ".join(f"`{c}` {dict(classes.dtypes)[c]}" for c in ("label", "embedding", "cls", "copies"))

    def rotate(batches):
        for frame in batches:
            units = next(to_units([frame]))
            turned = [u @ axes[len(u)] for u in units["unit"]]
            out = frame[["label", "embedding", "cls", "copies"]].assign(dim=units["dim"], axes=turned)
            yield out.assign(lead=[float(t[0]) for t in turned], one=1)

    rotated = map_frames(classes, rotate, f"{sizes}, dim int, axes array<double>, lead double, one long")
    order = [F.col(c) for c in ("label", "dim", "lead", "cls")]
    ranged = range_sorted(rotated, order, "rotated")
    numbered = running_total(ranged.select("label", "dim", "lead", "cls", "one", "_part"), order, "one", "rank")
    tiles = stage(
        numbered.select("label", "dim", "lead", "cls", F.floor((F.col("rank") - 1) / tile).alias("tile")), "tiles"
    )
    spans = tiles.groupBy("label", "dim", "tile").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
    left, right = (spans.select("label", "dim", *[F.col(c).alias(f"{c}_{s}") for c in ("tile", "low", "high")]) for s in "ab")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    pairs = (
        left.join(right, ["label", "dim"])
        .where(F.col("tile_a") <= F.col("tile_b"))
        .where((F.col("low_b") <= F.col("high_a") + reach) & (F.col("low_a") <= F.col("high_b") + reach))
        .select("tile_a", "tile_b")
        .distinct()
    )
    sides = stage(
        pairs.select("tile_a", "tile_b", F.explode(F.array(F.struct(F.col("tile_a").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("tile_b").alias("tile"), F.lit(1).alias("side")))).alias("s"))
        .select("tile_a", "tile_b", "s.tile", "s.side")
        .where("tile_a <> tile_b OR side = 0"),
        "pairs",
    )
    dealt = (
        ranged.select("label", "dim", "cls", "copies", "embedding", "axes")
        .join(tiles.select("cls", "tile"), "cls")
        .join(sides, "tile")
    )

    def compare(key, frame):
        return compare_tiles(frame, key[0] == key[1], threshold)

    found = dealt.groupBy("tile_a", "tile_b").applyInPandas(compare, "cls long, links long, root long")
    found = stage(found, "found")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    joined = classes.join(links, "cls", "left").join(
        roots.withColumnRenamed("node", "cls"), "cls", "left"
    ).withColumn("root", F.coalesce("root", "cls"))
    joined = stage(joined, "joined")
    firsts = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = joined.join(firsts, "root").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    members = sound.join(by_class, ["label", "embedding"]).select("row", "n_links", "component_id")
    result = rows.select("row", "id").join(members, "row", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return result.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
