"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import with_row, word_count
from ledgerloom.llm.ordering import range_sorted, running_total
from ledgerloom.session import stage

WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
MAX_PASSES = 2


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget_share: float = BUDGET_SHARE,
    passes: int = MAX_PASSES,
) -> DataFrame:
    """Target of every source: ``source``, ``source_rank``, ``source_size``, ``target``, ``budget``.

    ``sizes`` has one row ``source``, ``size`` per document. Sources by code point, null last, take
    the weights in turn. A target is its share of the budget by weight, at most ``passes`` times
    the source's size; what is cut off goes to the others by weight. That fixed point is a
    water level: sources are ordered by the level at which they are full, and the level is the
    first one that the remaining sources don't exceed. One row per source is handled.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("source_rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    )
    full = F.col("source_size") * passes / F.col("weight")
    rest = Window.orderBy(full, "source_rank").rowsBetween(0, Window.unboundedFollowing)
    done = Window.orderBy(full, "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    leveled = ranked.select(
        "*",
        (F.sum("source_size").over(Window.partitionBy()) * budget_share).alias("budget"),
        full.alias("full"),
        F.sum("weight").over(rest).alias("open_weight"),
        (F.coalesce(F.sum("source_size").over(done), F.lit(0)) * passes).alias("closed"),
    ).withColumn("level", (F.col("budget") - F.col("closed")) / F.col("open_weight"))
    # the level holds at the first source whose own full level it doesn't exceed
    first = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "source_rank", "level")))
    return leveled.withColumn("water", first.over(Window.partitionBy())["level"]).select(
        "source",
        "source_rank",
        "source_size",
        "budget",
        F.least(F.col("source_size").cast("double") * passes, F.col("water") * F.col("weight")).alias("target"),
    )


def shuffle_key(id_col: str) -> Column:
    """Reproducible place of a document in its source."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def fair_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    budget_share: float = BUDGET_SHARE,
    passes: int = MAX_PASSES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Words the mix takes of every document.

    Returns one row per row of ``docs``: ``id_col``, ``size`` (words; null text 0), ``source_size``,
    ``target`` of its source, ``taken`` and the columns named in ``carry``. Every source is a queue of its documents in shuffled
    order, gone through ``passes`` times. A copy's virtual finish time is the words of its source
    up to its end divided by the target. All copies are range-sorted by finish time and taken
    while their words fit into the total budget. Whole copies are taken, so ``taken`` is a multiple
    of ``size``. Equal finish times go by source, then place. Repeated rows are documents of
    their own; an empty table or one without words takes nothing.
    """
    sizes = stage(
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
            F.struct(F.lit(0), *carry).alias("_carry"))
        .withColumn("place", shuffle_key("_id")),
        "sizes",
    )
    targets = stage(source_targets(sizes, weights, budget_share, passes), "targets")
    order = [F.col(c).asc_nulls_last() for c in ("source", "place", "_id", "size")]
    queued = running_total(range_sorted(sizes, order, "queues"), order, "size", "_so_far")
    # running totals go over all sources in turn; each starts where the smaller ones end
    turn = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)
    starts = targets.withColumn("_start", F.coalesce(F.sum("source_size").over(turn), F.lit(0)))
    placed = stage(
        queued.join(starts, queued["source"].eqNullSafe(starts["source"]))
        .select(
            "_id", "_carry", "size", "place", "source_rank", "source_size", "target", "budget",
            (F.col("_so_far") - F.col("_start")).alias("_words"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "placed",
    )
    copies = (
        placed.where("size > 0 AND target > 0")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("_pass"))
        .withColumn("finish", (F.col("_words") + F.col("_pass") * F.col("source_size")) / F.col("target"))
        .select("_row", "size", "budget", "finish", "source_rank", "_pass", "place", "_id")
    )
    finish = [F.col(c).asc_nulls_last() for c in ("finish", "source_rank", "_pass", "place", "_id", "_row")]
    served = running_total(range_sorted(copies, finish, "served"), finish, "size", "_total")
    taken = served.where("_total <= budget").groupBy("_row").agg(F.sum("size").alias("taken"))
    return placed.join(taken, "_row", "left").select(
        F.col("_id").alias(id_col),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        *[F.col("_carry")[c].alias(c) for c in carry],
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them: not at all, once, or once for each pass.

    All columns stay as they are, whatever their names. Null and empty texts have no words and are never taken; null sources are one
    source, the last; rows that repeat an id or a text are taken one by one, ties in the order are settled by id and row. An empty table
    stays empty.
    """
    rows, row = with_row(docs, "documents")
    mix = fair_mix(rows, id_col, text_col, source_col, carry=(row,))
    times = mix.where("taken > 0").select(row, F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    return rows.join(times.select(row), row).select(docs.columns)
