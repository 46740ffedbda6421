"""Order-aware forward fill that runs on bounded blocks.

A fill over file order is sequential by nature. Here every source is cut into blocks
of ``block_rows`` consecutive rows. Each block reports its last usable value per
column, the small table of blocks is run through once, and what a block inherits is
joined to its rows. An ordinary window per block then does the rest: the rows are shuffled
once, by a key no group of which exceeds ``block_rows``, and not at all where they come
dealt by a column BLOCK already.

Guarded columns obey a rule on another column (the guard): on rows whose *filled*
guard equals a given value they neither receive nor pass on a value. At the head of a
block the guard is still unknown, so a block reports two candidates, and the pass over
the blocks picks the one that holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import clean, is_blank
from ledgerloom.session import stage
from ledgerloom.sources.rows import ROW_ID, SRC_ID

BLOCK_ROWS = 1 << 14
# a source may bring floor(row / BLOCK_ROWS) and deal its rows by scope and this column
BLOCK = "_block"
# blocks per group in the pass over the block table
GROUP_BLOCKS = 1 << 12


@dataclass(frozen=True)
class Guard:
    """``columns`` are left alone on rows where the filled ``column`` equals ``value``."""

    column: str
    value: str
    columns: tuple[str, ...]


def _latest(c: Column | str, over) -> Column:
    return F.last(c, ignorenulls=True).over(over)


def _carry(blocks: DataFrame, scope: list[str], columns: list[str]) -> DataFrame:
    """Replace each block's own last values by what it inherits from earlier blocks."""
    blocks = blocks.withColumn("_group", F.floor(F.col("_block") / GROUP_BLOCKS))
    groups = blocks.groupBy(*scope, "_group").agg(
        *[F.max_by(f"`{c}`", F.when(F.col(f"`{c}`").isNotNull(), F.col("_block"))).alias(c) for c in columns]
    )
    earlier = Window.partitionBy(*scope).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*scope, "_group", *[_latest(f"`{c}`", earlier).alias(f"_g_{c}") for c in columns])
    inside = (
        Window.partitionBy(*scope, "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    keep = [c for c in blocks.columns if c not in {*scope, "_group", *columns}]
    own = blocks.select(*scope, "_group", *keep, *[_latest(f"`{c}`", inside).alias(c) for c in columns])
    return own.join(groups, [*scope, "_group"]).select(
        *scope, *keep, *[F.coalesce(F.col(f"`{c}`"), F.col(f"`_g_{c}`")).alias(c) for c in columns]
    )


def ordered_fill(
    df: DataFrame,
    columns: dict[str, str],
    guards: tuple[Guard, ...] = (),
    row: str = ROW_ID,
    scope: tuple[str, ...] = (SRC_ID,),
    block_rows: int = BLOCK_ROWS,
    blank_text: bool = True,
) -> DataFrame:
    """Fill blanks with the last non-blank value above, in the order of ``row``.

    ``columns`` maps output name to source name; an output equal to its source replaces
    it. ``row`` is a BIGINT that rises in file order, ``scope`` names the columns a fill
    must not cross. ``guards`` refer to output names; a guard column must be filled too.
    Whitespace-only text counts as blank; ``blank_text=False`` says that blanks are NULL
    already, which saves testing every cell. A column BLOCK of ``df`` must be floor(``row`` / BLOCK_ROWS);
    it replaces ``block_rows`` and is not returned.
    """
    guards = effective(guards, columns)
    sources = list(dict.fromkeys(columns.values()))
    # In the working rows blanks are NULL. The rare whitespace-only text is kept aside.
    texts = [c for c in sources if blank_text and isinstance(df.schema[c].dataType, T.StringType)]
    seeds = {c: f"_s{i}" for i, c in enumerate(texts)}
    data = df if BLOCK in df.columns else df.withColumn(BLOCK, F.floor(F.col(row) / block_rows))
    df = df.drop(BLOCK)
    if texts:
        data = data.withColumns({seeds[c]: F.when(~is_blank(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in texts})
        odd = {c: F.col(f"`{c}`").isNotNull() & F.col(seeds[c]).isNull() for c in texts}
        spaces = F.array(*[F.when(odd[c], F.col(f"`{c}`")) for c in texts])
        data = data.select(
            *[F.col(seeds[c]).alias(c) if c in seeds else F.col(f"`{c}`") for c in df.columns],
            F.when(reduce(or_, odd.values()), spaces).alias("_spaces"),
            "_block",
        )
    space_of = {c: F.get("_spaces", F.lit(i)) for i, c in enumerate(texts)}

    carries = inherited(data, row, scope, columns, guards)
    both, temp, _ = fill_blocks(data, carries, row, scope, columns, guards)

    def restored(value: Column, out: str) -> Column:
        # in place, a blank with nothing above it stays as it was
        source = columns[out]
        return F.coalesce(value, space_of[source]) if source == out and source in space_of else value

    results = {o: restored(F.col(temp[o]), o) for o in columns}
    untouched = {c: F.coalesce(F.col(f"`{c}`"), space_of[c]) for c in texts if c not in columns}
    kept = [results.get(c, untouched.get(c, F.col(f"`{c}`"))).alias(c) for c in df.columns]
    added = [results[o].alias(o) for o in columns if o not in df.columns]
    return both.select(*kept, *added)


def effective(guards: tuple[Guard, ...], columns: dict[str, str]) -> tuple[Guard, ...]:
    """The guards that say something about ``columns``."""
    return tuple(g for g in guards if g.column in columns and set(g.columns) & set(columns))


def inherited(
    data: DataFrame,
    row: str,
    scope: tuple[str, ...],
    columns: dict[str, str],
    guards: tuple[Guard, ...] = (),
    seeds: DataFrame | None = None,
) -> DataFrame:
    """What each block of ``data`` inherits from earlier ones: one staged row per block with the sources of ``columns``.

    ``data`` has a column BLOCK and NULL for blanks. ``seeds`` may hold all rows with a value in its columns;
    these columns are looked up there and not among all rows. Guards and guarded columns must then be among them.
    """
    scope_keys, guarded = list(scope), {c for g in guards for c in g.columns if c in columns}
    keys = [*scope_keys, BLOCK]
    free = list(dict.fromkeys(columns[o] for o in columns if o not in guarded))
    few = [c for c in free if seeds is not None and c in seeds.columns]

    # One short row per block: written once, so that no later step scans the rows for it again.
    ends = _block_ends(data, keys, row, [c for c in free if c not in few])
    if few:
        ends = ends.join(_block_ends(seeds, keys, row, few), keys, "left")
    carries = _carry(stage(ends, "block_ends"), scope_keys, free)
    for guard in guards:
        held = [columns[o] for o in guard.columns if o in columns]
        told = data if seeds is None else seeds
        ends = stage(_guarded_ends(told, keys, row, columns[guard.column], guard.value, held), "guarded_ends")
        inherits = _is_value(F.col(f"`{columns[guard.column]}`"), guard.value)
        known = carries.select(*keys, inherits.alias("_shut"))
        chosen = ends.join(known, keys, "left").select(
            *keys,
            *[F.when(F.col("_shut"), F.col(f"_shut_{h}")).otherwise(F.col(f"_open_{h}")).alias(h) for h in held],
        )
        # blocks without any value of their own still inherit
        chosen = carries.select(*keys).join(chosen, keys, "left")
        carries = carries.join(_carry(chosen, scope_keys, held), keys)
    return stage(carries, "carries")


def fill_blocks(
    data: DataFrame, carries: DataFrame, row: str, scope: tuple[str, ...], columns: dict[str, str], guards: tuple[Guard, ...] = ()
) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """Fill inside the blocks of ``data``, from :func:`inherited` on.

    Returns the rows with added columns, the names of the filled ones by output and those of what the
    block inherits by source. A column ``_shut0`` and so on says where a guard holds.
    """
    guarded = {c: g for g in guards for c in g.columns if c in columns}
    keys = [*scope, BLOCK]
    # What a block inherits holds on its rows until the first value of its own. One short row a block: Spark
    # broadcasts the table while it is small, and else the rows are dealt and sorted by its keys anyway.
    heads = {c: f"_h{i}" for i, c in enumerate(c for c in carries.columns if c not in keys)}
    carried = carries.select(*keys, *[F.col(f"`{c}`").alias(h) for c, h in heads.items()])
    order = Window.partitionBy(*keys).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    temp = {out: f"_f{i}" for i, out in enumerate(columns)}
    free_outs = [o for o in columns if o not in guarded]
    both = data.withColumns({temp[o]: _latest(f"`{columns[o]}`", order) for o in free_outs}).join(carried, keys, "left")
    both = both.withColumns({temp[o]: F.coalesce(temp[o], heads[columns[o]]) for o in free_outs})
    if guarded:
        flags = {g.column: f"_shut{i}" for i, g in enumerate(guards)}
        both = both.withColumns({flags[g.column]: _is_value(F.col(temp[g.column]), g.value) for g in guards})
        passing = {o: F.when(~F.col(flags[g.column]), F.col(f"`{columns[o]}`")) for o, g in guarded.items()}
        both = both.withColumns({f"_p{temp[o]}": c for o, c in passing.items()})
        both = both.withColumns({temp[o]: _latest(f"_p{temp[o]}", order) for o in guarded})
        both = both.withColumns(
            {
                temp[o]: F.when(F.col(flags[g.column]), F.col(f"`{columns[o]}`")).otherwise(
                    F.coalesce(temp[o], heads[columns[o]])
                )
                for o, g in guarded.items()
            }
        )
    return both, temp, heads


def _is_value(c: Column, value: str) -> Column:
    # looking for the value is cheaper than trimming, which is left to the rows that hold it
    text = c.cast("string")
    return F.coalesce(text.contains(value) & (clean(text) == value), F.lit(False))


def _block_ends(data: DataFrame, keys: list[str], row: str, columns: list[str]) -> DataFrame:
    """Last non-blank value of each column per block.

    Row numbers are fixed-width, so one hash aggregate finds the last row of every column; values are
    fetched for those rows alone, at most one for each block and column.
    """
    ends = data.groupBy(*keys).agg(
        *[F.max(F.when(F.col(f"`{c}`").isNotNull(), F.col(row))).alias(f"_at{i}") for i, c in enumerate(columns)]
    )
    return _fetch(data, stage(ends, "ends"), keys, row, {f"_at{i}": (c, c) for i, c in enumerate(columns)})


def _fetch(data: DataFrame, ends: DataFrame, keys: list[str], row: str, cells: dict[str, tuple[str, str]]) -> DataFrame:
    """Replace row numbers in ``ends`` by values: ``cells`` maps a number's column to (source, output)."""
    wanted = ends.select(F.explode(F.array_distinct(F.array(*cells))).alias("_want")).where("_want IS NOT NULL").distinct()
    # one short row per wanted ledger row, written first so that its size is known to the join
    wanted = stage(wanted, "wanted")
    sources = list(dict.fromkeys(source for source, _ in cells.values()))
    rows = data.select(*keys, F.col(row).alias("_want"), *[f"`{c}`" for c in sources]).join(wanted, "_want", "left_semi")
    # the values of a block meet its row numbers; any of the few rows with the number holds the value
    numbers = ends.select(*keys, *cells)
    joined = numbers.join(rows, keys, "left")
    return joined.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_want") == F.col(at), F.col(f"`{source}`"))).alias(out)
            for at, (source, out) in cells.items()
        ]
    )


def _guarded_ends(
    data: DataFrame, keys: list[str], row: str, guard: str, value: str, held: list[str]
) -> DataFrame:
    """Last usable value of each held column per block: ``_open_`` and ``_shut_`` candidates.

    They differ where the rows before the first guard value of the block count. Only rows
    that set the guard or a held column matter, so the others are not shuffled.
    """
    slim = data.select(
        *keys, F.col(row).alias("_at"), F.col(f"`{guard}`").alias("_g"), *[f"`{h}`" for h in held]
    )
    telling = F.col("_g").isNotNull()
    for h in held:
        telling = telling | F.col(f"`{h}`").isNotNull()
    so_far = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    seen = slim.where(telling).withColumn("_g", clean(_latest("_g", so_far).cast("string")))
    candidates = []
    for prefix, unknown in (("_open_", True), ("_shut_", False)):
        usable = F.coalesce(F.col("_g") != value, F.lit(unknown))
        for h in held:
            at = F.when(F.col(f"`{h}`").isNotNull() & usable, F.col("_at"))
            candidates.append(F.max_by(f"`{h}`", at).alias(f"{prefix}{h}"))
    return seen.groupBy(*keys).agg(*candidates)
