"""Benchmark decontamination: windows of benchmark words as a hash set that document positions are looked up in.

Built from DataFrame and SQL functions alone.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stage

WINDOW = 10
# Words: everything but ASCII that is neither letter nor digit; A-Z is lower-cased first.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A word of a text in its own case with what stands before it, and what stands behind the last one.
SPELLED = r"(?s)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TAIL = r"(?s)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z"
# Bytes of windows up to which their table is sent to all executors; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def words(text: Column | str) -> Column:
    """Array of the lower-cased words of a text; null has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(
        F.translate(F.coalesce(col, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0)
    )


def item_windows(
    benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Distinct windows of all items, and the items that hold them.

    Windows: ``gram`` (its words), ``len``, ``hash`` and ``held_by``; holders: ``held_by`` and ``items``, sorted ids as
    strings, one row for each set of items that some window is found in. An item of fewer words is one window.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(text_col).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    placed = items.select("item", "w", size.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    grams = placed.select("item", F.slice("w", F.col("at"), F.col("len")).alias("gram"))
    sets = grams.groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    # lengths keep joined ids apart, whatever characters they hold
    said = F.concat_ws(",", F.transform("items", lambda i: F.concat(F.length(i).cast("string"), F.lit(":"), i)))
    sets = stage(sets.withColumn("held_by", F.sha2(said, 256)), "windows")
    windows = sets.select("gram", F.size("gram").alias("len"), F.xxhash64("gram").alias("hash"), "held_by")
    return windows, sets.select("held_by", "items").dropDuplicates(["held_by"])


def _hits(texts: DataFrame, windows: DataFrame, row: str, most: int) -> DataFrame:
    """``row``, ``at`` (first word, from 1), ``len`` and ``held_by`` of every occurrence of a window in ``texts``.

    Every position is looked up by the hash of its next words, a hit is verified word by word. Where the
    windows are small enough they are broadcast, and positions are never shuffled.
    """
    size = F.aggregate(F.transform("gram", F.octet_length), F.lit(0), lambda a, x: a + x)
    total, lengths = windows.agg(F.sum((size + 128).cast("long")), F.sort_array(F.collect_set("len"))).first()
    small = (total or 0) <= most
    read = texts.select(row, words("text").alias("w"))
    if not lengths:
        return texts.where("false").select(row, F.lit(1).alias("at"), F.lit(1).alias("len"), F.lit("").alias("held_by"))
    placed = read.where(F.size("w") > 0).select(row, "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at"))

    def key(n: int) -> Column:
        fits = F.col("at") + n - 1 <= F.size("w")
        return F.when(fits, F.struct(F.lit(n).alias("len"), F.xxhash64(F.slice("w", F.col("at"), F.lit(n))).alias("hash")))

    if len(lengths) == 1:
        keyed = placed.select(row, "w", "at", key(lengths[0]).alias("key"))
    else:
        keyed = placed.select(row, "w", "at", F.explode(F.array(*map(key, lengths))).alias("key"))
    keyed = keyed.where("key IS NOT NULL").select(row, "w", "at", "key.len", "key.hash")
    verified = F.slice("w", F.col("at"), F.col("len")) == F.col("gram")
    if small:
        found = keyed.join(F.broadcast(windows), ["len", "hash"]).where(verified)
    else:
        # positions travel without their text; the words of texts with a hit are fetched to verify it
        found = keyed.drop("w").join(windows, ["len", "hash"])
        found = found.join(read, row).where(verified)
    return found.select(row, "at", "len", "held_by")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    most: int = BROADCAST_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Words of every document that an occurrence of a benchmark window covers.

    Returns per row ``id_col``, the columns of ``carry``, ``n_words``, ``spans`` (covered runs of words: array of ``from`` and ``to``, counted from 0,
    ``to`` not included, touching ones joined) and ``items`` (sorted ids, as strings, of the items with an occurring window).
    Null and empty texts have no words and no spans; an empty benchmark hits nothing. Documents that repeat an id count
    one by one; items that repeat an id are one item, items without an id cover words but are not listed. Other
    columns are not read.
    """
    kept = [F.col(c).alias(f"_carry{n}") for n, c in enumerate(carry)]
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *kept)
    counted = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SPELLED)).cast("long").alias("n_words")
    # the written copy fixes the row numbers
    texts = stage(own.select("*", counted, F.monotonically_increasing_id().alias("row")), "texts")
    windows, holders = item_windows(benchmark, window, item_id, item_text)
    hits = stage(_hits(texts, windows, "row", most), "hits")
    in_order = Window.partitionBy("row").orderBy("at", "len")
    reach = F.max(F.col("at") + F.col("len")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.select("row", "at", "len", (F.coalesce(reach, F.lit(0)) < F.col("at")).cast("long").alias("opens"))
    runs = opened.withColumn("run", F.sum("opens").over(in_order)).groupBy("row", "run")
    runs = runs.agg((F.min("at") - 1).alias("from"), (F.max(F.col("at") + F.col("len")) - 1).alias("to"))
    spans = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))
    held = hits.select("row", "held_by").distinct().join(holders, "held_by").select("row", F.explode("items").alias("item"))
    items = held.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = texts.drop("text").join(spans, "row", "left").join(items, "row", "left")
    return found.select(
        F.col("id").alias(id_col),
        *[F.col(f"_carry{n}").alias(c) for n, c in enumerate(carry)],
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def hit_words(spans: Column | str = "spans") -> Column:
    """Number of words in ``spans``."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    row = "_row"
    while row in docs.columns:
        row += "_"
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "documents"), row


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, without the documents that hold a benchmark window."""
    rows, row = _numbered(docs)
    found = find_contamination(rows, benchmark, window, row, text_col)
    return rows.join(found.where(F.size("spans") > 0).select(row), row, "left_anti").select(docs.columns)


def clean_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with the covered words, and what stands before each of them, cut out of the text.

    Null texts stay null, texts without a hit stay as they are; other columns are kept.
    """
    rows, row = _numbered(docs)
    found = find_contamination(rows, benchmark, window, row, text_col).where(F.size("spans") > 0)
    found = found.select(F.col(row).alias("_hit"), F.col("spans").alias("_spans"))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(SPELLED), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.exists("_spans", lambda s: (i >= s["from"]) & (i < s["to"])))
    cut = F.concat(F.array_join(kept, ""), F.regexp_extract(F.col(text_col), TAIL, 0))
    joined = rows.join(found, rows[row] == found["_hit"], "left")
    text = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(cut)
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
