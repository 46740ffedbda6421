"""Language identification by compression with one raw-content dictionary per language."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, map_frames, text_slices

UNKNOWN = "und"
# Bounds of the training sample of a language: distinct texts, characters of the piece of each, dictionary bytes.
SAMPLE_TEXTS = 1_000
PIECE_CHARS = 500
DICTIONARY_BYTES = 64_000
MAX_LANGUAGES = 200
LEVEL = 6
# Texts are compressed in blocks of this size, each against the dictionaries alone: what a longer text learns from
# itself would count for every language alike and shrink the margin.
BLOCK_BYTES = 16_384
# A result is rejected if the second language needs less than this share of bytes more.
MIN_MARGIN = 0.005
# How fast the score leaves 0.5 with the ratio of the two smallest sizes.
SHARPNESS = 40


def learn_dictionaries(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, bytes]:
    """Raw dictionary of every language from rows where ``train`` holds and text and language are set.

    A language is learned from its distinct texts of the smallest hash: a piece of PIECE_CHARS characters of
    each, from a place in the whole text that its hash gives, until DICTIONARY_BYTES are full or SAMPLE_TEXTS texts
    are used. Copies of a text count once. More than MAX_LANGUAGES languages are an error, as the dictionaries
    are sent to every task.
    """
    mark = F.xxhash64(text_col, F.lit("langid"))
    usable = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.trim(text_col) != ""))
    texts = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), mark.alias("mark"))
    langs = texts.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if langs > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    # no more rows than Spark ranks with a limit in every task before the shuffle
    ranked = (
        texts.select("lang", "mark")
        .distinct()
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("mark")))
        .where(F.col("n") <= SAMPLE_TEXTS)
    )
    picked = texts.join(F.broadcast(ranked), ["lang", "mark"])
    places = F.greatest(F.char_length("text") - PIECE_CHARS, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("mark", F.lit("piece")), places.cast("long")).cast("int") + 1
    pieces = picked.select("lang", "n", F.substring("text", start, F.lit(PIECE_CHARS)).alias("text"))
    one = pieces.groupBy("lang", "n").agg(F.min("text").alias("text"))
    sampled = one.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("rows"))
    rows = sampled.collect()
    return {r["lang"]: "\n".join(x["text"] for x in r["rows"]).lower().encode()[:DICTIONARY_BYTES] for r in rows}


class Compressors:
    """Smallest encoding of lower-cased text over the languages' dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.coders = []
        for lang, raw in sorted(dictionaries.items()):
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            coder = zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_dict_id=False)
            self.coders.append((lang, coder))

    def predict(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether the margin is wide enough.

        Sizes are sums over blocks of BLOCK_BYTES of the whole text, so the margin does not depend on its
        length. The margin is the share of bytes by which the runner-up is larger. Equal sizes go to the
        language that comes first by name, with margin 0.
        """
        if not self.coders or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, False
        data = text.lower().encode()
        blocks = [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
        sizes = sorted((sum(len(coder.compress(b)) for b in blocks), lang) for lang, coder in self.coders)
        best, lang = sizes[0]
        second = sizes[1][0] if len(sizes) > 1 else 2 * best
        margin = second / best - 1
        return lang, 1 / (1 + (best / second) ** SHARPNESS), margin, margin >= min_margin


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    id_col: str = "doc_id",
    text_col: str = "text",
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """Language of every whole text.

    Returns per row ``id_col``, ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``accepted``. A null
    text or one without a letter is ``und`` with score 0 and not accepted, as is every text if no
    language was learned. With a single language the margin is 1. Repeated rows stay.
    """

    def run(batches):
        model = Compressors(dictionaries)
        for part in text_slices(batches, text_col):
            found = [model.predict(t, min_margin) for t in part[text_col]]
            out = pd.DataFrame(found, columns=["lang_pred", "score", "margin", "accepted"], index=part.index)
            out.insert(0, id_col, part[id_col])
            yield out

    slim = docs.select(id_col, text_col)
    kind = slim.schema[id_col].dataType.simpleString()
    return map_frames(slim, run, f"{id_col} {kind}, lang_pred string, score double, margin double, accepted boolean")


def accepted_rows(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose language is told by a wide enough margin.

    Null texts, texts without a letter and, if no language was learned, all rows go. Equal sizes of two languages
    are margin 0, so such rows go too. Repeated rows stay, an empty table stays empty.
    """

    def run(batches):
        model = Compressors(dictionaries)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            yield batch.filter(pa.array([model.predict(t)[3] for t in texts], type=pa.bool_()))

    return map_batches(docs, run, docs.schema)
