"""Registered queries of the operators: ``opN_<name>`` over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    align, collocations, decontaminate, embeddings, langid, mixing, packing, ppm, quality_model, quality_rules, simhash,
    suffix, warc,
)
from ledgerloom.llm.common import fold, table
from ledgerloom.session import stage, staging_root

Query = Callable[[SparkSession, str], DataFrame]


def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths by partial matching; learned outside fold 2 of 7."""
    held_out = fold("doc_id", 7) == 2
    scored = ppm.score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-boosted quality score; learned from folds 1 to 4 of 5."""
    held_out = fold("doc_id", 5) == 0
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_model.score_quality(docs, labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of equal-label vectors at cosine 0.93."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by weighted fair queueing."""
    return mixing.fair_mix(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back, revisits resolved."""
    path = f"{staging_root(spark)}/ledgerloom/{uuid.uuid4().hex}/archives"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    read = warc.payloads(warc.reassemble(warc.read_records(spark, path)))
    known = stage(
        read.select(
            "record_id",
            F.col("page_id").cast("long").alias("page_id"),
            F.col("type").alias("record_type"),
            "refers_to",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"),
        ),
        "pages_read",
    )
    full = known.where("record_type = 'response'")
    revisits = known.where("record_type = 'revisit'").select("page_id", "record_type", F.col("refers_to").alias("record_id"))
    referred = full.select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    resolved = revisits.join(referred, "record_id", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return full.withColumn("refers_to", F.lit(None).cast("long")).select(names).unionByName(resolved.select(names))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of risk-controlled rules per language."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a 100-byte string starting earlier covers."""
    cut = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by the smallest encoding; learned outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    found = langid.identify(docs, langid.learn_dictionaries(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of 64-bit fingerprints within two bits."""
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids along a Hilbert curve."""
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and id links of two tokenizers over all documents."""
    import public_tokenizers

    return align.alignment_digests(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that benchmark windows of ten words cover."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    n_hit = decontaminate.hit_words("spans")
    return decontaminate.find_contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def llm_queries() -> dict[str, Query]:
    return {
        "op1_ppm_scoring": op1_ppm_scoring,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_fair_mix": op4_fair_mix,
        "op5_warc": op5_warc,
        "op6_quality_rules": op6_quality_rules,
        "op7_repeated_passages": op7_repeated_passages,
        "op8_language_id": op8_language_id,
        "op9_simhash": op9_simhash,
        "op10_curve_packing": op10_curve_packing,
        "op11_tokenizer_alignment": op11_tokenizer_alignment,
        "op12_phrase_mining": op12_phrase_mining,
        "op13_decontamination": op13_decontamination,
    }
