"""Quality rules whose cutoffs are chosen with a guaranteed bound on false rejections."""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_frames
from ledgerloom.llm.docstats import with_base_stats
from ledgerloom.session import stage

# Share of good documents that a rule may reject, and the chance that any cutoff breaks that.
MAX_FALSE_REJECTION = 0.01
ERROR_RATE = 0.05
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Statistic of each rule with its cutoffs from lenient to strict; a document fails above a cutoff.
RULES = {
    "symbols": ("n_symbols / word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)),
    "dup_lines": ("n_dup_lines / n_words", (0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01, 0.005)),
    "repeats": ("n_repeat_words / n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03)),
    "long_words": ("word_chars / n_words", (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.5, 9.0)),
    "short_words": ("n_words / word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.32, 0.3, 0.28, 0.26)),
}


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of at most ``k`` of ``n`` draws at rate ``p``, exactly summed."""
    if k >= n:
        return 1.0
    total, term = 0.0, 0.0
    for i in range(k, -1, -1):
        term = exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p))
        total += term
        if i < n * p and term < 1e-18 * total:
            break
    return min(1.0, total)


def strictest(rejected: list[int], n: int, risk: float, error: float) -> int:
    """Index of the strictest cutoff that is safe, -1 if none is.

    ``rejected`` counts good holdout documents above each cutoff, lenient first. A cutoff is safe if
    a rejection rate above ``risk`` would give so few rejections with probability ``error`` at
    most. Cutoffs are tested in order and testing ends at the first failure, so the order needs no further
    correction.
    """
    safe = -1
    for i, k in enumerate(rejected):
        if binomial_tail(k, n, risk) > error:
            break
        safe = i
    return safe


def _statistic(rule: str) -> Column:
    top, bottom = RULES[rule][0].split(" / ")
    return F.coalesce(F.col(top) / F.nullif(F.col(bottom), F.lit(0)), F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def safe_cutoffs(
    counted: DataFrame, risk: float = MAX_FALSE_REJECTION, error: float = ERROR_RATE
) -> DataFrame:
    """Cutoff of every rule in every stratum: ``stratum`` and a map ``cutoffs`` of safe rules.

    ``counted`` has one labelled good document per row with its ``stratum`` and the base counts.
    One aggregate counts the documents above each cutoff; the exact test runs on these counts, one row
    per stratum. The error rate is split evenly over all rules and strata (Bonferroni).
    """
    above = [
        F.sum((_statistic(rule) > cut).cast("long")).alias(f"{rule}_{i}")
        for rule, (_, cuts) in RULES.items()
        for i, cut in enumerate(cuts)
    ]
    counts = counted.groupBy("stratum").agg(F.count("*").alias("n"), *above)
    counts = stage(counts, "rejections")
    each = error / (max(1, counts.count()) * len(RULES))

    def run(batches):
        for frame in batches:
            found = []
            for row in frame.to_dict("records"):
                cutoffs = {}
                for rule, (_, cuts) in RULES.items():
                    at = strictest([int(row[f"{rule}_{i}"]) for i in range(len(cuts))], int(row["n"]), risk, each)
                    if at >= 0:
                        cutoffs[rule] = cuts[at]
                found.append(cutoffs)
            yield frame[["stratum"]].assign(cutoffs=found)

    return map_frames(counts, run, "stratum string, cutoffs map<string,double>")


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
) -> DataFrame:
    """Base counts, base verdict and the rules' verdict of every row of ``docs``.

    Strata are the values of ``stratum_col``, null being one of its own. The holdout is every
    document with label 1 that passes the base rules (ids with repeated labels: all must be 1). A rule
    works in a stratum only if a cutoff there is proven safe; a stratum without enough
    labels rejects by the base rules alone. ``kept`` is false if the base or a rule rejects;
    ``failed_rules`` names the rules. Repeated rows are judged alike, null texts have no words.
    """
    stats = stage(with_base_stats(docs, (stratum_col,), id_col, text_col), "stats").withColumn(
        "base_failed", base_failed()
    ).withColumn("stratum", F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("null")))
    good = labels.groupBy(id_col).agg(F.min(label_col).alias("_good")).where("_good = 1").select(id_col)
    holdout = stats.where(~F.col("base_failed")).join(good, id_col, "left_semi")
    cutoffs = stage(safe_cutoffs(holdout), "cutoffs")
    judged = stats.join(cutoffs, "stratum", "left")
    failed = F.array_compact(
        F.array(*[F.when(_statistic(rule) > F.col("cutoffs")[rule], F.lit(rule)) for rule in RULES])
    )
    return judged.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        failed.alias("failed_rules"),
        (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"),
    )
