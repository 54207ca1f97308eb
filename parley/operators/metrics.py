"""Accuracy reports per call and per corpus, and the gates that promote a candidate.

A report has the word and character error rates, the recall of numbers and names, the share of
correctly attributed speech and whether all meet their target.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.edit import spread, with_error_rates, with_normal_rates, with_normal_texts
from parley.functions.once import with_once
from parley.functions.text import counts, name_recall, normalize, numbers, recall
from parley.operators.intervals import attribution
from parley.shared import cut

#: Targets of a report and limits of a promotion.
TARGETS = {"wer": 0.15, "cer": 0.08, "number_accuracy": 0.90, "name_accuracy": 0.90, "speaker_accuracy": 0.95}
RUNTIME_SECONDS = 1800
CONSENSUS_GAIN = 0.015
VARIANT_GAIN = 0.01


def meets_target() -> Column:
    low, high = ("wer", "cer"), ("number_accuracy", "name_accuracy", "speaker_accuracy")
    out = F.lit(True)
    for c in low:
        out = out & (F.col(c) <= TARGETS[c])
    for c in high:
        out = out & (F.col(c) >= TARGETS[c])
    return out


def with_text_scores(df: DataFrame, ref: str, hyp: str, names: Iterable[str] = ()) -> DataFrame:
    """Adds error rates and the recall of numbers and names of two text columns."""
    scored = with_error_rates(df, ref, hyp)
    scored = scored.withColumns({"_rn": counts(numbers(normalize(F.coalesce(F.col(ref), F.lit(""))))), "_hn": counts(numbers(normalize(F.coalesce(F.col(hyp), F.lit("")))))})
    plain = lambda c: normalize(F.coalesce(F.col(c), F.lit("")), numbers=False)
    names = list(names)
    return scored.withColumns({"number_accuracy": recall(F.col("_rn"), F.col("_hn")), "name_accuracy": name_recall(plain(ref), plain(hyp), names) if names else F.lit(1.0)}).drop("_rn", "_hn")


def call_report(texts: DataFrame, reference: DataFrame, hypothesis: DataFrame, call: str, names: Iterable[str] = ()) -> DataFrame:
    """One report per call. ``texts``: call, ref, hyp; segments: call, start, end, speaker."""
    speech = attribution(reference, hypothesis, call).select(call, "speaker_accuracy")
    out = with_text_scores(texts, "ref", "hyp", names).join(speech, call, "left").fillna(1.0, ["speaker_accuracy"])
    return out.withColumn("meets_target", meets_target()).select(call, "n_ref", "word_errors", "char_errors", *TARGETS, "meets_target")


def corpus_report(items: DataFrame, names: Iterable[str] = (), by: list[str] | None = None) -> DataFrame:
    """One report per group over whole items: errors and lengths are summed, not rates averaged.

    ``items``: what ``item_counts`` returns. Items are scored one by one and added up, so that no task
    sees the corpus as one text; an alignment across the border of two items is thereby not possible.
    """
    total = lambda c: F.sum(c)
    share = lambda a, b: F.when(total(b) > 0, F.try_divide(total(a), total(b))).otherwise(1.0)
    rate = lambda a, b, other: F.when(total(b) > 0, F.try_divide(total(a), total(b))).when(total(other) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    out = items.groupBy(*(by or [])).agg(
        F.count("*").alias("n_items"),
        rate("word_errors", "ref_words", "hyp_words").alias("wer"),
        rate("char_errors", "ref_chars", "hyp_chars").alias("cer"),
        share("numbers_found", "numbers").alias("number_accuracy"),
        share("names_found", "names").alias("name_accuracy"),
        share("correct", "scored").alias("speaker_accuracy"),
    )
    return out.withColumn("meets_target", meets_target())


def item_counts(items: DataFrame, names: Iterable[str] = ()) -> DataFrame:
    """Adds what ``corpus_report`` sums to items with ``ref``, ``hyp``, ``scored`` and ``correct`` (seconds)."""
    made = with_normal_rates(with_normal_texts(spread(items), "ref", "hyp"))
    tokens = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, " ")))
    wanted = F.array(*(normalize(F.lit(n), numbers=False) for n in names)) if names else F.array().cast("array<string>")
    there = F.filter(wanted, lambda n: (n != "") & F.contains(F.col("_pr"), n))
    made = with_once(made, {"_rn": counts(numbers(F.col("_r"))), "_hn": counts(numbers(F.col("_h"))), "_there": there})
    found = recall(F.col("_rn"), F.col("_hn"))
    expected = F.aggregate("_rn", F.lit(0), lambda s, x: s + x["n"])
    kept = F.filter("_there", lambda n: F.contains(F.col("_ph"), n))
    return made.withColumns(
        {
            "ref_words": tokens("_r"),
            "hyp_words": tokens("_h"),
            "ref_chars": F.length("_r"),
            "hyp_chars": F.length("_h"),
            "numbers": expected,
            "numbers_found": F.rint(found * expected).cast("int"),
            "names": F.size("_there"),
            "names_found": F.size(kept),
        }
    ).drop("_r", "_h", "_pr", "_ph", "_rn", "_hn", "_there")


def best_variants(reports: DataFrame) -> DataFrame:
    """candidate and ``mode``: telephone where it lowers the error rate by a point and loses no number or name."""
    one = reports.groupBy("candidate").pivot("mode", ["original", "telephone"]).agg(F.first(F.struct("wer", "number_accuracy", "name_accuracy")))
    better = (
        (F.col("original.wer") - F.col("telephone.wer") >= VARIANT_GAIN)
        & (F.col("telephone.number_accuracy") >= F.col("original.number_accuracy"))
        & (F.col("telephone.name_accuracy") >= F.col("original.name_accuracy"))
    )
    # A candidate that failed in either mode isn't compared.
    return one.where("original is not null and telephone is not null").select("candidate", F.when(better, "telephone").otherwise("original").alias("mode"))


def promotion(reports: DataFrame, consensus: DataFrame | None = None) -> DataFrame:
    """One row: the candidate with the least error rate, the runner-up, and whether their consensus is used.

    ``reports``: candidate, candidate_no, mode, runtime_40min and the report's columns; ``consensus``: the same for
    pairs (``primary``, ``secondary``). A few rows each: one a candidate and mode.
    """
    reports = cut(reports)
    chosen = reports.join(best_variants(reports), ["candidate", "mode"])
    ranked = chosen.withColumn("_r", F.row_number().over(Window.orderBy("wer", "candidate_no")))
    first = ranked.where("_r = 1").select(F.col("candidate").alias("primary"), F.col("mode").alias("audio_mode"), *(F.col(c).alias(f"p_{c}") for c in ("wer", "number_accuracy", "name_accuracy", "runtime_40min", "meets_target")))
    second = ranked.where("_r = 2").select(F.col("candidate").alias("secondary"), F.col("runtime_40min").alias("s_runtime"))
    both = first.join(second, F.lit(True), "left")  # one row each
    if consensus is None:
        both = both.withColumns({"use_consensus": F.lit(False), "target_met": F.col("p_meets_target") & (F.col("p_runtime_40min") <= RUNTIME_SECONDS)})
    else:
        both = both.join(consensus, ["primary", "secondary"], "left")
        runtime = F.col("p_runtime_40min") + F.col("s_runtime")
        use = F.coalesce(
            (F.col("p_wer") - F.col("wer") >= CONSENSUS_GAIN) & (F.col("number_accuracy") >= F.col("p_number_accuracy")) & (F.col("name_accuracy") >= F.col("p_name_accuracy")) & (runtime <= RUNTIME_SECONDS),
            F.lit(False),
        )
        met = F.when(use, F.col("meets_target") & (runtime <= RUNTIME_SECONDS)).otherwise(F.col("p_meets_target") & (F.col("p_runtime_40min") <= RUNTIME_SECONDS))
        both = both.withColumns({"use_consensus": use, "target_met": met})
    return both.select("primary", F.when(F.col("use_consensus"), F.col("secondary")).alias("promoted_secondary"), "audio_mode", "use_consensus", "target_met")
