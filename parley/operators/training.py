"""Training data: eligible calls, a split by whole calls, and the manifest of utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED = 20260830
LEAST_HOURS = 3.0


def eligible(calls: DataFrame) -> DataFrame:
    """Verified calls that aren't held out."""
    return calls.where(F.coalesce("verified", F.lit(False)) & ~F.coalesce("held_out", F.lit(False)))


def enough(calls: DataFrame, hours: float = LEAST_HOURS) -> Column:
    """A check to select: the hours of ``duration``, or an error if they are fewer than ``hours``."""
    total = F.coalesce(F.sum("duration"), F.lit(0.0)) / 3600
    return F.when(total >= hours, total).otherwise(F.raise_error(F.lit("too few verified hours")).cast("double"))


def split_sizes(n: int) -> tuple[int, int]:
    """How many of ``n`` calls train and validate; every split gets one at least."""
    if n < 3:
        raise ValueError("a split by calls needs three calls or more")
    train, val = max(1, round(n * 0.8)), max(1, round(n * 0.1))
    return (n - 2, 1) if train + val >= n else (train, val)


def split_calls(calls: DataFrame, call: str, seed: int = SEED) -> DataFrame:
    """call and ``split``: train, val or test, by whole calls in the order of a hash.

    The border hashes are found by quantile-free counting: calls are ranked within 4096 hash ranges, and a
    range's offset comes from the counts of those before it, so no task ranks all calls.
    """
    hashed = calls.select(call).distinct().withColumn("_h", F.xxhash64(F.lit(seed), F.col(call))).withColumn("_b", F.shiftrightunsigned("_h", 52).cast("int"))
    sizes = {r["_b"]: r["count"] for r in hashed.groupBy("_b").count().collect()}  # at most 4096 rows
    total = sum(sizes.values())
    train, val = split_sizes(total)
    offsets, at = [], 0
    for b in range(4096):
        offsets.append(at)
        at += sizes.get(b, 0)
    before = F.element_at(F.array(*map(F.lit, offsets)), F.col("_b") + 1)
    rank = before + F.row_number().over(Window.partitionBy("_b").orderBy(F.col("_h").bitwiseAND(F.lit((1 << 52) - 1)), call))
    return hashed.select(call, F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test").alias("split"))


def manifest(segments: DataFrame, splits: DataFrame, call: str, order: list[str], rate: int = 16_000, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """call, split, audio_filepath, text and duration of utterances with text and 0.2 s or more, numbered per split; ``keep`` columns stay.

    Numbers follow the hash order of the calls, as the split does: utterances are ranked within 4096 hash ranges
    a split, and a range's offset comes from the counts of those before it.
    """
    kept = segments.where("trim(coalesce(text, '')) <> '' and end - start >= 0.2").join(splits, call)
    kept = kept.withColumn("_h", F.xxhash64(F.lit(seed), F.col(call))).withColumn("_b", F.shiftrightunsigned("_h", 52).cast("int"))
    at, offsets = {}, []
    for r in sorted(kept.groupBy("split", "_b").count().collect()):  # at most 3 * 4096 rows
        offsets.append((r["split"], r["_b"], at.get(r["split"], 0)))
        at[r["split"]] = offsets[-1][2] + r["count"]
    before = segments.sparkSession.createDataFrame(offsets, "split string, _b int, _before long")
    # Java's signed order of the hash would not follow the ranges, which are by its unsigned top bits.
    within = Window.partitionBy("split", "_b").orderBy(F.col("_h").bitwiseAND(F.lit((1 << 52) - 1)), *order)
    numbered = kept.join(F.broadcast(before), ["split", "_b"]).withColumn("_n", F.col("_before") + F.row_number().over(within) - 1)
    samples = F.rint(F.col("end") * rate) - F.rint(F.col("start") * rate)
    return numbered.select(call, "split", F.format_string("%s_%06d.wav", F.col("split"), F.col("_n")).alias("audio_filepath"), F.trim("text").alias("text"), (samples / rate).alias("duration"), *keep)


def split_summary(segments: DataFrame, splits: DataFrame, call: str) -> DataFrame:
    """split, calls, utterances and hours."""
    usable = F.expr("case when trim(coalesce(text, '')) <> '' and end - start >= 0.2 then 1 else 0 end")
    each = segments.groupBy(call).agg(F.sum(usable).alias("utterances"), F.sum(F.col("end") - F.col("start")).alias("seconds"))
    return each.join(splits, call).groupBy("split").agg(F.count("*").alias("calls"), F.sum("utterances").alias("utterances"), (F.sum("seconds") / 3600).alias("hours"))
