"""Edit distance over token arrays, word and character error rates.

Texts of close spelling are settled by the JVM's ``levenshtein`` in a narrow band; all others by whole columns of bits
(``bits.distance``) in Arrow functions, whose memory is a few times the longer text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.bits import distance
from parley.functions.once import with_once
from parley.functions.text import canonical_numbers, normalize, split_tokens

#: Differences up to which the JVM compares two texts by itself.
BAND = 24


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays; null if either is null."""

    def run(left, right):
        import pyarrow as pa

        return pa.array([None if x is None or y is None else distance(x, y) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.int32())

    return F.arrow_udf(run, "int")(a, b)


def with_distance(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds the edit distance of the token arrays ``a`` and ``b``."""
    return df.withColumn(out, token_distance(F.col(a), F.col(b)))


def text_distances(a: Column, b: Column) -> Column:
    """struct<words int, chars int>: edit distances of two normalised texts, whose tokens a space divides."""
    near = F.nullif(F.levenshtein(a, b, BAND), F.lit(-1))

    def run(left, right, known):
        import pyarrow as pa

        words, chars = [], []
        for x, y, n in zip(left.to_pylist(), right.to_pylist(), known.to_pylist(), strict=True):
            p, q = x.split(" ") if x else [], y.split(" ") if y else []
            words.append(distance(p, q))
            # Where one text only has more words, it has the other's characters in their order.
            chars.append(n if n is not None else abs(len(x) - len(y)) if words[-1] == abs(len(p) - len(q)) else distance(x, y))
        return pa.StructArray.from_arrays([pa.array(words, pa.int32()), pa.array(chars, pa.int32())], ["words", "chars"])

    return F.arrow_udf(run, "words int, chars int")(a, b, near)


def rate(distance: Column, expected: Column, actual: Column) -> Column:
    """Errors by the reference's length; of an empty reference 0 if the hypothesis is empty too, else 1."""
    return F.when(expected > 0, distance / F.greatest(expected, F.lit(1))).when(actual > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is, or over all cores if by Catalyst's estimate it is too small to fill one partition a core."""
    spark = df.sparkSession
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), spark.sparkContext.defaultParallelism
    part = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return df.repartition(cores) if size < cores * part else df


def with_normal_texts(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Adds ``_r`` and ``_h``, two text columns normalised, and ``_pr`` and ``_ph``, the same with numbers as they are (null: empty)."""
    plain = lambda c: normalize(F.coalesce(F.col(c), F.lit("")), numbers=False)
    df = with_once(df, {"_pr": plain(ref), "_ph": plain(hyp)})
    return with_once(df, {"_r": canonical_numbers(F.col("_pr")), "_h": canonical_numbers(F.col("_ph"))})


def with_normal_rates(df: DataFrame) -> DataFrame:
    """Adds what ``with_error_rates`` does to what ``with_normal_texts`` makes."""
    df = df.withColumn("_d", text_distances(F.col("_r"), F.col("_h")))
    df = df.withColumns({"n_ref": F.size(split_tokens(F.col("_r"))), "_n_hyp": F.size(split_tokens(F.col("_h"))), "word_errors": F.col("_d.words"), "char_errors": F.col("_d.chars")})
    return df.withColumns(
        {
            "wer": rate(F.col("word_errors"), F.col("n_ref"), F.col("_n_hyp")),
            "cer": rate(F.col("char_errors"), F.length("_r"), F.length("_h")),
        }
    ).drop("_d", "_n_hyp")


def with_error_rates(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Adds ``n_ref``, ``word_errors``, ``wer``, ``char_errors`` and ``cer`` of two text columns (null: empty)."""
    return with_normal_rates(with_normal_texts(spread(df), ref, hyp)).drop("_r", "_h", "_pr", "_ph")
