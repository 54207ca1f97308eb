"""Alignment of two transcripts of a call and their conservative consensus."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.bits import align
from parley.functions.once import with_once

PATH = "array<struct<i:int,j:int>>"


def _paths(left: pa.Array, right: pa.Array) -> pa.Array:
    ends, i, j = [0], [], []
    for a, b in zip(left, right, strict=True):
        found = align(a.as_py() or [], b.as_py() or [])
        i += [x for x, _ in found]
        j += [y for _, y in found]
        ends.append(len(i))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["i", "j"]))


def _steps(a: DataFrame, b: DataFrame, call: str, no: str, token: str, a_cols: list[str], b_cols: list[str]) -> DataFrame:
    """call, ``step``, ``a`` and ``b`` (null: unmatched), structs of ``no`` (as ``_no``), ``token`` (as ``_token``) and the columns named: the cheapest edit path of each call's tokens.

    A call is one row with both transcripts' words in order. Only tokens go to Python, many calls a batch, and the path's
    places come back; the words stay in the row, so that no join has to find them.
    """

    def side(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        word = F.struct(F.col(no).alias("_no"), F.monotonically_increasing_id().alias("_at"), F.col(token).alias("_token"), *cols)
        return df.select(F.col(call).alias("_call"), word.alias("_w")).groupBy("_call").agg(F.sort_array(F.collect_list("_w")).alias(name))

    met = side(a, a_cols, "_a").withColumnRenamed("_call", "_k").join(side(b, b_cols, "_b"), F.col("_k").eqNullSafe(F.col("_call")), "full")
    met = with_once(met.select(F.coalesce("_k", "_call").alias(call), "_a", "_b"), {"_x": F.col("_a._token"), "_y": F.col("_b._token")})
    path = met.select(call, "_a", "_b", F.arrow_udf(_paths, PATH)("_x", "_y").alias("_p"))
    words = F.transform("_p", lambda p, n: F.struct(n.cast("int").alias("step"), F.get("_a", p["i"]).alias("a"), F.get("_b", p["j"]).alias("b")))
    return path.select(call, F.inline(words))


def align_words(a: DataFrame, b: DataFrame, call: str, no: str = "word_no", token: str = "token") -> DataFrame:
    """call, ``a_no``, ``b_no`` (null: unmatched) and ``step``: the cheapest edit path of each call's tokens.

    Two transcripts of one call meet in a task as two columns; a call that only one has is unmatched. Of equal costs
    a pair comes first, then a token of ``a`` alone, seen from the end.
    """
    return _steps(a, b, call, no, token, [], []).select(call, F.col("a._no").cast("int").alias("a_no"), F.col("b._no").cast("int").alias("b_no"), "step")


def alignment_cost(a: DataFrame, b: DataFrame, call: str, no: str = "word_no", token: str = "token") -> DataFrame:
    """call, ``n_steps`` and ``cost``, the steps of the edit path that don't pair equal tokens."""
    met = _steps(a, b, call, no, token, [], [])
    same = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a._token").eqNullSafe(F.col("b._token"))
    return met.groupBy(call).agg(F.count("*").alias("n_steps"), F.count(F.when(~same, 1)).alias("cost"))


def consensus_words(a: DataFrame, b: DataFrame, call: str, margin: float = 0.15, sure: float = 0.85) -> DataFrame:
    """Words of the consensus in order (``step``): the first transcript's but for confident disagreement.

    Both: call, word_no, token, text, start, end, confidence, speaker, overlap. Words only the second has
    come in at a confidence of ``sure``; where both differ the second's counts at ``margin`` over the first's
    (0.5 where unknown), and takes the first's time and speaker.
    """
    cols = ["token", "text", "start", "end", "confidence", "speaker", "overlap"]
    met = _steps(a, b, call, "word_no", "token", cols, cols)
    only_b = F.col("a").isNull()
    swap = F.col("b").isNotNull() & (F.col("a.token") != F.col("b.token")) & (F.coalesce("b.confidence", F.lit(0.5)) >= F.coalesce("a.confidence", F.lit(0.5)) + margin)
    text_of_b = only_b | F.coalesce(swap, F.lit(False))
    pick = lambda c: F.when(only_b, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    word = lambda c: F.when(text_of_b, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    kept = met.where(~only_b | (F.coalesce("b.confidence", F.lit(0.0)) >= sure))
    return kept.select(call, "step", word("text").alias("text"), pick("start").alias("start"), pick("end").alias("end"), word("confidence").alias("confidence"), pick("speaker").alias("speaker"), pick("overlap").alias("overlap"), text_of_b.alias("from_second"))
