"""Transcript-shaped inputs made from the driver's tables, in Spark and as SQL common table expressions.

A conversation is a call and a turn a segment, at 16 characters a second: all times are whole
sixteenths, so sums are exact in any order. Conversations are recordings: one call is worked on in
order of time and its rows are few; many calls spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.timing import proportional_words, words_of

NAMES = ("Thea", "einen", "que la", "zzzz")
GLOSSARY = ("the",)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call, seg_no, speaker, text, start, end."""
    t = F.coalesce("text", F.lit(""))
    end = F.sum(F.length(t)).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", t.alias("text"), end.alias("_e"))
    return rows.select(F.col("conv_id").alias("call"), F.col("turn").alias("seg_no"), F.col("role").alias("speaker"), "text", ((F.col("_e") - F.length("text")) / 16).alias("start"), (F.col("_e") / 16).alias("end"))


def without_every(text: Column, n: int) -> Column:
    """A text without every n-th word."""
    return F.array_join(F.filter(words_of(text), lambda x, i: (i + 1) % n != 0), " ")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call, seg_no, word_no, text, start, end, confidence, speaker, overlap, uncertain; ``seq`` orders a call's words."""
    seg = segments(spark, sf_dir)
    found = proportional_words(seg, ["call", "seg_no", "speaker"])
    confidence = ((F.col("call") * 31 + F.col("seg_no") * 7 + F.col("word_no")) % 16) / 16
    return found.select("call", "seg_no", "word_no", (F.col("seg_no") * 1_000_000 + F.col("word_no")).alias("seq"), F.col("word").alias("text"), F.col("word_start").alias("start"), F.col("word_end").alias("end"), confidence.alias("confidence"), "speaker", F.lit(False).alias("overlap"), F.lit(False).alias("uncertain"))


def turns(spark: SparkSession, sf_dir: str, shift: float = 0.25) -> DataFrame:
    """Turns of one speaker at a time: segments moved by ``shift``."""
    return segments(spark, sf_dir).select("call", F.col("seg_no").alias("turn_no"), "speaker", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))


def raw_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that overlap: segments half a second longer on either side."""
    return segments(spark, sf_dir).select("call", F.col("seg_no").alias("turn_no"), "speaker", F.greatest(F.lit(0.0), F.col("start") - 0.5).alias("start"), (F.col("end") + 0.5).alias("end"))


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call (user), seq, speaker (event type), start and end in microseconds, a minute each."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("call"), F.col("event_id").alias("seq"), F.col("event_type").alias("speaker"), micros.alias("start"), (micros + 60_000_000).alias("end"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per call with nested segments, as the exports take them."""
    s = segments(spark, sf_dir).withColumns({"overlap": F.col("seg_no") % 3 == 2, "uncertain": F.col("seg_no") % 4 == 3})
    entry = F.struct("seg_no", F.struct("start", "end", "text", "speaker", F.lit(None).cast("double").alias("confidence"), "overlap", "uncertain").alias("s"))
    grouped = s.groupBy("call").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["s"]).alias("segments"), F.max("end").alias("duration_seconds"))
    return grouped.select(
        "call",
        F.concat(F.lit("calls/call-"), F.col("call").cast("string"), F.lit(".wav")).alias("source"),
        F.lit("base").alias("model"),
        F.lit("cpu").alias("device"),
        F.lit("en").alias("language"),
        F.lit(0.75).alias("language_probability"),
        "duration_seconds",
        F.trim(F.array_join(F.transform("segments", lambda x: F.trim(x["text"])), " ")).alias("text"),
        F.lit(None).cast("string").alias("readable_text"),
        F.create_map().cast("map<string,string>").alias("diagnostics"),
        F.array().cast("array<string>").alias("provenance"),
        "segments",
        F.slice("segments", 1, 1).alias("raw_segments"),
    )


#: Samples a second of the recordings below: 16 a character, as texts run at 16 characters a second.
RATE = 256


#: Bytes of samples that go to Spark at once: a batch of texts is small, their waveforms are 64 times larger.
SPOKEN_BYTES = 4 << 20


def wave(text: str | None, repeat: int = 16) -> np.ndarray:
    """A text's samples: a character is ``repeat`` equal ones, its code's last byte as a level from -1 to 1."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    return np.repeat((codes.astype(np.float32) % 256 - 128) / 128, repeat).astype("<f4")


def spoken(text: Column, repeat: int = 16) -> Column:
    """A text as a waveform, ``wave``'s samples."""

    def one(t: str | None) -> bytes:
        return wave(t, repeat).tobytes()

    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            size = texts.map(lambda t: 4 * repeat * len(t or "")).cumsum()
            for _, part in texts.groupby(size // SPOKEN_BYTES):
                yield part.map(one)

    return F.pandas_udf(make, "binary")(text)


SEG = """seg AS (SELECT conv_id AS call, turn AS seg_no, role AS speaker, coalesce(text, '') AS text,
  CAST(sum(length(coalesce(text, ''))) OVER w - length(coalesce(text, '')) AS DOUBLE) / 16 AS s, CAST(sum(length(coalesce(text, ''))) OVER w AS DOUBLE) / 16 AS e
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""
SPLIT = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"
WRD = f"""{SEG}, sw AS (SELECT *, {SPLIT.format("text")} AS w FROM seg WHERE e > s),
wi AS (SELECT *, unnest(range(1, len(w) + 1)) AS i, list_sum(list_transform(w, lambda x: length(x))) AS n FROM sw),
wb AS (SELECT *, coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS b FROM wi),
wrd AS (SELECT call, seg_no, CAST(i - 1 AS INT) AS word_no, seg_no * 1000000 + i - 1 AS seq, w[i] AS text, speaker, s + (e - s) * b / n AS ws,
  greatest(s + (e - s) * b / n + 0.001, CASE WHEN i = len(w) THEN e ELSE s + (e - s) * (b + length(w[i])) / n END) AS we FROM wb)"""
NORM = "trim(regexp_replace(lower(replace(replace(translate({0}, '०१२३४५६७८९', '0123456789'), 'ß', 'ss'), 'ẞ', 'ss')), '[^\\p{{L}}\\p{{N}}_\\x{{0900}}-\\x{{097F}}]+', ' ', 'g'))"
TOKENS = "list_filter(list_transform(string_split_regex(lower(replace(coalesce({0}, ''), 'ß', 'ss')), '\\s+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}\\x{{0900}}-\\x{{097F}}]', '', 'g')), lambda x: x <> '')"


def norm_sql(text: str) -> str:
    return NORM.format(text)


def tokens_sql(text: str) -> str:
    return TOKENS.format(text)


def without_sql(text: str, n: int) -> str:
    return f"array_to_string(list_filter({SPLIT.format(text)}, lambda x, i: i % {n} <> 0), ' ')"


def list_of(normalized: str) -> str:
    return f"(CASE WHEN {normalized} = '' THEN [] ELSE string_split({normalized}, ' ') END)"
