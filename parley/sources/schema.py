"""Schemas of transcripts, nested as they are exchanged and flat as they are worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType()}


def _struct(**kinds) -> T.StructType:
    """A struct of fields by name; kinds are names of simple types or types. Needs no session, unlike parsed DDL."""
    return T.StructType([T.StructField(name, _TYPES.get(kind, kind) if isinstance(kind, str) else kind) for name, kind in kinds.items()])


_TIMED = {"start": "double", "end": "double", "text": "string"}
WORD = _struct(
    **_TIMED, confidence="double", speaker="string", overlap="boolean", origin="string", alternatives=T.ArrayType(T.StringType()), uncertain="boolean", repetition_removed="boolean"
)
SEGMENT = _struct(**_TIMED, speaker="string", confidence="double", overlap="boolean", uncertain="boolean", words=T.ArrayType(WORD))
_TRANSCRIPT = {
    **dict.fromkeys(("source", "model", "device", "language"), "string"),
    **dict.fromkeys(("language_probability", "duration_seconds"), "double"),
    **dict.fromkeys(("text", "readable_text"), "string"),
    "segments": T.ArrayType(SEGMENT),
    "raw_segments": T.ArrayType(SEGMENT),
    "diagnostics": T.MapType(T.StringType(), T.StringType()),
    "provenance": T.ArrayType(T.StringType()),
}
TRANSCRIPT = _struct(**_TRANSCRIPT)
CORRECTION = _struct(
    **_TRANSCRIPT,
    correction_metadata=_struct(training_eligible="boolean", held_out="boolean", split_group="string", verified="boolean", tags=_struct(dialect="string", noise="string")),
)
_ITEM = _struct(
    id="string", audio="string", source_name="string", source_start="double", source_end="double", duration="double",
    gold_segments=T.ArrayType(_struct(**_TIMED, speaker="string")), complete="boolean",
)
MANIFEST = _struct(version="int", held_out="boolean", training_excluded="boolean", duration_seconds="double", items=T.ArrayType(_ITEM))


def _word(w: Column) -> Column:
    required = lambda c: F.when(w[c].isNotNull(), w[c]).otherwise(F.raise_error(F.lit(f"a word has no {c}")).cast(WORD[c].dataType))
    return F.struct(
        *(required(c).alias(c) for c in ("start", "end", "text")),
        w["confidence"].alias("confidence"),
        w["speaker"].alias("speaker"),
        F.coalesce(w["overlap"], F.lit(False)).alias("overlap"),
        F.coalesce(w["origin"], F.lit("primary")).alias("origin"),
        F.coalesce(w["alternatives"], F.array().cast("array<string>")).alias("alternatives"),
        F.coalesce(w["uncertain"], F.lit(False)).alias("uncertain"),
        F.coalesce(w["repetition_removed"], F.lit(False)).alias("repetition_removed"),
    )


def _segment(s: Column) -> Column:
    required = lambda c: F.when(s[c].isNotNull(), s[c]).otherwise(F.raise_error(F.lit(f"a segment has no {c}")).cast(SEGMENT[c].dataType))
    return F.struct(
        *(required(c).alias(c) for c in ("start", "end", "text")),
        s["speaker"].alias("speaker"),
        s["confidence"].alias("confidence"),
        F.coalesce(s["overlap"], F.lit(False)).alias("overlap"),
        F.coalesce(s["uncertain"], F.lit(False)).alias("uncertain"),
        F.coalesce(F.transform(s["words"], _word), F.array().cast(T.ArrayType(WORD))).alias("words"),
    )


def text_of(segments: Column) -> Column:
    """A transcript's text: its segments' texts, trimmed, joined by a space."""
    return F.trim(F.array_join(F.transform(segments, lambda s: F.trim(s["text"])), " "))


def with_defaults(transcripts: DataFrame) -> DataFrame:
    """Missing values replaced by their defaults; a missing source or segment time or text is an error."""
    segments = lambda c: F.coalesce(F.transform(c, _segment), F.array().cast(T.ArrayType(SEGMENT)))
    source = F.when(F.col("source").isNotNull(), F.col("source")).otherwise(F.raise_error(F.lit("a transcript has no source")).cast("string"))
    made = transcripts.withColumns({"source": source, "segments": segments("segments"), "raw_segments": segments("raw_segments")})
    blank = {c: F.coalesce(c, F.lit("")) for c in ("model", "device", "language")}
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("language_probability", "duration_seconds")}
    return made.withColumns(
        blank | zero | {"text": text_of(F.col("segments")), "diagnostics": F.coalesce("diagnostics", F.create_map().cast("map<string,string>")), "provenance": F.coalesce("provenance", F.array().cast("array<string>"))}
    )


def flat_segments(transcripts: DataFrame, call: str = "source", of: str = "segments") -> DataFrame:
    """One row per segment: call, ``seg_no`` from 0 and the segment's columns."""
    return transcripts.select(F.col(call), F.posexplode(of).alias("seg_no", "_s")).select(call, "seg_no", "_s.*")


def flat_words(segments: DataFrame, call: str = "source") -> DataFrame:
    """One row per word of flat segments: call, ``seg_no``, ``word_no`` and the word's columns."""
    return segments.select(call, "seg_no", F.posexplode("words").alias("word_no", "_w")).select(call, "seg_no", "word_no", "_w.*")


def nest_segments(segments: DataFrame, call: str, order: list[str], cols: list[str]) -> DataFrame:
    """call and ``segments``: an array of structs in order."""
    entry = F.struct(*order, F.struct(*cols).alias("_s"))
    return segments.groupBy(call).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["_s"]).alias("segments"))
