"""Documents made from transcripts: plain text, subtitles, JSON, Markdown and the readable copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import end_sentence
from parley.functions.timing import clock

KINDS = ("txt", "raw", "verbatim", "readable", "srt", "json", "md")


def _lines(segments: Column, line) -> Column:
    return F.array_join(F.transform(segments, line), "\n")


def _end(text: Column) -> Column:
    return F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n"))


def _name(source: Column) -> Column:
    return F.regexp_replace(source, r"^.*[/\\]", "")


def _stem(source: Column) -> Column:
    return F.regexp_replace(_name(source), r"(?<=.)\.[^.]*$", "")


def _confidence() -> Column:
    p = F.col("language_probability")
    return F.when(p != 0, F.concat(F.rint(p * 100).cast("int").cast("string"), F.lit("%"))).otherwise("n/a")


def _who(s: Column, form: str = "%s: ") -> Column:
    return F.when(F.coalesce(s["speaker"], F.lit("")) != "", F.format_string(form, s["speaker"])).otherwise("")


def text_line(s: Column) -> Column:
    tag = lambda c: F.when(s[c], F.lit(f"[{c}] ")).otherwise("")
    return F.concat(F.lit("["), clock(s["start"]), F.lit("] "), _who(s), tag("overlap"), tag("uncertain"), s["text"])


def text_document(segments: Column) -> Column:
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Source: "), _name(F.col("source"))),
        F.concat(F.lit("Language: "), F.col("language"), F.lit(" (confidence: "), _confidence(), F.lit(")")),
        F.concat(F.lit("Model: "), F.col("model")),
        F.concat(F.lit("Device: "), F.col("device")),
        F.concat(F.lit("Duration: "), clock(F.col("duration_seconds"))),
        F.lit(""),
    )
    return _end(F.concat_ws("\n", head, _lines(segments, text_line)))


def srt_document(segments: Column) -> Column:
    block = lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), clock(s["start"], srt=True), F.lit(" --> "), clock(s["end"], srt=True), F.lit("\n"), _who(s), s["text"])
    return _end(F.array_join(F.transform(segments, block), "\n\n"))


def markdown_document(segments: Column) -> Column:
    line = lambda s: F.concat(F.lit("- `"), clock(s["start"]), F.lit("`"), _who(s, " **%s:**"), F.when(s["overlap"], " `[overlap]`").otherwise(""), F.lit(" "), s["text"])
    head = F.concat(
        F.lit("# Transcript: "), _name(F.col("source")), F.lit("\n\n- Language: `"), F.col("language"), F.lit("` (confidence: "), _confidence(), F.lit(")\n- Model: `"), F.col("model"),
        F.lit("`\n- Device: `"), F.col("device"), F.lit("`\n- Duration: `"), clock(F.col("duration_seconds")), F.lit("`\n\n## Conversation\n"),
    )
    return _end(F.concat_ws("\n", head, _lines(segments, line)))


def json_document() -> Column:
    """The whole transcript, nulls included."""
    cols = ("source", "model", "device", "language", "language_probability", "duration_seconds", "text", "readable_text", "diagnostics", "provenance", "segments", "raw_segments")
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def readable_text(segments: Column) -> Column:
    """Speaker, uncertainty tag and sentence of every segment, a line each."""
    line = lambda s: F.concat(_who(s), F.when(s["uncertain"], "[uncertain] ").otherwise(""), end_sentence(s["text"]))
    return F.trim(_lines(segments, line))


def documents(transcripts: DataFrame) -> DataFrame:
    """source, kind, filename and content: seven documents of every transcript (with defaults)."""
    raw = F.when(F.size("raw_segments") > 0, F.col("raw_segments")).otherwise(F.col("segments"))
    readable = F.when(F.coalesce("readable_text", F.lit("")) != "", F.col("readable_text")).otherwise(F.col("text"))
    content = {
        "txt": text_document(F.col("segments")),
        "raw": text_document(raw),
        "verbatim": text_document(F.col("segments")),
        "readable": F.concat(F.lit("Source: "), _name(F.col("source")), F.lit("\nType: readable standard-Hindi copy\n\n"), F.trim(readable), F.lit("\n")),
        "srt": srt_document(F.col("segments")),
        "json": F.concat(json_document(), F.lit("\n")),
        "md": markdown_document(F.col("segments")),
    }
    ending = {"txt": ".transcript.txt", "raw": ".raw.txt", "verbatim": ".verbatim.txt", "readable": ".readable.txt", "srt": ".transcript.srt", "json": ".transcript.json", "md": ".transcript.md"}
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.concat(_stem(F.col("source")), F.lit(ending[k])).alias("filename"), content[k].alias("content")) for k in KINDS))
    return transcripts.select("source", F.inline(each))


def write_documents(transcripts: DataFrame, path: str) -> None:
    """Writes all documents as a table partitioned by kind; ``filename`` names each."""
    documents(transcripts).write.mode("overwrite").partitionBy("kind").parquet(path)
