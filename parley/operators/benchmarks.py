"""Benchmarks: items in the order of their manifest, gold and draft segments, and reports over joined texts.

A benchmark is a few minutes of recordings, cut into items. Its texts are joined and aligned as one, which takes
time in the square of its length: one benchmark is the unit of work, and many of them run in
parallel. ``metrics.corpus_report`` adds up items instead and has no such bound.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators.metrics import call_report
from parley.operators.sessions import interval_errors

#: Seconds between two items of a joined benchmark.
GAP = 1.0


def with_offsets(items: DataFrame, by: str, order: str, gap: float = GAP) -> DataFrame:
    """Adds ``offset``: the durations and gaps of all items of the benchmark before this one. A null duration counts as 0."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("offset", F.coalesce(F.sum(F.coalesce("duration", F.lit(0.0)) + gap).over(before), F.lit(0.0)))


def moved(segments: DataFrame, offset: str = "offset") -> DataFrame:
    """Segments later by ``offset``; only ``start`` and ``end`` change, not the times of nested words."""
    return segments.withColumns({"start": F.col("start") + F.col(offset), "end": F.col("end") + F.col(offset)})


def joined_report(items: DataFrame, reference: DataFrame, hypothesis: DataFrame, by: str, item: str, names: Iterable[str] = (), gap: float = GAP) -> DataFrame:
    """One report per benchmark over its joined texts, and over its segments moved to the joined time.

    ``items``: by, item (which orders them), duration, ref, hyp; segments: by, item, start, end, speaker. Null texts are
    empty; segments of unknown items don't count.
    """
    placed = with_offsets(items, by, item, gap).select(by, item, "offset", "ref", "hyp")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(item, F.coalesce(c, F.lit("")).alias("t")))), lambda x: x["t"]), " ")
    texts = placed.groupBy(by).agg(text("ref").alias("ref"), text("hyp").alias("hyp"))
    at = lambda segments: moved(segments.join(placed.select(by, item, "offset"), [by, item])).select(by, "start", "end", "speaker")
    return call_report(texts, at(reference), at(hypothesis), by, names)


def with_drafts(items: DataFrame, drafts: DataFrame, item: str) -> DataFrame:
    """Items with ``draft_segments`` of the drafts (item, segments): an empty array where there is none or it couldn't be read."""
    kind = drafts.schema["segments"].dataType
    found = drafts.groupBy(item).agg(F.first("segments", ignorenulls=True).alias("draft_segments"))
    return items.join(found, item, "left").withColumn("draft_segments", F.coalesce("draft_segments", F.array().cast(kind)))


def item_by_id(items: DataFrame, item: str, wanted: str, order: str = "item_no") -> DataFrame:
    """The first item of that id; an unknown id is an error."""
    first = items.where(F.col(item) == wanted).orderBy(order).limit(1)
    there = items.agg(F.when(F.coalesce(F.bool_or(F.col(item) == wanted), F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown item: "), F.lit(wanted))).cast("boolean")).alias("_there"))
    return there.join(first, F.col("_there"), "left").drop("_there")  # one row on either side, none of them of an input's size


def gold_texts(segments: DataFrame, by: list[str], order: str) -> DataFrame:
    """The reference text of each item: its gold segments' texts as they stand, joined by a space."""
    entry = F.struct(order, F.coalesce("text", F.lit("")).alias("t"))
    return segments.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), " ").alias("text"))


def save_gold(segments: DataFrame, item: str, seq: str, duration: str = "duration") -> tuple[DataFrame, DataFrame]:
    """(kept, items): gold segments with text, trimmed, and each item's ``complete``.

    Segments out of order or outside of their clip are an error, blank ones too; a blank speaker is null. An item whose
    segments are all blank is not complete.
    """
    wrong = interval_errors(segments, item, seq, duration).agg(F.count("*").alias("_wrong"))
    checked = segments.join(F.broadcast(wrong), F.when(F.col("_wrong") == 0, F.lit(True)).otherwise(F.raise_error(F.lit("gold segments must be ordered and inside the clip")).cast("boolean")))  # one row
    trimmed = checked.withColumns({"text": F.trim(F.coalesce("text", F.lit(""))), "speaker": F.nullif(F.trim("speaker"), F.lit(""))}).drop("_wrong")
    return trimmed.where("text <> ''"), trimmed.groupBy(item).agg(F.bool_or(F.col("text") != "").alias("complete"))


def result_documents(reports: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``content``: a report's other columns as one JSON document, nulls included."""
    rest = [c for c in reports.columns if c not in keys]
    return reports.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("content"))
