"""Joins of words, segments and turns by time within a call.

A row has ``start`` and ``end`` in seconds from the start of its call; rows of two tables meet if they
overlap or by the distance of their midpoints. Every join carries the call as an equal key
and a time bucket: rows are dealt to all buckets that they touch, so that a long call is spread
over tasks and a row only meets those of its own time. A pair is counted in the first bucket that
both touch. Null times or calls meet nothing; the joins return nothing for empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of a bucket: a few times the length of a usual turn.
BUCKET = 64.0


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def _dealt(df: DataFrame, width: float) -> DataFrame:
    """A row for each bucket that [start, end] touches."""
    first, last = F.floor(F.col("start") / width), F.floor(F.greatest(F.col("start"), F.col("end")) / width)
    return df.where("start is not null and end is not null").withColumn("_b", F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, call: str, left_keys: list[str], right_keys: list[str], width: float = BUCKET) -> DataFrame:
    """Pairs with a positive overlap: the keys of both sides and ``seconds``.

    ``right_keys`` must not share names with the left ones, but for ``call``.
    """
    a = _dealt(left.select(call, "start", "end", *left_keys), width)
    b = _dealt(right.select(call, F.col("start").alias("_s"), F.col("end").alias("_e"), *right_keys).withColumns({"start": F.col("_s"), "end": F.col("_e")}), width).drop("start", "end")
    pairs = a.join(b, [call, "_b"]).where((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")))
    once = pairs.where(F.col("_b") == F.floor(F.greatest("start", "_s") / width))
    return once.select(call, *left_keys, *right_keys, overlap(F.col("start"), F.col("end"), F.col("_s"), F.col("_e")).alias("seconds"))


def nearest(left: DataFrame, right: DataFrame, call: str, key: str, order: str, value: str, width: float = BUCKET) -> DataFrame:
    """For each left row the ``value`` of the right row of its call whose midpoint is nearest; ties by ``order``.

    Right midpoints before and after are found by one pass over both tables in order of time: the last
    right row not after a left one, and the first after it. Of equal midpoints the first by ``order``
    counts. The pass is a window over a call's rows with running frames, which spill.
    """
    middle = (F.col("start") + F.col("end")) / 2
    points = right.select(call, middle.alias("_m"), F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("_r"))
    points = points.groupBy(call, "_m").agg(F.min("_r").alias("_r"))
    marked = points.select(call, "_m", F.lit(0).alias("_side"), F.struct("_m", "_r").alias("_p"), F.lit(None).cast(left.schema[key].dataType).alias(key))
    asked = left.select(call, middle.alias("_m"), F.lit(1).alias("_side"), F.lit(None).cast(marked.schema["_p"].dataType).alias("_p"), key)
    both = marked.unionByName(asked)
    back = Window.partitionBy(call).orderBy("_m", "_side")
    ahead = Window.partitionBy(call).orderBy(F.desc("_m"), F.desc("_side"))
    met = both.withColumns({"_before": F.last("_p", ignorenulls=True).over(back), "_after": F.last("_p", ignorenulls=True).over(ahead)}).where("_side = 1")
    far = lambda p: F.abs(F.col("_m") - F.col(p)["_m"])
    first = far("_before") < far("_after")
    tied = (far("_before") == far("_after")) & (F.col("_before")["_r"]["o"] <= F.col("_after")["_r"]["o"])
    chosen = F.when(F.col("_after").isNull() | first | tied, F.col("_before")).otherwise(F.col("_after"))
    return met.select(call, key, chosen["_r"]["v"].alias(value)).where(F.col(value).isNotNull())


def assign_speakers(words: DataFrame, turns: DataFrame, call: str, key: str, turn_no: str) -> DataFrame:
    """call, key and ``speaker``: whose turns overlap the word most, else the nearest turn's.

    Ties go to the speaker whose first turn comes first. ``turn_no`` orders the turns of a call.
    """
    named = turns.where("speaker is not null").withColumnRenamed("speaker", "_speaker")
    seen = named.groupBy(call, "_speaker").agg(F.min(turn_no).alias("_first"))
    # A word's pairs are dealt once, by the word: both aggregates then find them in place.
    met = overlapping(words, named.join(seen, [call, "_speaker"]), call, [key], ["_speaker", "_first"]).repartition(call, key)
    scored = met.groupBy(call, key, "_speaker").agg(F.sum("seconds").alias("_s"), F.first("_first").alias("_first"))
    # The best speaker by an aggregate: no sort of a word's speakers.
    best = scored.groupBy(call, key).agg(F.max_by("_speaker", F.struct("_s", (-F.col("_first")).alias("f"))).alias("speaker"))
    rest = words.join(best.select(call, key), [call, key], "left_anti")
    return best.select(call, key, "speaker").unionByName(nearest(rest, turns, call, key, turn_no, "speaker"))


def overlap_flags(words: DataFrame, turns: DataFrame, call: str, key: str) -> DataFrame:
    """call, key of words of which other speakers than the loudest cover half or more."""
    length = F.greatest(F.lit(0.001), F.col("end") - F.col("start"))
    met = overlapping(words.withColumn("_length", length), turns.withColumnRenamed("speaker", "_speaker"), call, [key, "_length"], ["_speaker"]).repartition(call, key)
    each = met.groupBy(call, key, "_speaker").agg(F.sum("seconds").alias("_s"), F.first("_length").alias("_length"))
    other = each.groupBy(call, key).agg((F.sum("_s") - F.max("_s")).alias("_other"), F.first("_length").alias("_length"))
    return other.where("_other >= 0.5 * _length").select(call, key)


def attribution(reference: DataFrame, hypothesis: DataFrame, call: str) -> DataFrame:
    """call, ``scored`` and ``correct`` seconds and ``speaker_accuracy`` of every call of the reference.

    Every overlap of a labelled reference segment with a hypothesis segment is scored; without any
    the accuracy is 1.0.
    """
    ref = reference.where("coalesce(speaker, '') <> ''").select(call, "start", "end", F.col("speaker").alias("_ref"))
    met = overlapping(ref, hypothesis.withColumnRenamed("speaker", "_hyp"), call, ["_ref"], ["_hyp"])
    summed = met.groupBy(call).agg(F.sum("seconds").alias("scored"), F.sum(F.when(F.col("_ref").eqNullSafe(F.col("_hyp")), F.col("seconds")).otherwise(0.0)).alias("correct"))
    out = reference.select(call).distinct().join(summed, call, "left").fillna(0.0, ["scored", "correct"])
    return out.withColumn("speaker_accuracy", F.when(F.col("scored") > 0, F.try_divide("correct", "scored")).otherwise(1.0))


def crosstalk(turns: DataFrame, call: str, turn_no: str) -> DataFrame:
    """call and ``overlap_seconds`` summed over pairs of turns of different speakers."""
    other = turns.select(call, "start", "end", F.col("speaker").alias("_speaker"), F.col(turn_no).alias("_no"))
    met = overlapping(turns, other, call, ["speaker", turn_no], ["_speaker", "_no"]).where((F.col(turn_no) < F.col("_no")) & ~F.col("speaker").eqNullSafe(F.col("_speaker")))
    return turns.select(call).distinct().join(met.groupBy(call).agg(F.sum("seconds").alias("overlap_seconds")), call, "left").fillna(0.0, ["overlap_seconds"])


def near_boundaries(words: DataFrame, turns: DataFrame, durations: DataFrame, call: str, within: float = 0.25) -> DataFrame:
    """call and ``ambiguous_words``: words whose midpoint is ``within`` seconds of a turn's edge inside the call."""
    inner = turns.join(durations.select(call, "duration"), call).select(call, "duration", F.explode(F.array("start", "end")).alias("edge")).where("edge > 0 and edge < duration")
    # Edges reach ``within`` to either side; buckets of a second keep a word's candidates few.
    reach = inner.select(call, "edge").distinct().withColumn("_b", F.explode(F.sequence(F.floor(F.col("edge") - within), F.floor(F.col("edge") + within))))
    asked = words.withColumn("_m", (F.col("start") + F.col("end")) / 2).withColumn("_b", F.floor("_m"))
    near = asked.alias("w").join(reach.alias("e"), (F.col(f"w.{call}") == F.col(f"e.{call}")) & (F.col("w._b") == F.col("e._b")) & (F.abs(F.col("_m") - F.col("edge")) <= within), "left_semi")
    return durations.select(call).distinct().join(near.groupBy(call).agg(F.count("*").alias("ambiguous_words")), call, "left").fillna(0, ["ambiguous_words"])


def friendly_labels(turns: DataFrame, call: str, turn_no: str, names: tuple[str, ...] = ("Speaker 1", "Speaker 2")) -> DataFrame:
    """call, speaker and ``label``: the n-th name by first appearance, then Speaker n."""
    first = turns.groupBy(call, "speaker").agg(F.min("start").alias("_s"), F.min(turn_no).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(call).orderBy("_s", "_n"))
    named = F.coalesce(F.get(F.array(*map(F.lit, names)), rank - 1), F.concat(F.lit("Speaker "), rank.cast("string")))
    return first.select(call, "speaker", named.alias("label"))


def span_context(spans: DataFrame, segments: DataFrame, call: str, span_no: str, seg_no: str, limit: int = 600) -> DataFrame:
    """call, span_no and ``context``: the two segments before and the two after a span, the last ``limit`` characters.

    Before are the last two by ``seg_no`` of those that end at or before the span's start, after the first two of those that
    start at or after its end. Both are found by one pass over spans and segments in order of time: running
    frames keep the two greatest (or least) so far, so a span meets no segment but its own four.
    """
    entry = F.struct(F.col(seg_no).alias("no"), F.col("text").alias("text"))
    kind = f"array<{segments.select(entry.alias('e')).schema['e'].dataType.simpleString()}>"
    at = segments.where("start is not null and end is not null").select(call, "start", "end", entry.alias("_e"))
    asked = spans.select(call, span_no, F.col("start").alias("_s"), F.col("end").alias("_t"))
    none = F.lit(None).cast(at.schema["_e"].dataType)
    key = F.lit(None).cast(spans.schema[span_no].dataType)

    def two(edge: str, bound: str, last: bool) -> DataFrame:
        rows = at.select(call, F.col(edge).alias("_m"), F.lit(0).alias("_side"), "_e", key.alias(span_no))
        rows = rows.unionByName(asked.select(call, F.col(bound).alias("_m"), F.lit(1).alias("_side"), none.alias("_e"), span_no))
        # A segment counts at the very edge of a span too, so it comes first among equal times.
        order = ["_m", "_side", "_e"] if last else [F.desc("_m"), "_side", "_e"]
        so_far = Window.partitionBy(call).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        best = F.max("_e") if last else F.min("_e")
        marked = rows.withColumn("_one", best.over(so_far))
        # The second is the best of those that were beaten: by a later row, or when they came.
        prior = F.lag("_one").over(Window.partitionBy(call).orderBy(*order))
        beats = (F.col("_e") > F.col("_prior")) if last else (F.col("_e") < F.col("_prior"))
        beaten = F.when(F.col("_e").isNull() | F.col("_prior").isNull(), none).when(beats, F.col("_prior")).otherwise(F.col("_e"))
        marked = marked.withColumn("_prior", prior).withColumn("_beaten", beaten)
        second = (F.max("_beaten") if last else F.min("_beaten")).over(so_far)
        found = marked.withColumn("_two", second).where("_side = 1")
        return found.select(call, span_no, F.array_sort(F.array_compact(F.array("_one", "_two")).cast(kind)).alias("_before" if last else "_after"))

    texts = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["text"]), " "), F.lit(""))
    met = spans.select(call, span_no).join(two("end", "_s", True).join(two("start", "_t", False), [call, span_no]), [call, span_no], "left")
    whole = F.concat(F.lit("Previous: "), texts("_before"), F.lit("\nFollowing: "), texts("_after"))
    return met.select(call, span_no, F.right(whole, F.lit(limit)).alias("context"))
