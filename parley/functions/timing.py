"""Clock strings and word times as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.once import let, with_once

SPACE = r"(?U)\s+"


def clock(seconds: Column, srt: bool = False) -> Column:
    """hh:mm:ss.mmm, rounded half to even, at least zero; hours go on beyond 99."""
    ms = F.greatest(F.lit(0), F.rint(seconds * 1000)).cast("long")
    mark = "," if srt else "."
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    hours = F.floor(ms / 3_600_000)
    padded = F.when(hours < 100, pad(hours, 2)).otherwise(hours.cast("string"))
    return F.concat(padded, F.lit(":"), pad(F.floor(ms / 60_000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit(mark), pad(ms % 1000, 3))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: Lengths are summed in blocks of this many words.
BLOCK = 32


def sums_before(lengths: Column) -> Column:
    """For each entry the sum of the entries before it (array<int>).

    Entries are summed by blocks, and the blocks' sums by one more pass: an aggregate that appends to an array copies
    it for every entry, so that one pass over all entries would grow with their square.
    """

    def running(items: Column, begin: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("at"), begin.alias("sum"))
        return F.aggregate(items, start, lambda s, n: F.struct(F.concat(s["at"], F.array(s["sum"])).alias("at"), (s["sum"] + n).alias("sum")), lambda s: s["at"])

    def made(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, n: s + n))
        return F.flatten(F.zip_with(blocks, running(totals, F.lit(0)), running))

    dealt = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v)), F.lit(BLOCK)), lambda i: F.slice(v, i, BLOCK))
    return let(lengths, lambda v: let(dealt(v), made))


def proportional_words(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per word of each segment (``start``, ``end``, ``text``): ``word_no`` from 0, ``word``, its start and end.

    A segment's time is shared by the words' lengths; the last ends with the segment, and no word is
    shorter than a millisecond. Segments without words or time have none.
    """
    timed = segments.where("end > start").select(*keys, "start", "end", words_of(F.col("text")).alias("_w"))
    timed = timed.select(*keys, "start", "end", "_w", F.aggregate("_w", F.lit(0), lambda s, x: s + F.length(x)).alias("_n"), F.size("_w").alias("_k"))
    # Weights before each word, within the segment's row: no shuffle.
    before = sums_before(F.transform("_w", F.length))
    each = timed.select(*keys, "start", "end", "_n", "_k", F.posexplode(F.arrays_zip(F.col("_w").alias("w"), before.alias("at"))).alias("word_no", "x"))
    span = F.col("end") - F.col("start")
    begin = F.col("start") + span * F.col("x.at") / F.col("_n")
    to = F.when(F.col("word_no") == F.col("_k") - 1, F.col("end")).otherwise(F.col("start") + span * (F.col("x.at") + F.length("x.w")) / F.col("_n"))
    return each.select(*keys, "word_no", F.col("x.w").alias("word"), begin.alias("word_start"), F.greatest(begin + 0.001, to).alias("word_end"))


def validate_words(words: DataFrame, call: str, duration: Column, order: list[str]) -> DataFrame:
    """Words (``text``, ``start``, ``end``) clamped to the last kept start and the duration; blank and empty ones go.

    A kept word starts no earlier than the last kept one. A word that is too short from its own start never stays; any other
    stays unless the last kept start is later than its own, and then it would not move that start on. So the last kept
    start is the running maximum of the starts of all words long enough by themselves, and no word waits for another.
    """
    by = Window.partitionBy(call).orderBy(*order, "start", "end", "text")
    rows = words.where(F.trim("text") != "").select(call, *order, "start", "end", "text", F.first(duration).over(by).alias("_d"))

    def clamped(rows: DataFrame, last: Column) -> DataFrame:
        begun = rows.select(call, *order, F.least("_d", F.greatest(last, "start")).alias("_s"), "start", "end", "text", "_d")
        return begun.withColumn("_e", F.least("_d", F.greatest("_s", "end"))).withColumn("_fine", ~F.isnan("_s") & ~F.isnan("_e") & (F.col("_e") - F.col("_s") >= 0.001))

    alone = clamped(rows, F.lit(0.0))
    last = F.max(F.when(F.col("_fine"), F.col("_s"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    placed = clamped(alone.withColumn("_last", F.coalesce(last, F.lit(0.0))), F.col("_last"))
    return placed.where("_fine").select(call, *order, F.col("_s").alias("start"), F.col("_e").alias("end"), "text")


def piece_words(rows: DataFrame, key: str) -> DataFrame:
    """Words from a recogniser's pieces: ``tokens``, ``timestamps``, ``logprobs``, ``text``, ``start`` and ``end`` a row.

    A piece that begins with the word mark or a space begins a word, whose confidence is the mean
    of its pieces' probabilities. Times may count from the segment or from the recording. Rows whose
    pieces don't fit their text, or whose times run backwards, are to use ``proportional_words``: they
    come back with ``fallback`` true and no word.
    """
    n = F.size("tokens")
    ordered = F.coalesce(F.forall(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 2)), lambda i: (n < 2) | (F.get("timestamps", i + 1) >= F.get("timestamps", i))), F.lit(False))
    finite = F.forall("timestamps", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = (n > 0) & (n == F.size("timestamps")) & ordered & finite
    relative = F.array_max("timestamps") <= F.col("end") - F.col("start") + 1.0
    # A row's pieces stay in the row: exploded they would each carry its arrays and text through a shuffle.
    made = {"_ok": F.coalesce(usable, F.lit(False)), "_shift": F.when(relative, F.col("start")).otherwise(0.0), "_p": F.transform("tokens", lambda t: F.translate(t, "▁", " ")), "_t": words_of(F.col("text"))}
    made = with_once(rows.select(key, "start", "end", "text", "tokens", "timestamps", "logprobs"), made)
    begins = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_p") - 1)), lambda i: (i == 0) | F.get("_p", i).startswith(" "))
    made = with_once(made, {"_b": F.when(F.col("_ok"), begins)})

    def said(b, k):
        to = F.coalesce(F.get("_b", k + 1), F.size("_p"))
        probability = F.aggregate(F.sequence(b, to - 1), F.lit(0.0), lambda s, i: s + F.exp(F.least(F.lit(0.0), F.get("logprobs", i).cast("double"))))
        at = F.least(F.col("end"), F.greatest(F.col("start"), F.get("timestamps", b) + F.col("_shift")))
        return F.struct(at.alias("at"), (probability / (to - b)).alias("confidence"), F.trim(F.array_join(F.slice("_p", b + 1, to - b), "")).alias("said"))

    made = with_once(made, {"_s": F.filter(F.transform("_b", said), lambda x: x["said"] != "")})
    timed = F.transform("_s", lambda x, k: F.struct(F.get("_t", k).alias("word"), x["at"].alias("word_start"), F.coalesce(F.get("_s", k + 1)["at"], F.col("end")).alias("word_end"), x["confidence"].alias("confidence")))
    made = with_once(made, {"_w": timed})
    good = (F.size("_s") == F.size("_t")) & (F.array_min(F.transform("_w", lambda w: (w["word_end"] > w["word_start"]).cast("int"))) == 1)
    each = made.select(key, F.posexplode_outer(F.when(good, F.col("_w"))).alias("word_no", "_x"))
    return each.select(key, "word_no", *(F.col(f"_x.{c}").alias(c) for c in ("word", "word_start", "word_end", "confidence")), F.col("word_no").isNull().alias("fallback"))


def clamp_rows(rows: DataFrame, duration: str = "duration") -> DataFrame:
    """A recogniser's segments and their nested ``words`` cut to the recording; what is then blank or empty goes.

    ``rows``: start, end, text, confidence, words (array<struct<start, end, text, confidence>>) and the recording's length (0
    or null: unknown). A null confidence is 0; a word's missing time is its segment's.
    """
    known = F.coalesce(duration, F.lit(0.0)) != 0
    cut = rows.where(~known | (F.col("start") < F.col(duration)))
    cut = cut.withColumns({"start": F.greatest(F.lit(0.0), "start"), "end": F.when(known, F.least("end", duration)).otherwise(F.col("end")), "text": F.trim("text"), "confidence": F.coalesce("confidence", F.lit(0.0))})
    clipped = F.transform(
        F.coalesce("words", F.array().cast(rows.schema["words"].dataType)),
        lambda w: F.struct(
            F.greatest(F.col("start"), F.coalesce(w["start"], F.col("start"))).alias("start"),
            F.least(F.col("end"), F.coalesce(w["end"], F.col("end"))).alias("end"),
            F.trim(F.coalesce(w["text"], F.lit(""))).alias("text"),
            F.coalesce(w["confidence"], F.lit(0.0)).alias("confidence"),
        ),
    )
    kept = cut.where("text <> '' and end > start")
    return kept.withColumn("words", F.filter(clipped, lambda w: (w["text"] != "") & (w["end"] > w["start"])))


def native_words(words: DataFrame, calls: DataFrame, call: str) -> DataFrame:
    """call, ``word_no``, start, end and text: a recogniser's own word times, or shared ones for calls that have none.

    Words with a missing or no positive length go. A call left without words has one segment as long as the recording (``calls``: call,
    duration, text), whose words share its time; without text it has none.
    """
    good = words.where("start is not null and end is not null and end > start").select(call, "word_no", "start", "end", F.trim("text").alias("text"))
    rest = calls.join(good.select(call).distinct(), call, "left_anti").select(call, F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.trim("text").alias("text"))
    shared = proportional_words(rest, [call]).select(call, "word_no", F.col("word_start").alias("start"), F.col("word_end").alias("end"), F.col("word").alias("text"))
    return good.unionByName(shared)


def span_score(spans: Column) -> Column:
    """Mean score of aligned spans (array<struct<score, length>>) weighted by length; null of none."""
    total = lambda f: F.aggregate(spans, F.lit(0.0), lambda s, x: s + f(x))
    return F.try_divide(total(lambda x: x["score"] * x["length"]), total(lambda x: x["length"].cast("double")))


def alignment_statistics(words: DataFrame, call: str) -> DataFrame:
    """call, ``aligned_words``, ``total_words``, ``aligned_percent`` and ``mean_score`` of words with a ``score`` (null: not aligned)."""
    found = words.groupBy(call).agg(F.count("score").alias("aligned_words"), F.count("*").alias("total_words"), F.round(F.avg("score"), 4).alias("mean_score"))
    return found.withColumn("aligned_percent", F.round(100.0 * F.col("aligned_words") / F.greatest(F.lit(1), "total_words"), 2))
