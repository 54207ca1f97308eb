"""Suspect spans, evidence-weighted candidates for them, and their replacement in a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.once import let, with_once
from parley.functions.text import common, context_copied, counts, repetition_count, tokens
from parley.operators.sessions import merge_spans, words_to_segments
from parley.shared import cut

#: Share of a call's time in spans beyond which the second model hears the whole call once.
FULL_PASS = 0.35


def flag_segments(segments: DataFrame) -> DataFrame:
    """Segments (start, end, text, n_words, confidence) with reasons to listen again, as ``reasons``."""
    tokened = segments.withColumn("_t", tokens(F.col("text")))
    length = F.col("end") - F.col("start")
    reasons = F.array(
        F.when(repetition_count(F.col("_t")) > 0, "repetition"),
        F.when((F.col("n_words") >= 2) & (F.col("confidence") < 0.18), "low_alignment"),
        F.when((F.col("n_words") > 0) & (F.try_divide(length, F.col("n_words")) > 1.15), "silence_to_word_ratio"),
        F.when((F.col("n_words") <= 2) & (length < 0.8), "fragment"),
    )
    return tokened.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull())).drop("_t").where(F.size("reasons") > 0)


def recovery_spans(segments: DataFrame, call: str) -> DataFrame:
    """Merged, padded and capped spans of flagged segments; ``segments`` has the call's ``duration``."""
    return merge_spans(flag_segments(segments).select(call, "start", "end", "reasons", "duration"), call)


def agreement(counted: Column, text: Column, others: Column) -> Column:
    """Mean multiset Jaccard of a text's token counts with those of other texts that differ as strings.

    ``others``: array<struct<text, counted>>. 0.5 for a text without tokens or without other texts.
    """
    size = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y["n"])

    def mean(mine: Column, total: Column, apart: Column) -> Column:
        jaccard = lambda o: let(common(mine, o["counted"]), lambda both: both / F.greatest(F.lit(1), total + size(o["counted"]) - both))
        value = F.aggregate(apart, F.lit(0.0), lambda s, o: s + jaccard(o)) / F.greatest(F.lit(1), F.size(apart))
        return F.when((total == 0) | (F.size(apart) == 0), F.lit(0.5)).otherwise(value)

    apart = let(text, lambda t: F.filter(others, lambda o: o["text"] != t))
    return let(counted, lambda mine: let(size(mine), lambda total: let(apart, lambda rest: mean(mine, total, rest))))


def candidate_score(confidence: Column, n_words: Column, repeats: Column, n_tokens: Column, agreed: Column, seconds: Column) -> Column:
    """Evidence for a candidate: confidence, agreement, few repeats and enough words for the time."""
    coverage = F.least(F.lit(1.0), n_words / F.greatest(F.lit(1.0), seconds * 1.3))
    plausible = F.greatest(F.lit(0.0), 1.0 - 2.5 * F.least(F.lit(1.0), repeats / F.greatest(F.lit(1), n_tokens)))
    return 0.55 * F.coalesce(confidence, F.lit(0.0)) + 0.20 * agreed + 0.15 * plausible + 0.10 * coverage


def choose(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate taken for each span, whether a retry was ``accepted``, and up to three ``alternatives``.

    ``candidates``: keys, ins_no (0: the primary), model, text, score, repeats, reasons. A retry needs 0.03 more
    than the primary, and either removes a repeat like another retry does, or, where none was
    the reason, is backed by another model and 0.08 better.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "ins_no")
    ranked = candidates.withColumn("_r", F.row_number().over(order))
    cols = F.struct("model", "text", "score", "repeats", "ins_no")
    one = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, cols)).alias("best"),
        F.max(F.when(F.col("ins_no") == 0, cols)).alias("primary"),
        F.first("reasons").alias("reasons"),
        F.bool_or((F.col("ins_no") > 0) & F.lower("model").contains("vaani")).alias("_other_model"),
        F.array_sort(F.collect_list(F.struct("_r", "text", "repeats", "ins_no"))).alias("_all"),
    )
    repeated = F.array_contains("reasons", "repetition")
    fewer = F.size(F.filter("_all", lambda x: (x["ins_no"] > 0) & (x["repeats"] < F.col("primary.repeats"))))
    by_repeats = repeated & (F.col("primary.repeats") > 0) & (fewer >= 2) & (F.col("best.repeats") < F.col("primary.repeats"))
    by_models = ~repeated & F.col("_other_model") & (F.col("best.score") >= F.col("primary.score") + 0.08)
    accepted = (F.col("best.ins_no") > 0) & (F.col("best.score") >= F.col("primary.score") + 0.03) & (by_repeats | by_models)
    out = one.withColumn("accepted", accepted).withColumn("chosen", F.when(F.col("accepted"), F.col("best")).otherwise(F.col("primary")))
    others = F.slice(F.array_distinct(F.transform(F.filter("_all", lambda x: x["text"] != F.col("chosen.text")), lambda x: x["text"])), 1, 3)
    removed = F.col("accepted") & (F.col("chosen.repeats") < F.col("primary.repeats"))
    return out.select(*keys, *(F.col(f"chosen.{c}").alias(c) for c in ("model", "text", "ins_no", "score")), "accepted", F.col("primary.score").alias("primary_score"), removed.alias("repetition_removed"), others.alias("alternatives"))


def copied_context(df: DataFrame, candidate: str, context: str, primary: str) -> DataFrame:
    """Adds ``context_copied``: a candidate that mostly repeats its prompt."""
    made = with_once(df, {"_c": tokens(F.col(candidate)), "_x": tokens(F.col(context)), "_p": tokens(F.col(primary))})
    return made.withColumn("context_copied", context_copied(F.col("_c"), F.col("_x"), F.col("_p"))).drop("_c", "_x", "_p")


def crop(words: DataFrame, spans: DataFrame, call: str, inside: bool = True) -> DataFrame:
    """Words whose midpoint lies in a span of their call (closed), or in none."""
    spans = spans.select(call, F.col("start").alias("_s"), F.col("end").alias("_e"))
    dealt = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / 16), F.floor(F.col("_e") / 16))))
    asked = words.withColumn("_m", (F.col("start") + F.col("end")) / 2).withColumn("_b", F.floor(F.col("_m") / 16))
    met = asked.alias("w").join(dealt.alias("s"), (F.col(f"w.{call}") == F.col(f"s.{call}")) & (F.col("w._b") == F.col("s._b")) & F.col("_m").between(F.col("_s"), F.col("_e")), "left_semi" if inside else "left_anti")
    return met.drop("_m", "_b")


def replace_in_spans(words: DataFrame, spans: DataFrame, replacement: DataFrame, call: str) -> DataFrame:
    """Words outside the spans and the replacement's words; both have the same columns."""
    return crop(words, spans, call, inside=False).unionByName(replacement)


def numbered(spans: DataFrame, call: str) -> DataFrame:
    """Spans with ``span_no`` from 0 in order of time; a call's spans are some seconds long each, and few."""
    return spans.withColumn("span_no", F.row_number().over(Window.partitionBy(call).orderBy("start", "end")) - 1)


def span_totals(spans: DataFrame, call: str) -> DataFrame:
    """call, ``flagged_seconds``, ``flagged_percent`` and ``full_pass`` of spans with the call's ``duration``."""
    share = F.sum(F.col("end") - F.col("start")) / F.greatest(F.lit(0.001), F.max("duration"))
    return spans.groupBy(call).agg(F.sum(F.col("end") - F.col("start")).alias("flagged_seconds"), F.round(100 * share, 2).alias("flagged_percent"), (share > FULL_PASS).alias("full_pass"))


def owned_retries(spans: DataFrame, shifted: DataFrame, second: DataFrame, call: str) -> DataFrame:
    """call, span_no, ``ins_no`` from 1, model, ``part`` and text: which retries were made for which span.

    ``shifted`` (call, span_no, part, model, text) are a span's own windows. ``second`` (call, part, model, text) has one part a
    span, in order, or, where the call had a full pass, one part 0 that belongs to all its spans. A retry keeps its
    (call, model, part), so it is aligned once however many spans own it. Retries without text have no number.
    """
    part = F.when(F.col("full_pass"), F.lit(0)).otherwise(F.col("span_no"))
    asked = spans.select(call, "span_no", "duration", "start", "end").join(span_totals(spans, call).select(call, "full_pass"), call).select(call, "span_no", part.alias("part"))
    own = shifted.join(spans.select(call, "span_no"), [call, "span_no"]).select(call, "span_no", F.lit(0).alias("_source"), "part", "model", "text")
    both = own.unionByName(second.join(asked, [call, "part"]).select(call, "span_no", F.lit(1).alias("_source"), "part", "model", "text"))
    number = F.row_number().over(Window.partitionBy(call, "span_no").orderBy("_source", "part"))  # three a span
    return both.where("coalesce(text, '') <> ''").select(call, "span_no", number.alias("ins_no"), "model", "part", "text")


def _by_span(words: DataFrame, spans: DataFrame, call: str) -> DataFrame:
    """Words with the ``span_no`` of each span that their midpoint lies in (closed; null: in none), joined once, by call and time bucket."""
    dealt = spans.select(call, "span_no", F.col("start").alias("_s"), F.col("end").alias("_e")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / 16), F.floor(F.col("_e") / 16))))
    asked = words.withColumn("_m", (F.col("start") + F.col("end")) / 2).withColumn("_b", F.floor(F.col("_m") / 16))
    met = asked.alias("w").join(dealt.alias("s"), (F.col(f"w.{call}") == F.col(f"s.{call}")) & (F.col("w._b") == F.col("s._b")) & F.col("_m").between(F.col("_s"), F.col("_e")), "left")
    return met.select(*(F.col(f"w.{c}") for c in words.columns), "s.span_no")


def recover(words: DataFrame, spans: DataFrame, retries: DataFrame, retry_words: DataFrame, call: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(words, decisions): a call's words with those of suspect spans replaced by the best evidence, and what was decided.

    ``words``: call, seq, start, end, text, confidence, speaker, overlap, uncertain; ``spans``: call, span_no, start, end, reasons,
    ``context``; ``retries``: what ``owned_retries`` returns; ``retry_words`` (call, model, part, word_no, start, end, text,
    confidence): each retry aligned to the recording. A retry whose words in the span are none, or mostly repeat its
    context, is no candidate. Words of a span get ``origin``, ``alternatives``, ``uncertain`` unless a retry was accepted, and, at the
    first one, ``repetition_removed``. A span without words keeps none and still has its decision.
    """
    keys = [call, "span_no"]
    cols = [*keys, "ins_no", "_no", "start", "end", "text", "confidence", "speaker", "overlap", "uncertain"]
    first = _by_span(words, spans, call).select(*keys, F.lit(0).alias("ins_no"), F.struct("start", "end", F.col(seq).cast("long").alias("no")).alias("_no"), "start", "end", "text", "confidence", "speaker", "overlap", "uncertain")
    inside = retry_words.join(retries.select(*keys, "ins_no", "model", "part"), [call, "model", "part"]).join(spans.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e")), keys)
    inside = inside.where(((F.col("start") + F.col("end")) / 2).between(F.col("_s"), F.col("_e")))
    again = inside.select(*keys, "ins_no", F.struct("start", "end", F.col("word_no").cast("long").alias("no")).alias("_no"), "start", "end", "text", "confidence", F.lit(None).cast("string").alias("speaker"), F.lit(False).alias("overlap"), F.lit(None).cast("boolean").alias("uncertain"))
    # The words of all candidates are scored, those of the chosen ones taken, and those in no span kept: read by three branches, made and written once.
    placed = cut(first.select(*cols).unionByName(again.select(*cols)))
    each = placed.where("span_no is not null").drop("uncertain")
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("_no", "text")))["text"], " ")
    texts = each.groupBy(*keys, "ins_no").agg(joined.alias("text"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_words"))

    asked = spans.select(*keys, F.lit(0).alias("ins_no"), F.lit("primary").alias("model"), F.lit(None).cast("string").alias("_raw"))
    heard = asked.unionByName(retries.select(*keys, "ins_no", "model", F.col("text").alias("_raw")))
    found = heard.join(texts, [*keys, "ins_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    # A candidate's tokens are counted once, here, and not by each candidate that is compared with it.
    raw = F.coalesce("_raw", "text")
    found = with_once(found, {"_mine": F.struct("ins_no", raw.alias("text"), counts(tokens(raw)).alias("counted"))})
    # A span and its candidates: four rows at most.
    whole = Window.partitionBy(*keys)
    found = found.withColumns({"_primary": F.max(F.when(F.col("ins_no") == 0, F.col("text"))).over(whole), "_others": F.sort_array(F.collect_list("_mine").over(whole))}).drop("_mine", "_raw")
    found = found.join(spans.select(*keys, "reasons", F.col("context").alias("_context"), (F.col("end") - F.col("start")).alias("_seconds")), keys)
    found = copied_context(found, "text", "_context", "_primary").where("ins_no = 0 or (text <> '' and not context_copied)")
    found = with_once(found, {"_t": tokens(F.col("text"))})
    found = with_once(found, {"_counted": counts(F.col("_t")), "repeats": repetition_count(F.col("_t"))})
    score = candidate_score(F.col("confidence"), F.coalesce("n_words", F.lit(0)), F.col("repeats"), F.size("_t"), agreement(F.col("_counted"), F.col("text"), F.col("_others")), F.col("_seconds"))
    decisions = cut(choose(found.withColumn("score", score).select(*keys, "ins_no", "model", "text", "score", "repeats", "reasons"), keys))

    taken = each.join(decisions.select(*keys, "ins_no", F.col("model").alias("origin"), "alternatives", "accepted", F.col("repetition_removed").alias("_removed")), [*keys, "ins_no"])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_no"))
    taken = taken.withColumns({"uncertain": ~F.col("accepted"), "repetition_removed": F.col("_removed") & (place == 1), seq: F.col("_no.no")})
    kept = placed.where("span_no is null").withColumns({"origin": F.lit("primary"), "alternatives": F.array().cast("array<string>"), "repetition_removed": F.lit(False), seq: F.col("_no.no")})
    out = [call, seq, "start", "end", "text", "confidence", "speaker", "overlap", "uncertain", "origin", "alternatives", "repetition_removed"]
    return kept.select(*out).unionByName(taken.select(*out)), decisions


def recovered_segments(words: DataFrame, call: str, seq: str) -> DataFrame:
    """Recovered words as segments; one is uncertain if any of its words is."""
    return words_to_segments(words, call, seq, 0.8)


def recovery_report(spans: DataFrame, decisions: DataFrame, call: str) -> DataFrame:
    """call, flagged seconds and percentage, ``full_pass`` and ``changes``, the spans for which a retry was accepted."""
    changes = decisions.groupBy(call).agg(F.count_if("accepted").alias("changes"))
    return span_totals(spans, call).join(changes, call, "left").fillna(0, ["changes"])
