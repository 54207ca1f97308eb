"""Speakers of words: from turns, with names and overrides, and checked again by the voice of each utterance.

Words are grouped into utterances, each with a vector of its voice; a call's speakers have centroids, enrolled people have profiles.
Clear utterances take the speaker they sound like, and words are grouped into segments anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators import intervals, profiles, sessions
from parley.shared import cut

REGROUP_GAP = 0.35


def label_words(words: DataFrame, turns: DataFrame, raw: DataFrame, call: str, seq: str, turn_no: str, names: tuple[str, ...] = ("Speaker 1", "Speaker 2"), overrides: DataFrame | None = None) -> DataFrame:
    """``words`` with ``speaker`` and ``overlap`` from turns of one speaker at a time and from raw ones, which may overlap.

    Speakers are named by first appearance; ``overrides`` (call, speaker, label) come before that. Words under 0.3 s
    between two of one speaker take theirs. Words of calls without turns stay as they are.
    """
    labels = intervals.friendly_labels(turns, call, turn_no, names).withColumnRenamed("label", "_label")
    if overrides is not None:
        labels = labels.join(overrides.select(call, "speaker", F.col("label").alias("_given")), [call, "speaker"], "left").select(call, "speaker", F.coalesce("_given", "_label").alias("_label"))
    known = turns.select(call).distinct()
    bare = words.join(known, call, "left_semi").select(call, seq, "start", "end")
    # Turns carry their label, so that words need no join by speaker.
    named = turns.join(labels, [call, "speaker"], "left").withColumn("speaker", F.when(F.col("speaker").isNotNull(), F.struct("speaker", "_label"))).drop("_label")
    found = intervals.assign_speakers(bare, named, call, seq, turn_no).select(call, seq, F.col("speaker._label").alias("speaker"))
    flags = intervals.overlap_flags(bare, raw, call, seq).withColumn("_over", F.lit(True))
    calm = sessions.suppress_flips(bare.join(found, [call, seq]), call, ["start", "end", seq]).select(call, seq, F.col("speaker").alias("_speaker"))
    met = words.join(calm, [call, seq], "left").join(flags, [call, seq], "left").join(known.withColumn("_known", F.lit(True)), call, "left")
    new = {"speaker": F.when(F.col("_known"), F.col("_speaker")).otherwise(F.col("speaker")), "overlap": F.when(F.col("_known"), F.coalesce("_over", F.lit(False))).otherwise(F.col("overlap"))}
    return met.select(*(new[c].alias(c) if c in new else c for c in words.columns))


def assign_word_speakers(words: DataFrame, turns: DataFrame, raw: DataFrame, call: str, seq: str, turn_no: str, **how) -> DataFrame:
    """Segments of the words that ``label_words`` labels; one ends at a gap over 0.35 s."""
    return sessions.words_to_segments(label_words(words, turns, raw, call, seq, turn_no, **how), call, seq, REGROUP_GAP)


def utterances(words: DataFrame, call: str, seq: str, grouped: DataFrame | None = None) -> DataFrame:
    """call, ``utterance`` (its first word's ``seq``), ``previous`` speaker, start, end, seconds and n_words; ``grouped``: the words' ``label_groups``, where they are known."""
    grouped = sessions.label_groups(words, call, seq) if grouped is None else grouped
    out = grouped.groupBy(call, F.col("group").alias("utterance")).agg(F.first("speaker").alias("previous"), F.min("start").alias("start"), F.max_by("end", F.struct("start", "end", seq)).alias("end"), F.count("*").alias("n_words"))
    return out.withColumn("seconds", F.col("end") - F.col("start"))


def call_centroids(groups: DataFrame, call: str) -> DataFrame:
    """call, name, label_no and vector: the mean voice of each speaker's utterances, numbered by name. ``groups``: call, previous, vector."""
    means = profiles.centroids(groups.where("previous IS NOT NULL AND vector IS NOT NULL").select(F.struct(call, "previous").alias("_k"), "vector"), "_k", "vector")
    return means.select(F.col(f"_k.{call}").alias(call), F.col("_k.previous").alias("name"), (F.row_number().over(Window.partitionBy(f"_k.{call}").orderBy("_k.previous")) - 1).alias("label_no"), "vector")


def _two_best(entries: Column) -> tuple[Column, Column]:
    ranked = F.sort_array(entries, asc=False)
    return F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))


def decide(groups: DataFrame, clusters: DataFrame, people: DataFrame, call: str) -> DataFrame:
    """One decision per utterance of a call with two clusters or more: ``groups`` with ``selected``, ``source``, ``confident`` and what they rest on.

    ``groups``: call, utterance, previous, seconds, n_words, vector, pitch; ``clusters``: call, label_no, name, vector (a call has few, gathered
    in one row); ``people``: name, profile_no, vector. Of equal similarities the later cluster or person is best.
    """
    enrolled = people.count()
    entry = F.struct("label_no", "name", profiles.unit(F.col("vector")).alias("v"))
    several = clusters.groupBy(call).agg(F.collect_list(entry).alias("_c")).where(F.size("_c") >= 2)
    met = groups.join(several, call).withColumn("_u", profiles.unit(F.col("vector")))
    first, second = _two_best(F.transform("_c", lambda c: F.struct(profiles.dot(F.col("_u"), c["v"]).alias("similarity"), c["label_no"].alias("label_no"), c["name"].alias("name"))))
    met = met.withColumns({"_first": first, "_second": second}).withColumns({"best": F.col("_first.similarity"), "second": F.col("_second.similarity"), "best_name": F.col("_first.name"), "_best_no": F.col("_first.label_no")}).drop("_c", "_u", "_first", "_second")
    # People: the two most similar to each utterance.
    keyed = groups.select(F.struct(call, "utterance").alias("_k"), "vector")
    top = profiles.top_profiles(keyed, people, "_k").groupBy(F.col(f"_k.{call}").alias(call), F.col("_k.utterance").alias("utterance"))
    at = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    top = top.agg(at(1, "name").alias("profile_name"), at(1, "similarity").alias("profile_best"), at(2, "similarity").alias("profile_second"))
    met = met.join(top, [call, "utterance"], "left").withColumn("n_profiles", F.lit(enrolled))
    if enrolled == 1:
        lone = profiles.top_profiles(clusters.select(F.struct(call, "label_no").alias("_k"), "vector"), people, "_k", 1)
        one, two = _two_best(F.col("_s"))
        lone = lone.groupBy(F.col(f"_k.{call}").alias(call)).agg(F.collect_list(F.struct("similarity", F.col("_k.label_no").alias("label_no"))).alias("_s")).withColumns({"_one": one, "_two": two})
        clear = (F.col("_one.similarity") >= 0.30) & (F.col("_one.similarity") - F.col("_two.similarity") >= 0.08)
        met = met.join(lone.where(clear).select(call, F.col("_one.label_no").alias("_anchor")), call, "left").withColumn("anchored", F.coalesce(F.col("_best_no") == F.col("_anchor"), F.lit(False))).drop("_anchor")
    else:
        met = met.withColumn("anchored", F.lit(False))
    # Pitch counts where a call has two speakers with a centre.
    centers = profiles.pitch_centers(groups.withColumnRenamed("previous", "speaker"), call).groupBy(call).agg(F.sort_array(F.collect_list(F.struct("speaker", "center"))).alias("_p")).where(F.size("_p") == 2)
    met = met.join(centers, call, "left")
    center = lambda i, c: F.get("_p", F.lit(i))[c]
    named = profiles.pitch_label(F.col("pitch"), center(0, "center"), center(1, "center"), center(0, "speaker"), center(1, "speaker"))
    return profiles.attribute(met.withColumn("pitch_name", named)).drop("_p", "_best_no")


def refine_words(words: DataFrame, vectors: DataFrame, clusters: DataFrame | None, people: DataFrame, call: str, seq: str, grouped: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(words with new speakers, decisions): the words of confident utterances take the selected speaker.

    ``vectors``: call, utterance, vector, pitch, as a voice model gives them for ``utterances``. Without ``clusters`` they are the
    means of each speaker's utterances. Calls of fewer than two clusters stay as they are. ``grouped``: a stored table of the words'
    ``label_groups``, where the caller has one.
    """
    # Words are put into utterances once, and the utterances with their voices, which six branches read, are written once.
    grouped = cut(sessions.label_groups(words, call, seq)) if grouped is None else grouped
    groups = cut(utterances(words, call, seq, grouped).join(vectors, [call, "utterance"]))
    decisions = decide(groups, call_centroids(groups, call) if clusters is None else clusters, people, call)
    told = decisions.where("confident").select(call, F.col("utterance").alias("group"), "selected")
    labelled = grouped.select(call, seq, "group").join(told, [call, "group"]).select(call, seq, "selected")
    out = words.join(labelled, [call, seq], "left").withColumn("speaker", F.coalesce("selected", "speaker"))
    return out.select(*words.columns), decisions


def refine_segments(words: DataFrame, vectors: DataFrame, clusters: DataFrame | None, people: DataFrame, call: str, seq: str, grouped: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, decisions) after ``refine_words``; a segment ends at a gap over 0.35 s."""
    made, decisions = refine_words(words, vectors, clusters, people, call, seq, grouped)
    return sessions.words_to_segments(made, call, seq, REGROUP_GAP), decisions
