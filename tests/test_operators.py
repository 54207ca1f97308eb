import random

import pytest
from pyspark.sql import functions as F

from parley.functions.bits import distance
from parley.operators import benchmarks, consensus, intervals, metrics, profiles, recovery, sessions, training

TURNS = "call int, turn_no int, start double, end double, speaker string"


def turns(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], TURNS)


def test_speakers_by_overlap_then_nearest(spark):
    words = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 2.0, 4.0), (1, 2, 200.0, 201.0), (2, 0, 0.0, 1.0)], "call int, seq int, start double, end double")
    found = intervals.assign_speakers(words, turns(spark, (0.0, 2.5, "A"), (2.5, 70.0, "B"), (70.0, 90.0, "A")), "call", "seq", "turn_no")
    assert sorted(map(tuple, found.collect())) == [(1, 0, "A"), (1, 1, "B"), (1, 2, "A")]


def test_ties_go_to_the_first_turn(spark):
    words = spark.createDataFrame([(1, 0, 0.0, 2.0)], "call int, seq int, start double, end double")
    found = intervals.assign_speakers(words, turns(spark, (1.0, 2.0, "B"), (0.0, 1.0, "A")), "call", "seq", "turn_no")
    assert found.first()["speaker"] == "B"


def test_buckets_count_a_pair_once(spark):
    rnd = random.Random(3)
    a = [(1, i, s, s + rnd.choice([1, 100, 300]) / 4) for i, s in enumerate(rnd.randint(0, 4000) / 4 for _ in range(60))]
    b = [(1, i, s, s + rnd.choice([1, 100, 300]) / 4, f"s{i}") for i, s in enumerate(rnd.randint(0, 4000) / 4 for _ in range(60))]
    left = spark.createDataFrame(a, "call int, k int, start double, end double")
    right = spark.createDataFrame(b, "call int, no int, start double, end double, speaker string")
    got = {(r["k"], r["no"]): r["seconds"] for r in intervals.overlapping(left, right, "call", ["k"], ["no"]).collect()}
    want = {(x[1], y[1]): min(x[3], y[3]) - max(x[2], y[2]) for x in a for y in b if x[2] < y[3] and y[2] < x[3]}
    assert got == want
    near = {r["k"]: r["speaker"] for r in intervals.nearest(left, right, "call", "k", "no", "speaker").collect()}
    assert near == {x[1]: min(b, key=lambda y: (abs((x[2] + x[3]) / 2 - (y[2] + y[3]) / 2), y[1]))[4] for x in a}


def test_attribution(spark):
    ref = spark.createDataFrame([(1, 0.0, 10.0, "A"), (2, 0.0, 1.0, "A"), (3, 0.0, 4.0, "A"), (4, 0.0, 4.0, None)], "call int, start double, end double, speaker string")
    hyp = spark.createDataFrame([(1, 2.0, 4.0, "A"), (3, 0.0, 2.0, None), (3, 2.0, 4.0, "A"), (4, 0.0, 4.0, "B")], "call int, start double, end double, speaker string")
    got = {r["call"]: r["speaker_accuracy"] for r in intervals.attribution(ref, hyp, "call").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.5, 4: 1.0}


def test_overlap_flags(spark):
    words = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 1.5)], "call int, seq int, start double, end double")
    raw = turns(spark, (0.0, 1.3, "A"), (0.7, 1.6, "B"))
    assert [r["seq"] for r in intervals.overlap_flags(words, raw, "call", "seq").collect()] == [1]
    assert intervals.crosstalk(raw, "call", "turn_no").first()["overlap_seconds"] == pytest.approx(0.6)


def test_words_to_segments(spark):
    schema = "call int, seq int, start double, end double, text string, confidence double, speaker string, overlap boolean, uncertain boolean"
    rows = [(1, 0, 0.0, 1.0, "a", 0.5, None, False, False), (1, 1, 1.8, 2.0, " b ", None, None, False, True), (1, 2, 2.0, 3.0, "c", 0.7, "A", False, False), (1, 3, 3.81, 4.0, "d", None, "A", False, None)]
    got = sessions.words_to_segments(spark.createDataFrame(rows, schema), "call", "seq").orderBy("seg_no").collect()
    assert [(r["text"], r["start"], r["end"], r["confidence"], r["uncertain"]) for r in got] == [("a b", 0.0, 2.0, 0.5, True), ("c", 2.0, 3.0, 0.7, False), ("d", 3.81, 4.0, None, False)]


def test_merge_turns(spark):
    rows = turns(spark, (0.0, 2.0, "A"), (2.3, 5.0, "A"), (5.2, 9.0, "B"), (9.1, 20.0, "B"), (20.2, 25.0, "B"), (25.0, 25.1, "A"))
    got = sorted((r["start"], r["end"], r["speaker"]) for r in sessions.merge_turns(rows, "call", "turn_no").collect())
    assert got == [(0.0, 5.0, "A"), (5.2, 20.0, "B"), (20.2, 25.0, "B")]


def test_smooth_turns(spark):
    got = sessions.smooth_turns(turns(spark, (0.0, 1.0, "A"), (1.0, 1.2, "B"), (1.2, 2.0, "A"), (2.3, 3.0, "A"), (5.0, 4.0, "B")), "call").collect()
    assert [(r["start"], r["end"], r["speaker"]) for r in got] == [(0.0, 3.0, "A")]


def test_flips_pass_on_from_left_to_right(spark):
    def plain(rows):
        rows = [list(r) for r in rows]
        for i in range(1, len(rows) - 1):
            if rows[i][1] - rows[i][0] < 0.3 and rows[i - 1][2] == rows[i + 1][2] != rows[i][2]:
                rows[i][2] = rows[i - 1][2]
        return [r[2] for r in rows]

    rnd = random.Random(5)
    data, want = [], {}
    for call in range(30):
        at, rows = 0.0, []
        for _ in range(rnd.randint(1, 14)):
            length = rnd.choice([0.125, 0.5])
            rows.append((at, at + length, rnd.choice("AB")))
            at += length
        want[call] = plain(rows)
        data += [(call, i, *r) for i, r in enumerate(rows)]
    got = sessions.suppress_flips(spark.createDataFrame(data, "call int, seq int, start double, end double, speaker string"), "call", ["seq"]).orderBy("call", "seq").collect()
    assert {c: [r["speaker"] for r in got if r["call"] == c] for c in want} == want


def test_utterance_groups(spark):
    rows = turns(spark, *((i / 2, i / 2 + 0.5, "A") for i in range(20)), (10.5, 11.0, "A"), (11.0, 11.5, "B"))
    got = sorted((r["start"], r["end"], r["n"]) for r in sessions.utterance_groups(rows, "call", "turn_no").collect())
    assert got == [(0.0, 6.0, 12), (6.0, 10.0, 8), (10.5, 11.0, 1), (11.0, 11.5, 1)]


def test_recovery_spans(spark):
    schema = "call int, start double, end double, reasons array<string>, duration double"
    spans = spark.createDataFrame([(1, 2.0, 3.0, ["b"], 30.0), (1, 4.0, 5.0, ["a"], 30.0), (2, 0.0, 30.0, ["a"], 60.0), (2, 40.0, 41.0, ["a"], 60.0), (3, 0.0, 0.2, ["a"], 0.3)], schema)
    got = sorted((r["call"], r["start"], r["end"], r["reasons"]) for r in sessions.merge_spans(spans, "call").collect())
    assert got == [(1, 0.0, 11.0, ["a", "b"]), (2, 6.0, 24.0, ["a"]), (2, 36.0, 45.0, ["a"])]


def test_span_properties(spark):
    rnd = random.Random(9)
    data = [(c, s, s + rnd.randint(1, 80) / 8, ["r"], 300.0) for c in range(20) for s in (rnd.randint(0, 2000) / 8 for _ in range(rnd.randint(1, 12)))]
    for c in range(20):
        rows = sorted((r["start"], r["end"]) for r in sessions.merge_spans(spark.createDataFrame([x for x in data if x[0] == c], "call int, start double, end double, reasons array<string>, duration double"), "call").collect()) if c < 3 else []
        assert all(b - a <= 18 and a >= 0 and b <= 300 for a, b in rows)
        assert all(x[1] <= y[0] for x, y in zip(rows, rows[1:], strict=False))


def test_overlap_dedup(spark):
    word = lambda t, a, b: (a, b, t, t.lower())
    schema = "call int, seg_no int, start double, end double, words array<struct<start:double,end:double,text:string,token:string>>"
    rows = [(1, 0, 0.0, 4.0, [word(t, i * 1.0, i + 1.0) for i, t in enumerate("one two three four".split())]), (1, 1, 3.0, 7.0, [word(t, 3.0 + i, 4.0 + i) for i, t in enumerate("Three four five six".split())]), (1, 2, 6.5, 7.0, [word("six", 6.5, 7.0)]), (1, 3, 9.0, 10.0, [word("six", 9.0, 10.0)])]
    got = sessions.overlap_dedup(spark.createDataFrame(rows, schema), "call", "seg_no").orderBy("seg_no").collect()
    assert [(r["seg_no"], r["start"], r["text"]) for r in got] == [(0, 0.0, "one two three four"), (1, 5.0, "five six"), (3, 9.0, "six")]


def test_alignment_and_consensus(spark):
    assert consensus.align(list("abcd"), list("abd")) == [(0, 0), (1, 1), (2, None), (3, 2)]
    assert consensus.align([], list("ab")) == [(None, 0), (None, 1)]
    assert consensus.align(list("ab"), list("xb")) == [(0, 0), (1, 1)]
    rnd = random.Random(2)
    for _ in range(40):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        path = consensus.align(a, b)
        assert [i for i, _ in path if i is not None] == list(range(len(a))) and [j for _, j in path if j is not None] == list(range(len(b)))
        assert sum(i is None or j is None or a[i] != b[j] for i, j in path) == _distance(a, b)
    schema = "call int, word_no int, token string, text string, start double, end double, confidence double, speaker string, overlap boolean"
    first = spark.createDataFrame([(1, i, t, t, i * 1.0, i + 1.0, c, "A", False) for i, (t, c) in enumerate([("a", 0.5), ("b", 0.5), ("c", None)])], schema)
    second = spark.createDataFrame([(1, i, t, t, 9.0, 9.5, c, "B", True) for i, (t, c) in enumerate([("a", 0.9), ("x", 0.9), ("y", 0.65), ("z", 0.6)])], schema)
    got = consensus.consensus_words(first, second, "call").orderBy("step").collect()
    assert [(r["text"], r["start"], r["speaker"]) for r in got] == [("a", 0.0, "A"), ("x", 9.0, "B"), ("y", 1.0, "A"), ("c", 2.0, "A")]


def test_aligned_words_stay_in_their_call_s_row(spark):
    """Words used to be found again by two joins with the path, each of which dealt all words once more."""
    schema = "call int, word_no int, token string, text string, start double, end double, confidence double, speaker string, overlap boolean"
    word = lambda call, i, t: (call, i, t, t.upper(), i * 1.0, i + 1.0, 0.9, "A", False)
    first = spark.createDataFrame([word(1, 7, "b"), word(1, 3, "a"), word(2, 0, "x"), word(None, 0, "n")], schema)
    second = spark.createDataFrame([word(1, 0, "a"), word(3, 0, "y"), word(None, 5, "n")], schema)
    path = consensus.align_words(first, second, "call").collect()
    assert {(r["call"], r["step"], r["a_no"], r["b_no"]) for r in path} == {(1, 0, 3, 0), (1, 1, 7, None), (2, 0, 0, None), (3, 0, None, 0), (None, 0, 0, 5)}
    made = consensus.consensus_words(first, second, "call")
    assert sorted((str(r["call"]), r["step"], r["text"], r["from_second"]) for r in made.collect()) == [("1", 0, "A", False), ("1", 1, "B", False), ("2", 0, "X", False), ("3", 0, "Y", True), ("None", 0, "N", False)]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_long_alignments_need_little_memory():
    import tracemalloc

    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    a = [rnd.choice(vocabulary) for _ in range(12_000)]
    b = [rnd.choice(vocabulary) if rnd.random() < 0.1 else x for x in a if rnd.random() > 0.1]
    tracemalloc.start()
    path = consensus.align(a, b)
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()
    assert sum(i is None or j is None or a[i] != b[j] for i, j in path) == distance(a, b)
    assert distance(a[:300], b[:250]) == _distance(a[:300], b[:250])


def test_alignment_cost(spark):
    side = lambda items: spark.createDataFrame([(c, i, t) for c, text in items for i, t in enumerate(text)], "call int, word_no int, token string")
    got = consensus.alignment_cost(side([(1, "abcd"), (2, "ab"), (3, "")]), side([(1, "xbd"), (3, "zz")]), "call")
    assert {tuple(r) for r in got.collect()} == {(1, 4, 2), (2, 2, 2), (3, 2, 2)}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_choice_needs_evidence(spark):
    schema = "k int, ins_no int, model string, text string, score double, repeats int, reasons array<string>"
    rows = [(1, 0, "primary", "p", 0.5, 0, []), (1, 1, "Vaani", "v", 0.59, 0, []), (2, 0, "primary", "p", 0.5, 0, []), (2, 1, "other", "v", 0.9, 0, []), (3, 0, "primary", "p p", 0.5, 1, ["repetition"]), (3, 1, "x", "q", 0.6, 0, ["repetition"]), (3, 2, "y", "r", 0.55, 0, ["repetition"]), (4, 0, "primary", "p", 0.5, 0, []), (4, 1, "vaani", "v", 0.5, 0, [])]
    got = {r["k"]: (r["model"], r["accepted"], r["repetition_removed"], r["alternatives"]) for r in recovery.choose(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert got == {1: ("Vaani", True, False, ["p"]), 2: ("primary", False, False, ["v"]), 3: ("x", True, True, ["r", "p p"]), 4: ("primary", False, False, ["v"])}


def test_replacement_keeps_words_outside(spark):
    words = spark.createDataFrame([(1, 0.0, 1.0, "a"), (1, 1.0, 2.0, "b"), (1, 2.0, 3.0, "c")], "call int, start double, end double, text string")
    spans = spark.createDataFrame([(1, 1.0, 2.0)], "call int, start double, end double")
    new = spark.createDataFrame([(1, 1.0, 2.0, "B")], "call int, start double, end double, text string")
    assert sorted(r["text"] for r in recovery.replace_in_spans(words, spans, new, "call").collect()) == ["B", "a", "c"]


def test_profiles_match_one_to_one(spark):
    people = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0])], "name string, profile_no int, vector array<float>")
    clusters = spark.createDataFrame([(1, "x", 0, [0.9, 0.3]), (1, "y", 1, [0.8, 0.5]), (2, "x", 0, [0.0, 0.0])], "call int, label string, label_no int, vector array<float>")
    got = {(r["call"], r["label"]): r["name"] for r in profiles.match_profiles(clusters, people, "call", 0.5).collect()}
    assert got == {(1, "x"): "a", (1, "y"): "b"}
    alone = profiles.match_profiles(clusters.where("call = 1"), people.where("name = 'a'"), "call").collect()
    assert [(r["label"], r["name"]) for r in alone] == [("x", "a")]


def test_names_differing_in_case_are_one(spark):
    rows = spark.createDataFrame([("asha", [1.0]), ("Asha", [2.0]), ("no/slash", [1.0]), ("none", None)], "name string, vector array<float>")
    assert [r["name"] for r in profiles.distinct_names(rows).collect()] == ["Asha"]


def test_quantized_profiles_come_back(spark):
    rows = spark.createDataFrame([(1, [float(i) for i in range(1, 513)]), (2, [0.0, 0.0]), (3, [])], "k int, v array<float>")
    got = rows.select("k", profiles.quantize(F.col("v")).alias("q"), "v").select("k", F.size("q.payload").alias("n"), profiles.cosine(F.col("v"), profiles.dequantize(F.col("q"))).alias("c")).orderBy("k").collect()
    assert got[0]["n"] == 512 and got[0]["c"] > 0.9999 and got[1]["c"] is None and got[2]["c"] is None


def test_pitch(spark):
    df = spark.createDataFrame([(124.0, 126.0, 177.0), (187.0, 126.0, 177.0), (150.0, 145.0, 155.0), (None, 126.0, 177.0)], "hz double, a double, b double")
    assert [r[0] for r in df.select(profiles.pitch_label(F.col("hz"), F.col("a"), F.col("b"), F.lit("A"), F.lit("B"))).collect()] == ["A", "B", None, None]


def test_splits(spark):
    for n in (3, 4, 10, 57):
        got = dict(training.split_calls(spark.range(n).withColumnRenamed("id", "call"), "call").groupBy("split").count().collect())
        train, val = training.split_sizes(n)
        assert got == {"train": train, "val": val, "test": n - train - val}
    with pytest.raises(ValueError):
        training.split_sizes(2)


def test_promotion_gates(spark):
    schema = "candidate string, candidate_no int, mode string, wer double, number_accuracy double, name_accuracy double, runtime_40min double, meets_target boolean"
    reports = spark.createDataFrame([("a", 0, "original", 0.30, 1.0, 1.0, 800.0, False), ("a", 0, "telephone", 0.28, 1.0, 1.0, 800.0, False), ("b", 1, "original", 0.29, 1.0, 1.0, 900.0, False), ("b", 1, "telephone", 0.20, 0.5, 1.0, 900.0, False), ("c", 2, "original", 0.01, 1.0, 1.0, 900.0, True)], schema)
    assert {r["candidate"]: r["mode"] for r in metrics.best_variants(reports).collect()} == {"a": "telephone", "b": "original"}
    assert tuple(metrics.promotion(reports).first()) == ("a", None, "telephone", False, False)
    both = spark.createDataFrame([("a", "b", 0.26, 1.0, 1.0, True)], "primary string, secondary string, wer double, number_accuracy double, name_accuracy double, meets_target boolean")
    assert tuple(metrics.promotion(reports, both).first()) == ("a", "b", "telephone", True, True)
    slow = reports.withColumn("runtime_40min", F.lit(1000.0))
    assert tuple(metrics.promotion(slow, both).first()) == ("a", None, "telephone", False, False)


def test_manifest_numbers_each_split_without_gaps(spark):
    rows = [(f"c{i}", k, float(k), k + (0.1 if k == 3 else 1.0), "" if k == 2 else f"text {k}") for i in range(30) for k in range(6)]
    segments = spark.createDataFrame(rows, "call string, seg_no int, start double, end double, text string")
    splits = training.split_calls(segments, "call")
    found = training.manifest(segments, splits, "call", ["call", "seg_no"]).collect()
    assert len(found) == 30 * 4
    for split in ("train", "val", "test"):
        numbers = sorted(r["audio_filepath"] for r in found if r["split"] == split)
        assert numbers == [f"{split}_{n:06d}.wav" for n in range(len(numbers))]
    assert training.manifest(segments.limit(0), splits, "call", ["call", "seg_no"]).count() == 0


WORDS = "call int, seq long, start double, end double, text string, confidence double, speaker string, overlap boolean, uncertain boolean"


def test_recovery_replaces_a_span_by_a_backed_retry(spark):
    said = "zero one two three four five six seven eight nine".split()
    words = spark.createDataFrame([(c, i, float(i), i + 1.0, w, 0.2, "a", False, False) for c in (1, 2) for i, w in enumerate(said)], WORDS)
    spans = spark.createDataFrame([(1, 0, 3.0, 6.0, ["low_alignment"], "", 10.0), (2, 0, 3.0, 6.0, ["low_alignment"], "drei vier fuenf sechs", 10.0)], "call int, span_no int, start double, end double, reasons array<string>, context string, duration double")
    heard = {"first": "drei vier fuenf", "vaani": "drei vier fuenf"}
    retries = spark.createDataFrame([(c, 0, k, m, k, t) for c in (1, 2) for k, (m, t) in enumerate(heard.items(), 1)], "call int, span_no int, ins_no int, model string, part int, text string")
    again = spark.createDataFrame([(c, m, k, i, 3.0 + i, 4.0 + i, w, 0.9) for c in (1, 2) for k, (m, t) in enumerate(heard.items(), 1) for i, w in enumerate(t.split())], "call int, model string, part int, word_no int, start double, end double, text string, confidence double")
    found, decisions = recovery.recover(words, spans, retries, again, "call", "seq")
    assert {r["call"]: r["accepted"] for r in decisions.collect()} == {1: True, 2: True}
    rows = sorted((r["call"], r["start"], r["text"], r["origin"], r["uncertain"]) for r in found.collect())
    assert [r[2] for r in rows if r[0] == 1] == "zero one two drei vier fuenf six seven eight nine".split()
    assert {r[3] for r in rows if r[0] == 1 and 3 <= r[1] < 6} <= {"first", "vaani"} and not any(r[4] for r in rows if r[0] == 1)
    report = {r["call"]: (r["flagged_seconds"], r["flagged_percent"], r["full_pass"], r["changes"]) for r in recovery.recovery_report(spans, decisions, "call").collect()}
    assert report == {1: (3.0, 30.0, False, 1), 2: (3.0, 30.0, False, 1)}
    assert [r["text"] for r in recovery.recovered_segments(found.where("call = 1"), "call", "seq").orderBy("seg_no").collect()] == ["zero one two", "drei vier fuenf", "six seven eight nine"]


def test_recovery_without_evidence_keeps_the_words(spark):
    words = spark.createDataFrame([(1, i, float(i), i + 1.0, w, 0.9, "a", False, False) for i, w in enumerate("a bb cc dd ee ff".split())], WORDS)
    spans = spark.createDataFrame([(1, 0, 1.0, 4.0, ["fragment"], "one two three four five"), (1, 1, 50.0, 51.0, ["fragment"], "")], "call int, span_no int, start double, end double, reasons array<string>, context string")
    retries = spark.createDataFrame([(1, 0, 1, "vaani", 0, "one two three four")], "call int, span_no int, ins_no int, model string, part int, text string")
    again = spark.createDataFrame([(1, "vaani", 0, i, 1.0 + i / 2, 1.5 + i / 2, w, 1.0) for i, w in enumerate("one two three four".split())], "call int, model string, part int, word_no int, start double, end double, text string, confidence double")
    found, decisions = recovery.recover(words, spans, retries, again, "call", "seq")
    # The retry says what its prompt says; a span without words is decided too.
    assert sorted((r["span_no"], r["accepted"], r["text"]) for r in decisions.collect()) == [(0, False, "bb cc dd"), (1, False, "")]
    assert sorted((r["text"], r["uncertain"]) for r in found.collect()) == [("a", False), ("bb", True), ("cc", True), ("dd", True), ("ee", False), ("ff", False)]


def test_a_full_pass_belongs_to_every_span(spark):
    spans = spark.createDataFrame([(1, 0, 0.0, 4.0, 10.0), (1, 1, 5.0, 9.0, 10.0), (2, 0, 0.0, 1.0, 10.0)], "call int, span_no int, start double, end double, duration double")
    shifted = spark.createDataFrame([(1, 0, 0, "q", "x"), (1, 0, 1, "q", ""), (2, 0, 0, "q", "y")], "call int, span_no int, part int, model string, text string")
    second = spark.createDataFrame([(1, 0, "v", "all"), (2, 0, "v", "own")], "call int, part int, model string, text string")
    got = sorted(tuple(r) for r in recovery.owned_retries(spans, shifted, second, "call").collect())
    assert got == [(1, 0, 1, "q", 0, "x"), (1, 0, 2, "v", 0, "all"), (1, 1, 1, "v", 0, "all"), (2, 0, 1, "q", 0, "y"), (2, 0, 2, "v", 0, "own")]


def test_span_context_by_brute_force(spark):
    rnd = random.Random(3)
    segments = [(c, i, a, a + rnd.randint(0, 6), f"t{i}") for c in (1, 2) for i, a in enumerate(rnd.randint(0, 40) for _ in range(30))]
    spans = [(c, k, a, a + rnd.randint(0, 5)) for c in (1, 2, 3) for k, a in enumerate(rnd.randint(-2, 44) for _ in range(25))]
    got = intervals.span_context(spark.createDataFrame(spans, "call int, span_no int, start int, end int"), spark.createDataFrame(segments, "call int, seg_no int, start int, end int, text string"), "call", "span_no", "seg_no")
    want = {}
    for c, k, s, e in spans:
        before = [t for cc, _, _, b, t in segments if cc == c and b <= s][-2:]
        after = [t for cc, _, a, b, t in segments if cc == c and a >= e and not b <= s][:2]
        want[c, k] = f"Previous: {' '.join(before)}\nFollowing: {' '.join(after)}"
    assert {(r["call"], r["span_no"]): r["context"] for r in got.collect()} == want


def test_benchmark_items(spark):
    items = spark.createDataFrame([("a", 0, 2.0), ("b", 1, 3.5), ("c", 2, None)], "id string, item_no int, duration double").withColumn("by", F.lit(1))
    assert [r["offset"] for r in benchmarks.with_offsets(items, "by", "item_no").orderBy("item_no").collect()] == [0.0, 3.0, 7.5]
    assert benchmarks.item_by_id(items, "id", "b").first()["item_no"] == 1
    with pytest.raises(Exception, match="unknown item: x"):
        benchmarks.item_by_id(items, "id", "x").collect()
    gold = "id string, seg_no int, start double, end double, text string, speaker string, duration double"
    kept, done = benchmarks.save_gold(spark.createDataFrame([("a", 0, 0.0, 1.0, " hi ", " ", 2.0), ("a", 1, 1.0, 2.0, "", None, 2.0), ("b", 0, 0.0, 1.0, " ", None, 2.0)], gold), "id", "seg_no")
    assert [(r["id"], r["text"], r["speaker"]) for r in kept.collect()] == [("a", "hi", None)]
    assert {r["id"]: r["complete"] for r in done.collect()} == {"a": True, "b": False}
    with pytest.raises(Exception, match="ordered and inside"):
        benchmarks.save_gold(spark.createDataFrame([("a", 0, 1.0, 1.0, "x", None, 2.0)], gold), "id", "seg_no")[0].collect()
    drafts = spark.createDataFrame([("a", [("x",)]), ("b", None)], "id string, segments array<struct<text:string>>")
    assert {r["id"]: len(r["draft_segments"]) for r in benchmarks.with_drafts(items, drafts, "id").collect()} == {"a": 1, "b": 0, "c": 0}
    documents = benchmarks.result_documents(spark.createDataFrame([("a", 0.5, None)], "id string, wer double, note string"), ["id"])
    assert documents.first()["content"] == '{"wer":0.5,"note":null}'


def test_profile_store(spark):
    empty = spark.createDataFrame([], "name string, dimension int, scale double, payload array<tinyint>")
    save = lambda store, *rows: profiles.save_profiles(store, spark.createDataFrame(list(rows), "name string, vector array<double>"))
    store = save(save(empty, (" b", [1.0, 0.0]), ("a", [0.0, 2.0])), ("b", [0.0, 1.0]))
    assert sorted((r["name"], [round(x, 3) for x in r["vector"]]) for r in profiles.load_profiles(store).collect()) == [("a", [0.0, 1.0]), ("b", [0.0, 1.0])]
    assert [r["name"] for r in profiles.delete_profiles(store, spark.createDataFrame([("a",), ("zz",)], "name string")).collect()] == ["b"]
    for bad in ([], [0.0, 0.0], [float("nan")]):
        with pytest.raises(Exception, match="no usable vector"):
            save(empty, ("x", bad)).collect()
    with pytest.raises(Exception, match="damaged profile"):
        profiles.load_profiles(store.withColumn("dimension", F.lit(3))).collect()
    with pytest.raises(Exception, match="too little"):
        profiles.enrollment_clips(spark.createDataFrame([("x", 0.0, 9.0), ("x", 9.0, 9.3)], "name string, start double, end double"), "name").collect()


def test_context_needs_no_known_call(spark):
    spans = spark.createDataFrame([(None, 1, 0.0, 1.0), (1, 1, 0.0, 1.0)], "call int, span_no int, start double, end double")
    none = spark.createDataFrame([], "call int, seg_no int, start double, end double, text string")
    assert [r["context"] for r in intervals.span_context(spans, none, "call", "span_no", "seg_no").collect()] == ["Previous: \nFollowing: "] * 2


def test_recovery_places_words_once(spark):
    """Words in a span and words in none come from one join; the second used to make all words again. A word at the edge of two spans is in both."""
    words = spark.createDataFrame([(1, i, float(i), i + 1.0, w, 0.9, "a", False, i == 5) for i, w in enumerate("a bb cc dd ee ff".split())] + [(2, 0, 0.0, 1.0, "x", None, None, True, None)], WORDS)
    spans = spark.createDataFrame([(1, 0, 1.0, 2.5, ["fragment"], ""), (1, 1, 2.5, 4.0, ["fragment"], "")], "call int, span_no int, start double, end double, reasons array<string>, context string")
    none = spark.createDataFrame([], "call int, span_no int, ins_no int, model string, part int, text string")
    unheard = spark.createDataFrame([], "call int, model string, part int, word_no int, start double, end double, text string, confidence double")
    found, _ = recovery.recover(words, spans, none, unheard, "call", "seq")
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["call"], r["seq"], r["text"], str(r["uncertain"]), r["overlap"]) for r in found.collect())
    assert got == [(1, 0, "a", "False", False), (1, 1, "bb", "True", False), (1, 2, "cc", "True", False), (1, 2, "cc", "True", False), (1, 3, "dd", "True", False), (1, 4, "ee", "False", False), (1, 5, "ff", "True", False), (2, 0, "x", "None", True)]
