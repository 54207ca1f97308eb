"""Word labels with names and overrides, utterances by voice, and profiles in blocks."""

import random

import numpy as np
import pytest

from parley.operators import profiles, refinement, sessions

WORDS = "call int, seq int, start double, end double, text string, confidence double, speaker string, overlap boolean, uncertain boolean"


def words(spark, rows):
    return spark.createDataFrame([(c, i, float(a), float(b), t, None, who, False, False) for c, i, a, b, t, who in rows], WORDS)


def test_words_take_names_and_overrides_and_keep_their_own_without_turns(spark):
    given = words(spark, [(1, 0, 0, 1, "a", None), (1, 1, 1.1, 1.3, "b", None), (1, 2, 1.4, 2.4, "c", None), (1, 3, 5, 6, "d", None), (2, 0, 0, 1, "x", "own")])
    turns = spark.createDataFrame([(1, 0, "S0", 0.0, 1.05), (1, 1, "S1", 1.05, 1.35), (1, 2, "S0", 1.35, 2.5), (1, 3, "S2", 9.0, 9.5)], "call int, turn_no int, speaker string, start double, end double")
    raw = turns.unionByName(spark.createDataFrame([(1, 4, "S1", 1.4, 2.4)], turns.schema))
    overrides = spark.createDataFrame([(1, "S0", "Mira")], "call int, speaker string, label string")
    made = {(r["call"], r["seq"]): (r["speaker"], r["overlap"]) for r in refinement.label_words(given, turns, raw, "call", "seq", "turn_no", overrides=overrides).collect()}
    # The short word between two of one speaker is theirs; the last is nearest to the third turn.
    assert made == {(1, 0): ("Mira", False), (1, 1): ("Mira", False), (1, 2): ("Mira", True), (1, 3): ("Mira", False), (2, 0): ("own", False)}
    found = refinement.assign_word_speakers(given, turns, raw, "call", "seq", "turn_no", overrides=overrides).orderBy("call", "seg_no").collect()
    assert [(r["call"], r["text"], r["overlap"]) for r in found] == [(1, "a b", False), (1, "c", True), (1, "d", False), (2, "x", False)]


def test_groups_break_on_length_counted_from_their_start(spark):
    given = words(spark, [(1, i, i * 0.9, i * 0.9 + 0.8, "w", "A") for i in range(20)] + [(1, 20, 18.5, 19, "w", "A"), (1, 21, 19, 20, "w", "B")])
    got = {r["seq"]: r["group"] for r in sessions.label_groups(given, "call", "seq").collect()}
    want, begin = {}, 0
    for i in range(20):
        if i * 0.9 + 0.8 - begin * 0.9 > 6.0:
            begin = i
        want[i] = begin
    assert got == want | {20: 20, 21: 21}


@pytest.fixture
def call(spark):
    """Two clear speakers; the third utterance sounds like the first speaker, the fourth is unclear and high, the fifth is long."""
    given = words(spark, [(1, 0, 0, 2, "a", "A"), (1, 1, 3, 5, "b", "B"), (1, 2, 6, 7, "c", "B"), (1, 3, 8, 9, "d", "A"), (1, 4, 10, 12, "e", "B"), (2, 0, 0, 2, "z", "A")])
    vectors = [(1, 0, [1.0, 0.0, 0.0], 100.0), (1, 1, [0.0, 1.0, 0.0], 200.0), (1, 2, [0.9, 0.1, 0.0], None), (1, 3, [0.5, 0.5, 0.1], 200.0), (1, 4, [0.0, 1.0, 0.0], 200.0), (2, 0, [0.0, 0.0, 1.0], None)]
    clusters = spark.createDataFrame([(1, 0, "A", [1.0, 0.0, 0.0]), (1, 1, "B", [0.0, 2.0, 0.0]), (2, 0, "A", [1.0, 0.0, 0.0])], "call int, label_no int, name string, vector array<double>")
    return given, spark.createDataFrame(vectors, "call int, utterance int, vector array<double>, pitch double"), clusters


def people(spark, rows):
    return spark.createDataFrame(rows, "profile_no int, name string, vector array<double>")


def test_utterances_take_the_cluster_or_the_pitch_they_sound_like(spark, call):
    given, vectors, clusters = call
    made, decisions = refinement.refine_words(given, vectors, clusters, people(spark, []), "call", "seq")
    assert {(r["call"], r["utterance"]): (r["selected"], r["source"]) for r in decisions.collect()} == {
        (1, 0): ("A", "call centroid"), (1, 1): ("B", "call centroid"), (1, 2): ("A", "call centroid"), (1, 3): ("B", "call pitch"), (1, 4): ("B", "call centroid"),
    }
    assert [r["speaker"] for r in made.orderBy("call", "seq").collect()] == ["A", "B", "A", "B", "B", "A"]
    segments = refinement.refine_segments(given, vectors, clusters, people(spark, []), "call", "seq")[0]
    assert segments.count() == 6
    means = {(r["call"], r["name"]): r["vector"] for r in refinement.call_centroids(refinement.utterances(given, "call", "seq").join(vectors, ["call", "utterance"]), "call").collect()}
    assert means[1, "A"] == pytest.approx([0.75, 0.25, 0.05]) and means[1, "B"] == pytest.approx([0.3, 0.7, 0.0])


def test_enrolled_people_come_first(spark, call):
    given, vectors, clusters = call
    one = refinement.refine_words(given, vectors, clusters, people(spark, [(0, "Ida", [1.0, 0.1, 0.0])]), "call", "seq")[1]
    assert [(r["selected"], r["source"]) for r in one.orderBy("utterance").collect()][:3] == [("Ida", "enrolled profile"), ("B", "call centroid"), ("Ida", "enrolled profile")]
    two = refinement.refine_words(given, vectors, clusters, people(spark, [(0, "Ida", [1.0, 0.1, 0.0]), (1, "Jon", [0.0, 1.0, 0.0]), (2, "Kim", [1.0, 1.0])]), "call", "seq")[1]
    assert [r["selected"] for r in two.orderBy("utterance").collect()] == ["Ida", "Jon", "Ida", "B", "Jon"]


def test_profiles_in_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    many = [(i, f"p{i}", list(map(float, rnd.normal(size=4 + i % 2)))) for i in range(11)] + [(11, "tie", None)]
    many[11] = (11, "tie", many[4][2])
    asked = [(i, list(map(float, rnd.normal(size=4 + i % 2)))) for i in range(40)] + [(40, many[4][2]), (41, None), (42, [1.0])]
    random.Random(1).shuffle(many)
    rows = spark.createDataFrame(asked, "k int, vector array<double>").repartition(3)
    take = lambda: {(r["k"], r["rank"]): (r["name"], round(r["similarity"], 9)) for r in profiles.top_profiles(rows, people(spark, many), "k", 3).collect()}
    whole = take()
    assert whole[40, 1] == ("tie", 1.0) and whole[40, 2] == ("p4", 1.0) and len(whole) == 41 * 3
    for k, v in asked[:40]:
        want = sorted(((float(np.dot(v, p)) / np.linalg.norm(v) / np.linalg.norm(p), n, name) for n, name, p in many if len(p) == len(v)), reverse=True)[:3]
        assert [whole[k, r][0] for r in (1, 2, 3)] == [w[2] for w in want]
    monkeypatch.setattr(profiles, "BLOCK", 3)
    assert take() == whole
    assert profiles.top_profiles(rows, people(spark, []), "k").count() == 0


def test_pairs_of_words_and_turns_are_dealt_once(spark):
    from parley.operators import intervals

    words = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 63.5, 64.5), (1, 2, 90.0, 91.0)], "call int, seq int, start double, end double")
    turns = spark.createDataFrame([(1, 0, "a", 0.0, 64.0), (1, 1, "b", 64.0, 70.0), (1, 2, None, 89.0, 95.0), (1, 3, "b", 0.5, 1.0)], "call int, turn_no int, speaker string, start double, end double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flags = intervals.overlap_flags(words, turns, "call", "seq")
        assert flags._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        assert sorted(r["seq"] for r in flags.collect()) == [0, 1]
        found = intervals.assign_speakers(words, turns, "call", "seq", "turn_no").collect()
        assert sorted((r["seq"], r["speaker"]) for r in found) == [(0, "a"), (1, "a")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_words_are_put_into_utterances_once(spark, call, monkeypatch):
    """Every branch of the decisions used to label all words anew."""
    given, vectors, _ = call
    made, label = [], sessions.label_groups
    monkeypatch.setattr(sessions, "label_groups", lambda *a, **k: made.append(1) or label(*a, **k))
    decisions = refinement.refine_segments(given, vectors, None, people(spark, [(0, "Ida", [1.0, 0.1, 0.0]), (1, "Jon", [0.0, 1.0, 0.0])]), "call", "seq")[1]
    assert len(made) == 1 and decisions.count() == 5
    # The only Python left in the decisions' plan compares utterances with people.
    assert decisions._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_vectors_of_other_lengths_and_missing_ones_meet_no_person(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0]), (1, None), (2, [1.0]), (3, [1.0, 1.0, 1.0]), (4, [2.0, 0.0])], "k int, vector array<float>")
    found = profiles.top_profiles(rows, people(spark, [(0, "Ida", [1.0, 0.0]), (1, "Jon", [0.0, 1.0])]), "k", 1).collect()
    assert {r["k"]: (r["name"], r["similarity"]) for r in found} == {0: ("Jon", 1.0), 4: ("Ida", 1.0)}
