"""Stored results that are whole or not there, and the matrix that resumes."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from parley.functions import audio
from parley.operators import matrix, metrics
from parley.sources.store import Checkpoints, Store
from parley.sources.transcripts import settings_key


def test_checkpoints_fall_back_and_survive_a_killed_writer(spark, tmp_path, monkeypatch):
    store = Checkpoints(spark, str(tmp_path / "points"))
    key = spark.range(1).select(settings_key({"model": "a"}, F.lit("content"))).first()[0]
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    assert store.load("align", key) is None
    assert store.run("align", key, lambda: make(3)).count() == 3 and store.run("align", key, lambda: make(9)).count() == 3 and made == [3]
    # Killed after the data and before the pointer: the version before counts.
    with monkeypatch.context() as patch:
        patch.setattr(Store, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.save(spark.range(5), "align", key)
    assert store.load("align", key).count() == 3
    store.save(spark.range(7), "align", key)
    assert store.load("align", key).count() == 7
    newest = store.pointer(f"align/{key}")["versions"][0]["folder"]
    shutil.rmtree(newest)
    assert store.load("align", key).count() == 3
    (tmp_path / "points" / "align" / f"{key}.json").write_text("{half")
    assert store.load("align", key) is None and store.load("other", key) is None


def items(spark, n):
    return spark.createDataFrame([(f"i{k}", "one two three four five six", True) for k in range(n)], "item string, ref string, complete boolean")


def answer(calls, name, hyp="one two three four five", fails=None):
    def recognize(todo, mode):
        calls.append((name, mode, todo.count()))
        if fails == mode:
            raise ValueError("no memory\nat all")
        return todo.select("item", F.lit(hyp if mode == "original" else "one two three four five six").alias("hyp"), F.lit(2.0).alias("scored"), F.lit(1.9).alias("correct"))

    return recognize


def test_a_second_run_computes_nothing(spark, tmp_path):
    ticks = iter(range(0, 1000, 10))
    calls = []
    found = matrix.Matrix(spark, str(tmp_path / "m"), clock=lambda: next(ticks))
    run = {"a": answer(calls, "a"), "b": answer(calls, "b", fails="telephone"), "c": answer(calls, "c", "one")}
    made, errors = found.run(items(spark, 2), run)
    assert made == 10 and errors == {"b:telephone": "no memory"}
    assert found.run(items(spark, 3), run)[0] == 5 and calls[-1] == ("c", "telephone", 1)
    before = len(calls)
    assert found.run(items(spark, 3), {k: run[k] for k in "ac"}) == (0, {}) and len(calls) == before
    again = matrix.Matrix(spark, str(tmp_path / "m"))
    reports = again.reports(items(spark, 3), ["a", "b", "c", "never"])
    got = {(r["candidate"], r["mode"]): r for r in reports.collect()}
    assert set(got) == {(c, m) for c in "ac" for m in matrix.MODES}
    assert got["a", "original"]["wer"] == pytest.approx(1 / 6) and got["a", "telephone"]["wer"] == 0 and got["a", "original"]["runtime_40min"] == 4 * 20
    promoted = metrics.promotion(reports)
    assert promoted.first()["primary"] == "a" and promoted.first()["audio_mode"] == "telephone"
    document = json.loads(matrix.report_document(reports, promoted, errors).first()["content"])
    assert document["errors"] == errors and document["promoted"]["primary"] == "a" and set(document["reports"]) == {"a:original", "a:telephone", "c:original", "c:telephone"}
    with pytest.raises(ValueError, match="complete"):
        found.run(items(spark, 1).withColumn("complete", F.lit(None).cast("boolean")), run)
    with pytest.raises(RuntimeError, match="every"):
        found.run(items(spark, 5), {"b": run["b"]})
    with pytest.raises(RuntimeError, match="has all"):
        found.reports(items(spark, 4), ["a"])


def test_diagnostics_document(spark):
    import numpy as np

    pcm = (0.1 * np.random.default_rng(1).normal(size=16_000)).astype("<f4").tobytes()
    rows = spark.createDataFrame([(pcm,), (None,)], "pcm binary").select(audio.diagnostics(F.col("pcm")).alias("d"))
    found = json.loads(rows.select(audio.diagnostics_json(F.col("d"), "auto").alias("c")).first()["c"])
    assert found["noisy"] and found["noise_reduction_applied"] and found["variant"] == "telephone-conservative" and found["dereverb_applied"] is False and found["duration_seconds"] == 1.0
    assert len(found) == 21
    plain = json.loads(rows.select(audio.diagnostics_json(F.col("d"), "original").alias("c")).first()["c"])
    assert plain["variant"] == "original" and not plain["noise_reduction_applied"]
