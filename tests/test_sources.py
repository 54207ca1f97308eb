import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import audio
from parley.sources import exports, schema, transcripts
from parley.sources.audio import read_wav
from parley.streaming.sessions import live_sessions


def stored(tmp_path, name="call one.json", **more):
    data = {"source": "/in/call one.wav", "model": "base", "language": "hi", "language_probability": 0.875, "duration_seconds": 4.0, "text": "ignored", "segments": [{"start": 0.0, "end": 2.0, "text": " नमस्ते ", "speaker": "A", "words": [{"start": 0.0, "end": 1.0, "text": "नमस्ते"}]}, {"start": 2.0, "end": 4.0, "text": "hello", "overlap": True, "uncertain": True}]} | more
    (tmp_path / name).write_text(json.dumps(data, ensure_ascii=False))
    return str(tmp_path)


def test_transcripts_get_their_defaults(spark, tmp_path):
    row = transcripts.read_transcripts(spark, stored(tmp_path)).first()
    assert row["text"] == "नमस्ते hello" and row["device"] == "" and row["raw_segments"] == [] and row["segments"][0]["words"][0]["origin"] == "primary"
    flat = schema.flat_words(schema.flat_segments(transcripts.read_transcripts(spark, str(tmp_path))))
    assert [(r["seg_no"], r["word_no"], r["text"]) for r in flat.collect()] == [(0, 0, "नमस्ते")]


def test_missing_times_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="no start"):
        transcripts.read_transcripts(spark, stored(tmp_path, segments=[{"end": 1.0, "text": "x"}])).collect()


def test_damaged_checkpoints_are_missing(spark, tmp_path):
    assert transcripts.read_checkpoint(spark, str(tmp_path / "nothing")) is None
    (tmp_path / "bad.json").write_text("{broken")
    assert transcripts.read_checkpoint(spark, str(tmp_path)) is None
    (tmp_path / "bad.json").unlink()
    assert transcripts.read_checkpoint(spark, stored(tmp_path)).count() == 1


def test_seven_documents(spark, tmp_path):
    got = {r["kind"]: r for r in exports.documents(transcripts.read_transcripts(spark, stored(tmp_path))).collect()}
    assert set(got) == set(exports.KINDS) and got["srt"]["filename"] == "call one.transcript.srt"
    assert got["txt"]["content"] == "Source: call one.wav\nLanguage: hi (confidence: 88%)\nModel: base\nDevice: \nDuration: 00:00:04.000\n\n[00:00:00.000] A:  नमस्ते \n[00:00:02.000] [overlap] [uncertain] hello\n"
    assert got["srt"]["content"] == "1\n00:00:00,000 --> 00:00:02,000\nA:  नमस्ते \n\n2\n00:00:02,000 --> 00:00:04,000\nhello\n"
    assert got["md"]["content"].endswith("## Conversation\n\n- `00:00:00.000` **A:**  नमस्ते \n- `00:00:02.000` `[overlap]` hello\n")
    assert got["readable"]["content"].endswith("\n\nनमस्ते hello\n")
    assert json.loads(got["json"]["content"])["segments"][1]["confidence"] is None
    exports.write_documents(transcripts.read_transcripts(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("kind = 'srt'").count() == 1


def test_json_turns(spark):
    rows = spark.createDataFrame([('```[1] then [{"id": 1, "text": "a"}] and [more]',), ("none []",), (None,)], "a string")
    got = [r[0] for r in rows.select(transcripts.json_turns(F.col("a"))).collect()]
    assert got[0][0]["text"] == "a" and got[1:] == [None, None]


def test_manifest_and_corrections(spark, tmp_path):
    windows = spark.createDataFrame([("a", "x", 0.0, 400.0, 500.0), ("b", "x", 100.0, 300.0, 500.0)], "id string, source_name string, source_start double, source_end double, source_duration double")
    assert transcripts.manifest_items(windows).count() == 2
    for bad in (windows.where("id = 'a'"), windows.withColumn("source_duration", F.lit(10.0))):
        with pytest.raises(Exception, match="total|ends after"):
            transcripts.manifest_items(bad).collect()
    made = transcripts.correction(transcripts.read_transcripts(spark, stored(tmp_path)), F.lit(True)).first()["correction_metadata"]
    assert (made["training_eligible"], made["held_out"], made["verified"]) == (False, True, True)
    fits = spark.createDataFrame([(10.0, 10.7), (10.0, 11.0), (100.0, 100.9), (5.0, 0.0)], "a double, e double").select(transcripts.audio_fits(F.col("a"), F.col("e")))
    assert [r[0] for r in fits.collect()] == [True, False, True, True]


def test_running_jobs_become_errors(spark):
    log = spark.createDataFrame([("a", 1, "queued", ""), ("a", 2, "running", "half"), ("b", 1, "done", "ok")], "job_id string, ts long, status string, message string")
    assert sorted((r["job_id"], r["status"], r["resumable"]) for r in transcripts.latest_jobs(log).collect()) == [("a", "error", True), ("b", "done", False)]


def wave_of(x):
    return np.asarray(x, "<f4").tobytes()


def test_audio_measures_and_variants(spark):
    t = np.arange(32_000) / 16_000
    rows = spark.createDataFrame([(1, wave_of(0.1 * np.sin(2 * np.pi * 1000 * t))), (2, None), (3, wave_of(np.ones(100)))], "k int, pcm binary")
    got = {r["k"]: r["d"] for r in rows.select("k", audio.diagnostics(F.col("pcm")).alias("d")).collect()}
    assert got[1]["bandwidth_limited"] and not got[1]["clipped"] and abs(got[1]["spectral_centroid_hz"] - 1000) < 5 and got[1]["peak_dbfs"] == pytest.approx(-20, abs=0.01)
    assert got[2]["peak_dbfs"] is None and got[3]["clipped"]
    for mode in ("telephone", "auto"):
        out = rows.where("k = 1").select(audio.variant(F.col("pcm"), mode, F.lit(True)).alias("v")).first()["v"]
        x = np.frombuffer(out, "<f4")
        assert len(x) == 32_000 and np.abs(x).max() <= 10 ** (-1 / 20) + 1e-6
    assert rows.select(audio.variant(F.col("pcm"), "original", F.lit(False)).alias("v")).first()["v"] == rows.first()["pcm"]


def test_highpass_equals_the_recurrence():
    x = np.random.default_rng(1).normal(size=3000).astype(np.float32)
    a, last, want = 1 / (1 + 2 * np.pi * 70 / 16_000), 0.0, []
    for i, v in enumerate(x):
        last = a * (last + float(v) - float(x[i - 1] if i else x[0]))
        want.append(last)
    assert np.allclose(audio.highpass(x), want, atol=1e-4)


def test_noise_reduction_keeps_length_and_speech():
    rng, t = np.random.default_rng(2), np.arange(16_001) / 16_000
    x = (np.sin(2 * np.pi * 440 * t) * (t > 0.5) + 0.01 * rng.normal(size=len(t))).astype(np.float32)
    y = audio.reduce_noise(x)
    assert len(y) == len(x) and np.std(y[:6000]) < 0.85 * np.std(x[:6000]) and np.std(y[9000:15000]) > 0.9 * np.std(x[9000:15000])


def test_words_skip_silence(spark):
    t = np.arange(64_000) / 16_000
    x = 0.1 * np.sin(2 * np.pi * 300 * t) * ((t < 1) | (t > 3))
    rows = spark.createDataFrame([("one two", wave_of(x))], "text string, pcm binary")
    words = rows.select(audio.spoken_words(F.col("text"), F.lit(0.0), audio.active_intervals(F.col("pcm"))).alias("w")).first()["w"]
    assert [w["word"] for w in words] == ["one", "two"] and words[0]["end"] < 1.5 and words[1]["start"] > 2.5


def test_wav_round_trip(spark, tmp_path):
    x = np.linspace(-0.5, 0.5, 1600)
    data = spark.createDataFrame([(wave_of(x),)], "pcm binary").select(audio.wav(F.col("pcm")).alias("w")).first()["w"]
    (tmp_path / "a.wav").write_bytes(data)
    back = np.frombuffer(read_wav(spark, str(tmp_path)).first()["pcm"], "<f4")
    assert np.allclose(back, x, atol=1e-4)


def test_streamed_sessions_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:30:00"), (1, "a", "2024-01-01 03:00:00"), (2, "b", "2024-01-02 00:00:00"), (9, "z", "2024-02-01 00:00:00")], "user int, kind string, at string").selectExpr("user", "kind", "cast(at as timestamp) as ts")
    rows.write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, live_sessions(rows, "user", "kind").where("user < 9").collect()))
    stream = live_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "user", "kind")
    running = stream.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert sorted(map(tuple, spark.table("live").where("user < 9").collect())) == want
