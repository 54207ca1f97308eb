"""Byte-range reads of recordings, and shards that are published whole or not at all."""

import json
import os
import struct
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.sources import audio, shards


def write_wav(path, x, rate=16_000, channels=1):
    with wave.open(str(path), "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(np.asarray(x, "<i2").tobytes())


def raw_wav(kind, bits, data, channels=1, rate=16_000, extra=b""):
    form = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + extra + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(data)) + data


def floats(data):
    return np.frombuffer(data, "<f4")


def test_sample_formats_agree():
    x = np.array([-1.0, -0.5, 0.0, 0.25, 0.5])
    made = {
        (1, 8): (x * 128 + 128).astype(np.uint8).tobytes(),
        (1, 16): (x * 32768).astype("<i2").tobytes(),
        (1, 24): b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in x),
        (1, 32): (x * (1 << 31)).astype("<i4").tobytes(),
        (3, 32): x.astype("<f4").tobytes(),
    }
    for (kind, bits), data in made.items():
        assert floats(audio._decode(raw_wav(kind, bits, data, extra=b"LIST" + struct.pack("<I", 3) + b"abc\0"), 16_000)) == pytest.approx(x)
    with pytest.raises(ValueError, match="PCM"):
        audio._decode(raw_wav(2, 4, b"1234"), 16_000)
    with pytest.raises(ValueError, match="no samples"):
        audio._decode(raw_wav(1, 16, b""), 16_000)
    with pytest.raises(ValueError, match="not a WAV"):
        audio._decode(b"ID3 etc. etc.", 16_000)


@pytest.mark.parametrize("rate,channels", [(16_000, 1), (8_000, 2), (44_100, 1)])
def test_chunks_and_windows_are_slices_of_the_whole(spark, tmp_path, rate, channels):
    rnd = np.random.default_rng(1)
    os.makedirs(tmp_path / "in")
    for k, seconds in enumerate((3.7, 1.0)):
        write_wav(tmp_path / "in" / f"r{k}.wav", rnd.integers(-9000, 9000, int(seconds * rate) * channels), rate, channels)
    whole = {os.path.basename(r["path"]): floats(r["pcm"]) for r in audio.read_wav(spark, str(tmp_path / "in")).collect()}
    got = audio.read_chunks(spark, str(tmp_path / "in"), seconds=0.8).orderBy("path", "chunk_no").collect()
    for name, x in whole.items():
        parts = [r for r in got if r["path"].endswith(name)]
        assert np.array_equal(np.concatenate([floats(r["pcm"]) for r in parts]), x)
        assert [r["chunk_no"] for r in parts] == list(range(len(parts))) and parts[-1]["end"] == len(x) / 16_000
    wanted = spark.createDataFrame([("a", str(tmp_path / "in" / "r0.wav"), 0.5, 1.25), ("b", str(tmp_path / "in" / "r0.wav"), 3.0, 3.6), ("c", str(tmp_path / "in" / "r1.wav"), 0.0, 0.65)], "id string, path string, source_start double, source_end double")
    items, clips = audio.prepare_items(wanted, total=2.0)
    assert {(r["id"], r["source_name"], round(r["duration"], 6)) for r in items.collect()} == {("a", "r0.wav", 0.75), ("b", "r0.wav", 0.6), ("c", "r1.wav", 0.65)}
    for r in clips.collect():
        w = wanted.where(F.col("id") == r["id"]).first()
        x = whole[os.path.basename(w["path"])][round(w["source_start"] * 16_000) : round(w["source_end"] * 16_000)]
        assert np.abs(floats(audio._decode(r["content"], 16_000)) - x).max() < 1e-4
    with pytest.raises(Exception, match="too short"):
        audio.cut_windows(wanted.withColumn("source_end", F.lit(9.0))).count()
    with pytest.raises(Exception, match="total"):
        audio.prepare_items(wanted, total=2.5)[0].collect()


def test_a_window_of_a_long_recording_reads_its_bytes_only(tmp_path):
    path = tmp_path / "long.wav"
    with open(path, "wb") as file:  # two hours, most of it a hole in the file
        n = 2 * 3600 * 16_000
        file.write(raw_wav(1, 16, b"")[:-4] + struct.pack("<I", 2 * n))
        file.seek(44 + 2 * (n - 16_000))
        file.write(np.full(16_000, 16384, "<i2").tobytes())
    read = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            read.append(n)
            return self.file.read(n)

    with open(path, "rb") as file:
        form = audio.layout(file, os.path.getsize(path))
        assert form.frames == n
        assert floats(audio.window(Counted(file), form, n - 16_000, n, 16_000)).tolist() == [0.5] * 16_000
    assert sum(read) == 32_000


def clips(spark, n, split="train"):
    rows = [(split if i % 4 else "val", f"{split}_{i:06d}.wav", f"text {i} é", i / 2, bytes([i % 256]) * (i * 50)) for i in range(n)]
    return spark.createDataFrame(rows, shards.SCHEMA).repartition(4)


def rows_of(df):
    return sorted((tuple(map(lambda v: bytes(v) if isinstance(v, bytearray) else v, r)) for r in df.collect()))


def test_shards_are_read_back_and_bounded(spark, tmp_path):
    path = str(tmp_path / "out")
    first, more = clips(spark, 60), clips(spark, 10, "extra")
    assert shards.read_shards(spark, path).count() == 0
    shards.write_shards(first, path, shard_bytes=20_000)
    assert rows_of(shards.read_shards(spark, path)) == rows_of(first)
    index = shards.read_index(path)
    assert len(index) > 4 and sum(s["rows"] for s in index) == 60
    assert max(os.path.getsize(f"{path}/{s['tar']}") for s in index) < 20_000 + 60 * 50 + 12_000
    lines = [json.loads(x) for s in index for x in open(f"{path}/{s['lines']}", encoding="utf-8")]
    assert {x["audio_filepath"] for x in lines} == {r["audio_filepath"] for r in first.collect()}
    shards.write_shards(more, path)
    assert rows_of(shards.read_shards(spark, path)) == rows_of(first.unionByName(more))
    shards.write_shards(more, path, mode="overwrite")
    assert rows_of(shards.read_shards(spark, path)) == rows_of(more)
    files = sorted(os.path.relpath(os.path.join(f, n), path) for f, _, names in os.walk(path) for n in names)
    assert files == sorted([shards.INDEX, *(s[k] for s in shards.read_index(path) for k in ("tar", "lines"))])


def test_a_failed_write_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    good = clips(spark, 8)
    shards.write_shards(good, path)
    bad = good.withColumn("duration", F.when(F.col("audio_filepath") == "train_000005.wav", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("duration")))
    with pytest.raises(Exception, match="lost"):
        shards.write_shards(bad, path)
    assert rows_of(shards.read_shards(spark, path)) == rows_of(good)
    left = [n for f, _, names in os.walk(path) for n in names]
    assert len(left) == 1 + 2 * len(shards.read_index(path))
    # A task that wrote but was not reported leaves nothing either.
    writer = shards.ShardWriter({"path": path}, False)
    row = {"split": "train", "audio_filepath": "x.wav", "text": "x", "duration": 1.0, "content": b"x"}
    lost, kept = writer.write(iter([row])), writer.write(iter([row | {"audio_filepath": "y.wav"}]))
    assert lost.shards and not any("_temporary" in s["tar"] for s in shards.read_index(path))
    writer.commit([kept, None])
    assert {r["audio_filepath"] for r in shards.read_shards(spark, path).collect()} == {r["audio_filepath"] for r in good.collect()} | {"y.wav"}


def test_waveforms_of_texts_come_in_small_batches(spark):
    from parley.plans import fixtures as fx

    made = fx.spoken.__globals__["F"].pandas_udf
    caught = []

    def keep(f, kind):
        caught.append(f)
        return made(f, kind)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fx.F, "pandas_udf", keep)
        column = fx.spoken(F.col("text"))
    texts = pd.Series(["é" * 20_000, None, ""] * 30)
    parts = list(caught[0](iter([texts])))
    assert len(parts) > 5 and max(sum(map(len, p)) for p in parts) <= 2 * fx.SPOKEN_BYTES
    assert [len(d) for p in parts for d in p] == [64 * len(t or "") for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string").select("k", column.alias("pcm")).collect()
    assert all(len(r["pcm"]) == 64 * len(texts[r["k"]] or "") for r in rows)


def test_peak_alone_is_that_of_the_diagnostics(spark):
    from parley.functions import audio as measures

    waves = [np.array(x, "<f4").tobytes() for x in ([0.25, -0.5], [0.0] * 9, [1.0])]
    rows = spark.createDataFrame([(w,) for w in [*waves, b"", None]], "pcm binary")
    got = rows.select(measures.peak_dbfs(F.col("pcm")).alias("p"), measures.diagnostics(F.col("pcm"))["peak_dbfs"].alias("d"), measures.pcm16(F.col("pcm")).alias("s")).collect()
    assert [r["p"] for r in got] == [r["d"] for r in got]
    assert [r["s"] if r["s"] is None else len(r["s"]) for r in got] == [4, 18, 2, 0, None]


LONG = """
import resource, sys
import numpy as np
from parley.functions import audio

def used():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024

x = np.load(sys.argv[1])
audio.presence(audio.highpass(x[:1000]))
before = used()
y = audio.presence(audio.highpass(x))
print(used() - before)
np.save(sys.argv[1], y)
"""


def lifted(x, rate=16_000):
    hertz = np.fft.rfftfreq(len(x), 1 / rate)
    lift = np.where((hertz >= 1800) & (hertz <= 3400), 1.5 * np.sin((hertz - 1800) / 1600 * np.pi), 0.0)
    return np.fft.irfft(np.fft.rfft(x.astype(np.float64)) * 10 ** (lift / 20), len(x))


def test_a_long_recording_is_prepared_in_little_memory(tmp_path):
    import subprocess
    import sys

    from parley.functions import audio as measures

    # A transform of this length, 16 times a prime, takes 180 bytes a sample.
    x = np.repeat(np.random.default_rng(2).uniform(-0.5, 0.5, 131_071).astype("<f4"), 16)
    np.save(tmp_path / "x.npy", x)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", LONG, str(tmp_path / "x.npy")], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True)
    assert float(done.stdout) < 200
    assert np.array_equal(np.load(tmp_path / "x.npy"), lifted(measures.highpass(x)).astype(np.float32))


@pytest.mark.parametrize("size,rate", [(5000, 16_000), (4999, 16_000), (3000, 44_100), (2000, 5_000), (1999, 5_000), (2000, 6_800), (600, 3_000)])
def test_any_part_of_the_lift_is_that_of_the_whole(monkeypatch, size, rate):
    from parley.functions import audio as measures

    one = np.zeros(size)
    one[0] = 1
    want = lifted(one, rate) - one
    assert np.abs(measures.lift_response(np.arange(size), size, rate) - want).max() < 1e-15
    assert np.abs(measures.lift_response(np.arange(-7, 5), size, rate) - want[np.arange(-7, 5)]).max() < 1e-15
    x = np.random.default_rng(3).uniform(-0.5, 0.5, size).astype(np.float32)
    for block in (64, 1000, size - 1):
        monkeypatch.setattr(measures, "BLOCK", block)
        assert np.abs(measures.presence(x, rate) - lifted(x, rate)).max() < 6e-8


def test_variants_never_leave_python_but_as_measures(spark):
    from parley import plans
    from parley.functions import audio as measures
    from parley.plans import fixtures as fx

    rows = spark.createDataFrame([(0, "Hello there, é.\n" * 40), (1, "x"), (2, ""), (3, None)], "k int, text string")
    for mode, noisy in (("original", False), ("telephone", True), ("auto", True), ("auto", False)):
        v = measures.variant_file(F.col("text"), mode, F.lit(noisy), fx.wave)
        apart = rows.select("k", measures.variant(fx.spoken(F.col("text")), mode, F.lit(noisy)).alias("pcm"))
        want = {r["k"]: (r["n"], r["p"]) for r in apart.select("k", F.length(measures.wav(F.col("pcm"))).alias("n"), measures.peak_dbfs(F.col("pcm")).alias("p")).collect()}
        got = {r["k"]: r["v"] for r in rows.select("k", v.alias("v")).collect()}
        assert {k: got[k] and tuple(got[k]) for k in (0, 1)} == {k: want[k] for k in (0, 1)} and got[2] is None and got[3] is None
    x = fx.wave("Hello")
    assert spark.createDataFrame([(x.tobytes(),)], "pcm binary").select(measures.wav(F.col("pcm"), 8_000).alias("w")).first()["w"] == measures.wav_file(x, 8_000)
    plan = plans.QUERIES["audio_variants"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "pcm" not in plan
