"""Job status from a stream with late, repeated and missing rows; words in Latin letters."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from parley.functions import roman
from parley.streaming import jobs
from parley.streaming.sessions import turn_stream


def test_silent_jobs_become_resumable_errors(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    rows = [
        [("a", 0, "queued", ""), ("b", 1, "running", "half"), ("a", 2, "running", "10 %"), ("c", 3, "running", "x")],
        [("a", 1, "queued", "late"), ("a", 2, "running", "10 %"), ("b", 5, "done", "ok"), ("c", 40, "running", "y")],
        [("z", 200, "queued", "")],
        [("a", 210, "running", "again"), ("z", 215, "queued", "")],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "job_id string, ts timestamp, status string, message string"
    for k, batch in enumerate(rows):
        made = spark.createDataFrame(batch, "job_id string, s long, status string, message string")
        made.select("job_id", F.timestamp_seconds("s").alias("ts"), "status", "message").coalesce(1).write.mode("append").parquet(source)
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        running = jobs.publish(jobs.job_status(log, silence=60_000), out, str(tmp_path / "state"), availableNow=True)
        running.awaitTermination(120)
        assert running.exception() is None
        got = {r["job_id"]: (r["at"] // 1000, r["status"], r["message"], r["resumable"]) for r in jobs.current(spark, out).collect()}
        if k == 1:
            assert got == {"a": (2, "running", "10 %", False), "b": (5, "done", "ok", False), "c": (40, "running", "y", False)}
        if k == 2:
            assert got["a"] == (2, "error", "interrupted", True) and got["c"] == (40, "error", "interrupted", True) and got["b"] == (5, "done", "ok", False)
    assert got["a"] == (210, "running", "again", False)
    # A batch that is written again replaces itself.
    before = sorted(map(tuple, jobs.current(spark, out).collect()))
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if "=" in p.name)
    spark.read.schema(jobs.SCHEMA).parquet(f"{out}/batch={last}").cache().write.mode("overwrite").parquet(f"{out}/again")
    spark.read.schema(jobs.SCHEMA).parquet(f"{out}/again").write.mode("overwrite").parquet(f"{out}/batch={last}")
    (tmp_path / "out" / "again").rename(tmp_path / "aside")
    assert sorted(map(tuple, jobs.current(spark, out).collect())) == before


def test_streamed_speaking_time_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0.0, 5.0), (1, "a", 20.0, 61.0), (1, "b", 61.0, 90.0), (2, "a", 0.0, 1.5), (9, "z", 0.0, 90_000.0)], "call int, speaker string, start double, end double")
    rows = rows.withColumn("arrived", F.timestamp_micros((F.col("end") * 1_000_000).cast("long")))
    rows.write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, turn_stream(rows, "call").where("call < 9").collect()))
    stream = turn_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "call")
    running = stream.writeStream.format("memory").queryName("minutes").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert sorted(map(tuple, spark.table("minutes").where("call < 9").collect())) == want and len(want) == 4


@pytest.mark.parametrize("word,want", [("नमस्ते", "namaste"), ("राम", "raam"), ("क", "ka"), ("हिंदी", "hindii"), ("कृपया", "krpayaa"), ("४२", "42"), ("தமிழ்", "tamilll"), ("Ça", "Ca"), ("Straße", "Strasse"), ("œuvre", "oeuvre"), ("ok", "ok"), ("", "")])
def test_romanized_words(word, want):
    assert roman.romanize(word) == want


def plain(word):
    """The same by looking at each character and the one after."""
    letters, out, text = roman._letters(), [], unicodedata.normalize("NFC", word)
    i = 0
    while i < len(text):
        script, kind, sound = letters[text[i]]
        begin, i = i, i + 1
        if kind == "consonant":
            at = lambda k: letters.get(text[k], ("", "", "")) if k < len(text) else ("", "", "")
            if i < len(text) and at(i)[0] == script and unicodedata.name(text[i]).endswith("SIGN NUKTA"):
                i += 1
            if at(i)[0] == script and at(i)[1] == "sign":
                sound, i = sound[:-1] + at(i)[2], i + 1
            elif i < len(text) and at(i)[0] == script and unicodedata.name(text[i]).endswith("SIGN VIRAMA"):
                sound, i = sound[:-1], i + 1
            elif i == len(text) and begin and script in roman.CLIPPED:
                sound = sound[:-1]
        out.append(sound)
    return "".join(out)


def test_all_indic_letters_equal_the_plain_loop(spark):
    letters = sorted(roman._letters())
    assert len(letters) > 500
    words = letters + [a + b for a in letters for b in letters if (ord(a) * 7 + ord(b)) % 11 == 0] + ["क" + c + "म" for c in letters]
    words = [w for w in words if all(c in roman._letters() for c in unicodedata.normalize("NFC", w))]
    assert [roman.romanize(w) for w in words] == [plain(w) for w in words]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words[:2000] + words[:50] + [None, "123", "Don’t"])], "k int, word string")
    got = {r["k"]: r["letters"] for r in roman.aligner_words(rows, "word").collect()}
    assert len(got) == 2053 and got[2050] is None and got[2051] == "*" and got[2052] == "don't"
    assert all(got[i] == got[2000 + i] for i in range(50))
