from pyspark.sql import functions as F

from parley.functions import bits, text, timing
from parley.functions.edit import with_distance, with_error_rates


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_spoken_and_written_numbers_are_equal(spark):
    for said, written in [("वन हंड्रेड एट रुपये", "108 रुपये"), ("एक सौ आठ", "१०८"), ("सिक्सटी फोर", "चौंसठ"), ("फिफ्टी फोर", "54"), ("एटी", "80")]:
        assert one(spark, text.normalize(F.col("a")), a=said) == one(spark, text.normalize(F.col("a")), a=written)
    assert one(spark, text.normalize(F.col("a"), numbers=False), a=" Hé-LLO,\tWorld_1!  ß") == "hé llo world_1 ss"
    assert one(spark, text.normalize(F.col("a"), exact=True), a="éTE") == "éte"
    assert spark.range(1).select(text.normalize(F.lit(None).cast("string"))).first()[0] is None


def test_error_rates(spark):
    rows = [(1, "a b c d", "a x c"), (2, "", ""), (3, "", "x"), (4, None, None), (5, "same here", "same here"), (6, "a", "b c d")]
    got = {r["k"]: r for r in with_error_rates(spark.createDataFrame(rows, "k int, ref string, hyp string"), "ref", "hyp").collect()}
    assert (got[1]["word_errors"], got[1]["wer"]) == (2, 0.5)
    assert [got[k]["wer"] for k in (2, 3, 4, 5, 6)] == [0.0, 1.0, 0.0, 0.0, 3.0]


def test_token_distance_is_symmetric_and_exact(spark):
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rnd = random.Random(1)
    pairs = [([rnd.choice("abcé") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 12))], [rnd.choice("abcé") for _ in range(rnd.randint(0, 12))]) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in with_distance(with_distance(df, "a", "b", "d"), "b", "a", "e").collect():
        assert r["d"] == r["e"] == plain(r["a"], r["b"])


def test_recalls(spark):
    recall = text.recall(text.counts(F.col("a")), text.counts(F.col("b")))
    assert one(spark, recall, a=["1", "1", "2"], b=["1", "2", "3"]) == 2 / 3
    assert spark.range(1).select(text.recall(text.counts(F.array().cast("array<string>")), text.counts(F.array(F.lit("1"))))).first()[0] == 1.0
    assert one(spark, text.numbers(text.normalize(F.col("a"))), a="call 10 or x9, then 3.5") == ["10", "3", "5"]
    assert one(spark, text.name_recall(F.col("a"), F.col("b"), ("Asha", "Ravi", "Nobody")), a="asha met ravi", b="asha met") == 0.5


def test_prompt_copy(spark):
    copied = text.prompt_copied(text.tokens(F.col("a")), text.tokens(F.col("b")))
    assert one(spark, copied, a="so One two, three four five", b="names: one two three four")
    assert not one(spark, copied, a="one x two y three z four", b="one two three four")
    assert not one(spark, copied, a="one two three", b="one two three")


def test_context_copy(spark):
    copied = lambda: text.context_copied(text.tokens(F.col("a")), text.tokens(F.col("b")), text.tokens(F.col("c")))
    assert one(spark, copied(), a="p q r s", b="p q r s t", c="x y")
    assert not one(spark, copied(), a="p q r s", b="p q r s t", c="p q r")


def test_repetitions(spark):
    count = text.repetition_count(text.tokens(F.col("a")))
    assert one(spark, count, a="yes yes") == 1
    assert one(spark, count, a="a b a b") == 1
    assert one(spark, count, a="call calling now") == 1
    assert one(spark, count, a="x y z x y z") == 1
    assert one(spark, count, a="") == 0


def test_rewrites(spark):
    valid = lambda: text.valid_rewrite("x", "y", ("Asha",))
    df = spark.createDataFrame(
        [("asha paid 10 rupees to the bank today", t) for t in ("Asha paid 10 rupees to the bank, today.", "Asha paid 11 rupees to the bank today", "Asha paid 10 rupees to the big old bank of today", "paid 10 rupees to the bank today", " ")], "a string, b string"
    ).select(text.rewrite_parts(F.col("a")).alias("x"), text.rewrite_parts(F.col("b")).alias("y"))
    assert [r[0] for r in df.select(valid()).collect()] == [True, False, False, False, False]


def test_structured_turns(spark):
    df = spark.createDataFrame([(["a", "b"], [(1, " a "), (2, "z")], [True, False]), (["a", "b"], [(2, "a"), (1, "b")], [True, True]), (["a", "b"], [(1, "a")], [True])], "s array<string>, r array<struct<id:int,text:string>>, ok array<boolean>")
    assert [r[0] for r in df.select(text.valid_turns(F.col("s"), F.col("r"), F.col("ok"))).collect()] == [["a", None], None, None]


def test_sentence_ends_and_lists(spark):
    assert one(spark, text.end_sentence(F.col("a")), a=" well ") == "well।"
    assert one(spark, text.end_sentence(F.col("a")), a="well?") == "well?"
    assert one(spark, text.end_sentence(F.col("a")), a="  ") == ""
    assert one(spark, text.rejected_turn(F.col("a")), a="well?! ") == "[uncertain] well।"
    assert one(spark, text.split_list(F.col("a")), a="a, b,,\n c ") == ["a", "b", "c"]
    assert one(spark, text.redact(F.col("a")), a="bad hf_abcDEF1 token") == "bad hf_*** token"


def test_scripts(spark):
    for given, wanted in [("ਕਮਲ", "कमल"), ("કમલ", "कमल"), ("কমল x", "कमल x"), ("ਂ", "ं")]:
        assert one(spark, text.to_devanagari(F.col("a")), a=given) == wanted


def test_clock(spark):
    assert one(spark, timing.clock(F.col("a")), a=65.432) == "00:01:05.432"
    assert one(spark, timing.clock(F.col("a"), srt=True), a=3661.007) == "01:01:01,007"
    assert one(spark, timing.clock(F.col("a")), a=-1.0) == "00:00:00.000"
    assert one(spark, timing.clock(F.col("a")), a=0.0625) == "00:00:00.062"
    assert one(spark, timing.clock(F.col("a")), a=360000.0) == "100:00:00.000"


def test_word_times(spark):
    seg = spark.createDataFrame([(1, 0.0, 6.0, "ab abcd"), (2, 3.0, 3.0, "x"), (3, 0.0, 1.0, " "), (4, 0.0, 1.0, None)], "k int, start double, end double, text string")
    got = [(r["k"], r["word_no"], r["word"], r["word_start"], r["word_end"]) for r in timing.proportional_words(seg, ["k"]).orderBy("k", "word_no").collect()]
    assert got == [(1, 0, "ab", 0.0, 2.0), (1, 1, "abcd", 2.0, 6.0)]


def test_words_are_clamped_to_the_last_kept_start(spark):
    rows = [(1, 0, 2.0, 3.0, "a"), (1, 1, 1.0, 1.5, "late"), (1, 2, 1.0, 2.5, "b"), (1, 3, 9.0, 12.0, "c"), (1, 4, 9.0, 9.5, " "), (1, 5, float("nan"), 9.5, "n")]
    df = spark.createDataFrame(rows, "call int, seq int, start double, end double, text string")
    got = [(r["text"], r["start"], r["end"]) for r in timing.validate_words(df, "call", F.lit(10.0), ["seq"]).orderBy("seq").collect()]
    assert got == [("a", 2.0, 3.0), ("b", 2.0, 2.5), ("c", 9.0, 10.0)]


def test_pieces_become_words_or_fall_back(spark):
    schema = "key int, text string, start double, end double, tokens array<string>, timestamps array<double>, logprobs array<double>"
    rows = [(1, "hello you", 10.0, 12.0, ["▁hel", "lo", "▁you"], [0.0, 0.5, 1.0], [0.0, 0.0, -1.0]), (2, "hello you", 0.0, 2.0, ["▁a", "▁b"], [2.0, 0.0], None), (3, "three words here", 0.0, 2.0, ["▁a", "▁b"], [0.0, 1.0], None), (4, "x", 0.0, 1.0, None, None, None)]
    got = timing.piece_words(spark.createDataFrame(rows, schema), "key").orderBy("key", "word_no").collect()
    assert [(r["key"], r["word"], r["word_start"], r["word_end"], r["fallback"]) for r in got] == [(1, "hello", 10.0, 11.0, False), (1, "you", 11.0, 12.0, False), (2, None, None, None, True), (3, None, None, None, True), (4, None, None, None, True)]


def test_multisets_of_long_texts(spark):
    import collections
    import random

    rnd = random.Random(5)
    pairs = [([rnd.choice("abcdefg") + str(rnd.randint(0, k)) for _ in range(n)], [rnd.choice("abcdefg") + str(rnd.randint(0, k)) for _ in range(m)]) for k, n, m in ((3, 200, 150), (9, 40, 0), (0, 0, 0), (10**6, 3_000, 2_000), (5, 0, 9))]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("a", "b", text.counts(F.col("a")).alias("n"), text.common(text.counts(F.col("a")), text.counts(F.col("b"))).alias("c")).collect():
        a, b = collections.Counter(r["a"]), collections.Counter(r["b"])
        assert [(x["item"], x["n"]) for x in r["n"]] == sorted(a.items()) and r["c"] == sum((a & b).values())
    assert spark.range(1).select(text.counts(F.array(F.lit(None).cast("string"), F.lit("x")))).first()[0][0]["n"] == 1


def test_more_distinct_tokens_than_the_basic_plane(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: i.cast("string")).alias("a"), F.array(F.lit("60000"), F.lit("x"), F.lit("60000")).alias("b"))
    assert with_distance(df, "a", "b", "d").select("d").first()["d"] == 59_999


def test_letters_of_an_aligner_and_merged_maps(spark):
    assert [one(spark, text.alignment_form(F.col("a")), a=x) for x in ("Don’t stop", "123 !", "")] == ["don'tstop", "*", "*"]
    merged = text.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))
    assert spark.range(1).select(merged).first()[0] == {"a": 1, "b": 3}


def test_rows_are_clamped_to_the_recording(spark):
    rows = [(1, -1.0, 3.0, " a ", None, 2.0, [(-1.0, 1.0, "x", None), (2.0, 3.0, "y", 0.5), (0.0, 1.0, " ", 0.5)]), (2, 2.0, 3.0, "b", 0.5, 2.0, []), (3, 2.0, 3.0, "c", 0.5, 0.0, None), (4, 0.0, 1.0, " ", 0.5, None, [])]
    df = spark.createDataFrame(rows, "k int, start double, end double, text string, confidence double, duration double, words array<struct<start:double,end:double,text:string,confidence:double>>")
    got = {r["k"]: (r["start"], r["end"], r["text"], r["confidence"], [tuple(w) for w in r["words"]]) for r in timing.clamp_rows(df).collect()}
    assert got == {1: (0.0, 2.0, "a", 0.0, [(0.0, 1.0, "x", 0.0)]), 3: (2.0, 3.0, "c", 0.5, [])}
    spans = F.array(F.struct(F.lit(0.5).alias("score"), F.lit(3).alias("length")), F.struct(F.lit(1.0).alias("score"), F.lit(1).alias("length")))
    assert spark.range(1).select(timing.span_score(spans)).first()[0] == 0.625


def test_pieces_stay_in_their_row(spark):
    schema = "key int, text string, start double, end double, tokens array<string>, timestamps array<double>, logprobs array<double>"
    rows = [(k, "a bc", 0.0, 2.0, ["▁a", " ", "▁b", "c"], [0.0, 0.25, 0.5, 1.0], [-1.0, 0.0, -1.0]) for k in (1, 2)]
    words = timing.piece_words(spark.createDataFrame(rows, schema), "key")
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString()
    got = [(r["key"], r["word_no"], r["word"], r["word_start"], r["word_end"], round(r["confidence"], 6)) for r in words.orderBy("key", "word_no").collect()]
    assert got == [x for k in (1, 2) for x in ((k, 0, "a", 0.0, 0.5, 0.367879), (k, 1, "bc", 0.5, 2.0, 0.68394))]


def test_words_left_out_need_no_table_of_distances(monkeypatch):
    def never(items):
        raise AssertionError("a table of distances was made")

    monkeypatch.setattr(bits, "Places", never)
    a = [f"w{i % 7}" for i in range(1000)]
    assert bits.distance(a, [x for i, x in enumerate(a) if i % 5]) == 200
    assert bits.distance(a[1::2], a) == 500
    assert bits.distance("kitten on a mat", "kit on mat") == 5


def test_error_rates_of_words_left_out_and_changed(spark):
    rows = [("a bb ccc dddd", "bb dddd", 2, 6), ("bb dddd", "a bb ccc dddd", 2, 6), ("ab c", "a bc", 2, 2), ("", "a bb", 2, 4), ("a b", "a b", 0, 0)]
    got = with_error_rates(spark.createDataFrame(rows, "r string, h string, w int, c int"), "r", "h").collect()
    assert [(x["word_errors"], x["char_errors"]) for x in got] == [(x["w"], x["c"]) for x in got]


def test_sums_before_entries_are_made_by_blocks(spark):
    """An aggregate that appends to one array for all words copied it for each: 3,000 words took 4.5 million copies, blocks take a hundredth."""
    words = [["x" * (i % 9 + 1) for i in range(n)] for n in (0, 1, 31, 32, 33, 64, 1100)]
    df = spark.createDataFrame([(w,) for w in words], "w array<string>")
    got = {len(r["w"]): list(r["at"]) for r in df.select("w", timing.sums_before(F.transform("w", F.length)).alias("at")).collect()}
    assert got == {len(w): [sum(map(len, w[:i])) for i in range(len(w))] for w in words}


def test_multiset_intersection_by_sets_equals_that_by_order(spark):
    pairs = [(["a", "a", "b 2", "b"], ["a", "a", "a", "b", "b"]), ([], ["x"]), (["x", "x", "x"], ["x", "x"]), (["x 2"], ["x", "x"])]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(text.counts(F.col("a")).alias("a"), text.counts(F.col("b")).alias("b"))
    got = df.select(text.common(F.col("a"), F.col("b")).alias("x"), text.common_sorted(F.col("a"), F.col("b")).alias("y")).collect()
    assert sorted((r["x"], r["y"]) for r in got) == [(0, 0), (0, 0), (2, 2), (3, 3)]


def test_validated_words_need_no_fold(spark):
    """A call's words are clamped by running frames, which spill: no array of a call's words is built, and each kept word copied it."""
    rows = [(1, i, i * 0.5 - (2.0 if i % 5 == 4 else 0.0), i * 0.5 + 0.4, "w") for i in range(200)] + [(1, 200, 1.0, None, "w"), (1, 201, None, 200.0, "w"), (1, 202, 3.0, 3.0005, "w"), (1, 203, float("nan"), 5.0, "w"), (1, 204, 1.0, 300.0, " ")]
    df = spark.createDataFrame(rows, "call int, seq int, start double, end double, text string")
    made = timing.validate_words(df, "call", F.lit(90.0), ["seq"])
    assert "aggregate" not in made._jdf.queryExecution().optimizedPlan().toString().lower().replace("windowexpression", "")
    last, want = 0.0, {}
    for _, seq, start, end, word in rows:
        if word.strip() and start == start:
            begin = min(90.0, max(last, last if start is None else start))
            to = min(90.0, max(begin, begin if end is None else end))
            if to - begin >= 0.001:
                last, want[seq] = begin, (begin, to)
    assert {r["seq"]: (r["start"], r["end"]) for r in made.collect()} == want
