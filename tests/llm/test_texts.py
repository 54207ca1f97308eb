"""Quality rules, language-model scores, toxicity, fingerprints and byte-level BPE."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from parley.llm import byte_bpe, filters, fingerprints, lm_score, quality_rules, toxicity
from tests.llm import brute

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_statistics_equal_brute_force(docs, labels, rows):
    got = Counter((r["doc_id"], *(r[c] for c in STATS)) for r in quality_rules.judge(docs, labels).collect())
    assert got == Counter((i, *brute.statistics(t)) for i, t in rows)


def test_rules_find_what_labels_say(spark):
    rnd = random.Random(4)
    good = [" ".join(rnd.choice(["plain", "word", "here", "there", "again"]) + str(rnd.randint(0, 999)) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(f"w{rnd.randint(0, 999)}###" for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 210, 2)], "doc_id long, quality int, toxic int")
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert sum(judged[i] == (i < 150) for i in range(210)) >= 207
    kept = quality_rules.reject(docs.withColumn("_row", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "_row"] and sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(210) if judged[i]]


def test_rules_without_labels_or_rows(docs, empty, labels, rows):
    kept = quality_rules.reject(docs, labels.limit(0))
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((i, t) for i, t in rows if not brute.statistics(t)[-1])
    assert quality_rules.judge(empty, labels).count() == 0 and quality_rules.reject(empty, labels).count() == 0


def test_model_scores_equal_exact_tables(docs, empty, rows):
    got = lm_score.score(docs).collect()
    base, model = brute.base_scores(rows), brute.bigram_scores(rows)
    want = Counter((i, *b[:3], round(b[3], 6)) for (i, _), b in zip(rows, base, strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    by_text = {(i, b[0], round(b[3], 6)): m for (i, _), b, m in zip(rows, base, model, strict=True)}
    # False positives of the filter may raise one pair in a thousand.
    assert all(abs(r["score"] - by_text[r["doc_id"], r["n_tokens"], round(r["base_score"], 6)]) <= 0.001 * r["n_tokens"] + 1e-6 for r in got)
    assert lm_score.score(empty).count() == 0


def test_model_keeps_bigrams_of_all_words(spark, monkeypatch):
    # More different words than any fixed vocabulary, each bigram once or twice, dealt to many slices and shards.
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(80)]
    texts += texts[:40]
    ids = [i for i in range(1000) if not brute.is_held_out(i)][: len(texts)]
    rows = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    want = dict(zip(ids, brute.bigram_scores(rows), strict=True))
    whole = {r["doc_id"]: r["score"] for r in lm_score.score(docs).collect()}
    for name in ("SHARD", "SLICE", "GROUP"):
        monkeypatch.setattr(lm_score, name, 30_000)
    dealt = {r["doc_id"]: r["score"] for r in lm_score.score(docs).collect()}
    for i, text in rows:
        assert abs(whole[i] - want[i]) <= 0.001 * len(text.split()) and abs(dealt[i] - want[i]) <= 0.001 * len(text.split())


def test_filter_has_no_false_negatives():
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    bits = np.zeros(filters.SEGMENT_BITS, bool)
    bits[filters.positions(keys[:2500], 1).ravel().astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little")
    assert filters.contains(packed, 1, keys[:2500]).all() and filters.contains(packed, 1, keys[2500:]).mean() < 0.01


def test_levels_round_counts_down():
    n = np.arange(1, 5000)
    back = lm_score.count_of(lm_score.level_of(n))
    assert (back <= n).all() and (back * lm_score.BASE + 1 >= n).all() and lm_score.count_of(0) == 0


@pytest.fixture(scope="module")
def toxic(spark):
    rnd = random.Random(8)
    plain, bad = [f"word{i}" for i in range(400)], ["vile", "nasty", "rotten", "filthy"]
    texts, marks = [], []
    for i in range(600):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 80))]
        if i % 6 == 0:
            for _ in range(rnd.randint(2, 5)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        texts.append(" ".join(words))
        marks.append(int(i % 6 == 0))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, found int")
    labels = spark.createDataFrame([(i, 1 - i % 2, m) for i, m in enumerate(marks) if i % 4], "doc_id long, quality int, toxic int")
    return docs, labels, marks


def test_toxicity_on_unseen_documents(toxic):
    docs, labels, marks = toxic
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity.judge(docs, labels).collect()}
    unseen = [i for i in range(len(marks)) if i % 4 == 0]
    assert np.mean([got[i] == bool(marks[i]) for i in unseen]) > 0.9
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, bad in got.items() if not bad}


def test_later_models_get_earlier_probabilities(toxic):
    docs, labels, _ = toxic
    chain = toxicity.fit(docs, labels)
    width = len(chain.terms)
    assert [len(m.weights) for m in chain.models] == [width + 1, width + 2, width + 3]
    assert {"vile", "nasty", "rotten", "filthy", "nast*"} <= set(chain.terms)


def test_terms_of_a_fold_are_chosen_without_it(spark):
    rows = [(f, int(k < 6), ["both", "only" if f == 1 and k < 6 else "x"] if k < 6 else ["x"]) for f in range(3) for k in range(40)]
    terms, used = toxicity.choose_terms(spark.createDataFrame(rows, "fold int, toxic int, terms array<string>"), clear=2.0)
    chosen = {t: used[:, i].tolist() for i, t in enumerate(terms)}
    assert chosen["both"] == [True] * 4 and chosen["only"] == [True, True, False, True]


def test_out_of_fold_probabilities_never_see_their_row():
    rng = np.random.default_rng(3)
    y, folds = rng.integers(0, 2, 90).astype(float), np.arange(90) % 3
    x = toxicity.Matrix(np.arange(0, 901, 10), rng.integers(0, 60, 900), 60, rng.normal(size=(90, 5)))
    seen = toxicity.fit_linear(x, y).predict(x)
    apart = np.zeros(90)
    for f in range(3):
        apart[folds == f] = toxicity.fit_linear(x.rows(folds != f), y[folds != f]).predict(x.rows(folds == f))
    assert np.mean((seen > 0.5) == y) > 0.8 and np.mean((apart > 0.5) == y) < 0.7


def test_fit_is_where_the_gradient_is_zero():
    rng = np.random.default_rng(5)
    y, use = rng.integers(0, 2, 200).astype(float), np.arange(30) % 2 == 0
    x = toxicity.Matrix(np.arange(0, 1001, 5), np.tile(rng.permutation(30)[:5], 200) ^ 1, 32, rng.normal(size=(200, 2)))
    w = toxicity.fit_linear(x, y, np.r_[use, True, True]).weights
    gradient = x.back(1 / (1 + np.exp(-x.times(w))) - y) + toxicity.RIDGE * np.r_[w[:-1], 0]
    free = np.r_[use, [True] * 5]
    assert np.abs(gradient[free]).max() < 1e-2 and (w[~free] == 0).all()


def test_toxicity_without_labels_or_rows(docs, empty, labels):
    assert toxicity.reject(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.judge(empty, labels).count() == 0
    judged = toxicity.judge(docs, labels)
    assert judged.count() == docs.count() and judged.where("is_toxic is null").count() == 0


def test_edited_texts_and_likeness(docs, empty, rows):
    docs, rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]), sorted(dict(r for r in rows if r[0] is not None).items())
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs).collect()}
    prints = {}
    for i, text, edited, after in brute.edited_texts(rows):
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - brute.jaccard(text, edited)) < 0.17 and abs(r["near_next"] - brute.jaccard(text, after)) < 0.17
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len(got) == len(rows) and fingerprints.edited_likeness(empty).count() == 0


def test_followers_with_repeated_and_missing_ids(docs, rows):
    assert fingerprints.edited_likeness(docs).count() == len(rows)
    assert fingerprints.edited_likeness(docs.where("doc_id is null")).count() == 3
    assert fingerprints.edited_likeness(docs.where("doc_id = 21")).first()["near_next"] == 1.0


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    df = spark.createDataFrame([(1, a, b)], "k int, a string, b string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "a", "sa"), "b", "sb")
    r = df.select(fingerprints.resemblance(F.col("sa"), F.col("sb")), fingerprints.containment(F.col("sa"), F.col("sb")), fingerprints.distinct_shingles(F.col("sa"))).first()
    assert abs(r[0] - 996 / 2996) < 0.15 and abs(r[1] - 996 / 1996) < 0.2 and abs(r[2] / 1996 - 1) < 0.3
    parts = df.select(F.lit(1).alias("g"), F.col("sa").alias("sketch")).unionByName(df.select(F.lit(1).alias("g"), F.col("sb").alias("sketch")))
    assert fingerprints.merge_all(parts, ["g"]).first()["sketch"] == df.select(fingerprints.merge(F.col("sa"), F.col("sb"))).first()[0]


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load(RANKS).ranks, special_tokens={})


def test_encoding_equals_the_merges(docs, empty, rows, encoding):
    got = Counter(tuple(r) for r in byte_bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(ids := encoding.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows)
    assert got == want
    assert byte_bpe.round_trip_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_ids_and_bytes_as_columns(docs, rows, encoding):
    ids = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect()) == Counter((i, tuple(encoding.encode_ordinary(t or ""))) for i, t in rows)
    assert Counter((r["doc_id"], bytes(r["data"])) for r in byte_bpe.decode_documents(ids, RANKS).collect()) == Counter((i, (t or "").encode()) for i, t in rows)


def test_prefixes_after_appends_and_edits(encoding):
    bpe, rnd = byte_bpe.load(RANKS), random.Random(6)
    single = tiktoken.Encoding("one", pat_str=r"(?s:.+)", mergeable_ranks=bpe.ranks, special_tokens={})
    for _ in range(150):
        text = "".join(rnd.choice("aaabcdeé 0,ing theß漢") for _ in range(rnd.randint(1, 60)))
        p = byte_bpe.Prefixes(bpe)
        for ch in text:
            p.append(ch.encode())
        assert p.ids() == single.encode_ordinary(text)
        data, a = text.encode(), rnd.randint(0, len(text.encode()))
        b = rnd.randint(a, len(data))
        p.edit(a, b, b"new")
        fresh = byte_bpe.Prefixes(bpe, data[:a] + b"new" + data[b:])
        assert p.ids() == fresh.ids() and bpe.decode(p.ids()) == data[:a] + b"new" + data[b:]
