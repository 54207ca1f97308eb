"""Language-model scores from a log-frequency Bloom filter (operator 2).

Training documents are counted exactly: every word (A-Z lower-cased) and one end token a
document. The base score is the add-``DELTA`` unigram probability from these counts. The
model conditions on the word before: every bigram of training, seen once or often and of whatever
words, is kept in a log-frequency Bloom filter, which holds a bigram together with each level
1, 2, ... up to the logarithm of its count. A count is read back by probing level after level until
one is missing, and rounded down to its level; it is never taken for more than the exact counts of its
two words. With q(v, w) the count read back,

    P(w | v) = (q(v, w) + MU * P_base(w)) / (count(v) + MU)

so a context seen often is trusted and a rare one falls back to the base probability, as does
one that training doesn't have.

Neither the counts nor the filter are sent to all workers, since both grow with the corpus. Words and
bigrams are dealt to shards by their hash, as many shards as the text asks for, so that a shard has about
``SHARD`` bytes of text to answer for at any size of the input. The texts are taken in slices of about ``GROUP``
bytes: a slice sends each of its distinct words and bigrams once, with their counts in its training
texts, as one packed row a shard. The shard adds up what all slices count, builds its segments of
the filter, probes them, and answers each slice with the counts and levels in the order in which it
was asked, so that no key travels back. No word or bigram has more rows than there are slices.

Cases: a null text is empty and has only its end token; a null id is in training, as its
remainder isn't known, and keeps its row; repeated rows count again and score alike; with no
training document every count is 0 and N is 0; an empty table gives an empty result; other
columns are ignored. The texts are read twice and must come in the same order each time; if a
slice finds other words than it has answers for, the job fails.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import filters
from parley.llm.store import table
from parley.llm.words import hash_words, mix, split_words, text_slices

DELTA = 0.1
MU = 256.0
#: Bits of a shard's filter for each bigram and level, at least.
BITS = 20
BASE = 1.5
LEVELS = 60
END = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_LEVEL = np.uint64(0xD6E8FEB86659FD93)
SLICE = 4 << 20
#: Bytes of text that send their words and bigrams together.
GROUP = 8 << 20
#: Bytes of text for whose words and bigrams one shard answers.
SHARD = 4 << 20


def level_of(count):
    """How many levels a count gets: 1 for 1, one more for every factor ``BASE``."""
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(level):
    """The least count with that level; 0 for level 0."""
    return np.where(level > 0, np.ceil(BASE ** (level - 1.0) - 1e-9), 0.0)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice, with an end after each row's words, and the row of each token."""
    words = split_words(data, offsets)
    rows = len(offsets) - 1
    n = len(words.starts)
    ends = words.bounds[1:] + np.arange(rows)
    out = np.empty(n + rows, np.uint64)
    inner = np.ones(n + rows, dtype=bool)
    inner[ends] = False
    out[ends] = END
    out[inner] = hash_words(data, words, lower=True)
    return out, np.repeat(np.arange(rows), np.diff(words.bounds) + 1)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def _contexts(tokens: np.ndarray) -> np.ndarray:
    """The token before each; a text begins after an end."""
    return np.r_[END, tokens[:-1]].astype(np.uint64)


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """The bigram that ends at each token."""
    return mix(_contexts(tokens) * _PAIR + tokens)


def _level_keys(pairs: np.ndarray, level) -> np.ndarray:
    return mix(pairs + np.asarray(level).astype(np.uint64) * _LEVEL)


def planes(values: np.ndarray) -> bytes:
    """The bytes of an array, first of all values, then second of all: high bytes of small numbers meet and compress."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: their order by shard, the shards that have any, and where each shard begins."""
    shard = ((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    found, begin = np.unique(shard[order], return_index=True)
    return order, found, np.r_[begin, len(keys)]


def _sliced(batches):
    """(slice, batch, first row, bytes, row offsets) of all texts of a task, slices in turn."""
    from pyspark import TaskContext

    number, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for first, data, offsets in text_slices(batch.column(1), SLICE):
            if held and held + len(data) > GROUP:
                number, held = number + 1, 0
            held += len(data)
            yield number, batch, first, data, offsets


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0))
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, n, len(found)).astype(np.int64)


ASKED = "slice long, shard int, words binary, word_n binary, pairs binary, pair_n binary"


def asked(docs: DataFrame, shards: int) -> DataFrame:
    """One row for each slice and shard: the slice's distinct words and bigrams there, and how often its training texts have them."""

    def rows_of(number, words, pairs):
        sides = [(keys[order], n[order], *rest) for keys, n in (words, pairs) for order, *rest in [_dealt(keys, shards)]]
        at = [dict(zip(found.tolist(), zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True), strict=True)) for _, _, found, begin in sides]
        here = sorted(at[0].keys() | at[1].keys())
        columns: list[list[bytes]] = [[], [], [], []]
        for shard in here:
            for k, (keys, n, _, _) in enumerate(sides):
                a, b = at[k].get(shard, (0, 0))
                columns[2 * k].append(planes(np.diff(keys[a:b], prepend=np.uint64(0))))
                columns[2 * k + 1].append(planes(n[a:b]))
        return pa.RecordBatch.from_arrays([pa.array([number] * len(here), pa.int64()), pa.array(here, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names=["slice", "shard", "words", "word_n", "pairs", "pair_n"])

    def run(batches):
        at, words, pairs = None, [], []
        for number, batch, first, data, offsets in _sliced(batches):
            if number != at and words:
                yield rows_of(at, _summed(words), _summed(pairs))
                words, pairs = [], []
            at = number
            tokens, row = _tokens(data, offsets)
            training = batch.column(2).slice(first, len(offsets) - 1).to_numpy(zero_copy_only=False)[row].astype(np.float64)
            words.append(_summed([(tokens, training)]))
            pairs.append(_summed([(_pairs(tokens), training)]))
        if words:
            yield rows_of(at, _summed(words), _summed(pairs))

    return docs.mapInArrow(run, ASKED)


def read_levels(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The level that the filter of one shard's counted bigrams gives for each."""
    level = np.where(counts > 0, np.minimum(level_of(counts), LEVELS), 0)
    segments = filters.segments_for(int(level.sum()), BITS, 1 << 40)
    bits = np.zeros(segments * filters.SEGMENT_BITS, dtype=bool)
    for step in range(1, int(level.max(initial=0)) + 1):
        keys = _level_keys(pairs[level >= step], step)
        for at in range(0, len(keys), 200_000):
            bits[filters.positions(keys[at : at + 200_000], segments).ravel().astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little")
    read, at = np.zeros(len(pairs), np.uint8), np.arange(len(pairs))
    for step in range(1, LEVELS + 1):
        at = at[filters.contains(packed, segments, _level_keys(pairs[at], step))]
        if not len(at):
            break
        read[at] = step
    return read


ANSWERS = "slice long, shard int, counts binary, levels binary, tokens long, different long"


def answers(docs: DataFrame, shards: int) -> DataFrame:
    """For each slice and shard the training counts of its words and the levels of its bigrams, in key order; without a slice, a shard's totals."""

    def shard(rows: pa.Table) -> pa.Table:
        told = {c: rows.column(c).to_pylist() for c in rows.column_names}
        keys = {c: [np.cumsum(from_planes(x, np.uint64), dtype=np.uint64) for x in told[c]] for c in ("words", "pairs")}
        n = {c: np.concatenate([from_planes(x, np.int64) for x in told[c]]) for c in ("word_n", "pair_n")}
        words, inverse = np.unique(np.concatenate(keys["words"]), return_inverse=True)
        count = np.bincount(inverse, n["word_n"], len(words)).astype(np.int64)
        counts = np.split(count[inverse], np.cumsum([len(x) for x in keys["words"]])[:-1])
        pairs, inverse = np.unique(np.concatenate(keys["pairs"]), return_inverse=True)
        read = read_levels(pairs, np.bincount(inverse, n["pair_n"], len(pairs)).astype(np.int64))
        levels = np.split(read[inverse], np.cumsum([len(x) for x in keys["pairs"]])[:-1])
        none = [None] * len(counts)
        return pa.table(
            {
                "slice": pa.array([*told["slice"], None], pa.int64()),
                "shard": pa.array([*told["shard"], told["shard"][0]], pa.int32()),
                "counts": pa.array([*map(planes, counts), None], pa.binary()),
                "levels": pa.array([*(x.tobytes() for x in levels), None], pa.binary()),
                "tokens": pa.array([*none, int(count.sum())], pa.int64()),
                "different": pa.array([*none, int(np.count_nonzero(count))], pa.int64()),
            }
        )

    return asked(docs, shards).groupBy("shard").applyInArrow(shard, ANSWERS)


def _answered(keys: np.ndarray, shards: int, told: dict[int, np.ndarray]) -> np.ndarray:
    """The answers to sorted keys, each shard's in the order in which it was asked."""
    order, found, begin = _dealt(keys, shards)
    if [len(told.get(s, ())) for s in found.tolist()] != np.diff(begin).tolist() or sum(map(len, told.values())) != len(keys):
        raise RuntimeError("the texts came in another order than before")
    out = np.zeros(len(keys), np.int64)
    if len(keys):
        out[order] = np.concatenate([told[s] for s in found.tolist()])
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.withColumn("training", ~held_out(F.col("doc_id")))
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0  # an end token a text
    shards = max(1, -(-int(size) // SHARD))
    told = table(answers(docs, shards), "lm-answers")
    total, distinct = (int(x or 0) for x in told.where("slice is null").agg(F.sum("tokens"), F.sum("different")).first())
    floor = float(np.log10(total + DELTA * (distinct + 1)))

    def tag(batches):
        for number, batch, first, _, offsets in _sliced(batches):
            rows = batch.slice(first, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number)), rows.column(0), rows.column(1)], names=["slice", "doc_id", "text"])

    def rate(texts: pa.Table, told: pa.Table) -> pa.Table:
        here = told.column("shard").to_pylist()
        counts = dict(zip(here, (from_planes(x, np.int64) for x in told.column("counts").to_pylist()), strict=True))
        levels = dict(zip(here, (np.frombuffer(x, np.uint8) for x in told.column("levels").to_pylist()), strict=True))
        parts = [(_tokens(data, offsets), len(offsets) - 1) for chunk in texts.column("text").chunks for _, data, offsets in text_slices(chunk, SLICE)]
        words = np.unique(np.concatenate([np.unique(t) for (t, _), _ in parts])) if parts else np.zeros(0, np.uint64)
        pairs = np.unique(np.concatenate([np.unique(_pairs(t)) for (t, _), _ in parts])) if parts else np.zeros(0, np.uint64)
        count, level = _answered(words, shards, counts), _answered(pairs, shards, levels)
        log_base, held = np.log10(count + DELTA) - floor, count_of(level)
        out = []
        for (tokens, row), rows in parts:
            at = np.searchsorted(words, tokens)
            before = np.r_[np.searchsorted(words, END), at[:-1]]
            n, context = count[at], count[before].astype(np.float64)
            base = log_base[at]
            seen = np.minimum(held[np.searchsorted(pairs, _pairs(tokens))], np.minimum(n, context))
            model = np.log10((seen + MU * 10.0**base) / (context + MU))
            out.append((np.bincount(row, minlength=rows), np.bincount(row[n > 0], minlength=rows), np.bincount(row, base, rows), np.bincount(row, model, rows)))
        n_tokens, n_known, base, model = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0)] * 4
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base": pa.array(base, pa.float64()), "model": pa.array(model, pa.float64())})

    sent = docs.mapInArrow(tag, "slice long, doc_id long, text string")
    back = told.where("slice is not null").select("slice", "shard", "counts", "levels")
    rated = sent.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(rate, "doc_id long, n_tokens long, n_known long, base double, model double")
    return rated.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("model").alias("score"),
    )
