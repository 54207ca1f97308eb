"""Repeated passages by a log-structured fingerprint index (operator 4).

A window is ``size`` consecutive words. Of every window one fingerprint is kept: the hash
of the ``gram`` consecutive words in it that hashes smallest. Equal windows choose the
same words, so a window can only be repeated if its fingerprint is, while neighbouring
windows share fingerprints, which leaves about one for ten words.

``FingerprintIndex`` holds fingerprints in immutable runs, bucketed and sorted by fingerprint. A new
batch becomes a run and is merge-joined with the runs before it, bucket by bucket, without shuffling
these; what was there before, or is twice in the batch, is a hit. Runs of a level are then compacted
into one of the next. Hits only name candidates. These are verified by the hash of the window's
whole word sequence (64 bits over all words), counted over all documents.

``find_ranges`` feeds a table to a new index batch by batch; ``find_new_ranges`` adds one more batch to
an index that is kept, and judges that batch only.

Cases: a null text has no words; a text of fewer than ``size`` words has no windows and
stays; an empty table gives an empty result; ids may be null or repeated, since rows
are matched by content (two hashes of the text), never by id; repeated rows repeat each other's
windows and lose them all; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm import filters
from parley.llm.store import discard, new_path, remove, table
from parley.llm.words import hash_words, mix, sliding_min, split_words, text_slices, window_hashes

SIZE = 35
GRAM = 16
#: Removed ranges up to this size are broadcast to the texts; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: A fingerprint with more than this share of all places (of places that repeat) is counted apart; there are at most as many as its inverse.
HOT_SHARE, HOT_PLACES = 1e-4, 1000
_POSITION = np.uint64((1 << 28) - 1)


def _anchors(data: np.ndarray, offsets: np.ndarray, size: int, gram: int):
    """Words, window hashes, valid windows, each window's anchor position and the fingerprints by position."""
    assert 0 <= size - gram < 31, "the windows of an anchor are kept as the bits of an int"
    words = split_words(data, offsets)
    hashes = hash_words(data, words)
    windows = window_hashes(hashes, size)
    valid = np.flatnonzero(words.row[size - 1 :] == words.row[: len(windows)]) if len(windows) else np.zeros(0, np.int64)
    if not len(valid):
        return words, windows, valid, valid, windows
    grams = window_hashes(hashes, gram)
    order = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(order, size - gram + 1)[valid] & _POSITION).astype(np.int64)
    return words, windows, valid, anchor, grams


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = SIZE, gram: int = GRAM, batches: int = 1) -> DataFrame:
    """(fp, n, batch): fingerprints of all windows and at how many places they lie, summed per slice; ``batch`` deals the input's partitions."""

    def run(parts):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() % batches
        for batch in parts:
            for _, data, offsets in text_slices(batch.column(0)):
                _, _, _, anchor, grams = _anchors(data, offsets, size, gram)
                found, n = np.unique(grams[np.unique(anchor)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.full(len(found), number, np.int32))], names=["fp", "n", "batch"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "fp long, n long, batch int")


class FingerprintIndex:
    """Sorted immutable runs of fingerprints in a folder, merged level by level.

    A run is a Parquet table (fp, n) in ``buckets`` buckets, each sorted by fp, so that runs are joined bucket by
    bucket as they lie. After each batch the folder's log gets the list of runs that count from then on; ``open``
    goes on from the last entry. The default folder is a new one in the shared folder.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = 4, buckets: int | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.path = path or new_path(spark, "fingerprint-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.levels = 0, []  # of each level, the tables' names
        self.names: dict[str, str] = {}  # in the folder, of each table

    @classmethod
    def open(cls, spark: SparkSession, path: str, fan_in: int = 4) -> FingerprintIndex:
        """The index in ``path`` as its last batch left it."""
        log = spark.read.parquet(f"{path}/log")
        last = log.join(log.agg(F.max("version").alias("version")), "version").orderBy("level", "name").collect()  # a few runs a level
        index = cls(spark, path, fan_in, last[0]["buckets"])
        index.version = last[0]["version"]
        for row in last:
            name = f"parley_run_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} (fp BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {index.buckets} BUCKETS LOCATION '{path}/{row['name']}'")
            index._put(name, row["name"], row["level"])
        return index

    def _put(self, table_name: str, folder: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table_name)
        self.names[table_name] = folder

    def _write(self, counted: DataFrame, level: int) -> str:
        name = f"parley_run_{uuid.uuid4().hex}"
        folder = f"run-{self.version:06d}-{level}-{name[-8:]}"
        counted.write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet").option("path", f"{self.path}/{folder}").saveAsTable(name)
        self._put(name, folder, level)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, f"{self.path}/{self.names.pop(name)}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch of (fp, n); the hits: (fp, n, before) of its fingerprints that earlier batches had, or that it has twice."""
        self.version += 1
        earlier = [name for level in self.levels for name in level]
        run = self.spark.table(self._write(batch.groupBy("fp").agg(F.sum("n").alias("n")), 0))
        joined, before = run, F.lit(0).cast("long")
        for k, name in enumerate(earlier):
            joined = joined.join(self.spark.table(name).withColumnRenamed("n", f"n{k}").hint("merge"), "fp", "left")
            before = before + F.coalesce(f"n{k}", F.lit(0))
        hits = table(joined.select("fp", "n", before.alias("before")).where("before + n > 1"), "fingerprint-hits")
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_in:
            merged, self.levels[level] = self.levels[level], []
            self._write(self._sum(merged), level + 1)
            self._drop(merged)
            level += 1
        now = [(self.version, k, self.names[name], self.buckets) for k, names in enumerate(self.levels) for name in names]
        self.spark.createDataFrame(now, "version long, level int, name string, buckets int").coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return hits

    def _sum(self, names: list[str]) -> DataFrame:
        # Read as plain files: Spark 4.1 takes a union of bucketed tables for bucketed and then doesn't shuffle it.
        runs = [self.spark.read.schema("fp long, n long").parquet(f"{self.path}/{self.names[name]}") for name in names]
        return reduce(DataFrame.unionByName, runs).groupBy("fp").agg(F.sum("n").alias("n"))

    def merged(self) -> DataFrame:
        """All runs as one: each fingerprint and at how many places it lies."""
        return self._sum([name for level in self.levels for name in level])

    def close(self, delete: bool = False) -> None:
        """Forget the tables; the folder stays unless it is to be deleted."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels, self.names = [], {}
        if delete:
            remove(self.spark, self.path)


CANDIDATES = "fp long, k1 long, k2 int, at int, known int, places array<int>, windows array<long>"


def candidates(docs: DataFrame, bits, segments: int, text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Windows whose fingerprint may be repeated, one row per anchor.

    ``at`` is the first window of the row, ``windows`` the hashes of those that need a look elsewhere, and
    ``places`` the i of each, window ``at + i``; bit i of ``known`` says that this window is repeated in its slice.
    Of windows that repeat within a slice only the first is sent: a passage that fills
    documents costs one row a slice, however often it is there.
    """

    def run(batches):
        for batch in batches:
            keys = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for first_row, data, offsets in text_slices(batch.column(0)):
                words, windows, valid, anchor, grams = _anchors(data, offsets, size, gram)
                if not len(valid):
                    continue
                places = np.unique(anchor)
                maybe = places[filters.contains(bits.value, segments, grams[places])]
                keep = np.isin(anchor, maybe, assume_unique=False)
                at, anchor = valid[keep], anchor[keep]
                if not len(at):
                    continue
                hashes = windows[at] | np.uint64(1)
                _, first, inverse, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                known = n[inverse] > 1
                sent = np.zeros(len(at), dtype=bool)
                sent[first] = True
                begin = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
                runs = np.diff(np.r_[begin, len(at)])
                bit = np.arange(len(at)) - np.repeat(begin, runs)
                mask = np.add.reduceat(known.astype(np.int64) << bit, begin)
                many = np.add.reduceat(sent.astype(np.int32), begin)
                row = words.row[at[begin]]
                k1, k2 = keys[0][first_row + row], keys[1][first_row + row]
                start = at[begin] - words.bounds[row]
                fp = grams[anchor[begin]]
                # Rows that send nothing need not meet others of their fingerprint.
                fp = np.where(many > 0, fp, mix(fp ^ k1.view(np.uint64) ^ start.astype(np.uint64)))
                ends = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (bit[sent].astype(np.int32), hashes[sent].view(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)), pa.array(k1), pa.array(k2), pa.array(start.astype(np.int32)), pa.array(mask.astype(np.int32)), *lists], names=["fp", "k1", "k2", "at", "known", "places", "windows"]
                )

    keyed = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return keyed.select("text", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2")).mapInArrow(run, CANDIDATES)


def repeated_windows(found: DataFrame, hot: list[int] | None = None) -> DataFrame:
    """(k1, k2, at, mask): verified repeats, bit i standing for window ``at + i``.

    Rows meet by fingerprint; within it windows are counted by the hash of their words. Both
    the count and the masks use that one shuffle. Rows of the fingerprints in ``hot`` don't meet: equal
    rows of different slices become one first, the windows of these are counted with map-side sums, and
    the masks joined to the rows, which the adaptive skew join can split.
    """
    # Rows that send nothing are the many copies of a text: only their ``known`` counts, below.
    sent = found.where(F.size("windows") > 0)
    weight = F.expr("1 + (shiftright(known, i) & 1)")  # a window that its slice has twice counts twice
    each = lambda rows, *cols: rows.select(*cols, F.inline(F.arrays_zip("places", "windows")).alias("i", "h"))
    united = F.bit_or(F.expr("shiftleft(1, i)")).alias("mask")
    cold = sent.where(~F.col("fp").isin(hot)) if hot else sent
    counted = each(cold.repartition("fp"), "fp", "k1", "k2", "at", "known").select("*", F.sum(weight).over(Window.partitionBy("fp", "h")).alias("n")).where("n > 1")
    masks = counted.groupBy("fp", "k1", "k2", "at").agg(united).drop("fp")
    if hot:
        same = ["known", "places", "windows"]
        rows = sent.where(F.col("fp").isin(hot)).withColumns({"l1": F.xxhash64(*same), "l2": F.hash(*same)})
        lists = rows.groupBy("l1", "l2", *same).agg(F.count("*").alias("rows"))
        often = each(lists, "known", "rows").groupBy("h").agg(F.sum(weight * F.col("rows")).alias("n")).where("n > 1").select("h")
        marked = each(lists, "l1", "l2").join(often, "h").groupBy("l1", "l2").agg(united)
        masks = masks.unionByName(rows.join(marked, ["l1", "l2"]).select("k1", "k2", "at", "mask"))
    local = found.where("known <> 0").select("k1", "k2", "at", F.col("known").alias("mask"))
    return masks.unionByName(local)


def ranges(repeats: DataFrame, size: int = SIZE) -> DataFrame:
    """(k1, k2, spans): for each distinct text its covered word ranges, start and end in turn."""

    def run(batches):
        for batch in batches:
            out = []
            for entries in batch.column(2).to_pylist():
                at = np.array([x["at"] for x in entries])[:, None]
                mask = np.array([x["mask"] for x in entries], dtype=np.int64)[:, None] & 0xFFFFFFFF
                bit = np.arange(32)[None, :]
                starts = np.unique((at + bit)[((mask >> bit) & 1).astype(bool)])
                new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + size])
                last = np.r_[new[1:], len(starts)] - 1
                out.append(np.stack([starts[new], starts[last] + size], 1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["k1", "k2", "spans"])

    # Copies of a text name the same anchors: united before the shuffle, a text has as many entries as its own anchors.
    united = repeats.groupBy("k1", "k2", "at").agg(F.bit_or("mask").alias("mask"))
    grouped = united.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "mask")).alias("e"))
    return grouped.mapInArrow(run, "k1 long, k2 int, spans array<int>")


def verified_ranges(docs: DataFrame, repeated: DataFrame, text_col: str = "text", size: int = SIZE, gram: int = GRAM, filter_bytes: int = 64 << 20) -> DataFrame:
    """(k1, k2, spans) of all texts of ``docs``; ``repeated``: a table of (key, n), the fingerprints that may repeat and their places.

    These go to the workers as a Bloom filter of at most ``filter_bytes``: a
    fuller filter lets more candidates through to verification, and never changes the result.
    """
    total, keys = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = [r["key"] for r in repeated.where(F.col("n") > max(HOT_PLACES, int(total * HOT_SHARE))).select("key").collect()]  # at most 1 / HOT_SHARE
    segments = filters.segments_for(keys, 12, filter_bytes)
    bits = docs.sparkSession.sparkContext.broadcast(filters.build(repeated.select("key"), segments))
    found = table(candidates(docs, bits, segments, text_col, size, gram), "window-candidates")
    spans = table(ranges(repeated_windows(found, hot), size), "repeated-ranges")
    discard(found)
    return spans


def find_ranges(docs: DataFrame, text_col: str = "text", batches: int = 5, size: int = SIZE, gram: int = GRAM, **how) -> DataFrame:
    """Word ranges to remove from each distinct text: all of ``docs`` goes through a new index in ``batches`` batches of whole partitions."""
    index = FingerprintIndex(docs.sparkSession)
    anchors = table(fingerprints(docs, text_col, size, gram, batches), "window-fingerprints")
    hits = [index.add(anchors.where(F.col("batch") == k)) for k in range(batches)]
    index.close(delete=True)
    # A fingerprint is a hit in every batch from its second place on: the last has all its places.
    met = reduce(DataFrame.unionByName, hits).groupBy(F.col("fp").alias("key")).agg(F.max(F.col("before") + F.col("n")).alias("n"))
    repeated = table(met, "repeated-fingerprints")
    discard(anchors, *hits)
    spans = verified_ranges(docs, repeated, text_col, size, gram, **how)
    discard(repeated)
    return spans


def find_new_ranges(index: FingerprintIndex, batch: DataFrame, history: DataFrame | None, text_col: str = "text", size: int = SIZE, gram: int = GRAM, **how) -> DataFrame:
    """Adds ``batch`` to ``index`` and gives the ranges of its texts whose windows lie in it twice or in ``history`` already.

    ``history``: all that the index was given before, read once (without a shuffle) to verify hits.
    """
    hits = index.add(fingerprints(batch, text_col, size, gram).drop("batch"))
    repeated = table(hits.select(F.col("fp").alias("key"), (F.col("before") + F.col("n")).alias("n")), "repeated-fingerprints")
    text = lambda docs: docs.select(F.col(text_col).alias("text"))
    both = text(batch) if history is None else text(batch).unionByName(text(history))
    spans = verified_ranges(both, repeated, "text", size, gram, **how)
    t = F.coalesce(F.col("text"), F.lit(""))
    mine = text(batch).select(F.xxhash64(t).alias("k1"), F.hash(t).alias("k2"))
    out = table(spans.join(mine, ["k1", "k2"], "left_semi"), "repeated-ranges")
    discard(hits, repeated, spans)
    return out


def with_ranges(docs: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``spans`` (null: nothing to remove) to every row of ``docs``."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"_parley_k1": F.xxhash64(t), "_parley_k2": F.hash(t)})
    spans = spans.select(F.col("k1").alias("_parley_k1"), F.col("k2").alias("_parley_k2"), F.col("spans").alias("_parley_spans"))
    size = spans.agg(F.coalesce(F.sum(F.size("_parley_spans") * 4 + 24), F.lit(0))).first()[0]
    return keyed.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, ["_parley_k1", "_parley_k2"], "left").drop("_parley_k1", "_parley_k2")


def _kept(text: str | None, spans) -> tuple[int, list[bytes]]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if spans is None:
        return len(words), words
    out, at = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        out += words[at:start]
        at = end
    return len(words), out + words[at:]


def removal_digests(docs: DataFrame, spans: DataFrame | None = None, **how) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every document; ``spans``: found before, else of ``docs``."""

    def run(batches):
        for batch in batches:
            n, removed, digest = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                count, left = _kept(text, spans)
                n.append(count)
                removed.append(count - len(left))
                digest.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = with_ranges(docs, find_ranges(docs, **how) if spans is None else spans).select("doc_id", "text", "_parley_spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, text_col: str = "text", length_col: str | None = None, **how) -> DataFrame:
    """``docs`` with repeated passages taken out of the text; texts without any stay byte for byte.

    All rows and columns stay; a changed text is its kept words joined by one space. ``length_col``,
    if given, becomes the changed text's length in code points.
    """

    def cut_text(texts, spans):
        import pandas as pd

        return pd.Series([t if s is None else b" ".join(_kept(t, s)[1]).decode("utf-8", "surrogatepass") for t, s in zip(texts, spans, strict=True)], dtype=object)

    shorten = F.pandas_udf(cut_text, "string")
    joined = with_ranges(docs, find_ranges(docs, text_col, **how), text_col)
    found = joined.withColumn("_parley_text", shorten(F.col(text_col), F.col("_parley_spans")))
    new = {text_col: F.col("_parley_text")}
    if length_col:
        new[length_col] = F.when(F.col("_parley_spans").isNull(), F.col(length_col)).otherwise(F.length("_parley_text").cast(docs.schema[length_col].dataType))
    return found.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))
