"""Voice profiles: normalised vectors, their stored form, and matching of clusters to people."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from parley.functions.once import let

NAME = r"^[^/\\\x00-\x1F]{1,60}$"


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    return let(F.greatest(norm(v), F.lit(1e-8)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if lengths differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8))))


def quantize(v: Column) -> Column:
    """struct(scale, payload): a vector as signed bytes of its unit form; null of an empty, zero or not finite one."""
    fine = (F.size(v) > 0) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm(v) >= 1e-8)
    step = lambda u: F.greatest(F.array_max(F.transform(u, F.abs)) / 127, F.lit(1e-12))
    byte = lambda x, scale: F.least(F.lit(127), F.greatest(F.lit(-127), F.rint(x / scale).cast("int"))).cast("tinyint")
    stored = let(unit(v), lambda u: let(step(u), lambda scale: F.struct(scale.alias("scale"), F.transform(u, lambda x: byte(x, scale)).alias("payload"))))
    return F.when(fine, stored)


def dequantize(stored: Column) -> Column:
    """The unit vector of a stored profile."""
    return unit(let(stored, lambda p: F.transform(p["payload"], lambda x: x.cast("double") * p["scale"])))


def distinct_names(profiles: DataFrame) -> DataFrame:
    """Profiles with a valid name and a vector; of names that differ in case only, the first in code-point order."""
    good = profiles.where(F.col("name").rlike(NAME) & F.col("vector").isNotNull())
    first = Window.partitionBy(F.lower("name")).orderBy("name")
    return good.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """label and the mean of its vectors' elements; summed per element, so a label of any size is combined by task."""
    each = rows.select(label, F.posexplode(vector).alias("i", "x"))
    mean = each.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


#: Profiles compared at a time: their vectors are sent to all tasks, a few megabytes.
BLOCK = 4096


def _blocks(profiles: DataFrame) -> Iterator[list]:
    """Profiles in lists of at most ``BLOCK``; the driver holds one."""
    held: list = []
    for row in profiles.select("profile_no", "name", "vector").where("vector IS NOT NULL").toLocalIterator():
        if len(held) == BLOCK:
            yield held
            held = []
        held.append((row["profile_no"], row["name"], row["vector"]))
    yield held


def top_profiles(rows: DataFrame, profiles: DataFrame, key: str, k: int = 2) -> DataFrame:
    """key, rank, name, profile_no and similarity of the ``k`` profiles most similar to each row; ties to the higher ``profile_no``.

    Rows are multiplied with blocks of at most ``BLOCK`` profiles, each sent to all tasks, and nothing is shuffled. With several blocks
    each gives its ``k`` best, and the best of those are found by a shuffle of them alone. Vectors of other lengths are not compared.
    """
    out = StructType([rows.schema[key], *profiles.select(F.lit(1).alias("rank"), "name", "profile_no").schema.fields, StructField("similarity", DoubleType())])

    def against(block: list) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            sizes: dict = {}
            for no, name, vector in sorted(sent.value, key=lambda p: p[0], reverse=True):
                sizes.setdefault(len(vector), []).append((no, name, vector))
            scale = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)
            ready = {n: ([p[0] for p in found], [p[1] for p in found], scale(np.array([p[2] for p in found], np.float64))) for n, found in sizes.items()}
            schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])
            for batch in batches:
                vectors = batch.column("vector")
                lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
                taken, made = [], []
                for n, (numbers, names, matrix) in ready.items():
                    at = np.flatnonzero(lengths == n)
                    for begin in range(0, len(at), 256):
                        some = at[begin : begin + 256]
                        # Elements go from Arrow's buffer to numpy as they lie, not one Python object each.
                        values = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
                        scores = scale(values.astype(np.float64).reshape(len(some), n)) @ matrix.T
                        # The order is stable, so of equal scores the higher number, which comes first, wins.
                        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                        for i, row, places in zip(some, scores, best, strict=True):
                            taken += [i] * len(places)
                            made += [(r, names[p], numbers[p], float(row[p])) for r, p in enumerate(places, 1)]
                columns = [pa.array([m[j] for m in made], schema.field(j + 1).type) for j in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(taken, pa.int64())), *columns], schema=pa.schema([pa.field(key, batch.column(key).type), *(schema.field(j) for j in range(1, 5))]))

        return rows.select(key, "vector").mapInArrow(run, out)

    found = [against(block) for block in _blocks(profiles)]
    if len(found) == 1:
        return found[0]
    met = reduce(DataFrame.unionByName, found).groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("similarity", "profile_no", "name")), asc=False), 1, k).alias("_b"))
    return met.select(key, F.posexplode("_b").alias("_i", "_p")).select(key, (F.col("_i") + 1).alias("rank"), "_p.name", "_p.profile_no", "_p.similarity")


def match_profiles(clusters: DataFrame, profiles: DataFrame, call: str, threshold: float = 0.55) -> DataFrame:
    """call, label, name and similarity: each call's clusters and people matched one to one, best pairs first.

    ``clusters``: call, label, label_no, vector; ``profiles``: name, profile_no, vector. With one profile and several
    clusters the best is taken at 0.30 if it leads by 0.08. A cluster's match is among its best as many as the call has
    clusters, since the others take one each: only those pairs meet.
    """
    most = clusters.groupBy(call).count().agg(F.max("count")).first()[0] or 1
    near = top_profiles(clusters.select(F.struct(call, "label", "label_no").alias("_k"), "vector"), profiles, "_k", most)
    pairs = near.select("_k.*", "name", "profile_no", "similarity")
    kind = clusters.schema[call].dataType.simpleString()

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["similarity", "label_no", "profile_no"], ascending=False)[["label", "name", "similarity"]].values.tolist()
        kept: list = []
        if frame["name"].nunique() == 1 and frame["label"].nunique() >= 2:
            if rows[0][2] >= 0.30 and rows[0][2] - rows[1][2] >= 0.08:
                kept = rows[:1]
        else:
            for label, name, similarity in rows:
                if similarity >= threshold and all(label != x[0] and name != x[1] for x in kept):
                    kept.append([label, name, similarity])
        out = pd.DataFrame(kept, columns=["label", "name", "similarity"])
        out.insert(0, call, frame[call].iloc[0])
        return out

    return pairs.groupBy(call).applyInPandas(one, f"{call} {kind}, label string, name string, similarity double")


def pitch_label(hz: Column, first: Column, second: Column, first_label: Column, second_label: Column) -> Column:
    """The label whose pitch centre is clearly nearest, else null."""
    valid = lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    far = lambda ref: F.abs(F.log2(hz / ref))
    a, b = far(first), far(second)
    distinct = F.abs(F.log2(first / second)) >= 0.25
    clear = (F.least(a, b) <= 0.22) & (F.abs(a - b) >= 0.15)
    return F.when(valid(hz) & valid(first) & valid(second), F.when(distinct & clear, F.when(a < b, first_label).otherwise(second_label)))


def pitch_centers(groups: DataFrame, call: str, least: float = 1.5) -> DataFrame:
    """call, speaker and ``center``: the median pitch of a speaker's groups (seconds, pitch) of ``least`` seconds or more."""
    return groups.where((F.col("seconds") >= least) & F.col("pitch").isNotNull()).groupBy(call, "speaker").agg(F.median("pitch").alias("center"))


def attribute(groups: DataFrame) -> DataFrame:
    """Adds ``selected`` speaker, ``source`` of the decision and ``confident`` to groups of words.

    ``groups``: seconds, ``previous`` speaker; ``best_name``, ``best`` and ``second``, the similarities to the call's clusters; ``n_profiles``,
    ``profile_name``, ``profile_best``, ``profile_second`` (null with one profile); ``anchored``: whether the best cluster is the one
    profile's; ``pitch_name`` by ``pitch_label``, or null. Enrolled people come before clusters, and pitch only helps short
    groups without either.
    """
    near = refine(groups).withColumnRenamed("confident", "_near")
    alone = (F.col("n_profiles") == 1) & F.coalesce("anchored", F.lit(False)) & (F.col("profile_best") >= 0.42)
    among = (F.col("n_profiles") >= 2) & (F.col("profile_best") >= 0.50) & (F.col("profile_best") - F.col("profile_second") >= 0.08)
    known = F.coalesce(alone | among, F.lit(False))
    cluster = F.coalesce("_near", F.lit(False))
    pitched = ~known & ~cluster & (F.col("seconds") <= 1.2) & F.col("pitch_name").isNotNull()
    pick = lambda a, b, c, d: F.when(known, a).when(cluster, b).when(pitched, c).otherwise(d)
    made = near.withColumns(
        {
            "selected": pick(F.col("profile_name"), F.col("best_name"), F.col("pitch_name"), F.col("previous")),
            "source": pick(F.lit("enrolled profile"), F.lit("call centroid"), F.lit("call pitch"), F.lit("timeline")),
            "confident": known | cluster | pitched,
        }
    )
    return made.drop("_near")


def decision_summary(groups: DataFrame, call: str) -> DataFrame:
    """call, groups, ``confident_groups``, ``overrides`` (words of confident groups whose speaker changed) and ``mean_margin``.

    ``groups``: what ``attribute`` returns, with ``n_words``.
    """
    changed = F.when(F.col("confident") & ~F.col("selected").eqNullSafe(F.col("previous")), F.col("n_words")).otherwise(0)
    margin = F.avg(F.when(F.col("confident"), F.col("best") - F.col("second")))
    return groups.groupBy(call).agg(F.count("*").alias("groups"), F.count_if("confident").alias("confident_groups"), F.sum(changed).alias("overrides"), F.round(margin, 4).alias("mean_margin"))


def enrollment_clips(clips: DataFrame, name: str, least: float = 0.40, total: float = 10.0, pause: float = 0.12) -> DataFrame:
    """Clips (start, end) of ``least`` seconds or more with ``offset``, their place in a person's joined speech.

    Clips are joined in order of time with ``pause`` seconds after each. A person with less than ``total`` seconds is an error.
    """
    kept = clips.where(F.col("end") - F.col("start") >= least).withColumn("_n", F.col("end") - F.col("start"))
    by = Window.partitionBy(name)
    before = by.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumns({"offset": F.coalesce(F.sum(F.col("_n") + pause).over(before), F.lit(0.0)), "_total": F.sum("_n").over(by)})
    fine = F.when(F.col("_total") >= total, F.col("offset")).otherwise(F.raise_error(F.concat(F.col(name).cast("string"), F.lit(" has too little verified speech"))).cast("double"))
    return placed.withColumn("offset", fine).drop("_n", "_total")


def save_profiles(store: DataFrame, people: DataFrame) -> DataFrame:
    """A store (name, dimension, scale, payload) with people (name, vector) added or, where the name is there, replaced.

    Names are trimmed; an empty, zero or not finite vector is an error. Of equal names among ``people`` the last vector in order counts.
    """
    stored = quantize(F.col("vector"))
    checked = F.when(stored.isNotNull(), stored).otherwise(F.raise_error(F.concat(F.lit("no usable vector: "), F.col("name"))).cast("struct<scale:double,payload:array<tinyint>>"))
    one = people.withColumn("name", F.trim("name")).groupBy("name").agg(F.max("vector").alias("vector")).select("name", F.size("vector").alias("dimension"), checked.alias("_q"))
    new = one.select("name", "dimension", "_q.scale", "_q.payload")
    return store.join(new.select("name"), "name", "left_anti").select(*new.columns).unionByName(new)


def delete_profiles(store: DataFrame, names: DataFrame) -> DataFrame:
    """A store without the given names; unknown names change nothing."""
    return store.join(names.select("name"), "name", "left_anti")


def load_profiles(store: DataFrame) -> DataFrame:
    """name and unit ``vector`` of profiles with a valid name; a payload of another length, or without direction, is an error."""
    whole = (F.size("payload") == F.col("dimension")) & ~F.isnan("scale") & (F.abs("scale") < float("inf")) & F.exists("payload", lambda x: x != 0)
    vector = F.when(whole, dequantize(F.struct("scale", "payload"))).otherwise(F.raise_error(F.concat(F.lit("damaged profile: "), F.col("name"))).cast("array<double>"))
    return store.where(F.col("name").rlike(NAME)).select("name", vector.alias("vector"))


def refine(rows: DataFrame) -> DataFrame:
    """Adds ``confident``: whether an utterance (best, second, seconds) is clearly one cluster's.

    Short ones need a larger lead over the second.
    """
    lead = F.when(F.col("seconds") < 0.70, 0.10).otherwise(0.055)
    return rows.withColumn("confident", (F.col("best") >= 0.25) & (F.col("best") - F.col("second") >= lead))
