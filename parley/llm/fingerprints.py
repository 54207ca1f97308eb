"""Bottom-k sketches of document shingles (operator 8, DataFrame functions only).

A sketch is the ``k`` smallest distinct 64-bit hashes of a text's word shingles, ascending.
Sketches of parts merge into the sketch of their union, and two of them estimate
resemblance (Jaccard similarity), containment and the number of distinct shingles. A text of
at most ``k`` distinct shingles is represented exactly.

Cases: a null text is an empty one; a text of fewer words than a shingle has one shingle of all
its words, one without words has an empty sketch; two empty sketches resemble by 1, an
empty and another by 0. The successor of a document is the next by (doc_id, text), nulls
first, and that of the last is the first; repeated rows follow each other; a single
document follows itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.quality_rules import shingle_hashes, word_hashes

SHINGLE = 5
SKETCH = 128


def sketch_of(w: str, k: int = SKETCH, shingle: int = SHINGLE) -> Column:
    """The sketch of a text, an ascending array<long>, from the column ``w`` of its word hashes."""
    return F.when(F.size(w) > 0, F.slice(F.sort_array(F.array_distinct(shingle_hashes(w, shingle))), 1, k)).otherwise(F.array().cast("array<bigint>"))


def with_sketch(docs: DataFrame, text_col: str, name: str, k: int = SKETCH, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the sketch of ``text_col`` as column ``name``."""
    hashed = docs.withColumn("_parley_w", word_hashes(F.col(text_col)))
    return hashed.withColumn(name, sketch_of("_parley_w", k, shingle)).drop("_parley_w")


def merge(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: DataFrame, by: list[str], col: str = "sketch", k: int = SKETCH) -> DataFrame:
    """One sketch per group of parts.

    Hashes are counted one by one, with the distinct ones of a task combined before the
    shuffle, and ranked within the group; no group is gathered to sort it.
    """
    flat = sketches.select(*by, F.explode(col).alias("_h")).distinct()
    ranked = flat.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_r") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(col))


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both have."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of a's shingles that b has too."""
    union = distinct_shingles(merge(a, b, k), k)
    both = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def fingerprint(a: Column) -> Column:
    """A sketch as text: its hashes as 16 hexadecimal digits each."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, cols: list[str], order: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """Adds ``next``, a struct of ``cols`` of the row that follows, by (order, text); the first follows the last.

    Rows are dealt to buckets of consecutive ids by quantiles of the id, and followers are found
    within a bucket. The first id of each bucket is copied to the end of the bucket before, so
    no bucket needs another. One shuffle; the driver sees the bucket bounds.
    """
    spark = docs.sparkSession
    ids = docs.select(order)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = ids.agg(F.min(order)).first()[0]
    has_null = bool(ids.where(F.col(order).isNull()).limit(1).count())
    bounds = ids.where(F.col(order).isNotNull()).approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.25 / buckets) if least is not None else []
    firsts = sorted({int(b) for b in bounds} | ({least} if least is not None else set()))
    firsts = ([None] if has_null else []) + firsts
    if not firsts:
        return docs.withColumn("next", F.struct(*cols))
    known = F.array(*(F.lit(x).cast("long") for x in firsts if x is not None)) if firsts != [None] else F.array().cast("array<long>")
    bucket = F.when(F.col(order).isNull(), F.lit(0)).otherwise(F.lit(int(has_null)) + F.size(F.filter(known, lambda x: x <= F.col(order).cast("long"))) - 1)
    dealt = docs.withColumn("_b", bucket)
    is_first = F.col(order).isNull() if has_null else F.lit(False)
    is_first = is_first | F.coalesce(F.array_contains(known, F.col(order).cast("long")), F.lit(False))
    before = F.pmod(F.col("_b") - 1, F.lit(len(firsts)))
    places = F.when(is_first, F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy")), F.struct(before.alias("b"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy"))))
    placed = dealt.withColumn("_p", F.explode(places)).withColumns({"_b": F.col("_p.b"), "_copy": F.col("_p.copy")}).drop("_p")
    window = Window.partitionBy("_b").orderBy("_copy", F.col(order).asc_nulls_first(), "text")
    return placed.withColumn("next", F.lead(F.struct(*cols)).over(window)).where(~F.col("_copy")).drop("_b", "_copy")


def fingerprint_documents(docs: DataFrame, k: int = SKETCH, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and its sketch."""
    return with_sketch(docs.select("doc_id", "text"), "text", "sketch", k, shingle).select("doc_id", "sketch")


def edited_likeness(docs: DataFrame, k: int = SKETCH, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and how many shingles a text has and shares.

    The edited text has its last half, counted in code points and rounded down, replaced by as
    much of the beginning of the following document.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # The sketch is made before the shuffle, so that a follower brings its own.
    base = with_sketch(base.withColumn("n_chars", F.length("text").cast("long")), "text", "sketch", k, shingle)
    paired = with_next(base, ["text", "sketch"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next.text"), F.lit(1), half))
    paired = paired.select("doc_id", "n_chars", "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    paired = paired.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "edited")
    paired = with_sketch(paired, "edited", "edited_sketch", k, shingle)
    return paired.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("kept_in_edited"),
        containment(F.col("sketch"), F.col("next_sketch"), k).alias("kept_in_next"),
    )
