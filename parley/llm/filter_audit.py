"""How five document filters interact, for every order in which they may be applied (operator 11).

Words are exploded and counted by (document, word), then by document, which gives totals and distinct words.
The flags that need no words are joined to that, and each part counts its documents by the 32 combinations of
failed filters. Every order's figures follow from those 32 counts.

Filters fail a text: A under 200 words; B fewer distinct words than half of all; C more than 2 capital letters
A-Z in 100 code points; D any of ``#$%&*|``; E equal to the text of a smaller id.

Cases: a null text is an empty one (it fails A, and E where a smaller id has an empty text too); a null part is an empty
string; a document without an id never fails E, makes no other fail it and has no labels; rows that agree in id, text and part
count as often as they occur, and those that agree in id and text don't fail E for each other; of several labels of one id
any that says 1 decides; labels of unknown ids are ignored; an empty table gives an empty result; other columns are ignored.
Two texts of one id (or none) are told apart by 64 bits of their digest when words are counted, texts in E by all 256.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.store import cut

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: Bytes of text whose words one task counts.
TASK_BYTES = 16 << 20
#: Tasks over which rows that agree in id and text may spread.
SALTS = 16


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_totals(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``_h``, ``n_words`` and ``n_distinct`` of every (doc_id, _h) of ``docs``, from its ``text``; ``size`` is all texts' bytes.

    The texts are shuffled once, by document; both counts then stay within a task. Each row adds an empty word,
    which tells how many equal rows a count has seen. Equal rows are salted by the task that read them.
    """
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    key = ["doc_id", "_h", "_salt"]
    dealt = docs.select("doc_id", "_h", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"), "text").repartition(tasks, *key)
    words = dealt.select(*key, F.explode(F.array_append(word_array(F.col("text")), F.lit(""))).alias("word"))
    counted = words.groupBy(*key, "word").agg(F.count("*").alias("n"))
    rows = F.sum(F.when(F.col("word") == "", F.col("n")))
    by_copy = counted.groupBy(*key).agg(F.expr("CAST(sum(n) AS BIGINT)").alias("n"), rows.alias("rows"), (F.count("*") - 1).alias("n_distinct"))
    return by_copy.groupBy("doc_id", "_h").agg(F.max(F.expr("(n - rows) div rows")).alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``fails`` (a bit a filter, A the lowest) and ``n``, the rows that agree in them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    base = base.withColumn("_digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))).withColumn("_h", F.xxhash64("_digest"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    size = F.octet_length("text").cast("long").alias("_size")
    flags = base.select("doc_id", "part", "_digest", "_h", size, (100 * capitals > 2 * F.length("text")).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"))
    flags = cut(flags.groupBy(*flags.columns).agg(F.count("*").alias("n")))
    # A text's smallest id is one row, so the join's key holds the id too and a common text spreads.
    first = flags.groupBy("_digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("_is_first", F.lit(True))
    known = flags.join(first, ["_digest", "doc_id"], "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("_is_first").isNull())
    total = flags.agg(F.sum(F.col("n") * F.col("_size"))).first()[0] or 0
    words = word_totals(base.select("doc_id", "_h", "text"), total).withColumnRenamed("doc_id", "_id").withColumnRenamed("_h", "_hash")
    known = known.join(words, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    known = known.withColumns({"A": F.col("n_words") < 200, "B": 100 * F.col("n_distinct") < 50 * F.col("n_words")})
    fails = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    return known.select("doc_id", "part", fails.alias("fails"), "n").groupBy("doc_id", "part", "fails").agg(F.sum("n").alias("n"))


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part`` and its documents by failed filters, 32 columns each of all (``n_0``..), good (``good_0``..) and toxic ones."""
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    judged = failures(docs).join(told, "doc_id", "left")
    kinds = {"n": F.lit(True), "good": F.col("_good") == 1, "toxic": F.col("_toxic") == 1}
    columns = [F.coalesce(F.sum(F.when(is_kind & (F.col("fails") == m), F.col("n"))), F.lit(0)).alias(f"{kind}_{m}") for kind, is_kind in kinds.items() for m in range(SETS)]
    return judged.groupBy("part").agg(*columns)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step of it; see the module for the filters.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter but were removed earlier), ``unique_fails``
    (fail its filter alone), ``good_lost`` and ``toxic_lost`` (labelled ones among the removed), and ``shapley``: the filter's removed
    over all orders. In m of 120 orders with m = 120 / (failed filters) a document is removed by one of those it fails.
    """
    held = counts(docs, labels).select("part", *(F.array(*(f"{kind}_{m}" for m in range(SETS))).alias(kind) for kind in ("n", "good", "toxic")))
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    steps = held.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = [F.instr("filter_order", f) for f in FILTERS]
    bits = lambda choose: sum((F.when(choose(p), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    steps = steps.withColumns({"_own": bits(lambda p: p == F.col("step")), "_before": bits(lambda p: p < F.col("step"))})
    every = F.sequence(F.lit(0), F.lit(SETS - 1))

    def total(kind, choose, weight=lambda m: F.lit(1)):
        return F.aggregate(every, F.lit(0).cast("long"), lambda s, m: s + F.when(choose(m), F.get(F.col(kind), m) * weight(m)).otherwise(F.lit(0)).cast("long"))

    fails = lambda m: m.bitwiseAND(F.col("_own")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("_before")) != 0
    first = lambda m: fails(m) & ~earlier(m)
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total("n", first).alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.get("n", F.col("_own")).cast("long").alias("unique_fails"),
        total("good", first).alias("good_lost"),
        total("toxic", first).alias("toxic_lost"),
        total("n", fails, lambda m: (F.lit(120) / F.bit_count(m)).cast("long")).alias("shapley"),
    )
