"""Quality rules as a learned decision list (operator 1, DataFrame functions only).

Text statistics are Spark expressions. Sequential covering learns an ordered list of
threshold conjunctions that pick out bad documents: candidate thresholds are quantiles of
the labelled rows; one aggregation counts, for the rows that the rule so far still
covers, how many good and bad ones lie in each interval of each feature, from which the
best next condition is read off. A finished conjunction is pruned on rows that were not
used to grow it, its rows are taken out, and the next rule is grown. The list becomes one
``CASE WHEN`` expression.

Cases: a null text has no words; statistics of it are 0. A document without words fails
the base rule. A null id or label takes no part in fitting. Rows are judged one by one,
so repeated rows get equal verdicts, and extra columns are ignored. With no labels, or
labels of one kind only, the list is empty and only the base rule rejects.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.store import cut

WHITE = r"[\x20\x09-\x0D]+"
#: At most about this many labelled rows are used, chosen by a hash of their id.
LABELLED_ROWS = 20_000
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "digit_rate", "line_rate")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of every word. Meant to be a column of its own: lambdas over a text would split it anew each time."""
    return F.transform(words(text), lambda x: F.xxhash64(x))


def shingle_hashes(w: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words, from the column ``w`` of word hashes; of fewer words, one of them all."""
    n = F.size(w)
    runs = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(F.col(w), i + k) for k in range(1, size))))
    return F.slice(runs, 1, F.greatest(F.lit(1), n - (size - 1)))


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of ``text`` are in the class ``chars``."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def repeated_words(hashes: Column, size: int) -> Column:
    """Words inside windows that occur twice or more, from the text's window hashes.

    The hashes are sorted with their positions, equal neighbours are repeats, and the
    covered words are summed over the gaps between consecutive repeated positions.
    """
    n = F.size(hashes)
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    before = F.concat(F.slice(placed, 1, 1), F.slice(placed, 1, n - 1))
    after = F.concat(F.slice(placed, 2, n), F.slice(placed, n, 1))
    three = F.arrays_zip(placed.alias("a"), before.alias("b"), after.alias("c"))
    # The first row is its own neighbour before it and the last after it; the zip's position tells them apart.
    repeats = F.filter(
        three,
        lambda x: ((x["a"]["h"] == x["b"]["h"]) & (x["a"]["i"] != x["b"]["i"])) | ((x["a"]["h"] == x["c"]["h"]) & (x["a"]["i"] != x["c"]["i"])),
    )
    at = F.sort_array(F.transform(repeats, lambda x: x["a"]["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-size).alias("last")),
        lambda s, i: F.struct((s["sum"] + F.least(F.lit(size), i - s["last"])).alias("sum"), i.alias("last")),
        lambda s: s["sum"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0).cast("long")).otherwise(covered)


def text_statistics(docs: DataFrame, carry: dict[str, Column] | None = None, text_col: str = "text", window: int = 8) -> DataFrame:
    """The columns ``carry`` (by default ``doc_id``) and the statistics of each whole text; one pass, no shuffle."""
    carry = carry or {"doc_id": F.col("doc_id")}
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*(c.alias(name) for name, c in carry.items()), t.alias("_t"), words(F.col(text_col)).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Each step is a projection of its own whose columns the next uses more than once, so that Catalyst keeps them apart.
    base = base.select(*carry, "_t", "_w", F.size("_w").cast("long").alias("n_words"), lines.alias("_l"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_x"))
    hashes = F.when(F.col("n_words") >= window, shingle_hashes("_x", window)).otherwise(F.array().cast("array<bigint>"))
    base = base.select(*carry, "_t", "_w", "n_words", "_l", hashes.alias("_h"))
    found = {
        "n_words": F.col("n_words"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": count_chars(F.col("_t"), "#*$%&|<>"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_h"), window),
        "n_lines": F.size("_l").cast("long"),
        "n_upper": count_chars(F.col("_t"), r"\p{Lu}"),
        "n_marks": count_chars(F.col("_t"), "!?.,;:"),
        "n_digits": count_chars(F.col("_t"), "0-9"),
    }
    # A generator of one row: filters on the statistics stay above it, so that each is computed once a row.
    once = base.select(*carry, F.explode(F.array(F.struct(*(c.alias(name) for name, c in found.items())))).alias("_s"))
    return once.select(*carry, "_s.*")


def features() -> list[Column]:
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    by_name = {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbol_rate": F.col("n_symbols") / n,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / n,
        "upper_rate": F.col("n_upper") / c,
        "mark_rate": F.col("n_marks") / n,
        "digit_rate": F.col("n_digits") / c,
        "line_rate": F.col("n_lines") / n,
    }
    return [by_name[name] for name in FEATURES]


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def on(self, values: list[Column]) -> Column:
        x = values[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


def _all(conditions: list[Condition], values: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, (c.on(values) for c in conditions), F.lit(True))


def _precision(bad: int, good: int) -> float:
    return (bad + 1) / (bad + good + 2)


def _interval(x: Column, points: list[float]) -> Column:
    """How many of the ascending ``points`` lie below ``x``."""
    return F.size(F.filter(F.array(*map(F.lit, points)), lambda point: point < x)) if points else F.lit(0)


def fit_decision_list(
    labelled: DataFrame, bins: int = 48, max_rules: int = 8, max_conditions: int = 3, min_bad: int = 5, min_precision: float = 0.75
) -> list[list[Condition]]:
    """Ordered rules, each a conjunction that marks bad rows, learned by sequential covering.

    ``labelled`` has the columns of ``text_statistics``, ``quality`` (0 bad, 1 good) and
    ``grow`` (true: used to grow, false: to prune). Only counts per feature and interval
    reach the driver: at most ``len(FEATURES) * bins * 4`` rows a step. A rule stays if its
    precision on the pruning rows, with one good and one bad row added, is ``min_precision``.
    """
    values = features()
    names = [f"f{i}" for i in range(len(values))]
    rows = cut(labelled.select("quality", "grow", *(v.alias(k) for v, k in zip(values, names, strict=True))))
    cols = [F.col(k) for k in names]
    kinds = {r["quality"] for r in rows.select("quality").distinct().limit(3).collect()}
    if not {0, 1} <= kinds:
        return []
    quantiles = rows.approxQuantile(names, [i / bins for i in range(1, bins)], 0.002)
    # Bad rows are few; their own quantiles give thresholds where they lie.
    quantiles_bad = rows.where("quality = 0").approxQuantile(names, [i / 16 for i in range(0, 17)], 0.002)
    points = [sorted(set(a) | set(b)) for a, b in zip(quantiles, quantiles_bad, strict=True)]
    # Thresholds lie midway, so that a value seen in either kind is not on the border itself.
    cuts = [[(a + b) / 2 for a, b in zip(p, p[1:], strict=False)] for p in points]
    rows = cut(rows.select("*", F.array(*(_interval(x, c) for c, x in zip(cuts, cols, strict=True))).alias("bin")))

    def counts(where: Column) -> dict:
        """(feature, interval, grow) -> [bad, good] of the rows that ``where`` covers."""
        got: dict = {}
        for r in rows.where(where).select("quality", "grow", F.posexplode("bin").alias("f", "b")).groupBy("f", "b", "grow", "quality").count().collect():
            got.setdefault((r["f"], r["b"], r["grow"]), [0, 0])[r["quality"]] += r["count"]
        return got

    rules: list[list[Condition]] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule: list[Condition] = []
        reached = 0.0
        while len(rule) < max_conditions:
            got = counts(left & _all(rule, cols))
            best = None
            for f, points in enumerate(cuts):
                hist = [[got.get((f, b, True), [0, 0])[q] for b in range(len(points) + 1)] for q in (0, 1)]
                all_bad, all_good = sum(hist[0]), sum(hist[1])
                bad = good = 0
                for b, point in enumerate(points):
                    bad, good = bad + hist[0][b], good + hist[1][b]
                    for above, x, y in ((False, bad, good), (True, all_bad - bad, all_good - good)):
                        # Weighted gain in precision: few pure rows lose to many nearly pure ones.
                        if x >= min_bad and (score := (x**0.5) * (_precision(x, y) - 0.5)) and (best is None or score > best[0]):
                            best = (score, Condition(f, above, point), _precision(x, y))
            if best is None or rule and best[2] <= reached + 1e-3:
                break
            rule.append(best[1])
            reached = best[2]
            if reached >= 0.995:
                break
        # Prune: drop last conditions while that does not lower precision on the pruning rows.
        tried = []
        for k in range(1, len(rule) + 1):
            r = rows.where(left & _all(rule[:k], cols)).agg(
                *(F.coalesce(F.sum(F.when((F.col("quality") == q) & ~F.col("grow"), 1)), F.lit(0)).alias(f"q{q}") for q in (0, 1))
            ).first()
            tried.append((_precision(r["q0"], r["q1"]), -k, r["q0"]))
        if not tried:
            break
        found = max(tried)
        if found[0] < min_precision or not found[2]:
            break
        rule = rule[: -found[1]]
        rules.append(rule)
        left = left & ~_all(rule, cols)
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that fires, else null."""
    values = features()
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(_all(rule, values), F.lit(k)).otherwise(out)
    return out


def chosen_labels(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, quality, grow) of about ``rows`` labelled documents, chosen by a hash of their id; a third of them prune.

    Of several labels of a document one that says 0 decides.
    """
    labels = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    share = min(1.0, rows / max(1, labels.count()))
    h = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(1_000_000))
    return labels.where(h < int(share * 1_000_000)).withColumn("grow", F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(3)) != 0)


def judge(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """Statistics, base verdict, number of the rule that rejects (or null) and ``kept`` of every document.

    The statistics are computed once and kept in the shared folder: they are a few dozen
    bytes a document, and both fitting and judging read them. Rows that the base rule fails
    take no part in fitting, since the list only has to judge the others.
    """
    statistics = cut(text_statistics(docs))
    rules = fit_decision_list(statistics.where(~base_failed()).join(chosen_labels(labels, rows), "doc_id"))
    judged = statistics.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def reject(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """``docs`` without the documents that the base rule or the list rejects; all columns stay as they are.

    Fitting reads the labelled documents only; the verdict is then part of one pass over the rows.
    """
    chosen = F.broadcast(chosen_labels(labels, rows))  # bounded by ``rows``
    labelled = docs.select("doc_id", "text").join(chosen, "doc_id")
    statistics = text_statistics(labelled, {c: F.col(c) for c in ("doc_id", "quality", "grow")})
    rules = fit_decision_list(statistics.where(~base_failed()))
    judged = text_statistics(docs, {"_row": F.struct(*docs.columns)})
    return judged.where(~base_failed() & verdict(rules).isNull()).select("_row.*")
