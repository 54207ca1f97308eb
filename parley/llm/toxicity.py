"""Toxicity by classifier chains (operator 6).

Categories are predicted one after another: each is a logistic regression on the terms of a
text and on the probabilities of the categories before it. While fitting, these earlier
probabilities are out of fold: every labelled row gets them from models that were
fitted without its fold, so that later models learn from predictions as good as those that they
will meet. The last category decides.

Terms are the words of a text and, of longer words, their first ``STEM`` letters. They are chosen by how much
more often labelled documents of the category have them than others (log odds with a prior, over
its standard error), counted over all words of whole texts; all that are clear enough count. What
a fold is predicted with is chosen without that fold. Fitting uses at most about ``rows``
labelled documents, chosen by a hash of their id.

Cases: a null text has no terms; rows without a label or with a null id take no part in fitting;
rows are judged one by one, so repeated rows get equal results; an empty table gives an empty
result; a category that all or none of the labelled rows have gets their share as its
probability (0.0 with no labelled rows); other columns are kept by ``reject`` and
ignored otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.store import cut

#: At most about this many labelled documents are used.
LABELLED_ROWS = 10_000
LEAST_DOCUMENTS = 4
#: Standard errors from which on a term counts.
CLEAR = 3.0
STEM = 4
FOLDS = 3
RIDGE = 0.2
THRESHOLD = 0.4
#: Categories in chain order, as conditions on a labelled row (columns ``toxic`` and ``quality``). The last is the verdict.
CATEGORIES = (("poor", "quality = 0"), ("crude", "toxic = 1 and quality = 0"), ("toxic", "toxic = 1"))
_NOT_WORD = r"[^\p{L}\p{N}']+"


def terms_of(text: Column, stem: int = STEM) -> Column:
    """Distinct lower-case words of a text, and the beginnings of the longer ones, marked by a star."""
    words = F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD), ""))
    stems = F.transform(F.filter(words, lambda w: F.length(w) > stem), lambda w: F.concat(F.substring(w, 1, stem), F.lit("*")))
    return F.array_union(words, stems)


def choose_terms(labelled: DataFrame, label: str = "toxic", folds: int = FOLDS, least: int = LEAST_DOCUMENTS, clear: float = CLEAR) -> tuple[list[str], np.ndarray]:
    """The terms that speak clearly for or against ``label``, and which are chosen: by all rows, then without each fold.

    A term is in at least ``least`` of the rows and ``clear`` standard errors off. The driver gets
    the chosen ones only, fewer than the words of the ``rows`` that a chain is fitted on.
    """
    parts = {(r["fold"], r[label]): r["count"] for r in labelled.groupBy("fold", label).count().collect()}
    counted = labelled.select("fold", label, F.explode("terms").alias("term")).groupBy("term")
    counted = counted.agg(*(x for f in range(folds) for x in (F.count_if(F.col("fold") == f).alias(f"n{f}"), F.sum(F.when(F.col("fold") == f, F.col(label)).otherwise(0)).alias(f"a{f}"))))
    # Log odds of the term in either kind, with half a document added to each cell.
    odds = lambda x, of: F.log((x + 0.5) / (F.lit(of) - x + 0.5))
    sides = []
    for out in (None, *range(folds)):
        used = [f for f in range(folds) if f != out]
        yes, no = (sum(parts.get((f, y), 0) for f in used) for y in (1, 0))
        a, n = (sum((F.col(f"{c}{f}") for f in used), F.lit(0)) for c in ("a", "n"))
        error = F.sqrt(1 / (a + 0.5) + 1 / (n - a + 0.5))
        z = (odds(a, yes) - odds(n - a, no)) / error
        sides.append((n >= least) & (F.abs(z) >= clear) if yes and no else F.lit(False))
    found = counted.select("term", *(side.alias(f"s{k}") for k, side in enumerate(sides))).where(" or ".join(f"s{k}" for k in range(len(sides)))).orderBy("term").collect()
    return [r["term"] for r in found], np.array([[r[f"s{k}"] for r in found] for k in range(len(sides))], dtype=bool).reshape(len(sides), len(found))


@dataclass
class Matrix:
    """0/1 columns by the positions of their ones, row after row, then dense columns."""

    bounds: np.ndarray  # where each row's positions begin, and the end
    ones: np.ndarray
    width: int
    dense: np.ndarray

    @classmethod
    def of(cls, lists: pa.Array, width: int) -> Matrix:
        bounds = np.asarray(lists.offsets)
        return cls(bounds - bounds[0], np.asarray(lists.flatten()), width, np.zeros((len(lists), 0)))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def with_column(self, values: np.ndarray) -> Matrix:
        return Matrix(self.bounds, self.ones, self.width, np.c_[self.dense, values])

    def rows(self, where: np.ndarray) -> Matrix:
        n = np.diff(self.bounds)
        return Matrix(np.r_[0, np.cumsum(n[where])], self.ones[np.repeat(where, n)], self.width, self.dense[where])

    def times(self, w: np.ndarray) -> np.ndarray:
        """Of each row, the sum of ``w`` over its columns; the last weight is the bias."""
        summed = np.r_[0.0, np.cumsum(w[self.ones])]
        return summed[self.bounds[1:]] - summed[self.bounds[:-1]] + self.dense @ w[self.width : -1] + w[-1]

    def back(self, r: np.ndarray, squared: bool = False) -> np.ndarray:
        """Of each column, the sum of ``r`` over its rows."""
        dense = self.dense**2 if squared else self.dense
        return np.r_[np.bincount(self.ones, np.repeat(r, np.diff(self.bounds)), self.width), dense.T @ r, r.sum()]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """P = sigmoid(x . weights + bias); ``weights`` ends with the bias."""

    weights: np.ndarray

    def predict(self, x: Matrix) -> np.ndarray:
        return _sigmoid(x.times(self.weights))


def fit_linear(x: Matrix, y: np.ndarray, use: np.ndarray | None = None, start: Linear | None = None, ridge: float = RIDGE, steps: int = 25) -> Linear:
    """Ridge logistic regression by Newton's method, whose steps are solved by conjugate gradients.

    ``use``: which of the 0/1 columns may have a weight. Memory grows with the ones, not with rows times columns.
    """
    share = (y.sum() + 0.0) / max(len(y), 1)
    w = np.zeros(x.width + x.dense.shape[1] + 1)
    if not len(y) or share in (0.0, 1.0):
        w[-1] = -30.0 if share == 0 else 30.0
        return Linear(w)
    free = np.ones(len(w), bool)
    if use is not None:
        free[: x.width] = use
    w[-1] = np.log(share / (1 - share))
    if start is not None:
        w = np.where(free, start.weights, 0.0)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x.times(w)
        return float(np.sum(np.logaddexp(0, z) - y * z) + penalty @ (w * w) / 2)

    now = loss(w)
    for _ in range(steps):
        p = _sigmoid(x.times(w))
        curve = p * (1 - p) + 1e-9
        gradient = np.where(free, x.back(p - y) + penalty * w, 0.0)
        scale = x.back(curve, squared=True) + penalty
        step, rest = np.zeros_like(w), gradient
        along = head = rest / scale
        size = rest @ head
        for _ in range(60):
            if size <= 1e-3 * (gradient @ (gradient / scale)) or size == 0:
                break
            bent = np.where(free, x.back(curve * x.times(along)) + penalty * along, 0.0)
            far = size / (along @ bent)
            step, rest = step + far * along, rest - far * bent
            head = rest / scale
            along, size = head + (rest @ head) / size * along, rest @ head
        # Whole steps may overshoot where classes are nearly separable: halve them until the loss falls.
        while (then := loss(w - step)) > now and np.abs(step).max() > 1e-6:
            step = step / 2
        done = now - then <= 1e-5 * abs(now)
        w, now = w - step, then
        if done:
            break
    return Linear(w)


@dataclass
class Chain:
    terms: list[str]
    names: list[str]
    models: list[Linear]

    def predict(self, x: Matrix) -> np.ndarray:
        """Probabilities, a column per category, each fed with those before it."""
        for model in self.models:
            x = x.with_column(model.predict(x))
        return x.dense


def fit_chain(x: Matrix, labels: np.ndarray, folds: np.ndarray, terms: list[str], names: list[str], chosen: np.ndarray | None = None) -> Chain:
    """``labels``: rows x categories; ``folds``: the fold of each row; ``chosen``: terms used by the chain, then by what predicts each fold."""
    chosen = np.ones((1 + int(folds.max(initial=0) + 1), x.width), bool) if chosen is None else chosen
    models = []
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        models.append(fit_linear(x, y, chosen[0]))
        out_of_fold = np.zeros(len(x))
        for fold in np.unique(folds):
            model = fit_linear(x.rows(folds != fold), y[folds != fold], chosen[1 + fold], models[-1])
            out_of_fold[folds == fold] = model.predict(x.rows(folds == fold))
        x = x.with_column(out_of_fold)
    return Chain(terms, names, models)


def matched(terms: list[str], found: Column) -> Column:
    """Those of ``terms`` that the array ``found`` has."""
    return F.array_intersect(found, F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>"))


def _positions(words: pa.Array, terms: list[str]) -> pa.Array:
    """Lists of words as lists of their positions in ``terms``; null lists are empty."""
    at = {t: i for i, t in enumerate(terms)}
    return pa.array([[at[w] for w in found or ()] for found in words.to_pylist()], pa.list_(pa.int32()))


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, rows: int = LABELLED_ROWS) -> Chain:
    """Fit a chain on about ``rows`` of the documents that have labels.

    What the driver gets of each is the positions of its chosen terms and its labels. Of several labels of a document one that
    says toxic decides, and one that says poor.
    """
    told = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id")
    labels = told.agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.min(F.coalesce(F.col("quality").cast("int"), F.lit(1))).alias("quality"))
    share = min(1.0, rows / max(1, labels.count()))
    h = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1_000_000))
    chosen = F.broadcast(labels.where(h < int(share * 1_000_000)))  # bounded by ``rows``
    fold = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(FOLDS)).cast("int")
    labelled = cut(docs.select(F.col("doc_id"), "text").join(chosen, "doc_id").select(fold.alias("fold"), "toxic", "quality", terms_of(F.col("text")).alias("terms")))
    terms, used = choose_terms(labelled)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_positions(batch.column(0), terms), *batch.columns[1:]], names=["found", *batch.schema.names[1:]])

    names = [name for name, _ in categories]
    got = labelled.select(matched(terms, F.col("terms")).alias("found"), "fold", *(F.expr(f"cast({where} as int)").alias(f"y{i}") for i, (_, where) in enumerate(categories)))
    got = got.mapInArrow(place, "found array<int>, fold int, " + ", ".join(f"y{i} int" for i in range(len(names)))).toArrow().combine_chunks()
    y = np.stack([got.column(f"y{i}").to_numpy().astype(float) for i in range(len(names))], axis=1)
    lists = got.column("found").combine_chunks() if len(got) else pa.array([], pa.list_(pa.int32()))
    return fit_chain(Matrix.of(lists, len(terms)), y, got.column("fold").to_numpy(), terms, names, used)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the probability of each category, in chain order, for every text."""
    schema = ", ".join(["doc_id long", *(f"{name} double" for name in chain.names)])

    def run(batches):
        for batch in batches:
            out = chain.predict(Matrix.of(_positions(batch.column(1), chain.terms), len(chain.terms)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, k]) for k in range(out.shape[1]))], names=["doc_id", *chain.names])

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), matched(chain.terms, terms_of(F.col(text_col))).alias("found"))
    return found.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the probability of each category and ``is_toxic`` of every document."""
    chain = fit(docs, labels)
    return score(docs, chain).withColumn("is_toxic", F.col(chain.names[-1]) >= threshold)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents judged toxic; all columns stay as they are."""
    chain = fit(docs, labels)

    def verdict(found):
        import pandas as pd

        words = pa.array(found, pa.list_(pa.string()))
        return pd.Series(chain.predict(Matrix.of(_positions(words, chain.terms), len(chain.terms)))[:, -1] < threshold, dtype=bool)

    return docs.where(F.pandas_udf(verdict, "boolean")(matched(chain.terms, terms_of(F.col("text")))))
