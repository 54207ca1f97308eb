"""The benchmark matrix: every recogniser in every audio mode over every item, computed once and resumed where it stopped.

A cell is one recogniser's answer to one item in one mode. Cells that are stored are anti-joined away, the rest are computed
and published per recogniser and mode together with the seconds they took. A recogniser that fails in any mode is left out.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import metrics
from parley.sources.store import Store

MODES = ("original", "telephone")
#: The items are ten minutes of calls; runtime is stated for forty.
RUNTIME_FACTOR = 4

#: (items, mode) -> item, hyp, and the ``scored`` and ``correct`` seconds of its speakers.
Recognizer = Callable[[DataFrame, str], DataFrame]
CELL = ("item", "hyp", "scored", "correct")


class Matrix:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.perf_counter):
        self.spark, self.store, self.clock = spark, Store(spark, path), clock

    def _name(self, candidate: str, mode: str) -> str:
        return f"{candidate}/{mode}"

    def parts(self, candidate: str, mode: str) -> list[dict]:
        """Published folders of a run with the cells and seconds of each."""
        return (self.store.pointer(self._name(candidate, mode)) or {}).get("parts", [])

    def cells(self, candidate: str, mode: str) -> DataFrame | None:
        folders = [p["folder"] for p in self.parts(candidate, mode)]
        return self.spark.read.parquet(*folders) if folders else None

    def _todo(self, items: DataFrame, candidate: str, mode: str) -> DataFrame:
        done = self.cells(candidate, mode)
        return items if done is None else items.join(done.select("item"), "item", "left_anti")

    def compute(self, items: DataFrame, candidate: str, mode: str, recognize: Recognizer) -> int:
        """Compute and publish the cells of ``items`` that aren't stored; returns how many."""
        name, todo = self._name(candidate, mode), self._todo(items, candidate, mode)
        if todo.isEmpty():
            return 0
        began, folder = self.clock(), self.store.fresh(name)
        recognize(todo, mode).select(*CELL).write.parquet(folder)
        made = self.spark.read.parquet(folder).count()
        part = {"folder": folder, "cells": made, "seconds": self.clock() - began}
        self.store.publish(name, {"parts": [*self.parts(candidate, mode), part]})
        return made

    def run(self, items: DataFrame, recognizers: dict[str, Recognizer], modes: Iterable[str] = MODES) -> tuple[int, dict[str, str]]:
        """(cells computed now, errors by ``candidate:mode``) for items with ``item``, ``complete`` and what the recognisers need.

        Items that aren't complete are an error: their reference is not yet corrected. What was computed before a failure stays.
        """
        if items.where(~F.coalesce("complete", F.lit(False))).limit(1).count():
            raise ValueError("all items must be complete")
        made, errors = 0, {}
        for candidate, recognize in recognizers.items():
            for mode in modes:
                try:
                    made += self.compute(items, candidate, mode, recognize)
                except Exception as error:  # whatever a recogniser raises takes it out of the comparison
                    errors[f"{candidate}:{mode}"] = str(error).split("\n")[0]
                    break
        if len({e.split(":")[0] for e in errors}) == len(recognizers):
            raise RuntimeError(f"every recogniser failed: {errors}")
        return made, errors

    def reports(self, items: DataFrame, candidates: list[str], names: Iterable[str] = (), modes: Iterable[str] = MODES) -> DataFrame:
        """One report per candidate and mode of those whose every item is stored, with ``runtime`` and ``runtime_40min`` seconds.

        ``items``: item and ``ref``. Candidates keep the order given, as ``candidate_no``. A candidate that lacks a cell has no report.
        """
        wanted, modes, out = items.count(), list(modes), []
        for number, candidate in enumerate(candidates):
            if any(self._todo(items, candidate, mode).limit(1).count() for mode in modes):
                continue
            for mode in modes:
                runtime = sum(p["seconds"] for p in self.parts(candidate, mode))
                met = items.select("item", "ref").join(self.cells(candidate, mode).select(*CELL), "item")
                out.append(met.select(F.lit(number).alias("candidate_no"), F.lit(candidate).alias("candidate"), F.lit(mode).alias("mode"), F.lit(runtime).alias("runtime"), "ref", "hyp", "scored", "correct"))
        if not out:
            raise RuntimeError(f"no candidate has all {wanted} items")
        keys = ["candidate_no", "candidate", "mode", "runtime"]
        scored = metrics.item_counts(reduce(DataFrame.unionByName, out), names)
        return metrics.corpus_report(scored, names, by=keys).withColumn("runtime_40min", RUNTIME_FACTOR * F.col("runtime"))


def report_document(reports: DataFrame, promoted: DataFrame, errors: dict[str, str]) -> DataFrame:
    """One row ``content``: the benchmark's final report as JSON. ``reports`` has a row per candidate and mode, ``promoted`` one."""
    entry = F.struct(F.concat_ws(":", "candidate", "mode").alias("key"), F.struct(*(c for c in reports.columns if c not in ("candidate", "mode", "candidate_no"))).alias("value"))
    gathered = reports.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("reports"))
    failed = F.from_json(F.lit(json.dumps(errors)), "map<string,string>")
    return gathered.join(promoted.select(F.struct(*promoted.columns).alias("promoted")), F.lit(True)).select(F.to_json(F.struct("reports", failed.alias("errors"), "promoted")).alias("content"))  # one row each
