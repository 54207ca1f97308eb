"""Stored results that are whole or not there: data goes to a fresh folder, and one small pointer file, replaced at once, names it.

A job that dies before the pointer is replaced leaves a folder that nobody reads. Paths are those of ``pyarrow.fs`` (local folders that all
machines share, or URIs of shared stores).
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from parley.sources.shards import file_system


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def fresh(self, name: str) -> str:
        """A folder that nothing was written to."""
        return f"{self.path}/{name}/{uuid.uuid4().hex}"

    def pointer(self, name: str) -> dict | None:
        """What was last published under ``name``; None without it, or if it is damaged."""
        from pyarrow import fs

        store, at = file_system(f"{self.path}/{name}.json")
        if store.get_file_info(at).type != fs.FileType.File:
            return None
        with store.open_input_stream(at) as file:
            try:
                found = json.loads(file.read())
            except ValueError:
                return None
        return found if isinstance(found, dict) else None

    def publish(self, name: str, value: dict) -> None:
        store, at = file_system(f"{self.path}/{name}.json")
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        new = f"{at}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(new) as file:
            file.write(json.dumps(value, ensure_ascii=False).encode())
        store.move(new, at)


class Checkpoints(Store):
    """Results of a pipeline's stages, by stage and key (``transcripts.settings_key``): the newest whole version counts."""

    def save(self, df: DataFrame, stage: str, key: str) -> DataFrame:
        """Write ``df`` as a new version and return it as read back; earlier versions stay to fall back on."""
        name = f"{stage}/{key}"
        folder = self.fresh(name)
        df.write.parquet(folder)
        made = self.spark.read.parquet(folder)
        before = (self.pointer(name) or {}).get("versions", [])
        self.publish(name, {"versions": [{"folder": folder, "rows": made.count()}, *before][:2]})
        return made

    def load(self, stage: str, key: str) -> DataFrame | None:
        """The newest version that is there with all its rows, or None, so that the stage runs again."""
        for version in (self.pointer(f"{stage}/{key}") or {}).get("versions", []):
            try:
                found = self.spark.read.parquet(version["folder"])
                if found.count() == version["rows"]:
                    return found
            except (PySparkException, KeyError):
                continue
        return None

    def run(self, stage: str, key: str, make) -> DataFrame:
        """The stored result, else ``make()``'s, which is then stored."""
        found = self.load(stage, key)
        return self.save(make(), stage, key) if found is None else found
