"""Scans of transcripts, checkpoints, manifests, corrections and job logs, and their sinks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parley.sources.schema import CORRECTION, MANIFEST, TRANSCRIPT, with_defaults


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of JSON files (a document each), with defaults; the text is derived from the segments."""
    return with_defaults(spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path))


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame | None:
    """A stage's stored result, or None if it is missing or damaged, so that the stage runs again."""
    kept = T.StructType([*TRANSCRIPT.fields, T.StructField("_corrupt_record", T.StringType())])
    try:
        found = spark.read.schema(kept).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        damaged = found.where("_corrupt_record is not null or source is null").limit(1).count()
        whole = None if damaged or not found.limit(1).count() else with_defaults(found.drop("_corrupt_record"))
    except Exception as error:  # a missing path is found at analysis
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return whole


def settings_key(settings: dict, content: Column) -> Column:
    """A checkpoint's key: it changes with any setting and with the recording's content."""
    return F.sha2(F.concat(F.lit(json.dumps(settings, sort_keys=True)), F.lit("\n"), content), 256)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of a benchmark manifest, in order (``item_no``)."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.posexplode("items").alias("item_no", "_i")).select("item_no", "_i.*")


def manifest_items(windows: DataFrame, total: float = 600.0) -> DataFrame:
    """Items of a new manifest from (id, source_name, source_start, source_end, source_duration).

    A window past its source's end is an error, and so is another total than ``total`` seconds.
    """
    length = F.col("source_end") - F.col("source_start")
    inside = F.when(F.col("source_end") <= F.col("source_duration"), length).otherwise(F.raise_error(F.lit("a window ends after its source")).cast("double"))
    items = windows.select("id", "source_name", "source_start", "source_end", inside.alias("duration"), F.lit(False).alias("complete"))
    whole = items.agg(F.when(F.abs(F.sum("duration") - total) <= 0.001, F.lit(True)).otherwise(F.raise_error(F.lit("the windows have another total")).cast("boolean")).alias("_fits"))
    return items.join(F.broadcast(whole), F.col("_fits")).drop("_fits")  # one row


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Corrections of JSON files with their file name and ``duration``, in no order."""
    found = spark.read.schema(CORRECTION).option("multiLine", True).json(path)
    seconds = F.aggregate(F.coalesce("segments", F.array().cast(CORRECTION["segments"].dataType)), F.lit(0.0), lambda s, x: s + x["end"] - x["start"])
    meta = F.col("correction_metadata")
    return found.select("*", F.input_file_name().alias("file"), seconds.alias("duration"), meta["verified"].alias("verified"), meta["held_out"].alias("held_out"))


def correction(transcripts: DataFrame, held_out: Column) -> DataFrame:
    """Transcripts with the metadata of a saved correction: verified, and eligible unless held out."""
    meta = F.struct((~held_out).alias("training_eligible"), held_out.alias("held_out"), F.col("source").alias("split_group"), F.lit(True).alias("verified"))
    return transcripts.withColumn("correction_metadata", meta)


def audio_fits(actual: Column, expected: Column) -> Column:
    """Whether attached audio is within 0.75 s or one per cent of the expected length (0: unknown)."""
    return (expected == 0) | (F.abs(actual - expected) <= F.greatest(F.lit(0.75), 0.01 * expected))


def latest_jobs(log: DataFrame) -> DataFrame:
    """The last row of each job (job_id, ts, status, message); one that was running becomes a resumable error."""
    last = Window.partitionBy("job_id").orderBy(F.desc("ts"))
    now = log.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    stopped = F.col("status") == "running"
    return now.select("job_id", "ts", F.when(stopped, "error").otherwise(F.col("status")).alias("status"), F.when(stopped, "interrupted").otherwise(F.col("message")).alias("message"), stopped.alias("resumable"))


def json_turns(text: Column) -> Column:
    """The first array of objects with id and text in a model's raw answer, as array<struct<id, text>>; null without one."""

    def first(answer: str | None):
        at = (answer or "").find("[")
        while at >= 0:
            try:
                found, _ = json.JSONDecoder().raw_decode(answer, at)
                if found and isinstance(found, list) and all(isinstance(x, dict) and {"id", "text"} <= x.keys() for x in found):
                    return json.dumps([{"id": x["id"], "text": str(x["text"])} for x in found])
            except ValueError:
                pass
            at = answer.find("[", at + 1)
        return None

    def run(answers: pd.Series) -> pd.Series:
        return answers.map(first)

    return F.from_json(F.pandas_udf(run, "string")(text), "array<struct<id:int,text:string>>")


def known_candidates(wanted: Column, known: list[str], most: int = 2) -> Column:
    """Known names among those wanted, distinct and in order, at most ``most``."""
    return F.slice(F.array_intersect(F.array_distinct(wanted), F.array(*map(F.lit, known))), 1, most)
