"""Shards of named files: a sink that publishes size-bounded tar files with their JSON lines, and a scan of them.

A task writes to a folder of its own. Only what successful tasks report is moved into place, and the shards count from
the moment that one small index file replaces the one before; until then, and after a failure, readers see the old
ones. Paths are those of ``pyarrow.fs``: local folders that all machines share, or URIs of shared stores.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "split string, audio_filepath string, text string, duration double, content binary"
INDEX = "_shards.json"
SHARD_BYTES = 256 << 20


def file_system(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_index(path: str) -> list[dict]:
    """The published shards: split, tar, lines and rows each; none where nothing was published."""
    from pyarrow import fs

    store, root = file_system(path)
    if store.get_file_info(f"{root}/{INDEX}").type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{root}/{INDEX}") as file:
        return json.loads(file.read())


@dataclass
class Written(WriterCommitMessage):
    shards: list


class _Shard:
    """One tar file and its lines while they are written."""

    def __init__(self, store, folder: str, split: str):
        name = uuid.uuid4().hex
        store.create_dir(folder, recursive=True)
        self.split, self.tar, self.lines, self.rows, self.bytes = split, f"{folder}/{name}.tar", f"{folder}/{name}.json", 0, 0
        self.files = store.open_output_stream(self.tar), store.open_output_stream(self.lines)
        self.archive = tarfile.open(fileobj=self.files[0], mode="w|")

    def add(self, row) -> None:
        info = tarfile.TarInfo(row["audio_filepath"])
        info.size = len(row["content"])
        self.archive.addfile(info, io.BytesIO(row["content"]))
        line = {"audio_filepath": row["audio_filepath"], "text": row["text"], "duration": row["duration"]}
        self.files[1].write((json.dumps(line, ensure_ascii=False) + "\n").encode())
        self.rows, self.bytes = self.rows + 1, self.bytes + 1024 + info.size

    def close(self) -> dict:
        self.archive.close()
        for file in self.files:
            file.close()
        return {"split": self.split, "tar": self.tar, "lines": self.lines, "rows": self.rows}


class ShardWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.limit, self.overwrite = options["path"], int(options.get("shardbytes", SHARD_BYTES)), overwrite
        self.work = f"_temporary/{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, root = file_system(self.path)
        folder, now, done = f"{root}/{self.work}/{uuid.uuid4().hex}", None, []
        for row in rows:
            if now is None or now.split != row["split"] or now.bytes >= self.limit:
                if now:
                    done.append(now.close())
                now = _Shard(store, folder, row["split"])
            now.add(row)
        if now:
            done.append(now.close())
        return Written(done)

    def commit(self, messages: list) -> None:
        store, root = file_system(self.path)
        old = read_index(self.path)
        kept = [] if self.overwrite else old
        # Numbers go on after those ever used, so that nothing that a reader has open is replaced.
        counts: dict = {}
        for shard in old:
            counts[shard["split"]] = max(counts.get(shard["split"], 0), int(shard["tar"].rsplit("_", 1)[1].removesuffix(".tar")) + 1)
        for shard in (s for m in messages if m is not None for s in m.shards):
            number = counts.get(shard["split"], 0)
            counts[shard["split"]] = number + 1
            base = f"{shard['split']}/shard_{number:04d}"
            store.create_dir(f"{root}/{shard['split']}", recursive=True)
            store.move(shard["tar"], f"{root}/{base}.tar")
            store.move(shard["lines"], f"{root}/{base}.json")
            kept.append(shard | {"tar": f"{base}.tar", "lines": f"{base}.json"})
        store.create_dir(f"{root}/{self.work}", recursive=True)
        with store.open_output_stream(f"{root}/{self.work}/{INDEX}") as file:
            file.write(json.dumps(kept).encode())
        store.move(f"{root}/{self.work}/{INDEX}", f"{root}/{INDEX}")
        store.delete_dir(f"{root}/{self.work}")
        if self.overwrite:
            for shard in old:
                for name in (shard["tar"], shard["lines"]):
                    store.delete_file(f"{root}/{name}")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, root = file_system(self.path)
        if store.get_file_info(f"{root}/{self.work}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.work}")


@dataclass
class ShardPartition(InputPartition):
    shard: dict


class ShardReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ShardPartition]:
        return [ShardPartition(s) for s in read_index(self.path)]

    def read(self, partition: ShardPartition) -> Iterator[tuple]:
        if partition is None:  # nothing is published
            return
        store, root = file_system(self.path)
        shard = partition.shard
        with store.open_input_stream(f"{root}/{shard['lines']}") as lines, store.open_input_stream(f"{root}/{shard['tar']}") as data, tarfile.open(fileobj=data, mode="r|") as archive:
            described = io.TextIOWrapper(io.BufferedReader(lines), encoding="utf-8")
            for member in archive:
                line = json.loads(next(described))
                if line["audio_filepath"] != member.name:
                    raise ValueError(f"{shard['tar']} and its lines differ at {member.name}")
                yield shard["split"], member.name, line["text"], line["duration"], archive.extractfile(member).read()


class Shards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parley_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(dict(self.options), overwrite)


def write_shards(clips: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, mode: str = "append") -> None:
    """Clips (split, audio_filepath, text, duration, content) as tar files of about ``shard_bytes``, sorted by name within a shard."""
    clips.sparkSession.dataSource.register(Shards)
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    placed = clips.select(*cols).repartitionByRange("split", "audio_filepath").sortWithinPartitions("split", "audio_filepath")
    placed.write.format("parley_shards").option("shardbytes", str(shard_bytes)).mode(mode).save(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The clips of all published shards; a task reads one shard as a stream."""
    spark.dataSource.register(Shards)
    return spark.read.format("parley_shards").load(path)


def clip_summary(clips: DataFrame) -> DataFrame:
    """split, utterances and hours of clips."""
    return clips.groupBy("split").agg(F.count("*").alias("utterances"), (F.sum("duration") / 3600).alias("hours"))
