"""Recordings as rows: WAV files whole, in chunks of a scan, or in wanted windows.

Chunks and windows are byte ranges: a task reads the header and its own samples, never a whole recording. PCM of 8, 16, 24 and
32 bits and 32-bit floats are read; channels are averaged, other rates interpolated. Compressed formats need a decoder.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parley.functions.audio import RATE, wav
from parley.sources.shards import file_system
from parley.sources.transcripts import manifest_items

CHUNK_SECONDS = 30.0
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass
class Layout:
    """Where a WAV file's samples lie. A frame is one sample of each channel."""

    kind: int
    channels: int
    rate: int
    bits: int
    first: int
    frames: int

    @property
    def width(self) -> int:
        return self.channels * self.bits // 8

    def length(self, rate: int) -> int:
        """Samples at another rate."""
        return self.frames if rate == self.rate else int(self.frames * rate / self.rate)


def layout(file, size: int) -> Layout:
    """A WAV file's layout, from its chunk headers."""
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", (body := file.read(min(length, 40)))[:16])
            form = (struct.unpack("<H", body[24:26])[0] if kind == EXTENSIBLE else kind), channels, rate, bits
        elif name == b"data":
            if form is None or (form[0], form[3]) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32)}:
                raise ValueError("only PCM and 32-bit float WAV files can be read")
            # Recorders that were cut off leave a length of 0 or of more than there is.
            length = size - at - 8 if length == 0 else min(length, size - at - 8)
            found = Layout(*form, at + 8, 0)
            found.frames = length // found.width
            if not found.frames:
                raise ValueError("a recording has no samples")
            return found
        at += 8 + length + length % 2
    raise ValueError("a WAV file without samples")


def samples(file, form: Layout, begin: int, end: int) -> np.ndarray:
    """Frames ``begin`` to ``end`` as one channel of doubles."""
    file.seek(form.first + begin * form.width)
    data = file.read((end - begin) * form.width)
    if form.kind == FLOAT:
        flat = np.frombuffer(data, "<f4").astype(np.float64)
    elif form.bits == 8:
        flat = (np.frombuffer(data, np.uint8) - 128.0) / 128
    elif form.bits == 24:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = ((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) ^ 0x800000) - 0x800000
        flat = flat / float(1 << 23)
    else:
        flat = np.frombuffer(data, f"<i{form.bits // 8}") / float(1 << form.bits - 1)
    return flat.reshape(-1, form.channels).mean(axis=1)


def window(file, form: Layout, first: int, last: int, rate: int) -> bytes:
    """Samples ``first`` to ``last`` at ``rate`` as floats: the same as those of the whole recording, from their bytes alone."""
    if form.rate == rate:
        return samples(file, form, first, last).astype("<f4").tobytes()
    at = np.arange(first, last) * form.rate / rate
    begin = int(at[0]) if len(at) else 0
    end = min(form.frames, int(at[-1]) + 2 if len(at) else 0)
    return np.interp(at, np.arange(begin, end), samples(file, form, begin, end)).astype("<f4").tobytes() if len(at) else b""


def _decode(data: bytes, rate: int) -> bytes:
    file = io.BytesIO(data)
    form = layout(file, len(data))
    return window(file, form, 0, form.length(rate), rate)


def read_wav(spark: SparkSession, path: str, rate: int = RATE) -> DataFrame:
    """path and ``pcm`` (floats at ``rate``, one channel) of every WAV file, each whole in one row."""

    def run(data: pd.Series) -> pd.Series:
        return pd.Series([_decode(x, rate) for x in data], dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", F.pandas_udf(run, "binary")("content").alias("pcm"))


@dataclass
class ChunkPartition(InputPartition):
    path: str
    first: int
    last: int


class ChunkReader(DataSourceReader):
    """Plans ``task`` chunks of ``chunk`` samples a partition, from the files' headers."""

    def __init__(self, options: dict):
        self.path, self.rate = options["path"], int(options.get("rate", RATE))
        self.chunk = max(1, round(float(options.get("chunkseconds", CHUNK_SECONDS)) * self.rate))
        self.task = int(options.get("chunksperpartition", 40))

    def _files(self) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = file_system(self.path)
        here = store.get_file_info(root)
        found = [here] if here.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        for info in sorted((i for i in found if i.type == fs.FileType.File and i.path.lower().endswith(".wav")), key=lambda i: i.path):
            yield store, info

    def partitions(self) -> list[ChunkPartition]:
        out = []
        for store, info in self._files():
            with store.open_input_file(info.path) as file:
                length = layout(file, info.size).length(self.rate)
            step = self.chunk * self.task
            out += [ChunkPartition(info.path, at, min(length, at + step)) for at in range(0, length, step)]
        return out

    def read(self, partition: ChunkPartition) -> Iterator[tuple]:
        if partition is None:  # no files
            return
        store, _ = file_system(self.path)
        with store.open_input_file(partition.path) as file:
            form = layout(file, file.size())
            for at in range(partition.first, partition.last, self.chunk):
                last = min(partition.last, at + self.chunk)
                yield partition.path, at // self.chunk, at / self.rate, last / self.rate, window(file, form, at, last, self.rate)


class WavChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parley_wav_chunks"

    def schema(self) -> str:
        return "path string, chunk_no long, start double, end double, pcm binary"

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(dict(self.options))


def read_chunks(spark: SparkSession, path: str, seconds: float = CHUNK_SECONDS, rate: int = RATE) -> DataFrame:
    """path, chunk_no, start, end and ``pcm`` of all WAV files at or below ``path``, in chunks: one long recording is read by many tasks."""
    spark.dataSource.register(WavChunks)
    return spark.read.format("parley_wav_chunks").option("rate", str(rate)).option("chunkseconds", str(seconds)).load(path)


def cut_windows(windows: DataFrame, rate: int = RATE) -> DataFrame:
    """``windows`` (path, source_start, source_end) with ``source_duration`` and ``pcm``, the samples between.

    Borders are rounded to samples. A window after the end of its recording is an error. A task reads one window at a time.
    """
    from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

    out = StructType([*windows.schema.fields, StructField("source_duration", DoubleType()), StructField("pcm", BinaryType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                path, start, end = (row.column(c)[0].as_py() for c in ("path", "source_start", "source_end"))
                store, name = file_system(path)
                with store.open_input_file(name) as file:
                    form = layout(file, file.size())
                    length, first, last = form.length(rate), round(start * rate), round(end * rate)
                    if last > length:
                        raise ValueError(f"{path} is too short for a window up to {end} s")
                    pcm = window(file, form, first, last, rate)
                made = [pa.array([length / rate], pa.float64()), pa.array([pcm], pa.binary())]
                yield pa.RecordBatch.from_arrays([*row.columns, *made], [*row.schema.names, "source_duration", "pcm"])

    return windows.mapInArrow(run, out)


def prepare_items(windows: DataFrame, total: float = 600.0, rate: int = RATE) -> tuple[DataFrame, DataFrame]:
    """(items of a benchmark manifest, their audio as id and WAV ``content``) from windows (id, path, source_start, source_end)."""
    cut = cut_windows(windows.withColumn("source_name", F.element_at(F.split("path", "/"), -1)), rate)
    return manifest_items(cut, total), cut.select("id", wav(F.col("pcm"), rate).alias("content"))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes ``content`` of rows (name, content) to ``folder``/name and returns name, ``path`` and ``size``; nothing happens before an action.

    A file appears at once and whole; a task that runs again writes the same.
    """

    def run(batches):
        import uuid

        import pyarrow as pa

        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), []
            for name, content in zip(names, batch.column("content"), strict=True):
                data, new = content.as_py(), f"{root}/{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(new) as file:
                    file.write(data)
                store.move(new, f"{root}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f"{root}/{n}" for n in names], pa.string()), pa.array(sizes, pa.int64())], ["name", "path", "size"])

    return files.select("name", "content").mapInArrow(run, "name string, path string, size long")
