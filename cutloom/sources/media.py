"""Sound from WAV files, frames from raw files, prompts from vector files.

``read_wav``, ``read_frames`` and ``read_vectors`` read through Spark's ``binaryFile``, so from any storage that the
executors reach, and give blocks of bounded size. The Python data sources beside them (``wav``, ``rgbframes``, ``vectors``)
seek in files instead of loading them and are for paths that every executor has mounted; a file is one partition there.
Frames are down-sampled while they are read, by the rule of ``operators.curves.sample_frames``, so that skipped frames never leave the reader.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FilePartition(InputPartition):
    def __init__(self, path: str, number: int):
        super().__init__(path)
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    pattern = "*"

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[FilePartition]:
        path = self.options["path"]
        files = sorted(glob.glob(os.path.join(path, self.pattern))) if os.path.isdir(path) else sorted(glob.glob(path))
        return [FilePartition(f, k) for k, f in enumerate(files)]


def wav_samples(data: bytes) -> tuple[int, list[int]]:
    """Rate and mono 16-bit samples of PCM data; channels are averaged, towards zero. (0, []) if it is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return 0, []
    at, rate, channels, bits = 12, 0, 1, 16
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
        elif kind == b"data":
            if bits != 16 or not channels:
                return 0, []
            x = np.frombuffer(data[at + 8 : at + 8 + size // (2 * channels) * 2 * channels], "<i2").astype(np.int64).reshape(-1, channels)
            total = x.sum(1)
            return rate, (np.sign(total) * (np.abs(total) // channels)).tolist()
        at += 8 + size + size % 2
    return 0, []


class WavReader(_Reader):
    pattern = "*.wav"

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            rate, samples = wav_samples(f.read())
        yield os.path.basename(partition.path), rate, samples


class WavSource(DataSource):
    """Files of a folder: file, sample_rate, samples. No or other sound gives no samples."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "file string, sample_rate int, samples array<bigint>"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def due_frames(times: list[int], step_ms: int) -> list[int]:
    """Places of the frames that a sampler of ``step_ms`` shows."""
    due, kept = 0, []
    for k, t in enumerate(times):
        if t >= due:
            kept.append(k)
            due = max(due + step_ms, t + 1)
    return kept


class FrameReader(_Reader):
    pattern = "*.rgb"

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        step = int(self.options.get("stepms", self.options.get("stepMs", "250")))
        with open(partition.path, "rb") as f:
            head = f.read(12)
            if len(head) < 12:
                return
            width, height, n = struct.unpack("<III", head)
            times = list(struct.unpack(f"<{n}q", f.read(8 * n)))
            size = width * height * 3
            for i, k in enumerate(due_frames(times, step)):
                f.seek(12 + 8 * n + k * size)
                rgb = f.read(size)
                if len(rgb) == size:
                    yield os.path.basename(partition.path), i, times[k], width, height, bytearray(rgb)


class FrameSource(DataSource):
    """Raw frames (width, height, count, times in ms, pixels): file, i, t_ms, width, height, rgb; option ``stepMs``."""

    @classmethod
    def name(cls) -> str:
        return "rgbframes"

    def schema(self) -> str:
        return "file string, i bigint, t_ms bigint, width int, height int, rgb binary"

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


class VectorReader(_Reader):
    def read(self, partition: FilePartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        n, dim = struct.unpack_from("<ii", data, 0)
        for k, row in enumerate(np.frombuffer(data, "<f4", n * dim, 8).reshape(n, dim)):
            yield k, row.astype(float).tolist()


class VectorSource(DataSource):
    """A vector file (count, dimension, floats): prompt, v."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "prompt bigint, v array<double>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options)


BLOCK_SAMPLES = 1 << 16


def _files(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _blocks(files: DataFrame, schema: str, kinds: list, scan) -> DataFrame:
    """``scan(file, content)`` gives rows; a few of them go out at a time."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
                held: list[tuple] = []
                for row in scan(file.as_py(), content.as_py() or b""):
                    held.append(row)
                    if len(held) == 16:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, schema)


def read_wav(spark: SparkSession, path: str, block: int = BLOCK_SAMPLES, pattern: str | None = "*.wav") -> DataFrame:
    """file, sample_rate, start, samples (16-bit, at most ``block`` from ``start`` on). No or other sound gives no rows."""

    def scan(file: str, content: bytes) -> Iterator[tuple]:
        rate, samples = wav_samples(content)
        for at in range(0, len(samples), block):
            yield file, rate, at, samples[at : at + block]

    return _blocks(_files(spark, path, pattern), "file string, sample_rate int, start bigint, samples array<smallint>", [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int16())], scan)


def read_frames(spark: SparkSession, path: str, step_ms: int = 250, pattern: str | None = "*.rgb") -> DataFrame:
    """file, i, t_ms, width, height, rgb of the frames that a sampler of ``step_ms`` shows; a cut-off frame ends its file."""

    def scan(file: str, content: bytes) -> Iterator[tuple]:
        if len(content) < 12:
            return
        width, height, n = struct.unpack_from("<III", content)
        if len(content) < 12 + 8 * n:
            return
        times, size = struct.unpack_from(f"<{n}q", content, 12), width * height * 3
        for i, k in enumerate(due_frames(list(times), step_ms)):
            rgb = content[12 + 8 * n + k * size : 12 + 8 * n + (k + 1) * size]
            if len(rgb) == size:
                yield file, i, times[k], width, height, rgb

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return _blocks(_files(spark, path, pattern), "file string, i bigint, t_ms bigint, width int, height int, rgb binary", kinds, scan)


def read_vectors(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """file, prompt (numbered in each file), v of vector files."""

    def scan(file: str, content: bytes) -> Iterator[tuple]:
        n, dim = struct.unpack_from("<ii", content, 0) if len(content) >= 8 else (0, 0)
        for k, row in enumerate(np.frombuffer(content, "<f4", n * dim, 8).reshape(n, dim)):
            yield file, k, row.astype(float).tolist()

    return _blocks(_files(spark, path, pattern), "file string, prompt bigint, v array<double>", [pa.string(), pa.int64(), pa.list_(pa.float64())], scan)


def write_vectors(path: str, vectors: np.ndarray) -> None:
    """The file that ``VectorSource`` reads; rows are scaled to length one."""
    v = np.asarray(vectors, np.float32)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)
    with open(path, "wb") as f:
        f.write(struct.pack("<ii", *v.shape) + v.astype("<f4").tobytes())


def strip_row_padding(plane: bytes, width: int, height: int, pixel: int, stride: int) -> bytes:
    """Rows of an image plane without what pads them to the stride."""
    return b"".join(plane[y * stride : y * stride + width * pixel] for y in range(height))


def rgb_of_argb(pixels: np.ndarray) -> bytes:
    """Interleaved bytes of packed colours."""
    p = np.asarray(pixels, np.int64)
    return np.stack([(p >> 16) & 255, (p >> 8) & 255, p & 255], -1).astype(np.uint8).tobytes()


def register(spark: SparkSession) -> None:
    for source in (WavSource, FrameSource, VectorSource):
        spark.dataSource.register(source)
