"""Binary scans: telemetry records (key, length, value) and ISO media boxes, as Arrow table functions.

Rows come from ``binaryFile`` or any table with bytes; one row's bytes are scanned at a time, and what
comes out is flat: trees are given by paths. Truncated or malformed data ends a scan without error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

HEADER = 8
SCALE_TYPES = {"s": ">h", "S": ">h", "l": ">i", "L": ">i"}


def klv(data: bytes, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, str, int, int, int]]:
    """(path, type, element size, repeat, offset) of each record, parents first. Type 0 holds records, to any depth.

    A record that does not fit ends the scan of those that hold it up to the level where it does not matter.
    """
    levels = [(start, len(data) if end is None else end, path)]
    while levels:
        start, end, path = levels.pop()
        if start + HEADER > end:
            continue
        key, kind, size, repeat = struct.unpack_from(">4scBH", data, start)
        at, length = start + HEADER, size * repeat
        if at + length > end:
            continue
        here = f"{path}/{key.decode('ascii', 'replace')}"
        yield here, kind.decode("latin-1"), size, repeat, at
        levels.append((at + (length + 3) // 4 * 4, end, path))
        if kind == b"\0" and length:
            levels.append((at, at + length, here))


def int16s(data: bytes, at: int, length: int) -> list[int]:
    return list(struct.unpack_from(f">{length // 2}h", data, at))


def int32s(data: bytes, at: int, length: int) -> list[int]:
    return list(struct.unpack_from(f">{length // 4}i", data, at))


def accelerations(data: bytes) -> list[tuple[list[int], int, float]]:
    """(values, axes, scale) of the first acceleration record of every stream; a missing or zero scale is 1."""
    records = list(klv(data))
    found = []
    for k, (path, *_rest) in enumerate(records):
        if not path.endswith("/STRM"):
            continue
        inside = []
        for r in records[k + 1 :]:
            if not r[0].startswith(path + "/"):
                break
            inside.append(r)
        accl = next((r for r in inside if r[0].endswith("/ACCL")), None)
        if accl is None:
            continue
        scale = 1.0
        scal = next((r for r in inside if r[0].endswith("/SCAL")), None)
        if scal and scal[1] in SCALE_TYPES and scal[2] * scal[3] >= struct.calcsize(SCALE_TYPES[scal[1]]):
            scale = float(struct.unpack_from(SCALE_TYPES[scal[1]], data, scal[4])[0]) or 1.0
        found.append((int16s(data, accl[4], accl[2] * accl[3]), accl[2] // 2 if accl[2] else 3, scale))
    return found


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int, int]]:
    """(type, header size, start, end) of the boxes directly within a range; 32-bit, 64-bit and open-ended sizes."""
    end = len(data) if end is None else end
    while start + HEADER <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        header = HEADER
        if size == 1:
            if start + 16 > end:
                return
            header, size = 16, struct.unpack_from(">Q", data, start + 8)[0]
        stop = end if size == 0 else start + size
        if stop <= start or stop > end:
            return
        yield kind.decode("ascii", "replace"), header, start, stop
        start = stop


def find_box(data: bytes, path: str) -> tuple[int, int] | None:
    """Range of the payload of the first box along a path like ``moov/udta/HMMT``."""
    low, high = 0, len(data)
    for part in path.split("/"):
        hit = next((b for b in boxes(data, low, high) if b[0] == part), None)
        if hit is None:
            return None
        low, high = hit[2] + hit[1], hit[3]
    return low, high


def marks(data: bytes, path: str = "moov/udta/HMMT") -> list[int]:
    """Operator marks in milliseconds, ascending: a count, which the payload bounds, and that many times; zeros are none."""
    found = find_box(data, path)
    if found is None or found[1] - found[0] < 4:
        return []
    at, end = found
    declared = struct.unpack_from(">I", data, at)[0]
    n = min(declared, (end - at - 4) // 4)
    return sorted(t for t in struct.unpack_from(f">{n}I", data, at + 4) if t)


def _table_function(rows: DataFrame, names: list[str], schema: str, scan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for k, data in enumerate(batch.column("bytes").to_pylist()):
                for row in scan(data or b""):
                    of.append(k)
                    out.append(row)
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            values = [pa.array(c, t) for c, t in zip(columns, _types(schema), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("video_id").take(pa.array(of, pa.int32())), *values], names=["video_id", *names])

    kind = rows.schema["video_id"].dataType.simpleString()
    return rows.select("video_id", "bytes").mapInArrow(run, f"video_id {kind}, {schema}")


def _types(schema: str) -> list:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}
    return [kinds[c.split(" ", 1)[1]] for c in schema.split(", ")]


def klv_nodes(rows: DataFrame) -> DataFrame:
    """video_id, node (place in the scan), path, type, struct_size, repeat, data_offset."""

    def scan(data: bytes):
        return ((k, *r) for k, r in enumerate(klv(data)))

    return _table_function(rows, ["node", "path", "type", "struct_size", "repeat", "data_offset"], "node bigint, path string, type string, struct_size bigint, repeat bigint, data_offset bigint", scan)


def box_rows(rows: DataFrame) -> DataFrame:
    """video_id, type, header_size, start, end of the top-level boxes."""
    return _table_function(rows, ["type", "header_size", "start", "end"], "type string, header_size bigint, start bigint, end bigint", boxes)


def highlight_marks(rows: DataFrame) -> DataFrame:
    """video_id, mark_ms."""

    def scan(data: bytes):
        return ((m,) for m in marks(data))

    return _table_function(rows, ["mark_ms"], "mark_ms bigint", scan)


def acceleration_rows(rows: DataFrame) -> DataFrame:
    """video_id, stream, values, axes, scale of each acceleration stream."""

    def scan(data: bytes):
        return ((k, values, axes, scale) for k, (values, axes, scale) in enumerate(accelerations(data)))

    return _table_function(rows, ["stream", "values", "axes", "scale"], "stream bigint, values array<bigint>, axes bigint, scale double", scan)
