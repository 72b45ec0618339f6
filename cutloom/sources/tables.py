"""The scans as SQL: table functions and scalar functions of a session.

``register(spark)`` makes them known. The table functions take one value per call and go with LATERAL:
``SELECT f.path, n.* FROM files f, LATERAL gpmf_nodes(f.content) n``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from cutloom.sources.binary import boxes, klv

# Fixed value: the line of a SubRip or WebVTT cue that has its times.
CUE_TIMES = re.compile(r"^(\d+):(\d\d):(\d\d)[,.](\d{3}) --> (\d+):(\d\d):(\d\d)[,.](\d{3})")


def srt_cues(body: str) -> Iterator[tuple[int, int, int, str]]:
    """(cue from 0, start_ms, end_ms, text) of a subtitle file of either kind; what has no times is skipped."""
    number, times, text = 0, None, []
    for line in [*body.splitlines(), ""]:
        found = CUE_TIMES.match(line)
        if found:
            h0, m0, s0, f0, h1, m1, s1, f1 = map(int, found.groups())
            times, text = (((h0 * 60 + m0) * 60 + s0) * 1000 + f0, ((h1 * 60 + m1) * 60 + s1) * 1000 + f1), []
        elif line.strip() and times:
            text.append(line)
        elif times:
            yield number, *times, "\n".join(text)
            number, times = number + 1, None


@udtf(returnType="node bigint, path string, type string, struct_size bigint, repeat bigint, data_offset bigint")
class GpmfNodes:
    """The records of a telemetry payload, in the order of the scan."""

    def eval(self, content: bytes):
        for k, row in enumerate(klv(bytes(content or b""))):
            yield k, *row


@udtf(returnType="type string, header_size bigint, start bigint, end bigint")
class Mp4Boxes:
    """The top-level boxes of a media file."""

    def eval(self, content: bytes):
        yield from boxes(bytes(content or b""))


@udtf(returnType="cue bigint, start_ms bigint, end_ms bigint, text string")
class SrtLines:
    """The cues of a subtitle file."""

    def eval(self, body: str):
        yield from srt_cues(body or "")


#: Scalar functions in SQL: name and parameters, type, expression.
SCALARS = [
    ("clamped(x DOUBLE, low DOUBLE, high DOUBLE)", "DOUBLE", "least(greatest(x, low), high)"),
    ("robust(x DOUBLE, low DOUBLE, high DOUBLE)", "DOUBLE", "CASE WHEN high <= low THEN 0.5D ELSE least(greatest((x - low) / (high - low), 0D), 1D) END"),
    ("length_preference(ms DOUBLE, mean DOUBLE, deviation DOUBLE)", "DOUBLE", "exp(-((ms - mean) * (ms - mean)) / (2 * deviation * deviation))"),
    ("timecode(ms BIGINT, point STRING)", "STRING", "format_string('%02d:%02d:%02d%s%03d', ms div 3600000, ms div 60000 % 60, ms div 1000 % 60, point, ms % 1000)"),
]


def register(spark: SparkSession) -> None:
    for name, function in (("gpmf_nodes", GpmfNodes), ("mp4_boxes", Mp4Boxes), ("srt_lines", SrtLines)):
        spark.udtf.register(name, function)
    for signature, kind, expression in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {expression}")
