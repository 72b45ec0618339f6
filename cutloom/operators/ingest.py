"""What is derived from a recording's metadata before it is analysed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.functions.scalars import clamp, even, round_half_up
from cutloom.operators.grid import div

# Formats by name, dates' patterns, the default aspect.
CODECS = {"video/avc": "H264", "video/hevc": "HEVC", "video/av01": "AV1", "video/x-vnd.on2.vp9": "VP9", "video/x-vnd.on2.vp8": "VP8"}
DATE_PATTERNS = ["yyyyMMdd'T'HHmmss.SSS'Z'", "yyyyMMdd'T'HHmmss'Z'", "yyyy-MM-dd HH:mm:ss"]
DEFAULT_ASPECT = 9.0 / 16.0


def normalized_rotation(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360))


def oriented(width: Column, height: Column, rotation: Column) -> tuple[Column, Column, Column]:
    """Width, height and whether it is a portrait, as shown."""
    upright = rotation % 180 == 0
    w, h = F.when(upright, width).otherwise(height), F.when(upright, height).otherwise(width)
    return w, h, h > w


def frame_rate(track: Column, capture: Column) -> Column:
    return F.coalesce(track, capture, F.lit(30.0))


def codec_of(mime: Column) -> Column:
    expr = None
    for k, v in CODECS.items():
        expr = F.when(mime == k, v) if expr is None else expr.when(mime == k, v)
    return expr.otherwise("OTHER")


def bit_depth(profile: Column) -> Column:
    return F.when((profile == 2) | (profile >= 0x1000), 10).otherwise(8)


def parse_date(raw: Column) -> Column:
    """Milliseconds of the first pattern that fits, in UTC; null if none does."""
    times = [F.try_to_timestamp(raw, F.lit(p)) for p in DATE_PATTERNS]
    return F.unix_millis(F.coalesce(*times))


def first_video_track(tracks: DataFrame) -> DataFrame:
    """(video_id, idx, mime, fps) -> the first track that holds video; equal places go by their values."""
    return tracks.where(F.col("mime").startswith("video/")).groupBy("video_id").agg(F.min(F.struct("idx", "mime", "fps")).alias("t")).select("video_id", "t.*")


def risk(codec: Column, mime: Column, decodable: Column, depth: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """Level, number of reasons and whether the recording can be used."""
    unknown = (codec == "OTHER") | mime.isNull()
    deep, large = depth >= 10, F.greatest(width, height) > 4096
    level = F.when(unknown | ~decodable, "UNSUPPORTED").when(deep | large, "CAUTION").otherwise("OK")
    reasons = F.when(unknown, 1).otherwise((~decodable).cast("int") + deep.cast("int") + large.cast("int"))
    return level, reasons, level != "UNSUPPORTED"


def parse_aspect(spec: Column) -> Column:
    """w/h of a text ``w:h``; null unless it has two positive numbers."""
    parts = F.split(spec, ":", -1)
    number = lambda k: F.trim(F.get(parts, F.lit(k))).try_cast("double")
    return F.when((F.size(parts) == 2) & (number(0) > 0) & (number(1) > 0), F.try_divide(number(0), number(1)))


def proxy_spec(width: Column, height: Column, fps: Column, edge: int = 1280) -> tuple[Column, Column, Column]:
    """Size and bitrate of a small copy: never larger than the source, even sizes, bounded bitrate."""
    bad = (width <= 0) | (height <= 0)
    longest = F.greatest(width, height)
    scale = F.when(longest > edge, F.lit(float(edge)) / longest).otherwise(F.lit(1.0))
    w = even(round_half_up(width * scale).cast("int"))
    h = even(round_half_up(height * scale).cast("int"))
    rate = F.when(fps.between(1.0, 240.0), fps).otherwise(F.lit(30.0))
    bits = clamp((w.cast("bigint") * h * rate * 0.1).cast("bigint"), 1_500_000, 8_000_000)
    return F.when(bad, edge).otherwise(w), F.when(bad, edge * 9 // 16 // 2 * 2).otherwise(h), F.when(bad, 4_000_000).otherwise(bits)


def analysis_height(width: Column, height: Column, base: int = 160) -> Column:
    """Even height of a frame ``base`` wide; 16:9 where sizes are missing."""
    h = F.when((width > 0) & (height > 0), div(F.lit(base) * height, width)).otherwise(F.lit(base * 9 // 16))
    return F.greatest(h, F.lit(2)).cast("int").bitwiseAND(F.lit(~1))


def sampling_step(fps: Column) -> Column:
    """Whole milliseconds between frames; rates out of 1..240 count as 30."""
    return F.greatest(F.floor(F.lit(1000.0) / F.when(fps.between(1.0, 240.0), fps).otherwise(F.lit(30.0))), F.lit(1))


def preview_frame(frames: DataFrame) -> DataFrame:
    """(video_id, t_ms, duration_ms) -> the frame nearest to the middle, the earlier on ties."""
    off = F.abs(F.col("t_ms") - div(F.col("duration_ms"), 2))
    return frames.groupBy("video_id").agg(F.min_by("t_ms", F.struct(off, "t_ms")).alias("t_ms"))
