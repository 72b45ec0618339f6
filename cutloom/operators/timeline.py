"""The output timeline: render plans of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Containers and their video formats.
CONTAINERS = {"MP4": "video/avc", "WEBM": "video/x-vnd.on2.vp9"}


def render_plan(edl: DataFrame, aspect: str, reframe: bool, captions: bool, container: str, music_ms: int) -> DataFrame:
    """Clips with their place in the output; looped music starts over every ``music_ms``."""
    w = Window.partitionBy("video_id").orderBy("ord")
    length = F.col("src_out_ms") - F.col("src_in_ms")
    start = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    effects = ",".join(name for name, on in (("reframe", reframe), ("crop", bool(aspect)), ("captions", captions)) if on)
    return edl.select(
        "video_id", "ord", "src_in_ms", "src_out_ms", start.alias("out_start_ms"), (start + length).alias("out_end_ms"),
        F.lit(effects).alias("effects"), F.lit(container).alias("container"), F.lit(CONTAINERS[container]).alias("video_mime"),
        F.pmod(start, F.lit(music_ms)).cast("bigint").alias("music_ms"),
    )
