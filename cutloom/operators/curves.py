"""Curves of one value per sample: swell, smoothing, cut detection, down-sampling.

What looks at neighbours is a window function; what depends on the last hit is a fold along the video.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.operators.folds import scan
from cutloom.operators.grid import by_video, div
from cutloom.operators.stats import normalize


def swell(curve: DataFrame) -> DataFrame:
    """Rises from sample to sample, the first 0, brought to 0..1."""
    rise = F.greatest(F.lit(0.0), F.col("value") - F.lag("value").over(by_video()))
    return normalize(curve.select("video_id", "i", F.coalesce(rise, F.lit(0.0)).alias("value")), ["video_id"], ["value"])


def smooth3(curve: DataFrame) -> DataFrame:
    """Mean of three neighbours; the two ends, and curves shorter than three, stay."""
    w = by_video()
    mid = (F.lag("value").over(w) + F.col("value") + F.lead("value").over(w)) / 3
    return curve.select("video_id", "i", F.coalesce(mid, F.col("value")).alias("value"))


def adaptive_ratio(curve: DataFrame, reach: int = 2, cap: float = 4.0) -> DataFrame:
    """Add ratio: the value against the mean of its neighbours, sample 0 not counted; ``cap`` where that mean is 0."""
    w = by_video().rowsBetween(-reach, reach)
    counted = F.when(F.col("i") >= 1, F.col("value"))
    n = F.count(counted).over(w) - 1
    mean = F.when(n > 0, (F.sum(counted).over(w) - F.col("value")) / n).otherwise(F.lit(0.0))
    with_mean = curve.withColumn("_mean", mean).where("i >= 1")
    ratio = F.when(F.col("_mean") > 1e-6, F.col("value") / F.col("_mean")).when(F.col("value") > 0, F.lit(cap)).otherwise(F.lit(0.0))
    return with_mean.withColumn("ratio", ratio).drop("_mean")


def cut_hits(curve: DataFrame, ratio: float = 3.0, least: float = 15.0, fixed: float = 27.0) -> DataFrame:
    return adaptive_ratio(curve, cap=ratio + 1).where(((F.col("ratio") > ratio) & (F.col("value") > least)) | (F.col("value") > fixed))


def debounce(hits: DataFrame, gap: int) -> DataFrame:
    """Keep a hit (video_id, i) that is ``gap`` after the last kept."""

    def begin():
        kept = None

        def step(i: int) -> bool:
            nonlocal kept
            if kept is not None and i - kept < gap:
                return False
            kept = i
            return True

        return step

    return scan(hits.select("video_id", "i"), ["i"], ["i"], begin, "kept", "boolean").where("kept").select("video_id", "i")


def detect_cuts(curve: DataFrame, gap: int = 15) -> DataFrame:
    """video_id, i of the debounced cuts."""
    return debounce(cut_hits(curve), gap)


def rising_edges(curve: DataFrame, threshold: float = 0.5, window: int = 100) -> DataFrame:
    """Samples that cross the threshold upwards; every window starts anew, and sample 0 is none."""
    block = div(F.col("i"), window)
    before = F.lag("value").over(Window.partitionBy("video_id", "_block").orderBy("i"))
    marked = curve.withColumn("_block", block).withColumn("_before", before)
    return marked.where((F.col("value") > threshold) & (F.col("_before").isNull() | (F.col("_before") <= threshold)) & (F.col("i") > 0)).select("video_id", "i")


def sample_frames(frames: DataFrame, step_ms: int) -> DataFrame:
    """(video_id, pts_ms) -> the frames a step sampler shows: next is the later of last due + step and pts + 1."""

    def begin():
        due = 0

        def step(pts: int) -> bool:
            nonlocal due
            if pts < due:
                return False
            due = max(due + step_ms, pts + 1)
            return True

        return step

    shown = scan(frames.select("video_id", "pts_ms"), ["pts_ms"], ["pts_ms"], begin, "shown", "boolean").where("shown")
    i = F.row_number().over(Window.partitionBy("video_id").orderBy("pts_ms")) - 1
    return shown.select("video_id", i.cast("bigint").alias("i"), "pts_ms")
