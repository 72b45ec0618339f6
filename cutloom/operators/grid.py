"""Channels on a uniform grid: rows (video_id, i, value). Everything is keyed by video_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.functions.scalars import clamp, lerp


def div(a: Column, b: Column | int) -> Column:
    """Whole-number division towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join of two sides that both grow with the recordings: never a broadcast.

    The planner takes exploded rows and gathered arrays for as small as the file they come from, and would send them through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def by_video(*order: str) -> Window:
    return Window.partitionBy("video_id").orderBy(*(order or ("i",)))


def grid(videos: DataFrame, n: int) -> DataFrame:
    """Every (video_id, i) for i in 0..n-1; nothing for n = 0."""
    return videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("i")) if n > 0 else videos.select("video_id", F.lit(0).cast("bigint").alias("i")).limit(0)


def bin_of(t_ms: Column, n: int, duration_ms: int) -> Column:
    return clamp(div(clamp(t_ms, 0, duration_ms - 1) * n, duration_ms), 0, n - 1)


def bin_max(points: DataFrame, n: int, duration_ms: int) -> DataFrame:
    """Largest value per bin of (video_id, t_ms, value), never below 0. Combines map-side."""
    return points.groupBy("video_id", bin_of(F.col("t_ms"), n, duration_ms).alias("i")).agg(F.greatest(F.max("value"), F.lit(0.0)).alias("value"))


def bin_max_wide(points: DataFrame, n: int, duration_ms: int, channels: dict[str, Column]) -> DataFrame:
    """Largest value per bin of several channels at once: one scan and one shuffle for all. A channel's value is null
    where a point does not belong to it."""
    return points.groupBy("video_id", bin_of(F.col("t_ms"), n, duration_ms).alias("i")).agg(*[F.greatest(F.max(c), F.lit(0.0)).alias(name) for name, c in channels.items()])


def to_length(channel: DataFrame, videos: DataFrame, n: int) -> DataFrame:
    """Exactly n samples: cut, or filled with zeros."""
    return meet(grid(videos, n), channel, ["video_id", "i"], "left").select("video_id", "i", F.coalesce("value", F.lit(0.0)).alias("value"))


def forward_fill(channel: DataFrame) -> DataFrame:
    """Values above 0 last until the next one; a true zero counts as missing; 0 before the first."""
    w = by_video().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.last(F.when(F.col("value") > 0, F.col("value")), ignorenulls=True).over(w)
    return channel.select("video_id", "i", F.coalesce(held, F.lit(0.0)).alias("value"))


def to_grid(points: DataFrame, videos: DataFrame, n: int, duration_ms: int) -> DataFrame:
    return forward_fill(to_length(bin_max(points, n, duration_ms), videos, n))


def resample_nearest(channel: DataFrame, videos: DataFrame, n: int) -> DataFrame:
    """Sample i takes source sample i * m div n; a video without samples gives zeros."""
    lengths = channel.groupBy("video_id").agg((F.max("i") + 1).alias("m"))
    at = grid(videos, n).join(lengths, "video_id", "left").select("video_id", F.col("i").alias("at"), clamp(div(F.col("i") * F.col("m"), n), 0, F.col("m") - 1).alias("i"))
    return at.join(channel, ["video_id", "i"], "left").select("video_id", F.col("at").alias("i"), F.coalesce("value", F.lit(0.0)).alias("value"))


def resample_linear(samples: DataFrame, from_rate: int, to_rate: int) -> DataFrame:
    """Whole-number samples at another rate, by linear interpolation, truncated."""
    lengths = samples.groupBy("video_id").agg((F.max("i") + 1).alias("m"))
    out = lengths.select("video_id", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), div(F.col("m") * to_rate, from_rate) - 1)).alias("at"))
    out = out.where("at >= 0").withColumn("pos", F.col("at") * F.lit(from_rate / to_rate))
    out = out.withColumn("i", F.least(F.floor("pos"), F.col("m") - 1)).withColumn("j", F.least(F.col("i") + 1, F.col("m") - 1))
    left = samples.select("video_id", "i", F.col("value").alias("a"))
    right = samples.select("video_id", F.col("i").alias("j"), F.col("value").alias("b"))
    both = out.join(left, ["video_id", "i"]).join(right, ["video_id", "j"])
    value = lerp(F.col("a").cast("double"), F.col("b").cast("double"), F.col("pos") - F.col("i"))
    return both.select("video_id", F.col("at").alias("i"), value.cast("bigint").alias("value"))


def highlight_curve(marks: DataFrame, videos: DataFrame, n: int, duration_ms: int, half_width_ms: int = 1500) -> DataFrame:
    """The larger of triangular kernels around marks (video_id, mark_ms)."""
    half = max(1, int(half_width_ms / (duration_ms / n)))
    centre = clamp(div(F.col("mark_ms") * n, duration_ms), 0, n - 1)
    bins = marks.select("video_id", centre.alias("c")).distinct().select("video_id", "c", F.explode(F.sequence(F.col("c") - half, F.col("c") + half)).alias("i"))
    fall = F.lit(1.0) - F.abs(F.col("i") - F.col("c")) / F.lit(float(half + 1))
    peaks = bins.where((F.col("i") >= 0) & (F.col("i") < n)).groupBy("video_id", "i").agg(F.max(fall).alias("value"))
    return to_length(peaks, videos, n)


def boost(base: DataFrame, add: DataFrame, weight: float) -> DataFrame:
    """base + weight * add in 0..1; a missing addend is 0."""
    both = meet(base, add.select("video_id", "i", F.col("value").alias("added")), ["video_id", "i"], "left")
    return both.select("video_id", "i", clamp(F.col("value") + F.lit(weight) * F.coalesce("added", F.lit(0.0)), 0.0, 1.0).alias("value"))


def zip_channels(videos: DataFrame, n: int, channels: dict[str, DataFrame]) -> DataFrame:
    """One wide row per (video_id, i); what a channel lacks is 0.

    Narrow rows are pivoted in one aggregation, so any number of channels costs one shuffle.
    """
    tagged = [c.select("video_id", "i", F.lit(name).alias("channel"), F.col("value").cast("double").alias("value")) for name, c in channels.items()]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    values = [F.max(F.when(F.col("channel") == name, F.col("value"))).alias(name) for name in channels]
    wide = rows.where(F.col("i") < n).groupBy("video_id", "i").agg(*values)
    return meet(grid(videos, n), wide, ["video_id", "i"], "left").select("video_id", "i", *[F.coalesce(name, F.lit(0.0)).alias(name) for name in channels])
