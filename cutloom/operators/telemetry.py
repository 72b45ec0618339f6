"""Camera telemetry: motion energy of packets, and marks that operators set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def magnitudes(values: str, axes: str, scale: str) -> Column:
    """Array of vector lengths: every ``axes`` values are one sample, divided by ``scale``; what is left over is dropped."""
    n = F.floor(F.size(values) / F.col(axes)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.sqrt(F.aggregate(F.slice(F.col(values), k * F.col(axes) + 1, F.col(axes)), F.lit(0.0), lambda a, x: a + (x / F.col(scale)) * (x / F.col(scale)))))


def packet_energy(packets: DataFrame) -> DataFrame:
    """(video_id, packet, values, axes, scale) -> mean length per packet against the video's largest; empty packets are skipped."""
    found = packets.select("video_id", "packet", F.explode(magnitudes("values", "axes", "scale")).alias("m")).groupBy("video_id", "packet").agg(F.avg("m").alias("energy"))
    most = F.max("energy").over(Window.partitionBy("video_id"))
    return found.select("video_id", "packet", F.when(most > 0, F.col("energy") / most).otherwise(F.col("energy")).alias("energy"))
