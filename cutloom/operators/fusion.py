"""The chain that fuses raw signals into the engine's channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.operators.stats import normalize


def fuse(raw: DataFrame) -> DataFrame:
    """(video_id, i, motion, sharpness, colorfulness and, where scorers ran, clip_quality,
    clip_aesthetic, clip_interest, nima, face) -> video_id, i, action, aesthetic, interest.

    Scorers' columns are used where they exist: CLIP before NIMA. Action is the motion as it is.
    """
    have = set(raw.columns)
    fitted = normalize(raw, ["video_id"], ["sharpness", "colorfulness"])
    aesthetic = F.lit(0.5) * F.col("sharpness") + F.lit(0.5) * F.col("colorfulness")
    if "clip_quality" in have:
        aesthetic = F.lit(0.7) * (F.lit(0.6) * F.col("clip_quality") + F.lit(0.4) * F.col("clip_aesthetic")) + F.lit(0.3) * aesthetic
    elif "nima" in have:
        aesthetic = F.lit(0.5) * aesthetic + F.lit(0.5) * F.col("nima")
    out = fitted.withColumn("aesthetic", aesthetic).withColumnRenamed("motion", "action")
    out = normalize(out.withColumn("interest", F.lit(0.5) * F.col("action") + F.lit(0.5) * F.col("aesthetic")), ["video_id"], ["interest"])
    for name, old in (("clip_interest", 0.6), ("face", 0.5)):
        if name in have:
            out = normalize(out.withColumn("interest", F.lit(old) * F.col("interest") + F.lit(1 - old) * F.col(name)), ["video_id"], ["interest"])
    return out.select("video_id", "i", "action", "aesthetic", "interest")
