"""Features and scores of units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.dims import SIGNALS
from cutloom.functions.scalars import clamp, composite, gaussian
from cutloom.operators.grid import div, meet
from cutloom.operators.stats import floor_rank, normalize

PEAKS = ["action", "laughter", "drama", "interest"]
MEANS = ["speech", "aesthetic"]
RELATIVE = ["action", "speech", "laughter", "drama", "aesthetic", "interest"]


def unit_samples(units: DataFrame, n: int, hz: int = 4) -> DataFrame:
    """A row per unit and sample in [index of the start, index of the last millisecond]."""
    at = lambda ms: clamp(div(ms * hz, 1000), 0, n - 1)
    return units.withColumn("i", F.explode(F.sequence(at(F.col("src_in_ms")), at(F.col("src_out_ms") - 1))))


def raw_features(units: DataFrame, shots: DataFrame, signals: DataFrame, preset: dict, n: int) -> DataFrame:
    """Peaks are 90th percentiles, the others means; a unit's length preference is that of its whole shot.

    Units cover a video about once, so the rows that meet the samples are about as many as those.
    """
    keys = ["video_id", "unit_seq", "shot_index", "src_in_ms", "src_out_ms"]
    met = meet(unit_samples(units, n), signals, ["video_id", "i"])
    found = met.groupBy(*keys).agg(*[floor_rank(s, 0.9).alias(s) for s in PEAKS], *[F.avg(s).alias(s) for s in MEANS])
    lengths = shots.select("video_id", "shot_index", gaussian(F.col("end_ms") - F.col("start_ms"), F.lit(preset["avg_shot_ms"]), F.lit(preset["sigma_ms"])).alias("scene_length"))
    return meet(found, lengths, ["video_id", "shot_index"]).select(*keys, *SIGNALS)


def score(raw: DataFrame, preset: dict) -> DataFrame:
    """Relative features brought to 0..1 among the video's units, and the composite score."""
    fitted = normalize(raw, ["video_id"], RELATIVE)
    total = sum(preset[f"w_{s}"] for s in SIGNALS)
    if total <= 0:
        raise ValueError("weights must sum to more than 0")
    weights = [F.lit(preset[f"w_{s}"] / total) for s in SIGNALS]
    return fitted.withColumn("score", composite([F.col(s) for s in SIGNALS], weights))
