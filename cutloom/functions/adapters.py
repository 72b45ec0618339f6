"""Scorers: what goes before and after a model, and a registry of injected ones.

Models themselves are not part of the engine. A scorer is a function from a pandas Series of inputs to
one of outputs; one that is not registered, or that fails to load, leaves the fallback.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.functions.scalars import clamp

_SCORERS: dict[str, Callable[[], Callable[[pd.Series], pd.Series]]] = {}

# Label sets of sound events; image statistics of the visual model; pair groups; scale of its logits.
LABELS = {
    "laughter": ["Laughter", "Baby laughter", "Giggle", "Snicker", "Belly laugh", "Chuckle, chortle"],
    "applause": ["Applause", "Cheering", "Crowd", "Clapping"],
    "music": ["Music"],
}
IMAGE_MEAN = (0.48145466, 0.4578275, 0.40821073)
IMAGE_STD = (0.26862954, 0.26130258, 0.27577711)
PAIR_GROUPS = {"quality": range(0, 4), "aesthetic": range(4, 7), "interest": range(7, 10)}
LOGIT_SCALE = 100.0


def register_scorer(name: str, load: Callable[[], Callable[[pd.Series], pd.Series]]) -> None:
    """``load`` runs once per batch stream on the executors and returns the scoring function."""
    _SCORERS[name] = load


def scorer(name: str, fallback: Column, value: Column, kind: str = "double") -> Column:
    """The registered scorer's output for ``value``; the fallback without one, or where it gives null."""
    if name not in _SCORERS:
        return fallback
    load = _SCORERS[name]

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            score = load()
        except Exception:  # a scorer that cannot be loaded is as good as none
            score = None
        for batch in batches:
            yield score(batch) if score else pd.Series([None] * len(batch), dtype="object")

    return F.coalesce(run(value), fallback)


def preprocess_image(rgb: np.ndarray) -> np.ndarray:
    """(height, width, 3) bytes -> (3, height, width) normalised floats."""
    x = (rgb.astype(np.float32) / 255.0 - np.array(IMAGE_MEAN, np.float32)) / np.array(IMAGE_STD, np.float32)
    return np.ascontiguousarray(x.transpose(2, 0, 1))


def windows_of(pcm: np.ndarray, size: int = 512, context: int = 64) -> np.ndarray:
    """Chunks with the end of the chunk before them as context; the last is filled with zeros."""
    n = -(-len(pcm) // size)
    x = np.zeros(n * size, np.float32)
    x[: len(pcm)] = pcm
    x = x.reshape(n, size)
    before = np.zeros((n, context), np.float32)
    before[1:] = x[:-1, -context:]
    return np.concatenate([before, x], 1)


def batches_of(frames: list, size: int = 100) -> list[list]:
    """Blocks of ``size`` frames; the last is filled up by repeating its last frame."""
    return [frames[a : a + size] + [frames[min(a + size, len(frames)) - 1]] * max(0, a + size - len(frames)) for a in range(0, len(frames), size)]


def l2_normalized(v: Column) -> Column:
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-6))
    return F.transform(v, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def mean_opinion(buckets: Column) -> Column:
    """Mean of a rating distribution over its number of buckets, in 0..1; 0 if empty."""
    total = F.aggregate(buckets, F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform(buckets, lambda x, k: (k + 1) * x), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(buckets) > 0, clamp(F.when(total > 0, weighted / total).otherwise(F.lit(0.0)) / F.size(buckets), 0.0, 1.0)).otherwise(F.lit(0.0))


def pair_scores(frames: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    """Probability of each positive prompt against its negative, as means of the pair groups.

    ``prompts`` (prompt, v) holds 20 rows by definition, so it is broadcast to the frames.
    """
    pair = F.floor(F.col("prompt") / 2)
    pairs = prompts.groupBy(pair.alias("pair")).agg(F.max(F.when(F.col("prompt") % 2 == 0, F.col("v"))).alias("pos"), F.max(F.when(F.col("prompt") % 2 == 1, F.col("v"))).alias("neg"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(dot(F.col("v"), F.col("neg")) * LOGIT_SCALE - dot(F.col("v"), F.col("pos")) * LOGIT_SCALE))
    each = frames.crossJoin(F.broadcast(pairs)).select(key, "pair", p.alias("p"))
    return each.groupBy(key).agg(*[F.avg(F.when(F.col("pair").isin(list(r)), F.col("p"))).alias(n) for n, r in PAIR_GROUPS.items()])


def label_maxima(scores: DataFrame, labels: dict[str, list[str]] | None = None) -> DataFrame:
    """(video_id, w, label, score) -> the largest score of each label set per window, case ignored."""
    sets = labels or LABELS
    name = F.lower("label")
    return scores.groupBy("video_id", "w").agg(*[F.coalesce(F.max(F.when(name.isin([x.lower() for x in of]), F.greatest(F.col("score"), F.lit(0.0)))), F.lit(0.0)).alias(n) for n, of in sets.items()])


def face_frames(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(video_id, k, left, top, right, bottom) -> score, centre and size of the dominant face, the first of the largest."""
    area = F.round((F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")), 6)
    box = boxes.groupBy("video_id").agg(F.max_by(F.struct("k", "left", "top", "right", "bottom"), F.struct(area, -F.col("k"))).alias("b")).select("video_id", "b.*")
    w, h = F.greatest(F.col("right") - F.col("left"), F.lit(0.0)), F.greatest(F.col("bottom") - F.col("top"), F.lit(0.0))
    cx, cy = (F.col("left") + F.col("right")) / 2 / width, (F.col("top") + F.col("bottom")) / 2 / height
    centred = clamp(1 - (F.abs(cx - 0.5) + F.abs(cy - 0.5)), 0.0, 1.0)
    score = clamp(F.lit(0.6) * clamp(F.sqrt(w * h / (width * height)), 0.0, 1.0) + F.lit(0.4) * centred, 0.0, 1.0)
    return box.select("video_id", "k", score.alias("score"), cx.alias("cx"), cy.alias("cy"), F.greatest(w / width, h / height).alias("size"))
