"""Frame signals from pixels: rows (video_id, i, x, y, r, g, b) of small, already reduced frames.

``frame_samples`` is the production form, one Arrow pass over binary frames of a video that emits all
signals at once. The pixel forms are the same in plain expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value, each 0..255."""
    r, g, b = (c.cast("double") for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = top - low
    sector = F.when(top == r, (g - b) / delta % 6).when(top == g, (b - r) / delta + 2).otherwise((r - g) / delta + 4)
    hue = F.when(delta > 1e-6, F.lit(60.0) * sector).otherwise(F.lit(0.0))
    hue = F.when(hue < 0, hue + 360).otherwise(hue)
    return hue / 360 * 255, F.when(top > 0, delta / top * 255).otherwise(F.lit(0.0)), top


def colorfulness(pixels: DataFrame) -> DataFrame:
    rg = (F.col("r") - F.col("g")).cast("double")
    yb = F.lit(0.5) * (F.col("r") + F.col("g")) - F.col("b")
    value = F.sqrt(F.var_pop(rg) + F.var_pop(yb)) + F.lit(0.3) * F.sqrt(F.avg(rg) * F.avg(rg) + F.avg(yb) * F.avg(yb))
    return pixels.groupBy("video_id", "i").agg(value.alias("colorfulness"))


def sharpness(pixels: DataFrame) -> DataFrame:
    """Population variance of the four-neighbour Laplacian over inner pixels; 0 for frames under 3 pixels.

    Neighbours are windows along rows and columns, so no pixel is joined with itself.
    """
    from pyspark.sql import Window

    across = Window.partitionBy("video_id", "i", "y").orderBy("x")
    down = Window.partitionBy("video_id", "i", "x").orderBy("y")
    l = pixels.withColumn("l", luma(F.col("r"), F.col("g"), F.col("b")))  # noqa: E741
    around = F.lag("l").over(across) + F.lead("l").over(across) + F.lag("l").over(down) + F.lead("l").over(down)
    lap = l.withColumn("lap", 4 * F.col("l") - around)
    return lap.groupBy("video_id", "i").agg(F.coalesce(F.var_pop("lap"), F.lit(0.0)).alias("sharpness"))


def frame_diff(pixels: DataFrame) -> DataFrame:
    """content and motion against the frame before; the first frame has 0."""
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    p = pixels.select("video_id", "i", "x", "y", h.alias("h"), s.alias("s"), v.alias("v"), luma(F.col("r"), F.col("g"), F.col("b")).alias("l"))
    before = p.select("video_id", (F.col("i") + 1).alias("i"), "x", "y", *[F.col(c).alias(f"p{c}") for c in "hsvl"])
    both = p.join(before, ["video_id", "i", "x", "y"], "left")
    moved = {c: F.abs(F.col(c) - F.col(f"p{c}")) for c in "hsvl"}
    content = F.avg((moved["h"] + moved["s"] + moved["v"]) / 3)
    return both.groupBy("video_id", "i").agg(F.coalesce(content, F.lit(0.0)).alias("content"), F.coalesce(F.avg(moved["l"]) / 255, F.lit(0.0)).alias("motion"))


def _hsv_planes(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, g, b = (rgb[..., k].astype(np.float64) for k in range(3))
    top, low = rgb.max(-1).astype(np.float64), rgb.min(-1).astype(np.float64)
    delta = top - low
    safe = np.where(delta > 1e-6, delta, 1.0)
    hue = np.select([top == r, top == g], [np.fmod((g - b) / safe, 6.0), (b - r) / safe + 2.0], (r - g) / safe + 4.0) * 60.0
    hue = np.where(delta > 1e-6, np.where(hue < 0, hue + 360.0, hue), 0.0)
    return hue / 360 * 255, np.where(top > 0, delta / np.where(top > 0, top, 1.0) * 255, 0.0), top


def samples_of(frames: list[np.ndarray]) -> list[tuple[float, float, float, float]]:
    """content, motion, sharpness, colorfulness of each frame (height, width, 3) of a video, in order."""
    out, before = [], None
    for rgb in frames:
        planes = _hsv_planes(rgb)
        l = rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114  # noqa: E741
        content = motion = 0.0
        if before is not None:
            content = float(sum(np.abs(a - b).mean() for a, b in zip(planes, before[0], strict=True)) / 3)
            motion = float(np.abs(l - before[1]).mean() / 255)
        sharp = 0.0
        if min(l.shape) >= 3:
            sharp = float((4 * l[1:-1, 1:-1] - l[1:-1, :-2] - l[1:-1, 2:] - l[:-2, 1:-1] - l[2:, 1:-1]).var())
        rg = rgb[..., 0].astype(np.float64) - rgb[..., 1]
        yb = 0.5 * (rgb[..., 0].astype(np.float64) + rgb[..., 1]) - rgb[..., 2]
        out.append((content, motion, sharp, float(np.sqrt(rg.var() + yb.var()) + 0.3 * np.hypot(rg.mean(), yb.mean()))))
        before = (planes, l)
    return out


def frame_samples(frames: DataFrame) -> DataFrame:
    """(video_id, i, t_sec, width, height, rgb) -> video_id, i, t_sec and the four signals, in one pass per video."""

    def analyse(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        rows = table.to_pylist()
        found = samples_of([np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3) for r in rows])
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.table({"video_id": table["video_id"], "i": table["i"], "t_sec": table["t_sec"], **{n: pa.array(c, pa.float64()) for n, c in zip(("content", "motion", "sharpness", "colorfulness"), columns, strict=True)}})

    return frames.groupBy("video_id").applyInArrow(analyse, "video_id bigint, i bigint, t_sec double, content double, motion double, sharpness double, colorfulness double")
