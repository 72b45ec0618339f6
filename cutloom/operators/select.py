"""Greedy choice of units under a duration budget, and the order of what was chosen.

The choice is sequential within a video, so it is one Arrow group function per video; the penalty
of each candidate is kept up to date, which makes a pick cost one pass over the candidates. Videos
are independent, and a group is bounded by a video's units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.dims import SIGNALS

BUCKETS = 8
#: Digits to which rates are compared, so that the order of additions decides no tie.
RATE_DIGITS = 9


def greedy(start: np.ndarray, end: np.ndarray, shot: np.ndarray, x: np.ndarray, score: np.ndarray, preset: dict, total_ms: int, free: np.ndarray) -> list[int]:
    """Rows in order of choice, among those that are ``free``; ties go to the earlier row."""
    length = end - start
    seconds = np.maximum(length / 1000.0, 0.001)
    bucket = np.clip((start + end) // 2 * BUCKETS // max(total_ms, 1), 0, BUCKETS - 1)
    norm = np.sqrt((x * x).sum(1))
    penalty = np.zeros(len(score))
    covered = np.zeros(BUCKETS, bool)
    left, used, picks = free.copy(), 0, []
    while left.any():
        fits = left & ((used + length <= preset["max_ms"]) | (not picks))
        if not fits.any():
            break
        new = 0.0 if total_ms <= 0 else np.where(covered[bucket], 0.0, 1.0 / BUCKETS)
        gain = score - preset["diversity"] * penalty + preset["coverage"] * new
        rate = np.where(fits, np.round(gain / seconds, RATE_DIGITS), -np.inf)
        best = int(rate.argmax())
        if used >= preset["min_ms"] and gain[best] < preset["quality_floor"]:
            break
        picks.append(best)
        used += int(length[best])
        left[best] = False
        covered[bucket[best]] = True
        both = norm * norm[best]
        cos = np.where(both > 0, np.clip((x @ x[best]) / np.where(both > 0, both, 1.0), 0.0, 1.0), 0.0)
        penalty += np.clip(0.6 * cos + 0.4 * (shot == shot[best]), 0.0, 1.0)
        if used >= preset["max_ms"]:
            break
    return picks


def choose(scored: DataFrame, preset: dict, total_ms: int, variants: int = 1) -> DataFrame:
    """scored units -> the chosen ones, with variant and pick_order. Later variants use what earlier ones left."""
    kept = ["video_id", "unit_seq", "shot_index", "src_in_ms", "src_out_ms", *SIGNALS, "score"]
    rows = scored.select(*kept)
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema], "variant bigint", "pick_order bigint"])

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit_seq")
        column = lambda c: table.column(c).to_numpy()
        x = np.stack([column(s) for s in SIGNALS], 1)
        free = np.ones(table.num_rows, bool)
        rows, variant, order = [], [], []
        for v in range(variants):
            picks = greedy(column("src_in_ms"), column("src_out_ms"), column("shot_index"), x, column("score"), preset, total_ms, free) if free.any() else []
            if not picks:
                break
            free[picks] = False
            rows += picks
            variant += [v] * len(picks)
            order += range(len(picks))
        chosen = table.take(pa.array(rows, pa.int64()))
        return chosen.append_column("variant", pa.array(variant, pa.int64())).append_column("pick_order", pa.array(order, pa.int64()))

    return rows.groupBy("video_id").applyInArrow(pick, schema)


def order_key(ordering: str) -> list[Column]:
    """Sort keys of an ordering within (video, variant)."""
    if ordering == "CHRONOLOGICAL":
        return [F.col("src_in_ms"), F.col("pick_order")]
    if ordering == "BUILD_TO_CLIMAX":
        return [(F.col("action") + F.col("drama") + F.col("interest")) / 3, F.col("pick_order")]
    if ordering == "HOOK_FIRST":
        group = Window.partitionBy("video_id", "variant")
        hook = F.max_by("pick_order", F.struct(F.round("score", RATE_DIGITS), -F.col("pick_order"))).over(group)
        return [F.col("pick_order") != hook, F.col("src_in_ms"), F.col("pick_order")]
    raise ValueError(ordering)


def arrange(chosen: DataFrame, ordering: str, transition: str) -> DataFrame:
    """video_id, variant, ord, src_in_ms, src_out_ms, transition; the first entry is a hard cut."""
    keys = order_key(ordering)
    named = chosen.select("*", *[k.alias(f"_key{j}") for j, k in enumerate(keys)])
    w = Window.partitionBy("video_id", "variant").orderBy(*[f"_key{j}" for j in range(len(keys))])
    ranked = named.withColumn("ord", (F.row_number().over(w) - 1).cast("bigint"))
    return ranked.select("video_id", "variant", "ord", "src_in_ms", "src_out_ms", F.when(F.col("ord") == 0, "HARD_CUT").otherwise(transition).alias("transition"))


def delete_entry(edl: DataFrame, at: int) -> DataFrame:
    """The list without entry ``at``, renumbered."""
    return _renumber(edl.where(F.col("ord") != at), F.col("ord"))


def move_entry(edl: DataFrame, source: int, target: int) -> DataFrame:
    """The list with entry ``source`` moved to ``target``, renumbered; entries that don't exist change nothing."""
    size = F.count(F.lit(1)).over(Window.partitionBy("video_id"))
    valid = (F.lit(source) < size) & (F.lit(target) < size) & F.lit(source >= 0 and target >= 0)
    o = F.col("ord")
    place = F.when(o == source, F.lit(target)).when(F.lit(source < target) & (o > source) & (o <= target), o - 1).when(F.lit(source > target) & (o >= target) & (o < source), o + 1).otherwise(o)
    moved = edl.withColumn("place", F.when(valid, place).otherwise(o))
    return _renumber(moved, F.col("place")).drop("place")


def _renumber(edl: DataFrame, key: Column) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("_at")
    return edl.withColumn("_at", key).withColumn("ord", (F.row_number().over(w) - 1).cast("bigint")).drop("_at")
