"""Shots from cuts, and the units that shots are divided into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.functions.scalars import clamp, round_half_up
from cutloom.operators.grid import by_video, div, meet


def shots_from_cuts(cuts: DataFrame, videos: DataFrame, duration_ms: int) -> DataFrame:
    """(video_id, cut_ms) -> video_id, shot_index, start_ms, end_ms. Cuts outside the video are ignored."""
    ends = videos.select("video_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(duration_ms).cast("bigint"))).alias("ms"))
    inside = cuts.where((F.col("cut_ms") >= 1) & (F.col("cut_ms") < duration_ms)).select("video_id", F.col("cut_ms").cast("bigint").alias("ms"))
    bounds = ends.unionByName(inside).distinct()
    w = by_video("ms")
    shots = bounds.select("video_id", F.col("ms").alias("start_ms"), F.lead("ms").over(w).alias("end_ms"), (F.row_number().over(w) - 1).cast("bigint").alias("shot_index"))
    return shots.where("end_ms > start_ms").select("video_id", "shot_index", "start_ms", "end_ms")


def pieces(length: Column, target: Column, most: Column) -> Column:
    """How many pieces: near the target length, and none over the largest."""
    return F.greatest(F.lit(1), round_half_up(length / target), div(length, most + 1) + 1)


def cut_targets(shots: DataFrame, preset: dict) -> DataFrame:
    """Where long shots should be cut: video_id, shot_index, start_ms, end_ms, k, target_ms."""
    length = F.col("end_ms") - F.col("start_ms")
    n = pieces(length, F.lit(preset["avg_shot_ms"]), F.lit(preset["max_unit_ms"]))
    long = shots.withColumn("n", n).where((length > preset["max_unit_ms"]) & (F.col("n") > 1))
    long = long.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n") - 1)))
    return long.select("video_id", "shot_index", "start_ms", "end_ms", "k", (F.col("start_ms") + div(length * F.col("k"), F.col("n"))).alias("target_ms"))


def snap_to_trough(targets: DataFrame, loudness: DataFrame, window_ms: int, n: int, hz: int = 4) -> DataFrame:
    """Add cut_ms: the quietest step within the window, the first if several, the target without loudness.

    A video's targets and its curve meet as one row each, so both sides stay where shots and curves are partitioned by
    video already, and the steps of a target are looked up in place. A step that starts between samples covers two; its value is their mean.
    """
    step = max(1, 1000 // hz)
    others = [c for c in targets.columns if c != "video_id"]
    asked = targets.groupBy("video_id").agg(F.collect_list(F.struct(*others)).alias("targets"))
    curve = loudness.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("curve"))
    met = meet(asked, curve, "video_id", "left").withColumn("whole", F.size("curve") == n)
    # Samples lie at their places where none is missing, and are searched for where some are.
    at = lambda ms: clamp(div(ms * hz, 1000), 0, n - 1)
    value = lambda i: F.when(F.col("whole"), F.get("curve", i.cast("int"))["value"]).otherwise(F.get(F.filter("curve", lambda s: s["i"] == i), F.lit(0))["value"])
    mean = lambda a, b: F.coalesce((a + b) / 2, a, b)
    low = lambda t: F.greatest(t["start_ms"], t["target_ms"] - window_ms)
    high = lambda t: F.least(t["end_ms"], t["target_ms"] + window_ms)
    valued = lambda t: F.transform(F.sequence(low(t), high(t), F.lit(step).cast("bigint")), lambda x: F.struct(mean(value(at(x)), value(at(x + step - 1))).alias("v"), x.alias("t")))
    trough = lambda t: F.array_min(F.filter(valued(t), lambda s: s["v"].isNotNull()))["t"]
    found = F.transform("targets", lambda t: F.struct(*[t[c].alias(c) for c in others], F.coalesce(trough(t), t["target_ms"]).alias("cut_ms")))
    return met.select("video_id", F.inline(found)).select(*targets.columns, "cut_ms")


def snap_to_sentence(targets: DataFrame, ends: DataFrame, window_ms: int) -> DataFrame:
    """Add sentence_ms: the nearest sentence end within the window, the earlier on ties, else null.

    Times meet by stretches of the window's length, a target also by the stretches beside its own.
    """
    stretch = lambda c: F.floor(F.col(c) / max(window_ms, 1))
    around = F.explode(F.array(*[stretch("target_ms") + k for k in (-1, 0, 1)]))
    near = targets.withColumn("_at", around).join(ends.withColumn("_at", stretch("end_at")), ["video_id", "_at"]).where(F.abs(F.col("end_at") - F.col("target_ms")) <= window_ms)
    keys = ["video_id", "shot_index", "k"]
    best = near.groupBy(*keys).agg(F.min_by("end_at", F.struct(F.abs(F.col("end_at") - F.col("target_ms")), "end_at")).alias("sentence_ms"))
    return targets.join(best, keys, "left")


def off_words(cuts: DataFrame, words: DataFrame) -> DataFrame:
    """Move a cut inside a word (ends included; the first such word) to the nearer edge, the end on ties.

    A word lies over few seconds; cuts and words meet by the second.
    """
    keys = ["video_id", "shot_index", "k"]
    second = lambda c: F.floor(F.col(c) / 1000)
    w = words.where("end_ms >= start_ms").select("video_id", "seq", F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"), F.explode(F.sequence(second("start_ms"), second("end_ms"))).alias("_at"))
    hit = cuts.withColumn("_at", second("cut_ms")).join(w, ["video_id", "_at"]).where(F.col("cut_ms").between(F.col("w_start"), F.col("w_end")))
    edge = F.when(F.col("cut_ms") - F.col("w_start") < F.col("w_end") - F.col("cut_ms"), F.col("w_start")).otherwise(F.col("w_end"))
    first = hit.groupBy(*keys).agg(F.min_by(edge, "seq").alias("edge"))
    rest = [c for c in cuts.columns if c != "cut_ms"]
    return cuts.join(first, keys, "left").select(*rest, F.coalesce("edge", "cut_ms").alias("cut_ms"))


def clean_bounds(bounds: Column, least: int) -> Column:
    """Keep a bound that lies ``least`` after the last kept one; the last kept becomes the last bound."""
    first = F.array(F.element_at(bounds, 1))
    kept = F.aggregate(F.slice(bounds, 2, F.size(bounds)), first, lambda acc, x: F.when(x - F.element_at(acc, -1) >= least, F.concat(acc, F.array(x))).otherwise(acc))
    return F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.element_at(bounds, -1)))


def units(shots: DataFrame, cuts: DataFrame, preset: dict) -> DataFrame:
    """video_id, unit_seq, shot_index, src_in_ms, src_out_ms; shots with cuts are divided, short units dropped."""
    keys = ["video_id", "shot_index"]
    cut = cuts.groupBy(*keys).agg(F.sort_array(F.collect_list(clamp(F.col("cut_ms"), F.col("start_ms"), F.col("end_ms")))).alias("cuts"))
    bounds = F.concat(F.array("start_ms"), F.coalesce("cuts", F.array().cast("array<bigint>")), F.array("end_ms"))
    cleaned = meet(shots, cut, keys, "left").withColumn("b", F.when(F.col("cuts").isNull(), bounds).otherwise(clean_bounds(bounds, preset["min_unit_ms"])))
    spans = F.transform(F.sequence(F.lit(1), F.size("b") - 1), lambda j: F.struct(F.element_at("b", j).alias("src_in_ms"), F.element_at("b", j + 1).alias("src_out_ms")))
    out = cleaned.where(F.size("b") > 1).select(*keys, F.inline(spans)).where(F.col("src_out_ms") - F.col("src_in_ms") >= preset["min_unit_ms"])
    seq = F.row_number().over(Window.partitionBy("video_id").orderBy("shot_index", "src_in_ms")) - 1
    return out.select("video_id", seq.cast("bigint").alias("unit_seq"), "shot_index", "src_in_ms", "src_out_ms")


def segment(shots: DataFrame, loudness: DataFrame, preset: dict, n: int, words: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Units of a preset. With words, cuts prefer sentence ends and never fall inside a word."""
    window = min(preset["avg_shot_ms"] // 2, 800)
    cuts = snap_to_trough(cut_targets(shots, preset), loudness, window, n)
    if words is not None and ends is not None:
        cuts = snap_to_sentence(cuts, ends, window).withColumn("cut_ms", F.coalesce("sentence_ms", "cut_ms")).drop("sentence_ms")
        cuts = off_words(cuts, words)
    return units(shots, cuts, preset)
