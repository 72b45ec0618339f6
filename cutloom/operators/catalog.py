"""Optional models: what a device can run, what is missing, what a feature needs, and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom import dims
from cutloom.functions.scalars import clamp, round_half_up
from cutloom.operators.grid import div


def can_run(min_ram: Column, ram: Column, abis: Column) -> Column:
    return F.array_contains(abis, "arm64-v8a") & (ram >= min_ram)


def runnable(devices: DataFrame, models: DataFrame) -> DataFrame:
    """device_id, id of every model a device can run. The catalog is fixed and small, so it is broadcast."""
    return devices.join(F.broadcast(models), can_run(F.col("min_ram_mb"), F.col("ram_mb"), F.col("abis"))).select("device_id", "id", "feature", "pos")


def available_features(devices: DataFrame, models: DataFrame) -> DataFrame:
    return runnable(devices, models).select("device_id", "feature").distinct()


def essentials(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(dims.ESSENTIALS)), "essential_pos int, id string")


def missing_essentials(devices: DataFrame, models: DataFrame, installed: DataFrame, wanted: DataFrame) -> DataFrame:
    """device_id, id, essential_pos: offered models that the device can run and has not installed."""
    offered = runnable(devices, models.where("downloadable")).join(wanted, "id")
    return offered.join(installed, ["device_id", "id"], "left_anti").select("device_id", "id", "essential_pos")


def unlocked_features(models: DataFrame, installed: DataFrame) -> DataFrame:
    return installed.join(models.select("id", "feature"), "id").select("device_id", "feature").distinct()


def recommended(models: DataFrame) -> DataFrame:
    """feature, id: the flagged model of a feature, else its first."""
    w = Window.partitionBy("feature").orderBy(F.desc("recommended"), "pos")
    return models.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select("feature", "id")


def resolve_speech_model(choices: DataFrame, models: DataFrame, installed: DataFrame) -> DataFrame:
    """(device_id, pref) -> model_id: none for ``off``; an installed explicit choice; else the recommended one, else the last installed."""
    best = recommended(models).where("feature = 'AUTO_CAPTIONS'").select(F.col("id").alias("best"))
    have = installed.join(models.where("feature = 'AUTO_CAPTIONS'").select("id", "pos"), "id")
    per = have.crossJoin(F.broadcast(best)).groupBy("device_id").agg(F.collect_set("id").alias("ids"), F.max_by("id", "pos").alias("last"), F.max(F.when(F.col("id") == F.col("best"), F.col("id"))).alias("best"))
    met = choices.join(per, "device_id", "left")
    explicit = F.when(F.array_contains("ids", F.col("pref")), F.col("pref"))
    return met.select("device_id", "pref", F.when(F.col("pref") != "off", F.coalesce(explicit, "best", "last")).alias("model_id"))


def alignment_preset(path: Column) -> Column:
    """Alignment heads by file name; the first rule that holds, with an English form."""
    name = F.lower(path)
    # Rules in order, whether they have an English form.
    rules = [("large-v3-turbo", "LARGE_V3_TURBO", False), ("large-v3", "LARGE_V3", False), ("large-v2", "LARGE_V2", False), ("large", "LARGE_V1", False), ("medium", "MEDIUM", True), ("small", "SMALL", True), ("base", "BASE", True), ("tiny", "TINY", True)]
    expr = None
    for part, label, english in rules:
        value = F.when(F.contains(name, F.lit(".en")), label + "_EN").otherwise(label) if english else F.lit(label)
        expr = F.when(F.contains(name, F.lit(part)), value) if expr is None else expr.when(F.contains(name, F.lit(part)), value)
    return expr.otherwise("NONE")


def audio_context(samples: Column, rate: int = 16000) -> Column:
    """Encoder length for a recording, a multiple of 64 within 768..1500."""
    seconds = samples / F.lit(float(rate))
    return clamp(F.ceil((seconds / 30.0 * 1500.0 + 128.0) / 64.0) * 64, 768, 1500)


def wants_translation(language: Column, chunks: Column) -> Column:
    return (F.trim(language) != "") & ~F.lower(language).startswith("en") & (chunks > 0)


def pacing_ticks(max_ms: Column, avg_ms: Column) -> Column:
    return clamp(round_half_up((max_ms / 1000.0) / (avg_ms / 1000.0)), 4, 20)


def file_name(url: Column, ident: Column) -> Column:
    last = F.substring_index(url, "/", -1)
    return F.when(F.contains(last, F.lit(".")), last).otherwise(F.concat(ident, F.lit(".model")))


def clock_label(ms: Column) -> Column:
    """m:ss.d"""
    s = div(ms, 1000)
    return F.format_string("%d:%02d.%d", div(s, 60), s % 60, div(ms % 1000, 100))


def duration_label(ms: Column) -> Column:
    s = div(ms, 1000)
    return F.format_string("%d:%02d", div(s, 60), s % 60)


def bytes_label(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000_000, F.format_string("%.1f GB", n / 1e9))
        .when(n >= 1_000_000, F.format_string("%.0f MB", n / 1e6))
        .when(n <= 0, F.lit("—"))
        .otherwise(F.format_string("%.0f KB", n / 1e3))
    )


def short_name(name: Column) -> Column:
    return F.substring_index(name, " (", 1)


def row_label(ord_: Column, start: Column, end: Column) -> Column:
    return F.concat(F.format_string("%02d", ord_ + 1), F.lit("  "), clock_label(start), F.lit(" → "), clock_label(end), F.format_string("  %.1fs", (end - start) / 1000.0))


def device_summary(ram: Column, abis: Column) -> Column:
    return F.format_string("%d GB RAM · %s · %s", round_half_up(ram / 1024.0), F.get(abis, F.lit(0)), F.when(ram >= 8000, "flagship").otherwise("standard"))


def installed_models(files: DataFrame, models: DataFrame) -> DataFrame:
    """(path, length) of a folder's files -> id, bytes of those that the catalog knows by their name without extension."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return files.select(stem.alias("id"), F.col("length").alias("bytes")).join(models.select("id"), "id")
