"""Captions: chunks of words, wrapped lines, layout, subtitle files.

Where a chunk ends depends on the chunk so far, so chunks are a fold along a recording's words, whose state is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.functions.scalars import clamp, clock
from cutloom.operators.folds import scan
from cutloom.operators.transcript import ENDS_SENTENCE


def chunk_words(words: DataFrame, most_words: int = 4, most_chars: int = 24, most_ms: int = 1800, pause_ms: int = 350) -> DataFrame:
    """Words -> video_id, seq, chunk_idx, text, start_ms, end_ms: the chunk of each word, before a lone last word is merged."""

    def begin():
        number, n, chars, start, finish, closed = -1, 0, 0, 0, 0, False

        def step(size: int, start_ms: int, end_ms: int, closes: bool) -> int:
            nonlocal number, n, chars, start, finish, closed
            if number < 0 or closed or n >= most_words or chars + size > most_chars or start_ms - finish > pause_ms or end_ms - start > most_ms:
                number, n, chars, start = number + 1, 0, 0, start_ms
            n, chars, finish, closed = n + 1, chars + size + 1, end_ms, closes
            return number

        return step

    marked = words.select("video_id", "seq", "text", "start_ms", "end_ms", F.length("text").alias("_size"), F.col("text").rlike(ENDS_SENTENCE).alias("_closes"))
    numbered = scan(marked, ["seq"], ["_size", "start_ms", "end_ms", "_closes"], begin, "chunk_idx", "bigint")
    return numbered.select("video_id", "seq", "chunk_idx", "text", "start_ms", "end_ms")


def caption_chunks(words: DataFrame, **limits: int) -> DataFrame:
    """Words -> video_id, chunk_idx, start_ms, end_ms, text, n_words. A lone last word joins the chunk before unless a pause parts them."""
    pause = limits.get("pause_ms", 350)
    rows = chunk_words(words, **limits).select("video_id", "chunk_idx", F.struct("seq", "text", "start_ms", "end_ms").alias("w"))
    ends = rows.groupBy("video_id", "chunk_idx").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    by = Window.partitionBy("video_id").orderBy("chunk_idx")
    first, last = F.element_at("ws", 1), F.element_at("ws", -1)
    lone = F.lead("chunk_idx").over(by).isNull() & (F.size("ws") == 1) & (first["start_ms"] - F.lag(last["end_ms"]).over(by) <= pause)
    moved = ends.select("video_id", (F.col("chunk_idx") - F.when(lone, 1).otherwise(0)).alias("chunk_idx"), "ws")
    whole = moved.groupBy("video_id", "chunk_idx").agg(F.sort_array(F.flatten(F.collect_list("ws"))).alias("ws"))
    return whole.select("video_id", "chunk_idx", first["start_ms"].alias("start_ms"), last["end_ms"].alias("end_ms"), F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"), F.size("ws").cast("bigint").alias("n_words"))


def cue(index: Column | None, start: Column, end: Column, text: Column, separator: str) -> Column:
    head = [F.concat(index.cast("string"), F.lit("\n"))] if index is not None else []
    return F.concat(*head, clock(start, separator), F.lit(" --> "), clock(end, separator), F.lit("\n"), text, F.lit("\n\n"))


def subtitles(chunks: DataFrame, kind: str = "srt") -> DataFrame:
    """(video_id, chunk_idx, start_ms, end_ms, text) -> video_id, body of a SubRip or WebVTT file."""
    if kind not in ("srt", "vtt"):
        raise ValueError(kind)
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("chunk_idx")) if kind == "srt" else None
    line = cue(number, F.col("start_ms"), F.col("end_ms"), F.col("text"), "," if kind == "srt" else ".")
    got = chunks.select("video_id", "chunk_idx", line.alias("cue")).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "cue"))).alias("cs"))
    body = F.array_join(F.transform("cs", lambda c: c["cue"]), "")
    return got.select("video_id", (F.concat(F.lit("WEBVTT\n\n"), body) if kind == "vtt" else body).alias("body"))


def write_subtitles(files: DataFrame, path: str) -> None:
    """A text file per recording, in a folder of its own."""
    body = F.expr("substring(body, 1, length(body) - 1)")  # the writer ends the last line itself
    files.select("video_id", body.alias("value")).write.mode("overwrite").partitionBy("video_id").text(path)


def active_chunk(frames: DataFrame, chunks: DataFrame) -> DataFrame:
    """(video_id, t_ms) -> the first chunk on screen at each time, ends included; times without one go.

    A chunk covers few seconds, so it is expanded to the seconds it touches and met on (video, second).
    """
    second = lambda c: F.floor(F.col(c) / 1000)
    spread = chunks.withColumn("_s", F.explode(F.sequence(second("start_ms"), F.greatest(second("start_ms"), second("end_ms")))))
    met = frames.withColumn("_s", second("t_ms")).join(spread, ["video_id", "_s"]).where(F.col("t_ms").between(F.col("start_ms"), F.col("end_ms")))
    return met.groupBy("video_id", "t_ms").agg(F.min_by(F.struct("chunk_idx", "text"), "chunk_idx").alias("c")).select("video_id", "t_ms", "c.chunk_idx", "c.text")


def wrapped_lines(words: Column, width: float, per_char: float = 1.0, space: float = 1.0) -> Column:
    """Array of line numbers: greedy wrapping of words whose width is ``per_char`` a character."""
    state = F.struct(F.lit(0).alias("line"), F.lit(0.0).alias("w"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, word: Column) -> Column:
        size = F.length(word) * F.lit(per_char)
        joined = F.when(s["w"] == 0, size).otherwise(s["w"] + space + size)
        over = (F.size(s["out"]) > 0) & (s["w"] > 0) & (joined > width)
        line = s["line"] + F.when(over, 1).otherwise(0)
        return F.struct(line.alias("line"), F.when(over, size).otherwise(joined).alias("w"), F.concat(s["out"], F.array(line)).alias("out"))

    return F.aggregate(words, state, step, lambda s: s["out"])


def layout(width: Column, height: Column, lines: Column) -> dict[str, Column]:
    """Sizes of the caption on a frame: text, outline, widest line, line height, baselines."""
    size = clamp(F.least(width, height) * 0.062, F.lit(22.0), height * 0.09)
    bottom = height * 0.86
    return {"text_size": size, "stroke": size * 0.12, "max_width": width * 0.90, "line_height": size * 1.22, "bottom": bottom, "top": bottom - (lines - 1) * size * 1.22}
