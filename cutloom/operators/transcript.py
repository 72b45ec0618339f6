"""Words: sentence ends, gaps, fillers, candidates, spans, sub-words, prompts and replies.

Words are rows (video_id, seq, text, start_ms, end_ms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.dims import FILLERS
from cutloom.operators.grid import div

ENDS_SENTENCE = r"[.!?]\s*$"
# What counts as white space around lines, and what ends a line.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|\r|\n"
# Fixed value: a selected line is a number, in brackets or not, a separator and a reason.
HOOK = r"^[\[(\s]*(\d+)[\s|:.)\]\-]+(.+)$"
TITLE_MARKS = "\"'*# "


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def _by_seq() -> Window:
    return Window.partitionBy("video_id").orderBy("seq")


def parse_tsv(raw: DataFrame) -> DataFrame:
    """(video_id, raw) lines ``text TAB start TAB end`` -> words; malformed lines are skipped, numbers among blanks are malformed."""
    lines = raw.select("video_id", F.posexplode(F.split("raw", LINE_END, -1)).alias("line", "row"))
    f = F.split("row", "\t", -1)
    number = lambda text: F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    parsed = lines.where(F.size(f) == 3).select("video_id", "line", trimmed(f[0]).alias("text"), number(f[1]).alias("start_ms"), number(f[2]).alias("end_ms"))
    good = parsed.where((F.col("text") != "") & (F.col("end_ms") >= F.col("start_ms")))
    seq = F.row_number().over(Window.partitionBy("video_id").orderBy("line")) - 1
    return good.select("video_id", seq.cast("bigint").alias("seq"), "text", "start_ms", "end_ms")


def sentence_ends(words: DataFrame, gap_ms: int = 400) -> DataFrame:
    """Distinct times (video_id, end_at) where a sentence ends: by its mark, or by a pause after the word."""
    pause = F.lead("start_ms").over(_by_seq()) - F.col("end_ms") > gap_ms
    marked = words.withColumn("_end", F.col("text").rlike(ENDS_SENTENCE) | F.coalesce(pause, F.lit(False)))
    return marked.where("_end").select("video_id", F.col("end_ms").alias("end_at")).distinct()


def silence_gaps(words: DataFrame, least_ms: int = 700) -> DataFrame:
    after = F.lead("start_ms").over(_by_seq())
    return words.select("video_id", F.col("end_ms").alias("from_ms"), after.alias("to_ms")).where(F.col("to_ms") - F.col("from_ms") > least_ms)


def normalized_token(text: Column) -> Column:
    return F.btrim(F.btrim(F.lower(text)), F.lit(".,!?;:\"'"))


def filler_intervals(words: DataFrame, fillers: list[str] | None = None) -> DataFrame:
    return words.where(normalized_token(F.col("text")).isin(fillers or FILLERS)).select("video_id", "start_ms", "end_ms")


def sentence_candidates(words: DataFrame) -> DataFrame:
    """video_id, idx, start_ms, end_ms, text: words up to and with each one that ends where a sentence does."""
    ends = sentence_ends(words).select("video_id", F.col("end_at").alias("end_ms"), F.lit(1).alias("_end"))
    flagged = words.join(ends, ["video_id", "end_ms"], "left")
    group = F.coalesce(F.sum("_end").over(_by_seq().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = flagged.select("video_id", group.cast("bigint").alias("idx"), F.struct("seq", "text", "start_ms", "end_ms").alias("w"))
    return joined_words(rows, ["video_id", "idx"])


def joined_words(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, w struct with seq) -> text joined in order, first start, last end, number of words."""
    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("w")).alias("ws"))
    return got.select(*keys, F.element_at("ws", 1)["start_ms"].alias("start_ms"), F.element_at("ws", -1)["end_ms"].alias("end_ms"), F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"), F.size("ws").cast("bigint").alias("n_words"))


def concat_spans(spans: DataFrame, rate: int = 16000, least: int = 1600, gap: int = 4800) -> DataFrame:
    """(video_id, k, from_ms, to_ms, n_samples) -> place of each long enough span in one recording with gaps between."""
    clamp = lambda ms: F.least(F.greatest(div(ms * rate, 1000), F.lit(0)), F.col("n_samples"))
    sized = spans.withColumn("_n", F.greatest(clamp(F.col("to_ms")) - clamp(F.col("from_ms")), F.lit(0))).where(F.col("_n") >= least)
    before = F.coalesce(F.sum(F.col("_n") + gap).over(Window.partitionBy("video_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("_at", before)
    return placed.select("video_id", "k", div(F.col("_at") * 1000, rate).alias("concat_start_ms"), div((F.col("_at") + F.col("_n")) * 1000, rate).alias("concat_end_ms"), F.col("from_ms").alias("src_start_ms"))


def to_source_time(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Words of the joined recording -> source time, by the first span that holds their start (ends included); others go.

    Spans follow each other in the joined recording, so both are sorted together once: the first span that holds a
    time is the one before it that begins last, or, where two touch there, the one that ends at it.
    """
    place = F.struct(F.col("concat_start_ms").alias("from_at"), F.col("concat_end_ms").alias("to_at"), F.col("src_start_ms").alias("source"))
    before = F.lag("span").over(Window.partitionBy("video_id").orderBy("concat_start_ms", "k"))
    marks = spans.withColumn("span", place).select("video_id", F.col("concat_start_ms").alias("at"), F.lit(0).alias("kind"), F.struct("span", before.alias("before")).alias("mark"))
    rows = words.select("video_id", F.col("start_ms").alias("at"), F.lit(1).alias("kind"), F.struct("seq", "text", "start_ms", "end_ms").alias("word"))
    both = marks.select("*", F.lit(None).cast(rows.schema["word"].dataType).alias("word")).unionByName(rows.select("*", F.lit(None).cast(marks.schema["mark"].dataType).alias("mark")))
    met = both.withColumn("mark", F.last("mark", True).over(Window.partitionBy("video_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))).where("kind = 1")
    span = F.when(F.col("at") <= F.col("mark.before.to_at"), F.col("mark.before")).when(F.col("at") <= F.col("mark.span.to_at"), F.col("mark.span"))
    held = met.withColumn("span", span).where("span IS NOT NULL").withColumn("shift", F.col("span.source") - F.col("span.from_at"))
    return held.select("video_id", "word.seq", "word.text", (F.col("word.start_ms") + F.col("shift")).alias("start_ms"), (F.col("word.end_ms") + F.col("shift")).alias("end_ms"))


def merge_subwords(tokens: DataFrame) -> DataFrame:
    """(video_id, segment, pos, token, dtw, t0, t1; times in hundredths) -> words.

    A leading space or a new segment starts a word; the aligned time is preferred to the plain one.
    """
    w = Window.partitionBy("video_id").orderBy("segment", "pos")
    starts = F.col("token").startswith(" ") | (F.coalesce(F.lag("segment").over(w), F.lit(-1)) != F.col("segment"))
    t = tokens.withColumn("_start", F.when(F.col("dtw") >= 0, F.col("dtw")).otherwise(F.col("t0")) * 10)
    t = t.withColumn("_word", F.sum(starts.cast("bigint")).over(w))
    text = F.when(F.col("token").startswith(" "), F.expr("substring(token, 2)")).otherwise(F.col("token"))
    got = t.select("video_id", "_word", F.struct("segment", "pos", text.alias("text"), "_start", (F.col("t1") * 10).alias("t1")).alias("p")).groupBy("video_id", "_word").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    start = F.element_at("ps", 1)["_start"]
    joined = got.select("video_id", F.col("_word").alias("seq"), F.array_join(F.transform("ps", lambda p: p["text"]), "").alias("text"), start.alias("start_ms"), F.greatest(F.element_at("ps", -1)["t1"], start).alias("end_ms"))
    return joined.where("text <> ''")


def parse_title(reply: Column, most: int = 80) -> Column:
    """The first line that is not blank without its label and marks."""
    clean = lambda line: F.btrim(trimmed(F.regexp_replace(trimmed(line), "^Title:", "")), F.lit(TITLE_MARKS))
    lines = F.filter(F.transform(F.split(reply, LINE_END, -1), clean), lambda x: trimmed(x) != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, most), F.lit(""))


def parse_hooks(replies: DataFrame) -> DataFrame:
    """(video_id, reply) -> video_id, pos, idx, reason; malformed lines are skipped, the first of an index stays."""
    lines = replies.select("video_id", F.posexplode(F.split("reply", LINE_END, -1)).alias("line", "row")).withColumn("row", trimmed(F.col("row")))
    found = lines.where(F.col("row").rlike(HOOK)).select("video_id", "line", F.regexp_extract("row", HOOK, 1).try_cast("int").alias("idx"), trimmed(F.regexp_extract("row", HOOK, 2)).alias("reason"))
    first = found.where("idx IS NOT NULL").withColumn("_nth", F.row_number().over(Window.partitionBy("video_id", "idx").orderBy("line"))).where("_nth = 1")
    pos = F.row_number().over(Window.partitionBy("video_id").orderBy("line")) - 1
    return first.select("video_id", pos.cast("bigint").alias("pos"), F.col("idx").cast("bigint").alias("idx"), "reason")


# The texts around the transcript and the candidates.
TITLE_HEAD = "You are a short-form video editor. Read the transcript and write ONE punchy title (max 8 words, no quotes, no emoji).\n\nTranscript:\n"
TITLE_TAIL = "\n\nTitle:"
HOOK_HEAD = "Pick the 1-3 most engaging moments (hook, punchline, quote, reaction) for a short clip.\nReply ONLY with lines formatted: <index> | <short reason>\n\nCandidates:\n"
HOOK_TAIL = "\nSelections:"


def title_prompt(transcript: Column) -> Column:
    return F.concat(F.lit(TITLE_HEAD), F.substring(transcript, 1, 4000), F.lit(TITLE_TAIL))


def hook_prompt(candidates: DataFrame, most: int = 12) -> DataFrame:
    """(video_id, idx, text) -> video_id, prompt over the first ``most`` candidates."""
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.substring("text", 1, 160), F.lit("\n"))
    got = candidates.where(F.col("idx") < most).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))).alias("ls"))
    return got.select("video_id", F.concat(F.lit(HOOK_HEAD), F.array_join(F.transform("ls", lambda x: x["line"]), ""), F.lit(HOOK_TAIL)).alias("prompt"))
