"""Queries of transcripts, captions, prompts and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom import dims
from cutloom.operators import captions as C
from cutloom.operators import shots as H
from cutloom.operators import transcript as T
from cutloom.plans import base as B
from cutloom.registry import query


def words_sql(source: str = "documents") -> str:
    ident, tab = ("doc_id", "documents") if source == "documents" else ("conv_id * 1000 + turn", "conversations")
    return f"""tok AS (SELECT video_id, unnest(ws) AS text, unnest(range(len(ws))) AS seq FROM (SELECT {ident} AS video_id, list_filter(regexp_split_to_array(text, '[ \\n]'), lambda t: t <> '') AS ws FROM {tab})),
wrd AS (SELECT video_id, seq, text, seq * 350 + coalesce(sum(CASE WHEN regexp_matches(text, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 400 AS start_ms FROM tok),
wds AS (SELECT *, start_ms + 300 AS end_ms FROM wrd)"""


ENDS = """nxt AS (SELECT *, lead(start_ms) OVER (PARTITION BY video_id ORDER BY seq) AS following FROM wds),
ens AS (SELECT DISTINCT video_id, end_ms AS end_at FROM nxt WHERE regexp_matches(text, '[.!?]\\s*$') OR coalesce(following - end_ms > 400, FALSE))"""


@query(f"WITH {words_sql()} SELECT video_id, seq, text, start_ms, end_ms FROM wds")
def words_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.words(spark, sf_dir)


@query(f"WITH {words_sql()}, {ENDS} SELECT video_id, end_at FROM ens")
def sentence_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sentence_ends(B.words(spark, sf_dir))


@query(f"WITH {words_sql()}, {ENDS} SELECT video_id, end_ms AS from_ms, following AS to_ms FROM nxt WHERE following - end_ms > 400")
def silence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.silence_gaps(B.words(spark, sf_dir), 400)


@query(f"WITH {words_sql()} SELECT video_id, start_ms, end_ms FROM wds WHERE trim(trim(lower(text)), '.,!?;:\"''') IN ('um', 'uh', 'umm', 'uhh', 'er', 'ah', 'hmm', 'mhm', 'like', 'uhm')")
def filler_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.filler_intervals(B.words(spark, sf_dir))


CANDIDATES = """flg AS (SELECT w.*, CASE WHEN e.end_at IS NULL THEN 0 ELSE 1 END AS e FROM wds w LEFT JOIN ens e ON e.video_id = w.video_id AND e.end_at = w.end_ms),
grp AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY video_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS idx FROM flg),
can AS (SELECT video_id, idx, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, string_agg(text, ' ' ORDER BY seq) AS text, count(*) AS n_words FROM grp GROUP BY ALL)"""


@query(f"WITH {words_sql()}, {ENDS}, {CANDIDATES} SELECT video_id, idx, start_ms, end_ms, text, n_words FROM can")
def sentence_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sentence_candidates(B.words(spark, sf_dir))


@query(f"""WITH {words_sql('conversations')}, {ENDS}, {CANDIDATES}, l AS (SELECT video_id, string_agg('[' || idx || '] ' || left(text, 160) || chr(10), '' ORDER BY idx) AS b FROM can WHERE idx < 12 GROUP BY 1)
SELECT video_id, '{T.HOOK_HEAD}' || b || '{T.HOOK_TAIL}' AS prompt FROM l""")
def hook_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.hook_prompt(T.sentence_candidates(B.words(spark, sf_dir, source="conversations")))


@query(f"SELECT conv_id, turn, '{T.TITLE_HEAD}' || left(text, 4000) || '{T.TITLE_TAIL}' AS prompt FROM conversations")
def title_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.title_prompt(F.col("text")).alias("prompt"))


# SQL literals of the white space and the line ends of replies.
_WHITE = "'" + T.WHITE + "'"
_LINES = "string_split_regex({x}, '" + T.LINE_END + "')"
_MARKS = "'" + T.TITLE_MARKS.replace("'", "''") + "'"
_TITLE = f"list_filter(list_transform({_LINES.format(x='reply')}, lambda x: trim(trim(regexp_replace(trim(x, {_WHITE}), '^Title:', ''), {_WHITE}), {_MARKS})), lambda x: trim(x, {_WHITE}) <> '')"


@query(f"""WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN chr(10) || ' Title: "' || text || '"' WHEN 1 THEN '## ' || text
  ELSE chr(13) || chr(10) || chr(9) || 'Title: ' || left(text, 30) || chr(9) || chr(13) || chr(10) || 'second' END AS reply FROM conversations) SELECT conv_id, turn, coalesce(left({_TITLE}[1], 80), '') AS title FROM r""")
def title_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with their label after a line end of either kind, blanks and tabs around it, or marks in front."""
    turn = F.col("turn") % 3
    reply = F.when(turn == 0, F.concat(F.lit('\n Title: "'), "text", F.lit('"'))).when(turn == 1, F.concat(F.lit("## "), "text"))
    reply = reply.otherwise(F.concat(F.lit("\r\n\tTitle: "), F.substring("text", 1, 30), F.lit("\t\r\nsecond")))
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.parse_title(reply).alias("title"))


REPLIES = """rep AS (SELECT conv_id * 1000 + turn AS video_id, 'Here are picks:' || chr(13) || chr(10) || (conv_id % 7) || ' | ' || left(text, 20) || chr(9) || chr(13) || chr(10) || chr(9) || '[' || turn || ']: quote' || chr(10) || (conv_id % 7) || ' - again' || chr(13) || '99999999999 | far' || chr(10) || 'none' AS reply FROM conversations)"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") % 7).cast("string")
    reply = F.concat(F.lit("Here are picks:\r\n"), k, F.lit(" | "), F.substring("text", 1, 20), F.lit("\t\r\n\t["), F.col("turn").cast("string"), F.lit("]: quote\n"), k, F.lit(" - again\r99999999999 | far\nnone"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("video_id"), reply.alias("reply"))


HOOKS = f"""{REPLIES}, lin AS (SELECT video_id, trim(unnest(ls), {_WHITE}) AS row, unnest(range(len(ls))) AS line FROM (SELECT video_id, {_LINES.format(x='reply')} AS ls FROM rep)),
fnd AS (SELECT video_id, line, TRY_CAST(regexp_extract(row, '{T.HOOK}', 1) AS INTEGER) AS idx, trim(regexp_extract(row, '{T.HOOK}', 2), {_WHITE}) AS reason FROM lin WHERE regexp_matches(row, '{T.HOOK}')),
hks AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY line) - 1 AS pos, idx::BIGINT AS idx, reason FROM (SELECT *, row_number() OVER (PARTITION BY video_id, idx ORDER BY line) AS rn FROM fnd WHERE idx IS NOT NULL) WHERE rn = 1)"""


@query(f"WITH {HOOKS} SELECT video_id, pos, idx, reason FROM hks")
def hook_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.parse_hooks(_replies(spark, sf_dir))


@query(f"WITH {words_sql('conversations')}, {ENDS}, {CANDIDATES}, {HOOKS} SELECT h.video_id, h.pos, h.idx, h.reason, c.start_ms, c.end_ms FROM hks h JOIN can c ON c.video_id = h.video_id AND c.idx = h.idx AND c.idx < 12")
def hook_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies meet their candidates; an index nobody offered is dropped."""
    c = T.sentence_candidates(B.words(spark, sf_dir, source="conversations")).where("idx < 12")
    return T.parse_hooks(_replies(spark, sf_dir)).join(c, ["video_id", "idx"]).select("video_id", "pos", "idx", "reason", "start_ms", "end_ms")


CHUNKS = """arr AS (SELECT video_id, list({'t': text, 's': start_ms, 'e': end_ms} ORDER BY seq) AS ws FROM wds GROUP BY 1),
fld AS (SELECT video_id, ws, list_reduce(list_transform(ws, lambda w: {'id': -1, 'n': 0, 'c': 0, 's': w.s, 'e': w.e, 'z': FALSE, 'l': len(w.t), 'd': regexp_matches(w.t, '[.!?]\\s*$'), 'o': CAST([] AS INTEGER[])}),
  lambda a, w: CASE WHEN a.id < 0 OR w.s - a.e > 350 OR a.n >= 4 OR a.c + w.l > 24 OR w.e - a.s > 1800 OR a.z
    THEN {'id': a.id + 1, 'n': 1, 'c': CAST(w.l + 1 AS INTEGER), 's': w.s, 'e': w.e, 'z': w.d, 'l': w.l, 'd': w.d, 'o': list_append(a.o, a.id + 1)}
    ELSE {'id': a.id, 'n': a.n + 1, 'c': CAST(a.c + w.l + 1 AS INTEGER), 's': a.s, 'e': w.e, 'z': w.d, 'l': w.l, 'd': w.d, 'o': list_append(a.o, a.id)} END,
  {'id': -1, 'n': 0, 'c': 0, 's': 0::BIGINT, 'e': 0::BIGINT, 'z': FALSE, 'l': 0::BIGINT, 'd': FALSE, 'o': CAST([] AS INTEGER[])}).o AS ids FROM arr),
rws AS (SELECT video_id, unnest(ids)::BIGINT AS cid, unnest(ws) AS w, unnest(range(len(ws))) AS sq FROM fld),
cks AS (SELECT video_id, cid, count(*) AS n, arg_min(w.s, sq) AS s, arg_max(w.e, sq) AS e FROM rws GROUP BY ALL),
mvd AS (SELECT video_id, cid, CASE WHEN lead(cid) OVER w IS NULL AND n = 1 AND s - lag(e) OVER w <= 350 THEN cid - 1 ELSE cid END AS to_id FROM cks WINDOW w AS (PARTITION BY video_id ORDER BY cid)),
chk AS (SELECT r.video_id, m.to_id AS chunk_idx, arg_min(w.s, sq) AS start_ms, arg_max(w.e, sq) AS end_ms, string_agg(w.t, ' ' ORDER BY sq) AS text, count(*) AS n_words FROM rws r JOIN mvd m ON m.video_id = r.video_id AND m.cid = r.cid GROUP BY ALL)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.caption_chunks(B.words(spark, sf_dir, source="conversations"))


@query(f"WITH {words_sql('conversations')}, {CHUNKS} SELECT video_id, chunk_idx, start_ms, end_ms, text, n_words FROM chk")
def caption_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


CLOCK = "printf('%02d:%02d:%02d{s}%03d', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} % 1000)"


@query(f"WITH {words_sql('conversations')}, {CHUNKS}, c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY chunk_idx) AS k FROM chk) SELECT video_id, string_agg(k || chr(10) || {CLOCK.format(s=',', t='start_ms')} || ' --> ' || {CLOCK.format(s=',', t='end_ms')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY k) AS body FROM c GROUP BY 1")
def subtitles_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.subtitles(_chunks(spark, sf_dir), "srt")


@query(f"WITH {words_sql('conversations')}, {CHUNKS} SELECT video_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({CLOCK.format(s='.', t='start_ms')} || ' --> ' || {CLOCK.format(s='.', t='end_ms')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY chunk_idx) AS body FROM chk GROUP BY 1")
def subtitles_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.subtitles(_chunks(spark, sf_dir), "vtt")


@query(f"""WITH {words_sql('conversations')}, {CHUNKS}, f AS (SELECT video_id, unnest(range(0, most + 1, 250)) AS t_ms FROM (SELECT video_id, max(end_ms) AS most FROM chk GROUP BY 1))
SELECT video_id, t_ms, chunk_idx, text FROM (SELECT f.video_id, f.t_ms, c.chunk_idx, c.text, row_number() OVER (PARTITION BY f.video_id, f.t_ms ORDER BY c.chunk_idx) AS rn FROM f JOIN chk c ON c.video_id = f.video_id AND f.t_ms BETWEEN c.start_ms AND c.end_ms) WHERE rn = 1""")
def active_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caption at every quarter second up to the end of the video's last one."""
    chunks = _chunks(spark, sf_dir)
    times = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("most"), F.lit(250).cast("bigint")))
    frames = chunks.groupBy("video_id").agg(F.max("end_ms").alias("most")).select("video_id", times.alias("t_ms"))
    return C.active_chunk(frames, chunks)


@query(f"""WITH {words_sql('conversations')}, a AS (SELECT video_id, list(text ORDER BY seq) AS ws FROM wds GROUP BY 1),
f AS (SELECT video_id, ws, list_reduce(list_transform(ws, lambda w: {{'l': 0, 'w': len(w)::DOUBLE, 'o': CAST([] AS INTEGER[])}}), lambda s, w: CASE WHEN len(s.o) > 0 AND s.w > 0 AND s.w + 1 + w.w > 20 THEN {{'l': s.l + 1, 'w': w.w, 'o': list_append(s.o, s.l + 1)}} ELSE {{'l': s.l, 'w': CASE WHEN s.w = 0 THEN w.w ELSE s.w + 1 + w.w END, 'o': list_append(s.o, s.l)}} END, {{'l': 0, 'w': 0.0::DOUBLE, 'o': CAST([] AS INTEGER[])}}).o AS ls FROM a),
r AS (SELECT video_id, unnest(ls)::BIGINT AS line, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM f) SELECT video_id, line, string_agg(w, ' ' ORDER BY k) AS text FROM r GROUP BY ALL""")
def word_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = B.words(spark, sf_dir, source="conversations").groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("ws"))
    texts = F.transform("ws", lambda x: x["text"])
    rows = w.select("video_id", F.posexplode(F.arrays_zip(C.wrapped_lines(texts, 20.0).alias("line"), texts.alias("text"))).alias("k", "z"))
    got = rows.groupBy("video_id", F.col("z.line").cast("bigint").alias("line")).agg(F.sort_array(F.collect_list(F.struct("k", "z.text"))).alias("ts"))
    return got.select("video_id", "line", F.array_join(F.transform("ts", lambda t: t["text"]), " ").alias("text"))


@query("""WITH p AS (SELECT p_partkey, p_size * 80 AS w, CAST(floor(p_retailprice) AS BIGINT) AS h FROM part), s AS (SELECT *, least(greatest(least(w, h) * 0.062::DOUBLE, 22.0::DOUBLE), h * 0.09::DOUBLE) AS z FROM p)
SELECT p_partkey, round(z, 4) AS text_size, round(z * 0.12::DOUBLE, 4) AS stroke, round(w * 0.9::DOUBLE, 4) AS max_width, round(z * 1.22::DOUBLE, 4) AS line_height, round(h * 0.86::DOUBLE, 4) AS bottom, round(h * 0.86::DOUBLE - 2 * z * 1.22::DOUBLE, 4) AS top FROM s""")
def caption_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 80).alias("w"), F.floor("p_retailprice").alias("h"))
    return p.select("p_partkey", *[F.round(c, 4).alias(n) for n, c in C.layout(F.col("w"), F.col("h"), F.lit(3)).items()])


SPANS = f"""spn AS (SELECT video_id, start_ms AS from_ms, end_ms AS to_ms, row_number() OVER (PARTITION BY video_id ORDER BY shot_index DESC) - 1 AS k, {B.DURATION * 16}::BIGINT AS n_samples FROM sht),
szd AS (SELECT *, greatest(least(to_ms * 16000 // 1000, n_samples) - least(from_ms * 16000 // 1000, n_samples), 0) AS n FROM spn),
plc AS (SELECT video_id, k, from_ms, n, coalesce(sum(n + 4800) OVER (PARTITION BY video_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM szd WHERE n >= 1600),
cat AS (SELECT video_id, k, a * 1000 // 16000 AS concat_start_ms, (a + n) * 1000 // 16000 AS concat_end_ms, from_ms AS src_start_ms FROM plc)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutloom.plans.editing import shots

    k = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("shot_index"))) - 1
    s = shots(spark, sf_dir).select("video_id", F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"), k.cast("bigint").alias("k"), F.lit(B.DURATION * 16).cast("bigint").alias("n_samples"))
    return T.concat_spans(s)


@query(f"WITH {B.POINTS}, {B.SHOTS_SQL}, {SPANS} SELECT video_id, k, concat_start_ms, concat_end_ms, src_start_ms FROM cat")
def concat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


@query(f"""WITH {B.POINTS}, {B.SHOTS_SQL}, {SPANS}, {words_sql()}, m AS (SELECT w.video_id, w.seq, w.text, w.start_ms - concat_start_ms + src_start_ms AS start_ms, w.end_ms - concat_start_ms + src_start_ms AS end_ms, row_number() OVER (PARTITION BY w.video_id, w.seq ORDER BY k) AS rn
FROM wds w JOIN cat c ON c.video_id = w.video_id AND w.start_ms BETWEEN concat_start_ms AND concat_end_ms) SELECT video_id, seq, text, start_ms, end_ms FROM m WHERE rn = 1""")
def words_to_source_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.to_source_time(B.words(spark, sf_dir), _spans(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id AS video_id, list_filter(regexp_split_to_array(text, '[ \\n]'), lambda t: t <> '') AS ws FROM documents), t AS (SELECT video_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM d),
p AS (SELECT video_id, k // 40 AS segment, k * 2 AS pos, ' ' || left(w, 2) AS token, CASE WHEN k % 3 = 0 THEN -1 ELSE k * 30 + 1 END AS dtw, k * 30 AS t0, k * 30 + 12 AS t1 FROM t UNION ALL SELECT video_id, k // 40, k * 2 + 1, substr(w, 3), -1, k * 30 + 12, k * 30 + 25 FROM t WHERE len(w) > 2)
SELECT video_id, word AS seq, text, start_ms, greatest(last_t1, start_ms) AS end_ms FROM (SELECT video_id, k + 1 AS word, string_agg(CASE WHEN token[1] = ' ' THEN substr(token, 2) ELSE token END, '' ORDER BY pos) AS text, arg_min(CASE WHEN dtw >= 0 THEN dtw ELSE t0 END * 10, pos) AS start_ms, arg_max(t1 * 10, pos) AS last_t1 FROM (SELECT *, pos // 2 AS k FROM p) GROUP BY ALL) WHERE text <> ''""")
def subword_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split("text", "[ \n]"), lambda t: t != "")
    t = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(parts).alias("k", "w")).withColumn("k", F.col("k").cast("bigint"))
    segment = F.floor(F.col("k") / 40)
    head = t.select("video_id", segment.alias("segment"), (F.col("k") * 2).alias("pos"), F.concat(F.lit(" "), F.substring("w", 1, 2)).alias("token"), F.when(F.col("k") % 3 == 0, F.lit(-1)).otherwise(F.col("k") * 30 + 1).alias("dtw"), (F.col("k") * 30).alias("t0"), (F.col("k") * 30 + 12).alias("t1"))
    tail = t.where(F.length("w") > 2).select("video_id", segment.alias("segment"), (F.col("k") * 2 + 1).alias("pos"), F.expr("substring(w, 3)").alias("token"), F.lit(-1).cast("bigint").alias("dtw"), (F.col("k") * 30 + 12).alias("t0"), (F.col("k") * 30 + 25).alias("t1"))
    return T.merge_subwords(head.unionByName(tail))


@query(f"""WITH r AS (SELECT doc_id AS video_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT video_id, unnest(ls) AS x, unnest(range(len(ls))) AS line FROM r),
t AS (SELECT video_id, line, trim(regexp_replace(x, '[\t\r]', ' ', 'g'), {_WHITE}) AS text, line * 1000 AS s, CASE WHEN line % 5 = 4 THEN line * 1000 - 1 ELSE line * 1000 + len(x) END AS e FROM l WHERE line % 7 <> 6)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY line) - 1 AS seq, text, s AS start_ms, e AS end_ms FROM t WHERE text <> '' AND e >= s""")
def words_parse_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents written as transcript lines with either line end, some of them malformed (a blank before a number too), and parsed again."""
    number = lambda k: F.when(k % 7 == 6, F.concat(F.lit(" "), (k * 1000).cast("string"))).otherwise((k * 1000).cast("string"))
    end = lambda x, k: F.when(k % 5 == 4, k * 1000 - 1).otherwise(k * 1000 + F.length(x)).cast("string")
    line = lambda x, k: F.concat(F.lit(" "), F.regexp_replace(x, "[\t\r]", " "), F.lit("\t"), number(k), F.lit("\t"), end(x, k), F.when(k % 2 == 0, F.lit("\r")).otherwise(F.lit("")))
    lines = F.transform(F.split("text", "\n", -1), line)
    raw = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.array_join(F.concat(F.array(F.lit("bad-line")), lines, F.array(F.lit("neg\t100\t50"), F.lit("a\tb\tc"))), "\n").alias("raw"))
    return T.parse_tsv(raw)


@query(f"WITH {B.POINTS},\n{B.GRID},\n{B.LOUD_SQL},\n{B.SHOTS_SQL},\n{words_sql()}, {ENDS},\n{B.units_sql(dims.preset('shortform'), words=True)} SELECT video_id, unit_seq, shot_index, src_in_ms, src_out_ms FROM uni")
def units_with_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose cuts prefer the ends of sentences and stay out of words; a document's words are spoken in the video of its number."""
    from cutloom.plans.editing import shots

    w = B.words(spark, sf_dir)
    return H.segment(shots(spark, sf_dir), B.loudness(spark, sf_dir), dims.preset("shortform"), B.N, w, T.sentence_ends(w))
