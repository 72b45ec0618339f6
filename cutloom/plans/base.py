"""How the test tables stand for recordings, in Spark and in SQL.

A video is a user of ``events``; its clock maps January 2024 to 259 200 ms; event types stand for
signal channels and purchases for cuts. Words come from ``documents`` and ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.operators import grid as G

DURATION = 259200
HZ = 4
N = DURATION * HZ // 1000
CHANNEL_EVENTS = {"action": "click", "aesthetic": "view", "interest": "purchase", "speech": "signup", "drama": "error"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, t_ms, event_id, event_type, value, k."""
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").alias("video_id"), G.div(micros, 10_000_000).alias("t_ms"), "event_id", "event_type", "value", k.alias("k"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct()


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, i, t_ms, event_type, value, k: a video's events in order."""
    p = points(spark, sf_dir)
    i = F.row_number().over(Window.partitionBy("video_id").orderBy("t_ms", "event_id")) - 1
    return p.select("video_id", i.cast("bigint").alias("i"), "t_ms", "event_type", "value", "k")


def channel(spark: SparkSession, sf_dir: str, event_type: str | None) -> DataFrame:
    """A channel on the grid: the largest value per bin of an event type (of all for None), held on."""
    p = points(spark, sf_dir)
    p = p if event_type is None else p.where(F.col("event_type") == event_type)
    return G.to_grid(p, videos(spark, sf_dir), N, DURATION)


def loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = channel(spark, sf_dir, None)
    most = F.max("value").over(Window.partitionBy("video_id"))
    return c.select("video_id", "i", F.when(most > 0, F.col("value") / most).otherwise(F.col("value")).alias("value"))


def _held(wide: DataFrame, names: list[str]) -> DataFrame:
    w = G.by_video().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = [F.coalesce(F.last(F.when(F.col(c) > 0, F.col(c)), ignorenulls=True).over(w), F.lit(0.0)).alias(c) for c in names]
    return wide.select("video_id", "i", *held)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, i and the six scored channels, those of events scaled by 490."""
    channels = {name: F.when(F.col("event_type") == kind, F.col("value") / 490) for name, kind in CHANNEL_EVENTS.items()} | {"laughter": F.col("k") / 100}
    binned = G.bin_max_wide(points(spark, sf_dir), N, DURATION, channels)
    return _held(G.meet(G.grid(videos(spark, sf_dir), N), binned, ["video_id", "i"], "left"), list(channels))


def zipped_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from channels that come apart, as scorers give them."""
    p = points(spark, sf_dir)
    apart = {name: G.bin_max(p.where(F.col("event_type") == kind).withColumn("value", F.col("value") / 490), N, DURATION) for name, kind in CHANNEL_EVENTS.items()}
    apart["laughter"] = G.bin_max(p.select("video_id", "t_ms", (F.col("k") / 100).alias("value")), N, DURATION)
    return _held(G.zip_channels(videos(spark, sf_dir), N, apart), list(apart))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("event_type = 'purchase'").select("video_id", F.col("t_ms").alias("cut_ms"))


def words(spark: SparkSession, sf_dir: str, most_docs: int | None = None, source: str = "documents") -> DataFrame:
    """video_id, seq, text, start_ms, end_ms: a word every 350 ms, and a pause of 400 ms after a sentence."""
    d = table(spark, sf_dir, source)
    d = d.select(F.col("doc_id").alias("video_id"), "text") if source == "documents" else d.select((F.col("conv_id") * 1000 + F.col("turn")).alias("video_id"), "text")
    parts = F.filter(F.split("text", "[ \n]"), lambda t: t != "")
    w = d.select("video_id", F.posexplode(parts).alias("seq", "text")).withColumn("seq", F.col("seq").cast("bigint"))
    ends = F.sum(F.col("text").rlike("[.!?]$").cast("bigint")).over(Window.partitionBy("video_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("seq") * 350 + F.coalesce(ends, F.lit(0)) * 400
    return w.select("video_id", "seq", "text", start.alias("start_ms"), (start + 300).alias("end_ms"))


# The same in SQL, as common table expressions to put before a query.
POINTS = """pts AS (
  SELECT user_id AS video_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 10000000 AS t_ms,
         event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
vids AS (SELECT DISTINCT user_id AS video_id FROM events)"""
SERIES = (
    POINTS
    + """,
ser AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t_ms, event_id) - 1 AS i, t_ms, event_type, value, k FROM pts)"""
)
GRID = f"""grd AS (SELECT video_id, unnest(range({N})) AS i FROM vids)"""


def channel_sql(name: str, value: str = "value", where: str = "TRUE") -> str:
    """CTEs <name>_b (largest per bin) and <name> (held on the grid)."""
    return f"""{name}_b AS (SELECT video_id, least(greatest(t_ms, 0), {DURATION - 1}) * {N} // {DURATION} AS i, greatest(max({value}), 0.0::DOUBLE) AS v FROM pts WHERE {where} GROUP BY ALL),
{name} AS (SELECT g.video_id, g.i, coalesce(last_value(CASE WHEN b.v > 0 THEN b.v END IGNORE NULLS) OVER (PARTITION BY g.video_id ORDER BY g.i ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS value
  FROM grd g LEFT JOIN {name}_b b ON g.video_id = b.video_id AND g.i = b.i)"""


SIGNALS_SQL = (
    POINTS + ",\n" + GRID + ",\n"
    + ",\n".join(channel_sql(f"c_{n}", "value / 490", f"event_type = '{k}'") for n, k in CHANNEL_EVENTS.items())
    + ",\n" + channel_sql("c_laughter", "k / 100") + """,
sig AS (SELECT a.video_id, a.i, a.value AS action, s.value AS speech, l.value AS laughter, d.value AS drama, e.value AS aesthetic, n.value AS interest
  FROM c_action a JOIN c_speech s USING (video_id, i) JOIN c_laughter l USING (video_id, i) JOIN c_drama d USING (video_id, i)
  JOIN c_aesthetic e USING (video_id, i) JOIN c_interest n USING (video_id, i))"""
)
LOUD_SQL = channel_sql("loud_c") + """,
loud AS (SELECT video_id, i, CASE WHEN max(value) OVER (PARTITION BY video_id) > 0 THEN value / max(value) OVER (PARTITION BY video_id) ELSE value END AS value FROM loud_c)"""
SHOTS_SQL = f"""bnd AS (SELECT video_id, 0 AS ms FROM vids UNION SELECT video_id, {DURATION} FROM vids
  UNION SELECT video_id, t_ms FROM pts WHERE event_type = 'purchase' AND t_ms BETWEEN 1 AND {DURATION - 1}),
sht AS (SELECT * FROM (SELECT video_id, row_number() OVER w - 1 AS shot_index, ms AS start_ms, lead(ms) OVER w AS end_ms FROM bnd
  WINDOW w AS (PARTITION BY video_id ORDER BY ms)) WHERE end_ms > start_ms)"""


def units_sql(p: dict, source: str = "sht", words: bool = False) -> str:
    """CTEs up to ``uni`` (units of a preset) from ``sht`` and ``loud``; with ``words``, from ``wds`` and ``ens`` too."""
    window, last = min(p["avg_shot_ms"] // 2, 800), N - 1
    snapped = f"""snt AS (SELECT t.video_id, t.shot_index, t.k, arg_min(e.end_at, abs(e.end_at - t.target_ms) * 10000000::BIGINT + e.end_at) AS s
  FROM tgt t JOIN ens e ON e.video_id = t.video_id AND abs(e.end_at - t.target_ms) <= {window} GROUP BY ALL),
cs1 AS (SELECT b.video_id, b.shot_index, b.k, b.start_ms, b.end_ms, coalesce(s, cut_ms) AS c FROM bst0 b LEFT JOIN snt n ON n.video_id = b.video_id AND n.shot_index = b.shot_index AND n.k = b.k),
ofw AS (SELECT c.video_id, c.shot_index, c.k, arg_min(CASE WHEN c.c - w.start_ms < w.end_ms - c.c THEN w.start_ms ELSE w.end_ms END, w.seq) AS e FROM cs1 c JOIN wds w ON w.video_id = c.video_id AND c.c BETWEEN w.start_ms AND w.end_ms GROUP BY ALL),
bst AS (SELECT c.video_id, c.shot_index, c.k, coalesce(e, c.c) AS cut_ms, c.start_ms, c.end_ms FROM cs1 c LEFT JOIN ofw o ON o.video_id = c.video_id AND o.shot_index = c.shot_index AND o.k = c.k),"""
    return f"""npc AS (SELECT *, end_ms - start_ms AS dur, greatest(1, CAST(floor((end_ms - start_ms) / {p['avg_shot_ms']}.0::DOUBLE + 0.5) AS BIGINT), (end_ms - start_ms) // {p['max_unit_ms'] + 1} + 1) AS n FROM {source}),
tgt AS (SELECT video_id, shot_index, start_ms, end_ms, k, start_ms + dur * k // n AS target_ms
  FROM (SELECT *, unnest(range(1, n)) AS k FROM npc WHERE dur > {p['max_unit_ms']} AND n > 1)),
stp AS (SELECT *, unnest(range(greatest(start_ms, target_ms - {window}), least(end_ms, target_ms + {window}) + 1, 250)) AS t FROM tgt),
val AS (SELECT s.*, a.value AS va, b.value AS vb, least(t * 4 // 1000, {last}) AS ia, least((t + 249) * 4 // 1000, {last}) AS ib
  FROM stp s JOIN loud a ON a.video_id = s.video_id AND a.i = least(t * 4 // 1000, {last})
  JOIN loud b ON b.video_id = s.video_id AND b.i = least((t + 249) * 4 // 1000, {last})),
{'bst0' if words else 'bst'} AS (SELECT video_id, shot_index, k, t AS cut_ms, start_ms, end_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, shot_index, k ORDER BY CASE WHEN ia = ib THEN va ELSE (va + vb) / 2 END, t) AS rn FROM val) WHERE rn = 1),
{snapped if words else ''}
cut AS (SELECT video_id, shot_index, list_sort(list(least(greatest(cut_ms, start_ms), end_ms))) AS cuts FROM bst GROUP BY ALL),
raw AS (SELECT s.video_id, s.shot_index, s.start_ms, s.end_ms, c.cuts,
  CASE WHEN c.cuts IS NULL THEN [s.start_ms, s.end_ms] ELSE list_reduce(list_transform(list_concat(list_concat([s.start_ms], c.cuts), [s.end_ms]), lambda x: [x]),
    lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= {p['min_unit_ms']} THEN list_concat(acc, x) ELSE acc END) END AS kept
  FROM {source} s LEFT JOIN cut c ON c.video_id = s.video_id AND c.shot_index = s.shot_index),
fin AS (SELECT video_id, shot_index, list_concat(kept[1:len(kept) - 1], [end_ms]) AS b FROM raw),
uni AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY shot_index, src_in_ms) - 1 AS unit_seq, shot_index, src_in_ms, src_out_ms FROM (
  SELECT video_id, shot_index, b[j] AS src_in_ms, b[j + 1] AS src_out_ms FROM (SELECT *, unnest(range(1, len(b))) AS j FROM fin)) WHERE src_out_ms - src_in_ms >= {p['min_unit_ms']})"""


def rank_sql(value: str, p: float) -> str:
    """Floor-rank percentile as an aggregate."""
    return f"list_sort(list({value}))[CAST(floor((count(*) - 1) * {p}::DOUBLE) AS BIGINT) + 1]"


def features_sql(p: dict) -> str:
    """CTEs ``rft`` (raw features) and ``nft`` (normalised, with the score)."""
    last = N - 1
    peaks, means = ("action", "laughter", "drama", "interest"), ("speech", "aesthetic")
    rel = ("action", "speech", "laughter", "drama", "aesthetic", "interest")
    names = ("scene_length", *rel)
    weights = {s: p[f"w_{s}"] / sum(p[f"w_{x}"] for x in ("scene_length", *rel)) for s in names}
    order = ["scene_length", "action", "speech", "laughter", "drama", "aesthetic", "interest"]
    terms = [f"{weights[s]!r}::DOUBLE * {s}" for s in order]
    return f"""met AS (SELECT u.*, s.* EXCLUDE (video_id, i) FROM (SELECT *, unnest(range(least(src_in_ms * 4 // 1000, {last}), least((src_out_ms - 1) * 4 // 1000, {last}) + 1)) AS i FROM uni) u
  JOIN sig s ON s.video_id = u.video_id AND s.i = u.i),
rft0 AS (SELECT video_id, unit_seq, shot_index, src_in_ms, src_out_ms, {', '.join(rank_sql(s, 0.9) + f' AS {s}' for s in peaks)}, {', '.join(f'avg({s}) AS {s}' for s in means)} FROM met GROUP BY ALL),
rft AS (SELECT r.*, exp(-((h.end_ms - h.start_ms - {p['avg_shot_ms']})::DOUBLE * (h.end_ms - h.start_ms - {p['avg_shot_ms']})::DOUBLE) / (2.0::DOUBLE * {float(p['sigma_ms'])}::DOUBLE * {float(p['sigma_ms'])}::DOUBLE)) AS scene_length
  FROM rft0 r JOIN sht h ON h.video_id = r.video_id AND h.shot_index = r.shot_index),
rng AS (SELECT video_id, {', '.join(f'{rank_sql(s, q)} AS {s}_{t}' for s in rel for q, t in ((0.05, 'lo'), (0.95, 'hi')))} FROM rft GROUP BY video_id),
nft0 AS (SELECT r.video_id, unit_seq, shot_index, src_in_ms, src_out_ms, scene_length, {', '.join(f'CASE WHEN {s}_hi <= {s}_lo THEN 0.5::DOUBLE ELSE least(greatest(({s} - {s}_lo) / ({s}_hi - {s}_lo), 0.0::DOUBLE), 1.0::DOUBLE) END AS {s}' for s in rel)}
  FROM rft r JOIN rng g ON g.video_id = r.video_id),
nft AS (SELECT *, 0.7::DOUBLE * ({' + '.join(terms)}) + 0.3::DOUBLE * greatest(0.0::DOUBLE, {', '.join(terms)}) AS score FROM nft0)"""


def greedy_sql(p: dict) -> str:
    """CTE ``chs``: the greedy choice as a recursive query; a state row per unit carries its penalty."""
    total, names = DURATION, ("scene_length", "action", "speech", "laughter", "drama", "aesthetic", "interest")
    dot = " + ".join(f"s.{x} * b.{x}" for x in names)
    return f"""ini AS (SELECT *, src_out_ms - src_in_ms AS dur, least(greatest((src_in_ms + src_out_ms) // 2 * 8 // {total}, 0), 7) AS bkt,
  sqrt({' + '.join(f'{x} * {x}' for x in names)}) AS nrm FROM nft),
grd2 AS (
  SELECT 0 AS step, *, 0.0::DOUBLE AS pen, CAST([] AS BIGINT[]) AS cov, 0::BIGINT AS used, -1::BIGINT AS picked, FALSE AS done FROM ini
),
walk AS (
  WITH RECURSIVE st AS (
    SELECT * FROM grd2
    UNION ALL
    SELECT step + 1, video_id, unit_seq, shot_index, src_in_ms, src_out_ms, scene_length, action, speech, laughter, drama, aesthetic, interest, score, dur, bkt, nrm,
      pen + CASE WHEN nrm * b_nrm > 0 THEN least(greatest(0.6::DOUBLE * least(greatest(dt / (nrm * b_nrm), 0.0::DOUBLE), 1.0::DOUBLE) + 0.4::DOUBLE * CAST(shot_index = b_shot AS INT), 0.0::DOUBLE), 1.0::DOUBLE)
        ELSE 0.4::DOUBLE * CAST(shot_index = b_shot AS INT) END,
      list_append(cov, b_bkt), used + b_dur, CASE WHEN unit_seq = b_seq THEN CAST(step AS BIGINT) ELSE picked END, used + b_dur >= {p['max_ms']}
    FROM (
      SELECT s.*, b.unit_seq AS b_seq, b.dur AS b_dur, b.bkt AS b_bkt, b.shot_index AS b_shot, b.nrm AS b_nrm, b.gain AS b_gain, {dot} AS dt
      FROM st s JOIN (
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(gain / greatest(dur / 1000.0::DOUBLE, 0.001::DOUBLE), 9) DESC, unit_seq) AS rn FROM (
            SELECT *, score - {p['diversity']!r}::DOUBLE * pen + {p['coverage']!r}::DOUBLE * CASE WHEN list_contains(cov, bkt) THEN 0.0::DOUBLE ELSE 0.125::DOUBLE END AS gain
            FROM st WHERE NOT done AND picked < 0 AND (used + dur <= {p['max_ms']} OR len(cov) = 0))) WHERE rn = 1
      ) b ON b.video_id = s.video_id AND NOT (s.used >= {p['min_ms']} AND b.gain < {p['quality_floor']!r}::DOUBLE)
    )
  ) SELECT * FROM st
),
chs AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY video_id, unit_seq ORDER BY step DESC) AS rk FROM walk) WHERE rk = 1 AND picked >= 0)"""
