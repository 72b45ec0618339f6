"""Queries of curves, sound, frames and scorers' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.functions import adapters as M

from cutloom.operators import audio as U
from cutloom.operators import curves as V
from cutloom.operators import frames as P
from cutloom.operators import grid as G

from cutloom.plans import base as B
from cutloom.plans.editing import edl, r6
from cutloom.registry import query

CONTENT = "cnt AS (SELECT video_id, i, coalesce(abs(value - lag(value) OVER (PARTITION BY video_id ORDER BY i)) / 10, 0.0::DOUBLE) AS value FROM ser)"
RATIO = """rto AS (SELECT video_id, i, value, CASE WHEN m > 1e-6 THEN value / m WHEN value > 0 THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS ratio FROM (
  SELECT *, CASE WHEN count(CASE WHEN i >= 1 THEN value END) OVER w > 1 THEN (sum(CASE WHEN i >= 1 THEN value END) OVER w - value) / (count(CASE WHEN i >= 1 THEN value END) OVER w - 1) ELSE 0.0::DOUBLE END AS m
  FROM cnt WINDOW w AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE i >= 1)"""


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.series(spark, sf_dir)
    change = F.abs(F.col("value") - F.lag("value").over(G.by_video())) / 10
    return s.select("video_id", "i", F.coalesce(change, F.lit(0.0)).alias("value"))


@query(f"""WITH {B.SERIES}, d AS (SELECT video_id, i, greatest(0.0::DOUBLE, coalesce(value - lag(value) OVER (PARTITION BY video_id ORDER BY i), 0.0::DOUBLE)) AS value FROM ser),
f AS (SELECT video_id, {B.rank_sql('value', 0.05)} AS lo, {B.rank_sql('value', 0.95)} AS hi FROM d GROUP BY 1)
SELECT video_id, i, round(CASE WHEN hi <= lo THEN 0.5::DOUBLE ELSE least(greatest((value - lo) / (hi - lo), 0.0::DOUBLE), 1.0::DOUBLE) END, 6) AS value FROM d JOIN f USING (video_id)""")
def swell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.swell(B.series(spark, sf_dir).select("video_id", "i", "value")).select("video_id", "i", *r6("value"))


@query(f"WITH {B.SERIES} SELECT video_id, i, round(coalesce((lag(value) OVER w + value + lead(value) OVER w) / 3, value), 6) AS value FROM ser WINDOW w AS (PARTITION BY video_id ORDER BY i)")
def smooth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.smooth3(B.series(spark, sf_dir)).select("video_id", "i", *r6("value"))


@query(f"WITH {B.SERIES}, {CONTENT}, {RATIO} SELECT video_id, i, round(ratio, 5) AS ratio FROM rto")
def adaptive_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.adaptive_ratio(content(spark, sf_dir)).select("video_id", "i", F.round("ratio", 5).alias("ratio"))


@query(f"""WITH {B.SERIES}, {CONTENT}, {RATIO}, h AS (SELECT video_id, list_sort(list(i)) AS hits FROM rto WHERE (ratio > 3 AND value > 15) OR value > 27 GROUP BY 1)
SELECT video_id, unnest(list_reduce(list_transform(hits, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= 15 THEN list_concat(acc, x) ELSE acc END)) AS i FROM h""")
def cut_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.detect_cuts(content(spark, sf_dir))


@query(f"""WITH {B.SERIES}, b AS (SELECT video_id, i, value / 490 AS value, lag(value / 490) OVER (PARTITION BY video_id, i // 10 ORDER BY i) AS bef FROM ser)
SELECT video_id, i FROM b WHERE value > 0.5 AND (bef IS NULL OR bef <= 0.5) AND i > 0""")
def rising_edge_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.series(spark, sf_dir).select("video_id", "i", (F.col("value") / 490).alias("value"))
    return V.rising_edges(s, 0.5, 10)


@query(f"""WITH {B.POINTS}, p AS (SELECT video_id, list_sort(list(t_ms)) AS pts FROM pts GROUP BY 1),
k AS (SELECT video_id, list_reduce(list_transform(pts, lambda x: [x, 0]), lambda acc, x: CASE WHEN x[1] >= acc[1] THEN list_concat([greatest(acc[1] + 5000, x[1] + 1)], list_concat(acc[2:], [x[1]])) ELSE acc END, [0::BIGINT]) AS s FROM p)
SELECT video_id, j - 1 AS i, s[j + 1] AS pts_ms FROM (SELECT *, unnest(range(1, len(s))) AS j FROM k)""")
def frame_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sample_frames(B.points(spark, sf_dir).select("video_id", F.col("t_ms").alias("pts_ms")), 5000)


@query(f"WITH {B.SERIES} SELECT video_id, i, value FROM ser WHERE i % 4 = 0")
def every_fourth_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.series(spark, sf_dir).where("i % 4 = 0").select("video_id", "i", "value")


PCM_SQL = "pcm AS (SELECT l_suppkey AS video_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i, CAST(floor((l_extendedprice * 7 + l_quantity * 131)) AS BIGINT) % 20001 - 10000 AS value FROM lineitem)"


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number samples made of line items, a recording per supplier; taken as 1000 Hz."""
    l = B.table(spark, sf_dir, "lineitem")  # noqa: E741
    i = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    value = F.floor(F.col("l_extendedprice") * 7 + F.col("l_quantity") * 131) % 20001 - 10000
    return l.select(F.col("l_suppkey").alias("video_id"), i.cast("bigint").alias("i"), value.alias("value"))


WIN_SQL = """win AS (SELECT video_id, i // {n} AS w, sqrt(sum(value / 32768.0::DOUBLE * (value / 32768.0::DOUBLE)) / {n}) AS rms, sum(c) / {n}::DOUBLE AS zcr FROM (
  SELECT *, CASE WHEN (value >= 0) <> coalesce(lag(value) OVER (PARTITION BY video_id, i // {n} ORDER BY i) >= 0, value >= 0) THEN 1 ELSE 0 END AS c FROM pcm) GROUP BY ALL HAVING count(*) = {n})"""


@query(f"WITH {PCM_SQL}, {WIN_SQL.format(n=50)} SELECT video_id, w, round(rms, 6) AS rms, round(zcr, 6) AS zcr FROM win")
def tumbling_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.windows(pcm(spark, sf_dir), 1000, 50).select("video_id", "w", *r6("rms", "zcr"))


@query(f"WITH {PCM_SQL}, {WIN_SQL.format(n=50)} SELECT video_id, w AS i, round(CASE WHEN max(rms) OVER (PARTITION BY video_id) > 0 THEN rms / max(rms) OVER (PARTITION BY video_id) ELSE rms END, 6) AS value FROM win")
def loudness_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = U.windows(pcm(spark, sf_dir), 1000, 50).select("video_id", F.col("w").alias("i"), F.col("rms").alias("value"))
    return U.relative_to_max(c).select("video_id", "i", *r6("value"))


@query(f"""WITH {PCM_SQL}, {WIN_SQL.format(n=30)}, f AS (SELECT video_id, {B.rank_sql('rms', 0.1)} AS fl, {B.rank_sql('rms', 0.95)} AS pk FROM win GROUP BY 1),
p AS (SELECT video_id, w AS i, 1.0::DOUBLE / (1.0::DOUBLE + exp(-((rms - (fl + 0.15::DOUBLE * greatest(pk - fl, 1e-6::DOUBLE))) / (0.1::DOUBLE * greatest(pk - fl, 1e-6::DOUBLE))))) * CASE WHEN zcr < 0.02 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS value FROM win JOIN f USING (video_id))
SELECT video_id, i, round(coalesce((lag(value) OVER w + value + lead(value) OVER w) / 3, value), 6) AS value FROM p WINDOW w AS (PARTITION BY video_id ORDER BY i)""")
def vad_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.speech_curve(pcm(spark, sf_dir), 1000, 30).select("video_id", "i", *r6("value"))


@query(f"""WITH {PCM_SQL}, s AS (SELECT video_id, value FROM pcm WHERE i % 400 BETWEEN 100 AND 299 UNION ALL SELECT video_id, value FROM pcm WHERE i % 400 >= 200),
r AS (SELECT video_id, sqrt(sum(value / 32768.0::DOUBLE * (value / 32768.0::DOUBLE)) / count(*)) AS rms FROM s GROUP BY 1)
SELECT v.video_id, round(CASE WHEN coalesce(rms, 0) >= 1e-4 THEN least(greatest(0.12::DOUBLE / rms, 0.5::DOUBLE), 4.0::DOUBLE) ELSE 1.0::DOUBLE END, 6) AS gain FROM (SELECT DISTINCT video_id FROM pcm) v LEFT JOIN r USING (video_id)""")
def makeup_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over two spans that overlap, in every 400 ms of a recording."""
    p = pcm(spark, sf_dir)
    vids = p.groupBy("video_id").agg(F.max("i").alias("last"))
    every = vids.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"), F.lit(400).cast("bigint"))).alias("at"))
    spans = every.select("video_id", F.explode(F.array(F.lit(100), F.lit(200))).alias("after"), "at").select("video_id", (F.col("at") + F.col("after")).alias("from_ms"), (F.col("at") + F.col("after") + 200).alias("to_ms"))
    return U.makeup_gain(p, spans, vids.select("video_id"), 1000).select("video_id", *r6("gain"))


@query(f"WITH {PCM_SQL} SELECT video_id, i, least(greatest(CAST(trunc(value * 3.7::DOUBLE) AS BIGINT), -32768), 32767) AS value FROM pcm")
def pcm_gain_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pcm(spark, sf_dir).select("video_id", "i", U.limited(F.col("value"), F.lit(3.7)).alias("value"))


@query(f"WITH {PCM_SQL} SELECT video_id, i // 3 AS i, sum(value)::BIGINT // 3 + CASE WHEN sum(value) < 0 AND sum(value) % 3 <> 0 AND FALSE THEN 1 ELSE 0 END AS value FROM pcm GROUP BY ALL HAVING count(*) = 3")
def downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = pcm(spark, sf_dir).groupBy("video_id", G.div(F.col("i"), 3).alias("i")).agg(F.collect_list("value").alias("frame"))
    return f.where(F.size("frame") == 3).select("video_id", "i", U.downmix(F.col("frame"), 3).alias("value"))


def _duck_sql() -> str:
    from cutloom.plans.editing import _OD

    speech = B.channel_sql("spc", "value / 490", "event_type = 'signup'")
    return _OD.rstrip() + f""",
{speech},
stt AS (SELECT video_id, ord, src_in_ms, unnest(range(0, greatest(src_out_ms - src_in_ms, 1), 50)) AS t FROM od),
duc AS (SELECT s.video_id, row_number() OVER (PARTITION BY s.video_id ORDER BY ord, t) - 1 AS j, CASE WHEN value > 0.4 THEN 0.22::DOUBLE ELSE 0.6::DOUBLE END AS raw
  FROM stt s JOIN spc c ON c.video_id = s.video_id AND c.i = least(CAST(floor((src_in_ms + t) / {float(B.DURATION)}::DOUBLE * {B.N}) AS BIGINT), {B.N - 1})) """


def _duck(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech = B.channel(spark, sf_dir, "signup").withColumn("value", F.col("value") / 490)
    return U.duck_raw(edl("shortform", spark, sf_dir), speech, B.DURATION, B.N)


@query(_duck_sql() + "SELECT video_id, j, raw FROM duc")
def duck_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duck(spark, sf_dir)


@query(_duck_sql() + """, al AS (SELECT video_id, list(raw ORDER BY j) AS rs FROM duc GROUP BY 1), fo AS (SELECT video_id, list_reduce(list_transform(rs, lambda x: [x]), lambda acc, x: list_concat(acc, [acc[len(acc)] + (x[1] - acc[len(acc)]) * 0.2::DOUBLE]), [0.6::DOUBLE]) AS g FROM al)
SELECT video_id, k - 2 AS j, round(g[k], 6) AS gain FROM (SELECT *, unnest(range(2, len(g) + 1)) AS k FROM fo)""")
def duck_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.one_pole(_duck(spark, sf_dir)).select("video_id", "j", *r6("gain"))


@query(f"""WITH {PCM_SQL}, e AS (SELECT video_id, w AS j, round(0.2::DOUBLE + rms, 6) AS gain FROM (SELECT * FROM (SELECT video_id, i // 50 AS w, sqrt(sum(value / 32768.0::DOUBLE * (value / 32768.0::DOUBLE)) / 50) AS rms FROM pcm GROUP BY ALL HAVING count(*) = 50)) QUALIFY w < max(w) OVER (PARTITION BY video_id)),
l AS (SELECT video_id, max(j) AS last FROM e GROUP BY 1)
SELECT p.video_id, p.i, least(greatest(CAST(trunc(p.value * coalesce(e.gain, 0.6::DOUBLE)) AS BIGINT), -32768), 32767) AS value FROM pcm p LEFT JOIN l ON l.video_id = p.video_id LEFT JOIN e ON e.video_id = p.video_id AND e.j = least(CAST(floor(p.i / 1000.0::DOUBLE * 20) AS BIGINT), l.last)""")
def pcm_duck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope has all windows but the last, so that a held gain shows as well."""
    p = pcm(spark, sf_dir)
    windows = U.windows(p, 1000, 50).withColumn("most", F.max("w").over(Window.partitionBy("video_id"))).where("w < most")
    env = windows.select("video_id", F.col("w").alias("j"), F.round(F.lit(0.2) + F.col("rms"), 6).alias("gain"))
    return U.duck(p, env, 1000, 20)


PIX_SQL = """pix AS (SELECT video_id, i, x, y, (video_id * 31 + i * 17 + x * 7 + y * 13) * 37 % 256 AS r, (video_id * 5 + i * 29 + x * 11 + y * 3) * 53 % 256 AS g, (video_id * 13 + i * 3 + x * 19 + y * 23) * 71 % 256 AS b
FROM (SELECT p_partkey AS video_id FROM part) v, (SELECT unnest(range(4)) AS i) f, (SELECT unnest(range(6)) AS x) a, (SELECT unnest(range(5)) AS y) b)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small frames from a rule: four frames of 6 x 5 pixels per part."""
    d = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id"))
    rng = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    d = d.select("video_id", rng(4).alias("i")).select("*", rng(6).alias("x")).select("*", rng(5).alias("y"))
    part = lambda a, b, c, e, m: ((F.col("video_id") * a + F.col("i") * b + F.col("x") * c + F.col("y") * e) * m % 256)
    return d.select("*", part(31, 17, 7, 13, 37).alias("r"), part(5, 29, 11, 3, 53).alias("g"), part(13, 3, 19, 23, 71).alias("b"))


HSV_SQL = """hsv AS (SELECT *, CASE WHEN mx > 0 THEN d / mx * 255 ELSE 0.0::DOUBLE END AS s, mx AS v, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END / 360 * 255 AS h, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM (
  SELECT *, CASE WHEN d > 1e-6 THEN 60.0::DOUBLE * CASE WHEN mx = r THEN fmod((g - b) / d, 6) WHEN mx = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END ELSE 0.0::DOUBLE END AS h0 FROM (
    SELECT *, greatest(r, g, b)::DOUBLE AS mx, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS d FROM pix)))"""


@query(f"WITH {PIX_SQL}, {HSV_SQL} SELECT video_id, i, x, y, round(h, 5) AS h, round(s, 5) AS s, round(v, 5) AS v, round(l, 5) AS luma FROM hsv")
def rgb_hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, s, v = P.hsv(F.col("r"), F.col("g"), F.col("b"))
    l = P.luma(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    return pixels(spark, sf_dir).select("video_id", "i", "x", "y", F.round(h, 5).alias("h"), F.round(s, 5).alias("s"), F.round(v, 5).alias("v"), F.round(l, 5).alias("luma"))


@query(f"WITH {PIX_SQL}, q AS (SELECT video_id, i, (r - g)::DOUBLE AS rg, 0.5::DOUBLE * (r + g) - b AS yb FROM pix) SELECT video_id, i, round(sqrt(var_pop(rg) + var_pop(yb)) + 0.3::DOUBLE * sqrt(avg(rg) * avg(rg) + avg(yb) * avg(yb)), 5) AS colorfulness FROM q GROUP BY ALL")
def colorfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.colorfulness(pixels(spark, sf_dir)).select("video_id", "i", F.round("colorfulness", 5).alias("colorfulness"))


@query(f"""WITH {PIX_SQL}, l AS (SELECT video_id, i, x, y, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM pix),
p AS (SELECT c.video_id, c.i, 4 * c.l - a.l - b.l - d.l - e.l AS lap FROM l c JOIN l a ON (a.video_id, a.i, a.x, a.y) = (c.video_id, c.i, c.x - 1, c.y) JOIN l b ON (b.video_id, b.i, b.x, b.y) = (c.video_id, c.i, c.x + 1, c.y)
JOIN l d ON (d.video_id, d.i, d.x, d.y) = (c.video_id, c.i, c.x, c.y - 1) JOIN l e ON (e.video_id, e.i, e.x, e.y) = (c.video_id, c.i, c.x, c.y + 1)) SELECT video_id, i, round(var_pop(lap), 3) AS sharpness FROM p GROUP BY ALL""")
def sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sharpness(pixels(spark, sf_dir)).select("video_id", "i", F.round("sharpness", 3).alias("sharpness"))


@query(f"""WITH {PIX_SQL}, {HSV_SQL} SELECT a.video_id, a.i, round(coalesce(avg((abs(a.h - b.h) + abs(a.s - b.s) + abs(a.v - b.v)) / 3), 0.0::DOUBLE), 5) AS content, round(coalesce(avg(abs(a.l - b.l)) / 255, 0.0::DOUBLE), 6) AS motion
FROM hsv a LEFT JOIN hsv b ON (b.video_id, b.x, b.y) = (a.video_id, a.x, a.y) AND b.i = a.i - 1 GROUP BY ALL""")
def frame_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.frame_diff(pixels(spark, sf_dir)).select("video_id", "i", F.round("content", 5).alias("content"), F.round("motion", 6).alias("motion"))


FACE_SQL = """fac AS (SELECT l_orderkey AS video_id, l_linenumber * 1000000::BIGINT + l_partkey AS k, l_quantity::DOUBLE AS lft, l_discount * 500::DOUBLE AS top, l_quantity + l_tax * 1000::DOUBLE AS rgt, l_discount * 500::DOUBLE + l_quantity AS btm FROM lineitem)"""


@query(f"""WITH {FACE_SQL}, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round((rgt - lft) * (btm - top), 6) DESC, k) AS rn FROM fac) WHERE rn = 1),
s AS (SELECT video_id, k, (lft + rgt) / 2 / 160 AS cx, (top + btm) / 2 / 90 AS cy, greatest(rgt - lft, 0) AS w, greatest(btm - top, 0) AS h FROM d)
SELECT video_id, CAST(k AS BIGINT) AS face, round(least(greatest(0.6::DOUBLE * least(greatest(sqrt(w * h / 14400), 0.0::DOUBLE), 1.0::DOUBLE) + 0.4::DOUBLE * least(greatest(1 - (abs(cx - 0.5::DOUBLE) + abs(cy - 0.5::DOUBLE)), 0.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE), 6) AS score,
round(cx, 6) AS cx, round(cy, 6) AS cy, round(greatest(w / 160, h / 90), 6) AS size FROM s""")
def face_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = B.table(spark, sf_dir, "lineitem")  # noqa: E741
    boxes = l.select(F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") * F.lit(1000000).cast("bigint") + F.col("l_partkey")).alias("k"), F.col("l_quantity").cast("double").alias("left"), (F.col("l_discount") * 500).alias("top"), (F.col("l_quantity") + F.col("l_tax") * 1000).alias("right"), (F.col("l_discount") * 500 + F.col("l_quantity")).alias("bottom"))
    return M.face_frames(boxes, 160, 90).select("video_id", F.col("k").alias("face"), *r6("score", "cx", "cy", "size"))


@query("""WITH b AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: abs(x)::DOUBLE) AS p FROM embeddings),
s AS (SELECT vec_id, len(p) AS k, list_sum(p) AS t, list_sum(list_transform(range(1, 11), lambda i: i * p[i])) AS w FROM b) SELECT vec_id, round(least(greatest(CASE WHEN t > 0 THEN w / t ELSE 0 END / k, 0.0::DOUBLE), 1.0::DOUBLE), 5) AS nima FROM s""")
def nima_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double")))
    return B.table(spark, sf_dir, "embeddings").select("vec_id", F.round(M.mean_opinion(buckets), 5).alias("nima"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), pr AS (SELECT vec_id // 2 AS pair, max(CASE WHEN vec_id % 2 = 0 THEN v END) AS pos, max(CASE WHEN vec_id % 2 = 1 THEN v END) AS neg FROM e WHERE vec_id < 20 GROUP BY 1),
q AS (SELECT e.vec_id, pair, 1.0::DOUBLE / (1.0::DOUBLE + exp(list_dot_product(v, neg) * 100 - list_dot_product(v, pos) * 100)) AS p FROM e, pr WHERE e.vec_id >= 20)
SELECT vec_id, round(avg(CASE WHEN pair <= 3 THEN p END), 5) AS quality, round(avg(CASE WHEN pair BETWEEN 4 AND 6 THEN p END), 5) AS aesthetic, round(avg(CASE WHEN pair >= 7 THEN p END), 5) AS interest FROM q GROUP BY 1""")
def clip_pair_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    prompts = e.where("vec_id < 20").select(F.col("vec_id").alias("prompt"), "v")
    found = M.pair_scores(e.where("vec_id >= 20"), prompts, "vec_id")
    return found.select("vec_id", *[F.round(c, 5).alias(c) for c in ("quality", "aesthetic", "interest")])


@query("""SELECT user_id AS video_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 10000000 // 975 AS w, coalesce(max(value) FILTER (WHERE lower(event_type) IN ('click', 'view')), 0.0::DOUBLE) AS laughter,
coalesce(max(value) FILTER (WHERE lower(event_type) IN ('purchase')), 0.0::DOUBLE) AS applause, coalesce(max(value) FILTER (WHERE lower(event_type) IN ('signup', 'error')), 0.0::DOUBLE) AS music FROM events GROUP BY ALL""")
def audio_event_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.points(spark, sf_dir).select("video_id", G.div(F.col("t_ms"), 975).alias("w"), F.upper("event_type").alias("label"), F.col("value").alias("score"))
    return M.label_maxima(s, {"laughter": ["Click", "View"], "applause": ["Purchase"], "music": ["Signup", "Error"]})


@query(f"""WITH {B.SERIES}, k AS (SELECT video_id, i, value, k, {B.rank_sql('value', 0.05).replace('list(value)', 'list(value) OVER w').replace('count(*)', 'count(*) OVER w')} AS vlo, {B.rank_sql('value', 0.95).replace('list(value)', 'list(value) OVER w').replace('count(*)', 'count(*) OVER w')} AS vhi,
{B.rank_sql('k', 0.05).replace('list(k)', 'list(k) OVER w').replace('count(*)', 'count(*) OVER w')} AS klo, {B.rank_sql('k', 0.95).replace('list(k)', 'list(k) OVER w').replace('count(*)', 'count(*) OVER w')} AS khi FROM ser WINDOW w AS (PARTITION BY video_id)),
a AS (SELECT video_id, i, value / 490 AS action, 0.5::DOUBLE * CASE WHEN vhi <= vlo THEN 0.5::DOUBLE ELSE least(greatest((value - vlo) / (vhi - vlo), 0.0::DOUBLE), 1.0::DOUBLE) END + 0.5::DOUBLE * CASE WHEN khi <= klo THEN 0.5::DOUBLE ELSE least(greatest((k - klo) / (khi - klo), 0.0::DOUBLE), 1.0::DOUBLE) END AS aesthetic FROM k),
b AS (SELECT *, 0.5::DOUBLE * action + 0.5::DOUBLE * aesthetic AS raw FROM a), f AS (SELECT video_id, {B.rank_sql('raw', 0.05)} AS lo, {B.rank_sql('raw', 0.95)} AS hi FROM b GROUP BY 1)
SELECT video_id, i, round(action, 6) AS action, round(aesthetic, 6) AS aesthetic, round(CASE WHEN hi <= lo THEN 0.5::DOUBLE ELSE least(greatest((raw - lo) / (hi - lo), 0.0::DOUBLE), 1.0::DOUBLE) END, 6) AS interest FROM b JOIN f USING (video_id)""")
def channel_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classical fusion: sharpness and colour make the aesthetic, motion and aesthetic the interest."""
    from cutloom.operators.fusion import fuse

    s = B.series(spark, sf_dir).select("video_id", "i", (F.col("value") / 490).alias("motion"), F.col("value").alias("sharpness"), F.col("k").alias("colorfulness"))
    return fuse(s).select("video_id", "i", *r6("action", "aesthetic", "interest"))


@query(f"WITH {B.SERIES}, c AS (SELECT video_id, count(*) FILTER (WHERE value / 490 > 0.5) AS loud, count(*) AS n, count(*) FILTER (WHERE value / 490 > 0.4) AS laughs FROM ser GROUP BY 1) SELECT video_id, loud > n // 20 AS has_speech, laughs FROM c")
def speech_gate_laugh_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") / 490
    c = B.series(spark, sf_dir).groupBy("video_id").agg(F.count_if(x > 0.5).alias("loud"), F.count(F.lit(1)).alias("n"), F.count_if(x > 0.4).alias("laughs"))
    return c.select("video_id", (F.col("loud") > G.div(F.col("n"), 20)).alias("has_speech"), "laughs")


@query("""WITH m AS (SELECT l_orderkey AS video_id, l_linenumber * 1000000::BIGINT + l_partkey AS packet, sqrt((l_quantity / 10) * (l_quantity / 10) + (l_discount * 100 / 10) * (l_discount * 100 / 10) + (l_tax * 100 / 10) * (l_tax * 100 / 10)) AS mag FROM lineitem),
p AS (SELECT video_id, packet, avg(mag) AS energy FROM m GROUP BY ALL) SELECT video_id, packet, round(CASE WHEN max(energy) OVER (PARTITION BY video_id) > 0 THEN energy / max(energy) OVER (PARTITION BY video_id) ELSE energy END, 6) AS energy FROM p""")
def accel_packet_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutloom.operators.telemetry import packet_energy

    l = B.table(spark, sf_dir, "lineitem")  # noqa: E741
    rows = l.select(F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") * F.lit(1000000).cast("bigint") + F.col("l_partkey")).alias("packet"), F.array(F.col("l_quantity").cast("double"), F.col("l_discount") * 100, F.col("l_tax") * 100).alias("values"), F.lit(3).alias("axes"), F.lit(10.0).alias("scale"))
    return packet_energy(rows).select("video_id", "packet", *r6("energy"))


