"""Queries of the editing engine: grid, shots, units, features, choice, arrangement."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom import dims
from cutloom.functions.scalars import cosine, gaussian, similarity, timeline_bucket
from cutloom.operators import grid as G
from cutloom.operators import score as S
from cutloom.operators import select as C
from cutloom.operators import shots as H
from cutloom.operators import stats as A
from cutloom.plans import base as B
from cutloom.registry import query

SHORT = dims.preset("shortform")


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {B.POINTS},\n{B.GRID},\n{B.channel_sql('c', where="event_type = 'click'")} SELECT video_id, i, value FROM c")
def signal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.channel(spark, sf_dir, "click")


@query(f"WITH {B.SERIES} SELECT video_id, i, coalesce(last_value(CASE WHEN value > 200 THEN value END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS value FROM ser")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.series(spark, sf_dir).withColumn("value", F.when(F.col("value") > 200, F.col("value")).otherwise(F.lit(0.0)))
    return G.forward_fill(s)


@query(f"""WITH {B.POINTS},\n{B.GRID},
mk AS (SELECT DISTINCT video_id, least(greatest(t_ms * {B.N} // {B.DURATION}, 0), {B.N - 1}) AS c FROM pts WHERE event_type = 'purchase'),
ex AS (SELECT video_id, c, unnest(range(c - 5, c + 6)) AS i FROM mk),
pk AS (SELECT video_id, i, max(1.0::DOUBLE - abs(i - c) / 6.0::DOUBLE) AS v FROM ex GROUP BY ALL)
SELECT g.video_id, g.i, round(coalesce(v, 0.0::DOUBLE), 6) AS value FROM grd g LEFT JOIN pk ON pk.video_id = g.video_id AND pk.i = g.i""")
def highlight_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = B.cuts(spark, sf_dir).withColumnRenamed("cut_ms", "mark_ms")
    return G.highlight_curve(marks, B.videos(spark, sf_dir), B.N, B.DURATION).select("video_id", "i", *r6("value"))


@query(f"""WITH {B.POINTS},\n{B.GRID},\n{B.channel_sql('a', 'value / 490', "event_type = 'click'")},\n{B.channel_sql('b', 'value / 490', "event_type = 'view'")}
SELECT a.video_id, a.i, round(least(greatest(a.value + 0.6::DOUBLE * b.value, 0.0::DOUBLE), 1.0::DOUBLE), 6) AS value FROM a JOIN b USING (video_id, i)""")
def boost_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = lambda kind: B.channel(spark, sf_dir, kind).withColumn("value", F.col("value") / 490)
    return G.boost(scaled("click"), scaled("view"), 0.6).select("video_id", "i", *r6("value"))


@query(f"""WITH {B.SERIES}, m AS (SELECT video_id, count(*) AS m FROM ser GROUP BY 1)
SELECT g.video_id, g.i, s.value FROM (SELECT video_id, m, unnest(range(100)) AS i FROM m) g JOIN ser s ON s.video_id = g.video_id AND s.i = least(g.i * g.m // 100, g.m - 1)""")
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.series(spark, sf_dir).select("video_id", "i", "value")
    return G.resample_nearest(s, B.videos(spark, sf_dir), 100)


@query(f"""WITH {B.SERIES}, smp AS (SELECT video_id, i, CAST(floor(value * 100) AS BIGINT) AS value FROM ser), m AS (SELECT video_id, count(*) AS m FROM smp GROUP BY 1),
o AS (SELECT video_id, m, j, j * (44100 / 16000::DOUBLE) AS pos FROM (SELECT video_id, m, unnest(range(m * 16000 // 44100)) AS j FROM m))
SELECT o.video_id, o.j AS i, CAST(trunc(a.value::DOUBLE + (b.value::DOUBLE - a.value::DOUBLE) * (o.pos - least(floor(o.pos), o.m - 1))) AS BIGINT) AS value
FROM o JOIN smp a ON a.video_id = o.video_id AND a.i = least(floor(o.pos), o.m - 1) JOIN smp b ON b.video_id = o.video_id AND b.i = least(least(floor(o.pos), o.m - 1) + 1, o.m - 1)""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.series(spark, sf_dir).select("video_id", "i", F.floor(F.col("value") * 100).alias("value"))
    return G.resample_linear(s, 44100, 16000)


@query(f"SELECT l_suppkey, {B.rank_sql('l_extendedprice', 0.05)} AS p05, {B.rank_sql('l_extendedprice', 0.9)} AS p90, {B.rank_sql('l_extendedprice', 0.95)} AS p95 FROM lineitem GROUP BY l_suppkey")
def floor_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[A.floor_rank("l_extendedprice", p).alias(n) for p, n in ((0.05, "p05"), (0.9, "p90"), (0.95, "p95"))])


@query(f"""WITH {B.SERIES}, f AS (SELECT video_id, {B.rank_sql('value', 0.05)} AS lo, {B.rank_sql('value', 0.95)} AS hi FROM ser GROUP BY 1)
SELECT s.video_id, s.i, round(CASE WHEN hi <= lo THEN 0.5::DOUBLE ELSE least(greatest((value - lo) / (hi - lo), 0.0::DOUBLE), 1.0::DOUBLE) END, 6) AS value FROM ser s JOIN f USING (video_id)""")
def robust_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.normalize(B.series(spark, sf_dir).select("video_id", "i", "value"), ["video_id"], ["value"]).select("video_id", "i", *r6("value"))


@query(f"WITH {B.POINTS},\n{B.SHOTS_SQL} SELECT video_id, shot_index, start_ms, end_ms FROM sht")
def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.shots_from_cuts(B.cuts(spark, sf_dir), B.videos(spark, sf_dir), B.DURATION)


def _units(spark: SparkSession, sf_dir: str, preset: dict) -> DataFrame:
    return H.segment(shots(spark, sf_dir), B.loudness(spark, sf_dir), preset, B.N)


UNITS_SQL = {p: f"WITH {B.POINTS},\n{B.GRID},\n{B.LOUD_SQL},\n{B.SHOTS_SQL},\n{B.units_sql(dims.preset(p))}" for p in ("shortform", "cine")}


@query(UNITS_SQL["shortform"] + " SELECT video_id, unit_seq, shot_index, src_in_ms, src_out_ms FROM uni")
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir, SHORT)


@query(UNITS_SQL["cine"] + " SELECT video_id, unit_seq, shot_index, src_in_ms, src_out_ms FROM uni")
def units_cine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir, dims.preset("cine"))


def _edit_sql(p: dict, choose: bool = False) -> str:
    parts = [B.SIGNALS_SQL, B.LOUD_SQL, B.SHOTS_SQL, B.units_sql(p), B.features_sql(p)] + ([B.greedy_sql(p)] if choose else [])
    return "WITH RECURSIVE " + ",\n".join(parts)


def _raw(spark: SparkSession, sf_dir: str, preset: dict) -> DataFrame:
    return S.raw_features(_units(spark, sf_dir, preset), shots(spark, sf_dir), B.signals(spark, sf_dir), preset, B.N)


FEATURES = ["scene_length", "action", "speech", "laughter", "drama", "aesthetic", "interest"]


@query(f"WITH {B.SIGNALS_SQL} SELECT video_id, i, {', '.join(f'round({s}, 6) AS {s}' for s in FEATURES[1:])} FROM sig")
def zip_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.zipped_signals(spark, sf_dir).select("video_id", "i", *r6(*FEATURES[1:]))


@query(f"WITH {B.SIGNALS_SQL} SELECT video_id, i, {', '.join(f'round({s}, 6) AS {s}' for s in FEATURES[1:])} FROM sig")
def signal_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.signals(spark, sf_dir).select("video_id", "i", *r6(*FEATURES[1:]))


@query(_edit_sql(SHORT) + f" SELECT video_id, unit_seq, {', '.join(f'round({s}, 6) AS {s}' for s in FEATURES)} FROM rft")
def unit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, SHORT).select("video_id", "unit_seq", *r6(*FEATURES))


@query(_edit_sql(SHORT) + " SELECT video_id, unit_seq, round(score, 6) AS score FROM nft")
def unit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score(_raw(spark, sf_dir, SHORT), SHORT).select("video_id", "unit_seq", *r6("score"))


@query(f"""WITH {B.POINTS},\n{B.GRID},\n{B.channel_sql('c', where="event_type = 'click'")},\n{B.SHOTS_SQL},
met AS (SELECT h.video_id, h.shot_index, c.value FROM (SELECT *, unnest(range(least(start_ms * 4 // 1000, {B.N - 1}), least((end_ms - 1) * 4 // 1000, {B.N - 1}) + 1)) AS i FROM sht) h JOIN c ON c.video_id = h.video_id AND c.i = h.i)
SELECT video_id, shot_index, round(avg(value), 6) AS mean_value, {B.rank_sql('value', 0.9)} AS p90_value FROM met GROUP BY ALL""")
def interval_mean_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = shots(spark, sf_dir).withColumnsRenamed({"start_ms": "src_in_ms", "end_ms": "src_out_ms"})
    met = G.meet(S.unit_samples(spans, B.N), B.channel(spark, sf_dir, "click"), ["video_id", "i"])
    return met.groupBy("video_id", "shot_index").agg(F.round(F.avg("value"), 6).alias("mean_value"), A.floor_rank("value", 0.9).alias("p90_value"))


@query(f"""WITH {B.POINTS},\n{B.SHOTS_SQL}, p AS (SELECT * FROM ({dims.values_sql([(r[0], r[4], r[5]) for r in dims.PRESETS])}) t(preset_id, l, s))
SELECT video_id, shot_index, preset_id, round(exp(-((end_ms - start_ms - l)::DOUBLE * (end_ms - start_ms - l)::DOUBLE) / (2.0::DOUBLE * s::DOUBLE * s::DOUBLE)), 6) AS preference FROM sht, p""")
def length_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.broadcast(dims.presets(spark).select("preset_id", "avg_shot_ms", "sigma_ms"))  # six rows
    pref = gaussian(F.col("end_ms") - F.col("start_ms"), F.col("avg_shot_ms"), F.col("sigma_ms"))
    return shots(spark, sf_dir).crossJoin(p).select("video_id", "shot_index", "preset_id", F.round(pref, 6).alias("preference"))


@query(_edit_sql(SHORT) + f""" SELECT a.video_id, a.unit_seq, round(CASE WHEN a.n2 = 0 OR b.n2 = 0 THEN 0.0::DOUBLE ELSE least(greatest((dt(a, b)) / (sqrt(a.n2) * sqrt(b.n2)), 0.0::DOUBLE), 1.0::DOUBLE) END, 5) AS cos
FROM nft a JOIN nft b ON FALSE""".replace("dt(a, b)", " + ".join(f"a.{s} * b.{s}" for s in FEATURES)).replace("a.n2", "(" + " + ".join(f"a.{s} * a.{s}" for s in FEATURES) + ")").replace("b.n2", "(" + " + ".join(f"b.{s} * b.{s}" for s in FEATURES) + ")").replace("JOIN nft b ON FALSE", "JOIN nft b ON b.video_id = a.video_id AND b.unit_seq = a.unit_seq + 1"))
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each unit's features with the next unit's."""
    scored = S.score(_raw(spark, sf_dir, SHORT), SHORT)
    w = Window.partitionBy("video_id").orderBy("unit_seq")
    near = cosine([F.col(s) for s in FEATURES], [F.lead(s).over(w) for s in FEATURES])
    following = scored.select("video_id", "unit_seq", F.round(near, 5).alias("cos"), F.lead("unit_seq").over(w).alias("_next"))
    return following.where("_next IS NOT NULL").drop("_next")


@query(_edit_sql(SHORT) + f""", c AS (SELECT a.video_id, a.unit_seq, a.shot_index = b.shot_index AS same, ({' + '.join(f'a.{s} * b.{s}' for s in FEATURES)}) / (sqrt({' + '.join(f'a.{s} * a.{s}' for s in FEATURES)}) * sqrt({' + '.join(f'b.{s} * b.{s}' for s in FEATURES)})) AS q FROM nft a JOIN nft b ON b.video_id = a.video_id AND b.unit_seq = a.unit_seq + 1)
SELECT video_id, unit_seq, round(least(greatest(0.6::DOUBLE * least(greatest(coalesce(CASE WHEN isnan(q) THEN 0.0::DOUBLE ELSE q END, 0.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) + 0.4::DOUBLE * CAST(same AS INT), 0.0::DOUBLE), 1.0::DOUBLE), 5) AS sim FROM c""")
def unit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = S.score(_raw(spark, sf_dir, SHORT), SHORT)
    w = Window.partitionBy("video_id").orderBy("unit_seq")
    near = cosine([F.col(s) for s in FEATURES], [F.lead(s).over(w) for s in FEATURES])
    found = scored.select("video_id", "unit_seq", F.round(similarity(near, F.col("shot_index") == F.lead("shot_index").over(w)), 5).alias("sim"), F.lead("unit_seq").over(w).alias("_next"))
    return found.where("_next IS NOT NULL").drop("_next")


@query(UNITS_SQL["shortform"] + f", b AS (SELECT *, least(greatest((src_in_ms + src_out_ms) // 2 * 8 // {B.DURATION}, 0), 7) AS bucket FROM uni) SELECT video_id, unit_seq, bucket, CASE WHEN unit_seq = min(unit_seq) OVER (PARTITION BY video_id, bucket) THEN 0.125::DOUBLE ELSE 0.0::DOUBLE END AS coverage FROM b")
def timeline_bucket_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighth each unit lies in, and what it would add if units were taken in order."""
    b = units(spark, sf_dir).withColumn("bucket", timeline_bucket(F.col("src_in_ms"), F.col("src_out_ms"), F.lit(B.DURATION)).cast("bigint"))
    first = F.min("unit_seq").over(Window.partitionBy("video_id", "bucket"))
    return b.select("video_id", "unit_seq", "bucket", F.when(F.col("unit_seq") == first, 0.125).otherwise(0.0).alias("coverage"))


def _chosen(spark: SparkSession, sf_dir: str, preset: dict, variants: int = 1) -> DataFrame:
    return C.choose(S.score(_raw(spark, sf_dir, preset), preset), preset, B.DURATION, variants)


def edl(preset_id: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, ord, src_in_ms, src_out_ms, transition of a preset's edit."""
    p = dims.preset(preset_id)
    return C.arrange(_chosen(spark, sf_dir, p), p["ordering"], p["transition"]).drop("variant")


def _order_sql(ordering: str) -> str:
    return {
        "CHRONOLOGICAL": "src_in_ms, picked",
        "BUILD_TO_CLIMAX": "(action + drama + interest) / 3, picked",
        "HOOK_FIRST": "CASE WHEN picked = hook THEN 0 ELSE 1 END, src_in_ms, picked",
    }[ordering]


def _edl_sql(preset_id: str) -> str:
    p = dims.preset(preset_id)
    return (
        _edit_sql(p, True)
        + f""", hk AS (SELECT *, first_value(picked) OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, picked) AS hook FROM chs),
od AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {_order_sql(p['ordering'])}) - 1 AS ord FROM hk)
SELECT video_id, ord, src_in_ms, src_out_ms, CASE WHEN ord = 0 THEN 'HARD_CUT' ELSE '{p['transition']}' END AS transition FROM od"""
    )


for _p in dims.PRESETS:
    query(_edl_sql(_p[0]), f"edl_{_p[0]}")(partial(edl, _p[0]))


@query(_edit_sql(SHORT, True) + " SELECT video_id, unit_seq, picked AS pick_order FROM chs")
def greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir, SHORT).select("video_id", "unit_seq", "pick_order")


def _arranged(ordering: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.arrange(_chosen(spark, sf_dir, SHORT), ordering, "DISSOLVE").select("video_id", "ord", "src_in_ms", "src_out_ms", "transition")


for _o, _n in (("CHRONOLOGICAL", "arrange_chronological"), ("HOOK_FIRST", "arrange_hook_first"), ("BUILD_TO_CLIMAX", "arrange_climax")):
    query(
        _edit_sql(SHORT, True)
        + f""", hk AS (SELECT *, first_value(picked) OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, picked) AS hook FROM chs),
od AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {_order_sql(_o)}) - 1 AS ord FROM hk)
SELECT video_id, ord, src_in_ms, src_out_ms, CASE WHEN ord = 0 THEN 'HARD_CUT' ELSE 'DISSOLVE' END AS transition FROM od""",
        _n,
    )(partial(_arranged, _o))


def _variants_sql(p: dict, n: int) -> str:
    """CTEs ``chs_v0``, ``chs_v1``, ...: greedy choices one after the other, each from the units that earlier ones left."""
    parts = []
    for k in range(n):
        named = re.sub(r"\b(ini|grd2|walk|chs|st|nft)\b", lambda m, k=k: f"{m[1]}_v{k}", B.greedy_sql(p))
        left = "SELECT * FROM nft" + "".join(f" ANTI JOIN chs_v{j} USING (video_id, unit_seq)" for j in range(k))
        parts.append(f"nft_v{k} AS ({left}),\n{named}")
    return ",\n".join(parts)


@query(_edit_sql(SHORT) + ",\n" + _variants_sql(SHORT, 3) + f""",
alv AS ({' UNION ALL '.join(f'SELECT {k} AS variant, * FROM chs_v{k}' for k in range(3))}),
hk AS (SELECT *, first_value(picked) OVER (PARTITION BY video_id, variant ORDER BY round(score, 9) DESC, picked) AS hook FROM alv),
od AS (SELECT *, row_number() OVER (PARTITION BY video_id, variant ORDER BY {_order_sql(SHORT['ordering'])}) - 1 AS ord FROM hk)
SELECT video_id, variant, ord, src_in_ms, src_out_ms, CASE WHEN ord = 0 THEN 'HARD_CUT' ELSE '{SHORT['transition']}' END AS transition FROM od""")
def edit_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three edits per video, each from the units that earlier ones left."""
    return C.arrange(_chosen(spark, sf_dir, SHORT, 3), SHORT["ordering"], SHORT["transition"])


_OD = _edl_sql("shortform").rsplit("SELECT video_id, ord", 1)[0]


@query(_OD + "SELECT video_id, CAST(sum(src_out_ms - src_in_ms) AS BIGINT) AS total_ms, count(*) AS n_entries FROM od GROUP BY 1")
def edl_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edl("shortform", spark, sf_dir).groupBy("video_id").agg(F.sum(F.col("src_out_ms") - F.col("src_in_ms")).alias("total_ms"), F.count(F.lit(1)).alias("n_entries"))


@query(_OD + "SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY ord) - 1 AS ord, src_in_ms, src_out_ms FROM od WHERE ord <> 1")
def timeline_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.delete_entry(edl("shortform", spark, sf_dir), 1).select("video_id", "ord", "src_in_ms", "src_out_ms")


@query(_OD + """SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN n <= 3 THEN ord WHEN ord = 0 THEN 3 WHEN ord <= 3 THEN ord - 1 ELSE ord END) - 1 AS ord, src_in_ms, src_out_ms
FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM od)""")
def timeline_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.move_entry(edl("shortform", spark, sf_dir), 0, 3).select("video_id", "ord", "src_in_ms", "src_out_ms")


@query(_OD + """, cs AS (SELECT *, coalesce(sum(src_out_ms - src_in_ms) OVER (PARTITION BY video_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS out_start FROM od)
SELECT video_id, ord, src_in_ms, src_out_ms, CAST(out_start AS BIGINT) AS out_start_ms, CAST(out_start + src_out_ms - src_in_ms AS BIGINT) AS out_end_ms, 'reframe,crop,captions' AS effects, 'MP4' AS container, 'video/avc' AS video_mime, CAST(out_start % 30000 AS BIGINT) AS music_ms FROM cs""")
def render_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a renderer needs for each clip: the cut, its place in the output, effects, container, music position."""
    from cutloom.operators.timeline import render_plan

    return render_plan(edl("shortform", spark, sf_dir), "9:16", reframe=True, captions=True, container="MP4", music_ms=30000)
