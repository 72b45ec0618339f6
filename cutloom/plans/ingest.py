"""Queries of metadata rules, the model catalog, labels and reframing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom import dims
from cutloom.operators import catalog as K

from cutloom.operators import ingest as I
from cutloom.operators import reframe as R
from cutloom.plans import base as B
from cutloom.plans.editing import _OD, edl, r6
from cutloom.registry import query

PROBE = """prb AS (SELECT p_partkey AS video_id, p_size * 100 AS w, CAST(floor(p_retailprice) AS BIGINT) * 2 AS h, p_size * 90 - 1000 AS rot,
  CASE p_size % 7 WHEN 0 THEN 'video/avc' WHEN 1 THEN 'video/hevc' WHEN 2 THEN 'video/av01' WHEN 3 THEN 'video/x-vnd.on2.vp9' WHEN 4 THEN 'video/x-vnd.on2.vp8' WHEN 5 THEN 'video/mpeg' END AS mime,
  CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4096 ELSE 0 END AS prof, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 6.0::DOUBLE END AS fps, CASE WHEN p_size % 10 = 0 THEN NULL ELSE 24.0::DOUBLE END AS cap FROM part)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    pick = lambda m, values: F.get(F.array(*[F.lit(v) for v in values]), size % m)
    return B.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("video_id"), (size * 100).alias("w"), (F.floor("p_retailprice") * 2).alias("h"), (size * 90 - 1000).alias("rot"),
        pick(7, [*I.CODECS, "video/mpeg", None]).alias("mime"), pick(4, [1, 2, 4096, 0]).alias("prof"),
        F.when(size % 5 != 0, size * 6.0).alias("fps"), F.when(size % 10 != 0, F.lit(24.0)).alias("cap"),
    )


@query(f"WITH {PROBE} SELECT video_id, CAST(((rot % 360) + 360) % 360 AS BIGINT) AS rotation, coalesce(fps, cap, 30.0::DOUBLE) AS fps, CASE WHEN ((rot % 360) + 360) % 360 % 180 = 0 THEN w ELSE h END::BIGINT AS shown_w, CASE WHEN ((rot % 360) + 360) % 360 % 180 = 0 THEN h ELSE w END::BIGINT AS shown_h, CASE WHEN ((rot % 360) + 360) % 360 % 180 = 0 THEN h > w ELSE w > h END AS portrait FROM prb")
def probe_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = probes(spark, sf_dir).withColumn("rotation", I.normalized_rotation(F.col("rot")))
    w, h, portrait = I.oriented(F.col("w").cast("bigint"), F.col("h"), F.col("rotation"))
    return p.select("video_id", F.col("rotation").cast("bigint").alias("rotation"), I.frame_rate(F.col("fps"), F.col("cap")).alias("fps"), w.alias("shown_w"), h.alias("shown_h"), portrait.alias("portrait"))


@query(f"WITH {PROBE} SELECT video_id, CASE mime WHEN 'video/avc' THEN 'H264' WHEN 'video/hevc' THEN 'HEVC' WHEN 'video/av01' THEN 'AV1' WHEN 'video/x-vnd.on2.vp9' THEN 'VP9' WHEN 'video/x-vnd.on2.vp8' THEN 'VP8' ELSE 'OTHER' END AS codec, CASE WHEN prof = 2 OR prof >= 4096 THEN 10 ELSE 8 END AS depth FROM prb")
def codec_bit_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes(spark, sf_dir).select("video_id", I.codec_of(F.col("mime")).alias("codec"), I.bit_depth(F.col("prof")).alias("depth"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN -1 ELSE epoch_ms(date_trunc('second', o_orderdate)) + CASE WHEN o_orderkey % 4 = 0 THEN 250 ELSE 0 END END AS captured_ms FROM orders""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in the three patterns, and one that fits none (given as -1), parsed again."""
    d = F.col("o_orderdate").cast("timestamp")
    raw = F.get(F.array(F.date_format(d, "yyyyMMdd'T'HHmmss'.250Z'"), F.date_format(d, "yyyyMMdd'T'HHmmss'Z'"), F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.lit("yesterday")), (F.col("o_orderkey") % 4).cast("int"))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(I.parse_date(raw), F.lit(-1)).alias("captured_ms"))


@query(f"""WITH {PROBE}, c AS (SELECT *, CASE mime WHEN 'video/avc' THEN 'H264' WHEN 'video/hevc' THEN 'HEVC' WHEN 'video/av01' THEN 'AV1' WHEN 'video/x-vnd.on2.vp9' THEN 'VP9' WHEN 'video/x-vnd.on2.vp8' THEN 'VP8' ELSE 'OTHER' END AS codec, CASE WHEN prof = 2 OR prof >= 4096 THEN 10 ELSE 8 END AS depth, coalesce(mime IN ('video/avc', 'video/hevc', 'video/x-vnd.on2.vp9'), FALSE) AS dec FROM prb),
l AS (SELECT video_id, CASE WHEN codec = 'OTHER' OR mime IS NULL OR NOT dec THEN 'UNSUPPORTED' WHEN depth >= 10 OR greatest(w, h) > 4096 THEN 'CAUTION' ELSE 'OK' END AS level,
CASE WHEN codec = 'OTHER' OR mime IS NULL THEN 1 ELSE CAST(NOT dec AS INT) + CAST(depth >= 10 AS INT) + CAST(greatest(w, h) > 4096 AS INT) END AS reasons FROM c) SELECT *, level <> 'UNSUPPORTED' AS usable FROM l""")
def ingest_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decodable formats are a dimension that recordings are semi-joined with, case ignored."""
    support = F.broadcast(spark.createDataFrame([("Video/AVC",), ("video/hevc",), ("video/x-vnd.on2.VP9",)], "mime string").select(F.lower("mime").alias("mime"), F.lit(True).alias("dec")))
    p = probes(spark, sf_dir).join(support, "mime", "left").withColumn("dec", F.coalesce("dec", F.lit(False)))
    level, reasons, usable = I.risk(I.codec_of(F.col("mime")), F.col("mime"), F.col("dec"), I.bit_depth(F.col("prof")), F.col("w"), F.col("h"))
    return p.select("video_id", level.alias("level"), reasons.alias("reasons"), usable.alias("usable"))


@query(f"""WITH {PROBE}, q AS (SELECT video_id, w - 1500 AS w, h - 2000 AS h, fps FROM prb), s AS (SELECT *, CASE WHEN greatest(w, h) > 1280 THEN 1280.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS sc FROM q),
e AS (SELECT *, greatest(CAST(floor(w * sc + 0.5) AS BIGINT) & ~1::BIGINT, 2) AS pw, greatest(CAST(floor(h * sc + 0.5) AS BIGINT) & ~1::BIGINT, 2) AS ph, CASE WHEN fps BETWEEN 1 AND 240 THEN fps ELSE 30.0::DOUBLE END AS f FROM s)
SELECT video_id, CASE WHEN w <= 0 OR h <= 0 THEN 1280 ELSE pw END::BIGINT AS width, CASE WHEN w <= 0 OR h <= 0 THEN 720 ELSE ph END::BIGINT AS height, CASE WHEN w <= 0 OR h <= 0 THEN 4000000 ELSE least(greatest(CAST(trunc(pw * ph * f * 0.1::DOUBLE) AS BIGINT), 1500000), 8000000) END::BIGINT AS bitrate FROM e""")
def proxy_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, rate = I.proxy_spec(F.col("w") - 1500, F.col("h") - 2000, F.col("fps"))
    return probes(spark, sf_dir).select("video_id", w.cast("bigint").alias("width"), h.cast("bigint").alias("height"), rate.cast("bigint").alias("bitrate"))


ASPECTS = ["9:16", "16:9", "1:1", "2.39:1", " 4 : 5 ", "16-9", "16", "a:b", "0:1", "-1:2", "1:2:3", "", "nonsense"]


@query(f"""WITH a AS (SELECT * FROM ({dims.values_sql([(x,) for x in ASPECTS])}) t(spec)), p AS (SELECT spec, string_split(spec, ':') AS q FROM a), n AS (SELECT spec, len(q) AS c, TRY_CAST(trim(q[1]) AS DOUBLE) AS w, TRY_CAST(trim(q[2]) AS DOUBLE) AS h FROM p)
SELECT spec, CASE WHEN c = 2 AND w > 0 AND h > 0 THEN round(w / h, 6) END AS ratio, round(coalesce(CASE WHEN c = 2 AND w > 0 AND h > 0 THEN w / h END, 9 / 16::DOUBLE), 6) AS ratio_or_default FROM n""")
def aspect_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.createDataFrame([(x,) for x in ASPECTS], "spec string")
    ratio = I.parse_aspect(F.col("spec"))
    return a.select("spec", F.round(ratio, 6).alias("ratio"), F.round(F.coalesce(ratio, F.lit(I.DEFAULT_ASPECT)), 6).alias("ratio_or_default"))


@query(f"WITH {PROBE} SELECT video_id, (greatest(CASE WHEN w > 0 AND h > 0 THEN 160 * h // w ELSE 90 END, 2)::BIGINT & ~1::BIGINT) AS frame_h, greatest(CAST(floor(1000.0::DOUBLE / CASE WHEN fps BETWEEN 1 AND 240 THEN fps ELSE 30.0::DOUBLE END) AS BIGINT), 1) AS step_ms FROM prb")
def analysis_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes(spark, sf_dir).select("video_id", I.analysis_height(F.col("w"), F.col("h")).cast("bigint").alias("frame_h"), I.sampling_step(F.col("fps")).alias("step_ms"))


@query(f"WITH {B.POINTS} SELECT video_id, arg_min(t_ms, abs(t_ms - {B.DURATION // 2}) * 1000000 + t_ms) AS t_ms FROM pts GROUP BY 1")
def preview_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.preview_frame(B.points(spark, sf_dir).select("video_id", "t_ms", F.lit(B.DURATION).alias("duration_ms")))


@query("WITH t AS (SELECT l_orderkey AS video_id, l_linenumber * 1000000::BIGINT + l_partkey AS idx, CASE WHEN l_returnflag = 'A' THEN 'audio/mp4' ELSE 'video/' || lower(l_linestatus) END AS mime, l_quantity AS fps FROM lineitem) SELECT video_id, idx, mime, fps FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx, mime, fps) AS rn FROM t WHERE starts_with(mime, 'video/')) WHERE rn = 1")
def first_video_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.when(F.col("l_returnflag") == "A", "audio/mp4").otherwise(F.concat(F.lit("video/"), F.lower("l_linestatus")))
    t = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") * F.lit(1000000).cast("bigint") + F.col("l_partkey")).alias("idx"), mime.alias("mime"), F.col("l_quantity").alias("fps"))
    return I.first_video_track(t)


MODELS_SQL = f"mdl AS (SELECT * FROM ({dims.values_sql([(k, *m) for k, m in enumerate(dims.MODELS)])}) t(pos, id, name, feature, runtime, size_mb, license, min_ram_mb, prefers_npu, recommended, downloadable))"
DEVICES_SQL = "dev AS (SELECT c_custkey AS device_id, (c_custkey % 14 * 1000)::INTEGER AS ram_mb, CASE WHEN c_custkey % 3 = 0 THEN ['x86_64'] ELSE ['arm64-v8a', 'armeabi-v7a'] END AS abis FROM customer)"
INSTALLED_SQL = "ins AS (SELECT device_id, id FROM dev, mdl WHERE (device_id * 7 + pos * 3) % 5 = 0)"


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    abis = F.when(key % 3 == 0, F.array(F.lit("x86_64"))).otherwise(F.array(F.lit("arm64-v8a"), F.lit("armeabi-v7a")))
    return B.table(spark, sf_dir, "customer").select(key.alias("device_id"), (key % 14 * 1000).cast("int").alias("ram_mb"), abis.alias("abis"))


def _installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _devices(spark, sf_dir).select("device_id").crossJoin(F.broadcast(dims.models(spark).select("id", "pos")))
    return both.where((F.col("device_id") * 7 + F.col("pos") * 3) % 5 == 0).select("device_id", "id")


RUN = "run AS (SELECT device_id, id, feature, pos FROM dev JOIN mdl ON list_contains(abis, 'arm64-v8a') AND ram_mb >= min_ram_mb)"


@query(f"WITH {MODELS_SQL}, {DEVICES_SQL}, {RUN} SELECT device_id, id FROM run")
def model_runnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.runnable(_devices(spark, sf_dir), dims.models(spark)).select("device_id", "id")


@query(f"WITH {MODELS_SQL}, {DEVICES_SQL}, {RUN} SELECT DISTINCT device_id, feature FROM run")
def features_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.available_features(_devices(spark, sf_dir), dims.models(spark))


ESSENTIAL_VALUES = dims.values_sql([(k, e) for k, e in enumerate(dims.ESSENTIALS)])


@query(f"WITH {MODELS_SQL}, {DEVICES_SQL}, {RUN}, {INSTALLED_SQL}, ess AS (SELECT * FROM ({ESSENTIAL_VALUES}) t(essential_pos, id)) SELECT r.device_id, r.id, e.essential_pos FROM run r JOIN ess e USING (id) JOIN mdl m ON m.id = r.id AND m.downloadable WHERE NOT EXISTS (SELECT 1 FROM ins i WHERE i.device_id = r.device_id AND i.id = r.id)")
def essentials_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.missing_essentials(_devices(spark, sf_dir), dims.models(spark), _installed(spark, sf_dir), K.essentials(spark))


@query(f"WITH {MODELS_SQL}, {DEVICES_SQL}, {INSTALLED_SQL} SELECT DISTINCT device_id, feature FROM ins JOIN mdl USING (id)")
def features_unlocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.unlocked_features(dims.models(spark), _installed(spark, sf_dir))


@query(f"WITH {MODELS_SQL}, {DEVICES_SQL}, {INSTALLED_SQL}, ft AS (SELECT * FROM ({dims.values_sql(list(enumerate(dims.FEATURES)))}) t(pos, feature)), m AS (SELECT device_id, f.feature, row_number() OVER (PARTITION BY device_id ORDER BY f.pos) AS nth FROM dev CROSS JOIN ft f WHERE NOT EXISTS (SELECT 1 FROM ins i JOIN mdl d USING (id) WHERE i.device_id = dev.device_id AND d.feature = f.feature)) SELECT device_id, feature, nth - 1 AS place FROM m WHERE nth <= 4")
def features_missing_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four features a device has no model for: what a hint shows."""
    every = _devices(spark, sf_dir).select("device_id").crossJoin(F.broadcast(dims.features(spark)))
    left = every.join(K.unlocked_features(dims.models(spark), _installed(spark, sf_dir)), ["device_id", "feature"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("device_id").orderBy("pos"))
    return left.withColumn("nth", nth).where("nth <= 4").select("device_id", "feature", (F.col("nth") - 1).cast("bigint").alias("place"))


@query(f"WITH {MODELS_SQL} SELECT feature, id FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY recommended DESC, pos) AS rn FROM mdl) WHERE rn = 1")
def model_recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.recommended(dims.models(spark))


@query(f"""WITH {MODELS_SQL}, {DEVICES_SQL}, {INSTALLED_SQL}, prf AS (SELECT device_id, unnest(['off', 'auto', 'whisper-base-q5', 'unknown']) AS pref FROM dev),
h AS (SELECT device_id, list(id) AS ids, arg_max(id, pos) AS lst, max(CASE WHEN id = 'whisper-small-q5' THEN id END) AS best FROM ins JOIN mdl USING (id) WHERE feature = 'AUTO_CAPTIONS' GROUP BY 1)
SELECT p.device_id, pref, CASE WHEN pref <> 'off' THEN coalesce(CASE WHEN list_contains(ids, pref) THEN pref END, best, lst) END AS model_id FROM prf p LEFT JOIN h ON h.device_id = p.device_id""")
def speech_model_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = _devices(spark, sf_dir).select("device_id", F.explode(F.array(*map(F.lit, ("off", "auto", "whisper-base-q5", "unknown")))).alias("pref"))
    return K.resolve_speech_model(choices, dims.models(spark), _installed(spark, sf_dir))


PATHS = ["ggml-base-q5_1.bin", "ggml-base.en.bin", "ggml-small.bin", "GGML-SMALL.EN.bin", "ggml-tiny.bin", "ggml-medium.en.bin", "ggml-large-v3-turbo.bin", "ggml-large-v3.bin", "ggml-large-v2.bin", "ggml-large.bin", "other.bin"]


@query(f"""WITH p AS (SELECT path, lower(path) AS n FROM ({dims.values_sql([(x,) for x in PATHS])}) t(path)) SELECT path, CASE WHEN contains(n, 'large-v3-turbo') THEN 'LARGE_V3_TURBO' WHEN contains(n, 'large-v3') THEN 'LARGE_V3' WHEN contains(n, 'large-v2') THEN 'LARGE_V2' WHEN contains(n, 'large') THEN 'LARGE_V1'
WHEN contains(n, 'medium') THEN 'MEDIUM' || CASE WHEN contains(n, '.en') THEN '_EN' ELSE '' END WHEN contains(n, 'small') THEN 'SMALL' || CASE WHEN contains(n, '.en') THEN '_EN' ELSE '' END WHEN contains(n, 'base') THEN 'BASE' || CASE WHEN contains(n, '.en') THEN '_EN' ELSE '' END WHEN contains(n, 'tiny') THEN 'TINY' || CASE WHEN contains(n, '.en') THEN '_EN' ELSE '' END ELSE 'NONE' END AS preset FROM p""")
def alignment_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in PATHS], "path string").select("path", K.alignment_preset(F.col("path")).alias("preset"))


@query("SELECT o_orderkey, least(greatest(CAST(ceil(((o_totalprice * 2) / 16000.0::DOUBLE / 30.0::DOUBLE * 1500.0::DOUBLE + 128.0::DOUBLE) / 64.0::DOUBLE) * 64 AS BIGINT), 768), 1500) AS audio_ctx FROM orders")
def audio_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "orders").select("o_orderkey", K.audio_context(F.col("o_totalprice") * 2).cast("bigint").alias("audio_ctx"))


@query("SELECT doc_id, trim(lang) <> '' AND NOT starts_with(lower(lang), 'en') AND n_chars > 100 AS translate FROM documents")
def translation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", K.wants_translation(F.col("lang"), F.when(F.col("n_chars") > 100, 1).otherwise(0)).alias("translate"))


@query(f"SELECT preset_id, least(greatest(CAST(floor((mx / 1000.0::DOUBLE) / (av / 1000.0::DOUBLE) + 0.5) AS BIGINT), 4), 20) AS ticks, captions FROM ({dims.values_sql([(r[0], r[2], r[4], r[21]) for r in dims.PRESETS])}) t(preset_id, mx, av, captions)")
def pacing_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.presets(spark).select("preset_id", K.pacing_ticks(F.col("max_ms"), F.col("avg_shot_ms")).cast("bigint").alias("ticks"), "captions")


@query("""WITH b AS (SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) AS ms, CAST(floor(o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 100000 ELSE 0 END) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, printf('%d:%02d.%d', ms // 1000 // 60, ms // 1000 % 60, ms % 1000 // 100) AS clock, printf('%d:%02d', ms // 1000 // 60, ms // 1000 % 60) AS duration, CASE WHEN n >= 1000000000 THEN '1' WHEN n >= 1000000 THEN '2' WHEN n <= 0 THEN '3' ELSE '4' END AS size_class FROM b""")
def formatters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.floor(F.col("o_totalprice") * 100)
    n = F.floor(F.col("o_totalprice") * F.get(F.array(F.lit(1), F.lit(1000), F.lit(100000), F.lit(0)), (F.col("o_orderkey") % 4).cast("int")))
    label = K.bytes_label(n)
    kind = F.when(label.endswith("GB"), "1").when(label.endswith("MB"), "2").when(label == "—", "3").otherwise("4")
    return B.table(spark, sf_dir, "orders").select("o_orderkey", K.clock_label(ms).alias("clock"), K.duration_label(ms).alias("duration"), kind.alias("size_class"))


@query("SELECT page_id, sha256(html) AS digest, CASE WHEN contains(string_split(url, '/')[-1], '.') THEN string_split(url, '/')[-1] ELSE page_id || '.model' END AS file FROM pages")
def sha256_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"), K.file_name(F.col("url"), F.col("page_id").cast("string")).alias("file"))


@query(f"WITH {MODELS_SQL}, {DEVICES_SQL} SELECT device_id, printf('%d GB RAM · %s · %s', CAST(floor(ram_mb / 1024.0::DOUBLE + 0.5) AS BIGINT), abis[1], CASE WHEN ram_mb >= 8000 THEN 'flagship' ELSE 'standard' END) AS summary FROM dev")
def device_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _devices(spark, sf_dir).select("device_id", K.device_summary(F.col("ram_mb"), F.col("abis")).alias("summary"))


@query(f"WITH {MODELS_SQL} SELECT id, string_split(name, ' (')[1] AS short_name FROM mdl")
def model_short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.models(spark).select("id", K.short_name(F.col("name")).alias("short_name"))


@query(_OD + "SELECT video_id, ord, printf('%02d', ord + 1) || '  ' || printf('%d:%02d.%d', src_in_ms // 60000, src_in_ms // 1000 % 60, src_in_ms % 1000 // 100) || ' → ' || printf('%d:%02d.%d', src_out_ms // 60000, src_out_ms // 1000 % 60, src_out_ms % 1000 // 100) AS label FROM od")
def edl_row_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.substring_index(K.row_label(F.col("ord"), F.col("src_in_ms"), F.col("src_out_ms")), "  ", 2)
    return edl("shortform", spark, sf_dir).select("video_id", "ord", label.alias("label"))


# A subject per event: where it is and how large, from the event's value and k.
TARGETS = B.SERIES + """, trg AS (SELECT video_id, i, t_ms / 1000.0::DOUBLE AS t_sec, value / 490 AS cx, coalesce(k, 0) % 100 / 100 AS cy, 0.05::DOUBLE + value / 600 AS size FROM ser)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.series(spark, sf_dir)
    return s.select("video_id", "i", (F.col("t_ms") / 1000.0).alias("t_sec"), (F.col("value") / 490).alias("cx"), (F.coalesce("k", F.lit(0.0)) % 100 / 100).alias("cy"), (F.lit(0.05) + F.col("value") / 600).alias("size"))


def _cuts_sec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cuts(spark, sf_dir).select("video_id", (F.col("cut_ms") / 1000.0).alias("cut_sec"))


_A = "(1.0::DOUBLE / (1.0::DOUBLE + 1.0::DOUBLE / (2 * pi() * ({fc})) / {dt}))"


@query(f"""WITH {TARGETS}, a AS (SELECT video_id, list({{'x': cx, 't': t_sec}} ORDER BY i) AS xs FROM trg GROUP BY 1),
f AS (SELECT video_id, list_reduce(list_transform(xs, lambda q: {{'x': q.x, 't': q.t, 'v': 0.0::DOUBLE, 'o': CAST([] AS DOUBLE[])}}), lambda s, q: CASE WHEN len(s.o) = 0 THEN {{'x': q.x, 't': q.t, 'v': 0.0::DOUBLE, 'o': [q.x]}} ELSE
  list_transform([CASE WHEN q.t - s.t > 1e-6 THEN q.t - s.t ELSE 1e-3::DOUBLE END], lambda dt: list_transform([{_A.format(fc='1.0::DOUBLE', dt='dt')} * (q.x - s.x) / dt + (1 - {_A.format(fc='1.0::DOUBLE', dt='dt')}) * s.v], lambda v:
    list_transform([{_A.format(fc='1.0::DOUBLE + 0.007::DOUBLE * abs(v)', dt='dt')} * q.x + (1 - {_A.format(fc='1.0::DOUBLE + 0.007::DOUBLE * abs(v)', dt='dt')}) * s.x], lambda e: {{'x': e, 't': q.t, 'v': v, 'o': list_append(s.o, e)}})[1])[1])[1] END,
  {{'x': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 'o': CAST([] AS DOUBLE[])}}).o AS o FROM a)
SELECT video_id, j - 1 AS i, round(o[j], 6) AS value FROM (SELECT *, unnest(range(1, len(o) + 1)) AS j FROM f)""")
def one_euro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.one_euro(targets(spark, sf_dir).select("video_id", "i", "t_sec", F.col("cx").alias("value"))).select("video_id", "i", *r6("value"))


def _euro_sql(rows: str, value: str, name: str) -> str:
    """The filter along the struct list ``rows`` (t and values in order), as a list."""
    weight = lambda cutoff: _A.format(fc=cutoff, dt="dt")
    speed, smooth = weight("1.0::DOUBLE"), weight("1.0::DOUBLE + 0.007::DOUBLE * abs(v)")
    return f"""list_reduce(list_transform({rows}, lambda q: {{'x': q.{value}, 't': q.t, 'v': 0.0::DOUBLE, 'o': CAST([] AS DOUBLE[])}}), lambda s, q: CASE WHEN len(s.o) = 0 THEN {{'x': q.x, 't': q.t, 'v': 0.0::DOUBLE, 'o': [q.x]}} ELSE
  list_transform([CASE WHEN q.t - s.t > 1e-6 THEN q.t - s.t ELSE 1e-3::DOUBLE END], lambda dt: list_transform([{speed} * (q.x - s.x) / dt + (1 - {speed}) * s.v], lambda v:
    list_transform([{smooth} * q.x + (1 - {smooth}) * s.x], lambda e: {{'x': e, 't': q.t, 'v': v, 'o': list_append(s.o, e)}})[1])[1])[1] END,
  {{'x': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 'o': CAST([] AS DOUBLE[])}}).o AS {name}"""


def _reach_sql(value: str, name: str) -> str:
    """Places along the struct list ``ps`` that move at most half the frame a second, as a list."""
    reach = "0.5::DOUBLE * greatest(q.t - s.t, 1e-3::DOUBLE)"
    return f"""list_reduce(list_transform(ps, lambda q: {{'x': q.{value}, 't': q.t, 'o': CAST([] AS DOUBLE[])}}), lambda s, q: list_transform([least(greatest(CASE WHEN len(s.o) = 0 THEN q.x ELSE least(greatest(q.x, s.x - {reach}), s.x + {reach}) END, 0.0::DOUBLE), 1.0::DOUBLE)],
  lambda e: {{'x': e, 't': q.t, 'o': list_append(s.o, e)}})[1], {{'x': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'o': CAST([] AS DOUBLE[])}}).o AS {name}"""


@query(f"""WITH {TARGETS}, c AS (SELECT video_id, t_ms / 1000.0::DOUBLE AS cut_sec FROM pts WHERE event_type = 'purchase'),
e AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM trg) WHERE n >= 2),
s AS (SELECT e.*, (SELECT count(*) FROM c WHERE c.video_id = e.video_id AND c.cut_sec <= e.t_sec) AS segment FROM e),
a AS (SELECT video_id, segment, list({{'t': t_sec, 'i': i, 'x': cx, 'y': cy, 'z': size}} ORDER BY t_sec, i) AS xs FROM s GROUP BY ALL),
f AS (SELECT video_id, xs, {_euro_sql('xs', 'x', 'fx')}, {_euro_sql('xs', 'y', 'fy')}, {_euro_sql('xs', 'z', 'fz')} FROM a),
r AS (SELECT video_id, xs[j].t AS t, xs[j].i AS i, fx[j] AS x, fy[j] AS y, fz[j] AS z FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS j FROM f)),
w AS (SELECT video_id, list({{'t': t, 'i': i, 'x': x, 'y': y, 'z': z}} ORDER BY t, i) AS ps FROM r GROUP BY 1),
g AS (SELECT video_id, ps, {_reach_sql('x', 'gx')}, {_reach_sql('y', 'gy')} FROM w)
SELECT video_id, ps[j].i AS i, round(ps[j].t, 6) AS t_sec, round(gx[j], 6) AS cx, round(gy[j], 6) AS cy, round(least(greatest(ps[j].z, 0.1::DOUBLE), 1.0::DOUBLE), 6) AS size FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM g)""")
def crop_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.crop_trajectory(targets(spark, sf_dir), _cuts_sec(spark, sf_dir)).select("video_id", "i", *[F.round(c, 6).alias(c) for c in ("t_sec", "cx", "cy", "size")])


@query(f"""WITH {TARGETS}, k AS (SELECT video_id, t_sec, max(cx) AS cx FROM trg GROUP BY ALL), q AS (SELECT video_id, unnest(range(0, 260, 10))::DOUBLE AS at_sec FROM vids),
b AS (SELECT q.video_id, q.at_sec, max(k.t_sec) FILTER (WHERE k.t_sec <= q.at_sec) AS ta, min(k.t_sec) FILTER (WHERE k.t_sec > q.at_sec) AS tb FROM q JOIN k ON k.video_id = q.video_id GROUP BY ALL)
SELECT b.video_id, b.at_sec, round(CASE WHEN ta IS NULL THEN y.cx WHEN tb IS NULL THEN x.cx ELSE x.cx + (y.cx - x.cx) * (at_sec - ta) / (tb - ta) END, 6) AS cx FROM b LEFT JOIN k x ON x.video_id = b.video_id AND x.t_sec = b.ta LEFT JOIN k y ON y.video_id = b.video_id AND y.t_sec = b.tb""")
def crop_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes looked up between their times, at every ten seconds."""
    k = targets(spark, sf_dir).groupBy("video_id", "t_sec").agg(F.max("cx").alias("cx")).select("video_id", "t_sec", "cx", F.lit(0.5).alias("cy"), F.lit(0.5).alias("size"))
    times = B.videos(spark, sf_dir).select("video_id", F.explode(F.sequence(F.lit(0), F.lit(250), F.lit(10))).alias("s")).select("video_id", F.col("s").cast("double").alias("at_sec"))
    return R.sample_at(k, times).select("video_id", "at_sec", *r6("cx"))


@query(f"WITH {TARGETS}, s AS (SELECT DISTINCT video_id, t_sec FROM trg), c AS (SELECT video_id, t_ms / 1000.0::DOUBLE AS cut_sec FROM pts WHERE event_type = 'purchase') SELECT s.video_id, s.t_sec, (SELECT count(*) FROM c WHERE c.video_id = s.video_id AND c.cut_sec <= s.t_sec) AS segment FROM s")
def crop_cut_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cut_segments(targets(spark, sf_dir).select("video_id", "t_sec").distinct(), _cuts_sec(spark, sf_dir))


@query(f"WITH {TARGETS} SELECT video_id, i, 1.15::DOUBLE AS scale, round(least(greatest(-(cx * 2 - 1), -0.15::DOUBLE), 0.15::DOUBLE), 6) + 0.0::DOUBLE AS tx, round(least(greatest(-(1 - cy * 2) * 0.5::DOUBLE, -0.1::DOUBLE), 0.1::DOUBLE), 6) + 0.0::DOUBLE AS ty FROM trg")
def reframe_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale, tx, ty = R.reframe_params(F.col("cx"), F.col("cy"))
    return targets(spark, sf_dir).select("video_id", "i", scale.alias("scale"), (F.round(tx, 6) + 0.0).alias("tx"), (F.round(ty, 6) + 0.0).alias("ty"))


@query(_OD + ", f AS (SELECT video_id, ord, src_in_ms, unnest(range(0, (src_out_ms - src_in_ms) * 1000, 400000)) AS pts_us FROM od) SELECT video_id, ord, pts_us, src_in_ms + pts_us // 1000 AS src_ms FROM f")
def entry_frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.entry_frames(edl("shortform", spark, sf_dir), 400000)


