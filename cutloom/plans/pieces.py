"""Queries of the small pieces: prompts, fallbacks, sorted marks, joined lists, arrays and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom import dims
from cutloom.functions import arrays as A
from cutloom.plans import base as B
from cutloom.plans.editing import UNITS_SQL, units
from cutloom.registry import query


@query("""WITH t AS (SELECT conv_id, turn, list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: len(w)) AS ids FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN list_prepend(49406, ids) WHEN turn % 3 = 1 THEN list_append(ids, 49407) ELSE [] END AS ids FROM t),
o AS (SELECT conv_id, turn, CASE WHEN ids[1] = 49406 THEN ids ELSE list_prepend(49406, ids) END AS ids FROM b),
c AS (SELECT conv_id, turn, list_resize(CASE WHEN ids[-1] = 49407 THEN ids ELSE list_append(ids, 49407) END, 77, 0) AS ids FROM o)
SELECT conv_id, turn, pos, ids[pos + 1]::BIGINT AS id FROM (SELECT *, unnest(range(77)) AS pos FROM c)""")
def prompt_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of 77 places: some begun already, some ended, some empty."""
    ids = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w: F.length(w))
    turn = F.col("turn") % 3
    given = F.when(turn == 0, F.concat(F.array(F.lit(A.BEGIN)), ids)).when(turn == 1, F.concat(ids, F.array(F.lit(A.END)))).otherwise(F.array().cast("array<int>"))
    rows = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(A.padded_prompt(given)).alias("at", "id"))
    return rows.select("conv_id", "turn", F.col("at").cast("bigint").alias("pos"), F.col("id").cast("bigint").alias("id"))


@query(f"""WITH {B.POINTS}, l AS (SELECT DISTINCT video_id, t_ms AS cut_ms FROM pts WHERE event_type = 'error' AND video_id % 2 = 0), c AS (SELECT DISTINCT video_id, t_ms AS cut_ms FROM pts WHERE event_type = 'purchase')
SELECT video_id, cut_ms, 'learned' AS source FROM l UNION ALL SELECT video_id, cut_ms, 'classical' FROM c WHERE video_id NOT IN (SELECT video_id FROM l)""")
def cuts_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned cuts where a video has any, else the classical ones."""
    p = B.points(spark, sf_dir)
    cuts = lambda kind, name: p.where(F.col("event_type") == kind).select("video_id", F.col("t_ms").alias("cut_ms"), F.lit(name).alias("source")).distinct()
    return A.first_given(cuts("error", "learned").where("video_id % 2 = 0"), cuts("purchase", "classical"))


@query(f"""WITH {B.POINTS}, m AS (SELECT video_id, list_sort(list(t_ms)) AS ms FROM pts WHERE event_type = 'signup' GROUP BY 1)
SELECT video_id, pos, ms[pos + 1] AS mark_ms, ms[len(ms) - pos] AS from_end_ms, coalesce(ms[pos + 3], -1) AS two_on_ms FROM (SELECT *, unnest(range(least(len(ms), 5))) AS pos FROM m)""")
def marks_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five marks of each video in order, beside them those from the end and those two places on (-1 if there is none)."""
    got = B.points(spark, sf_dir).where("event_type = 'signup'").groupBy("video_id").agg(F.array_sort(F.collect_list("t_ms")).alias("ms"))
    z = F.arrays_zip(F.slice("ms", 1, 5).alias("a"), F.slice(F.reverse("ms"), 1, 5).alias("b"), F.transform(F.slice("ms", 1, 5), lambda _, k: F.coalesce(F.get("ms", k + 2), F.lit(-1))).alias("c"))
    return got.select("video_id", F.posexplode(z).alias("at", "z")).select("video_id", F.col("at").cast("bigint").alias("pos"), F.col("z.a").alias("mark_ms"), F.col("z.b").alias("from_end_ms"), F.col("z.c").alias("two_on_ms"))


@query(UNITS_SQL["shortform"] + """, l AS (SELECT video_id, list({'a': src_in_ms, 'b': src_out_ms} ORDER BY unit_seq) AS us FROM uni GROUP BY 1),
j AS (SELECT video_id, CASE WHEN len(us) >= 2 THEN list_append(us[1:len(us) - 2], {'a': us[-2].a, 'b': us[-1].b}) ELSE us END AS us FROM l)
SELECT video_id, pos AS ord, us[pos + 1].a AS src_in_ms, us[pos + 1].b AS src_out_ms FROM (SELECT *, unnest(range(len(us))) AS pos FROM j)""")
def units_merged_at_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of each video with the last two made one."""
    got = units(spark, sf_dir).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("unit_seq", "src_in_ms", "src_out_ms"))).alias("us"))
    one = A.merge_last_two(F.col("us"), lambda x, y: F.struct(x["unit_seq"].alias("unit_seq"), x["src_in_ms"].alias("src_in_ms"), y["src_out_ms"].alias("src_out_ms")))
    return got.select("video_id", F.posexplode(one).alias("at", "u")).select("video_id", F.col("at").cast("bigint").alias("ord"), "u.src_in_ms", "u.src_out_ms")


@query(f"""WITH p AS (SELECT * FROM ({dims.values_sql([(r[0], r[4]) for r in dims.PRESETS])}) t(preset_id, avg_ms)), m AS (SELECT map_from_entries(list((preset_id, avg_ms))) AS avg_of FROM p),
k AS (SELECT p_partkey, coalesce((SELECT list(preset_id ORDER BY preset_id) FROM p)[p_size % 9 + 1], 'none') AS preset_id FROM part)
SELECT p_partkey, preset_id, coalesce(element_at(avg_of, preset_id)[1], 0)::BIGINT AS avg_shot_ms, coalesce(len(element_at(avg_of, preset_id)) > 0, FALSE) AS known FROM k, m""")
def preset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets as a map, met by keys that are partly unknown; those get 0."""
    names = sorted(r[0] for r in dims.PRESETS)
    avg_of = F.create_map(*[F.lit(x) for r in dims.PRESETS for x in (r[0], r[4])])
    key = F.coalesce(F.get(F.array(*map(F.lit, names)), F.col("p_size") % 9), F.lit("none"))
    rows = B.table(spark, sf_dir, "part").select("p_partkey", key.alias("preset_id"))
    return rows.select("p_partkey", "preset_id", F.coalesce(F.try_element_at(avg_of, F.col("preset_id")), F.lit(0)).cast("bigint").alias("avg_shot_ms"), F.map_contains_key(avg_of, F.col("preset_id")).alias("known"))
