"""The editing engine on hand-made recordings: budget, order, words, variants, percentiles, ties."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutloom import dims
from cutloom.operators import grid as G
from cutloom.operators import score as S
from cutloom.operators import select as C
from cutloom.operators import shots as H
from cutloom.operators import stats as A
from cutloom.operators import transcript as T

BASE = {"action": 0.1, "speech": 0.1, "laughter": 0.05, "loudness": 0.3, "drama": 0.1, "aesthetic": 0.3, "interest": 0.1}


def edit(spark, preset_id, duration, shot_ms, hot, words=None, variants=1):
    """Entries (variant, ord, start, end) for constant channels with hot spans (channel, from s, to s, value)."""
    n = duration * 4 // 1000
    values = {c: [v] * n for c, v in BASE.items()}
    for c, a, b, v in hot:
        values[c][a * 4 : b * 4] = [v] * (min(b * 4, n) - a * 4)
    p = dims.preset(preset_id)
    signals = spark.createDataFrame([(1, i, *[float(values[c][i]) for c in BASE]) for i in range(n)], "video_id bigint, i bigint, " + ", ".join(f"{c} double" for c in BASE))
    bounds = [*range(0, duration, shot_ms), duration]
    shots = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))], "video_id bigint, shot_index bigint, start_ms bigint, end_ms bigint")
    loud = signals.select("video_id", "i", F.col("loudness").alias("value"))
    w = spark.createDataFrame(words, "video_id bigint, seq bigint, text string, start_ms bigint, end_ms bigint") if words else None
    units = H.segment(shots, loud, p, n, w, T.sentence_ends(w) if words else None)
    scored = S.score(S.raw_features(units, shots, signals, p, n), p)
    edl = C.arrange(C.choose(scored, p, duration, variants), p["ordering"], p["transition"])
    return sorted((r.variant, r.ord, r.src_in_ms, r.src_out_ms) for r in edl.collect())


def test_budget_is_kept(spark):
    e = edit(spark, "shortform", 60000, 10000, [("interest", 20, 28, 0.95)])
    assert e and sum(b - a for *_, a, b in e) <= 45000


def test_spike_is_chosen(spark):
    e = edit(spark, "promo", 60000, 10000, [("interest", 30, 38, 0.95), ("action", 30, 38, 0.9)])
    assert any(a < 38000 and b > 30000 for *_, a, b in e)


def test_chronological(spark):
    e = edit(spark, "vlog", 90000, 10000, [("aesthetic", 0, 90, 0.6), ("interest", 10, 14, 0.9), ("action", 60, 66, 0.9)])
    assert [a for *_, a, _ in e] == sorted(a for *_, a, _ in e)


def test_hook_first(spark):
    e = edit(spark, "shortform", 60000, 10000, [("speech", 50, 58, 0.95), ("interest", 50, 58, 0.95)])
    assert any(a < e[0][2] for *_, a, _ in e[1:])


def test_no_cut_inside_a_word(spark):
    words = [(1, k, f"w{k}", k * 500, k * 500 + 450) for k in range(24)]
    e = edit(spark, "shortform", 12000, 12000, [("interest", 2, 10, 0.9)], words)
    inner = {x for *_, a, b in e for x in (a, b)} - {0, 12000}
    assert not any(s < x < t for x in inner for _, _, _, s, t in words)


def test_presets_differ(spark):
    hot = [("speech", 10, 18, 0.95), ("aesthetic", 40, 50, 0.95), ("action", 40, 50, 0.2)]
    assert {x[2:] for x in edit(spark, "shortform", 60000, 10000, hot)} != {x[2:] for x in edit(spark, "cine", 60000, 10000, hot)}


def test_short_source(spark):
    e = edit(spark, "shortform", 8000, 4000, [("interest", 0, 8, 0.4)])
    assert sum(b - a for *_, a, b in e) <= 8000


def test_variants_are_disjoint(spark):
    e = edit(spark, "shortform", 120000, 10000, [("interest", 5, 14, 0.9), ("action", 40, 50, 0.9), ("aesthetic", 80, 95, 0.9)], variants=3)
    assert len({v for v, *_ in e}) >= 2
    assert len({x[2:] for x in e}) == len(e)


def test_floor_rank(spark):
    d = spark.createDataFrame([(float(x),) for x in range(1, 11)], "x double")
    assert d.agg(A.floor_rank("x", 0.9), A.floor_rank("x", 0.95), A.floor_rank("x", 0.05)).first()[:] == (9.0, 9.0, 1.0)


def test_flat_channel_is_one_half(spark):
    d = spark.createDataFrame([(1, k, 0.7) for k in range(5)], "video_id bigint, i bigint, value double")
    assert {r.value for r in A.normalize(d, ["video_id"], ["value"]).collect()} == {0.5}


def _greedy(start, end, shot, score, preset="shortform", total=60000):
    n = len(start)
    return C.greedy(np.array(start), np.array(end), np.array(shot), np.eye(7)[np.arange(n) % 7], np.array(score, float), dims.preset(preset), total, np.ones(n, bool))


def test_tie_goes_to_the_earlier_unit():
    assert _greedy([0, 30000], [2000, 32000], [0, 1], [0.5, 0.5])[0] == 0


def test_first_pick_may_exceed_the_budget():
    assert _greedy([0], [100000], [0], [0.9], total=100000) == [0]


def test_greedy_without_units():
    assert _greedy([], [], [], []) == []


@pytest.mark.parametrize(("cuts", "want"), [([5000, 8000], [(0, 5000), (5000, 8000), (8000, 10000)]), ([-1000, 0, 5000, 5000, 99000], [(0, 5000), (5000, 10000)]), ([], [(0, 10000)])])
def test_shots(spark, cuts, want):
    videos = spark.createDataFrame([(1,)], "video_id bigint")
    c = spark.createDataFrame([(1, x) for x in cuts], "video_id bigint, cut_ms bigint")
    got = H.shots_from_cuts(c, videos, 10000).collect()
    assert sorted((r.start_ms, r.end_ms) for r in got) == want


def test_telemetry_grid(spark):
    v = spark.createDataFrame([(1,)], "video_id bigint")
    p = spark.createDataFrame([(1, 0, 1.0), (1, 5000, 0.5)], "video_id bigint, t_ms bigint, value double")
    got = [r.value for r in G.to_grid(p, v, 10, 10000).orderBy("i").collect()]
    assert got == [1.0] * 5 + [0.5] * 5
    m = spark.createDataFrame([(1, 5000)], "video_id bigint, mark_ms bigint")
    k = [r.value for r in G.highlight_curve(m, v, 10, 10000, 1000).orderBy("i").collect()]
    assert k[5] == 1 and k[5] > k[4] and k[0] == 0
    empty = spark.createDataFrame([], "video_id bigint, t_ms bigint, value double")
    assert {r.value for r in G.to_grid(empty, v, 10, 10000).collect()} == {0.0}


def test_move_and_delete(spark):
    e = spark.createDataFrame([(1, k, k * 10, k * 10 + 5) for k in range(4)], "video_id bigint, ord bigint, src_in_ms bigint, src_out_ms bigint")
    order = lambda d: [r.src_in_ms for r in d.orderBy("ord").collect()]
    assert order(C.move_entry(e, 0, 2)) == [10, 20, 0, 30]
    assert order(C.move_entry(e, 3, 1)) == [0, 30, 10, 20]
    assert order(C.move_entry(e, 0, 9)) == [0, 10, 20, 30]
    assert order(C.delete_entry(e, 1)) == [0, 20, 30]


def test_unknown_preset():
    with pytest.raises(KeyError):
        dims.preset("nonsense")
    assert all(abs(sum(r[9:16]) - 1) < 1e-9 for r in dims.PRESETS)


def test_joins_that_grow_with_recordings_are_no_broadcasts(spark, sf):
    """The planner takes exploded and gathered rows for small; broadcast, they fill the driver's memory."""
    from cutloom.plans import base as B
    from cutloom.plans import editing as E
    from cutloom.plans import signals as D

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (E.boost_fuse(spark, sf), E.interval_mean_p90(spark, sf), E.units_cine(spark, sf), E.greedy_select(spark, sf), E.edl("cine", spark, sf), D.duck_raw(spark, sf), B.zipped_signals(spark, sf)):
        assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" in plan(df)


def test_queries_of_whole_edits_hold_no_broadcasts(spark, sf):
    """The same of the queries on scores, choices and edits."""
    from cutloom.plans import editing as E
    from cutloom.plans import ingest as I

    for of in (E.edit_variants, E.edl_duration, E.timeline_delete, E.unit_score, E.cosine_similarity, I.entry_frame_times, I.edl_row_labels):
        plan = of(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan, of
