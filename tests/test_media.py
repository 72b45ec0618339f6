"""Sound, frames, faces, crops, captions, binary scans, sources and streams on small exact inputs."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutloom import dims
from cutloom.functions import adapters as M
from cutloom.operators import audio as U
from cutloom.operators import captions as C
from cutloom.operators import catalog as K
from cutloom.operators import curves as V
from cutloom.operators import frames as P
from cutloom.operators import ingest as I
from cutloom.operators import reframe as R
from cutloom.operators import transcript as T
from cutloom.sources import binary as S
from cutloom.sources import media

WORDS = "video_id bigint, seq bigint, text string, start_ms bigint, end_ms bigint"


def words(spark, *ws):
    return spark.createDataFrame([(1, k, *w) for k, w in enumerate(ws)], WORDS)


def pcm(spark, samples):
    return spark.createDataFrame([(1, i, int(x)) for i, x in enumerate(samples)], "video_id bigint, i bigint, value bigint")


def test_rms(spark):
    assert {r.rms for r in U.windows(pcm(spark, [0] * 4000), 16000, 50).collect()} == {0.0}
    tone = (16000 * np.sin(2 * np.pi * 440 * np.arange(4000) / 16000)).astype(int)
    assert U.windows(pcm(spark, tone), 16000, 50).agg(F.avg("rms")).first()[0] > 0.1
    assert U.windows(pcm(spark, [5] * 850), 16000, 50).count() == 1  # the rest of a window is dropped


def test_speech(spark):
    rng = np.random.default_rng(1)
    quiet_loud = np.concatenate([rng.normal(0, 100, 8000), rng.normal(0, 9000, 8000)])
    got = [r.value for r in U.speech_curve(pcm(spark, quiet_loud), 16000).orderBy("i").collect()]
    assert np.mean(got[: len(got) // 2]) < np.mean(got[len(got) // 2 :])
    assert U.speech_curve(pcm(spark, [0] * 3200), 16000).agg(F.avg("value")).first()[0] < 0.3


def test_frames():
    blue, red = np.zeros((18, 32, 3), np.uint8), np.zeros((18, 32, 3), np.uint8)
    blue[..., 2], red[..., 0] = 200, 220
    frames = [blue] * 20 + [np.roll(red // (1 + k % 2), k, 0) for k in range(20)]
    got = P.samples_of(frames)
    assert got[0][:2] == (0.0, 0.0) and got[20][0] > 27
    assert np.mean([g[1] for g in got[21:]]) > np.mean([g[1] for g in got[:20]])
    checker = np.repeat(((np.indices((18, 32)).sum(0) % 2) * 255).astype(np.uint8)[..., None], 3, -1)
    gray = np.full((18, 32, 3), 128, np.uint8)
    sharp = P.samples_of([checker])[0][2], P.samples_of([gray])[0][2]
    assert sharp[0] > sharp[1] == 0.0
    assert P.samples_of([red])[0][3] > P.samples_of([gray])[0][3]


def test_frame_pass_equals_pixel_form(spark):
    rng = np.random.default_rng(2)
    frames = [rng.integers(0, 256, (5, 6, 3), dtype=np.uint8) for _ in range(3)]
    d = spark.createDataFrame([(1, i, i / 4, 6, 5, bytearray(f.tobytes())) for i, f in enumerate(frames)], "video_id bigint, i bigint, t_sec double, width int, height int, rgb binary")
    one = P.frame_samples(d).orderBy("i").collect()
    pix = spark.createDataFrame([(1, i, x, y, *map(int, f[y, x])) for i, f in enumerate(frames) for y in range(5) for x in range(6)], "video_id bigint, i bigint, x bigint, y bigint, r bigint, g bigint, b bigint")
    diff = P.frame_diff(pix).orderBy("i").collect()
    sharp = P.sharpness(pix).orderBy("i").collect()
    color = P.colorfulness(pix).orderBy("i").collect()
    for a, b, c, d in zip(one, diff, sharp, color, strict=True):
        assert (a.content, a.motion, a.sharpness, a.colorfulness) == pytest.approx((b.content, b.motion, c.sharpness, d.colorfulness))


def test_faces(spark):
    box = lambda *b: spark.createDataFrame([(1, k, *map(float, x)) for k, x in enumerate(b)], "video_id bigint, k bigint, left double, top double, right double, bottom double")
    big, small = (M.face_frames(box(b), 160, 90).first() for b in ((50, 20, 110, 80), (0, 0, 16, 12)))
    assert big.score > small.score and abs(big.cx - 0.5) < 0.05
    assert M.face_frames(box((0, 0, 10, 10), (60, 30, 120, 80)), 160, 90).first().cx > 0.4


@pytest.mark.parametrize(("buckets", "want"), [([0.1] * 10, 0.55), ([0.0] * 9 + [1.0], 1.0), ([1.0] + [0.0] * 9, 0.1), ([0.2] * 10, 0.55), ([], 0.0)])
def test_mean_opinion(spark, buckets, want):
    d = spark.createDataFrame([(buckets,)], "b array<double>")
    assert d.select(M.mean_opinion(F.col("b"))).first()[0] == pytest.approx(want)


def test_adapters(spark):
    assert M.windows_of(np.arange(600, dtype=np.float32)).shape == (2, 576)
    assert [len(b) for b in M.batches_of(list(range(150)))] == [100, 100] and M.batches_of(list(range(150)))[1][-1] == 149
    assert M.preprocess_image(np.zeros((4, 4, 3), np.uint8)).shape == (3, 4, 4)
    d = spark.createDataFrame([(0.25,)], "x double")
    assert d.select(M.scorer("none", F.lit(0.5), F.col("x"))).first()[0] == 0.5
    M.register_scorer("double", lambda: lambda s: s * 2)
    assert d.select(M.scorer("double", F.lit(0.5), F.col("x"))).first()[0] == 0.5
    M.register_scorer("triple", lambda: lambda s: s * 3)
    assert d.select(M.scorer("triple", F.lit(9.9), F.col("x"))).first()[0] == 0.75


def test_one_euro():
    f = R.OneEuro(1, 0.01)
    assert all(abs(f(0.7, k * 0.033) - 0.7) < 1e-3 for k in range(51))
    g = R.OneEuro(1, 0)
    g(0, 0)
    assert 0 < g(1, 0.033) < 1


TARGET = "video_id bigint, i bigint, t_sec double, cx double, cy double, size double"


def test_trajectory(spark):
    jitter = [(1, k, k / 10, 0.5 + (0.02 if k % 2 else -0.02), 0.5, 0.3) for k in range(31)]
    jump = [(2, 0, 0.0, 0.1, 0.5, 0.3), (2, 1, 0.1, 0.9, 0.5, 0.3), (3, 0, 0.0, 0.1, 0.5, 0.3)]
    cut = [(4, 0, 0.0, 0.5, 0.5, 0.3), (4, 1, 0.1, 0.5, 0.5, 0.05), (4, 2, 0.2, 0.5, 0.5, 0.9), (4, 3, 0.3, 0.5, 0.5, 0.9)]
    d = spark.createDataFrame(jitter + jump + cut, TARGET)
    cuts = spark.createDataFrame([(4, 0.15), (4, 0.0), (9, 1.0)], "video_id bigint, cut_sec double")
    got = {}
    for r in R.crop_trajectory(d, cuts).orderBy("video_id", "i").collect():
        got.setdefault(r.video_id, []).append(r)
    assert len(got[1]) == 31 and max(abs(r.cx - 0.5) for r in got[1][5:]) < 0.02
    assert abs(got[2][1].cx - got[2][0].cx) <= 0.05 + 1e-6 and 3 not in got
    # After a cut the size starts from its own sample; before it, it lags behind, and it is never under a tenth.
    assert got[4][2].size == 0.9 and got[4][1].size > 0.1 and min(r.size for r in got[4]) >= 0.1
    assert R.crop_trajectory(d.where("false"), cuts).count() == 0


def test_crop_lookup(spark):
    k = spark.createDataFrame([(1, 0.0, 0.2, 0.5, 0.5), (1, 2.0, 0.8, 0.5, 0.5)], "video_id bigint, t_sec double, cx double, cy double, size double")
    t = spark.createDataFrame([(1, 1.0), (1, -1.0), (1, 9.0), (2, 1.0)], "video_id bigint, at_sec double")
    got = {r.at_sec: r.cx for r in R.sample_at(k, t).collect()}
    assert got == pytest.approx({1.0: 0.5, -1.0: 0.2, 9.0: 0.8})


def test_reframe(spark):
    d = spark.createDataFrame([(0.5, 0.5), (1.0, 0.5), (0.0, 0.5)], "cx double, cy double")
    _, tx, ty = R.reframe_params(F.col("cx"), F.col("cy"))
    got = d.select(tx, ty).collect()
    assert got[0][0] == got[0][1] == 0 and -0.15 <= got[1][0] < 0 < got[2][0]


def test_rising_edges_start_anew_in_each_window(spark):
    p = spark.createDataFrame([(1, i, 0.9 if i in (99, 100) else 0.0) for i in range(120)], "video_id bigint, i bigint, value double")
    assert sorted(r.i for r in V.rising_edges(p).collect()) == [99, 100]


def test_transcript(spark):
    w = words(spark, ("Hello", 0, 400), ("um", 450, 700), ("world", 750, 1200))
    assert [tuple(r) for r in T.filler_intervals(w).collect()] == [(1, 450, 700)]
    w = words(spark, ("Hello.", 0, 400), ("And", 1200, 1400), ("then", 1450, 1700))
    assert 400 in [r.end_at for r in T.sentence_ends(w).collect()]
    assert [tuple(r)[1:] for r in T.silence_gaps(words(spark, ("a", 0, 500), ("b", 2000, 2500))).collect()] == [(500, 2000)]
    c = T.sentence_candidates(words(spark, ("Hello.", 0, 400), ("How", 500, 700), ("are", 750, 900), ("you?", 950, 1200))).orderBy("idx").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in c] == [("Hello.", 0, 400), ("How are you?", 500, 1200)]
    empty = spark.createDataFrame([], WORDS)
    assert not T.filler_intervals(empty).count() and not T.sentence_ends(empty).count() and not T.sentence_candidates(empty).count()


def test_tsv(spark):
    raw = lambda s: spark.createDataFrame([(1, s)], "video_id bigint, raw string")
    assert T.parse_tsv(raw("hello\t0\t400\nthere\t450\t800\n")).count() == 2
    assert [r.text for r in T.parse_tsv(raw("ok\t10\t20\nbad-line\nneg\t100\t50\n\tmissing\t1\t2\n")).collect()] == ["ok"]
    assert T.parse_tsv(raw("  ")).count() == 0


def test_replies(spark):
    for reply, want in (('"Big Day Out"', "Big Day Out"), ("Title: My Trip\nextra", "My Trip"), ("\n\n  *Sendai*  ", "Sendai"), ("", "")):
        d = spark.createDataFrame([(reply,)], "r string")
        assert d.select(T.parse_title(F.col("r"))).first()[0] == want
    d = spark.createDataFrame([(1, "Here are picks:\n2 | funny reaction\n[5]: great quote\n7 - the drop\nnonsense line")], "video_id bigint, reply string")
    got = T.parse_hooks(d).orderBy("pos").collect()
    assert [r.idx for r in got] == [2, 5, 7] and got[0].reason == "funny reaction"


def test_captions(spark):
    chunk = lambda *ws: C.caption_chunks(words(spark, *ws)).orderBy("chunk_idx").collect()
    ten = chunk(*[(f"w{k}", k * 350, k * 350 + 300) for k in range(10)])
    assert all(r.n_words <= 4 for r in ten) and sum(r.n_words for r in ten) == 10
    assert [r.text for r in chunk(("hello", 0, 300), ("there", 320, 600), ("friend", 2000, 2300))] == ["hello there", "friend"]
    assert chunk(("Stop.", 0, 300), ("Now", 350, 600), ("go", 650, 900))[0].text == "Stop."
    assert [(r.start_ms, r.end_ms) for r in chunk(("a", 0, 300), ("b", 350, 650))] == [(0, 650)]
    assert C.caption_chunks(spark.createDataFrame([], WORDS)).count() == 0


def test_subtitles(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, 1000, 2500, "one"), (1, 1, 3661000, 3662000, "two")], "video_id bigint, chunk_idx bigint, start_ms bigint, end_ms bigint, text string")
    srt, vtt = C.subtitles(d, "srt").first().body, C.subtitles(d, "vtt").first().body
    assert srt.startswith("1\n00:00:01,000 --> 00:00:02,500\none\n\n2\n01:01:01,000 --> 01:01:02,000")
    assert vtt.startswith("WEBVTT\n\n00:00:01.000 --> 00:00:02.500\none")
    C.write_subtitles(C.subtitles(d, "srt"), str(tmp_path / "srt"))
    assert next((tmp_path / "srt" / "video_id=1").glob("part-*")).read_text() == srt


def record(key, kind, size, repeat, body):
    return key + kind + struct.pack(">BH", size, repeat) + body + bytes(-len(body) % 4)


def stream(scale, kind=b"s"):
    scal = record(b"SCAL", kind, 2, 1, struct.pack(">h", scale))
    accl = record(b"ACCL", b"s", 6, 2, struct.pack(">6h", 3, 0, 4, 0, 0, 0))
    return record(b"DEVC", b"\0", 1, len(x := record(b"STRM", b"\0", 1, len(scal + accl), scal + accl)), x)


def test_telemetry_records(spark):
    rows = spark.createDataFrame([(1, bytearray(stream(1))), (2, bytearray(b"short")), (3, None)], "video_id bigint, bytes binary")
    paths = [r.path for r in S.klv_nodes(rows).collect()]
    assert paths == ["/DEVC", "/DEVC/STRM", "/DEVC/STRM/SCAL", "/DEVC/STRM/ACCL"]
    from cutloom.operators.telemetry import magnitudes

    found = S.acceleration_rows(rows).withColumn("axes", F.col("axes").cast("int")).select(magnitudes("values", "axes", "scale")).first()[0]
    assert found == [5.0, 0.0]
    assert S.accelerations(stream(0))[0][2] == 1.0 and S.accelerations(stream(2, b"f"))[0][2] == 1.0
    assert list(S.klv(stream(1)[:20])) == []


def box(kind, body, wide=False):
    return (struct.pack(">I4sQ", 1, kind, len(body) + 16) if wide else struct.pack(">I4s", len(body) + 8, kind)) + body


def test_boxes_and_marks():
    payload = struct.pack(">4I", 3, 2500, 1000, 8000)
    moov = box(b"moov", box(b"mvhd", bytes(12)) + box(b"udta", box(b"HMMT", payload)))
    assert S.marks(moov) == [1000, 2500, 8000]
    assert S.marks(box(b"free", b"x" * 40, wide=True) + moov) == [1000, 2500, 8000]  # a 64-bit box before it
    assert S.find_box(moov, "moov/udta/none") is None
    assert S.marks(box(b"moov", box(b"udta", box(b"HMMT", struct.pack(">2I", 99, 7))))) == [7]


def test_sources(spark, tmp_path):
    media.register(spark)
    data = struct.pack("<8h", 3, 4, -3, -4, 100, 101, 0, 0)
    fmt = struct.pack("<HHIIHH", 1, 2, 16000, 64000, 4, 16)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data
    (tmp_path / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    (tmp_path / "b.wav").write_bytes(b"none")
    got = {r.file: (r.sample_rate, r.samples) for r in spark.read.format("wav").load(str(tmp_path)).collect()}
    assert got == {"a.wav": (16000, [3, -3, 100, 0]), "b.wav": (0, [])}
    times = [0, 100, 200, 300, 600]
    (tmp_path / "f.rgb").write_bytes(struct.pack("<III", 2, 1, 5) + struct.pack("<5q", *times) + bytes(range(30)))
    frames = spark.read.format("rgbframes").option("stepMs", "250").load(str(tmp_path)).orderBy("i").collect()
    assert [r.t_ms for r in frames] == [0, 300, 600] and bytes(frames[1].rgb) == bytes(range(18, 24))
    media.write_vectors(str(tmp_path / "v.bin"), np.array([[3.0, 4.0], [0.0, 2.0]]))
    v = spark.read.format("vectors").load(str(tmp_path / "v.bin")).orderBy("prompt").collect()
    assert v[0].v == pytest.approx([0.6, 0.8]) and v[1].v == [0.0, 1.0]
    assert media.strip_row_padding(b"abXcdX", 2, 2, 1, 3) == b"abcd"
    assert media.rgb_of_argb(np.array([0xFF102030])) == bytes([0x10, 0x20, 0x30])


@pytest.mark.parametrize(("w", "h", "fps", "want"), [(3840, 2160, 30.0, (1280, 720)), (2160, 3840, 30.0, (720, 1280)), (640, 360, 30.0, (640, 360)), (0, 0, 30.0, (1280, 720))])
def test_proxy(spark, w, h, fps, want):
    d = spark.createDataFrame([(w, h, fps)], "w int, h int, f double")
    a, b, rate = d.select(*I.proxy_spec(F.col("w"), F.col("h"), F.col("f"))).first()
    assert (a, b) == want and 1_500_000 <= rate <= 8_000_000


def test_catalog(spark):
    got = {(r.device_id, r.id) for r in K.runnable(dims.devices(spark), dims.models(spark)).collect()}
    assert not any(d == 1 for d, _ in got)
    assert (2, "silero-vad") in got and (2, "whisper-base-q5") in got and (2, "whisper-small-q5") not in got and (3, "whisper-small-q5") in got
    features = {(r.device_id, r.feature) for r in K.available_features(dims.devices(spark), dims.models(spark)).collect()}
    assert (2, "AUTO_CAPTIONS") in features and (3, "SEMANTIC_SELECTION") in features
    ins = spark.createDataFrame([(1, "yamnet"), (1, "whisper-base-q5")], "device_id int, id string")
    assert {r.feature for r in K.unlocked_features(dims.models(spark), ins).collect()} == {"LAUGHTER_DETECTION", "AUTO_CAPTIONS"}
    assert len({m[0] for m in dims.MODELS}) == len(dims.MODELS) and {m[2] for m in dims.MODELS} == set(dims.FEATURES)
    files = spark.createDataFrame([("/m/yamnet.tflite", 5), ("/m/other.bin", 7)], "path string, length bigint")
    assert [tuple(r) for r in K.installed_models(files, dims.models(spark)).collect()] == [("yamnet", 5)]


def test_digest(spark):
    assert spark.range(1).select(F.sha2(F.lit("abc"), 256)).first()[0].startswith("ba7816bf")


def test_telemetry_of_any_depth(spark):
    from cutloom.sources import binary as Y

    data = b"LEAF" + b"l" + bytes([4]) + (1).to_bytes(2, "big") + (7).to_bytes(4, "big")
    depth = 1500
    for _ in range(depth):
        data = b"NEST" + b"\0" + bytes([1]) + len(data).to_bytes(2, "big") + data
    nodes = list(Y.klv(data))
    assert len(nodes) == depth + 1 and nodes[-1][0].endswith("/LEAF")
    rows = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"x")), ("c", None)], "video_id string, bytes binary")
    got = Y.klv_nodes(rows)
    assert got.count() == depth + 1 and {r.video_id for r in got.select("video_id").collect()} == {"a"}


def test_sql_surface(spark):
    from cutloom.sources import tables

    tables.register(spark)
    box = (16).to_bytes(4, "big") + b"ftyp" + b"12345678"
    node = b"LEAF" + b"l" + bytes([4]) + (1).to_bytes(2, "big") + (7).to_bytes(4, "big")
    srt = "1\n00:00:01,500 --> 00:00:02,000\nHello\nthere\n\n2\n01:00:00,000 --> 01:00:01,250\nBye\n"
    spark.createDataFrame([(1, bytearray(box), bytearray(node), srt)], "id int, media binary, telemetry binary, subtitles string").createOrReplaceTempView("files")
    assert [tuple(r) for r in spark.sql("SELECT b.* FROM files f, LATERAL mp4_boxes(f.media) b").collect()] == [("ftyp", 8, 0, 16)]
    assert [tuple(r) for r in spark.sql("SELECT n.path, n.repeat FROM files f, LATERAL gpmf_nodes(f.telemetry) n").collect()] == [("/LEAF", 1)]
    assert [tuple(r) for r in spark.sql("SELECT s.* FROM files f, LATERAL srt_lines(f.subtitles) s ORDER BY cue").collect()] == [(0, 1500, 2000, "Hello\nthere"), (1, 3600000, 3601250, "Bye")]
    r = spark.sql("SELECT clamped(3, 0, 1) a, robust(5, 0, 10) b, robust(5, 1, 1) c, round(length_preference(2000, 2000, 500), 6) d, timecode(3661001, ',') e").first()
    assert tuple(r) == (1.0, 0.5, 0.5, 1.0, "01:01:01,001")


def test_files_through_binary_file(spark, tmp_path):
    """Sound in blocks, frames and vectors from any storage that Spark reads."""
    import struct
    import wave

    import numpy as np

    from cutloom.sources import media as Q

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(np.array([[k, k + 1] for k in range(100)], "<i2").tobytes())
    (tmp_path / "bad.wav").write_bytes(b"none")
    rows = Q.read_wav(spark, str(tmp_path), block=30).orderBy("start").collect()
    assert [(r.file, r.sample_rate, r.start, len(r.samples)) for r in rows] == [("a.wav", 16000, k, min(30, 100 - k)) for k in range(0, 100, 30)]
    assert [x for r in rows for x in r.samples] == list(range(100))
    frames = struct.pack("<III", 2, 1, 3) + struct.pack("<3q", 0, 100, 300) + bytes(range(18))
    (tmp_path / "v.rgb").write_bytes(frames)
    assert [(r.i, r.t_ms, bytes(r.rgb)) for r in Q.read_frames(spark, str(tmp_path)).orderBy("i").collect()] == [(0, 0, bytes(range(6))), (1, 300, bytes(range(12, 18)))]
    for name in ("x.vec", "y.vec"):
        Q.write_vectors(str(tmp_path / name), np.eye(2, 3))
    got = Q.read_vectors(spark, str(tmp_path), "*.vec").collect()
    assert sorted((r.file, r.prompt) for r in got) == [("x.vec", 0), ("x.vec", 1), ("y.vec", 0), ("y.vec", 1)] and len(got[0].v) == 3


def test_installed_models_from_a_listing(spark, tmp_path):
    from cutloom import dims
    from cutloom.operators import catalog

    (tmp_path / "yamnet.tflite").write_bytes(b"12345")
    (tmp_path / "unknown.bin").write_bytes(b"1")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = catalog.installed_models(files.select("path", "length"), dims.models(spark)).collect()
    assert [(r.id, r.bytes) for r in got] == [("yamnet", 5)]


def test_progress(spark):
    from cutloom.streaming import progress as P

    told = []
    bands = P.Bands(lambda stage, at: told.append((stage, round(at, 3))))
    assert bands.tell("analysis", 0.5) == 0.25 and bands.tell("analysis", 2.0) == 0.5
    rows, seen = P.watched(spark.range(40), "rows")
    rows.write.format("noop").mode("overwrite").save()
    assert P.tell_when_done(seen, 80, bands, "transcription") == pytest.approx(0.725)
    assert bands.tell("analysis", 0.1) == pytest.approx(0.725) and bands.tell("title", 1.0) == 1.0 and told[-1] == ("title", 1.0)
    assert P.Bands(lambda *_: None, with_words=False).tell("analysis", 0.5) == 0.5


def test_folds_start_anew_for_each_key(spark):
    from cutloom.operators.folds import scan

    def begin():
        total = 0

        def step(x):
            nonlocal total
            total += x
            return total

        return step

    d = spark.range(1000).selectExpr("id % 7 AS video_id", "id DIV 7 AS i", "1L AS x").repartition(5)
    got = scan(d, ["i"], ["x"], begin, "n", "bigint")
    assert got.where("n <> i + 1").count() == 0 and got.count() == 1000
    assert scan(d.where("false"), ["i"], ["x"], begin, "n", "bigint").count() == 0


def test_text_rules(spark):
    from cutloom.operators import transcript as T

    replies = ["\tTitle: My clip\r\n", " \r\n\n'Second'\r", "", None, "Title:   \u00a0\n** x **"]
    d = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "id int, reply string")
    assert {r.id: r.t for r in d.select("id", T.parse_title(d.reply).alias("t")).collect()} == {0: "My clip", 1: "Second", 2: "", 3: "", 4: "x"}
    raw = "a\t1\t2\r\nb\t 5\t6\n\tc\t7\t8\rd \t+9\t10\n\t\t\ne\t3\t2\nf\t1\t2\t3"
    got = T.parse_tsv(spark.createDataFrame([(1, raw)], "video_id bigint, raw string")).orderBy("seq").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in got] == [("a", 1, 2), ("d", 9, 10)]
