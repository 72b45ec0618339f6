"""Fixed dimensions: presets, features, models, codecs. Small by definition, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SIGNALS = ["scene_length", "action", "speech", "laughter", "drama", "aesthetic", "interest"]

# The presets.
PRESET_COLUMNS = (
    "preset_id string, min_ms bigint, max_ms bigint, aspect string, avg_shot_ms bigint, sigma_ms bigint, min_unit_ms bigint, max_unit_ms bigint, "
    "ordering string, w_scene_length double, w_action double, w_speech double, w_laughter double, w_drama double, w_aesthetic double, w_interest double, "
    "diversity double, coverage double, quality_floor double, beat_sync boolean, transition string, captions boolean"
)
PRESETS = [
    ("shortform", 15000, 45000, "9:16", 1200, 900, 500, 3000, "HOOK_FIRST", 0.0, 0.20, 0.30, 0.15, 0.10, 0.05, 0.20, 0.6, 0.15, 0.18, True, "HARD_CUT", True),
    ("cine", 30000, 60000, "2.39:1", 4500, 2500, 1500, 8000, "BUILD_TO_CLIMAX", 0.25, 0.05, 0.05, 0.0, 0.20, 0.35, 0.10, 0.4, 0.25, 0.22, False, "DISSOLVE", False),
    ("promo", 15000, 30000, "9:16", 1800, 1200, 1000, 5000, "HOOK_FIRST", 0.05, 0.20, 0.10, 0.05, 0.10, 0.20, 0.30, 0.5, 0.20, 0.20, True, "HARD_CUT", True),
    ("vlog", 45000, 90000, "16:9", 2800, 1600, 1000, 6000, "CHRONOLOGICAL", 0.15, 0.15, 0.15, 0.10, 0.05, 0.25, 0.15, 0.5, 0.30, 0.18, True, "HARD_CUT", True),
    ("action", 20000, 40000, "16:9", 1000, 800, 400, 3000, "BUILD_TO_CLIMAX", 0.0, 0.40, 0.0, 0.0, 0.15, 0.10, 0.35, 0.6, 0.20, 0.20, True, "SPEED_RAMP", False),
    ("talkinghead", 30000, 60000, "9:16", 3500, 1500, 1000, 7000, "HOOK_FIRST", 0.10, 0.0, 0.45, 0.10, 0.15, 0.05, 0.15, 0.45, 0.15, 0.16, False, "HARD_CUT", True),
]

# Optional models (id, name, feature, runtime, size in MiB, license, RAM floor, prefers NPU, recommended, downloadable).
MODEL_COLUMNS = "pos int, id string, name string, feature string, runtime string, size_mb int, license string, min_ram_mb int, prefers_npu boolean, recommended boolean, downloadable boolean"
MODELS = [
    ("whisper-base-q5", "Whisper base (captions)", "AUTO_CAPTIONS", "GGML", 57, "MIT", 3000, False, False, True),
    ("whisper-small-q5", "Whisper small (recommended)", "AUTO_CAPTIONS", "GGML", 182, "MIT", 6000, True, True, True),
    ("silero-vad", "Silero VAD", "ROBUST_VAD", "ONNX", 2, "MIT", 2000, False, False, True),
    ("yamnet", "YAMNet audio events", "LAUGHTER_DETECTION", "MEDIAPIPE_TASK", 4, "Apache-2.0", 2000, False, False, True),
    ("clip-iqa", "CLIP-IQA aesthetic (recommended)", "AESTHETIC_SCORING", "ONNX", 89, "MIT", 4000, False, True, True),
    ("nima-mobilenet", "NIMA aesthetic", "AESTHETIC_SCORING", "TFLITE", 5, "MIT", 3000, False, False, False),
    ("blazeface-short", "Face detector", "FACE_TRACKING", "MEDIAPIPE_TASK", 1, "Apache-2.0", 2000, False, False, True),
    ("face-landmarker", "Face landmarks + blendshapes", "FACE_TRACKING", "MEDIAPIPE_TASK", 4, "Apache-2.0", 3000, False, False, True),
    ("efficientdet-lite0", "Object detector", "SMART_REFRAME", "MEDIAPIPE_TASK", 7, "Apache-2.0", 3000, False, False, True),
    ("pose-landmarker-lite", "Pose landmarks", "POSE_ACTION", "MEDIAPIPE_TASK", 3, "Apache-2.0", 3000, False, False, True),
    ("movinet-a0-stream", "MoViNet action", "POSE_ACTION", "TFLITE", 5, "Apache-2.0", 4000, True, False, False),
    ("transnetv2", "TransNetV2 shot cuts", "SCENE_ML", "ONNX", 31, "MIT", 4000, False, True, True),
    ("wav2small", "Speech arousal", "SPEECH_EMOTION", "ONNX", 1, "research", 2000, False, False, False),
    ("gemini-nano", "Gemini Nano (on-device LLM)", "SEMANTIC_SELECTION", "SYSTEM", 0, "OEM", 6000, True, False, False),
    ("gemma3-1b", "Gemma 3 1B (on-device LLM)", "SEMANTIC_SELECTION", "MEDIAPIPE_LLM", 555, "Gemma", 6000, True, False, False),
]
# Models offered first, in this order; the features in their order.
ESSENTIALS = ["whisper-small-q5", "clip-iqa", "silero-vad", "yamnet", "blazeface-short"]
FEATURES = [
    "AUTO_CAPTIONS", "ROBUST_VAD", "LAUGHTER_DETECTION", "AESTHETIC_SCORING", "FACE_TRACKING",
    "SMART_REFRAME", "POSE_ACTION", "SCENE_ML", "SPEECH_EMOTION", "SEMANTIC_SELECTION",
]
# Words that a transcript can do without.
FILLERS = ["um", "uh", "umm", "uhh", "er", "ah", "hmm", "mhm", "like", "uhm"]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, PRESET_COLUMNS)


def preset(preset_id: str) -> dict:
    """One preset as a dict; an unknown id is an error."""
    names = [c.split()[0] for c in PRESET_COLUMNS.split(", ")]
    for row in PRESETS:
        if row[0] == preset_id:
            return dict(zip(names, row, strict=True))
    raise KeyError(preset_id)


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *m) for k, m in enumerate(MODELS)], MODEL_COLUMNS)


def features(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(FEATURES)), "pos int, feature string")


def devices(spark: SparkSession) -> DataFrame:
    """Example devices, as the tests of capability rules use them."""
    return spark.createDataFrame([(1, 12000, ["x86_64"]), (2, 4000, ["arm64-v8a"]), (3, 12000, ["arm64-v8a", "armeabi-v7a"])], "device_id int, ram_mb int, abis array<string>")


def values_sql(rows: list[tuple]) -> str:
    """Rows as a SQL VALUES list."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, float):
            return f"{x!r}::DOUBLE"
        return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
