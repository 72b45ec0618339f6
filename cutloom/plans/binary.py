"""Queries of binary scans, over blobs that a rule makes of table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.operators.telemetry import magnitudes
from cutloom.plans import base as B
from cutloom.registry import query
from cutloom.sources import binary as S


def _be(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2 * size, "0"))


def _text(s: str) -> Column:
    return F.lit(s).cast("binary")


def media_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A media file per order: ``free``, then ``moov`` with a header, and ``udta`` holding the operator's marks."""
    marks = F.concat(_be(F.lit(3), 4), _be(F.col("o_custkey") + 1, 4), _be(F.col("o_orderkey") % 7 * 1000, 4), _be(F.col("o_orderkey") + 5, 4))
    box = lambda kind, body, size: F.concat(_be(F.lit(size), 4), _text(kind), body)
    hmmt = box("HMMT", marks, 24)
    moov = box("moov", F.concat(box("mvhd", F.unhex(F.repeat(F.lit("00"), 12)), 20), box("udta", hmmt, 32)), 60)
    return B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), F.concat(box("free", _text("abcd"), 12), moov).alias("bytes"))


@query("""WITH m AS (SELECT o_orderkey AS video_id, unnest([o_custkey + 1, o_orderkey % 7 * 1000, o_orderkey + 5]) AS mark_ms FROM orders) SELECT video_id, mark_ms FROM m WHERE mark_ms > 0""")
def highlight_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.highlight_marks(media_blobs(spark, sf_dir))


@query("SELECT o_orderkey AS video_id, unnest(['free', 'moov']) AS type, 8 AS header_size, unnest([0, 12]) AS start, unnest([12, 72]) AS \"end\" FROM orders")
def box_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.box_rows(media_blobs(spark, sf_dir)).select("video_id", "type", F.col("header_size").cast("int").alias("header_size"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def telemetry_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A telemetry packet per order: a device with a stream of a scale and two samples of three axes."""
    record = lambda key, kind, size, repeat, body: F.concat(_text(key), F.unhex(F.lit(kind)), _be(F.lit(size), 1), _be(F.lit(repeat), 2), body)
    scal = record("SCAL", "73", 2, 1, F.concat(_be(F.col("o_orderkey") % 9 + 1, 2), F.unhex(F.lit("0000"))))
    axes = [F.col("o_custkey") % 100, F.col("o_orderkey") % 200, F.lit(4), F.lit(0), F.lit(3), F.lit(4)]
    accl = record("ACCL", "73", 6, 2, F.concat(*[_be(a, 2) for a in axes]))
    strm = record("STRM", "00", 1, 32, F.concat(scal, accl))
    return B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), record("DEVC", "00", 1, 40, strm).alias("bytes"))


@query("SELECT o_orderkey AS video_id, unnest([0, 1, 2, 3]) AS node, unnest(['/DEVC', '/DEVC/STRM', '/DEVC/STRM/SCAL', '/DEVC/STRM/ACCL']) AS path, unnest([1, 1, 2, 6]) AS struct_size, unnest([40, 32, 1, 2]) AS repeat, unnest([8, 16, 24, 36]) AS data_offset FROM orders")
def klv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.klv_nodes(telemetry_blobs(spark, sf_dir))
    return found.select("video_id", *[F.col(c).cast("int").alias(c) if c != "path" else F.col(c) for c in ("node", "path", "struct_size", "repeat", "data_offset")])


@query("""WITH v AS (SELECT o_orderkey AS video_id, (o_orderkey % 9 + 1)::DOUBLE AS s, (o_custkey % 100)::DOUBLE AS a, (o_orderkey % 200)::DOUBLE AS b FROM orders)
SELECT video_id, unnest([0, 1]) AS i, round(unnest([sqrt((a / s) * (a / s) + (b / s) * (b / s) + (4 / s) * (4 / s)), sqrt((3 / s) * (3 / s) + (4 / s) * (4 / s))]), 6) AS magnitude FROM v""")
def accel_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.acceleration_rows(telemetry_blobs(spark, sf_dir)).withColumn("axes", F.col("axes").cast("int"))
    return rows.select("video_id", F.posexplode(magnitudes("values", "axes", "scale")).alias("i", "m")).select("video_id", "i", F.round("m", 6).alias("magnitude"))
