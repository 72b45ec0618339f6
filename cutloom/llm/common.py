"""Helpers shared by the training-data operators: tables, the shared folder, staged tables.

Executors may be lost at any time, so lineage is cut only by tables written to the folder that
``spark.checkpoint.dir`` names, which every executor sees. Where that setting is absent and the
session is local (unit tests in one process) a folder is made and the setting is filled in; on a
cluster its absence is an error.

The results of the operators read such tables, so these stay until the caller is done with them: what is
done within ``scratch`` has its folders and tables removed at the end.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\f\r"
BATCH_BYTES = 4 << 20
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Folders and tables made, innermost ``scratch`` last.
_MADE: list[tuple[list[str], list[str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cutloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    made = f"{base.rstrip('/')}/cutloom-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1][0].append(made)
    return made


def made_table(name: str) -> str:
    """Note a table for removal with the others."""
    if _MADE:
        _MADE[-1][1].append(name)
    return name


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end the folders and tables that operators have made within; results must have been consumed by then."""
    _MADE.append(([], []))
    try:
        yield
    finally:
        folders, tables = _MADE.pop()
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for at in folders:
            drop_folder(spark, at)


#: Whether shuffle files go as soon as the write that made them has ended.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of DataFrames made and written within go when they are written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREES_SHUFFLES, "false")
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREES_SHUFFLES, before)


def staged(df: DataFrame, at: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` to ``at`` and read it back: lineage ends here, the rows are fixed and its shuffle files go."""
    names = list(partition_by)
    with freed(df.sparkSession):
        writer = df.select("*").write.mode("overwrite")
        if names:
            writer = writer.partitionBy(*names)
        writer.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop_folder(spark: SparkSession, at: str) -> None:
    """Delete a staged table that no later plan reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python by bytes: texts differ in length, and a batch is held several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_or_empty(column: str | Column = "text") -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col.cast("string"), F.lit(""))


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(modulus)
