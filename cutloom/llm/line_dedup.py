r"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` keeps, per line key, the number of documents that hold it, in runs: tables bucketed
and sorted by the key's 128-bit hash. Adding a batch counts its keys, merge-anti-joins them with
the keys the runs have already settled (those at the threshold, which need no more counting) and
writes the rest as a run of level 0. When a level has ``fanout`` runs they are merged into one run
of the next level and deleted. Since every run has the same buckets and order, a batch that has
been counted is joined with the runs without another shuffle.

A line is what stands between two ``\n``. Its key is the line stripped of ``[\x20\x09-\x0D]`` at
both ends with A-Z in lower case. Keys of at least ``min_chars`` code points found in at least
``min_docs`` documents lose all their lines in every document; the other lines stay, joined by ``\n``.

The text is read twice, once to count its keys and once to drop its lines. The hashes of the keys to drop are
broadcast if there are at most ``MOST_BROADCAST`` of them, and then no text moves at all; if there are more, the
positions to drop are found by a join on the hashes and meet their texts in a join on the text's hash.

Defined results: null or empty text is one empty line; lines of any length are compared whole, by 128 bits; a key counts once per
row of the table, so repeated rows count each; a key in exactly ``min_docs`` documents goes (ties); an empty table
gives an empty result; other columns are carried untouched and cannot clash, as the operator works on structs and on names of its own.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutloom.llm.common import LOWER, SPACE, UPPER, drop_folder, made_table, shared_dir, small_batches, staged, text_or_empty

HASH = ["h1", "h2"]
#: So many hashes of 16 bytes are broadcast at most.
MOST_BROADCAST = 1_000_000
#: Spark's seed of xxhash64, and the seed that a leading 1 makes of it.
_SEED = 42
_SECOND = xxhash.xxh64_intdigest(struct.pack("<i", 1), _SEED)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def key_hashes(line: str, min_chars: int) -> tuple[int, int] | None:
    """``line_hashes`` of the line's key in Python; None if the key is too short."""
    key = line.encode().strip(SPACE.encode()).lower()  # of bytes: A-Z alone
    if len(key) < min_chars or len(key.decode()) < min_chars:
        return None
    return xxhash.xxh64_intdigest(key, _SEED), xxhash.xxh64_intdigest(key, _SECOND)


class LineRuns:
    """The levelled runs. ``levels[k]`` lists the table names of level k, oldest first."""

    def __init__(self, spark: SparkSession, at: str | None = None, min_docs: int = 10, fanout: int = 3, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.at = at or shared_dir(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tag = uuid.uuid4().hex[:12]
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _write(self, counts: DataFrame, level: int) -> None:
        name = made_table(f"cutloom_lines_{self.tag}_{self.written}")
        self.written += 1
        spread = counts.repartition(self.buckets, *HASH)
        spread.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.at}/runs/{name}").format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_folder(self.spark, f"{self.at}/runs/{name}")

    def merged(self, names: list[str] | None = None) -> DataFrame:
        """(h1, h2, n): the sum over runs.

        The runs are read as plain files here: Spark 4.1 takes the union of bucketed tables as
        bucketed, but does not line the buckets up, and sums then come out in parts.
        """
        names = [n for level in self.levels for n in level] if names is None else names
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        runs = self.spark.read.schema("h1 long, h2 long, n long").parquet(*[f"{self.at}/runs/{name}" for name in names])
        return runs.groupBy(*HASH).agg(F.sum("n").alias("n"))

    def settled(self) -> DataFrame:
        return self.merged().where(F.col("n") >= self.min_docs).select(*HASH)

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """Merge-anti-join: ``counts`` without the keys that the runs hold often enough.

        ``counts`` is merged with run after run; each join keeps its order and needs no shuffle.
        """
        left, seen = counts, F.lit(0)
        for k, name in enumerate(n for level in self.levels for n in level):
            run = self.spark.table(name).select(*HASH, F.col("n").alias(f"n{k}"))
            left = left.join(run.hint("merge"), HASH, "left")
            seen = seen + F.coalesce(F.col(f"n{k}"), F.lit(0))
        return left.where(seen < self.min_docs).select(*HASH, "n")

    def add(self, counts: DataFrame) -> None:
        """Write a batch's unsettled (h1, h2, n) as a run of its own, then compact full levels."""
        self._write(self.unsettled(counts), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self.levels[level] = []
            self._write(self.merged(old), level + 1)
            for name in old:
                self._drop(name)
            level += 1


def count_keys(docs: DataFrame, min_chars: int, text: str = "text", batches: int = 1) -> DataFrame:
    """(batch, h1, h2, n): documents per line key. A key counts once per row, before anything is shuffled."""
    keys = F.array_distinct(F.transform(F.split(text_or_empty(text), "\n", -1), line_key))
    batch = F.pmod(F.xxhash64(F.col(text)), F.lit(batches)).cast("int")
    lines = docs.select(batch.alias("batch"), F.explode(keys).alias("key")).where(F.length("key") >= min_chars)
    return lines.select("batch", *line_hashes(F.col("key"))).groupBy("batch", *HASH).agg(F.count(F.lit(1)).alias("n"))


def frequent_keys(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, at: str | None = None, text: str = "text") -> DataFrame:
    """The hashes of the keys to drop: the keys of the documents, read once, go through the runs batch by batch."""
    at = at or shared_dir(docs.sparkSession)
    runs = LineRuns(docs.sparkSession, at, min_docs)
    counted = staged(count_keys(docs, min_chars, text, batches), f"{at}/counted", ["batch"])
    for k in range(batches):
        runs.add(counted.where(F.col("batch") == k).select(*HASH, "n"))
    found = staged(runs.settled(), f"{at}/frequent")
    for level in runs.levels:
        for name in level:
            runs._drop(name)
    drop_folder(docs.sparkSession, f"{at}/counted")
    return found


def _cut_type(row: T.StructField) -> T.StructType:
    return T.StructType([row, T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def _cut(batch: pa.RecordBatch, texts: list[str | None], gone_of) -> pa.RecordBatch:
    """``gone_of(number, lines)``: the positions to drop."""
    kept, n_lines, n_dropped = [], [], []
    for k, text in enumerate(texts):
        parts = (text or "").split("\n")
        gone = gone_of(k, parts)
        n_lines.append(len(parts))
        n_dropped.append(len(gone))
        kept.append("\n".join(p for i, p in enumerate(parts) if i not in gone) if gone else text or "")
    return pa.RecordBatch.from_arrays(
        [batch.column("row"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
        names=["row", "kept_text", "n_lines", "n_dropped"],
    )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, text: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``row`` (the whole input row), kept_text, n_lines, n_dropped."""
    spark = docs.sparkSession
    small_batches(spark)
    at = shared_dir(spark)
    frequent = frequent_keys(docs, min_docs, min_chars, batches, at, text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = docs.columns.index(text)
    texts_of = lambda batch: batch.column("row").field(place).cast(pa.string()).to_pylist()
    if frequent.count() > most_broadcast:
        return _dedup_by_join(docs, rows, frequent, min_chars, at, text, texts_of)
    got = frequent.orderBy(*HASH).toArrow()
    shared = spark.sparkContext.broadcast(np.stack([got.column(c).to_numpy() for c in HASH], 1).astype(np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(map(tuple, shared.value.view(np.uint64).tolist()))
        for batch in batches:
            yield _cut(batch, texts_of(batch), lambda _, parts: {i for i, p in enumerate(parts) if key_hashes(p, min_chars) in known})

    return rows.mapInArrow(cut, _cut_type(rows.schema["row"]))


def _dedup_by_join(docs: DataFrame, rows: DataFrame, frequent: DataFrame, min_chars: int, at: str, text: str, texts_of) -> DataFrame:
    """The way for any number of frequent keys.

    Which positions to drop depends on the text alone, so they are gathered per distinct text (a
    group's size is bounded by its text's lines) and joined back on the text's hash.
    """
    digest = lambda c: [F.xxhash64(F.lit(2), c).alias("t1"), F.xxhash64(F.lit(3), c).alias("t2")]
    keys = F.transform(F.split(text_or_empty(text), "\n", -1), line_key)
    lines = docs.select(*digest(F.col(text)), F.posexplode(keys).alias("at", "key")).where(F.length("key") >= min_chars)
    hits = lines.select("t1", "t2", "at", *line_hashes(F.col("key"))).join(frequent, HASH, "left_semi")
    # Staged, so that the join below is of two plain shuffles and Spark can split the copies of one text.
    dropped = staged(hits.groupBy("t1", "t2").agg(F.sort_array(F.collect_set("at")).alias("drop")), f"{at}/dropped")
    joined = rows.select("row", *digest(F.col(f"row.`{text}`"))).join(dropped, ["t1", "t2"], "left").select("row", "drop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drop = batch.column("drop").to_pylist()
            yield _cut(batch, texts_of(batch), lambda k, _, drop=drop: set(drop[k] or ()))

    return joined.mapInArrow(cut, _cut_type(joined.schema["row"]))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The documents, their text without its frequent lines and ``n_chars`` to match, if there is one."""
    cut = dedup_lines(docs, min_docs, min_chars)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.col("kept_text")).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("row.text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return cut.select(*columns)
