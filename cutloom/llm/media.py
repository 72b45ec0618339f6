"""Media columns: texts as 8-bit samples in a store of content-defined chunks.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the payload. Its media
form is a mono 8-bit PCM WAV file: a header of 44 bytes, which is stored with the recipe, and the
payload as samples. Payloads are cut where a rolling gear hash has ``CUT_BITS`` leading zeros (between
``LEAST`` and ``MOST`` bytes), so equal passages give equal chunks wherever they stand.

* ``recipes``: per document the ordered list of its chunk digests, with lengths, header and digests.
* ``ChunkStore``: chunk digests are deduplicated by joins. Of the payloads that hold a chunk the first one owns
  it, unless a join with the store finds it there already. Only digests move for that; then each distinct payload
  goes to its place once and writes the chunks it owns, compressed with a small shared dictionary. Chunks that
  other payloads need as well are marked as shared.
* ``read_back``: recipes of distinct payloads meet their own chunks where these lie, and the shared ones by a join on the
  digest; they are decompressed and put together in order. A chunk that is missing, or a digest that does not match, fails the job.

Copies of a payload have one recipe to read back, whatever their number; a chunk that many payloads
share is one row, and both sides of its join are plain shuffles, which Spark can split. A task keeps one payload in memory at a time.

Defined results: null text is empty, and an empty text is 64 zero bytes; a text of any length is cut
whole; equal texts have equal values (ties); repeated rows each get a row; an empty table gives an empty result;
only id and text are read, so columns of clashing names do not matter.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm.common import freed, made_table, shared_dir, small_batches, staged

UNIT = 64
CUT_BITS = 12
LEAST, MOST = 1024, 32768
WINDOW = 32
RATE_HZ = 8000
HEADER_BYTES = 44
#: Compression of stored chunks, and of texts on their way to the store.
LEVEL, WAY_LEVEL = 15, 3
DICTIONARY_BYTES = 110_000
DICTIONARY_TEXTS = 3000
SAMPLE_BYTES = 8192
#: Gear values from a rule: the first four bytes of the digest of each byte value.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], np.uint32)


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def wav_header(n: int) -> bytes:
    """RIFF header of mono 8-bit PCM with ``n`` samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE_HZ, RATE_HZ, 1, 8, b"data", n)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks. The hash at a byte is the sum of the last 32 gear values, each shifted by its age."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:  # sums over 1, 2, 4, ... bytes
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, 2 * span
    ends, start = [], 0
    for at in (np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 1).tolist() + [len(data)]:
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= LEAST or at == len(data) > start:
            ends.append(at)
            start = at
    return ends


def chunks_of(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features_of(payload: bytes) -> str:
    """Mean, deviation, rate of crossings of the middle, and shares of eight levels, of the samples."""
    x = np.frombuffer(payload, np.uint8)
    above = x >= 128
    shares = np.bincount(x >> 5, minlength=8) / len(x)
    return f"mean={x.mean():.4f};std={x.std():.4f};cross={np.count_nonzero(above[1:] != above[:-1]) / len(x):.6f};levels=" + ",".join(f"{s:.4f}" for s in shares)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_digest (SHA-256), header, media_digest (SHA-256 of header and payload), digests (in order)."""
    rows = _texts(docs)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_digest binary, header binary, written_digest binary, digests array<binary>"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, size, whole, headers, media, parts = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                payload = payload_of(text)
                n.append(len((text or "").encode()))
                size.append(len(payload))
                whole.append(hashlib.sha256(payload).digest())
                headers.append(wav_header(len(payload)))
                media.append(hashlib.sha256(headers[-1] + payload).digest())
                parts.append([chunk_digest(c) for c in chunks_of(payload)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(size, pa.int64()), *[pa.array(x, pa.binary()) for x in (whole, headers, media)], pa.array(parts, pa.list_(pa.binary()))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_digest", "header", "written_digest", "digests"],
            )

    return rows.mapInArrow(write, schema)


def chunk_dictionary(docs: DataFrame) -> bytes:
    """A compression dictionary from a bounded sample of texts, the same on every run; empty if they are too few."""
    many = docs.count()
    cut = int(min(1.0, DICTIONARY_TEXTS / max(many, 1)) * (1 << 62))
    drawn = docs.select(F.col("text").cast("string").alias("t")).withColumn("draw", F.xxhash64(F.lit(11), "t").bitwiseAND(F.lit((1 << 62) - 1))).where(F.col("draw") <= cut)
    # The pieces are samples for the dictionary, not results; each is short so that many texts fit.
    drawn = drawn.select("draw", F.substring("t", 1, SAMPLE_BYTES).alias("piece")).distinct().orderBy("draw", "piece").limit(2 * DICTIONARY_TEXTS)
    pieces = [r["piece"].encode()[:SAMPLE_BYTES] for r in drawn.collect() if r["piece"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes() if len(pieces) >= 64 else b""
    except zstandard.ZstdError:
        return b""


def compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=False, write_dict_id=False)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


class ChunkStore:
    """Distinct chunks in tables of the shared folder, one for each batch of documents added.

    A row has the chunks that one payload owns: payload_digest, digests, packed, shared. The tables are bucketed by
    the payload and divided by ``shared``.
    """

    def __init__(self, spark: SparkSession, at: str | None = None, dictionary: bytes = b"", buckets: int | None = None):
        self.spark, self.dictionary = spark, dictionary
        self.at = at or shared_dir(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tag = uuid.uuid4().hex[:12]
        self.tables: list[str] = []

    def digests(self) -> DataFrame:
        """digest of every chunk stored."""
        found = self.spark.createDataFrame([], "digest binary")
        for name in self.tables:
            found = found.unionAll(self.spark.table(name).select(F.explode("digests").alias("digest")))
        return found

    def owners(self, recipe: DataFrame) -> DataFrame:
        """payload_digest, owned (array of digest, shared): the new chunks of each payload that owns some."""
        parts = recipe.select("payload_digest", "digests").dropDuplicates(["payload_digest"]).select("payload_digest", F.explode(F.array_distinct("digests")).alias("digest"))
        first = parts.groupBy("digest").agg(F.min("payload_digest").alias("owner"), F.count(F.lit(1)).alias("n"))
        if self.tables:
            first = first.join(self.digests(), "digest", "left_anti")
        return first.groupBy(F.col("owner").alias("payload_digest")).agg(F.collect_list(F.struct("digest", (F.col("n") > 1).alias("shared"))).alias("owned"))

    def add(self, docs: DataFrame, recipe: DataFrame | None = None) -> None:
        """Store the chunks of ``docs`` that no table holds yet. ``recipe``: of the same documents, staged."""
        at, many = f"{self.at}/{len(self.tables)}", len(self.tables)
        owners = staged(self.owners(recipe if recipe is not None else staged(recipes(docs), f"{at}-recipes")), f"{at}-owners")
        rows, dictionary = _texts(docs).select("text"), self.dictionary

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each payload of a task once, compressed."""
            press, sent = compressor(dictionary, WAY_LEVEL), set()
            for batch in batches:
                digests, frames = [], []
                if len(sent) > 1_000_000:
                    sent.clear()
                for text in batch.column("text").to_pylist():
                    payload = payload_of(text)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in sent:
                        sent.add(digest)
                        digests.append(digest)
                        frames.append(press.compress(payload))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(frames, pa.binary())], names=["payload_digest", "frame"])

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by payload; the first of each is cut, and what it owns is packed."""
            press, unpack, last = compressor(dictionary, LEVEL), decompressor(dictionary), None
            for batch in batches:
                out: list[tuple] = []
                owned = batch.column("owned")
                for i, (digest, frame) in enumerate(zip(batch.column("payload_digest").to_pylist(), batch.column("frame").to_pylist(), strict=True)):
                    if digest == last:
                        continue
                    last = digest
                    wanted = {o["digest"]: o["shared"] for o in owned[i].as_py()}
                    kept: dict[bool, dict[bytes, bytes]] = {False: {}, True: {}}
                    for chunk in chunks_of(unpack.decompress(frame)):
                        name = chunk_digest(chunk)
                        if name in wanted and name not in kept[wanted[name]]:
                            kept[wanted[name]][name] = press.compress(chunk)
                    out += [(digest, list(k), list(k.values()), shared) for shared, k in kept.items() if k]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                kinds = (pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["payload_digest", "digests", "packed", "shared"])

        sent = rows.mapInArrow(send, "payload_digest binary, frame binary").repartition(self.buckets, "payload_digest")
        meant = sent.join(owners, "payload_digest").sortWithinPartitions("payload_digest")
        fresh = meant.mapInArrow(store, "payload_digest binary, digests array<binary>, packed array<binary>, shared boolean")
        name = made_table(f"cutloom_chunks_{self.tag}_{many}")
        with freed(self.spark):
            fresh.select("*").write.partitionBy("shared").bucketBy(self.buckets, "payload_digest").option("path", f"{self.at}/{name}").format("parquet").saveAsTable(name)
        self.tables.append(name)

    def read_back(self, recipe: DataFrame) -> DataFrame:
        """Per distinct payload: payload_digest, payload_bytes, tail_crc32, media_bytes, media_digest (SHA-256), feature."""
        dictionary = self.dictionary
        distinct = recipe.select("payload_digest", "header", "digests").dropDuplicates(["payload_digest"])
        # A payload's own chunks lie in one table; shared ones, and those of earlier batches, may be anywhere.
        away = self.spark.createDataFrame([], "digest binary, packed binary")
        own = self.spark.createDataFrame([], "payload_digest binary, own array<struct<digest:binary,packed:binary>>")
        for name in self.tables:
            rows = self.spark.table(name)
            found = rows.where("shared") if name == self.tables[-1] else rows
            away = away.unionAll(found.select(F.explode(F.arrays_zip("digests", "packed")).alias("c")).select("c.digests", "c.packed"))
            mine = rows.where("NOT shared").select("payload_digest", F.arrays_zip(F.col("digests").alias("digest"), "packed").alias("own"))
            own = mine if len(self.tables) == 1 else own.unionAll(mine)  # a single bucketed table is not shuffled
        wanted = distinct.select("payload_digest", F.explode(F.array_distinct("digests")).alias("digest"))
        fetched = wanted.join(away, "digest").groupBy("payload_digest").agg(F.collect_list(F.struct("digest", "packed")).alias("fetched"))
        parts = distinct.join(own, "payload_digest", "left").join(fetched, "payload_digest", "left")
        schema = "payload_digest binary, payload_bytes long, tail_crc32 long, media_bytes long, media_digest binary, feature string"

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = decompressor(dictionary)
            for batch in batches:
                out = []
                for i in range(batch.num_rows):
                    digest, header, digests, own, fetched = (batch.column(c)[i].as_py() for c in ("payload_digest", "header", "digests", "own", "fetched"))
                    have = {x["digest"]: x["packed"] for x in (*(own or ()), *(fetched or ()))}
                    lacks = sum(d not in have for d in digests)
                    if lacks:
                        raise ValueError(f"payload {digest.hex()} lacks {lacks} chunks")
                    out.append(verified(digest, header, b"".join(unpack.decompress(have[d]) for d in digests)))
                columns = list(zip(*out, strict=True)) or [[]] * 6
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["payload_digest", "payload_bytes", "tail_crc32", "media_bytes", "media_digest", "feature"])

        return parts.mapInArrow(join, schema)


def verified(digest: bytes, header: bytes, payload: bytes) -> tuple:
    """The values of a payload read back; fails if it is not the one that was stored."""
    back = hashlib.sha256(payload).digest()
    if back != digest:
        raise ValueError(f"payload {digest.hex()} was read back otherwise")
    return back, len(payload), zlib.crc32(payload[-UNIT:]), len(header) + len(payload), hashlib.sha256(header + payload).digest(), features_of(payload)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    at = shared_dir(spark)
    recipe = staged(recipes(docs), f"{at}/recipes")
    store = ChunkStore(spark, f"{at}/chunks", chunk_dictionary(docs))
    store.add(docs, recipe)
    return described(recipe, store)


def described(recipe: DataFrame, store: ChunkStore) -> DataFrame:
    """The values of every document of ``recipe``, all of stored bytes read back; fails if some are missing or not those written."""
    back = store.read_back(recipe)
    found = recipe.select("doc_id", "n_bytes", "payload_digest", "written_digest").join(back, "payload_digest", "left")
    same = F.coalesce(F.col("media_digest") == F.col("written_digest"), F.lit(False))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("payload_digest")).alias("payload_sha256"), "tail_crc32", "media_bytes",
        F.when(same, F.lower(F.hex("media_digest"))).otherwise(F.raise_error(F.lit("media was not read back as written")).cast("string")).alias("media_sha256"), "feature",
    )
