"""Best-fit packing of tokenised documents into fixed-length sequences.

Best-fit decreasing: pieces in order of falling length, each into the open bin with the least
remaining capacity that still holds it, found by a segment tree over remaining capacities in
logarithmic time; a new bin opens where none fits.

Scale: lengths are whole numbers up to the sequence length, so the exact plan for any number of
pieces follows from the histogram of lengths (at most ``capacity`` numbers, whatever the data).
Bins in the same state are kept as a run with a count, and pieces of one length are placed run by
run. A run that takes k pieces of length L keeps less than L and less than half of its room, so it
is met at most log2(capacity) times, and each length splits at most one run: the plan is a table
whose size is bounded by the capacity alone. Pieces get a rank among those of their length, from
counts by (length, salt) and ranks within, so no task holds all pieces of a common length; the plan
maps (length, rank) to (sequence, offset).

Defined results: null or empty text is the end token alone; only documents longer than a sequence
are cut, the last piece may be shorter; pieces of equal length are ranked by a hash, and those that tie there in some order, which
moves no length; repeated rows are packed once each; an empty table gives an
empty result; other columns may be carried as a struct and cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm.common import shared_dir, small_batches, staged

CAPACITY = 4096
END_ID = 1
#: Salts follow the most common length; beyond the last number groups get larger instead.
ROWS_PER_SALT = 1000
MOST_SALTS = 4096
CACHE_WORDS = 500_000
BLOCK_CHARS = 1_000_000


class CapacityTree:
    """Segment tree over remaining capacities; a leaf counts the runs of bins with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        at = self.size + room
        while at:
            self.counts[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room >= need that some bin has, or None."""
        at = self.size + need
        if self.counts[at]:
            return need
        while at > 1:
            if not at & 1 and self.counts[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.counts[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces per bin, offset, pieces), by length and rank."""
    tree = CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> [(first bin, bins)]
    bins, plan = 0, []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            runs.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                each = room // length
                first, n = runs[room].pop()
                tree.add(room, -1)
            full = min(n, left // each)
            taken = full * each
            if full:
                plan.append((length, rank, first, each, capacity - room, taken))
                put(room - each * length, first, full)
            rest = min(left - taken, each) if full < n else 0
            if rest:
                plan.append((length, rank + taken, first + full, rest, capacity - room, rest))
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            rank += taken + rest
            left -= taken + rest
    return np.array(plan, np.int64).reshape(-1, 6)


#: Characters for which splitting at white space, lowering the case and telling letters from
#: punctuation are the same to Python and to the tokenizer.
PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")


class WordIds:
    """Ids of whole texts, by way of a bounded cache of the ids of their words.

    The vocabulary file lowers case, drops white space and splits at a fixed pattern before its
    merges, so the ids of a text are those of its parts joined. Unknown words of a block of texts
    go through the tokenizer in one call. Texts that the shortcut does not cover (special tokens,
    characters beyond ``PLAIN``) go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Put the ids of words into the cache. A word's core, without its closing marks, is one part if it is all letters,
        and the marks are another."""
        cache = self.cache
        cores = {w: w.rstrip(punctuation) for w in words}
        simple = {w: c for w, c in cores.items() if c.isalpha()}
        plain = sorted(set(simple.values()).difference(cache))
        if plain:
            encoded = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4").tobytes()
            ends = np.flatnonzero(np.diff(np.array(encoded.word_ids, np.int64), append=-1)) + 1
            start = 0
            for core, end in zip(plain, (4 * ends).tolist(), strict=True):
                cache[core] = ids[start:end]
                start = end
        other = sorted(({w[len(c) :] for w, c in simple.items()} | (words - simple.keys())).difference(cache, [""]))
        for word, encoded in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False), strict=True):
            cache[word] = np.array(encoded.ids, "<u4").tobytes()
        for word, core in simple.items():
            if len(core) < len(word):
                cache[word] = cache[core] + cache[word[len(core) :]]

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        split = [t.lower().split() if PLAIN.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        found = [None if words is None else list(map(cache.get, words)) for words in split]
        gaps = [[k for k, ids in enumerate(parts) if ids is None] if parts and None in parts else () for parts in found]
        self._learn({words[k] for words, at in zip(split, gaps, strict=True) for k in at})
        out = []
        for text, words, parts, at in zip(texts, split, found, gaps, strict=True):
            for k in at:
                parts[k] = cache[words[k]]
            out.append(self.whole(text) if parts is None else b"".join(parts))
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process, so that tasks go on with the words the last ones met."""
    return WordIds(path)


def blocks(texts: Sequence[str], most: int = BLOCK_CHARS) -> Iterator[slice]:
    """Slices of about ``most`` characters; a longer text has one of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, draw long"
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_path)
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for block in blocks(texts):
                for i, ids in enumerate(ids_of(texts[block]), block.start):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        of.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "draw"],
            )

    return rows.mapInArrow(cut, schema).withColumn("draw", F.xxhash64("doc_id", "piece", "ids_crc32"))


def place(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", draw: str = "draw", at: str | None = None) -> DataFrame:
    """``pieces`` (names must be free of ``salt``, ``rank``) with sequence_id and offset.

    ``pieces`` is read more than once and must give the same rows each time, as a staged table does.
    """
    spark = pieces.sparkSession
    most = pieces.groupBy(length).count().agg(F.max("count")).first()[0] or 0
    salts = min(MOST_SALTS, -(-most // ROWS_PER_SALT) or 1)
    salted = pieces.withColumn("salt", F.pmod(F.col(draw), F.lit(salts)).cast("int"))
    counts = salted.groupBy(length, "salt").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per length and salt, summed over the salts of a length.
    starts = counts.withColumn("rank_start", F.coalesce(F.sum("n").over(Window.partitionBy(length).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r[0]: r[1] for r in counts.groupBy(length).agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(best_fit_plan(histogram, capacity))
    local = F.row_number().over(Window.partitionBy(length, "salt").orderBy(draw)) - 1
    ranked = salted.withColumn("rank", local).join(starts.select(length, "salt", "rank_start"), [length, "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("rank_start")).cast("long").alias("rank"))
    names = pieces.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema], "sequence_id long", "offset long"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        order = np.lexsort((table[:, 1], table[:, 0]))
        table = table[order]
        codes = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            lengths, ranks = batch.column(length).to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(codes, lengths << 48 | ranks, "right") - 1]
            step = ranks - row[:, 1]
            sequence = row[:, 2] + step // row[:, 3]
            offset = row[:, 4] + step % row[:, 3] * lengths
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(look_up, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    small_batches(docs.sparkSession)
    at = shared_dir(docs.sparkSession)
    pieces = staged(tokenized_pieces(docs, tokenizer_path, capacity, doc_id, text), f"{at}/pieces")
    return place(pieces, capacity).drop("draw")
