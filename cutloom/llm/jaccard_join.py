r"""N-gram Jaccard self-join of documents over a MinHash LSH forest, with exact verification.

Two texts are linked if the Jaccard similarity of their sets of word 5-grams is at least 0.8 (words
are runs of ``[^\x20\x09-\x0D]``; a text of one to four words has all its words as its one gram).

Forest: each distinct text has a signature of ``TREES * LABELS`` minimum hashes; a tree takes
``LABELS`` of them, one byte each, as the path of the text in its trie, kept as one sortable number.
Texts that share a path's beginning of length x in some tree are candidates. A link of similarity s is missed with probability
``(1 - s**x)**TREES``. The beginnings that find enough links even if all are as weak as the threshold bring texts together first;
how alike these are, by the labels their signatures share, tells how many links each length would miss. The join takes whole paths
and shortens them by a label while the misses expected, one unseen link at the threshold included, exceed what the target recall
allows. Where many links are as weak as the threshold this ends at ``1 - (1 - s**6)**32``; where all are strong it ends earlier.

Verification is exact. Candidates form groups (components of the trie nodes). All texts of a small group are
compared with each other. A larger one is cut into blocks of ``BLOCK`` texts, and either all its blocks are compared, or
the texts of each node, block by block, a pair in the first tree that brings it together; whichever moves fewer texts. So a group of
copies costs what its blocks cost and a long chain what its nodes cost. Each pair of blocks is one small task, which counts shared
grams by a matrix product over the grams that many texts of the block hold and by their postings
for the others. A task gives per text its number of links and one text it is joined to by links, not the
links themselves. Counting the links of m texts that are all alike takes m²/2 comparisons and moves each text m / ``BLOCK`` times.

Copies: rows of equal text are one class and are compared once. ``n_links`` is the number of other
documents a document is linked to, copies counted; ``n_texts`` the number of other distinct texts.

Defined results: null text is empty; texts without words are linked to nothing but their copies
(equal texts); very long texts are compared whole, in smaller blocks; repeated rows are copies of each other; null ids are
kept (a class of null ids has a null class id); of equally good members of a group the least id stands for it (ties); an empty table
gives an empty result; only id and text are read, so columns of clashing names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm.common import shared_dir, small_batches, staged
from cutloom.llm.components import components

GRAM = 5
THRESHOLD = 0.8
TREES = 32
LABELS = 8
TARGET_RECALL = 0.9999
#: A block has at most so many texts and about so many grams.
BLOCK = 2048
BLOCK_GRAMS = 3_000_000
#: Links are counted by similarity in so many steps from the threshold to 1.
STEPS = 40
#: How far below the threshold an estimate still counts: a standard deviation.
MARGIN = 0.025
SPREADS = 2
#: What names a pair of blocks: its cluster, the trie node if only a node's texts are compared (else -1, 0), and the blocks.
PAIR = ["cluster", "tree", "path", "low", "high"]
DENSE_FROM = 24
CACHE_WORDS = 150_000
_P1, _P2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def depth_for(threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, labels: int = LABELS) -> int:
    """The longest beginning that is enough even if all links are as weak as the threshold."""
    return next((d for d in range(labels, 1, -1) if 1 - (1 - threshold**d) ** trees >= target), 1)


def missed(depth: int, links: dict[int, int], threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """Links expected to be missed by beginnings of this length, of links by step of similarity.

    A step counts as its lower end, and one more link at the threshold is taken to exist.
    """
    of = lambda step: (1 - (threshold + step * (1 - threshold) / STEPS) ** depth) ** trees
    return of(0) + sum(n * of(step) for step, n in links.items())


def suffices(depth: int, links: dict[int, int], threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES) -> bool:
    return missed(depth, links, threshold, trees) <= (1 - target) * (1 + sum(links.values()))


def likely_links(edges: DataFrame, classes: DataFrame, threshold: float = THRESHOLD) -> dict[int, int]:
    """Pairs of a text and the least first text of its nodes that are probably links, by step of similarity, as their signatures estimate it.

    Each text of a node counts once. Estimates a little below the threshold count as links at it.
    """
    side = lambda c: classes.select(F.col("class_no").alias(c), F.col("paths").alias(f"paths_{c}"))
    pairs = edges.groupBy("a").agg(F.min("b").alias("b")).join(side("a"), "a").join(side("b"), "b").select("paths_a", "paths_b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                left, right = (batch.column(c).flatten().to_numpy().view(np.uint8).reshape(batch.num_rows, -1) for c in ("paths_a", "paths_b"))
                alike = ((left == right).mean(1) - 1 / 256) / (1 - 1 / 256)
                steps = np.floor((alike[alike >= threshold - MARGIN] - threshold) / (1 - threshold) * STEPS + 1e-9)
                total += np.bincount(np.clip(steps, 0, STEPS).astype(np.int64), minlength=STEPS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS + 1, dtype=np.int32)), pa.array(total)], names=["step", "n"])

    got = pairs.mapInArrow(count, "step int, n long").groupBy("step").agg(F.sum("n").alias("n"))
    return {r["step"]: r["n"] for r in got.collect() if r["n"]}  # at most STEPS + 1 rows


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P1
    x = (x ^ (x >> np.uint64(27))) * _P2
    return x ^ (x >> np.uint64(31))


class Grams:
    """Sets of 64-bit gram hashes of texts; the hashes of words are cached."""

    def __init__(self, size: int = GRAM):
        self.size = size
        self.cache: dict[bytes, int] = {}
        self.powers = _mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct hashes; empty if the text has no word."""
        words = text.encode().split()
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        try:
            ids = list(map(cache.__getitem__, words))
        except KeyError:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for word in set(words).difference(cache):
                cache[word] = xxhash.xxh3_64_intdigest(word)
            ids = list(map(cache.__getitem__, words))
        codes = np.array(ids, np.uint64)
        width = min(self.size, len(codes))
        total = np.full(len(codes) - width + 1, np.uint64(width))
        for k in range(width):
            total = total + codes[k : len(codes) - width + 1 + k] * self.powers[k]
        return np.unique(_mixed(total))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    odd = _mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    return odd, _mixed(np.arange(n + 1, 2 * n + 1, dtype=np.uint64))


def paths(grams: np.ndarray, trees: int = TREES, labels: int = LABELS) -> np.ndarray:
    """The text's path in each tree: ``labels`` bytes, the first the most significant, as a signed number."""
    a, b = _seeds(trees * labels)
    low = np.full(trees * labels, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), 4096):
        part = grams[start : start + 4096]
        low = np.minimum(low, (part[None, :] * a[:, None] + b[:, None]).min(1))
    digits = (_mixed(low) >> np.uint64(56)).reshape(trees, labels)
    return (digits << (np.arange(labels - 1, -1, -1, dtype=np.uint64) * np.uint64(8))[None, :]).sum(1, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, paths and number of grams (null for a text without words)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, paths array<long>, n_grams int"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            digests, found, many, done = [], [], [], {}
            for text in batch.column("text").to_pylist():
                text = text or ""
                digest = hashlib.sha256(text.encode()).digest()[:16]
                if digest not in done:
                    have = grams(text)
                    done[digest] = (paths(have), len(have)) if len(have) else (None, None)
                digests.append(digest)
                found.append(done[digest][0])
                many.append(done[digest][1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(many, pa.int32())], names=["doc_id", "digest", "paths", "n_grams"])

    return rows.mapInArrow(sign, schema)


def count_links(left: Sequence[np.ndarray], right: Sequence[np.ndarray], same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays (left, right): whether the gram sets are linked, for ``same`` only above the diagonal, and how similar they are.

    Shared grams that at least ``DENSE_FROM`` texts of a side hold are counted by a matrix product in
    strips, the others by the pairs of their postings.
    """
    n, m = len(left), len(right)
    shared = np.zeros((n, m), np.float32)
    sizes = [np.array([len(g) for g in side], np.int64) for side in (left, right)]
    flat = [np.concatenate(side) if len(side) else np.zeros(0, np.uint64) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), size) for side, size in zip((left, right), sizes, strict=True)]
    names = [np.unique(f, return_inverse=True, return_counts=True) for f in flat]
    common, at_left, at_right = np.intersect1d(names[0][0], names[1][0], assume_unique=True, return_indices=True)
    held = np.maximum(names[0][2][at_left], names[1][2][at_right])
    number = [np.full(len(x[0]), -1, np.int64) for x in names]
    number[0][at_left] = number[1][at_right] = np.arange(len(common))
    ids = [number[k][names[k][1]] for k in range(2)]

    dense = np.flatnonzero(held >= DENSE_FROM)
    place = np.full(len(common), -1, np.int64)
    place[dense] = np.arange(len(dense))
    columns = [np.where(i >= 0, place[np.maximum(i, 0)], -1) if len(common) else np.full(len(i), -1) for i in ids]
    for start in range(0, len(dense), 4096):
        strips = []
        for k, rows in ((0, n), (1, m)):
            strip = np.zeros((rows, min(4096, len(dense) - start)), np.float32)
            inside = (columns[k] >= start) & (columns[k] < start + 4096)
            strip[owner[k][inside], columns[k][inside] - start] = 1.0
            strips.append(strip)
        shared += strips[0] @ strips[1].T

    rare = [np.flatnonzero((ids[k] >= 0) & (columns[k] < 0)) for k in range(2)]
    if len(rare[0]) and len(rare[1]):
        order = [r[np.argsort(ids[k][r], kind="stable")] for k, r in enumerate(rare)]
        gram = [ids[k][o] for k, o in enumerate(order)]
        first, last = np.searchsorted(gram[1], gram[0], "left"), np.searchsorted(gram[1], gram[0], "right")
        for start in range(0, len(order[0]), 200_000):
            lo, hi = first[start : start + 200_000], last[start : start + 200_000]
            reps = hi - lo
            rows = np.repeat(owner[0][order[0][start : start + 200_000]], reps)
            within = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            cols = owner[1][order[1][np.repeat(lo, reps) + within]]
            shared += np.bincount(rows * m + cols, minlength=n * m).reshape(n, m).astype(np.float32)
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    linked = (shared > 0) & (shared >= threshold * union - 1e-6)
    return (np.triu(linked, 1) if same else linked), shared / np.maximum(union, 1)


def component_roots(linked: np.ndarray, same: bool) -> np.ndarray:
    """For the rows and then, unless ``same``, the columns: the first of the nodes that links join to it."""
    n, m = linked.shape
    if same:
        linked = linked | linked.T
    roots = np.arange(n if same else n + m, dtype=np.int32)
    far = np.int32(len(roots))
    while True:
        new = roots.copy()
        columns = new if same else new[n:]
        np.minimum(new[:n], np.where(linked, columns[None, :], far).min(1, initial=far), out=new[:n])
        if not same:
            np.minimum(new[n:], np.where(linked, new[:n, None], far).min(0, initial=far), out=new[n:])
        new = new[new]
        if (new == roots).all():
            return roots
        roots = new


def compare(texts: DataFrame, depth: int, threshold: float = THRESHOLD) -> DataFrame:
    """``texts`` (*PAIR, side, class_no, copies, text, paths) -> class_no, n_texts, n_links, joined_to, per pair of blocks.

    Where a tree is named, pairs that an earlier tree brings together at ``depth`` don't count.
    Rows must come sorted by pair and side within their partition; one pair of blocks is held at a time.
    """
    schema = "class_no long, n_texts long, n_links long, joined_to long"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        key, held = None, ([], [])

        def done() -> pa.RecordBatch:
            (left, right), same = held, key[3] == key[4]
            if same:
                right = left
            sides = [[x[0] for x in left], [x[0] for x in right]]
            linked, _ = count_links([x[2] for x in left], [x[2] for x in right], same, threshold)
            if key[1] > 0:
                ways = [np.array([x[3][: key[1]] for x in side], np.int64) >> (8 * (LABELS - depth)) for side in (left, right)]
                for a, b in zip(ways[0].T, ways[1].T, strict=True):
                    linked &= a[:, None] != b[None, :]
            copies = [np.array([x[1] for x in side], np.int64) for side in (left, right)]
            offset = 0 if same else len(left)
            nodes = sides[0] if same else sides[0] + sides[1]
            n_texts = np.zeros(len(nodes), np.int64)
            n_links = np.zeros(len(nodes), np.int64)
            n_texts[: len(left)] += linked.sum(1)
            n_links[: len(left)] += linked @ copies[1]
            n_texts[offset : offset + len(sides[1])] += linked.sum(0)
            n_links[offset : offset + len(sides[1])] += linked.T @ copies[0]
            roots = component_roots(linked, same)
            keep = np.flatnonzero(n_texts).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([nodes[k] for k in keep], pa.int64()), pa.array(n_texts[keep]), pa.array(n_links[keep]), pa.array([nodes[roots[k]] for k in keep], pa.int64())],
                names=["class_no", "n_texts", "n_links", "joined_to"],
            )

        for batch in batches:
            for *pair, side, no, copies, text, ways in zip(*(batch.column(c).to_pylist() for c in (*PAIR, "side", "class_no", "copies", "text", "paths")), strict=True):
                if tuple(pair) != key:
                    if key and held[0]:
                        yield done()
                    key, held = tuple(pair), ([], [])
                held[side].append((no, copies, grams(text), ways))
        if key and held[0]:
            yield done()

    return texts.mapInArrow(verify, schema)


def classes_of(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """Staged (doc_id, digest) of the documents, and per distinct text: digest, copies, copy_id, group, n_texts, n_links.

    ``group`` is null for a text that is linked to no other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    at = shared_dir(spark)
    signed = staged(signatures(docs), f"{at}/signed")
    classes = signed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("copy_id"), F.first("paths").alias("paths"), F.first("n_grams").alias("n_grams"))
    classes = staged(classes.withColumn("class_no", F.monotonically_increasing_id()), f"{at}/classes")

    least = depth_for(threshold, target)
    edges = candidate_edges(classes, least, f"{at}/forest-{least}")
    texts = staged(_texts(docs, classes, edges), f"{at}/texts")
    links = likely_links(edges, classes, threshold)
    depth = next((d for d in range(LABELS, least, -1) if suffices(d, links, threshold, target)), least)
    if depth > least:
        edges = candidate_edges(classes, depth, f"{at}/forest-{depth}")
    members = staged(_blocks(_clusters(edges, f"{at}/clusters").join(classes.select(F.col("class_no").alias("node"), "n_grams"), "node"), f"{at}/placed"), f"{at}/members")
    compared = staged(compare(_pairs(texts, classes, members, staged(_by_node(members, classes, depth), f"{at}/by-node"), depth), depth, threshold), f"{at}/compared")
    counts = compared.groupBy("class_no").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_links").alias("n_links"))
    linked = staged(_clusters(compared.select(F.col("class_no").alias("a"), F.col("joined_to").alias("b")), f"{at}/links"), f"{at}/linked")
    found = classes.select("class_no", "digest", "copies", "copy_id").join(linked.select(F.col("node").alias("class_no"), F.col("root").alias("group")), "class_no", "left")
    return signed.select("doc_id", "digest"), found.join(counts, "class_no", "left").drop("class_no")


def _clusters(edges: DataFrame, at: str) -> DataFrame:
    """Edges (a, b) of texts a and first texts b of nodes -> (node, root), the root being the least node of its component.

    Texts and nodes first tell each other the least number they know, ``SPREADS`` times, which settles most components;
    the numbers that still meet in a node are joined as a graph of their own, which is far smaller than that of all texts.
    """
    known = edges.unionAll(edges.select("b", "b")).distinct()
    # A node's rows, three numbers each, are sorted in one task, which spills; nothing is joined.
    of_text, of_node = Window.partitionBy("a"), Window.partitionBy("b")
    known = known.withColumn("l", F.min("b").over(of_text))
    for _ in range(SPREADS):
        known = known.withColumn("n", F.min("l").over(of_node)).withColumn("l", F.min("n").over(of_text)).drop("n")
    known = staged(known, f"{at}/known")
    among = known.withColumn("n", F.min("l").over(of_node)).where("l <> n").select(F.col("l").alias("a"), F.col("n").alias("b")).distinct()
    roots = components(among, f"{at}/heads")
    found = known.select(F.col("a").alias("node"), F.col("l").alias("head")).distinct()
    found = found.join(roots.select(F.col("node").alias("head"), F.col("root").alias("top")), "head", "left").select("node", F.coalesce("top", "head").alias("top"))
    first = found.groupBy("top").agg(F.min("node").alias("root"))
    return found.join(first, "top").select("node", "root")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id (least id of the group of linked documents), copy_id (least id of equal text), n_texts, n_links."""
    signed, classes = classes_of(docs, threshold, target)
    least = classes.where("group IS NOT NULL").groupBy("group").agg(F.min("copy_id").alias("least"))
    whole = classes.join(least, "group", "left").select(
        "digest", "copy_id", F.when(F.col("group").isNull(), F.col("copy_id")).otherwise(F.col("least")).alias("class_id"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    return signed.join(whole, "digest").select("doc_id", "class_id", "copy_id", "n_texts", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """The documents, one of each group: the one of least id (null last), of its rows one. Rows are unchanged."""
    _, classes = classes_of(docs, threshold, target)
    first = F.min(F.struct(F.col("copy_id").isNull(), "copy_id", "digest")).alias("first")
    alone = classes.where("group IS NULL").select("digest", "copy_id")
    kept = classes.where("group IS NOT NULL").groupBy("group").agg(first).select("first.digest", "first.copy_id").unionAll(alone)
    named = lambda doc_id: (F.col(doc_id).isNull().alias("id_null"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id_key"))
    kept = kept.select(*named("copy_id"), "digest")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *named("doc_id"), _digest("text").alias("digest"))
    key = ["id_null", "id_key", "digest"]
    # The join and the window share one partitioning, so the texts are shuffled once.
    found = rows.join(kept.hint("merge"), key).withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    return found.where("nth = 1").select("row.*")


def _digest(text: str) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)), 1, 16)


def candidate_edges(classes: DataFrame, depth: int, at: str) -> DataFrame:
    """(a, b): every text of a trie node at ``depth`` with the first of the node.

    All paths of all trees are sorted together, so a node is a run of rows. The order goes on by
    class, so a node of any size may lie over many partitions: each partition links its own part and
    reports its first and last row, and these few rows link the parts.
    """
    shift = np.uint64(8 * (LABELS - depth))
    nodes = classes.where("paths IS NOT NULL").select(F.posexplode("paths").alias("tree", "path"), "class_no")
    nodes = nodes.repartitionByRange("tree", "path", "class_no").sortWithinPartitions("tree", "path", "class_no")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first_row, before = ["tree", "path", "a", "b"], True, None
        row = lambda t, p, a, b: pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(p, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=names)
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, no = batch.column("tree").to_numpy(), batch.column("class_no").to_numpy()
            # Signed order puts the paths with the first bit set first; runs are contiguous all the same.
            path = (batch.column("path").to_numpy().view(np.uint64) >> shift).view(np.int64)
            new = np.ones(len(no), bool)
            new[1:] = (tree[1:] != tree[:-1]) | (path[1:] != path[:-1])
            head = no[np.maximum.accumulate(np.where(new, np.arange(len(no)), 0))]
            if before is not None and before[:2] == (tree[0], path[0]):
                head = np.where(np.cumsum(new) == 1, before[2], head)
            if first_row:
                yield row([tree[0]], [path[0]], [no[0]], [None])
                first_row = False
            pairs = np.flatnonzero(head != no)
            yield row([None] * len(pairs), [None] * len(pairs), no[pairs], head[pairs])
            before = (tree[-1], path[-1], head[-1])
        if before is not None:
            yield row([before[0]], [before[1]], [before[2]], [None])

    found = staged(nodes.mapInArrow(link, "tree int, path long, a long, b long"), f"{at}/edges")
    ends = found.where("b IS NULL").select("tree", "path", "a")
    least = ends.groupBy("tree", "path").agg(F.min("a").alias("b"))
    return found.where("b IS NOT NULL").select("a", "b").union(ends.join(least, ["tree", "path"]).select("a", "b"))


def _texts(docs: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """class_no, copies, text of every class that an edge names; of a class the rows of its least id, and of these one."""
    near = edges.select(F.col("a").alias("class_no")).unionAll(edges.select(F.col("b").alias("class_no"))).distinct()
    wanted = classes.join(near, "class_no", "left_semi").select("class_no", F.col("digest").alias("of_digest"), "copies", "copy_id")
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _digest("text").alias("digest"))
    found = text.join(wanted, (F.col("digest") == F.col("of_digest")) & F.col("doc_id").eqNullSafe(F.col("copy_id")))
    return found.select("class_no", "copies", "text").withColumn("nth", F.row_number().over(Window.partitionBy("class_no").orderBy(F.lit(1)))).where("nth = 1").drop("nth")


def _blocks(clusters: DataFrame, at: str) -> DataFrame:
    """``clusters`` (root, node, n_grams) -> cluster, class_no, block.

    A small cluster is one block. The texts of larger ones are sorted by range, which may spread a cluster over many
    partitions, numbered on from one partition to the next, and cut into runs; so the number of blocks follows from the
    cluster alone, however many partitions there are.
    """
    size = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("n_grams").alias("most_grams"))
    clusters = clusters.select("root", "node").join(size, "root")
    small = (F.col("n") <= BLOCK) & (F.col("n") * F.col("most_grams") <= BLOCK_GRAMS)
    one = clusters.where(small).select(F.col("root").alias("cluster"), F.col("node").alias("class_no"), F.lit(0).cast("long").alias("block"))
    run = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_GRAMS) / F.greatest(F.col("most_grams"), F.lit(1)))))
    more = clusters.where(~small).repartitionByRange("root", "node").sortWithinPartitions("root", "node").withColumn("place", F.monotonically_increasing_id())
    # The place has the partition in its high bits.
    more = staged(more.select("root", "node", run.alias("run"), F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("local")), at)
    parts = more.groupBy("root", "part").agg(F.min("local").alias("first"), F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("root").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("root", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    number = F.col("local") + F.col("shift")
    more = more.join(parts, ["root", "part"]).select(F.col("root").alias("cluster"), F.col("node").alias("class_no"), F.floor(number / F.col("run")).cast("long").alias("block"))
    return one.unionAll(more)


def _nodes(members: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """cluster, class_no, block, paths, tree, path: the trie nodes of members at a depth."""
    found = members.join(classes.select("class_no", "paths"), "class_no").select("*", F.posexplode("paths").alias("tree", "path"))
    return found.withColumn("path", F.shiftright("path", 8 * (LABELS - depth)))


def _by_node(members: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """cluster: the larger ones of which fewer texts move if only the texts of nodes are compared."""
    sized = members.groupBy("cluster", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster")
    many = sized.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n")).where("blocks > 1")
    nodes = _nodes(members.join(many.select("cluster"), "cluster", "left_semi"), classes, depth)
    held = nodes.groupBy("cluster", "tree", "path", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster", "tree", "path")
    held = held.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n")).where("n > 1")
    cost = held.groupBy("cluster").agg(F.sum(F.col("n") * F.col("blocks")).alias("of_nodes"))
    return many.join(cost, "cluster").where(F.col("of_nodes") < F.col("n") * F.col("blocks")).select("cluster")


def _paired(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, blocks (array of block and n) -> keys, low, high, low_n for every two blocks and every block with itself."""
    rows = groups.select(*keys, F.posexplode("blocks").alias("at", "one"), "blocks")
    rows = rows.select(*keys, "one", F.explode(F.expr("slice(blocks, at + 1, size(blocks))")).alias("two"))
    return rows.select(*keys, F.col("one.block").alias("low"), F.col("two.block").alias("high"), F.col("one.n").alias("low_n"))


def _pairs(texts: DataFrame, classes: DataFrame, members: DataFrame, by_node: DataFrame, depth: int) -> DataFrame:
    """A text of each member, once for every pair of blocks it takes part in, sorted by pair."""
    listed = F.sort_array(F.collect_list(F.struct("block", "n"))).alias("blocks")
    sized = members.join(by_node, "cluster", "left_anti").groupBy("cluster", "block").agg(F.count(F.lit(1)).alias("n"))
    whole = _paired(sized.groupBy("cluster").agg(listed), ["cluster"]).select("cluster", F.lit(-1).alias("tree"), F.lit(0).cast("long").alias("path"), "low", "high")
    nodes = _nodes(members.join(by_node, "cluster", "left_semi"), classes, depth)
    held = nodes.groupBy("cluster", "tree", "path", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster", "tree", "path")
    parts = _paired(held.agg(listed), ["cluster", "tree", "path"]).where("low < high OR low_n > 1").select(*PAIR)

    def sides(pairs: DataFrame, keys: list[str]) -> DataFrame:
        """Per block, the pairs it takes part in and on which side."""
        rows = pairs.select("*", F.explode(F.when(F.col("low") < F.col("high"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("side"))
        rows = rows.select(*keys, F.when(F.col("side") == 0, F.col("low")).otherwise(F.col("high")).alias("block"), F.struct(*PAIR, "side").alias("pair"))
        return rows.groupBy(*keys, "block").agg(F.collect_list(F.struct("pair.*")).alias("pairs"))

    asked = members.join(sides(whole, ["cluster"]).withColumnRenamed("cluster", "of").withColumnRenamed("block", "at"), (F.col("cluster") == F.col("of")) & (F.col("block") == F.col("at")))
    asked = asked.select("class_no", "pairs", F.lit(None).cast("array<long>").alias("paths"))
    within = nodes.join(sides(parts, ["cluster", "tree", "path"]), ["cluster", "tree", "path", "block"]).select("class_no", "pairs", "paths")
    # A text meets the list of its pairs, and only then is repeated.
    found = asked.unionAll(within).join(texts, "class_no").select(F.explode("pairs").alias("pair"), "class_no", "copies", "text", "paths").select("pair.*", "class_no", "copies", "text", "paths")
    return found.repartition(*PAIR).sortWithinPartitions(*PAIR, "side", "class_no")
