"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Targets: sources ordered by code point (null last) take the weights in turn and share all words.
No target exceeds ``cap`` times its source's words; what a capped source cannot take is shared
again among the others by weight. That fixed point is ``min(cap * size, level * weight)`` for one
water level, and the level is the largest of the levels met while sources are capped in the order
of ``cap * size / weight``, so two window sums over the small table of sources give it.

Sampling: every document of a source expects ``target / source words`` copies. Documents are put in
an order within their source, the expected copies are summed along it, one random offset per
source is added, and a document is emitted once for each integer the running sum crosses. The
order goes by size class, so neighbours are alike and the words taken stay within about one
document of the target.

Scale: positions come from counts of (source, size class, salt), summed first within a class and
then over classes, so that no task ranks a whole source, however large it is. The number of salts
follows the size of the largest class.

Defined results: null text has size 0; a null source is a source of its own, ordered last; a source
without words gets target 0; a very long text is one document of its size, so the words taken may miss the target by
it; ties and repeated rows are ranked in some order among themselves and
count one by one; an empty table gives an empty result. Extra columns are carried in a struct, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm.common import WORD_PATTERN, staged, text_or_empty

#: Salts follow the largest size class of a source; beyond the last number groups get larger instead.
ROWS_PER_GROUP = 1000
MOST_SALTS = 4096


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD_PATTERN)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source_null, source_key, source_size) -> the same with ``target`` and ``offset``.

    One row per source: the windows without a partition run over that table alone.
    """
    by_name = Window.orderBy("source_null", "source_key")
    ranked = sizes.withColumn("turn", (F.row_number().over(by_name) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1))
    ranked = ranked.withColumn("ceiling", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), "source_null", "source_key")
    before = F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    ranked = ranked.withColumn("level_here", (total - before) / rest)
    ranked = ranked.withColumn("level", F.max("level_here").over(everything))
    return ranked.select(
        "source_null", "source_key", "source_size",
        F.least(F.col("ceiling"), F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def copies(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3.0,
    seed: int = 17,
    keep: Sequence[str] = ("doc_id",),
    stage_at: str | None = None,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per document: ``row`` (struct of ``keep``), size, source_size, target, n_copies.

    ``stage_at`` names a folder for the sized rows; with narrow ``keep`` it saves a second
    counting of words.
    """
    size = word_count(text)
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col(source).isNull().alias("source_null"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source_key"),
        size.alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("draw"),
    )
    if stage_at:
        sized = staged(sized, stage_at)
    # The class is the size's leading bit with the four after it: 6 % wide, from integers alone.
    size_class = F.expr("length(bin(size)) * 32 + shiftright(shiftleft(size, 5), length(bin(size)))").cast("int")
    sized = sized.withColumn("size_class", size_class)
    largest = sized.groupBy("source_null", "source_key", "size_class").count().agg(F.max("count")).first()[0] or 0
    salts = min(MOST_SALTS, -(-largest // ROWS_PER_GROUP) or 1)
    sized = sized.withColumn("salt", F.pmod(F.col("draw"), F.lit(salts)).cast("int"))

    group = ["source_null", "source_key", "size_class", "salt"]
    counts = sized.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    classes = counts.groupBy(*group[:3]).agg(F.sum("n").alias("class_n"), F.sum("words").alias("words"))
    preceding = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    class_start = classes.select(
        *group[:3],
        F.coalesce(F.sum("class_n").over(preceding(Window.partitionBy(*group[:2]).orderBy("size_class"))), F.lit(0)).alias("class_start"),
    )
    targets = source_targets(classes.groupBy(*group[:2]).agg(F.sum("words").alias("source_size")), weights, cap)
    starts = (
        counts.withColumn("salt_start", F.coalesce(F.sum("n").over(preceding(Window.partitionBy(*group[:3]).orderBy("salt"))), F.lit(0)))
        .join(class_start, group[:3])
        .join(targets, group[:2])
        .select(*group, (F.col("salt_start") + F.col("class_start")).alias("start"), "source_size", "target")
    )
    local = F.row_number().over(Window.partitionBy(*group).orderBy("size", "draw"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), "source_null", "source_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sampled = sized.withColumn("local", local).join(starts, group)
    sampled = sampled.withColumns({"position": F.col("start") + F.col("local"), "rate": rate, "offset": offset})
    crossed = F.floor(F.col("position") * F.col("rate") + F.col("offset")) - F.floor((F.col("position") - 1) * F.col("rate") + F.col("offset"))
    return sampled.select(
        "row", "size", "source_size", "target",
        # A document is emitted as often as its rate, rounded down or up.
        F.least(F.greatest(crossed, F.floor("rate")), F.ceil(F.col("rate") - 1e-9)).cast("int").alias("n_copies"),
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: every document's row, as often as the mix takes it."""
    chosen = copies(docs, weights, cap, seed, keep=docs.columns)
    return chosen.where("n_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy")).select("row.*")
