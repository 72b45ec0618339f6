"""Document fingerprints: a homomorphic multiset hash of paragraphs. DataFrame functions only.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed into a wide vector and
the vectors are added lane by lane modulo powers of two, so

* the order of paragraphs does not matter, and texts of equal paragraphs have equal fingerprints;
* a paragraph is inserted or deleted by adding or subtracting its own vector (``insert``/``delete``).

The vector has two parts. ``IDENTITY`` lanes of 62 bits hold whole-paragraph hashes. The likeness
part holds ``LANES * PACKED`` counters of 30 bits, two to a number: a paragraph adds, for each of its
phrases (every run of three words side by side, so runs overlap; a line of fewer words is one phrase; no
run crosses a paragraph's end), the bits of the phrase's hash. A counter against half the number of phrases is a sum of signs, and the correlation of two
such vectors estimates the cosine of the phrase multisets. A counter holds more phrases than a string can have.

Defined results: null text is empty; empty texts are equal to each other (likeness 1) and unlike
any other text (0); very long texts are taken whole; equal texts, repeated rows among them, have equal fingerprints
(ties in the order of ids go by the text's hash); an empty table gives an empty result; only id and text are
read, so columns of clashing names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm.common import WORD_PATTERN, staged, text_or_empty

IDENTITY = 4
PACKED = 30
LANES, LANE_BITS = 2, 30
IDENTITY_MASK = (1 << 62) - 1
PACKED_MASK = (1 << 60) - 1
LANE_MASK = (1 << LANE_BITS) - 1
SPREAD = 1 | 1 << LANE_BITS
PHRASE_WORDS = 3


def _shift(x: Column, bits: int) -> Column:
    return F.call_function("shiftrightunsigned", x, F.lit(bits))


def _masked_sum(values: Column, mask: int) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: (acc + x).bitwiseAND(F.lit(mask).cast("long")))


def phrase_hashes(text: Column) -> Column:
    """array<long>: a hash for every run of ``PHRASE_WORDS`` words of a line, or of all words of a shorter line."""
    words = F.transform(F.split(text, r"[\x0A-\x0D]+", -1), lambda line: F.regexp_extract_all(line, F.lit(WORD_PATTERN), F.lit(0)))
    words = F.filter(words, lambda w: F.size(w) > 0)
    runs = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - PHRASE_WORDS, F.lit(0)))
    return F.flatten(F.transform(words, lambda w: F.transform(runs(w), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(PHRASE_WORDS)]))))


def vector(text: Column) -> Column:
    """array<long>: identity lanes, then packed counters, then the number of phrases."""
    phrases = phrase_hashes(text)
    paragraphs = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))

    def identity(lane: int, s: Column) -> Column:
        hashes = F.transform(s["paragraphs"], lambda p: F.xxhash64(F.lit(lane), p).bitwiseAND(F.lit(IDENTITY_MASK).cast("long")))
        return _masked_sum(hashes, IDENTITY_MASK)

    def packed(bit: int, s: Column) -> Column:
        return _masked_sum(F.transform(s["phrases"], lambda h: _shift(h, bit).bitwiseAND(F.lit(SPREAD).cast("long"))), PACKED_MASK)

    return F.transform(
        F.array(F.struct(paragraphs.alias("paragraphs"), phrases.alias("phrases"))),
        lambda s: F.array(*[identity(k, s) for k in range(IDENTITY)], *[packed(k, s) for k in range(PACKED)], F.size(s["phrases"]).cast("long")),
    )[0]


def insert(whole: Column, part: Column) -> Column:
    """The vector of a text with another's paragraphs added."""
    return _lanes(whole, part, 1)


def delete(whole: Column, part: Column) -> Column:
    """The vector of a text with another's paragraphs taken away."""
    return _lanes(whole, part, -1)


def _lanes(a: Column, b: Column, sign: int) -> Column:
    masks = F.array(*[F.lit(m).cast("long") for m in [IDENTITY_MASK] * IDENTITY + [PACKED_MASK] * PACKED + [IDENTITY_MASK]])
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + F.lit(sign) * y), masks, lambda x, m: x.bitwiseAND(m))


def fingerprint(vec: Column) -> Column:
    """Fixed-width lowercase hex of the lanes."""
    return F.lower(F.concat_ws("", F.transform(vec, lambda x: F.lpad(F.hex(x), 16, "0"))))


def _signs(vec: Column) -> Column:
    n = F.element_at(vec, -1)
    packed = F.slice(vec, IDENTITY + 1, PACKED)
    lanes = F.flatten(F.transform(packed, lambda x: F.array(*[_shift(x, LANE_BITS * k).bitwiseAND(F.lit(LANE_MASK).cast("long")) for k in range(LANES)])))
    return F.transform(lanes, lambda c: (F.lit(2) * c - n).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal vectors, else the estimated cosine of the phrase multisets."""
    return F.transform(
        F.array(F.struct(a.alias("a"), b.alias("b"), _signs(a).alias("x"), _signs(b).alias("y"))),
        lambda s: F.when(s["a"] == s["b"], F.lit(1.0))
        .when((F.element_at(s["a"], -1) == 0) | (F.element_at(s["b"], -1) == 0), F.lit(0.0))
        .otherwise(F.least(F.greatest(F.coalesce(F.try_divide(_dot(s["x"], s["y"]), F.sqrt(_dot(s["x"], s["x"]) * _dot(s["y"], s["y"]))), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))),
    )[0]


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, vector, fingerprint."""
    base = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("t"))
    base = base.select("doc_id", F.length("t").alias("n_chars"), vector(F.col("t")).alias("vector"))
    return base.withColumn("fingerprint", fingerprint(F.col("vector")))


KEY = ["id_null", "id_key", "digest"]


def edited_fingerprints(docs: DataFrame, stage_at: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints beside those of edited texts and of the next documents.

    The edited text of a document has its last ``n_chars // 4`` code points replaced by the first
    as many of the next document in ascending id (null ids first, the first document follows the
    last). Ids are whole numbers. Rows that repeat id and text follow each other, so each but the last
    has itself as next.

    The order is settled on (id, hash of text, length) alone: range partitions, sorted, numbered
    and staged. The texts are shuffled once, and each sends its successor's quarter to it.
    """
    keyed = docs.select(
        F.col(doc_id).isNotNull().cast("int").alias("id_null"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id_key"),
        text_or_empty(text).alias("t"),
    ).withColumn("digest", F.sha2("t", 256))
    spark = docs.sparkSession
    narrow = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("repeats"), F.max(F.length("t")).alias("n_chars"))
    ordered = staged(narrow.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id()), f"{stage_at}/order")
    ordered = ordered.withColumns({"part": F.shiftright("place", 33), "local": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    # One row per range partition: a table as small as the number of partitions.
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    total = ordered.count()
    ranked = ordered.join(parts, "part").withColumn("rank", F.col("start") + F.col("local"))
    before = ranked.select(((F.col("rank") + 1) % F.lit(max(total, 1))).alias("rank"), *[F.col(c).alias(f"before_{c}") for c in KEY], F.floor(F.col("n_chars") / 4).cast("int").alias("wanted"))
    links = staged(ranked.join(before, "rank").select(*KEY, "repeats", "n_chars", "wanted", *[f"before_{c}" for c in KEY]), f"{stage_at}/links")

    # Both sides of the last join read the same columns of this, so its shuffle is made once and reused.
    one_each = keyed.withColumn("vec", vector(F.col("t")))
    one_each = one_each.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(1)))).where("nth = 1").drop("nth")
    joined = one_each.join(links, KEY)
    following = joined.select(
        *[F.col(f"before_{c}").alias(c) for c in KEY],
        F.substring("t", F.lit(1), F.col("wanted")).alias("next_head"),
        F.col("vec").alias("next_vec"),
    )
    own_head = F.expr("substring(t, 1, n_chars div 4)")
    paired = joined.join(following, KEY).select(
        F.when(F.col("id_null") == 1, F.col("id_key")).cast(docs.schema[doc_id].dataType).alias("doc_id"), "n_chars", "t", "vec",
        F.explode(F.transform(F.sequence(F.lit(1), F.col("repeats")), lambda i: F.struct(
            F.when(i == F.col("repeats"), F.col("next_head")).otherwise(own_head).alias("head"),
            F.when(i == F.col("repeats"), F.col("next_vec")).otherwise(F.col("vec")).alias("vec"),
        ))).alias("next"),
    )
    edited = paired.withColumn("edited", F.concat(F.expr("substring(t, 1, n_chars - n_chars div 4)"), F.col("next.head")))
    edited = edited.withColumn("edited_vec", vector(F.col("edited")))
    return edited.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("vec")).alias("fingerprint"),
        fingerprint(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"),
        likeness(F.col("vec"), F.col("next.vec")).alias("near_next"),
    )
