"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings have ordered grades; here 0 is toxic, 1 is clean but poor, 2 is clean and good. One weight
vector over hashed text features, shared by all grades, gives a text's position, and ordered
thresholds cut the line into grades: ``P(grade <= k) = sigmoid(threshold_k - position)``. The expected
grade ranks documents and the tail probability ``P(grade >= k)`` selects them.

Features are the distinct lower-case words of the whole text, the distinct shapes of its words
(letters and digits collapsed, other characters kept), word beginnings that several distinct words
share (a feature for each number of sharing words from two to ``MOST_SHARED``, so that more words have all of them),
and a few binned measures of the text, hashed
into ``BUCKETS``. Only features that tell grades apart (a G test at ``MIN_G``) get a weight, so that a
long text's hundreds of ordinary words don't drown the few that matter.

The model is fitted on the driver to a bounded sample of rated documents (about ``TRAIN_ROWS``, drawn by a
hash of the id and so the same on every run); every document is scored, whole.

Defined results: null text is empty; an empty text has only its measures as features; ratings that
are null or belong to no document are not used; a document that is rated twice is learned from
once for each different rating; without any usable rating all weights are 0 and the grades are equally likely; very long
texts are scored whole; equal texts have equal grades, and repeated rows a result each (ties); an empty table gives an empty
result; other columns are not read and cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm.common import small_batches

BUCKETS = 1 << 18
TRAIN_ROWS = 8000
MIN_DF = 4
MIN_G = 15.0
CACHE_WORDS = 400_000
#: Lengths of word beginnings, and how many distinct words of a text sharing one still count.
STEMS = (3, 4, 5, 6, 7)
MOST_SHARED = 5

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")


def shape(word: str) -> str:
    return _DIGITS.sub("0", _LETTERS.sub("a", word))


class Features:
    """Hashed features of texts; the buckets of words and their shapes are cached."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self.stems: dict[tuple[str, int], int] = {}

    @staticmethod
    def bucket(kind: str, what: str) -> int:
        return zlib.crc32(f"{kind} {what}".encode()) % BUCKETS

    def stem(self, stem: str, level: int) -> int:
        if (stem, level) not in self.stems:
            self.stems[stem, level] = self.bucket(f"p{level}", stem)
        return self.stems[stem, level]

    def __call__(self, text: str) -> np.ndarray:
        """The sorted distinct buckets of a text."""
        tokens = text.lower().split()
        distinct = set(tokens)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
            self.shapes.clear()
        if len(self.stems) > CACHE_WORDS:
            self.stems.clear()
        for word in distinct.difference(self.words):
            self.words[word] = self.bucket("w", word.strip(".,;:!?\"'()"))
            self.shapes[word] = self.bucket("s", shape(word))
        found = set(map(self.words.__getitem__, distinct))
        found.update(map(self.shapes.__getitem__, distinct))
        stems = Counter(w[:k] for w in distinct for k in STEMS if len(w) > k)
        found.update(self.stem(stem, level) for stem, n in stems.items() if n > 1 for level in range(2, min(n, MOST_SHARED) + 1))
        n = len(tokens)
        found.add(self.bucket("length", str(n.bit_length())))
        found.add(self.bucket("distinct", f"{min(n.bit_length(), 6)} {10 * len(distinct) // max(n, 1)}"))
        odd = sum(1 for w in distinct if not any(c.isalnum() for c in w))
        found.add(self.bucket("odd", str(10 * odd // max(len(distinct), 1))))
        return np.sort(np.fromiter(found, np.int32, len(found)))


@dataclass
class CumulativeLink:
    """``weights`` by bucket, increasing ``thresholds``."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as columns."""
        at = np.array([float(self.weights[r].sum()) for r in rows])
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - at[:, None], -60, 60)))


def _telling(flat: np.ndarray, grade: np.ndarray, grades: np.ndarray, n_used: int, n_grades: int, least: float) -> np.ndarray:
    """Features whose presence depends on the grade: G statistic of presence by grade >= ``least``."""
    seen = np.stack([np.bincount(flat[grade == k], minlength=n_used) for k in range(n_grades)])
    of = np.bincount(grades, minlength=n_grades)[:, None].astype(float)
    share = seen.sum(0) / of.sum()
    g = np.zeros(n_used)
    for have, expect in ((seen, of * share), (of - seen, of * (1 - share))):
        with np.errstate(divide="ignore", invalid="ignore"):
            g += 2 * np.where(have > 0, have * np.log(have / expect), 0.0).sum(0)
    return (g >= least) & (seen.sum(0) >= MIN_DF)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = 3, steps: int = 400, penalty: float = 3e-4, rate: float = 0.05, least: float = MIN_G) -> CumulativeLink:
    """Full-batch Adam on the mean negative log likelihood with an L2 penalty.

    The thresholds are a first one and positive gaps, so they stay ordered.
    """
    weights, cuts = np.zeros(BUCKETS), np.arange(n_grades - 1, dtype=float)
    if not len(rows):
        share = np.arange(1, n_grades) / n_grades
        return CumulativeLink(weights, np.log(share / (1 - share)))
    flat = np.concatenate(rows)
    used, flat = np.unique(flat, return_inverse=True)
    live = _telling(flat, np.repeat(grades, [len(r) for r in rows]), grades, len(used), n_grades, least)
    sizes = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    keep = live[flat]
    flat, owner = flat[keep], owner[keep]
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades), 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(len(used)), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-2))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1):
        w, gaps = params[: len(used)], np.exp(params[len(used) + 1 :])
        cuts = params[len(used)] + np.concatenate([[0.0], np.cumsum(gaps)])
        at = np.bincount(owner, w[flat], len(rows))
        edges = np.concatenate([[-60.0], cuts, [60.0]])
        hi, lo = sigmoid(edges[grades + 1] - at), sigmoid(edges[grades] - at)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        d_at = (dhi - dlo) / p / len(rows)
        grad = np.empty_like(params)
        grad[: len(used)] = np.bincount(flat, d_at[owner], len(used)) + penalty * w
        d_cut = np.array([(-(dhi / p)[grades == k].sum() + (dlo / p)[grades == k + 1].sum()) / len(rows) for k in range(n_grades - 1)])
        grad[len(used)] = d_cut.sum()
        grad[len(used) + 1 :] = gaps * np.cumsum(d_cut[::-1])[::-1][1:]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        params -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights[used] = np.where(live, params[: len(used)], 0.0)
    gaps = np.exp(params[len(used) + 1 :])
    return CumulativeLink(weights, params[len(used)] + np.concatenate([[0.0], np.cumsum(gaps)]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> CumulativeLink:
    """Fit to about ``rows`` rated documents. Only their distinct hashed features reach the driver."""
    small_batches(docs.sparkSession)
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1)
    rated = labels.select("doc_id", grade.cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").distinct()
    many = rated.count()
    drawn = rated.where(F.xxhash64(F.lit(5), "doc_id").bitwiseAND(F.lit((1 << 62) - 1)) <= F.lit(int(min(1.0, rows / max(many, 1)) * ((1 << 62) - 1))))
    # About ``rows`` different ids and grades: a bounded table.
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in batches:
            found = [make(t or "").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(found, pa.binary())], names=["grade", "found"])

    got = sample.select("text", "grade").mapInArrow(features, "grade int, found binary").distinct().orderBy("grade", "found").toArrow()
    return fit([np.frombuffer(b, np.int32) for b in got.column("found").to_pylist()], np.array(got.column("grade").to_pylist(), np.int64))


def score(docs: DataFrame, model: CumulativeLink, keep_at: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_clean (grade >= 1), p_good (grade >= 2), keep (p_good >= keep_at)."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_grade double, p_clean double, p_good double, keep boolean"

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, fitted = Features(), CumulativeLink(*shared.value)
        for batch in batches:
            tails = fitted.tails([make(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(fitted.thresholds))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep_at)],
                names=["doc_id", "expected_grade", "p_clean", "p_good", "keep"],
            )

    return rows.mapInArrow(grade, schema)
