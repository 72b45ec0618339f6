"""Language identification by hierarchical discrimination.

First a text's language family is predicted, then one-versus-one linear support vector machines
decide among the closely related languages within it. Families are learned too: languages whose
mean profiles are closest are joined (average linkage) up to the widest gap between joins.

Features are the counts of hashed character bigrams and trigrams of the whole lower-case text,
square-rooted and scaled to length one. Models are fitted on the driver to a bounded sample of
labelled texts: about ``TRAIN_PER_LANGUAGE`` different texts of each language, drawn by hash, however many copies they have,
of which only the distinct hashed profiles leave the executors. Every document is predicted on its whole text.

Defined results: text that is null or has no letter is ``und`` with score 0; if no labelled text
exists, everything is ``und``; a single known language is predicted for all with score 1; equal
texts get equal results, and repeated rows one each; very long texts are profiled whole; ties go to the language
first in order of code points; an empty table gives an empty result. Other columns than
id and text are never inputs of a prediction and cannot clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.llm.common import small_batches

BITS = 12
TRAIN_PER_LANGUAGE = 300
MOST_DRAW = (1 << 62) - 1
BLOCK_CHARS = 400_000
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def profiles(texts: Sequence[str], bits: int = BITS) -> np.ndarray:
    """Unit-length rows of hashed bigram and trigram counts. Texts are folded together in blocks."""
    half = 1 << (bits - 1)
    out = np.zeros((len(texts), 2 * half), np.float32)
    start = 0
    while start < len(texts):
        end, size = start + 1, len(texts[start])
        while end < len(texts) and size + len(texts[end]) <= BLOCK_CHARS:
            size += len(texts[end])
            end += 1
        lower = [f" {t.lower()} " for t in texts[start:end]]
        codes = np.frombuffer("".join(lower).encode("utf-32-le", "replace"), np.uint32)
        owner = np.repeat(np.arange(end - start), [len(t) for t in lower]) * (2 * half)
        pair = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
        triple = pair[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
        shift = np.uint32(32 - bits + 1)
        at = np.concatenate([owner[:-1][owner[:-1] == owner[1:]] + (pair >> shift)[owner[:-1] == owner[1:]], owner[:-2][owner[:-2] == owner[2:]] + half + (triple >> shift)[owner[:-2] == owner[2:]]])
        out[start:end] = np.bincount(at, minlength=(end - start) * 2 * half).reshape(end - start, -1)
        start = end
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def families(names: Sequence[str], centres: np.ndarray) -> list[list[str]]:
    """Average-linkage groups of languages, cut at the widest gap between successive joins."""
    if len(names) <= 2:
        return [list(names)]
    centred = centres - centres.mean(0)
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
    near = centred @ centred.T
    groups = [[i] for i in range(len(names))]
    steps = [(1.0, [list(g) for g in groups])]
    while len(groups) > 1:
        best = max(itertools.combinations(range(len(groups)), 2), key=lambda p: (near[np.ix_(groups[p[0]], groups[p[1]])].mean(), -p[0], -p[1]))
        height = float(near[np.ix_(groups[best[0]], groups[best[1]])].mean())
        groups = [g for k, g in enumerate(groups) if k not in best] + [sorted(groups[best[0]] + groups[best[1]])]
        steps.append((height, [list(g) for g in groups]))
    # The grouping before the widest drop; single languages alone are no grouping.
    drops = [(steps[k][0] - steps[k + 1][0], k) for k in range(1, len(steps) - 1)]
    chosen = steps[max(drops)[1]][1]
    return sorted(sorted(names[i] for i in g) for g in chosen)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge linear support vector machine by accelerated gradient; y in {-1, 1}, classes weighed alike."""
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    last_w, last_b = w, b
    rate = np.float32(1.0 / 4.1)
    for step in range(steps):
        pull = np.float32(step / (step + 3))
        v, c = w + pull * (w - last_w), b + float(pull) * (b - last_b)
        slack = np.maximum(0, 1 - y * (x @ v + np.float32(c))) * y * weight
        last_w, last_b = w, b
        w, b = v + rate * (2 * (slack @ x) - np.float32(penalty) * v), c + float(rate) * 2 * float(slack.sum())
    return w, float(b)


@dataclass
class LanguageModel:
    groups: list[list[str]] = field(default_factory=list)
    family: list[tuple[np.ndarray, float]] = field(default_factory=list)  # one against the rest
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the family's share times the language's share of its votes."""
        if not len(x) or not self.groups:
            return [UNDETERMINED] * len(x), np.zeros(len(x))
        if len(self.groups) == 1:
            share = np.ones((len(x), 1))
        else:
            share = np.stack([_sigmoid(x @ w + b) for w, b in self.family], 1)
            share /= share.sum(1, keepdims=True)
        chosen = share.argmax(1)
        names: list[str] = [""] * len(x)
        score = np.zeros(len(x))
        for k, group in enumerate(self.groups):
            rows = np.flatnonzero(chosen == k)
            votes = np.zeros((len(rows), len(group)))
            soft = np.zeros((len(rows), len(group)))
            for (i, a), (j, c) in itertools.combinations(enumerate(group), 2):
                w, b = self.pairs[a, c]
                margin = x[rows] @ w + b
                votes[:, i] += margin >= 0
                votes[:, j] += margin < 0
                soft[:, i] += _sigmoid(margin)
                soft[:, j] += _sigmoid(-margin)
            rivals = max(len(group) - 1, 1)
            best = (votes + soft / (rivals + 1)).argmax(1)
            for row, lang in zip(rows.tolist(), best.tolist(), strict=True):
                names[row] = group[lang]
            score[rows] = share[rows, k] * (soft[np.arange(len(rows)), best] / rivals if len(group) > 1 else 1.0)
        return names, np.clip(score, 0.0, 1.0).round(6)


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(4.0 * margin, -60, 60)))


def fit(names: Sequence[str], x: np.ndarray) -> LanguageModel:
    """A model from labelled profiles."""
    kinds = sorted(set(names))
    if not kinds:
        return LanguageModel()
    lang = np.array([kinds.index(n) for n in names])
    x = x.astype(np.float32)
    model = LanguageModel(families(kinds, np.stack([x[lang == k].mean(0) for k in range(len(kinds))])))
    of = {n: k for k, g in enumerate(model.groups) for n in g}
    family = np.array([of[kinds[k]] for k in lang])
    if len(model.groups) > 1:
        model.family = [linear_svm(x, np.where(family == k, 1.0, -1.0)) for k in range(len(model.groups))]
    for group in model.groups:
        for a, c in itertools.combinations(group, 2):
            rows = (lang == kinds.index(a)) | (lang == kinds.index(c))
            model.pairs[a, c] = linear_svm(x[rows], np.where(lang[rows] == kinds.index(a), 1.0, -1.0))
    return model


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def train(labelled: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> LanguageModel:
    """``labelled`` (text, lang): fit to about ``per_language`` texts of each language."""
    small_batches(labelled.sparkSession)
    labelled = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # One row per language, with about its number of different texts.
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()
    if not counts:
        return LanguageModel()
    cut: Column | None = None
    for row in counts:
        share = F.lit(int(min(1.0, per_language / max(row.n, 1)) * MOST_DRAW))
        cut = F.when(F.col("lang") == row.lang, share) if cut is None else cut.when(F.col("lang") == row.lang, share)
    drawn = labelled.where(F.xxhash64(F.lit(7), "text").bitwiseAND(F.lit(MOST_DRAW)) <= cut).distinct()

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            rows = [k for k, t in enumerate(texts) if has_letter(t)]
            found = profiles([texts[k] for k in rows]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in rows], pa.string()), pa.array([f.tobytes() for f in found], pa.binary())], names=["lang", "found"])

    got = drawn.select("text", "lang").mapInArrow(profile, "lang string, found binary").distinct().orderBy("lang", "found").toArrow()
    names, packed = got.column("lang").to_pylist(), got.column("found").to_pylist()
    del got
    pa.default_memory_pool().release_unused()
    return fit(names, np.frombuffer(b"".join(packed), np.float16).reshape(-1, 1 << BITS))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``row`` (the whole input row), lang_pred, score."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = batch.column("t").to_pylist()
            names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            known = [k for k, t in enumerate(texts) if has_letter(t)]
            for at in range(0, len(known), 500):
                part = known[at : at + 500]
                found, sure = fitted.predict(profiles([texts[k] for k in part]))
                score[part] = sure
                for k, name in zip(part, found, strict=True):
                    names[k] = name
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(predict, schema)


def keep_identified(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The documents whose language could be told (not ``und``, score at least ``min_score``), unchanged.

    Where no document is labelled there is no language to tell, and every text with a letter stays.
    """
    model = train(docs)
    named = identify(docs, model)
    if not model.groups:
        return named.where(F.regexp_like(F.col("row.text").cast("string"), F.lit(r"\p{L}"))).select("row.*")
    return named.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")
