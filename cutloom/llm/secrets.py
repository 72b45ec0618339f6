r"""Secret scans over a trigram inverted index.

Every rule is a regular expression. ``trigram_query`` walks its parse tree and derives a Boolean
query: a conjunction of disjunctions of trigrams, all lower case, that each match must contain. The
index takes a segment of documents at a time, builds the postings of the trigrams
that the rules ask for, and answers a query by intersecting and uniting postings. Only the
candidates are verified, by the regex itself on the whole text. Rules that have no mandatory
trigram (a plain run of hex digits) scan every document.

Defined results: null text is empty and has no spans; equal texts have equal spans, and repeated rows a
result each; spans that begin together come in the order of the rules (ties); texts of any length are searched
whole; case is ignored for A-Z alone; an empty table gives an empty result. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm.common import small_batches


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``at_least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Kinds the method adds to the base: published formats of well-known credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

MOST_STRINGS = 64
SEGMENT_BYTES = 2_000_000

#: All clauses must hold; a clause holds if one of its alternatives does; an alternative needs all of
#: its trigrams.
Query = list[frozenset[frozenset[bytes]]]


def trigram_query(pattern: str) -> Query:
    """The conjunction for a regex; empty if no trigram is mandatory."""
    clauses: Query = []
    for strings in _strings(list(sre_parse.parse(pattern))):
        clauses += _clauses(strings)
    return [c for i, c in enumerate(clauses) if c not in clauses[:i]]


def _strings(nodes: list) -> Iterator[set[str]]:
    """Runs of concatenated exact strings, each ended where the regex gets inexact."""
    now: set[str] = {""}
    for node in nodes:
        exact = _exact(node)
        if exact is not None and len(now) * len(exact) <= MOST_STRINGS:
            now = {a + b for a, b in itertools.product(now, exact)}
            continue
        yield now
        op, arg = node
        if op is sre.SUBPATTERN:
            yield from _strings(list(arg[3]))
        elif op is sre.MAX_REPEAT and arg[0] >= 1:
            yield from _strings(list(arg[2]))
        now = {""}
    yield now


def _exact(node: tuple) -> set[str] | None:
    """All the strings a node matches, where they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg)}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {chr(a) for _, a in arg}
    if op is sre.SUBPATTERN:
        return _exact_all(list(arg[3]))
    if op is sre.BRANCH:
        parts = [_exact_all(list(b)) for b in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] == 1:
        inner = _exact_all(list(arg[2]))
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _exact_all(nodes: list) -> set[str] | None:
    now: set[str] = {""}
    for node in nodes:
        exact = _exact(node)
        if exact is None or len(now) * len(exact) > MOST_STRINGS:
            return None
        now = {a + b for a, b in itertools.product(now, exact)}
    return now


def _clauses(strings: set[str]) -> Query:
    """The clause 'one of these strings'; none if one of them is short of a trigram."""
    folded = {s.encode().lower() for s in strings}  # of bytes, as the texts: A-Z alone
    if not folded or min(map(len, folded)) < 3:
        return []
    return [frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in folded)]


class SegmentIndex:
    """Postings of a segment's documents for the trigrams that queries ask for."""

    def __init__(self, texts: Sequence[bytes], trigrams: Sequence[bytes]):
        self.n = len(texts)
        joined = b"\x00\x00\x00".join(t.lower() for t in texts)
        sizes = np.fromiter(map(len, texts), np.int64, self.n) + 3
        starts = np.concatenate([[0], np.cumsum(sizes)])
        codes = np.frombuffer(joined, np.uint8).astype(np.uint32)
        grams = codes[:-2] | codes[1:-1] << 8 | codes[2:] << 16 if len(codes) > 2 else np.zeros(0, np.uint32)
        wanted = np.zeros(1 << 24, bool)
        numbers = [t[0] | t[1] << 8 | t[2] << 16 for t in trigrams]
        wanted[numbers] = True
        places = np.flatnonzero(wanted[grams])
        owners = np.searchsorted(starts, places, "right") - 1
        found = grams[places]
        self.postings = {t: np.unique(owners[found == number]) for t, number in zip(trigrams, numbers, strict=True)}

    def candidates(self, query: Query) -> np.ndarray:
        """Documents for which every clause holds; all of them if there is no clause."""
        left = np.arange(self.n)
        for clause in query:
            either = [reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), (self.postings[t] for t in sorted(each))) for each in clause]
            left = np.intersect1d(left, np.unique(np.concatenate(either)), assume_unique=True)
        return left


def _segments(texts: Sequence[bytes]) -> Iterator[slice]:
    """Slices of about ``SEGMENT_BYTES``; a longer text has one of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > SEGMENT_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def find_spans(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches in code points; those with a short group are dropped."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.at_least]


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, base: int = len(BASE_RULES), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_<kind> of the first ``base`` rules, base_sha256, spans: kind:start:end by start, then kind."""
    small_batches(docs.sparkSession)
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for clause in q for each in clause for t in each})
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = [r.kind for r in rules[:base]]
    schema = ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *[f"n_{k} long" for k in kinds], "base_sha256 string", "spans string"])

    def listed(found: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in sorted(found))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [r.compiled() for r in rules]
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            encoded = [t.encode() for t in texts]
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for part in _segments(encoded):
                index = SegmentIndex(encoded[part], trigrams)
                for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                    for i in index.candidates(query) + part.start:
                        found[i] += [(a, k, b) for a, b in find_spans(texts[i], rule, compiled[k])]
            in_base = [[x for x in f if x[1] < base] for f in found]
            counts = [pa.array([sum(x[1] == k for x in f) for f in in_base], pa.int64()) for k in range(base)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *counts,
                    pa.array([hashlib.sha256(listed(f).encode()).hexdigest() for f in in_base]),
                    pa.array([listed(f) for f in found]),
                ],
                names=["doc_id", *[f"n_{k}" for k in kinds], "base_sha256", "spans"],
            )

    return rows.mapInArrow(segments, schema)
