"""Secret scans: all rules in one automaton and one pass over the bytes of each text.

Matches of one rule are leftmost and don't overlap; matches of different rules may. A null text counts as
empty and has no spans; each row is scanned for itself, so repeated rows get equal spans. Offsets are code
points, ends exclusive.
Texts of any length are scanned whole; an empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import compile_patterns
from .shared import free_name


@dataclass(frozen=True)
class Rule:
    """A match is head, then tail; it counts if the tail has min_tail bytes or more. The first bytes of a match
    must tell where it starts: no match may lie within the shortest beginning of a longer one."""

    kind: str
    head: str
    tail: str = ""
    min_tail: int = 0
    any_case: bool = False


#: The base kinds in the order in which their spans are listed, then further ones.
RULES = (
    Rule("assign", "(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]+", 16),
    # A run of fewer than 24 is no match, and each longer run is one.
    Rule("hex", "", "[0-9a-f]{24,}", 24),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", 35),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]+", 10),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")


#: Scanners that this process has unfolded, so that a worker does it once and not for each task.
_UNFOLDED: dict[tuple[Rule, ...], list] = {}


class Scanner:
    """The rules as one automaton that finds where matches end, and for each rule one that walks back to the
    start, one that walks on to the longest end and one that finds where the tail begins."""

    def __init__(self, rules: Iterable[Rule] = RULES) -> None:
        self.rules = tuple(rules)
        self.find = compile_patterns([(r.head + r.tail, r.any_case) for r in self.rules], anywhere=True)
        self.back = [compile_patterns([(r.head + r.tail, r.any_case)], backward=True) for r in self.rules]
        self.on = [compile_patterns([(r.head + r.tail, r.any_case)]) for r in self.rules]
        self.head = [compile_patterns([(r.head, r.any_case)]) for r in self.rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, number of the rule, end) of each match, in order, in bytes."""
        if self.rules not in _UNFOLDED:
            _UNFOLDED[self.rules] = [self.find.rows()[0], *([a.rows()[0] for a in x] for x in (self.back, self.on, self.head))]
        row, back, on, head = _UNFOLDED[self.rules]
        done = [0] * len(self.rules)
        found = []
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                for k, rule in enumerate(self.rules):
                    if row[256] >> k & 1 and i >= done[k]:
                        start = _walk_back(back[k], data, i + 1, done[k])
                        if start is None:
                            continue
                        done[k] = _walk_on(on[k], data, start)
                        if not rule.tail or done[k] - _walk_on(head[k], data, start) >= rule.min_tail:
                            found.append((start, k, done[k]))
        return sorted(found)


def _walk_back(row: list, data: bytes, end: int, least: int) -> int | None:
    best = None
    for i in range(end - 1, least - 1, -1):
        row = row[data[i]]
        if row is None:
            break
        if row[256]:
            best = i
    return best


def _walk_on(row: list, data: bytes, start: int) -> int:
    best = start
    for i in range(start, len(data)):
        row = row[data[i]]
        if row is None:
            break
        if row[256]:
            best = i + 1
    return best


def in_code_points(spans: list[tuple[int, int, int]], data: bytes) -> list[tuple[int, int, int]]:
    if data.isascii():
        return spans
    marks = sorted({x for start, _, end in spans for x in (start, end)})
    at, before, so_far = {}, 0, 0
    for x in marks:
        so_far += len(data[before:x].decode("utf-8"))
        at[x], before = so_far, x
    return [(at[start], k, at[end]) for start, k, end in spans]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text", into: str = "secrets") -> DataFrame:
    """docs with an array column of (kind, start, end), ordered by start and then by the order of the rules."""
    scanner = Scanner(rules)
    kinds = [r.kind for r in scanner.rules]
    source, = free_name(docs, "scanned_text")
    schema = T.StructType([*docs.drop(into).schema.fields, T.StructField(into, SPANS)])
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                found = in_code_points(scanner.spans(data), data) if data else []
                out.append([{"kind": kinds[k], "start": s, "end": e} for s, k, e in found])
            arrays = [*batch.columns[:-1], pa.array(out, kind_of)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return docs.withColumn(source, F.col(text)).drop(into).mapInArrow(run, schema)


def joined(spans) -> F.Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: Iterable[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans and all spans as text."""
    spans = F.col("secrets")

    def count(kind: str) -> F.Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda x: x["kind"].isin(*BASE_KINDS))
    rows = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), rules).drop("text")
    return rows.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
