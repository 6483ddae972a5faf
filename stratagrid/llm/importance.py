"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Each text is a bag of lower-cased words and word pairs, hashed into BUCKETS. The raw model counts the bags of
all documents, the target model those of documents labelled good (a sample of them, bounded by MOST_TARGET and
taken by the least hash of doc_id). A document's log weight is the log of the ratio of its probabilities under
the two. Adding Gumbel noise, a repeatable number for each doc_id, and taking the k largest draws k documents
without replacement in proportion to their weights. k is a given share of all documents, or else the number of
documents that the target model doesn't hold for e^-FLOOR times less likely than the raw one does.

A null or blank text has log weight 0. Repeated rows get equal numbers; those that tie with the k-th are all
kept. A null doc_id has no label and the noise of its hash. Without target documents every log weight is 0.
Texts of any length count whole; an empty table gives an empty result; a column that is called like an added one is
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, hash_unit, materialise

BUCKETS, SMOOTH = 10_000, 1.0
MOST_TARGET = 20_000
FLOOR, SALT, TEMPERATURE = -3.0, 8, 1.0
BINS = 2048


class _Hashes(dict):
    """The hash of each word, worked out once while a batch is read."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word) & 0x7FFFFFFF
        return out


def buckets(data: bytes, hashes: _Hashes, n: int = BUCKETS) -> np.ndarray:
    """The bucket of each word and of each pair of neighbours."""
    words = np.array([hashes[w] for w in data.lower().split()], dtype=np.int64)
    if not len(words):
        return words
    pairs = (words[:-1] * 1_000_003 + words[1:] * 8_191 + 7) % 2_147_483_647
    return np.concatenate([words, pairs]) % n


def counts(docs: DataFrame, text: str = "text", n: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket occurs in all of docs. Each task adds up before anything is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype=np.int64)
        for batch in batches:
            hashes = _Hashes()
            for x in batch.column(0).cast(pa.binary()).to_pylist():
                if x:
                    total += np.bincount(buckets(x, hashes, n), minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(rows: list, n: int) -> np.ndarray:
    found = np.zeros(n)
    for bucket, count in rows:
        found[bucket] = count
    return found


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Of smoothed models: the raw one by SMOOTH counts for each bucket, the target one by as many counts as
    there are buckets, shared out as in the raw one, so that a small target doesn't count against what it lacks."""
    p = (raw + SMOOTH) / (raw + SMOOTH).sum()
    return np.log((target + len(raw) * p) / (target.sum() + len(raw))) - np.log(p)


def ratio(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", n: int = BUCKETS) -> np.ndarray:
    """The log ratio of target to raw for each bucket. n numbers reach the driver, and MOST_TARGET ids are
    broadcast at most, whatever the input."""
    good = labels.filter(F.col(label) == 1).select(F.col(doc_id).alias("__id")).filter(F.col("__id").isNotNull()).distinct()
    sample = good.orderBy(F.xxhash64("__id"), "__id").limit(MOST_TARGET)
    target = docs.join(F.broadcast(sample), F.col(doc_id) == F.col("__id"), "left_semi")
    wanted = counts(target, text, n).collect()
    if not wanted:
        return np.zeros(n)
    return log_ratio(_vector(wanted, n), _vector(counts(docs, text, n).collect(), n))


def weigh(docs: DataFrame, logs: np.ndarray, text: str = "text", into: str = "log_weight") -> DataFrame:
    """docs with a column of log weights."""
    source, = free_name(docs, "weighed_text")
    schema = T.StructType([*docs.drop(into).schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _Hashes()
            found = [float(logs[buckets(x, hashes, len(logs))].sum()) if x else 0.0 for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[f.name for f in schema.fields])

    return docs.withColumn(source, F.col(text)).drop(into).mapInArrow(run, schema)


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, exactly: counts in ever narrower bins. BINS counts reach the driver each time."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or not n:
        return None
    k = min(k, n)
    while low < high:
        width = (high - low) / BINS
        if width == 0 or low + width == low:
            return high
        inside = rows.filter((F.col(column) >= low) & (F.col(column) <= high))
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        found = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for row in sorted(found, key=lambda r: -r.bin):
            if row.n >= k:
                low, high = row.low, row.high
                break
            k -= row.n
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the text, with log_weight, gumbel_key and kept."""
    rows = weigh(docs, ratio(docs, labels, doc_id, text), text).drop(text)
    u = F.greatest(hash_unit(F.col(doc_id), SALT), F.lit(1e-15))
    rows = rows.withColumn("gumbel_key", F.col("log_weight") / TEMPERATURE - F.log(-F.log(u)))
    rows = materialise(rows, "weights")
    n, likely = rows.agg(F.count(F.lit(1)), F.count_if(F.col("log_weight") >= FLOOR)).first()
    least = kth_largest(rows, "gumbel_key", likely if share is None else math.ceil(share * n))
    return rows.withColumn("kept", F.col("gumbel_key") >= F.lit(math.inf if least is None else least))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return resample(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
