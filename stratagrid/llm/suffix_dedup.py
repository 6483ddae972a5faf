"""Repeated substrings: every byte covered by a string of `length` bytes that also starts anywhere else goes.

Which strings can repeat at all is found first, without loss. Each window of `length` bytes belongs to the
least hash among its grams of GRAM bytes, so equal windows belong to equal hashes; neighbouring windows of one
hash form a segment, and each window is in one segment only. A hash of a single gram has no repeat in it. Where
all segments of a hash, two at least, are the same bytes, all their windows repeat. Only the rest, segments that
share a hash but differ or that repeat within themselves, must be looked into: they are dealt out by hash, each distinct one once, and sorted as suffixes of a
shard (see induced.py).

Texts are taken as UTF-8, a null text as empty; matches don't cross documents. Equal texts are worked out once
and count as often as they occur, so repeated rows remove each other when they are long enough. doc_id takes no
part. All decisions are made on the input, not on what is left of it. An empty input gives an empty result; texts
of any length are taken whole; columns may have any names.

Passages that other documents share are found by the same search with a symbol for each word in place of bytes;
windows of words that share a hash are compared by 64-bit hashes in their shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .induced import repeats
from .shared import free_name, materialise, spread_join, text_or_empty

LENGTH, GRAM = 400, 128
#: Words of a passage that is reported where other documents have it, and of the grams that these are found by.
PASSAGE_WORDS, WORD_GRAM = 51, 12
#: Windows worked out at a time, bytes of a shard after which a new one is begun, tuples in a shard's memory.
CHUNK, SHARD_BYTES, TUPLES = 1 << 20, 1 << 20, 1 << 22
#: Distinct segments of one hash that a shard takes; the windows of hashes with more are compared one by one.
SHARD_SEGMENTS = 100_000
_BLANK = re.compile(rb"[ \t-\r]")
_ODD = 0x9E3779B97F4A7C15
_SEGMENT = np.dtype([("h", "<i8"), ("d", "<i8"), ("s", "<i4"), ("e", "<i4"), ("own", "<i4")])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if n not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            _powers[n] = tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(n, b, dtype=np.uint64))) for b in (_ODD, pow(_ODD, -1, 1 << 64)))
    return _powers[n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of all symbols before each place, each times a power of its place, and the inverses of these powers: the
    difference of two sums times the inverse at its beginning depends only on the symbols between."""
    up, down = _power(max(CHUNK + 4096, len(data)))
    with np.errstate(over="ignore"):
        return np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)), down


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of each run of gram symbols."""
    sums, down = _sums(data)
    with np.errstate(over="ignore"):
        return _mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values, from runs forwards and backwards inside blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def word_symbols(text: bytes) -> bytes:
    """A symbol of 4 bytes, a hash, for each word. Runs of equal symbols stand for runs of equal words: one word in
    2^32 would have to be mistaken for another at the same place of a run that is equal otherwise."""
    parts, a = [], 0
    while a < len(text):
        cut = _BLANK.search(text, min(a + CHUNK, len(text)))
        b = cut.start() if cut else len(text)
        data = np.frombuffer(text, dtype=np.uint8, count=b - a, offset=a)
        inside = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13)), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        sums, down = _sums(data)
        with np.errstate(over="ignore"):
            parts.append(_mixed((sums[edges[1::2]] - sums[edges[::2]]) * down[edges[::2]]).astype("<u4").tobytes())
        a = b
    return b"".join(parts)


def segments(text: bytes, length: int = LENGTH, gram: int = GRAM, width: int = 1, inner: bool = True) -> np.ndarray:
    """h, d, s, e, own of each segment: its hash, a digest of its symbols, its windows' starts from s to before e,
    and, if inner ones matter, whether its hash is that of several of its grams, so that its own windows may equal
    each other. Symbols are of so many bytes."""
    data = np.frombuffer(text, dtype=f"<u{width}")
    parts = []
    for a in range(0, max(0, len(data) - length + 1), CHUNK):
        piece = data[a : a + CHUNK + length - 1]
        hashes, run = gram_hashes(piece, gram), length - gram + 1
        least = sliding_least(hashes, run)
        s = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
        e = np.append(s[1:], len(least))
        out = np.empty(len(s), dtype=_SEGMENT)
        out["h"], out["s"], out["e"] = least[s].view(np.int64), s + a, e + a
        out["own"] = inner and [np.count_nonzero(hashes[x : y + run - 1] == v) > 1 for x, y, v in zip(s.tolist(), e.tolist(), least[s])]
        digest = xxhash.xxh3_64_intdigest
        out["d"] = np.array([digest(text[x * width : (y + length - 1) * width]) for x, y in zip(out["s"].tolist(), out["e"].tolist())], dtype=np.uint64).view(np.int64)
        parts.append(out)
    return np.concatenate(parts) if parts else np.empty(0, dtype=_SEGMENT)


def _key(text: Column) -> Column:
    """128 bits of the text's SHA-256, which stand for the text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def runs_of(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


RUNS = "array<struct<a:int,b:int>>"
_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _pairs(runs: list[tuple[int, int]]) -> list[dict]:
    return [{"a": a, "b": b} for a, b in runs]


def _by_window(contents: DataFrame, length: int, words: bool) -> DataFrame:
    """h, d, runs of windows that occur twice or more among segments, found by counting digests of windows."""

    width = 4 if words else 1

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                data = some.column(5).to_pylist()
                counts = [len(x) // width - length + 1 for x in data]
                digests = [xxhash.xxh3_128_digest(x[i * width : (i + length) * width]) for x, n in zip(data, counts) for i in range(n)]
                rows = pa.array(np.repeat(np.arange(len(data)), counts))
                starts = pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in counts]))
                yield pa.RecordBatch.from_arrays([*[some.column(c).take(rows) for c in range(5)], starts, pa.array(digests, pa.binary())], names=["h", "d", "n", "first", "last", "i", "window"])

    each = contents.mapInArrow(windows, "h long, d long, n long, first long, last long, i int, window binary")
    again = F.min("first") != F.max("last") if words else F.sum("n") > 1
    again = materialise(each.groupBy("window").agg(again.alias("again"), F.count("*").alias("n")).filter("again").select("window", "n"), "windows")
    found = spread_join(each, again.select("window"), ["window"], again).groupBy("h", "d").agg(F.collect_set("i").alias("at"))
    return found.select("h", "d", F.transform("at", lambda i: F.struct(i.alias("a"), (i + 1).alias("b"))).alias("runs"))


def shared_windows(rows: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each row of symbols of 4 bytes, which of its windows another owner has too, by 64-bit hashes. owners: for
    each row the first and last of those who have it."""
    counts = np.array([len(x) // 4 for x in rows])
    flat = np.frombuffer(b"".join(rows), dtype="<u4")
    whole = np.ones(len(flat), dtype=bool)
    ends = np.cumsum(counts)
    for k in range(1, length):
        whole[ends[counts >= k] - k] = False
    at = np.flatnonzero(whole[: len(flat) - length + 1])
    hashes, own = gram_hashes(flat, length)[at], np.repeat(np.arange(len(rows)), counts)[at]
    order = np.argsort(hashes)
    first = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
    several = np.minimum.reduceat(owners[own[order], 0], first) != np.maximum.reduceat(owners[own[order], 1], first)
    marked = np.zeros(len(flat), dtype=bool)
    marked[at[order]] = np.repeat(several, np.diff(np.append(first, len(order))))
    return [marked[b - n : b - length + 1] for b, n in zip(ends.tolist(), counts.tolist())]


def repeated_runs(
    docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int | None = None, shard_bytes: int = SHARD_BYTES,
    shard_segments: int = SHARD_SEGMENTS, words: bool = False, tuples: int = TUPLES,
) -> DataFrame:
    """key, runs, times: for each text that has any, the runs of starts of windows that repeat, and how many rows
    have the text. Windows are of so many bytes, and repeat if they start anywhere else; or with words of so many
    words, whatever lies between these, and repeat if another row has them. shard_segments: a hash with more
    distinct segments isn't looked into by one task, its windows are counted by digest."""
    usual = WORD_GRAM if words else GRAM
    gram = gram or (usual if length > 2 * usual else max(1, length // 2))
    width = 4 if words else 1
    whole = text_or_empty(text)
    # A word takes two bytes with the blank after it.
    long_texts = docs.select(whole.alias("text")).filter(F.octet_length("text") >= (2 * length - 1 if words else length)).select(_key(F.col("text")).alias("key"), "text")

    def symbols(texts: pa.Array) -> list[bytes]:
        found = texts.cast(pa.binary()).to_pylist()
        return [word_symbols(x) for x in found] if words else found

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [segments(x, length, gram, width, not words).tobytes() for x in symbols(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["key", "packed"])

    found = long_texts.mapInArrow(find, "key binary, packed binary").filter(F.octet_length("packed") > 0)
    found = materialise(found.groupBy("key").agg(F.count("*").alias("times"), F.first("packed").alias("packed")), "segments")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, dtype=_SEGMENT) for x in batch.column(2).to_pylist()]
            n = np.array([len(r) for r in rows])
            if n.sum():
                at, flat = pa.array(np.repeat(np.arange(len(rows)), n)), np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(flat[k].copy()) for k in _SEGMENT.names]], names=["key", "times", *_SEGMENT.names])

    each = found.mapInArrow(unpack, "key binary, times long, h long, d long, s int, e int, own int").withColumn("owner", F.xxhash64("key"))
    # Who has a segment: the first and the last of the texts, which are told apart if one text has several rows.
    owners = [F.min("owner").alias("first"), F.max(F.when(F.col("times") > 1, F.lit((1 << 63) - 1)).otherwise(F.col("owner"))).alias("last")]
    hashes = each.groupBy("h").agg(F.sum("times").alias("times"), F.min("d").alias("low"), F.max("d").alias("high"), F.max("own").alias("own"), F.count("*").alias("n"), *owners)
    differ, several = F.col("low") != F.col("high"), F.col("times") > 1
    hashes = hashes.filter(F.col("first") != F.col("last")) if words else hashes.filter(several | (F.col("own") > 0))
    hashes = materialise(hashes.select("h", "n", (differ if words else differ | ~several).alias("mixed")), "hashes")
    shared = materialise(spread_join(each.drop("own"), hashes.select("h", "mixed"), ["h"], hashes.select("h", "n")), "shared")

    # One text that has each distinct segment of a mixed hash.
    mixed = shared.filter("mixed").groupBy("h", "d").agg(F.sum("times").alias("n"), F.max(F.struct("key", "s", "e")).alias("at"), F.count("*").alias("rows"), *owners)
    mixed = materialise(mixed, "mixed")
    wanted = mixed.groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct("h", "d", "n", "first", "last", "at.s", "at.e")).alias("segments"))
    names = ["h", "d", "n", "first", "last", "data"]
    kinds = "h long, d long, n long, first long, last long, data binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # copies of a text give the same segments
        for batch in batches:
            keys = batch.column(0).to_pylist()
            fresh = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            offsets, flat = batch.column(2).offsets.to_numpy(), batch.column(2).flatten()
            fields = {k: flat.field(k) for k in (*names[:-1], "s", "e")}
            for data, i, j in zip(symbols(batch.column(1)), (offsets - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist()):
                for a in range(i, j, 5000):
                    some = {k: v.slice(a, min(5000, j - a)) for k, v in fields.items()}
                    parts = [data[x * width : (y + length - 1) * width] for x, y in zip(some["s"].to_pylist(), some["e"].to_pylist())]
                    yield pa.RecordBatch.from_arrays([*[some[k] for k in names[:-1]], pa.array(parts, pa.binary())], names=names)

    contents = spread_join(long_texts, wanted, ["key"], found.select("key", F.col("times").alias("n"))).select("key", "text", "segments").mapInArrow(cut, kinds)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(rows: list[tuple]) -> pa.RecordBatch:
            if words:
                owners = np.array([r[3:5] for r in rows], dtype=np.int64)
                marks = shared_windows([r[5] for r in rows], owners, length)
            else:
                marks = repeats([r[5] for r in rows], length, tuples)
            runs = [_pairs([(0, len(m))] if (r[3] != r[4] if words else r[2] > 1) else runs_of(m)) for r, m in zip(rows, marks)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(runs, _RUNS)], names=["h", "d", "runs"])

        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if row[:2] == last:
                    continue
                if size >= shard_bytes and row[0] != last[0]:
                    yield shard(held)
                    held, size = [], 0
                last = row[:2]
                held.append(row)
                size += len(row[5])
        if held:
            yield shard(held)

    crowded = mixed.groupBy("h").count().filter(F.col("count") > shard_segments).select("h")
    crowded = materialise(crowded, "crowded")
    by_window = None
    if not crowded.isEmpty():
        contents = materialise(contents, "contents")
        by_window = _by_window(contents.join(crowded, "h", "left_semi").dropDuplicates(["h", "d"]), length, words)
        contents = contents.join(crowded, "h", "left_anti")
    sorted_ = contents.repartition("h").sortWithinPartitions("h", "d").mapInArrow(sort, f"h long, d long, runs {RUNS}")
    sorted_ = sorted_ if by_window is None else sorted_.unionByName(by_window)
    sorted_ = materialise(sorted_.filter(F.size("runs") > 0), "sorted")
    inside = spread_join(shared.filter("mixed"), sorted_, ["h", "d"], mixed.select("h", "d", F.col("rows").alias("n")))
    inside = inside.select("key", "times", F.transform("runs", lambda r: F.struct((r["a"] + F.col("s")).alias("a"), (r["b"] + F.col("s")).alias("b"))).alias("runs"))
    same = shared.filter("not mixed").select("key", "times", F.array(F.struct(F.col("s").alias("a"), F.col("e").alias("b"))).alias("runs"))
    return inside.unionByName(same).groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.max("times").alias("times"))


def covered(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """The spans of bytes that windows starting in sorted runs cover, joined where they meet."""
    out: list[list[int]] = []
    for r in runs:
        a, b = r["a"], r["b"] + length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, passage_words: int | None = None, **options) -> DataFrame:
    """docs with removed (spans of bytes, ends exclusive) and kept (the remaining bytes), and with passage_words
    also passages: the spans of words, in runs of so many at least, that other rows have too. These replace
    columns of such names. options: as of repeated_runs()."""
    made = ["removed", "kept", *["passages"][: passage_words is not None]]
    cols = [c for c in docs.columns if c.lower() not in made]
    key, content, runs = free_name(docs, "key", "content", "runs")
    found = repeated_runs(docs, text, length, **options).withColumn("shared", F.lit(None).cast(RUNS))
    if passage_words is not None:
        passages = repeated_runs(docs, text, passage_words, words=True)
        found = found.unionByName(passages.select("key", F.lit(None).cast(RUNS).alias("runs"), "times", F.col("runs").alias("shared")))
        found = found.groupBy("key").agg(F.max("runs").alias("runs"), F.max("times").alias("times"), F.max("shared").alias("shared"))
    found = materialise(found, "runs")
    whole = docs.select(*cols, text_or_empty(text).alias(content)).withColumn(key, _key(F.col(content)))
    rows = spread_join(whole, found.select(F.col("key").alias(key), F.struct("runs", "shared").alias(runs)), [key], found.select(F.col("key").alias(key), F.col("times").alias("n")), "left")
    spans = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    schema = T.StructType([*docs.select(*cols).schema.fields, *[T.StructField(c, T.BinaryType() if c == "kept" else spans) for c in made]])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            removed, kept, shared = [], [], []
            for data, found in zip(batch.column(n - 2).cast(pa.binary()).to_pylist(), batch.column(n - 1).to_pylist()):
                spans = covered(found and found["runs"] or [], length)
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])]))
                removed.append(_pairs(spans))
                shared.append(_pairs(covered(found and found["shared"] or [], passage_words or 1)))
            out = [pa.array(removed, _RUNS), pa.array(kept, pa.binary()), pa.array(shared, _RUNS)][: len(made)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *out], names=[f.name for f in schema.fields])

    return rows.select(*cols, content, runs).mapInArrow(strip, schema)


def report(docs: DataFrame) -> DataFrame:
    """Bytes, removed bytes, maximal removed runs and a digest of what remains, for each document; and in how many
    passages of more than 50 words it agrees with other documents, whether these reach `length` bytes or not."""
    rows = remove_repeats(docs.select("doc_id", "text"), passage_words=PASSAGE_WORDS)
    n = F.octet_length(text_or_empty("text")).cast("long")
    return rows.select(
        "doc_id",
        n.alias("n_bytes"),
        (n - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"),
        (F.size("passages") > 0).alias("has_passage"),
    )
