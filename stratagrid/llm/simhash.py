"""SimHash near-duplicates: exact comparison of fingerprints in tiles, then connected components.

Fingerprints that differ in at most `radius` bits agree on one of radius + 1 blocks of bits (on k of radius + k,
for tables so large that one block doesn't part them), so each distinct fingerprint goes to one bucket per choice
of blocks and no link is lost. A bucket of more than a tile is cut into tiles along the population counts, a count
with more than a tile into several. Pairs of tiles whose counts differ beyond the radius are skipped: a fingerprint
goes only to the pairs with tiles that hold counts within the radius of its own. Inside a pair, parts are skipped
likewise, the rest compared by exclusive-or and bit count. A tile passes on one link per fingerprint, not all pairs. Equal
fingerprints travel once, however many documents have them.

A null or blank text has fingerprint zero and is linked like any other; a null doc_id takes part but names no
component unless all its members are null. Repeated rows each come back. An empty input gives an empty result.
Texts of any length are taken whole. Columns may have any names; only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, spread_join

WORDS, SEED, RADIUS = 4, 42, 4
#: Most fingerprints on one side of a tile, and the parts in which numpy compares them.
TILE, PART, WIDTH = 1 << 14, 256, 4096
#: Rows of a broadcast table of tiles: of six short columns.
MOST_PARTS = 100_000


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """Bit b is 1 if it is set in over half of the hashes of all shingles, repeats included."""
    found = data.lower().split()  # of bytes: A-Z, and ASCII white space
    if not found:
        return 0
    line = b" ".join(found)
    starts = [0, *accumulate([len(w) + 1 for w in found])]
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[k:])], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(counts * 2 > len(hashes)).tolist())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x or b"", words) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64), pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label with i and j joined pairwise: equal labels for what is linked, each label its own least member."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label[label] != label).any():
            label = label[label]


def links_in_tile(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius, inside left or between left and right (unsigned arrays)."""
    counts = np.bitwise_count(left)
    order = np.argsort(counts, kind="stable")
    left, counts = left[order], counts[order].astype(np.int64)
    if right is None:
        other, others, whole, shift = left, counts, left, 0
    else:
        others = np.bitwise_count(right)
        order = np.argsort(others, kind="stable")
        other, others = right[order], others[order].astype(np.int64)
        whole, shift = np.concatenate([left, other]), len(left)
    label = np.arange(len(whole))
    for a in range(0, len(left), PART):
        rows = left[a : a + PART]
        low, high = counts[a] - radius, counts[min(a + PART, len(left)) - 1] + radius
        first = a if right is None else int(np.searchsorted(others, low))
        last = int(np.searchsorted(others, high, side="right"))
        for b in range(first, last, WIDTH):
            columns = other[b : min(b + WIDTH, last)]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ columns[None, :]) <= radius)
            label = merge(label, i + a, j + b + shift)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return whole[moved], whole[label[moved]]


def agreeing(fingerprints: int, radius: int = RADIUS, tile: int = TILE) -> int:
    """How many blocks a bucket takes, so that buckets of evenly spread fingerprints stay within a tile."""
    k = 1
    while fingerprints >> (64 * k // (radius + k)) > tile and k < 8:
        k += 1
    return k


def block_keys(fp: Column, radius: int = RADIUS, agree: int = 1) -> Column:
    """The buckets of a fingerprint: of radius + agree blocks of bits, each choice of agree blocks and their bits,
    as one number. Fingerprints within the radius have all blocks but radius of them in common, if not more."""
    n = radius + agree
    edges = [round(64 * k / n) for k in range(n + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), agree)):
        bits, width = F.lit(0).cast("long"), 0
        for k in chosen:
            size = edges[k + 1] - edges[k]
            part = F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << size) - 1))
            bits, width = bits + F.shiftleft(part, width), width + size
        keys.append((bits + F.lit(number << 48)).cast("long"))
    return F.array(*keys)


def tile_pairs(rows: DataFrame, radius: int, tile: int, bounded: bool = False) -> DataFrame:
    """bucket, a, b, right, fp: the pairs of tiles that each fingerprint of (fp, bucket) takes part in, and whether
    it belongs to the second one. bounded: of one block, so that there are at most 5 * 2^13 buckets."""
    none = F.lit(0)
    hot = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("bucket"), "hot")
    if hot.isEmpty():
        return rows.select("bucket", none.alias("a"), none.alias("b"), F.lit(False).alias("right"), "fp")
    rows = rows.withColumn("ones", F.bit_count("fp"))
    upto = Window.partitionBy("bucket").orderBy("ones")  # of 65 rows at most
    counts = rows.join(F.broadcast(hot) if bounded else hot, "bucket", "left_semi").groupBy("bucket", "ones").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    counts = counts.withColumns({"first": F.floor(F.col("before") / tile).cast("int"), "last": F.floor((F.col("before") + F.col("n") - 1) / tile).cast("int")})
    near = upto.rangeBetween(-radius, radius)
    parts = materialise(counts.select("bucket", "ones", "first", "last", F.min("first").over(near).alias("low"), F.max("last").over(near).alias("high")), "parts")
    rows = rows.join(F.broadcast(parts) if parts.count() <= MOST_PARTS else parts, ["bucket", "ones"], "left")
    mine = F.col("first") + F.pmod(F.xxhash64("fp"), F.col("last") - F.col("first") + 1).cast("int")
    rows = rows.withColumn("mine", F.coalesce(mine, none)).withColumn("other", F.explode(F.sequence(F.coalesce("low", none), F.coalesce("high", none))))
    return rows.select("bucket", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).alias("right"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, agree: int | None = None) -> DataFrame:
    """(u, v) that connect the distinct fingerprints of fps as all pairs within the radius would."""
    agree = agree or agreeing(fps.count(), radius)
    rows = materialise(fps.select("fp", F.explode(block_keys(F.col("fp"), radius, agree)).alias("bucket")), "buckets")
    tiles = tile_pairs(rows, radius, tile, bounded=agree == 1 and radius >= RADIUS)
    tiles = tiles.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sides, found in _tiles(batches):
            found = found.view(np.uint64)
            if key[1] == key[2]:
                u, v = links_in_tile(found, None, radius) if len(found) > 1 else (found[:0],) * 2
            else:
                u, v = links_in_tile(found[~sides], found[sides], radius)
            for i in range(0, len(u), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000].view(np.int64)) for x in (u, v)], names=["u", "v"])

    return tiles.mapInArrow(run, "u long, v long").distinct()


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Runs of equal (bucket, a, b) in sorted rows: the key, which side each row is on, the fingerprints."""
    key, held = None, []
    for batch in batches:
        keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        sides, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            now = tuple(keys[a].tolist())
            if now != key:
                if held:
                    yield key, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                key, held = now, []
            held.append((sides[a:b], fp[a:b]))
    if held:
        yield key, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another: the root is the least node that it can reach.

    Alternating large-star and small-star steps: each links a node's neighbours to the least among them. The
    edges never grow in number, and a few rounds turn them into stars. Sums and joins only; each round is
    written to the shared folder."""
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == before or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")), "least")
        large = spread_join(both.filter("v > u"), least.select("u", F.least("u", "m").alias("m")), ["u"], least.select("u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), "edges")
        # Each edge points downwards here: u's neighbours that are not above it, and u itself.
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = spread_join(large, least.select("u", "m"), ["u"], least.select("u", "n")).select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = materialise(small.filter("u <> v").distinct(), "edges")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of each row; the component's id is the least doc_id in it."""
    rows = materialise(fingerprints(docs, doc_id, text, words), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, radius))
    placed = materialise(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    ids = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "ids")
    named = spread_join(placed, ids.select("root", "component_id"), ["root"], ids.select("root", "n"))
    return spread_join(rows, named.select("fp", "component_id"), ["fp"], nodes.select("fp", "n")).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that name their component, with the columns of docs. Rows that repeat such a doc_id
    are one document and stay; where no member has an id, all stay."""
    found = classes(docs, doc_id, text, words, radius)
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"))
    return whole.join(stays, F.col("id").eqNullSafe(F.col("__id")), "left_semi").select("row.*")
