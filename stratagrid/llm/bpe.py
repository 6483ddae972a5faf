"""Byte-level BPE over a corpus: each distinct pre-token is encoded once, its ids are joined back, and texts are
put together again by position. Decoding joins each batch of ids with the table of token bytes, by Arrow's take.

1. Documents are taken in blocks of bounded bytes, as the tasks read them. Each block is exploded into its
   pre-tokens, combined at once to the distinct ones: (block, word).
2. These are dealt out by word and sorted; a task meets all rows of a word one after another and encodes it once.
   (A frequent word has one row for each block at most, however often it occurs.)
3. (block, word, ids) goes back to its block, many pairs packed in a row, where the texts have gone as compressed pieces. There a text's
   positions are filled with its words' ids.

A null text counts as empty and has no ids. Rows are kept apart by their place, so repeated rows each come
back; all columns of the input stay, and the added ones replace columns of the same name. A text longer than a
block is a block of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Bytes of text in a block, and in a piece of it; a longer text is a block of its own.
BLOCK_BYTES, PIECE_BYTES = 16 << 20, 1 << 20
#: (block, word) pairs that a task gathers before it passes them on, packed by block.
HELD_WORDS = 200_000


class Merges:
    """The ranks of a vocabulary file: lines of base64 bytes and rank."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tokens = {rank: token for token, rank in self.ranks.items()}
        #: The bytes of each id; an id that is no rank has none.
        self.table = pa.array([tokens.get(i, b"") for i in range(max(tokens) + 1)], pa.large_binary())

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-token: of all neighbours, those of the lowest rank merge first, leftmost first."""
        if word in self.ranks:
            return [self.ranks[word]]
        return self._short(word) if len(word) < 80 else self._long(word)

    def _short(self, word: bytes) -> list[int]:
        rank = self.ranks.get
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [rank(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        while pairs:
            best, at = None, 0
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1])
        return [self.ranks[p] for p in parts]

    def _long(self, word: bytes) -> list[int]:
        """The same with a heap, for pre-tokens of any length."""
        n, rank = len(word), self.ranks.get
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged into another
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, upto = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != upto:
                continue
            end[i], end[j] = upto, 0
            if upto < n:
                before[upto] = i
                if (r := rank(word[i : end[upto]])) is not None:
                    heapq.heappush(heap, (r, i, end[upto]))
            if (p := before[i]) >= 0 and (r := rank(word[p:upto])) is not None:
                heapq.heappush(heap, (r, p, upto))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of texts whose ids are given as bytes, all joined with the table at once."""
        joined = self.table.take(pa.array(np.frombuffer(b"".join(ids), dtype="<u4")))
        data = joined.buffers()[2]
        if data is None:
            return [b""] * len(ids)
        edges = np.frombuffer(joined.buffers()[1], dtype=np.int64)[np.cumsum([0, *[len(x) // 4 for x in ids]])].tolist()
        whole = memoryview(data)
        return [bytes(whole[a:b]) for a, b in zip(edges, edges[1:])]

    def ids_by(self, words: list[str], ids_of: dict[str, bytes]) -> bytes:
        """The ids of words, put together. A word that the block's rows haven't brought is encoded here: that
        happens where the input was read in another order when it was exploded."""
        try:
            return b"".join([ids_of[w] for w in words])
        except KeyError:
            for w in {w for w in words if w not in ids_of}:
                ids_of[w] = _ids_bytes(self.encode(w.encode("utf-8")))
            return b"".join([ids_of[w] for w in words])


@lru_cache(4)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(4)
def splitter(pattern: str):
    return regex.compile(pattern)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with at most so many bytes in the last column, the text, and at least one row in each."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
        first = 0
        for i, x in enumerate(sizes):
            if size and size + x > most:
                if i > first:
                    held.append(batch.slice(first, i - first))
                yield held
                held, size, first = [], 0, i
            size += x
        if len(sizes) > first:
            held.append(batch.slice(first))
    if held:
        yield held


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The task's rows as runs, each with a number made from its texts, which any other reading of the run has
    too. Blocks with the same number do no harm to each other, for a word has the same ids everywhere."""
    for held in _runs(batches, most):
        number = xxhash.xxh3_64()
        for batch in held:
            for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                number.update(b"\1" + x if x is not None else b"\0")
        yield number.intdigest() - (1 << 63), held


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column(batch.num_columns - 1).to_pylist()


def _ids_bytes(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


def _join_pairs(pairs: list[tuple[bytes, bytes]]) -> bytes:
    """Words and their ids: the number of pairs, all lengths, all words, all ids."""
    lengths = np.array([len(x) for column in zip(*pairs) for x in column], dtype="<u4")
    return len(pairs).to_bytes(4, "little") + lengths.tobytes() + b"".join([w for w, _ in pairs]) + b"".join([i for _, i in pairs])


def _split_pairs(data: bytes) -> Iterator[tuple[str, bytes]]:
    n = int.from_bytes(data[:4], "little")
    ends = (np.frombuffer(data, dtype="<u4", count=2 * n, offset=4).cumsum(dtype=np.int64) + 4 + 8 * n).tolist()
    starts = [4 + 8 * n, *ends]
    for k in range(n):
        yield data[starts[k] : ends[k]].decode("utf-8"), data[starts[n + k] : ends[n + k]]


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with token_ids (binary, little-endian unsigned 32-bit) and decoded (binary: the ids' bytes again)."""
    cols = [c for c in docs.columns if c.lower() not in ("token_ids", "decoded")]
    kept = docs.select(*cols)
    row_type = T.StructType([*kept.schema.fields, T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    source, = free_name(kept, "source_text")
    whole = kept.withColumn(source, F.col(text))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter(pattern).findall
        for block, held in _blocks(batches, block_bytes):
            words: set[str] = set()
            for batch in held:
                for x in _texts(batch):
                    if x:
                        words.update(find(x))
            out = sorted(words)
            for i in range(0, len(out), 10_000):
                some = out[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.string())], names=["block", "word"])

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, ids = merges(path), None, b""
        zstd = zstandard.ZstdCompressor(level=3)

        def packed(held: dict[int, list[tuple[bytes, bytes]]]) -> pa.RecordBatch:
            data = [zstd.compress(_join_pairs(pairs)) for pairs in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array([0] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["block", "piece", "data"])

        held: dict[int, list[tuple[bytes, bytes]]] = {}
        n = 0
        for batch in batches:
            for block, word in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if word != last:
                    last, ids = word, _ids_bytes(own.encode(word))
                held.setdefault(block, []).append((word, ids))
            n += batch.num_rows
            if n >= HELD_WORDS:
                yield packed(held)
                held, n = {}, 0
        if held:
            yield packed(held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks' rows as compressed pieces, numbered from 1, which follow the words of the block."""
        zstd = zstandard.ZstdCompressor(level=3)
        for block, held in _blocks(batches, block_bytes):
            for piece, part in enumerate(_runs(iter(held), PIECE_BYTES), 1):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part[0].schema) as writer:
                    for batch in part:
                        writer.write_batch(batch)
                data = zstd.compress(sink.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([piece], pa.int32()), pa.array([data], pa.binary())], names=["block", "piece", "data"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, find, now = merges(path), splitter(pattern).findall, None
        ids_of: dict[str, bytes] = {}
        for batch in batches:
            for block, piece, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = zstandard.ZstdDecompressor().decompress(data)
                if block != now:
                    now, ids_of = block, {}
                if not piece:
                    ids_of.update(_split_pairs(data))
                    continue
                with pa.ipc.open_stream(data) as reader:
                    for rows in reader:
                        ids = [own.ids_by(find(x), ids_of) if x else b"" for x in _texts(rows)]
                        back = own.decode(ids)
                        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=[f.name for f in row_type.fields])

    parts = "block long, piece int, data binary"
    words = whole.select(source).mapInArrow(explode, "block long, word string")
    coded = words.repartition("word").sortWithinPartitions("word").mapInArrow(encode_words, parts)
    pieces = whole.mapInArrow(pack, parts)
    return coded.unionByName(pieces).repartition("block").sortWithinPartitions("block", "piece").mapInArrow(assemble, row_type)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The number of ids and digests of the ids and of the decoded bytes, for each document."""
    rows = encode(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path)
    return rows.select(
        "doc_id",
        F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
