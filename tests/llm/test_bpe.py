import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from stratagrid.llm import bpe


@pytest.fixture(scope="module")
def library():
    with open(bpe.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(rows, texts, library):
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_equals_the_library(make_docs, odd_texts, library):
    r = random.Random(2)
    texts = odd_texts + ["".join(r.choice(["The ", "the", " isn't", "  ", "\n", "12", "é", "日本", "<|endoftext|>", "!?", "ing", "aaaa", "　"]) for _ in range(r.randint(0, 60))) for _ in range(800)]
    check(bpe.report(make_docs(list(enumerate(texts)))).collect(), texts, library)


def test_small_blocks_give_the_same(make_docs, odd_texts, library):
    docs = make_docs(list(enumerate(odd_texts))).select("doc_id", "text")
    rows = bpe.encode(docs, block_bytes=100).collect()
    assert len(rows) == len(odd_texts)
    for row in rows:
        ids = library.encode_ordinary(odd_texts[row.doc_id] or "")
        assert bytes(row.token_ids) == struct.pack(f"<{len(ids)}I", *ids) and bytes(row.decoded) == (odd_texts[row.doc_id] or "").encode()


def test_long_words(library):
    r, own = random.Random(4), bpe.merges(bpe.VOCABULARY)
    for _ in range(200):
        word = bytes(r.choice(b"abcdeinrst \xc3\xa9\xff") for _ in range(r.randint(1, 300)))
        assert own.encode(word) == library._encode_single_piece(word) == own._long(word)


def test_repeats_clashes_and_empty(spark, make_docs):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, token_ids string")
    out = bpe.encode(docs)
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"] and out.count() == 3
    assert bpe.report(docs.limit(0)).count() == 0


def test_decoding_and_words_that_are_missing(library):
    own = bpe.merges(bpe.VOCABULARY)
    texts = ["", "a naïve 日本 test", "", "x"]
    ids = [struct.pack(f"<{len(found)}I", *found) for found in map(library.encode_ordinary, texts)]
    assert own.decode(ids) == [t.encode() for t in texts] and own.decode([]) == [] and own.decode([b""]) == [b""]
    known = {}
    words = bpe.splitter(bpe.PATTERN).findall(texts[1])
    assert own.ids_by(words, known) == ids[1] and set(known) == set(words)
    assert own.ids_by(words[:1], {words[0]: b"kept"}) == b"kept"


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, "p")], "doc_id long, text string, source_text int, block int, decoded string")
    out = bpe.encode(docs)
    assert out.columns == ["doc_id", "text", "source_text", "block", "token_ids", "decoded"]
    row = out.first()
    assert (row.source_text, row.block, bytes(row.decoded)) == (5, 6, b"a b")
