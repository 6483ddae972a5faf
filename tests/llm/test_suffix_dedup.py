import hashlib
import random
from collections import Counter

import pytest

from stratagrid.llm import induced, suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[hash(d[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def brute_passages(texts, n):
    """For each text, the spans of words in runs of n that another text has too."""
    rows = [(t or "").encode().split() for t in texts]
    owners = {}
    for k, words in enumerate(rows):
        for i in range(len(words) - n + 1):
            owners.setdefault(hash(tuple(words[i : i + n])), set()).add(k)
    out = []
    for words in rows:
        inside = [False] * len(words)
        for i in range(len(words) - n + 1):
            if len(owners[hash(tuple(words[i : i + n]))]) > 1:
                inside[i : i + n] = [True] * n
        edges = [i for i in range(len(words) + 1) if (i > 0 and inside[i - 1]) != (i < len(words) and inside[i])]
        out.append(list(zip(edges[::2], edges[1::2])))
    return out


def test_owners_against_brute_force():
    import numpy as np

    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 4)
        rows = [bytes(b for _ in range(n + r.randint(0, 9)) for b in (r.choice(b"abc"), 0, 1, 2)) for _ in range(r.randint(1, 6))]
        owners = np.array([(o := r.randint(0, 2), o + r.choice([0, 0, 1])) for _ in rows], dtype=np.int64)
        found = {}
        for s, own in zip(rows, owners.tolist()):
            for i in range(0, len(s) - 4 * n + 1, 4):
                found.setdefault(s[i : i + 4 * n], set()).update(own)
        got = suffix_dedup.shared_windows(rows, owners, n)
        assert [m.tolist() for m in got] == [[len(found[s[i : i + 4 * n]]) > 1 for i in range(0, len(s) - 4 * n + 1, 4)] for s in rows]


@pytest.mark.parametrize("memory", [4, 1 << 20])
def test_sorter_against_brute_force(memory):
    r = random.Random(memory)
    for _ in range(400):
        depth, letters = r.choice([1, 2, 3, 4, 7, 12]), r.choice([b"ab", b"abc", b"a", b"abcdefgh", b"\x00\xff"])
        strings = [bytes(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 6))]
        if strings and r.random() < 0.4:
            strings.append(strings[0][3:30] + b"zz" + strings[-1][:20])
        count = Counter(s[i : i + depth] for s in strings for i in range(len(s) - depth + 1))
        got = induced.repeats(strings, depth, memory)
        assert [m.tolist() for m in got] == [[count[s[i : i + depth]] > 1 for i in range(len(s) - depth + 1)] for s in strings]


@pytest.mark.parametrize("names", [1, 4, 1 << 30])
def test_order_and_common_prefixes(monkeypatch, names):
    """With and without recursion, in memory and from disk."""
    import numpy as np

    monkeypatch.setattr(induced, "MOST_NAMES", names)
    monkeypatch.setattr(induced, "BLOCK", 7)
    r = random.Random(names)
    for _ in range(300):
        letters = r.choice([2, 3, 20])
        body = [r.randint(1, letters) for _ in range(r.randint(0, 80))]
        if r.random() < 0.5:
            body = body * r.randint(1, 4)
        text = np.array([*body, 0], dtype=np.int16)
        order, value = induced.Shard(text, 1000, r.choice([5, 1 << 20])).sort()
        suffixes = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert order.tolist() == suffixes
        for a, b, v in zip(suffixes, suffixes[1:], value.tolist()[1:]):
            x, y = text[a:].tolist(), text[b:].tolist()
            assert v == next(k for k in range(len(x) + 1) if k == len(x) or k == len(y) or x[k] != y[k])


def passages(seed, n=150):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "grid", "naïve", "日本", "cell"]) + str(r.randint(0, 50))
    shared = [" ".join(word() for _ in range(r.randint(40, 200))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 80))) for _ in range(3)]
        for s in r.sample(shared, r.randint(0, 2)):
            a = r.randint(0, len(s) // 3)
            parts.insert(r.randint(0, len(parts)), s[a:])
        texts.append(" ".join(parts))
        if r.random() < 0.1:
            words = texts[-1].split()
            words[len(words) // 2 : len(words) // 2 + 1] = ["edited"]
            texts.append(" ".join(words))
    return texts + [texts[0], texts[0], "x" * 2000, "ab" * 900, "ab" * 200, "ab" * 199 + "a"]


def test_report_against_brute_force(make_docs, odd_texts):
    texts = passages(1) + odd_texts
    rows = {r.doc_id: r for r in suffix_dedup.report(make_docs(list(enumerate(texts)))).collect()}
    want, shared = brute(texts, 400), brute_passages(texts, 51)
    assert len(rows) == len(texts) and sum(w[1] for w in want) > 50_000 and sum(map(bool, shared)) > 20
    for i, w in enumerate(want):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == w, i
        assert (rows[i].n_passages, rows[i].has_passage) == (len(shared[i]), bool(shared[i])), i


@pytest.mark.parametrize(("n", "shard", "most"), [(12, 200, 10**6), (25, 10**6, 2)])
def test_passages_of_words(make_docs, n, shard, most):
    """Blanks of any kind part words, and what one text says twice is no passage of others."""
    r = random.Random(n)
    texts = [r.choice([" ", "\n ", "\t"]).join(t.split()) for t in passages(n, 40)]
    words = [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(40)) for _ in range(2)]
    texts += [words[0] + " " + words[0], words[1], words[1] + " end", None]
    docs = make_docs(list(enumerate(texts))).select("doc_id", "text")
    runs = suffix_dedup.repeated_runs(docs, length=n, words=True, shard_bytes=shard, shard_segments=most)
    keyed = docs.select("doc_id", suffix_dedup._key(suffix_dedup.text_or_empty()).alias("key")).join(runs, "key")
    rows = {x.doc_id: suffix_dedup.covered([s.asDict() for s in x.runs], n) for x in keyed.collect()}
    want = brute_passages(texts, n)
    assert [rows.get(i, []) for i in range(len(texts))] == want
    assert not want[-4] and want[-3] == [(0, 40)]


@pytest.mark.parametrize(("length", "gram", "shard", "most", "tuples"), [(60, 20, 200, 10**6, 1 << 20), (60, 20, 10**6, 3, 1 << 20), (30, 29, 10**6, 0, 1), (8, 1, 10**6, 10**6, 500)])
def test_other_lengths_and_small_shards(make_docs, length, gram, shard, most, tuples):
    """Small shards, hashes too crowded for one, and shards far larger than their memory."""
    texts = passages(2, 40)
    docs = make_docs(list(enumerate(texts))).select("doc_id", "text")
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, length=length, gram=gram, shard_bytes=shard, shard_segments=most, tuples=tuples).collect()}
    for i, w in enumerate(brute(texts, length)):
        assert (sum(s.b - s.a for s in rows[i].removed), len(rows[i].removed), hashlib.sha256(bytes(rows[i].kept)).hexdigest()) == w[1:]


def test_chunks_of_a_long_text(monkeypatch):
    text = random.Random(1).randbytes(5000)
    whole = suffix_dedup.segments(text)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    parts = suffix_dedup.segments(text)
    for found in (whole, parts):
        assert found["s"][0] == 0 and found["e"][-1] == 5000 - 399 and (found["s"][1:] == found["e"][:-1]).all()


def test_symbols_of_words(monkeypatch):
    r = random.Random(3)
    text = "".join(r.choice(["ab", "é", " ", "\n", "x" * 40, "\x0b", "日本 "]) for _ in range(500)).encode()
    whole = suffix_dedup.word_symbols(text)
    ids = {}
    for k, w in enumerate(text.split()):
        assert ids.setdefault(w, whole[4 * k : 4 * k + 4]) == whole[4 * k : 4 * k + 4]
    assert len(whole) == 4 * len(text.split()) and len(set(ids.values())) == len(ids)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 17)
    assert suffix_dedup.word_symbols(text) == whole and suffix_dedup.word_symbols(b" \t") == b""


def test_repeats_clashes_and_empty(spark, make_docs):
    docs = spark.createDataFrame([(None, "y" * 500, 1), (None, "y" * 500, 2), (1, None, 3)], "doc_id long, text string, kept int")
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "removed", "kept"] and [len(r.kept) for r in out.collect()] == [0, 0, 0]
    clashing = spark.createDataFrame([(1, "y" * 500, 5, 6, 7, 8, "x")], "doc_id long, text string, key int, content int, RUNS int, salt int, passages string")
    out = suffix_dedup.remove_repeats(clashing.unionByName(clashing), passage_words=3)
    assert out.columns == ["doc_id", "text", "key", "content", "RUNS", "salt", "removed", "kept", "passages"]
    assert [tuple(r)[2:6] + (len(r.kept), r.passages) for r in out.collect()] == [(5, 6, 7, 8, 0, [])] * 2
    assert suffix_dedup.report(make_docs([(1, "x")]).limit(0)).count() == 0
