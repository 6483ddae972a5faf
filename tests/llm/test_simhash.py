import random

import numpy as np
import pytest
import xxhash

from stratagrid.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[ \t-\r]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=4):
    best = dict(enumerate(ids))
    changed = True
    near = [[j for j in range(len(ids)) if (fps[i] ^ fps[j]).bit_count() <= radius] for i in range(len(ids))]
    while changed:
        changed = False
        for i in range(len(ids)):
            m = min(best[j] for j in near[i])
            if m < best[i]:
                best[i], changed = m, True
    return best


def near_copies(seed, n=300):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            words = r.choice(texts).split()
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = f"w{r.randint(0, 9999)}"
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(f"w{r.randint(0, 9999)}" for _ in range(r.randint(30, 150))))
    return texts


def test_against_brute_force(make_docs, odd_texts):
    texts = near_copies(1) + odd_texts
    ids = random.Random(9).sample(range(10_000), len(texts))
    rows = {r.doc_id: r for r in simhash.report(make_docs(list(zip(ids, texts)))).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(ids, fps)
    assert len(rows) == len(ids)
    for k, i in enumerate(ids):
        assert rows[i].fingerprint == f"{fps[k]:016x}" and rows[i].component_id == want[k]
    assert len(set(want.values())) < 0.8 * len(ids)


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.agreeing(n) for n in (1, 10**6, 10**9, 10**11)] == [1, 1, 2, 3]


@pytest.mark.parametrize(("tile", "agree"), [(8, 1), (64, 1), (8, 2), (64, 3)])
def test_small_tiles_lose_no_link(spark, tile, agree):
    r = random.Random(3)
    fps = []
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.append(x)
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(64)
    fps = sorted(set(fps))
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    roots = dict(simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), tile=tile, agree=agree)).collect())
    want = brute_components(signed, fps)
    assert [roots.get(x, x) for x in signed] == [want[k] for k in range(len(fps))]


def test_long_chain(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "u long, v long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 200)}


def test_keep_one_and_odd_rows(spark):
    rows = [(5, "a b c d e", 1), (3, "A b C d e", 2), (3, "A b C d e", 2), (None, None, 3), (9, "", 4), (7, "quite another text of words", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [3, 3, 7, 9]
    assert simhash.report(docs).count() == 6 and simhash.report(docs.limit(0)).count() == 0


def test_tiles_follow_population_counts(spark):
    """All pairs within the radius meet in just one pair of tiles, and far ones don't travel together."""
    r = np.random.default_rng(3)
    fps = np.unique(np.concatenate([r.integers(0, 1 << 16, 400), [(1 << k) - 1 for k in range(17)]])).tolist()
    rows = spark.createDataFrame([(f, 0) for f in fps], "fp long, bucket long")
    found = {}
    for t in simhash.tile_pairs(rows, 2, 20).collect():
        found.setdefault((t.a, t.b), ([], []))[t.right].append(t.fp)
    met = {}
    for (a, b), (left, right) in found.items():
        assert len(left) <= 60 and len(right) <= 60 and a <= b
        for x in left:
            for y in left if a == b else right:
                if x != y:
                    met[min(x, y), max(x, y)] = met.get((min(x, y), max(x, y)), 0) + (1 if a != b else 0.5)
    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= 2:
                assert met[x, y] == 1
    tiles = 1 + max(b for _, b in found)
    assert tiles > 15 and len(found) < tiles * (tiles + 1) / 2


def test_one_group_of_many(make_docs):
    """A third of all rows in one component, and names that clash."""
    texts = ["same " * 60] * 200 + near_copies(4, 120)
    docs = make_docs(list(enumerate(texts))).withColumnsRenamed({"lang": "fp", "n_chars": "root"})
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(list(range(len(texts))), fps)
    assert {r.doc_id: r.component_id for r in simhash.report(docs).collect()} == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())
