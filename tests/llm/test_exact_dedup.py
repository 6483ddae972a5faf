import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stratagrid.llm import exact_dedup


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    best, size = {}, {}
    for i, text in rows:
        k = normal(text)
        best[k] = max(best.get(k, i), i)
        size[k] = size.get(k, 0) + 1
    return sorted((i, best[k := normal(t)], size[k], i == best[k], hashlib.sha256(k.encode()).hexdigest()) for i, t in rows)


def some(odd_texts, n=500):
    r = random.Random(1)
    texts = odd_texts + ["É", "é", "Hot Copy"] + [f"text {i}" for i in range(50)]
    return [(i, "hOT cOPY" if r.random() < 0.3 else r.choice(texts)) for i in r.sample(range(-100, 10_000), n)]


@pytest.mark.parametrize("salts", [1, 16])
def test_against_brute_force(make_docs, odd_texts, salts, monkeypatch):
    monkeypatch.setattr(exact_dedup.classes, "__defaults__", ("doc_id", "text", salts))
    rows = some(odd_texts)
    assert sorted(map(tuple, exact_dedup.verdicts(make_docs(rows)).collect())) == brute(rows)


def test_digests_that_collide(make_docs, monkeypatch):
    """Contents are compared where a digest stands for several."""
    real = exact_dedup._rows
    monkeypatch.setattr(exact_dedup, "_rows", lambda *a: real(*a).withColumn("digest", exact_dedup.F.substring("content", 1, 1)))
    rows = [(1, "a1"), (2, "a2"), (3, "A1"), (4, "b"), (5, "c"), (6, "C"), (7, None), (8, "")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.verdicts(make_docs(rows)).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True), 5: (6, 2, False), 6: (6, 2, True), 7: (8, 2, False), 8: (8, 2, True)}


def test_deduplicate(spark, make_docs, odd_texts):
    rows = some(odd_texts)
    docs = make_docs(rows)
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(b[0] for b in brute(rows) if b[3])


def test_repeated_rows_null_ids_clashes_and_empty(spark, make_docs):
    docs = spark.createDataFrame([(5, "A", 1), (5, "a", 2), (4, "a", 3), (None, "b", 4), (None, "B", 5), (None, "c", 6), (1, "c", 7)], "doc_id long, text string, digest int").repartition(1)
    got = exact_dedup.verdicts(docs).collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 3
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text.lower()) for r in kept.collect()) == [(0, "b"), (1, "c"), (5, "a")]
    assert exact_dedup.verdicts(make_docs([(1, "x")]).limit(0)).count() == 0


def test_readings_in_another_order(spark, make_docs, monkeypatch):
    """Of rows that agree in id and text exactly one stays, whatever order later readings bring them in."""
    real = exact_dedup._rows
    docs = make_docs([(1, "a"), (1, "A"), (1, "a"), (2, "b"), (3, "c"), (3, "C"), (None, "n"), (None, "N")])
    turned = make_docs([(1, "A"), (3, "c"), (1, "a"), (None, "N"), (2, "b"), (1, "a"), (None, "n"), (3, "C")], parts=2)

    def rows(found, *columns):
        """Other places in each reading."""
        place = F.monotonically_increasing_id() + F.floor(F.rand() * 1e6).cast("long") * 1000
        return real(found, *columns).withColumn("row_no", place)

    monkeypatch.setattr(exact_dedup, "_rows", rows)
    for source in (docs, turned):
        got = exact_dedup.verdicts(source).collect()
        assert len(got) == 8 and sorted(r.doc_id or 0 for r in got if r.kept) == [0, 1, 2, 3]
        assert sorted(r.doc_id or 0 for r in exact_dedup.deduplicate(source).collect()) == [0, 1, 2, 3]
