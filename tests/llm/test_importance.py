import random

import numpy as np
import pytest

from stratagrid.llm import importance


def corpus(n=800, seed=1):
    r = random.Random(seed)
    good = [f"word{i}" for i in range(60)]
    bad = [f"junk{i}###" for i in range(60)]
    quality = [int(r.random() < 0.85) for _ in range(n)]
    return [" ".join(r.choice(good if q else bad) for _ in range(r.randint(20, 80))) for q in quality], quality


def test_against_brute_force(spark, make_docs):
    texts, quality = corpus()
    docs = make_docs(list(enumerate(texts))).select("doc_id", "text")
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(quality) if i % 2], "doc_id long, quality int")
    rows = {r.doc_id: r for r in importance.report(docs, labels).collect()}
    hashes = importance._Hashes()
    bags = [np.bincount(importance.buckets(t.encode(), hashes), minlength=importance.BUCKETS) for t in texts]
    raw = np.sum(bags, axis=0) + 1.0
    raw = raw / raw.sum()
    target = np.sum([b for i, b in enumerate(bags) if i % 2 and quality[i]], axis=0) + 10_000 * raw
    logs = np.log(target / target.sum()) - np.log(raw)
    for i, bag in enumerate(bags):
        assert rows[i].log_weight == pytest.approx(bag @ logs)
    keys = sorted((r.gumbel_key for r in rows.values()), reverse=True)
    k = sum(r.log_weight >= importance.FLOOR for r in rows.values())
    assert {i for i, r in rows.items() if r.kept} == {i for i, r in rows.items() if r.gumbel_key >= keys[k - 1]}
    assert importance.resample(docs, labels, share=0.25).filter("kept").count() == len(texts) // 4
    held = [i for i in range(0, len(texts), 2)]
    assert sum(rows[i].kept == bool(quality[i]) for i in held) / len(held) > 0.95


@pytest.mark.parametrize("values", [[1.0], [2.0] * 50, [float(i % 7) for i in range(100)], list(np.random.default_rng(1).normal(size=500)), [1e-300, 2e-300, 1e300]])
def test_kth_largest(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    for k in {1, 2, len(values) // 2 + 1, len(values), len(values) + 5}:
        assert importance.kth_largest(rows, "x", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]


def test_odd_inputs(spark, make_docs, odd_texts):
    labels = spark.createDataFrame([(0, 1), (None, 1), (7, 1), (7, 1)], "doc_id long, quality int")
    docs = make_docs(list(enumerate(odd_texts)) + [(None, "x"), (7, odd_texts[7])])
    rows = importance.report(docs, labels).collect()
    assert len(rows) == len(odd_texts) + 2 and all(r.log_weight == 0 for r in rows if r.doc_id in (0, 1, 2, 3))
    assert importance.report(docs, labels.limit(0)).filter("log_weight <> 0").count() == 0
    assert importance.report(docs.limit(0), labels).count() == 0
