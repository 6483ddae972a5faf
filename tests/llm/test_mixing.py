import math
import random

from stratagrid.llm import mixing


def wanted(sizes):
    """The targets by the rule as it is told: share, stop at twice the size, share the excess again."""
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode("utf-8")) + [None] * (None in sizes)
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(weight[k] for k in free)
        above = {k for k in free if left * weight[k] / total > 2 * sizes[k]}
        if not above:
            return out | {k: left * weight[k] / total for k in free}
        for k in above:
            out[k] = 2.0 * sizes[k]
        left -= sum(out[k] for k in above)
        free -= above
    return out


def corpus(seed, n=2000):
    r = random.Random(seed)
    names = ["b", "a", "é", "Z", "10", "9", None, "日"]
    return [(i, " ".join(["w"] * int(r.lognormvariate(4, 1))) if r.random() > 0.02 else r.choice([None, "", " "]), names[0] if r.random() < 0.35 else r.choice(names)) for i in range(n)]


def check(docs, rows):
    rows = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    sizes, largest, taken = {}, {}, {}
    for i, text, source in docs:
        n = len((text or "").split())
        assert rows[i]["size"] == n and 0 <= rows[i].taken <= 2 * n and (not n or rows[i].taken % n == 0)
        sizes[source] = sizes.get(source, 0) + n
        largest[source] = max(largest.get(source, 0), n)
        taken[source] = taken.get(source, 0) + rows[i].taken
    want = wanted(sizes)
    for i, _, source in docs:
        assert rows[i].source_size == sizes[source] and math.isclose(rows[i].target, want[source], rel_tol=1e-9, abs_tol=1e-9)
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source] / 2 + 1e-6, source


def test_targets_and_taken(make_docs):
    docs = corpus(1)
    table = make_docs(docs)
    first = mixing.report(table).collect()
    check(docs, first)
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.report(table).collect()))


def test_few_documents(make_docs):
    docs = [(1, "a b c", "x"), (2, "a", "y"), (3, None, None), (4, "", "z"), (5, "a b " * 50, "x")]
    check(docs, mixing.report(make_docs(docs)).collect())


def test_no_words_and_no_rows(make_docs):
    assert [(r.taken, r.target) for r in mixing.report(make_docs([(1, None, None), (2, "", "a")])).collect()] == [(0, 0.0), (0, 0.0)]
    assert mixing.report(make_docs([(1, "a")]).limit(0)).count() == 0


def test_mix_repeats_rows(spark, make_docs):
    docs = corpus(2, 600)
    table = make_docs(docs)
    n = {r.doc_id: (r.taken, r["size"]) for r in mixing.report(table).collect()}
    out = mixing.mix(table)
    assert out.columns == table.columns
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(got.get(i, 0) * size == taken for i, (taken, size) in n.items())


def test_repeated_ids_and_clashing_names(spark):
    rows = [(1, "a b", "s", 3)] * 3 + [(None, "a", "s", 4), (None, "a", None, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    assert mixing.report(table).count() == 5
    assert mixing.mix(table).columns == table.columns


def test_tilts_against_bisection(make_docs):
    """The multipliers that Newton's steps find are those that another solver finds, and most aren't 0."""
    docs = corpus(7)
    rows, _ = mixing.plan(make_docs(docs))
    histogram = rows.groupBy("key", "size").count().withColumnRenamed("count", "n")
    targets = mixing.targets(histogram.selectExpr("key", "size * n AS size"), share=0.8)
    found = {r.key: r for r in mixing.tilts(histogram, targets).collect()}
    sizes = {}
    for _, text, source in docs:
        sizes.setdefault("" if source is None else "=" + source, []).append(len((text or "").split()))
    tilted = 0
    for key, own in sizes.items():
        target = found[key].target
        if target >= 2 * sum(own):
            continue
        unit = sum(n * n for n in own) / sum(own)
        low, high = -50.0, 50.0
        for _ in range(200):
            middle = (low + high) / 2
            taken = sum(n * 2 / (1 + math.exp(min(700, -middle * n / unit))) for n in own)
            low, high = (middle, high) if taken < target else (low, middle)
        assert math.isclose(found[key].tilt, low, rel_tol=1e-5, abs_tol=1e-7), key
        tilted += abs(low) > 0.01
    assert tilted >= 4
