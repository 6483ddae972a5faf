import random
import zlib

import numpy as np
import pytest

from stratagrid.llm import toxicity

INSULTS = ["blockhead", "nitwit", "dunderpate", "lummox"]


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice(["ta", "ri", "mo", "le", "un", "so", "pe", "ka"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(n):
        doc = [[r.choice(words) for _ in range(r.randint(4, 12))] for _ in range(r.randint(3, 8))]
        toxic.append(int(r.random() < 0.25))
        if toxic[-1]:
            for _ in range(2):
                r.choice(doc).append(r.choice(INSULTS))
        texts.append(". ".join(" ".join(s) for s in doc) + ".")
    return texts, toxic


@pytest.fixture(scope="module")
def tables(spark):
    texts, toxic = corpus(900, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"), texts, toxic


def test_held_out_accuracy(tables):
    docs, labels, texts, toxic = tables
    rows = toxicity.report(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out]
    assert len(held) > 150 and sum(p == t for p, t in held) / len(held) > 0.97


def test_labels_of_held_out_rows_are_not_used(tables):
    docs, labels, *_ = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.report(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_gaps_and_inserted_characters(tables):
    docs, labels, *_ = tables
    model = toxicity.fit(docs, labels)
    bad = ["you blockhead.", "you b-l-o-c-k-h-e-a-d.", "a n i t w i t here", "you blockxhead.", "NIT_WIT", "lu.mm.ox"]
    good = ["tari mole unso.", "", None, "pe", "ka ka ka ka ka"]
    assert min(model.scores(bad)) > 0.3 > max(model.scores(good))


def test_likeness_equals_the_plain_kernel():
    r = random.Random(2)
    words = [toxicity.bare("".join(r.choice("abcdeé") for _ in range(r.randint(0, 9)))) for _ in range(300)]
    marks = words[:20]
    got = toxicity.Likeness(marks).of(words)
    want = np.array([[toxicity.kernel(w, m) for m in marks] for w in words])
    want[want < toxicity.FLOOR] = 0
    assert np.allclose(got, want, atol=1e-5) or np.abs(got - want)[np.abs(want - toxicity.FLOOR) > 1e-5].max() < 1e-5


def test_odd_inputs(spark, make_docs, odd_texts, tables):
    labels = tables[1]
    assert toxicity.report(make_docs(list(enumerate(odd_texts))), labels.limit(0)).count() == len(odd_texts)
    rows = toxicity.report(make_docs([(1, None), (1, None), (None, "x")]), labels).collect()
    assert len(rows) == 3 and {r.held_out for r in rows if r.doc_id is None} == {False}
    assert toxicity.report(make_docs([(1, "x")]).limit(0), labels).count() == 0
    table = spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, text string, scored_text int, score int")
    assert toxicity.score(table, toxicity.train(["a"], np.array([True]), 0.5)).columns == ["doc_id", "text", "scored_text", "score"]


def test_documents_that_share_an_id_are_learnt_from_once(tables):
    docs, labels, *_ = tables
    once, thrice = toxicity.fit(docs, labels), toxicity.fit(docs.union(docs).union(docs), labels)
    assert np.array_equal(once.curve, thrice.curve) and np.array_equal(once.weights, thrice.weights)


def test_long_words_are_scored_to_their_end(tables):
    docs, labels, *_ = tables
    model = toxicity.fit(docs, labels)
    bad = [
        " ".join("youareanabsolutecompleteblockhead"),
        "https://example.com/tari/mole/unso/peka/2024/you-are-a-blockhead",
        "tari_mole_unso_peka_tari_mole_blockhead_unso_kape_molepe",
        "tarimoleunsopekatarimoleunso" + "nitwit" + "molepekatarisounlepeka",
        "tarimole" * 9000 + "dunderpate" + "unsopeka" * 9000,
        "ta/ri/mo/le/un/so/pe/ka/ta/ri/mo/le/lummox.",
    ]
    good = ["https://example.com/tari/mole/unso/peka/2024/tari-mole-unso-peka-rimo", "tarimole" * 9000, " ".join("tarimoleunsopeka" * 3), "日本語" * 5000]
    assert min(model.scores(bad)) > 0.3 > max(model.scores(good))
    # Words in a row don't share windows.
    assert max(model.scores(["tarimoleunsopekatarimoleunsoblock headtarimoleunsopekatarimoleunso"])) < 0.3


def test_likest_window_of_a_long_word():
    r = random.Random(3)
    marks = [toxicity.bare(w) for w in ("abcdeabc", "edcba", "aabbccddeeaabbcc")] + [toxicity.START + "cdcdcd"]
    likeness = toxicity.Likeness(marks)
    words = [toxicity.bare("".join(r.choice("abcdez") for _ in range(n))) for n in (24, 25, 60, 200, 31, 26)]
    words[2] = toxicity.bare("z" * 40 + "abcdeabc" + "z" * 7)
    got = likeness.of(words)
    for w, row in zip(words, got):
        pieces = [w[i : i + n] for n in likeness.sizes for i in range(len(w) - n + 1)] if len(w) > toxicity.LONGEST + 2 else [w]
        want = np.array([max(toxicity.kernel(x, m) for x in pieces) for m in marks])
        assert np.allclose(row, np.where(want < toxicity.FLOOR, 0, want), atol=1e-4)
    assert got[2, 0] > 0.7
