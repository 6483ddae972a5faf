import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source), over a few partitions."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts, "doc_id")

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and other unusual texts."""
    r = random.Random(5)
    long_text = " ".join(r.choice(["the", "of", "grid", "cell", "point", "naïve", "日本"]) for _ in range(30_000))
    return [None, "", " ", "\n\n", "a", "A b", "a B", long_text, long_text, long_text + " end", "x" * 5000, "ß ẞ İ é É", "tab\tand\x0bvt\x0cff\r\nnl", "🙂 emoji 🙂 emoji 🙂 emoji", "don't won't I'LL 12345 ...  \n  x"]
