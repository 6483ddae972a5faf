import hashlib
import random
import re

from stratagrid.llm import secret_scan
from stratagrid.llm.automaton import compile_patterns

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                found.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def mixed(n, seed):
    r = random.Random(seed)
    parts = ["password", "PassWd", "api_key", "apikey", "token", "ſecret", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH", "12345678", "deadbeef", "x", "\n", "-", "é", "日", "abcdef", "Z9"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_base_spans_equal_those_of_re(make_docs, odd_texts):
    texts = odd_texts + mixed(3000, 1)
    rows = secret_scan.report(make_docs(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = brute(texts[row.doc_id])
        assert [x for x in row.spans.split(",") if x.split(":")[0] in secret_scan.BASE_KINDS] == want
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in PATTERNS)


def test_further_kinds(make_docs):
    text = "é ghp_" + "a1B2" * 10 + " xoxb-1234567890-ab AIza" + "x" * 35 + "\n-----BEGIN RSA PRIVATE KEY-----"
    row = secret_scan.report(make_docs([(1, text)])).first()
    assert [x.split(":")[0] for x in row.spans.split(",")] == ["github", "slack", "google", "pem"]
    assert row.spans.split(",")[0] == "github:2:46"


def test_empty_table_and_clashing_names(spark, make_docs):
    assert secret_scan.report(make_docs([(1, "x")]).limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "token=abcdefgh", 5, 6)], "doc_id long, text string, secrets int, scanned_text int")
    out = secret_scan.scan(docs)
    assert out.columns == ["doc_id", "text", "scanned_text", "secrets"]
    assert [tuple(x) for x in out.first().secrets] == [("assign", 0, 14)]


def test_automaton_against_re():
    r = random.Random(3)
    for pattern in ["a(b|c)*d", "a{2,3}b?", "(?:ab|a)c+", "[^a]b", "x?y?z{2}", "(a|b){1,2}c"]:
        rows, again = compile_patterns([(pattern, False)]).rows()[0], re.compile(pattern)
        for _ in range(300):
            text = "".join(r.choice("abcdxyz") for _ in range(r.randint(0, 7)))
            row, ends = rows, False
            for b in text.encode():
                row = row[b] if row else None
            ends = bool(row and row[256])
            assert ends == bool(again.fullmatch(text)), (pattern, text)
