import random
import re

from stratagrid.llm import quality_rules
from stratagrid.llm.quality_rules import Rule


def brute(text):
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for found in windows.values() if len(found) > 1 for i in found for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def texts(n, seed):
    r = random.Random(seed)
    words = ["the", "of", "and", "naïve", "日本語", "a", "cell#", "GRID", "x|y", "...", "• item", "\n", "\n", "line one\n", "\t", "\r\n", "🙂"]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 120))) for _ in range(n)]


def test_measures_against_brute_force(make_docs, odd_texts):
    found = odd_texts + texts(400, 1)
    rows = quality_rules.apply_rules(make_docs(list(enumerate(found))).select("doc_id", "text")).collect()
    assert len(rows) == len(found)
    for r in rows:
        want = brute(found[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)


def good(seed):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(["the", "of", "and", f"word{r.randint(0, 9999)}"]) for _ in range(12)) + "." for _ in range(8))


def test_each_rule(make_docs):
    base = good(1)
    words = base.split()
    bad = {
        "short": "the of and few words", "symbols": base.replace(" ", " # "), "shout": base.upper(), "no stop words": " ".join(f"w{i}" for i in range(80)), "long words": " ".join(w * 4 + str(i) for i, w in enumerate(words)),
        "bullets": "\n".join("- " + x for x in base.split("\n")), "ellipses": "\n".join(x + "..." for x in base.split("\n")), "repeats": " ".join(words[:20] * 5),
    }
    names = ["good", *bad]
    rows = {names[r.doc_id]: r.kept for r in quality_rules.apply_rules(make_docs(list(enumerate([base, *bad.values()])))).collect()}
    assert rows["good"] and not any(rows[k] for k in bad), rows


def test_own_rules_clashes_and_empty(spark, make_docs):
    docs = spark.createDataFrame([(1, good(2), 7), (1, good(2), 7), (2, None, 8)], "doc_id long, text string, n_words int")
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns and [(r.doc_id, r.n_words) for r in out.collect()] == [(1, 7), (1, 7)]
    none = quality_rules.apply_rules(docs, [Rule("few", "n_words", high=10)])
    assert none.filter("kept").count() == 0
    assert quality_rules.apply_rules(make_docs([(1, "x")]).limit(0)).count() == 0


def test_verdict_stays_above_the_measures(make_docs):
    """Else the optimizer writes each measure out for every rule that names it, and doesn't end."""
    plan = quality_rules.keep_good(make_docs([(1, "x")]))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "Python" not in plan


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7, 8)], "doc_id long, text string, words int, `lines` int, ordered int, n_words int")
    row = quality_rules.apply_rules(docs).first()
    assert (row.words, row.lines, row.ordered, row.n_words) == (5, 6, 7, 2)
