"""The queries that SQL can express, for DuckDB."""

from __future__ import annotations

from .quality_rules import MAX_REPEATED, MIN_WORDS, RULES, STOP_WORDS, verdict_sql

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
      length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      len(ls)::BIGINT AS n_lines,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
      coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
      len(list_filter([{_STOP}], lambda x: list_contains(ws, x)))::BIGINT AS n_stop_words,
      len(list_filter(ws, lambda x: regexp_matches(x, '^[^a-z]*[A-Z][A-Z][^a-z]*$')))::BIGINT AS n_shouted,
      len(list_filter(ls, lambda x: regexp_matches(x, '^ *[•*-]')))::BIGINT AS n_bullet_lines,
      len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…) *$')))::BIGINT AS n_ellipsis_lines
      FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {verdict_sql(RULES)} AS kept FROM f
"""

_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""

ORACLE_SQL = {"op1_quality_rules": OP1, "op3_exact_dedup": OP3}
