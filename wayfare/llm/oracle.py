"""DuckDB SQL for the queries that SQL can express."""

#: Words are runs of anything but U+0020 and U+0009 to U+000D.
OP9 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w) WHERE i + 2 <= len(words)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri), range(3) r(k)
        WHERE c >= 2 GROUP BY doc_id),
f AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_symbols > 0.1::DOUBLE * n_words OR n_dup_lines >= 5 OR word_chars::DOUBLE / greatest(n_words, 1) < 2 OR word_chars::DOUBLE / greatest(n_words, 1) > 15 AS soft FROM f),
h AS (SELECT source, count(*) AS n_docs, sum((base_failed OR soft)::BIGINT) AS n_failed FROM g GROUP BY source),
m AS (SELECT sum(n_failed)::DOUBLE / sum(n_docs) AS mu, coalesce(var_samp(n_failed::DOUBLE / n_docs), 0) AS v FROM h),
p AS (SELECT mu, CASE WHEN v > 0 THEN least(1000.0::DOUBLE, greatest(1.0::DOUBLE, mu * (1 - mu) / v - 1)) ELSE 1000.0::DOUBLE END AS s FROM m),
hr AS (SELECT source, round((n_failed + mu * s) / (n_docs + s), 6) AS host_rate FROM h, p)
SELECT g.doc_id, g.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, base_failed OR soft AS failed,
       host_rate, host_rate > 0.5 AS host_bad, NOT base_failed AND NOT (host_rate > 0.5 AND (base_failed OR soft)) AS kept
FROM g JOIN hr ON g.source IS NOT DISTINCT FROM hr.source
"""

ORACLES = {"op9_host_quality": OP9}
