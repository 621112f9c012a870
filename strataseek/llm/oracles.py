"""DuckDB SQL for the queries that SQL can express over whole tables."""

SQL: dict[str, str] = {}

SQL["op10_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
       unnest(ls) WITH ORDINALITY AS u(line, pos)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (s.key IS NOT NULL AND k.doc_id <> s.keeper) AS lost
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE lost))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_STOP = "the|of|and|to|in|a|is|that|for|with|der|die|das|und|ein|ist|von|mit|le|la|les|de|et|des|que|un|est|el|los|las|en|y|del|por"
_COUNT = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"

SQL["op5_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d
), k AS (
  SELECT doc_id, i, word || chr(1) || lead(word, 1) OVER o || chr(1) || lead(word, 2) OVER o || chr(1) || lead(word, 3) OVER o || chr(1) || lead(word, 4) OVER o AS key
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM k WHERE key IS NOT NULL) WHERE n > 1
), r AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) v(o) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, t, len(ls) AS n_lines, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
         {_COUNT('[#*$%&|<>]')} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id
), b AS (
  SELECT *, (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AS base_failed FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars > 14 * n_words OR word_chars < 2 * n_words OR n_dup_lines * 10 > n_lines * 3
            OR {_COUNT(chr(92) + 'p{Lu}')} * 10 > word_chars * 4 OR {_COUNT('[!?]')} * 4 > n_words
            OR NOT regexp_matches(t, '(?i)(?:^|[^\p{{L}}])(?:{_STOP})(?:[^\p{{L}}]|$)')
            OR {_COUNT(chr(92) + 'p{L}')} * 10 < word_chars * 6
            OR {_COUNT('(?m)(?:[.][.][.]|…)$')} * 10 > n_lines * 3 OR {_COUNT('(?m)^[ ' + chr(92) + 't]*[-*•]')} * 10 > n_lines * 9) AS kept
FROM b
"""

_MARKED = "'<|im_end|><|im_start|>assistant ok'"
_ESCAPED = lambda c: rf"regexp_replace({c}, '<(\\*)\|', '<\\\1|', 'g')"

SQL["op12_chat_replies"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_MARKED} UNION ALL SELECT -1, 1, 'assistant', {_MARKED}
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS pos FROM t
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said,
         coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS learnt,
         sum(length({_ESCAPED('text')}) + length(replace({_ESCAPED('role')}, chr(10), '<|nl|>')) + length('<|im_start|><|im_end|>') + 2) AS formatted_chars
  FROM r GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM c
"""

SQL["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), v AS (
  SELECT lang, count(*)::HUGEINT AS kinds, sum(n_lang)::HUGEINT AS total FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), s AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL
), f AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + v.kinds) AS p,
         1 + (1000000000::HUGEINT * (n_lang + 1)) // (v.total + v.kinds) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
       LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT i.lang, i.source, j.source AS item, sum(((i.p - j.p) * (i.p - j.p)) // j.p) AS value
             FROM f i JOIN f j ON i.lang = j.lang AND i.term = j.term AND i.source <> j.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM f WHERE n > 0 AND p > q
), both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 200
"""
