"""The registered queries in SQL, for a second engine to check."""

from __future__ import annotations

LINES = r"line AS (SELECT doc_id, CAST(i AS BIGINT) AS ord, string_split(text, chr(10))[i] AS text FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"
_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_BULLETS = "['-','–','—','•','·','∙','○','◦','●','■','▪','□','◆','◇','►','▸','▶','➤','➢','‣','⁃','','…','+','*','☒','☐','✓','✔','✗','✘','✖','✕']"
_STRICT = "['•','∙','○','◦','●','■','▪','□','◆','◇','►','▸','▶','➤','➢','‣','⁃','','☒','☐','✓','✔','✗','✘','✖','✕']"
_CUR = "$¢£¤¥" + "".join(map(chr, range(0x20A0, 0x20C0)))
_NUM = rf"[\s\d,.()\[\]%\-–—−{_CUR}]+"


def _numeric(c: str) -> str:
    t = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return (
        rf"({t} IN ('-','–','—','−','%','*') OR lower({t}) IN ('na','n/a','n.a.') OR (length({t}) = 1 AND contains('{_CUR}', {t})) OR (regexp_full_match({t}, '{_NUM}') AND regexp_matches({t}, '\d') AND NOT regexp_full_match({t}, '[(\[]?\s*20[0-4]\d\s*[)\]]?'))"
        rf" OR regexp_full_match({t}, '(?i)(?:[%{_CUR}]\s*)?(?:n\.a\.|n/a|na|[-–—−*])\s*[%{_CUR}]?'))"
    )


_ROMAN = "M?(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})"
BLOCKS = rf"""{LINES},
laid AS (SELECT *, CASE WHEN lag(ord) OVER w IS NULL OR contains(text, ' | ') <> lag(contains(text, ' | ')) OVER w OR lag({_STRIP} = '') OVER w THEN 1 ELSE 0 END AS s FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
placed AS (SELECT doc_id, ord, {_STRIP} AS t, sum(s) OVER (PARTITION BY doc_id ORDER BY ord) AS block_id FROM laid),
led AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, block_id, t <> '' ORDER BY ord) = 1 THEN '' WHEN t IN ('o') OR list_contains({_BULLETS}, substr(t, 1, 1)) THEN chr(10) ELSE ' ' END AS sep FROM placed),
block AS (SELECT doc_id, CAST(block_id AS BIGINT) AS block_id, min(ord) AS ord, CAST(count(*) AS BIGINT) AS n_lines, coalesce(string_agg(CASE WHEN t <> '' THEN sep || t END, '' ORDER BY ord), '') AS text FROM led GROUP BY doc_id, block_id)"""
_TERMS = "list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{M}\\p{N}_''’]+'), lambda w: NOT list_contains(['a','an','and','are','as','at','be','by','for','from','has','have','in','is','it','its','of','on','or','that','the','this','to','was','were','will','with'], w))"
_SCORES = f"""tok AS (SELECT doc_id, text, {_TERMS} AS w FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY ALL),
asked AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark)),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM tok),
scored AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.6 + 0.4 * len(w) / a))) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN tok USING (doc_id), st GROUP BY ALL)"""
_GRID = """o AS (SELECT CAST(c_nationkey AS BIGINT) AS table_id, year(o_orderdate) AS y, o_orderpriority AS p, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""

_TREE = """h AS (SELECT CAST(r_regionkey AS BIGINT) AS id, NULL AS up, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation UNION ALL SELECT 1000 + s_suppkey, 100 + s_nationkey, s_name FROM supplier),
p AS (SELECT a.id, a.name, CASE WHEN b.id IS NULL THEN 1 WHEN c.id IS NULL THEN 2 ELSE 3 END AS depth, concat_ws(' > ', c.name, b.name, a.name) AS path, list_filter([c.id, b.id, a.id], lambda x: x IS NOT NULL) AS ids,
  CASE WHEN b.id IS NULL THEN '# ' || a.name WHEN c.id IS NULL THEN '# ' || b.name || chr(10) || '## ' || a.name ELSE '# ' || c.name || chr(10) || '## ' || b.name || chr(10) || '### ' || a.name END AS crumb
  FROM h a LEFT JOIN h b ON a.up = b.id LEFT JOIN h c ON b.up = c.id)"""
_WORDS = """w AS (SELECT CAST(l_orderkey % 50 AS BIGINT) AS doc_id, CAST(l_partkey // 400 AS BIGINT) AS page_number, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS word_id, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST((l_orderkey * 7 + l_linenumber * 13) % 700 AS DOUBLE) AS y0, x0 + CAST(l_quantity AS DOUBLE) + 1 AS x1, y0 + 10 AS y1 FROM lineitem),
l AS (SELECT CAST(p_partkey % 50 AS BIGINT) AS doc_id, CAST(p_partkey // 400 AS BIGINT) AS page_number, CAST(p_partkey AS BIGINT) AS link_id, CAST(p_partkey * 31 % 450 AS DOUBLE) AS x0, CAST(p_partkey * 17 % 650 AS DOUBLE) AS y0, x0 + 80 AS x1, y0 + 40 AS y1 FROM part)"""

ORACLES: dict[str, str] = {
    "doc_lines": f"WITH {LINES} SELECT doc_id, ord, text FROM line",
    "line_features": rf"""WITH {LINES} SELECT doc_id, ord, CAST(length(text) AS BIGINT) AS char_count, CAST(len(regexp_extract_all(text, '\p{{L}}')) AS BIGINT) AS alpha_count, CAST(len(regexp_extract_all(text, '\p{{Nd}}')) AS BIGINT) AS digit_count,
        CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS uppercase_count, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS word_count,
        CAST(len(list_filter(regexp_extract_all(text, '\S+'), lambda w: regexp_matches(w, '\p{{L}}'))) AS BIGINT) AS alpha_word_count, CAST(len(list_filter(regexp_extract_all(text, '\S+'), lambda w: regexp_matches(w, '^\p{{Lu}}'))) AS BIGINT) AS capitalized_word_count FROM line""",
    "line_masks": rf"""WITH {LINES}, s AS (SELECT doc_id, ord, text, {_STRIP} AS t FROM line)
        SELECT doc_id, ord, t = 'o' OR (t <> '' AND list_contains({_BULLETS}, substr(t, 1, 1))) AS is_bullet, t <> '' AND list_contains({_STRICT}, substr(t, 1, 1)) AS is_strict_bullet,
        t <> '' AND (t = 'o' OR list_contains({_BULLETS}, t) OR regexp_full_match(t, '(?i)\d+(\.\d+)*\.?(\([A-Za-z0-9]{{1,4}}\))*|\([A-Za-z0-9]{{1,4}}\)|\d{{1,2}}\)|[A-Za-z]\)|\[\d+\]|[A-Za-z]\.') OR regexp_full_match(t, '(?i){_ROMAN}\)?') AND t <> ')' OR regexp_full_match(t, '(?i){_ROMAN}\.') AND t <> '.') AS is_list_marker,
        len(regexp_extract_all(t, '\S+')) > 0 AND len(list_filter(regexp_extract_all(t, '\S+'), lambda w: NOT ({_numeric('w')} OR regexp_full_match(w, '[(\[]?\s*20[0-4]\d\s*[)\]]?') OR (regexp_full_match(w, '(?i){_NUM}(k|m|mm|b|bn|tn)') AND regexp_matches(w, '\d'))))) = 0 AS is_numeric, contains(text, ' | ') AS is_table_row FROM s""",
    "cell_values": rf"""WITH {LINES}, c AS (SELECT doc_id, ord, CAST(i - 1 AS BIGINT) AS col, string_split(text, ' | ')[i] AS cell FROM (SELECT *, unnest(range(1, len(string_split(text, ' | ')) + 1)) AS i FROM line WHERE contains(text, ' | '))),
        t AS (SELECT *, regexp_replace(cell, '^\s+|\s+$', '', 'g') AS s FROM c)
        SELECT doc_id, ord, col, {_numeric('cell')} AS is_numeric, length(s) = 1 AND contains('{_CUR}', s) AS is_currency,
        CASE WHEN s = '' OR length(s) > 9 THEN NULL WHEN regexp_full_match(s, '\d{{1,3}}') THEN 'arabic' WHEN regexp_full_match(s, '(?i){_ROMAN}') THEN 'roman' WHEN regexp_full_match(s, '[A-Za-z]-?\d{{1,3}}') THEN 'alpha_numeric'
             WHEN regexp_full_match(s, '(?i)[A-Za-z]-[ivxlcdm]{{1,7}}') THEN 'alpha_roman' WHEN regexp_full_match(s, '(?i)[IVXLCDM]{{1,6}}-\d{{1,3}}') THEN 'roman_numeric' WHEN regexp_full_match(s, '[A-Za-z]-\d{{1,3}}-\d{{1,3}}') THEN 'alpha_numeric_sub' WHEN regexp_full_match(s, '\d{{1,4}}/\d{{1,3}}') THEN 'arabic_sub' END AS label_type FROM t""",
    "block_text": f"WITH {BLOCKS} SELECT doc_id, block_id, ord, n_lines, text, CAST(length(text) AS BIGINT) AS embed_char_count FROM block",
    "document_rollup": rf"""WITH {LINES}, f AS (SELECT doc_id, ord, CAST(length(text) AS BIGINT) AS c, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS w, nullif({_STRIP}, '') AS t, len(regexp_extract_all(text, '[A-Z]')) AS u FROM line)
        SELECT doc_id, min(ord) AS ord, CAST(sum(c) AS BIGINT) AS char_count, CAST(sum(w) AS BIGINT) AS word_count, bool_or(c > 200) AS is_long, arg_min(t, ord) FILTER (t IS NOT NULL) AS first_text,
        CASE WHEN first(c ORDER BY c DESC, ord) % 2 = 0 THEN 'even' END AS top_kind, round(coalesce(sum(CASE WHEN c > 0 THEN u END) / nullif(sum(CASE WHEN c > 0 THEN c END), 0), 0), 9) AS upper_ratio,
        array_to_string(list_sort(list_distinct(list(c))), ',') AS sizes, (SELECT string_agg(k, ',' ORDER BY o) FROM (SELECT 'k' || (c % 3) AS k, min(ord) AS o FROM f g WHERE g.doc_id = f.doc_id GROUP BY k)) AS kinds, min(c) AS y_top, max(c) AS y_bottom, CAST(count(*) AS BIGINT) AS n_lines FROM f GROUP BY doc_id""",
    "greedy_chunks": f"""WITH RECURSIVE {BLOCKS}, q AS (SELECT doc_id, ord, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM block),
        g AS (SELECT doc_id, ord, k, 1 AS chunk, n AS held FROM q WHERE k = 1 UNION ALL
              SELECT q.doc_id, q.ord, q.k, CASE WHEN held > 0 AND held + n > 1500 THEN chunk + 1 ELSE chunk END, CASE WHEN held > 0 AND held + n > 1500 THEN n ELSE held + n END FROM g JOIN q ON g.doc_id = q.doc_id AND q.k = g.k + 1)
        SELECT doc_id, ord, CAST(chunk AS BIGINT) AS chunk FROM g""",
    "token_totals": "SELECT source, lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY ALL",
    "bm25_scores": f"WITH {_SCORES} SELECT query_id, doc_id, round(score, 6) AS score FROM scored",
    "search_top": rf"""WITH {_SCORES}, q AS (SELECT item_id AS query_id, trim(text) AS t FROM benchmark),
lit AS (SELECT query_id, doc_id FROM q, documents d WHERE t <> '' AND regexp_matches(d.text, '(?i)' || CASE WHEN regexp_matches(t, '^[\p{{L}}\p{{N}}_]') THEN '(^|[^\p{{L}}\p{{M}}\p{{N}}_])' ELSE '' END || regexp_escape(t) || CASE WHEN regexp_matches(t, '[\p{{L}}\p{{N}}_]$') THEN '($|[^\p{{L}}\p{{M}}\p{{N}}_])' ELSE '' END)),
hit AS (SELECT query_id, doc_id, coalesce(score, 0) AS score, lit.doc_id IS NOT NULL AS literal FROM scored FULL JOIN lit USING (query_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY literal DESC, round(score, 9) DESC, doc_id) AS rank FROM hit)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, literal, round(score, 6) AS score FROM r WHERE rank <= 8""",
    "unmatched_terms": f"SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark) WHERE term NOT IN (SELECT unnest({_TERMS}) FROM conversations WHERE text IS NOT NULL)",
    "table_roles": f"""WITH {_GRID}, c AS (SELECT DISTINCT table_id, y, dense_rank() OVER (ORDER BY y) AS c FROM o), r AS (SELECT DISTINCT table_id, p, dense_rank() OVER (ORDER BY p) + 1 AS r FROM o),
        cell AS (SELECT table_id, r.r AS row_start, c.c AS col_start, 'data' AS role FROM o JOIN c USING (table_id, y) JOIN r USING (table_id, p) UNION ALL SELECT table_id, r, 0, 'row_label' FROM r UNION ALL SELECT table_id, 1, c, 'header' FROM c
                 UNION ALL SELECT DISTINCT table_id, 0, 0, 'header' FROM o UNION ALL SELECT DISTINCT table_id, 0, 1, 'header' FROM o)
        SELECT table_id, CAST(row_start AS BIGINT) AS row_start, CAST(col_start AS BIGINT) AS col_start, role AS table_cell_role, CASE WHEN row_start > 1 THEN 'numeric' ELSE 'text' END AS row_style FROM cell""",
    "table_melted": f"""WITH {_GRID} SELECT table_id, p AS label, 'Orders > ' || y AS header, CAST(n AS VARCHAR) AS value FROM o""",
    "table_markdown": f"""WITH {_GRID}, ys AS (SELECT DISTINCT y FROM o), ts AS (SELECT table_id, max(y) AS my FROM o GROUP BY table_id), base AS (SELECT table_id, y FROM ts JOIN ys ON y <= my),
        h AS (SELECT table_id, '| Priority | ' || string_agg('Orders', ' | ' ORDER BY y) || ' |' AS a, '|  | ' || string_agg(CASE WHEN (table_id, y) IN (SELECT table_id, y FROM o) THEN CAST(y AS VARCHAR) ELSE '' END, ' | ' ORDER BY y) || ' |' AS b, '|---|' || string_agg('---', '|' ORDER BY y) || '|' AS c FROM base GROUP BY table_id),
        b AS (SELECT table_id, p, '| ' || p || ' | ' || string_agg(coalesce(CAST(n AS VARCHAR), ''), ' | ' ORDER BY base.y) || ' |' AS l FROM base JOIN (SELECT DISTINCT table_id, p FROM o) USING (table_id) LEFT JOIN o USING (table_id, p, y) GROUP BY table_id, p)
        SELECT table_id, a || chr(10) || b || chr(10) || c || chr(10) || ls AS text FROM h JOIN (SELECT table_id, string_agg(l, chr(10) ORDER BY p) AS ls FROM b GROUP BY table_id) USING (table_id)""",
    "table_jsonl": f"""WITH {_GRID}, b AS (SELECT table_id, p, '{{"Priority": "' || p || '", ' || string_agg('"Orders_' || y || '": "' || n || '"', ', ' ORDER BY y) || '}}' AS l FROM o GROUP BY table_id, p)
        SELECT table_id, string_agg(l, chr(10) ORDER BY p) AS text FROM b GROUP BY table_id""",
    "chart_points": """WITH e AS (SELECT event_type AS series_name, CAST(hour(ts) AS VARCHAR) AS category, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL)
        SELECT *, round(100 * value / sum(value) OVER (PARTITION BY series_name), 1) AS percent FROM e""",
    "page_metadata": r"""SELECT page_id AS doc_id, replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title, coalesce(nullif(lower(regexp_extract(html, '<html lang="([A-Za-z]{2})', 1)), ''), 'unknown') AS language FROM pages""",
    "marker_candidates": f"""WITH {LINES} SELECT doc_id, ord, ['item','single_parens_single_alpha','single_parens_roman','numbered_heading','section','alpha_numbered_heading','table',NULL,NULL][ord % 9 + 1] AS hierarchy_type,
        ['Item','(a)','(iv)','12.3','Section','B.2','Table',NULL,NULL][ord % 9 + 1] AS hierarchy_marker FROM line""",
    "heading_score": rf"""WITH {LINES}, f AS (SELECT doc_id, ord, length(text) AS c, len(regexp_extract_all(text, '[A-Z]')) AS u, len(regexp_extract_all(text, '\S+')) AS w, len(list_filter(regexp_extract_all(text, '\S+'), lambda x: regexp_matches(x, '^\p{{Lu}}'))) AS cap FROM line),
        g AS (SELECT *, round(0.7 + (c % 10) / 10, 1) AS r, CAST(c % 25 AS DOUBLE) AS gap, lead(CAST(c % 25 AS DOUBLE)) OVER (PARTITION BY doc_id ORDER BY ord) AS below, count(*) OVER (PARTITION BY doc_id, ord // 3) AS n FROM f)
        SELECT doc_id, ord, CAST(CASE WHEN r >= 1.4 THEN 3.0 WHEN r >= 1.2 THEN 2.0 WHEN r >= 1.01 THEN 1.0 WHEN r < 0.75 THEN -6.0 WHEN r < 0.95 THEN -1.0 ELSE 0.0 END + CASE WHEN c < 50 THEN 0.5 ELSE 0 END - CASE WHEN c > 100 THEN 1 ELSE 0 END - CASE WHEN c > 150 THEN 1.5 ELSE 0 END
        - CASE WHEN c > 250 THEN 3 ELSE 0 END - CASE WHEN c > 2000 THEN 2 ELSE 0 END + CASE WHEN cap / nullif(w, 0) > 0.75 THEN 0.5 ELSE 0 END + CASE WHEN ord % 3 = 0 THEN 2.5 ELSE 0 END + CASE WHEN ord % 5 = 0 THEN 1.5 ELSE 0 END + CASE WHEN ord % 11 = 0 THEN 1.5 ELSE 0 END
        + CASE WHEN u > 50 THEN 1 ELSE 0 END + CASE WHEN c % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN c % 9 = 0 THEN 1 ELSE 0 END - CASE WHEN ord % 7 = 0 THEN 5 ELSE 0 END - CASE WHEN gap > 0 AND gap <= 0.5 THEN 5 ELSE 0 END - CASE WHEN gap > 0.5 AND gap < 2 THEN 2 ELSE 0 END
        - CASE WHEN gap > 0 AND below > 0 AND gap < below THEN 0.5 ELSE 0 END + CASE WHEN gap > 0 AND below > 0 AND gap > below AND gap BETWEEN 6 AND 20 THEN 0.5 ELSE 0 END - CASE WHEN n >= 4 THEN 2 ELSE 0 END AS DOUBLE) AS score FROM g""",
    "context_adjustment": f"""WITH {LINES}, k AS (SELECT doc_id, ord, concat_ws('|', ord % 3 = 0, ord % 5 = 0, ord % 11 = 0, CASE WHEN length(text) % 6 = 0 THEN 'note' ELSE '-' END, length(text) % 10) AS s FROM line),
        n AS (SELECT *, coalesce(lag(s, 2) OVER w = s, false) AS p2, coalesce(lag(s) OVER w = s, false) AS p1, coalesce(lead(s) OVER w = s, false) AS n1, coalesce(lead(s, 2) OVER w = s, false) AS n2 FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
        SELECT doc_id, ord, CAST(CASE WHEN (p1 AND p2) OR (p1 AND n1) OR (n1 AND n2) THEN -2.0 ELSE 0.0 END + CASE WHEN NOT (p1 OR p2 OR n1 OR n2) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS adjustment FROM n""",
    "navigation_lines": f"""WITH {LINES}, f AS (SELECT doc_id, ord, text AS t FROM line WHERE ord % 2 = 0), k AS (SELECT doc_id, t FROM f GROUP BY ALL HAVING count(DISTINCT ord // 10) >= 3) SELECT doc_id, ord, t AS text FROM f JOIN k USING (doc_id, t)""",
    "event_pages": """SELECT user_id AS doc_id, event_id AS ord, CAST(1 + coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_number FROM events""",
    "heading_paths": f"""WITH {_TREE} SELECT id AS heading_id, depth, path, crumb AS breadcrumb FROM p""",
    "outline_costs": f"""WITH {_TREE}, s AS (SELECT 1000 + s_suppkey AS id, length(s_name) * 37 AS n FROM supplier), t AS (SELECT p.id, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS tokens FROM p LEFT JOIN p q ON list_contains(q.ids, p.id) LEFT JOIN s ON s.id = q.id GROUP BY p.id)
        SELECT p.id AS heading_id, tokens, repeat('  ', depth - 1) || '- ' || name || '  ~' || CASE WHEN tokens >= 10000 THEN CAST(CAST(round_even(tokens / 1000, 0) AS BIGINT) AS VARCHAR) || 'k' WHEN tokens >= 1000 THEN format('{{:.1f}}', tokens / 1000) || 'k' ELSE CAST(tokens AS VARCHAR) END AS line FROM p JOIN t USING (id)""",
    "blocks_under": "SELECT CAST(1000 + s_suppkey AS BIGINT) AS heading_id, CAST(length(s_name) * 37 AS BIGINT) AS token_count FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "found_headings": f"""WITH {_TREE}, f AS (SELECT * FROM p WHERE contains(lower(name), 'ia')) SELECT id AS heading_id, name AS text FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.id <> f.id AND list_contains(f.ids, g.id))""",
    "word_links": f"""WITH {_WORDS}, j AS (SELECT w.doc_id, w.page_number, word_id, link_id, (least(w.x1, l.x1) - greatest(w.x0, l.x0)) * (least(w.y1, l.y1) - greatest(w.y0, l.y0)) / ((w.x1 - w.x0) * (w.y1 - w.y0)) AS ratio FROM w JOIN l ON w.doc_id = l.doc_id AND w.page_number = l.page_number AND least(w.x1, l.x1) > greatest(w.x0, l.x0) AND least(w.y1, l.y1) > greatest(w.y0, l.y0))
        SELECT doc_id, page_number, word_id, link_id, round(ratio, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY word_id, doc_id, page_number ORDER BY ratio DESC, link_id) AS k FROM j WHERE ratio >= 0.5) WHERE k = 1""",
    "words_in_cells": f"""WITH {_WORDS} SELECT w.doc_id, w.page_number, word_id, min(link_id) AS link_id FROM w JOIN l ON w.doc_id = l.doc_id AND w.page_number = l.page_number AND w.x0 >= l.x0 - 1 AND w.x1 <= l.x1 + 1 AND w.y0 >= l.y0 - 1 AND w.y1 <= l.y1 + 1 GROUP BY ALL""",
    "word_lines": f"""WITH {_WORDS}, j AS (SELECT *, CASE WHEN y0 - lag(y0) OVER o <= 5 THEN 0 ELSE 1 END AS s FROM w WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY y0, x0, word_id))
        SELECT doc_id, page_number, word_id, CAST(sum(s) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, word_id) AS BIGINT) AS line_id FROM j""",
    "line_gaps": f"""WITH {_WORDS}, j AS (SELECT *, CASE WHEN y0 - lag(y0) OVER o <= 5 THEN 0 ELSE 1 END AS s FROM w WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY y0, x0, word_id)),
        n AS (SELECT *, CAST(sum(s) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, word_id) AS BIGINT) AS line_id FROM j), g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, page_number, line_id ORDER BY x0, word_id, x1) AS gap FROM n)
        SELECT doc_id, page_number, line_id, CAST(count(*) AS BIGINT) AS n_words, median(gap) AS median_gap, max(gap) AS widest_gap, coalesce(median(gap) > 0 AND max(gap) >= 3 * median(gap), false) AS bimodal FROM g GROUP BY ALL""",
    "language_votes": r"""WITH w AS (SELECT doc_id, length(text) AS n, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents),
        v AS (SELECT doc_id, n, code, len(list_filter(w, lambda x: list_contains(own, x))) AS k FROM w, (VALUES ('de', ['der','die','das','und','nicht','ist','mit','von','ein','zu']), ('en', ['the','and','of','to','in','is','that','it','for','with']), ('es', ['el','la','los','de','que','y','en','un','por','con']), ('fr', ['le','la','les','et','des','que','est','pour','dans','un'])) AS t(code, own))
        SELECT doc_id, CASE WHEN n >= 50 AND k > 0 THEN code ELSE 'unknown' END AS language, CAST(k AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, code) AS r FROM v) WHERE r = 1""",
    "first_titles": rf"""WITH {LINES} SELECT doc_id, arg_min({_STRIP}, ord) AS title FROM line WHERE length({_STRIP}) > 5 GROUP BY doc_id""",
    "markdown_export": f"""WITH {BLOCKS} SELECT doc_id, string_agg('<!-- page ' || block_id || ' -->' || chr(10) || chr(10) || CASE WHEN block_id = 1 THEN '## ' ELSE '' END || trim(text), chr(10) || chr(10) ORDER BY ord) AS text FROM block WHERE trim(text) <> '' GROUP BY doc_id""",
}
