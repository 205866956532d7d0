"""DuckDB SQL for the queries that SQL can express."""

_RULES = "(VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(rule_host, rule_path, rule_verdict)"

_ESCAPED = "replace({}, '\\', '\\\\')"
for _from, _to in (("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"), ("<<SYS>>", "<\\<SYS>>"), ("<</SYS>>", "<\\</SYS>>")):
    _ESCAPED = f"replace({_ESCAPED}, '{_from}', '{_to}')"

ORACLE_SQL = {
    "op4_chat_trees": f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
turns AS (
  SELECT *, length('<|im_start|>') + length(replace({_ESCAPED.format("role")}, chr(10), '\\' || chr(10))) + 1
            + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1 AS chars
  FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op5_url_filter": f"""
WITH split AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT n, page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM split),
urls AS (
  SELECT n, page_id,
         translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM parts),
fits AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM urls JOIN {_RULES} ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN fits USING (n)""",
    # as the pages are: one article each, of headings and paragraphs
    "op9_html_extraction": r"""
WITH parts AS (
  SELECT row_number() OVER () AS n, page_id, url,
         regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)</article>', 1, 's'), '</?(h[1-6]|p|div|ul|ol|li|blockquote|section)(\s[^>]*)?>') AS blocks
  FROM pages),
cleaned AS (
  SELECT n, page_id, url, list_filter(list_transform(blocks, lambda b:
           trim(regexp_replace(replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(b, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
             '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', chr(1), 'g'), chr(1), '&'), '\s+', ' ', 'g'))), lambda b: b <> '') AS blocks
  FROM parts)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, length(array_to_string(blocks, chr(10) || chr(10))) AS n_chars
FROM cleaned""",
    "op11_lexical_search": r"""
WITH docs AS (
  SELECT row_number() OVER () AS n_row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
held AS (SELECT n_row, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS documents, sum(n) AS length FROM held),
items AS (
  SELECT row_number() OVER () AS i_row, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
  FROM benchmark),
asked AS (SELECT i_row, item_id, unnest(terms) AS term FROM items),
said AS (SELECT n_row, doc_id, n, term, count(*) AS tf FROM (SELECT n_row, doc_id, n, unnest(terms) AS term FROM held) GROUP BY ALL),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM said, totals GROUP BY term, documents),
scored AS (
  SELECT i_row, item_id, n_row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // length)))) AS BIGINT) AS score
  FROM asked JOIN weighed USING (term) JOIN said USING (term), totals GROUP BY ALL)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i_row ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE score > 0) WHERE r <= 10""",
    # one turn at a time: for each state the least (cost, audit) and what is repaired so far
    "op12_turn_repair": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
marked AS (
  SELECT said.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda j: ord(k[j])::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS mark
  FROM said, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN mark = 4 THEN 'user' ELSE role END AS role,
         CASE mark WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, (VALUES (1), (2)) v(copy) WHERE mark <> 0 AND (copy = 1 OR mark = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS i
  FROM hurt),
turns AS (
  SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS prior,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
counts AS (
  SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (prior IS NOT NULL AND prior || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
closure(i, j, cost, audit, said) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']),
         (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])),
steps AS (
  SELECT conv_id, pos, state AS a, 'D' AS edit, state AS b, 3 AS cost, []::VARCHAR[] AS said FROM turns, (VALUES (0), (1), (2), (3)) v(state)
  UNION ALL
  SELECT conv_id, pos, a, CASE WHEN t.i = w THEN 'K' ELSE 'R' END, b, CASE WHEN t.i = w THEN 0 ELSE 2 END + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END,
         [CASE WHEN t.i = w THEN role WHEN w = 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
  FROM turns t, (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(a, w, b) WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, pos, 0, 'K', 1, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, [role || ':' || text] FROM turns WHERE i = 's' AND fault IN ('', 'truncated')),
walk(conv_id, pos, state, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'said': []::VARCHAR[]} FROM counts
  UNION ALL
  SELECT * FROM (
    SELECT w.conv_id, s.pos, s.b, min({'cost': best.cost + c.cost + s.cost, 'audit': best.audit || c.audit || s.edit, 'said': best.said || c.said || s.said})
    FROM walk w JOIN closure c ON c.i = w.state JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos + 1 AND s.a = c.j
    GROUP BY ALL)),
ended AS (
  SELECT w.conv_id, min({'cost': best.cost + c.cost, 'audit': best.audit || c.audit, 'said': best.said || c.said}) AS best
  FROM walk w JOIN counts k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.n = w.pos JOIN closure c ON c.i = w.state AND c.j IN (0, 3) GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
