"""Reference SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

_CHAT = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn ') + length(replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g'), chr(10), '\n'))
      + 2 + length(text) + length(regexp_extract_all(text, '</?turn')) + length(chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""

_MEASURES = (
    ("symbols", "n_symbols", "word_chars", 1000, 10),
    ("echoes", "n_echo_words", "n_words", 1000, 20),
    ("repeats", "n_repeat_words", "n_words", 1000, 50),
    ("line_copies", "n_dup_lines", "n_lines", 1000, 100),
    ("word_length", "word_chars", "n_words", 100, 100),
)

_QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS win FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
twice AS (SELECT rid, unnest(places) AS i FROM (SELECT rid, list(i) AS places FROM windows GROUP BY rid, win HAVING count(*) > 1)),
repeated AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(8) AS r(j) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_echo_words
  FROM d LEFT JOIN repeated USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
s AS (""" + " UNION ALL ".join(
    f"SELECT rid, lang, source, base_failed, '{name}' AS measure, {step} AS step, {scale} * {part} // greatest({whole}, 1) AS v FROM f"
    for name, part, whole, scale, step in _MEASURES
) + r"""),
b AS (SELECT *, greatest(length(bin(v)) - 7, 0)::BIGINT AS k FROM s),
c AS (SELECT lang, source, measure, step, (v >> k) << k AS v, count(*) AS n FROM b WHERE NOT base_failed GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY v) AS below, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM c),
q AS (SELECT lang, source, measure, step, min(v) FILTER (2 * below >= total) AS med, min(v) FILTER (4 * below >= 3 * total) AS upper FROM r GROUP BY ALL),
beyond AS (
  SELECT DISTINCT rid FROM s JOIN q ON s.measure = q.measure AND s.lang IS NOT DISTINCT FROM q.lang AND s.source IS NOT DISTINCT FROM q.source
  WHERE s.v > med + 6 * greatest(upper - med, q.step))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rid NOT IN (SELECT rid FROM beyond) AS kept
FROM f
"""

_MIX = """
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source HAVING sum(length(coalesce(text, ''))) > 0),
rated AS (SELECT source, pow(chars, 0.5) / sum(pow(chars, 0.5)) OVER () * (sum(chars) OVER () * 1.0) / chars AS rate FROM sizes),
parted AS (SELECT *, greatest(ceil(rate / 16), 1)::BIGINT AS parts FROM rated),
means AS (SELECT source, parts, rate / parts AS mean FROM parted),
probabilities AS (
  SELECT source, parts, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
  FROM means, range(81) AS r(k)),
tables AS (SELECT source, parts, list(below ORDER BY k) AS below FROM probabilities GROUP BY source, parts),
keyed AS (
  SELECT doc_id, d.source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS key, parts, below
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
drawn AS (
  SELECT doc_id, source, key, list_sum(list_transform(range(1, parts + 1), lambda part:
    len(list_filter(below, lambda p: p <= ('0x' || substr(md5('mix-1|' || key || '|' || part::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0))))::BIGINT AS n
  FROM keyed)
SELECT doc_id, source, c::INTEGER AS copy, md5('mix-1|place|' || key || '|' || c::VARCHAR) AS place
FROM drawn, unnest(range(1, n + 1)) AS u(c)
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATION = f"""
WITH i AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM_WORDS} AS w FROM documents),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
  FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(k) WHERE len(w) > 0),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
tens AS (SELECT rid, k, [word, {", ".join(f"lead(word, {j}) OVER s" for j in range(1, 10))}] AS ten FROM words WINDOW s AS (PARTITION BY rid ORDER BY k)),
spans AS (
  SELECT rid, k, size, array_to_string(ten[1:size], ' ') AS win
  FROM tens CROSS JOIN (SELECT DISTINCT size FROM windows) AS sizes WHERE ten[size] IS NOT NULL),
found AS (SELECT rid, k, s.size, item_id FROM spans s JOIN windows w ON s.win = w.win AND s.size = w.size),
hit AS (SELECT rid, count(DISTINCT k + j) AS n FROM (SELECT DISTINCT rid, k, size FROM found) AS f, unnest(range(size)) AS u(j) GROUP BY rid),
listed AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(listed.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)
"""

_REPAIR = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS r(n))),
said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place
  FROM conversations),
fated AS (
  SELECT said.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(place, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS fate
  FROM said, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS u(copy) WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), md5(text)) AS k,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS unended FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
faulty AS (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND unended AS truncated, blank OR again AS gone FROM seen),
chains(s, letters, lines, t) AS (VALUES
  (0, '', []::VARCHAR[], 0), (0, 'I', ['user:'], 2), (0, 'II', ['user:', 'assistant:'], 3), (1, '', []::VARCHAR[], 1), (1, 'I', ['user:'], 2), (1, 'II', ['user:', 'assistant:'], 3),
  (2, '', []::VARCHAR[], 2), (2, 'I', ['assistant:'], 3), (2, 'II', ['assistant:', 'user:'], 2), (3, '', []::VARCHAR[], 3), (3, 'I', ['user:'], 2), (3, 'II', ['user:', 'assistant:'], 3)),
paths AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM conversations
  UNION ALL
  SELECT conv_id, k, way.t AS state, min({'cost': best.cost + 3 * length(letters) + way.cost, 'audit': best.audit || letters || way.letter, 'lines': best.lines || lines || way.line})
  FROM (
    SELECT p.conv_id, f.k, p.best, letters, lines, unnest(list_filter([
      {'t': t, 'cost': 4, 'letter': 'D', 'line': []::VARCHAR[], 'can': true},
      {'t': CASE t WHEN 2 THEN 3 ELSE 2 END, 'cost': CASE WHEN truncated THEN 6 ELSE 3 END, 'letter': 'R', 'line': [CASE t WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text], 'can': NOT gone},
      {'t': CASE f.role[1:1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'cost': CASE WHEN truncated THEN 3 ELSE 0 END, 'letter': 'K', 'line': [f.role || ':' || f.text],
       'can': NOT gone AND (t::VARCHAR || f.role[1:1]) IN ('0s', '0u', '1u', '3u', '2a')}], lambda x: x.can)) AS way
    FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = p.k + 1 JOIN chains ON chains.s = p.state)
  GROUP BY conv_id, k, way.t),
sizes AS (
  SELECT c.conv_id, count(f.k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
ends AS (
  SELECT p.conv_id, p.k, min({'cost': best.cost + 3 * length(letters), 'audit': best.audit || letters, 'lines': best.lines || lines}) AS best
  FROM paths p JOIN chains ON chains.s = p.state WHERE chains.t = 3 OR (chains.s = 0 AND chains.t = 0) GROUP BY p.conv_id, p.k)
SELECT z.conv_id, gaps, blank, duplicate, truncated, illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM sizes z JOIN ends e ON e.conv_id IS NOT DISTINCT FROM z.conv_id AND e.k = z.n
"""

LLM_ORACLES = {"op11_conversation_repair": _REPAIR, "op13_decontamination": _DECONTAMINATION, "op6_source_mix": _MIX, "op1_chat_formatting": _CHAT, "op5_quality_rules": _QUALITY}
