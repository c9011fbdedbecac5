"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .passages import LONG, MARKS, MIN_WORDS, SPAN, TOKEN
from .url_filter import CHILD_SHARE, MOST_CHILDREN, PRIOR_BAD, PRIOR_WEIGHT, REJECT_AT, SAME_BELOW

OP2 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP9 = r"""
WITH RECURSIVE counts AS (
  SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1
), rates AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM counts)::DOUBLE * (SELECT sum(n) FROM counts)::DOUBLE / n AS rate FROM counts
), draws AS (
  SELECT source, greatest(1, ceil(rate / 8.0::DOUBLE))::INTEGER AS draws, rate / greatest(1, ceil(rate / 8.0::DOUBLE))::INTEGER AS mean FROM rates
), terms AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM draws
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM terms WHERE k < 63
), cdfs AS (
  SELECT source, list(cdf ORDER BY k) AS cdfs FROM terms GROUP BY source
), drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, r.draws + 1), lambda i: len(list_filter(c.cdfs, lambda x:
      x <= ('0x' || substr(md5('0|' || coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, ''))) || '|' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE))))::INTEGER AS n
  FROM documents d JOIN draws r ON r.source = coalesce(d.source, '') JOIN cdfs c ON c.source = r.source
), copies AS (
  SELECT *, unnest(range(1, n + 1))::INTEGER AS mix_copy FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, mix_copy,
  ('0x' || substr(md5('order0|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || '|' || mix_copy), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS mix_order
FROM copies
"""

#: The given pages mark their article, so a cut at the mark and at its tags gives the same text.
OP3 = r"""
WITH marked AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS inner_html FROM pages
), blocks AS (
  SELECT page_id, url, list_transform(string_split_regex(replace(regexp_replace(inner_html, '</?b>', '', 'g'), '<br>', ' '), '<[^>]*>'),
    lambda b: trim(regexp_replace(replace(replace(replace(replace(b, '&quot;', '"'), '&quot', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))) AS b FROM marked
)
SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text, length(array_to_string(list_filter(b, lambda x: x <> ''), chr(10))) AS n_chars FROM blocks
"""

_VARIABLE = (
    r"regexp_matches({0}, '^(?:[0-9]+(?:[-_.][0-9]+)*|[0-9a-f]{{8,}}(?:-[0-9a-f]{{4,}})*)(?:\.[a-z]{{2,5}})?$')"
    r" OR (regexp_matches({0}, '^[0-9A-Za-z_-]{{16,}}(?:\.[a-z]{{2,5}})?$') AND regexp_matches({0}, '[0-9]'))"
)


#: Levels of branches with many paths that the SQL below can follow; the operator has no such bound.
LEVELS = 4


def _level(k: int) -> str:
    """One level of the template tree: the open paths' branches, the variable ones among them, and the longer templates."""
    return f"""
h{k} AS (
  SELECT *, seg[1] AS here, count(*) OVER (PARTITION BY host, names, len(seg) > 0) <= {MOST_CHILDREN} AS few FROM t{k}
), w{k} AS (
  SELECT host, names FROM (SELECT host, names, here, sum(n) AS n FROM h{k} WHERE here IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) > {MOST_CHILDREN} AND count(*) > {CHILD_SHARE}::DOUBLE * sum(n)
), t{k + 1} AS (
  SELECT h.host, h.path, n, good, bad, CASE WHEN few THEN [] ELSE seg[2:] END AS seg,
    CASE WHEN here IS NULL THEN h.names ELSE list_append(h.names, CASE WHEN few THEN array_to_string(seg, '/') WHEN w.host IS NULL THEN here ELSE '*' END) END AS names
  FROM h{k} h LEFT JOIN w{k} w ON w.host = h.host AND w.names = h.names
)"""


def _judged(k: int) -> str:
    """The smoothed shares of level k from those of its parents."""
    return f"""
f{k} AS (
  SELECT c.*, p.impurity AS above, p.labels AS above_labels, p.n AS above_n, sum(c.labels) OVER family AS m, sum(c.bad) OVER family AS all_bad
  FROM nodes c JOIN j{k - 1} p ON c.depth = {k} AND p.host = c.host AND p.names = c.names[:{k - 1}] WINDOW family AS (PARTITION BY c.host, c.names[:{k - 1}])
), s{k} AS (
  SELECT *, CASE WHEN labels > 0 AND m > labels THEN CASE WHEN all_bad = 0 OR all_bad = m THEN true
    ELSE abs(bad / labels - (all_bad - bad) / (m - labels)) / sqrt(all_bad / m * (1 - all_bad / m) * (1 / labels + 1 / (m - labels))) < {SAME_BELOW}::DOUBLE END ELSE false END AS same FROM f{k}
), j{k} AS (
  SELECT host, depth, names, n, bad, labels, (CASE WHEN same THEN all_bad ELSE bad END + {PRIOR_WEIGHT}::DOUBLE * ({PRIOR_BAD}::DOUBLE + above_labels / above_n * (above - {PRIOR_BAD}::DOUBLE))) / (CASE WHEN same THEN m ELSE labels END + {PRIOR_WEIGHT}::DOUBLE) AS impurity FROM s{k}
)"""


OP4 = (
    r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(r, ''), '^[^/?#]*(/[^?#]*)', 1) AS path FROM rest
), ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM split
), t0 AS (
  SELECT host, path, count(*) AS n, count(*) FILTER (rule IN ('example.net/en/', 'org/fr/')) AS good, count(*) FILTER (rule IN ('net/', 'example.com/de/')) AS bad, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN """
    + _VARIABLE.format("s")
    + r""" THEN '*' ELSE s END) AS seg, []::VARCHAR[] AS names
  FROM ruled GROUP BY host, path
), """
    + ", ".join(_level(k) for k in range(LEVELS))
    + f"""
, ends AS (
  SELECT host, names, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM t{LEVELS} GROUP BY 1, 2
), nodes AS (
  SELECT host, depth, names[:depth] AS names, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(good + bad)::DOUBLE AS labels
  FROM (SELECT *, unnest(range(0, len(names) + 1)) AS depth FROM ends) GROUP BY 1, 2, 3
), j0 AS (
  SELECT host, depth, names, n, bad, labels, (bad + {PRIOR_WEIGHT * PRIOR_BAD}::DOUBLE) / (labels + {PRIOR_WEIGHT}::DOUBLE) AS impurity FROM nodes WHERE depth = 0
), """
    + ", ".join(_judged(k) for k in range(1, LEVELS + 1))
    + f"""
, judged AS (
  {" UNION ALL ".join(f"SELECT host, names, impurity FROM j{k}" for k in range(LEVELS + 1))}
)
SELECT r.page_id, r.host, r.path, r.rule, CASE WHEN r.rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN r.rule IS NOT NULL OR j.impurity > {REJECT_AT}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict,
  array_to_string(list_transform(t.names, lambda s: '/' || s), '') AS template, 1 - j.impurity AS purity
FROM ruled r JOIN t{LEVELS} t ON t.host = r.host AND t.path = r.path JOIN judged j ON j.host = t.host AND j.names = t.names
"""
)

OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), classes AS (
  SELECT array_to_string(w, ' ') AS k, min(doc_id) AS copy_id, any_value(w) AS w FROM words WHERE len(w) > 0 GROUP BY 1
), grams AS (
  SELECT DISTINCT copy_id, unnest(CASE WHEN len(w) < 5 THEN [k] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM classes
), sizes AS (
  SELECT copy_id, count(*) AS n FROM grams GROUP BY 1
), shared AS (
  SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.copy_id < b.copy_id GROUP BY 1, 2
), linked AS (
  SELECT a, b FROM shared JOIN sizes x ON x.copy_id = a JOIN sizes y ON y.copy_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-6::DOUBLE
), pairs AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach AS (
  SELECT copy_id AS node, copy_id AS root FROM classes
  UNION
  SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.node WHERE r.root < p.b
), roots AS (
  SELECT node, min(root) AS class_id FROM reach GROUP BY 1
), counts AS (
  SELECT a AS node, count(*) AS links FROM pairs GROUP BY 1
)
SELECT w.doc_id, coalesce(r.class_id, w.doc_id) AS class_id, coalesce(c.copy_id, w.doc_id) AS copy_id, coalesce(n.links, 0) AS links
FROM words w LEFT JOIN classes c ON len(w.w) > 0 AND c.k = array_to_string(w.w, ' ') LEFT JOIN roots r ON r.node = c.copy_id LEFT JOIN counts n ON n.node = c.copy_id
"""

OP8 = rf"""
WITH tokens AS (
  SELECT doc_id, unnest(t) AS t, unnest(range(1, len(t) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN.replace("'", "''")}') AS t FROM documents)
), marked AS (
  SELECT *, regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', '', 'g') AS w, regexp_matches(t, '[{MARKS}][^\p{{L}}\p{{N}}]*$') AS ends, regexp_matches(t, '^[ \t\r\f]*\n') AS opens FROM tokens
), sentences AS (
  SELECT *, sum(CASE WHEN opens OR before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS s
  FROM (SELECT *, coalesce(lag(ends) OVER (PARTITION BY doc_id ORDER BY k), false) AS before FROM marked)
), words AS (
  SELECT doc_id, k, w, s, count(*) OVER (PARTITION BY doc_id, s) > {LONG} AS long, md5(w) LIKE '0%' AS anchor FROM sentences WHERE w <> ''
), pieces AS (
  SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS piece
  FROM (SELECT *, coalesce(lag(s) OVER d <> s OR (lag(long) OVER d AND lag(anchor) OVER d), true) AS cut FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY k))
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, piece ORDER BY k) - 1 AS within FROM pieces
), numbered AS (
  SELECT doc_id, k, w, sum(CASE WHEN within = 0 OR (long AND within % {LONG} = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS u, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS j FROM placed
), units AS (
  SELECT doc_id, u::BIGINT AS u, min(k) AS k, min(j) AS first, max(j) AS last FROM numbered GROUP BY 1, 2
), texts AS (
  SELECT doc_id, list(w ORDER BY j) AS w FROM numbered GROUP BY 1
), fitting AS (
  SELECT a.doc_id, a.u, z.u AS v, a.first, z.last FROM units a JOIN units z ON z.doc_id = a.doc_id AND z.u BETWEEN a.u + {SPAN - 1} AND a.u + {max(SPAN, MIN_WORDS)} AND z.last - a.first + 1 >= {MIN_WORDS}
), runs AS (
  SELECT doc_id, u, min(v) AS v FROM fitting GROUP BY 1, 2 UNION SELECT doc_id, max(u), v FROM fitting GROUP BY 1, 3
), hashed AS (
  SELECT r.doc_id, r.u, r.v, array_to_string(t.w[a.first:z.last], ' ') AS run
  FROM runs r JOIN units a ON a.doc_id = r.doc_id AND a.u = r.u JOIN units z ON z.doc_id = r.doc_id AND z.u = r.v JOIN texts t ON t.doc_id = r.doc_id
), later AS (
  SELECT doc_id, u, v FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, u) AS n FROM hashed) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(u, v + 1)) AS u FROM later
), assigned AS (
  SELECT t.doc_id, t.k, t.t, coalesce(max(u.u) OVER (PARTITION BY t.doc_id ORDER BY t.k), 1) AS u FROM tokens t LEFT JOIN units u ON u.doc_id = t.doc_id AND u.k = t.k
), losers AS (
  SELECT doc_id, count(*) AS removed FROM gone GROUP BY 1
), stays AS (
  SELECT a.doc_id, string_agg(a.t, '' ORDER BY a.k) AS stay FROM assigned a SEMI JOIN losers l ON l.doc_id = a.doc_id ANTI JOIN gone g ON g.doc_id = a.doc_id AND g.u = a.u GROUP BY 1
), tails AS (
  SELECT l.doc_id FROM losers l JOIN (SELECT doc_id, max(u) AS u FROM units GROUP BY 1) m ON m.doc_id = l.doc_id ANTI JOIN gone g ON g.doc_id = m.doc_id AND g.u = m.u
)
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.text ELSE regexp_replace(coalesce(s.stay, '') || CASE WHEN e.doc_id IS NULL THEN '' ELSE regexp_extract(d.text, '[ \t\n\r\f]*$') END, '^[ \t\n\r\f]+', '') END AS text, coalesce(l.removed, 0) AS removed_units
FROM documents d LEFT JOIN losers l ON l.doc_id = d.doc_id LEFT JOIN stays s ON s.doc_id = d.doc_id LEFT JOIN tails e ON e.doc_id = d.doc_id
"""

OP7 = r"""
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP11 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'k': sha256(role || chr(10) || text), 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST, role, md5(text)) AS t FROM turns GROUP BY conv_id
), heads AS (
  SELECT c.*, b.t AS head, list_reduce(list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT),
    lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), 4294967295::BIGINT) AS crc
  FROM own c LEFT JOIN (SELECT conv_id AS block, t FROM own) b ON b.block = c.conv_id - c.conv_id % 20
), paths AS (
  SELECT conv_id, list_concat(coalesce(head, [])[:h], t[h + 1:]) AS t FROM (SELECT *, xor(crc, 4294967295) % 4 AS h FROM heads)
), steps AS (
  SELECT conv_id, len(t) AS size, unnest(range(0, len(t) + 1)) AS depth, t FROM paths
), prefixes AS (
  SELECT conv_id, size, depth, sha256(array_to_string(list_transform(t[:depth], lambda x: x.k), ',')) AS prefix, CASE WHEN depth > 0 THEN t[depth].w ELSE 0 END AS w FROM steps
), members AS (
  SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM prefixes
), nodes AS (
  SELECT node, depth, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM members GROUP BY node, depth
), up AS (
  SELECT n.node, n.depth, p.node AS parent FROM nodes n JOIN members p ON p.conv_id = n.node AND p.depth = n.depth - 1
), kids AS (
  SELECT parent, depth - 1 AS depth, count(*) AS n FROM up GROUP BY ALL
), subtrees AS (
  SELECT a.node, a.depth, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM nodes n JOIN members a ON a.conv_id = n.node AND a.depth <= n.depth LEFT JOIN kids k ON k.parent = n.node AND k.depth = n.depth GROUP BY ALL
)
SELECT n.node AS conv_id, n.depth::BIGINT AS depth, u.parent AS parent_conv_id, n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM nodes n JOIN subtrees s ON s.node = n.node AND s.depth = n.depth LEFT JOIN up u ON u.node = n.node AND u.depth = n.depth LEFT JOIN kids k ON k.parent = n.node AND k.depth = n.depth
"""

OP12 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS terms FROM documents
), words AS (
  SELECT lang, source, d, term, count(*) AS n FROM (SELECT lang, source, d, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(*) >= 10
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source, false AS is_lang FROM docs UNION ALL SELECT DISTINCT lang, NULL, true FROM docs
), counts AS (
  SELECT lang, source, term, sum(n) AS n, false AS is_lang FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
  UNION ALL SELECT lang, NULL, term, sum(n), true FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, term
), totals AS (
  SELECT g.lang, g.source, g.is_lang, coalesce(sum(c.n), 0) + 2 * any_value(s.v) AS total
  FROM groups g JOIN sizes s ON s.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.is_lang = g.is_lang AND c.source IS NOT DISTINCT FROM g.source GROUP BY ALL
), shares AS (
  SELECT t.lang, t.source, t.is_lang, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)::HUGEINT) // t.total::HUGEINT) AS p
  FROM totals t JOIN kept k ON k.lang = t.lang LEFT JOIN counts c ON c.lang = t.lang AND c.is_lang = t.is_lang AND c.source IS NOT DISTINCT FROM t.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON NOT a.is_lang AND NOT b.is_lang AND a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON NOT a.is_lang AND NOT b.is_lang AND a.lang = b.lang AND a.source != b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT a.lang, a.source, 'term', a.term, (a.p - b.p) * (a.p - b.p) // (a.p + b.p)
  FROM shares a JOIN shares b ON NOT a.is_lang AND b.is_lang AND a.lang = b.lang AND a.term = b.term AND a.n > 0 AND a.p > b.p
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLE_SQL = {
    "op6_ngram_jaccard_join": OP6,
    "op7_exact_topk": OP7,
    "op8_substring_dedup": OP8,
    "op2_chat_formatting": OP2,
    "op3_html_extraction": OP3,
    "op4_url_filter": OP4,
    "op9_source_mixing": OP9,
    "op11_prefix_trie": OP11,
    "op12_source_divergence": OP12,
}
