"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from gridloom.llm import manifest, mixing
from gridloom.llm import quality_rules as q

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, 16 + length(role) + length(regexp_replace(role, '[^\\<>\n]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')) AS chars FROM rows),
said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said
"""

_ITEM = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(text=_LOWER)

DECONTAMINATE = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT *, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_ITEM} AS w FROM documents),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, n, i FROM places JOIN windows USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM docs WHERE len(w) > 1)
  UNION ALL SELECT doc_id, w[1] FROM docs WHERE len(w) = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes r ON r.doc_id = b WHERE 100 * c >= 80 * (p.n + r.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT edges.b, reach.least FROM reach JOIN edges ON edges.a = reach.node WHERE reach.least < edges.b),
parts AS (SELECT node AS doc_id, min(least) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM parts LEFT JOIN sizes USING (doc_id)
"""

QUALITY = rf"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw FROM documents),
eight AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)),
again AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM eight) WHERE c > 1) GROUP BY doc_id),
normal AS (SELECT doc_id, host, list_transform(raw, lambda x: array_to_string(string_split_regex(regexp_replace(lower(x), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+'), ' ')) AS xs FROM docs),
lines AS (SELECT doc_id, host, md5(array_to_string(xs, chr(10))) AS document, unnest(xs) AS x FROM normal),
hosts AS (SELECT host, count(DISTINCT document) AS host_docs FROM lines GROUP BY host),
seen AS (SELECT host, x, count(DISTINCT document) AS docs FROM lines GROUP BY host, x),
common AS (SELECT host, x FROM seen JOIN hosts USING (host) WHERE docs > {q.MIN_DOCS} AND docs > {q.DOC_SHARE} * host_docs),
gone AS (SELECT doc_id, CAST(sum(len(string_split(x, ' '))) AS BIGINT) AS n FROM lines JOIN common USING (host, x) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(raw) - len(list_distinct(raw)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_line_words
  FROM docs LEFT JOIN again USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words) AND n_line_words <= {q.DEPLETED} * n_words AS kept
FROM base
"""

_BODY = "coalesce(text, '')"
_NO_WHITE = "translate({text}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13){more}, '')"
_HELD = f"length({_NO_WHITE.format(text=_BODY, more='')})"
_GOOD = f"length({_NO_WHITE.format(text=_BODY, more=" || '" + mixing.BAD + "'")})"

MIX = rf"""
WITH docs AS (
  SELECT doc_id, source, len({_WORDS.format(text=_BODY)}) AS size, CAST(0.1 AS DOUBLE) + CASE WHEN {_HELD} > 0 THEN CAST(0.9 AS DOUBLE) * ({_GOOD} / {_HELD}) ELSE 0 END AS w FROM documents),
drawn AS (SELECT *, (CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || size), 1, 13) AS UBIGINT) + CAST(0.5 AS DOUBLE)) / 4503599627370496 AS u FROM docs),
keyed AS (SELECT *, floor((log2(-ln(u) / w) + 64) * 2199023255552) AS k FROM drawn),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM docs GROUP BY source),
known AS (SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight, {mixing.EPOCHS} * total AS most, CAST(sum(total) OVER () AS BIGINT) AS words FROM sizes),
-- the sources that are full: of all sets that start with those filled first, the largest whose level fills each
filled AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS i FROM known),
sets AS (
  SELECT a.i, CAST(coalesce(sum(b.most) FILTER (b.i < a.i), 0) AS BIGINT) AS used, CAST(sum(b.weight) FILTER (b.i >= a.i) AS BIGINT) AS open FROM filled a, filled b GROUP BY a.i),
level AS (SELECT filled.*, 100 * (CAST(used AS HUGEINT) * weight + CAST(open AS HUGEINT) * most) <= {mixing.PERCENT} * CAST(words AS HUGEINT) * weight AS full_ FROM filled JOIN sets USING (i)),
wanted AS (
  SELECT source, total, CASE WHEN full_ THEN CAST(most AS DOUBLE) ELSE ({mixing.PERCENT / 100}::DOUBLE * words - coalesce(CAST(sum(most) FILTER (full_) OVER () AS BIGINT), 0)) / CAST(sum(weight) FILTER (NOT full_) OVER () AS BIGINT) * weight END AS target FROM level),
whole AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS epochs FROM wanted),
placed AS (
  SELECT doc_id, size, total, target, epochs, CAST(floor(target - epochs * total + CAST(0.5 AS DOUBLE)) AS BIGINT) AS rest,
    CAST(coalesce(sum(size) OVER (PARTITION BY keyed.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM keyed JOIN whole ON keyed.source IS NOT DISTINCT FROM whole.source)
SELECT doc_id, size, total AS source_size, target, epochs * size + least(size, greatest(0, rest - before)) AS taken FROM placed
"""

_LEAF = "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({{}} AS VARCHAR)) AS VARCHAR) || ':' || CAST({{}} AS VARCHAR), '-')".replace("{}", f"{{{f}}}") for f in manifest.FIELDS) + ")"
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])), lambda x, y: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1)))), CAST(4294967295 AS UBIGINT))"


def _merkle_levels(name: str, levels: int) -> str:
    """CTEs name1 .. of (g, r, n, h) above name0, pairs of nodes at a time."""
    one = "{name}{k} AS MATERIALIZED (SELECT g, r // 2 AS r, (n + 1) // 2 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE max(h) END AS h FROM {name}{j} GROUP BY g, r // 2, n)"
    return ",\n".join(one.format(name=name, k=k, j=k - 1) for k in range(1, levels + 1))


def _merkle_paths(name: str, start: str, levels: int) -> str:
    """CTEs name_path1 ..: per row of start (g, r, node, others, rest) the fold so far and the digests beside it."""
    one = """{name}_path{k} AS MATERIALIZED (SELECT p.* REPLACE (p.r // 2 AS r, others || coalesce(b.h, '') AS others,
  CASE WHEN o.n = 1 THEN node WHEN p.r % 2 = 0 THEN sha256(node || coalesce(b.h, '')) ELSE sha256(b.h || node) END AS node)
  FROM {before} p JOIN (SELECT DISTINCT g, n FROM {name}{j}) o ON o.g = p.g LEFT JOIN {name}{j} b ON b.g = p.g AND b.r = xor(p.r, 1))"""
    return ",\n".join(one.format(name=name, k=k, j=k - 1, before=start if k == 1 else f"{name}_path{k - 1}") for k in range(1, levels + 1))


_LEVELS, _TOPS = 24, 8
MANIFEST = f"""
WITH docs AS (SELECT *, coalesce('=' || lang, '') AS g, n_chars + CASE WHEN {_CRC} % {manifest.TAMPER_SHARE} = 0 THEN 1 ELSE 0 END AS more FROM documents),
hashed AS (SELECT doc_id, g, {_LEAF.format(**{f: f for f in manifest.FIELDS})} AS leaf, {_LEAF.format(**{f: "coalesce(more, n_chars)" if f == "n_chars" else f for f in manifest.FIELDS})} AS node FROM docs),
rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM hashed),
node0 AS MATERIALIZED (SELECT g, r, n, leaf AS h FROM rows),
{_merkle_levels("node", _LEVELS)},
start AS (SELECT doc_id, g, r, leaf, node, '' AS others FROM rows),
{_merkle_paths("node", "start", _LEVELS)},
tops AS MATERIALIZED (SELECT g AS lang_g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM node{_LEVELS}),
top0 AS MATERIALIZED (SELECT 1 AS g, place AS r, n, subroot AS h FROM tops),
{_merkle_levels("top", _TOPS)},
middle AS (SELECT doc_id, 1 AS g, place AS r, leaf, node, others, subroot FROM node_path{_LEVELS} JOIN tops ON lang_g = g),
{_merkle_paths("top", "middle", _TOPS)}
SELECT doc_id, leaf, subroot, h AS root, sha256(others) AS proof_sha256, node AS folded_root, node = h AS verified FROM top_path{_TOPS}, top{_TOPS}
"""
