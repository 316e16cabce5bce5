"""DuckDB SQL that must give the same rows as the operators' queries, where SQL
can express them. Each is written from the definitions, not from the plans."""

from __future__ import annotations

from ledgerloom.llm import secrets

# --- op1: CRC-32 by half bytes, and jump hashing as a recursive query.
def _crc_entry(value: int) -> int:
    for _ in range(4):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


_CRC_TABLE = str([_crc_entry(i) for i in range(16)])
_NIBBLES = "flatten(list_transform(range(1, 2 * octet_length(encode(t)), 2), lambda i: [instr('0123456789ABCDEF', h[i + 1]) - 1, instr('0123456789ABCDEF', h[i]) - 1]))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_NIBBLES}::BIGINT[]), lambda c, x: xor(({_CRC_TABLE}::BIGINT[])[(xor(c, x) & 15) + 1], c >> 4)), 4294967295::BIGINT)"


def _jumps(name: str, shards: int) -> str:
    """CTE of the shard of each document: the published loop, a row for each jump."""
    return f"""{name}(doc_id, k, b, j) AS (
  SELECT doc_id, doc_id::UHUGEINT, -1::BIGINT, 0::BIGINT FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, k, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k >> 33)::DOUBLE + 1)))::BIGINT
  FROM (SELECT doc_id, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k, j FROM {name} WHERE j < {shards}))"""


_SHARDING = f"""WITH RECURSIVE {_jumps("now", 40)}, {_jumps("later", 41)},
texts AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, (octet_length(encode(t)) + 16)::BIGINT AS size, {_CRC} AS text_crc32 FROM texts),
parts AS (
  SELECT s.*, n.b::INTEGER AS shard, l.b::INTEGER AS grown_shard,
    ('0x' || substr(md5(concat_ws(',', s.doc_id, s.size, s.text_crc32)), 1, 8))::BIGINT % (SELECT greatest(16, ceil(count(*) / 250000))::BIGINT FROM documents) AS part
  FROM sized s JOIN now n ON n.doc_id = s.doc_id AND n.j >= 40 JOIN later l ON l.doc_id = s.doc_id AND l.j >= 41)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM parts"""

# --- op2: all pairs of lines of nearly the same length. levenshtein() counts bytes, so each letter
# beyond ASCII in the tables first becomes one byte that no text has.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_BYTES = " || ".join(f"chr({i})" for i in [*range(1, 10), *range(11, 11 + len(_LETTERS) - 9)])
_LINES = f"""WITH lines AS (
  SELECT doc_id, unnest(range(len(l)))::INTEGER AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
classes AS (
  SELECT line, arg_min({{'d': doc_id, 'n': line_no}}, (doc_id, line_no)) AS place, length(line) AS n, translate(line, '{_LETTERS}', {_BYTES}) AS b
  FROM lines WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY line),
links AS (
  SELECT x.line AS x, y.line AS y, x.place AS xp, y.place AS yp FROM (SELECT *, unnest([n - 2, n - 1, n, n + 1, n + 2]) AS m FROM classes) x JOIN classes y ON y.n = x.m
  WHERE x.line < y.line AND least(x.n, y.n) >= 2 AND CASE WHEN least(x.n, y.n) < 40 THEN levenshtein(x.b, y.b) <= 1 ELSE levenshtein(x.b, y.b) <= 2 END),
seen AS (SELECT x AS line, yp AS other FROM links UNION ALL SELECT y, xp FROM links),
linked AS (SELECT line, count(*) AS n_links, arg_min(other, (other.d, other.n)) AS earliest FROM seen GROUP BY line),
known AS (
  SELECT c.line, place, coalesce(n_links, 0) AS n_links, CASE WHEN (earliest.d, earliest.n) < (place.d, place.n) THEN earliest END AS near FROM classes c LEFT JOIN linked USING (line))
SELECT doc_id, line_no, place.d AS class_doc, place.n AS class_line, coalesce(n_links, 0) AS n_links, near.d AS near_doc, near.n AS near_line,
  place IS NULL OR (near IS NULL AND place.d = doc_id AND place.n = line_no) AS kept FROM lines LEFT JOIN known USING (line)"""

# --- op4: pieces between matches and matches alternate.
def _spans_sql(rule: secrets.Rule, rank: int) -> str:
    """Spans of one rule: pieces between matches and matches alternate."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, s AS start, s + length(ms[i]) AS stop FROM (
  SELECT doc_id, ms, gs, i, coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s FROM (
    SELECT doc_id, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {rule.group}) AS gs, string_split_regex(t, '{pattern}') AS ps FROM texts)))
WHERE length(gs[i]) >= {rule.min_length}"""


_RULES = [*secrets.BASE_RULES, *secrets.KEY_FILE_RULES]
_BASE = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
_SECRETS = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_spans_sql(r, i) for i, r in enumerate(_RULES))}),
joined AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)},
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind IN ({_BASE})) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secrets.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (doc_id)"""

# --- op7: every window that begins with a shingle of the item, or ends the text.
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w != '')"
_SHINGLES = "list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string({0}[i:i + {1} - 1], ' '))"
_CONTAMINATED = f"""WITH items AS (
  SELECT item_id, w, least(5, len(w)) AS width, {_SHINGLES.format("w", "least(5, len(w))")} AS s FROM (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM items),
texts AS (SELECT doc_id, width, {_SHINGLES.format("w", "width")} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), widths WHERE len(w) >= width),
places AS (SELECT doc_id, width, len(s) AS n, unnest(range(len(s))) AS place, unnest(s) AS shingle FROM texts),
shared AS (
  SELECT DISTINCT doc_id, item_id, width, n, len(i.s) AS k, place FROM places p JOIN (SELECT item_id, width, s, unnest(s) AS shingle FROM items) i USING (width, shingle)),
starts AS (SELECT DISTINCT doc_id, item_id, width, n, k, least(place, n - least(k, n)) AS start FROM shared),
windows AS (SELECT x.*, t.s[start + 1:start + least(k, x.n)] AS s FROM starts x JOIN texts t USING (doc_id, width)),
own AS (SELECT item_id, shingle, count(*) AS c FROM (SELECT item_id, unnest(s) AS shingle FROM items) GROUP BY ALL),
counted AS (SELECT doc_id, item_id, width, n, k, start, shingle, count(*) AS c FROM (SELECT doc_id, item_id, width, n, k, start, unnest(s) AS shingle FROM windows) GROUP BY ALL),
common AS (SELECT doc_id, item_id, width, n, k, start, sum(least(x.c, o.c)) AS n_shared FROM counted x JOIN own o USING (item_id, shingle) GROUP BY ALL),
scored AS (SELECT *, n_shared / (k + least(k, n) - n_shared) AS similarity FROM common)
SELECT doc_id, item_id, arg_max(start, (similarity, -start))::INTEGER AS start_word, (arg_max(least(k, n), (similarity, -start)) + any_value(width) - 1)::INTEGER AS n_words, round(max(similarity), 6) AS similarity
FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id"""

# --- op11: sets of word pairs, all pairs of sets that share one, and what links reach.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NEAR_COPIES = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words),
sets AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM shingled WHERE len(s) > 0 GROUP BY s),
each AS (SELECT id, n, unnest(s) AS shingle FROM sets),
shared AS (SELECT x.id AS a, y.id AS b, x.n AS an, y.n AS bn, count(*) AS k FROM each x JOIN each y ON x.shingle = y.shingle AND x.id < y.id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (an + bn - k)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, t.b FROM reach r JOIN sides t ON r.b = t.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
labelled AS (SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(least(l.m, e.id), d.doc_id) AS component_id FROM shingled d LEFT JOIN sets e ON e.s = d.s LEFT JOIN least l ON l.a = e.id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM labelled"""

# --- op12: a prefix is the text of its turns' digests, so its ancestors are its beginnings.
_TRIE = f"""WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT c, {_CRC} % 6 AS head FROM (SELECT c, c::VARCHAR AS t, hex(encode(c::VARCHAR)) AS h FROM ids)),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x, size) AS i, x, size
  FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS size FROM conversations)),
rebuilt AS (
  SELECT h.c, 0 AS part, i, x, size FROM heads h JOIN turns t ON t.c = h.c - h.c % 100 AND t.i <= head
  UNION ALL SELECT h.c, 1, i, x, size FROM heads h JOIN turns t ON t.c = h.c AND t.i > head),
listed AS (SELECT c, list(x ORDER BY part, i) AS xs, list(size ORDER BY part, i) AS sizes FROM rebuilt GROUP BY c),
whole AS (SELECT ids.c, coalesce(xs, []) AS xs, coalesce(sizes, []) AS sizes FROM ids LEFT JOIN listed USING (c)),
prefixes AS (SELECT c, d, array_to_string(xs[1:d], '') AS p, coalesce(sizes[d], 0) AS size, d = len(xs) AS ends FROM (SELECT *, unnest(range(len(xs) + 1)) AS d FROM whole)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ends FROM prefixes GROUP BY p, d),
children AS (SELECT left(p, 32 * (d - 1)) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (SELECT o.*, coalesce(n, 0) AS n_children, (n IS NULL)::BIGINT AS leaf, (n_convs - 1) * size AS saved FROM nodes o LEFT JOIN children USING (p)),
sums AS (SELECT left(p, 32 * k) AS p, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT p, leaf, saved, unnest(range(d + 1)) AS k FROM own) GROUP BY ALL)
SELECT o.conv_id, o.d::BIGINT AS depth, q.conv_id AS parent_conv_id, o.n_convs, n_children, n_leaves, saved_tokens, sha256(o.ends) AS ends_sha256
FROM own o JOIN sums USING (p) LEFT JOIN nodes q ON o.d > 0 AND q.p = left(o.p, 32 * (o.d - 1))"""

# --- op13: every anchor against every row.
_NEGATIVES = """WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, list_dot_product(a.q, r.q)::BIGINT AS score FROM vectors a JOIN vectors r ON a.vec_id % 50 = 0 AND r.vec_id != a.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
ranked AS (
  SELECT p.*, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank
  FROM positives p JOIN scored s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3"""

ORACLE_SQL = {
    "op1_sharding": _SHARDING, "op2_lines": _LINES, "op4_secrets": _SECRETS, "op7_decontamination": _CONTAMINATED, "op11_minhash": _NEAR_COPIES,
    "op12_prefixes": _TRIE, "op13_negatives": _NEGATIVES,
}
