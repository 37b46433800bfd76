"""The results that SQL can express, in DuckDB's SQL over the given tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BENCHMARK_WINDOWS = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, w, least(len(w), 10) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram
            FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
grams AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
          FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
                FROM docs JOIN (SELECT DISTINCT size FROM items) ON len(w) >= size)),
found AS (SELECT doc_id, item_id, i, size FROM grams JOIN windows USING (gram, size)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM found)
        GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

JACCARD_JOIN = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5
                 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM docs),
grams AS (SELECT doc_id, len(s) AS n, unnest(list_transform(s, lambda x: hash(x))) AS gram FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS one, b.doc_id AS two FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM docs
            UNION SELECT doc_id, two FROM reached JOIN links ON one = other)
SELECT doc_id, len(s) AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)"""

# CRC-32 (reflected) of an ASCII text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                lambda c, bit: xor(c >> 1, (c & 1) * 3988292384))))"""


def _shown(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_shown(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _levels(name: str, leaves: str) -> str:
    """(part, level, pos, digest, n) of all levels over (part, pos, digest), pairs hashed upwards."""
    return f"""{name} AS (SELECT part, 0 AS level, pos, digest, count(*) OVER (PARTITION BY part) AS n FROM {leaves}
  UNION ALL
  SELECT part, any_value(level) + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY part, pos // 2)"""


def _climb(name: str, start: str, levels: str) -> str:
    """(id, part, level, pos, folded, proof) of every leaf's way up."""
    return f"""{name} AS (SELECT id, part, 0 AS level, pos, folded, proof FROM {start}
  UNION ALL
  SELECT w.id, w.part, w.level + 1, w.pos // 2,
         sha256(CASE WHEN w.pos % 2 = 1 THEN coalesce(s.digest, '') || w.folded ELSE w.folded || coalesce(s.digest, '') END),
         w.proof || coalesce(s.digest, '')
  FROM {name} w JOIN {levels} own ON own.part = w.part AND own.level = w.level AND own.pos = w.pos AND own.n > 1
  LEFT JOIN {levels} s ON s.part = w.part AND s.level = w.level AND s.pos = xor(w.pos, 1))"""


MERKLE_MANIFEST = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS part,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, row_number() OVER () AS id
  FROM (SELECT doc_id, lang, {_leaf("n_chars")} AS digest,
               CASE WHEN {_CRC32.format(text="doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars + 1)")}
                    ELSE {_leaf("n_chars")} END AS changed FROM documents)),
{_levels("inner_levels", "leaves")},
inside AS MATERIALIZED (SELECT * FROM inner_levels),
subroots AS MATERIALIZED (SELECT 0 AS part, part AS pos, digest FROM inside WHERE n = 1),
{_levels("outer_levels", "subroots")},
outside AS MATERIALIZED (SELECT * FROM outer_levels),
starts AS MATERIALIZED (SELECT id, part, pos, changed AS folded, '' AS proof FROM leaves),
{_climb("inner_way", "starts", "inside")},
entered AS MATERIALIZED (SELECT w.id, 0 AS part, w.part AS pos, w.folded, w.proof
  FROM inner_way w JOIN inside i ON i.part = w.part AND i.level = w.level AND i.pos = w.pos AND i.n = 1),
{_climb("outer_way", "entered", "outside")}
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256,
       w.folded AS folded_root, w.folded = r.digest AS verified
FROM leaves l JOIN subroots s ON s.pos = l.part JOIN outer_way w USING (id)
JOIN outside r ON r.part = 0 AND r.level = w.level AND r.pos = w.pos AND r.n = 1"""

HARD_NEGATIVES = """
WITH vectors AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS units
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.units, b.units)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5"""

SQL = {
    "op7_benchmark_windows": BENCHMARK_WINDOWS,
    "op8_jaccard_join": JACCARD_JOIN,
    "op12_merkle_manifest": MERKLE_MANIFEST,
    "op13_hard_negatives": HARD_NEGATIVES,
}
