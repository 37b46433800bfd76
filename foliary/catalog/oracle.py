"""The same results in SQL over the given tables, for comparison."""

from __future__ import annotations

import re

from foliary.catalog import fixtures as fx
from foliary.functions.objects import CONTENT_TYPES
from foliary.functions.text import FOLD_FROM, FOLD_TO, FOLD_WIDE, TOKEN_RE2
from foliary.operators.extract import WHITE_SPACE
from foliary.operators.highlight import fragment_pattern
from foliary.settings import FIELD_BOOSTS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_of(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {lit(TOKEN_RE2)})"


def folded(word: str) -> str:
    sql = f"translate({word}, {lit(FOLD_FROM)}, {lit(FOLD_TO)})"
    for char, plain in FOLD_WIDE.items():
        sql = f"replace({sql}, {lit(char)}, {lit(plain)})"
    return sql


def time_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def base_name(key: str) -> str:
    return f"regexp_extract({key}, '[^/]*$')"


# Written out for the given pages, apart from the rules of the engine.
PAGE_STEPS = (
    ("(?is)<script[^>]*>.*?</script>", " "),
    ("(?is)<style[^>]*>.*?</style>", " "),
    ("(?s)<!--.*?-->", " "),
    ("(?i)</?(p|br|div|h1|li|ul|nav|article|footer|title|body|head|html)( [^>]*)?>", "\n"),
    ("<[^>]+>", ""),
    ("&copy;", "\u00a9"),
    ("&middot;", "\u00b7"),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("[ \t]+", " "),
    (r"\s*\n\s*", "\n"),
)


def markup_text(html: str) -> str:
    for pattern, replacement in PAGE_STEPS:
        html = f"regexp_replace({html}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return html


STOPS = "(" + ", ".join(lit(w) for w in fx.STOPWORDS) + ")"
AS_OF = f"TIMESTAMP {lit(fx.AS_OF)}"
REGISTRY = (
    "sha256 s3_bucket s3_key text_s3_key filename content_type size_bytes etag "
    "extractor_version extracted_at indexed_at seen_at status error"
).split()
_TIMES = ("extracted_at", "indexed_at", "seen_at")


def registry_row(source: str) -> str:
    columns = ", ".join(f"{time_text(c)} AS {c}" if c in _TIMES else c for c in REGISTRY)
    return f"SELECT {columns} FROM {source}"


CODE = (
    "CASE WHEN doc_id % 29 = 0 THEN 422 WHEN doc_id % 31 = 0 THEN 503 "
    "WHEN doc_id % 37 = 0 THEN NULL ELSE 200 END"
)


def per_page(doc: str, text: str, chars: str) -> str:
    stated = (
        f"CASE WHEN {doc} % 4 = 0 AND {doc} % 16 <> 8 AND {doc} % 8 <> 4 "
        f"THEN {chars} + 0.5 END::DOUBLE"
    )
    pages = (
        f"CASE WHEN {doc} % 4 IN (1, 2) AND {doc} % 16 NOT IN (2, 5) "
        f"THEN 1 + {chars} // 3000 ELSE 1 END"
    )
    return f"coalesce({stated}, length(trim({text}, {lit(WHITE_SPACE)}))::DOUBLE / ({pages}))"


def message(code: str, text: str) -> str:
    return (
        f"CASE WHEN {code} IS NULL THEN 'no answer: ' || substr({text}, 1, 500) "
        f"WHEN {code} >= 400 THEN 'status ' || {code} || ': ' || substr({text}, 1, 500) END"
    )


N = "(SELECT count(*) FROM documents)"

# Named parts; each names the parts it needs.
PARTS: dict[str, str] = {}

PARTS["objects"] = """
SELECT 'documents' AS s3_bucket, concat('documents/', source, '/', doc_id, '.txt') AS s3_key,
       text AS content, strlen(text) AS size_bytes, md5(text) AS etag, sha256(text) AS sha256,
       doc_id, concat(doc_id, '-', lang, '.txt') AS filename, 'text/plain' AS content_type
FROM documents"""

PARTS["registry0"] = """
SELECT sha256, s3_bucket, s3_key,
       CASE WHEN status NOT IN ('pending', 'error') THEN 'text/' || sha256 || '.txt' END AS text_s3_key,
       filename, content_type, size_bytes,
       CASE WHEN doc_id % 10 = 1 THEN 'stale' ELSE etag END AS etag,
       CASE WHEN status NOT IN ('pending', 'error') AND doc_id % 50 <> 8 THEN 'v1' END AS extractor_version,
       CASE WHEN status NOT IN ('pending', 'error') THEN seen_at + INTERVAL 1 HOUR END AS extracted_at,
       CASE WHEN status = 'indexed' THEN seen_at + INTERVAL 2 HOUR END AS indexed_at,
       seen_at, status, CASE WHEN status = 'error' THEN 'boom' END AS error
FROM (SELECT *, CASE doc_id % 20 WHEN 0 THEN 'error' WHEN 2 THEN 'pending' WHEN 4 THEN 'extracted'
                WHEN 7 THEN 'needs_ocr' ELSE 'indexed' END AS status,
             TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS seen_at
      FROM objects WHERE doc_id % 3 <> 0
      QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY doc_id DESC) = 1)"""

PARTS["listing"] = "SELECT s3_bucket, s3_key, size_bytes, etag FROM objects"

PARTS["updates"] = f"""
SELECT event_id + 1 AS seq, h.sha256, k.s3_bucket, k.s3_key,
       CASE WHEN event_type IN ('signup', 'purchase') THEN concat('upload-', event_id, '.txt') END AS filename,
       h.content_type, h.size_bytes, h.etag, ts AS seen_at,
       CASE WHEN event_type IN ('signup', 'purchase') THEN 'upload' ELSE 'worker' END AS source
FROM events
JOIN objects h ON h.doc_id = event_id % {N}
JOIN objects k ON k.doc_id = CASE WHEN event_type = 'error' THEN (event_id * 7 + 3) % {N}
                                  ELSE event_id % {N} END"""

PARTS["sidecars"] = """
SELECT sha256, any_value(content) AS text, 'v1' AS extractor_version,
       TIMESTAMP '2024-02-01 00:00:00' AS extracted_at
FROM objects WHERE doc_id % 5 <> 0 GROUP BY sha256"""

PARTS["notifications"] = f"""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '{{"Event":"ping"}}'
            WHEN event_id % 17 = 0 THEN substr(body, 1, 40) ELSE body END AS body
FROM (SELECT event_id, concat('{{"Records":[{{"s3":{{"bucket":{{"name":"', s3_bucket,
             '"}},"object":{{"key":"', CASE WHEN event_id % 13 = 0 THEN '' ELSE s3_key END,
             '"}}}}}}]}}') AS body
      FROM events JOIN objects ON doc_id = event_id % {N})"""

PARTS["payloads"] = f"""
SELECT event_id, CASE WHEN event_id % 19 = 0 THEN '{{"bucket":"documents"}}'
            WHEN event_id % 23 = 0 THEN 'not json'
            ELSE concat('{{"bucket":"', s3_bucket, '","key":"', s3_key, '"}}') END AS payload
FROM events JOIN objects ON doc_id = event_id % {N}"""

PARTS["corpus"] = """
SELECT sha256, arg_max(content, doc_id) AS content, arg_max(filename, doc_id) AS filename,
       arg_max(s3_bucket, doc_id) AS s3_bucket, arg_max(s3_key, doc_id) AS s3_key,
       any_value(content_type) AS content_type, any_value(size_bytes) AS size_bytes
FROM objects GROUP BY sha256"""

PARTS["content_words"] = f"""
SELECT sha256, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
FROM (SELECT sha256, {words_of("content")} AS w FROM corpus)"""

PARTS["vocabulary"] = f"""
SELECT DISTINCT unnest({words_of("text")}) AS word FROM documents"""

PARTS["lemmas"] = """
SELECT word AS surface, unnest(CASE
         WHEN suffix(word, 'ing') AND length(word) > 6 THEN [left(word, length(word) - 3)]
         WHEN suffix(word, 'tion') AND length(word) > 6 THEN [left(word, length(word) - 4)]
         WHEN suffix(word, 'ly') AND length(word) > 2 THEN [word, left(word, length(word) - 2)]
         ELSE [] END) AS lemma
FROM vocabulary"""

PARTS["field_words"] = f"""
SELECT sha256, 'content.raw' AS field, pos, word AS term FROM content_words
UNION ALL
SELECT sha256, 'content.folded', pos, {folded("word")} FROM content_words
UNION ALL
SELECT sha256, 'content', pos, coalesce(lemma, word)
FROM content_words LEFT JOIN lemmas ON surface = word WHERE word NOT IN {STOPS}
UNION ALL
SELECT sha256, 'filename', generate_subscripts(w, 1) - 1, unnest(w)
FROM (SELECT sha256, {words_of("filename")} AS w FROM corpus)"""

PARTS["lengths"] = """
SELECT sha256, field, count(DISTINCT pos) AS dl, count(*) AS words FROM field_words GROUP BY ALL"""

PARTS["posts"] = """
SELECT field, term, sha256, count(*) AS tf, list(pos ORDER BY pos) AS positions
FROM field_words GROUP BY ALL"""

PARTS["terms"] = """
SELECT field, term, count(*) AS doc_freq, sum(tf)::BIGINT AS total_tf FROM posts GROUP BY ALL"""

PARTS["fields"] = """
SELECT field, count(*) AS docs, sum(words) / count(*) AS avg_length FROM lengths GROUP BY field"""

PARTS["fixed_queries"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({n}::BIGINT, {lit(q)})" for n, q in fx.SEARCH_QUERIES
) + ") AS t(query_id, q)"

PARTS["many_queries"] = "SELECT item_id AS query_id, text AS q FROM benchmark"


def _query_parts(source: str, fuzzy: bool) -> dict[str, str]:
    """Parts that depend on the queries asked."""
    auto = "CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END"
    edits = f"CASE WHEN lemmas > 1 THEN NULL ELSE {auto} END" if fuzzy else "NULL"
    parts = {}
    parts["query_words"] = f"""
SELECT query_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
FROM (SELECT query_id, {words_of("q")} AS w FROM {source})"""
    parts["query_terms"] = f"""
SELECT query_id, field, pos, term, {edits} AS edits FROM (
  SELECT query_id, 'content.raw' AS field, pos, word AS term, 1 AS lemmas FROM query_words
  UNION ALL SELECT query_id, 'filename', pos, word, 1 FROM query_words
  UNION ALL SELECT query_id, 'content.folded', pos, {folded("word")}, 1 FROM query_words
  UNION ALL
  SELECT query_id, 'content', pos, coalesce(lemma, word), count(*) OVER (PARTITION BY query_id, pos)
  FROM query_words LEFT JOIN lemmas ON surface = word WHERE word NOT IN {STOPS})"""
    # The built-in distance counts bytes, so it only sorts out pairs of plain ASCII forms;
    # mapping single letters never makes two words differ more.
    plain = f"translate(term, {lit(FOLD_FROM)}, {lit(FOLD_TO)})"
    parts["plain_terms"] = f"SELECT field, term, {plain} AS plain FROM terms"
    parts["near_pairs"] = f"""
SELECT DISTINCT q.term AS a, t.term AS b
FROM (SELECT DISTINCT field, term, edits, {plain} AS plain FROM query_terms WHERE edits > 0) q
JOIN plain_terms t ON t.field = q.field AND left(t.term, 1) = left(q.term, 1)
 AND length(t.term) BETWEEN length(q.term) - q.edits AND length(q.term) + q.edits
WHERE damerau_levenshtein(q.plain, t.plain) <= q.edits
   OR strlen(q.plain) > length(q.plain) OR strlen(t.plain) > length(t.plain)"""
    parts["table_rows"] = """
SELECT a, b, 0 AS i, range(0, length(b) + 1) AS above2, range(0, length(b) + 1) AS above
FROM near_pairs
UNION ALL
SELECT a, b, i + 1, above,
       list_transform(range(0, length(b) + 1), lambda j:
         j + list_min(list_transform(range(0, j + 1), lambda x: base[x + 1] - x)))
FROM (SELECT *, list_prepend(i + 1, list_transform(range(1, length(b) + 1), lambda j: least(
        above[j + 1] + 1,
        above[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END,
        CASE WHEN i >= 1 AND j > 1 AND a[i + 1] = b[j - 1] AND a[i] = b[j]
             THEN above2[j - 1] + 1 ELSE 1000 END))) AS base
      FROM table_rows WHERE i < length(a))"""
    parts["distances"] = "SELECT a, b, above[length(b) + 1] AS distance FROM table_rows WHERE i = length(a)"
    parts["found"] = """
SELECT field, query_term, edits, term, distance, 1 - distance / least(length(query_term), length(term)) AS boost, doc_freq
FROM (SELECT q.field, q.term AS query_term, q.edits, t.term, coalesce(d.distance, 0) AS distance, t.doc_freq
      FROM (SELECT DISTINCT field, term, edits FROM query_terms) q
      JOIN terms t ON t.field = q.field AND left(t.term, 1) = left(q.term, 1)
      LEFT JOIN distances d ON d.a = q.term AND d.b = t.term
      WHERE t.term = q.term OR (q.edits > 0 AND d.distance <= q.edits))
QUALIFY row_number() OVER (PARTITION BY field, query_term, edits ORDER BY boost DESC, term) <= 50"""
    parts["weighted"] = """
SELECT *, boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) AS weight,
       CASE WHEN edits IS NULL THEN '' ELSE term END AS unit
FROM (SELECT q.query_id, q.field, q.pos, q.term AS query_term, q.edits, f.term, f.distance, f.boost,
             max(f.doc_freq) OVER (PARTITION BY q.query_id, q.field, q.pos) AS df
      FROM query_terms q JOIN found f ON f.field = q.field AND f.query_term = q.term
       AND f.edits IS NOT DISTINCT FROM q.edits)
JOIN fields USING (field)"""
    parts["scores"] = """
SELECT query_id, sha256, field, sum(weight * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg_length))) AS score
FROM (SELECT w.query_id, w.field, w.pos, w.unit, w.weight, w.avg_length, p.sha256, l.dl, sum(p.tf) AS tf
      FROM weighted w JOIN posts p ON p.field = w.field AND p.term = w.term
      JOIN lengths l ON l.field = p.field AND l.sha256 = p.sha256 GROUP BY ALL)
GROUP BY ALL"""
    boosts = " ".join(f"WHEN {lit(f)} THEN {b}" for f, b in FIELD_BOOSTS.items())
    parts["ranked"] = f"""
SELECT query_id, sha256, max(score * CASE field {boosts} END) AS score FROM scores GROUP BY ALL"""
    parts["pages_shown"] = """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, sha256) AS rank,
       sha256, round(score, 6) AS score FROM ranked"""
    parts["hit_fragments"] = f"""
SELECT query_id, sha256, unnest(w) AS fragment, generate_subscripts(w, 1) - 1 AS fragment_no
FROM (SELECT query_id, sha256, regexp_extract_all(content, {lit(fragment_pattern(200))}) AS w
      FROM pages_shown JOIN corpus USING (sha256) WHERE rank <= 20)"""
    parts["fragment_words"] = f"""
SELECT query_id, sha256, fragment_no, fragment, unnest({words_of("fragment")}) AS word FROM hit_fragments"""
    parts["matched_words"] = f"""
SELECT f.query_id, sha256, fragment_no, fragment, word, coalesce(lemma, word) AS term
FROM (SELECT *, row_number() OVER () AS n FROM fragment_words WHERE word NOT IN {STOPS}) f
LEFT JOIN lemmas ON surface = word
JOIN (SELECT DISTINCT query_id, term FROM weighted WHERE field = 'content') w
  ON w.query_id = f.query_id AND w.term = coalesce(lemma, word)"""
    parts["marked"] = f"""
SELECT query_id, sha256, fragment_no, trim(array_to_string(list_transform(
         regexp_extract_all(fragment, {lit(TOKEN_RE2 + "|(?s:.)")}),
         lambda p: CASE WHEN list_contains(words, lower(p)) THEN '<em>' || p || '</em>' ELSE p END), ''),
         chr(32) || chr(9) || chr(13) || chr(10)) AS highlight
FROM (SELECT query_id, sha256, fragment_no, fragment, list(DISTINCT word) AS words,
             count(DISTINCT term) AS distinct_terms FROM matched_words GROUP BY ALL)
JOIN (SELECT query_id, sha256, fragment_no, count(*) AS matches
      FROM (SELECT DISTINCT query_id, sha256, fragment_no, word FROM matched_words)
      JOIN fragment_words USING (query_id, sha256, fragment_no, word) GROUP BY ALL)
  USING (query_id, sha256, fragment_no)
QUALIFY row_number() OVER (PARTITION BY query_id, sha256
                           ORDER BY distinct_terms DESC, matches DESC, fragment_no) <= 3"""
    return parts


def _seen_parts(updates: str) -> dict[str, str]:
    """Sightings applied to the registry, with windows over places and hashes."""
    parts = {}
    columns = ", ".join(REGISTRY)
    parts["seen_events"] = f"""
SELECT 0 AS seq, {columns}, 'registry' AS source FROM registry0
UNION ALL
SELECT seq, sha256, s3_bucket, s3_key, NULL, coalesce(filename, {base_name("s3_key")}), content_type,
       size_bytes, etag, NULL, NULL, NULL, seen_at, 'pending', NULL, source FROM {updates}"""
    parts["seen_changes"] = """
SELECT *, CASE WHEN sha256 IS DISTINCT FROM lag(sha256) OVER here THEN seq END AS changed
FROM seen_events WINDOW here AS (PARTITION BY s3_bucket, s3_key ORDER BY seq)"""
    parts["seen_broken"] = """
SELECT *, min(changed) OVER (PARTITION BY s3_bucket, s3_key ORDER BY seq
                             ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_other,
       lead(seq) OVER (PARTITION BY sha256 ORDER BY seq) AS next_own
FROM seen_changes"""
    parts["seen_segments"] = """
SELECT *, sum(coalesce(before, 0)) OVER (PARTITION BY sha256 ORDER BY seq) AS segment
FROM (SELECT *, lag(broken::INT) OVER (PARTITION BY sha256 ORDER BY seq) AS before
      FROM (SELECT *, coalesce(next_other < coalesce(next_own, 1000000000000), false) AS broken
            FROM seen_broken))"""
    first = ", ".join(
        f"first_value({c}) OVER segments AS seen_{c}"
        for c in ("text_s3_key", "extractor_version", "extracted_at", "indexed_at", "status", "error")
    )
    parts["seen_last"] = f"""
SELECT *, {first},
       coalesce(last_value(CASE WHEN source = 'upload' THEN filename END IGNORE NULLS) OVER segments,
                first_value(filename) OVER segments) AS seen_filename
FROM seen_segments
WINDOW segments AS (PARTITION BY sha256, segment ORDER BY seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
    parts["seen"] = """
SELECT sha256, s3_bucket, s3_key, seen_text_s3_key AS text_s3_key, seen_filename AS filename,
       content_type, size_bytes, etag, seen_extractor_version AS extractor_version,
       seen_extracted_at AS extracted_at, seen_indexed_at AS indexed_at, seen_at,
       seen_status AS status, seen_error AS error
FROM seen_last WHERE next_own IS NULL AND NOT broken"""
    return parts


PARTS["job_updates"] = """
SELECT unnest(list_distinct([first, last])) AS seq, sha256, s3_bucket, s3_key, NULL AS filename,
       content_type, size_bytes, etag, {as_of} AS seen_at, 'worker' AS source
FROM (SELECT payload::JSON ->> 'key' AS s3_key, min(event_id + 1) AS first, max(event_id + 1) AS last
      FROM payloads WHERE event_id % 19 <> 0 AND event_id % 23 <> 0 GROUP BY ALL)
JOIN objects USING (s3_key)""".replace("{as_of}", AS_OF)

PARTS["batch"] = """
SELECT seen.*, d.content, o_doc.doc_id AS doc_id, s.sha256 IS NOT NULL AS cached,
       s.extractor_version AS stored_version, s.extracted_at AS stored_at
FROM seen JOIN (SELECT DISTINCT sha256 FROM job_updates) USING (sha256)
JOIN objects o_doc ON o_doc.s3_key = seen.s3_key
JOIN (SELECT sha256, any_value(content) AS content FROM objects GROUP BY sha256) d USING (sha256)
LEFT JOIN sidecars s USING (sha256)"""

PARTS["judged"] = f"""
SELECT *, CASE WHEN cached AND status = 'needs_ocr' THEN 'skipped'
               WHEN cached THEN 'indexed'
               WHEN code IS NULL OR code >= 400 THEN 'error'
               WHEN {per_page("doc_id", "content", "length(content)")} < 100 THEN 'needs_ocr'
               ELSE 'indexed' END AS verdict
FROM (SELECT *, {CODE} AS code FROM batch)"""

PARTS["ingested"] = f"""
SELECT sha256, s3_bucket, s3_key,
       CASE WHEN verdict IN ('skipped', 'error') THEN text_s3_key ELSE 'text/' || sha256 || '.txt' END AS text_s3_key,
       filename, content_type, size_bytes, etag,
       CASE WHEN verdict IN ('skipped', 'error') THEN extractor_version ELSE coalesce(stored_version, 'v2') END AS extractor_version,
       CASE WHEN verdict IN ('skipped', 'error') THEN extracted_at ELSE coalesce(stored_at, {AS_OF}) END AS extracted_at,
       CASE WHEN verdict = 'indexed' THEN {AS_OF} ELSE indexed_at END AS indexed_at,
       seen_at, CASE WHEN verdict = 'skipped' THEN 'needs_ocr' ELSE verdict END AS status,
       CASE WHEN verdict = 'error' THEN {message("code", "substr(content, 1, 800)")} END AS error
FROM judged
UNION ALL
SELECT seen.* FROM seen WHERE sha256 NOT IN (SELECT sha256 FROM job_updates)"""

PARTS["rebuilt"] = """
SELECT r.sha256, s.text AS content, r.filename, r.s3_key, r.size_bytes, r.extractor_version, r.extracted_at
FROM registry0 r JOIN sidecars s USING (sha256)
WHERE r.status = 'indexed' AND r.text_s3_key IS NOT NULL AND r.extractor_version IS NOT NULL"""

PARTS["searchable"] = f"""
SELECT sha256, md5(content) AS content_md5, filename, s3_key, coalesce(stored_version, 'v2') AS extractor_version,
       coalesce(stored_at, {AS_OF}) AS extracted_at, {AS_OF} AS indexed_at
FROM judged WHERE verdict = 'indexed'
UNION ALL
SELECT sha256, md5(content), filename, s3_key, extractor_version, extracted_at,
       TIMESTAMP '2024-02-02 00:00:00'
FROM rebuilt WHERE sha256 NOT IN (SELECT sha256 FROM judged WHERE verdict = 'indexed')"""

PARTS["outcomes"] = f"""
SELECT seq, sha256, action, CASE WHEN action = 'error' THEN concat('failed ', doc_id) END AS error
FROM (SELECT doc_id, sha256(text) AS sha256, unnest(CASE
        WHEN code IS NULL OR code >= 400 THEN [{{'seq': doc_id * 2 + 1, 'action': 'error'}}]
        WHEN n_chars < 100 THEN [{{'seq': doc_id * 2, 'action': 'extracted'}}, {{'seq': doc_id * 2 + 1, 'action': 'needs_ocr'}}]
        WHEN doc_id % 7 <> 0 THEN [{{'seq': doc_id * 2, 'action': 'extracted'}}, {{'seq': doc_id * 2 + 1, 'action': 'indexed'}}]
        ELSE [{{'seq': doc_id * 2, 'action': 'extracted'}}] END, recursive := true)
      FROM (SELECT *, {CODE} AS code FROM documents))"""


def with_parts(body: str, parts: dict[str, str] | None = None) -> str:
    """The body after the parts it needs, in order of need."""
    known = {**PARTS, **(parts or {})}
    order: list[str] = []

    def need(sql: str, inside: str = "") -> None:
        for name in known:
            if name != inside and name not in order and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                need(known[name], name)
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS {'' if n == 'table_rows' else 'MATERIALIZED '}({known[n]})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{body}"


def _affix_values() -> str:
    rows = ", ".join(
        f"({lit(flag)}, {lit(kind)}, {str(cross).lower()}, {lit(strip)}, {lit(affix)}, "
        f"{'[' + ', '.join(lit(c) for c in cont) + ']' if cont else '[]::VARCHAR[]'}, {lit(cond)})"
        for flag, kind, cross, strip, affix, cont, cond in fx.AFFIXES
    )
    return f"SELECT * FROM (VALUES {rows}) AS t(flag, kind, is_cross, strip, affix, cont, cond)"


def _applied(kind: str, surface: str) -> str:
    """Condition and result of a rule of a kind on a surface."""
    if kind == "SFX":
        fits = f"suffix({surface}, r.strip) AND regexp_matches({surface}, r.cond || '$')"
        form = f"left({surface}, length({surface}) - length(r.strip)) || r.affix"
    else:
        fits = f"prefix({surface}, r.strip) AND regexp_matches({surface}, '^' || r.cond)"
        form = f"r.affix || substr({surface}, length(r.strip) + 1)"
    return fits, form


def _expansion() -> str:
    fits, form = _applied("SFX", "w.surface")
    pre_fits, pre_form = _applied("PFX", "w.surface")
    parts = {
        "affix_rules": _affix_values(),
        "stem_flags": f"""
SELECT word AS lemma, list_filter([
         CASE WHEN regexp_matches(word, '[esrd]$') THEN 'A' END, CASE WHEN suffix(word, 'n') THEN 'B' END,
         CASE WHEN regexp_matches(word, '^(th|in)') THEN 'N' END, CASE WHEN prefix(word, 're') THEN 'R' END],
         lambda f: f IS NOT NULL) AS flags
FROM vocabulary WHERE NOT contains(word, 'eau')""",
        "form0": """
SELECT lemma, lemma AS surface, []::VARCHAR[] AS far, flags AS near FROM stem_flags""",
        "form1": f"""
SELECT w.lemma, {form} AS surface, CASE WHEN r.is_cross THEN w.near ELSE [] END AS far, r.cont AS near
FROM form0 w JOIN affix_rules r ON r.kind = 'SFX' AND list_contains(w.near, r.flag) WHERE {fits}""",
        "form2": f"""
SELECT w.lemma, {form} AS surface, CASE WHEN r.is_cross THEN w.far ELSE [] END AS far, r.cont AS near
FROM form1 w JOIN affix_rules r ON r.kind = 'SFX' AND list_contains(w.near, r.flag) WHERE {fits}""",
        "forms": """
SELECT * FROM form0 UNION ALL SELECT * FROM form1 UNION ALL SELECT * FROM form2""",
    }
    return with_parts(
        f"""
SELECT surface, lemma FROM forms
UNION
SELECT {pre_form}, w.lemma FROM forms w JOIN affix_rules r ON r.kind = 'PFX'
 AND (list_contains(w.near, r.flag) OR (r.is_cross AND list_contains(w.far, r.flag))) WHERE {pre_fits}""",
        parts,
    )


def _search(body: str, source: str = "fixed_queries", fuzzy: bool = True) -> str:
    return with_parts(body, _query_parts(source, fuzzy))


def _safe() -> str:
    text = "replace(html, '<p>', '<em>''p''</em>')"
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "#39")):
        text = f"replace({text}, {lit(char)}, '&{name};')"
    text = f"replace({text}, '&lt;em&gt;', '<em>')"
    return f"replace({text}, '&lt;/em&gt;', '</em>')"


EXTENSION = "regexp_extract({}, '[^./][^/]*?(\\.[^./]*)$', 1)"
PAGE = "SELECT query_id, rank, sha256, score FROM pages_shown WHERE rank <= {}"


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["object_listing"] = with_parts("SELECT * FROM listing")
    sql["inventory_prefix"] = with_parts("SELECT * FROM listing WHERE starts_with(s3_key, 'documents/src1')")
    sql["object_info"] = f"""
SELECT page_id, s3_key, CASE WHEN page_id % 5 = 1 THEN 'text/x-page'
  ELSE coalesce(map {{{", ".join(f"{lit(e)}: {lit(t)}" for e, t in CONTENT_TYPES.items())}}}[
         lower(regexp_extract(s3_key, '[.]([^./]+)$', 1))], 'binary/octet-stream') END AS content_type
FROM (SELECT page_id, concat('documents/', page_id, [{", ".join(map(lit, fx.ENDINGS))}][page_id % {len(fx.ENDINGS)} + 1]) AS s3_key
      FROM pages)"""
    sql["stored_notes"] = f"""
SELECT doc_id, CASE WHEN note IS NULL THEN {time_text(AS_OF)}
                    ELSE {time_text("try_cast(CASE WHEN doc_id % 6 IN (1, 3) THEN note || '+00' ELSE note END AS TIMESTAMPTZ) AT TIME ZONE 'UTC'")}
               END AS extracted_at,
       note IS NOT NULL AND try_cast(note AS TIMESTAMPTZ) IS NULL AS bad_note,
       CASE WHEN doc_id % 4 > 0 THEN 'v' || (doc_id % 4) ELSE 'unknown' END AS extractor_version
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN day || 'T10:30:00+02:00' WHEN 1 THEN day || ' 23:59:59.25'
        WHEN 2 THEN day || 'T01:00:00Z' WHEN 3 THEN day || ' 00:00:00' WHEN 4 THEN 'yesterday' END AS note
      FROM (SELECT doc_id, '2024-03-' || lpad((doc_id % 33)::VARCHAR, 2, '0') AS day FROM documents))"""
    sql["sidecar_delta"] = with_parts(
        "SELECT DISTINCT sha256, 'text/' || sha256 || '.txt' AS text_s3_key, length(content) AS chars, "
        "'v2' AS extractor_version FROM objects "
        "WHERE sha256 NOT IN (SELECT sha256 FROM sidecars)"
    )
    sql["registry_lookup"] = with_parts(
        """
SELECT sha256, s3_bucket, s3_key, status, 'place' AS found_by FROM registry0
WHERE (s3_bucket, s3_key) IN (SELECT (s3_bucket, s3_key) FROM updates)
UNION ALL
SELECT sha256, s3_bucket, s3_key, status, 'hash' FROM registry0
WHERE sha256 IN (SELECT sha256 FROM updates)"""
    )
    address = f"concat('documents/', sha256, {EXTENSION.format('filename')})"
    sql["batch_ingest"] = with_parts(
        f"""
SELECT doc_id + 1 AS seq, o.sha256, coalesce(status, 'pending') AS status, o.s3_bucket, address AS s3_key,
       concat('{{"bucket":"documents","key":"', address, '"}}') AS payload
FROM (SELECT *, {address} AS address FROM objects) o LEFT JOIN registry0 r ON r.sha256 = o.sha256"""
    )
    uploads = f"""
SELECT doc_id + 1 AS seq, sha256, s3_bucket, {address} AS s3_key, filename, content_type, size_bytes, etag,
       {AS_OF} AS seen_at, 'upload' AS source FROM objects"""
    sql["upload_registry"] = with_parts(
        registry_row("seen"), {"upload_updates": uploads, **_seen_parts("upload_updates")}
    )
    sql["content_hash"] = "SELECT doc_id, sha256(text) AS sha256 FROM documents"
    sql["content_address"] = (
        f"SELECT page_id, concat('documents/', sha256(html), {EXTENSION.format('url')}) AS s3_key, "
        "concat('text/', sha256(html), '.txt') AS text_s3_key FROM pages"
    )
    sql["resolve_filename"] = with_parts(
        f"SELECT doc_id, coalesce(r.filename, {base_name('o.s3_key')}) AS filename "
        "FROM objects o LEFT JOIN registry0 r ON r.sha256 = o.sha256"
    )
    sql["ingest_rejects"] = """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 0 ELSE length(html) END AS chars,
       CASE WHEN page_id % 7 = 0 THEN 'filename is required' WHEN page_id % 5 = 0 THEN 'empty file'
            ELSE 'accepted' END AS reason FROM pages"""
    sql["parse_notifications"] = with_parts(
        """
SELECT event_id, s3_bucket, s3_key FROM (
  SELECT event_id, unnest(json_extract_string(body, '$.Records[*].s3.bucket.name')) AS s3_bucket,
         unnest(json_extract_string(body, '$.Records[*].s3.object.key')) AS s3_key
  FROM notifications WHERE json_valid(body))
WHERE s3_bucket <> '' AND s3_key <> ''"""
    )
    sql["decode_jobs"] = with_parts(
        """
SELECT event_id, bucket AS s3_bucket, key AS s3_key,
       CASE WHEN bucket IS NULL AND key IS NULL THEN 'not a job'
            WHEN bucket IS NULL OR key IS NULL THEN 'missing field' END AS reason
FROM (SELECT event_id, CASE WHEN json_valid(payload) THEN payload::JSON ->> 'bucket' END AS bucket,
             CASE WHEN json_valid(payload) THEN payload::JSON ->> 'key' END AS key FROM payloads)"""
    )
    measured = per_page("doc_id", "text", "n_chars")
    sql["chars_per_page"] = f"SELECT doc_id, round({measured}, 6) AS per_page FROM documents"
    sql["needs_ocr_gate"] = f"SELECT doc_id, {measured} < 100 AS needs_ocr FROM documents"
    sql["extraction_outcome"] = f"""
SELECT doc_id, CASE WHEN code IS NULL OR code >= 500 THEN 'retryable' WHEN code >= 400 THEN 'permanent'
       ELSE 'ok' END AS outcome, {message("code", "text")} AS error
FROM (SELECT *, {CODE} AS code FROM documents)"""
    sql["safe_highlight"] = f"SELECT page_id, {_safe()} AS safe FROM pages"
    sql["keyword_fields"] = with_parts(
        f"""
SELECT sha256, s3_bucket, s3_key, content_type, size_bytes, 'v1' AS extractor_version,
       {time_text("TIMESTAMP '2024-02-01 00:00:00'")} AS extracted_at, {time_text(AS_OF)} AS indexed_at,
       CASE WHEN length(content) <= 512 THEN replace(content, ' ', '_') END AS filename_keyword FROM corpus"""
    )
    sweep = """
SELECT l.s3_bucket, l.s3_key, l.size_bytes, l.etag, CASE WHEN r.s3_key IS NULL THEN 'new' ELSE 'changed' END AS state,
       concat('{"bucket":"', l.s3_bucket, '","key":"', l.s3_key, '"}') AS payload
FROM listing l LEFT JOIN registry0 r ON r.s3_bucket = l.s3_bucket AND r.s3_key = l.s3_key
WHERE r.s3_key IS NULL OR l.etag IS DISTINCT FROM r.etag"""
    sql["reconcile_sweep"] = with_parts(sweep)
    sql["reconcile_duplicates"] = with_parts(
        """
SELECT s3_key, state, sha256 IN (SELECT sha256 FROM registry0) AS known_duplicate
FROM swept JOIN objects USING (s3_key)""",
        {"swept": sweep},
    )
    sql["sweep_summary"] = with_parts(
        "SELECT state, count(*) AS objects FROM swept GROUP BY state", {"swept": sweep}
    )
    for name, test in (("cache_hits", "IN"), ("cache_misses", "NOT IN")):
        sql[name] = with_parts(
            f"SELECT sha256, s3_key, status FROM registry0 WHERE sha256 {test} (SELECT sha256 FROM sidecars)"
        )
    sql["reindex"] = with_parts(
        f"""
SELECT sha256, md5(content) AS content_md5, filename, s3_key, size_bytes, extractor_version,
       {time_text("extracted_at")} AS extracted_at, {time_text(AS_OF)} AS indexed_at FROM rebuilt"""
    )
    sql["index_audit"] = with_parts(
        """
SELECT CASE WHEN r.sha256 IS NULL THEN 'orphan' WHEN c.sha256 IS NULL THEN 'missing' ELSE 'matched' END AS state,
       count(*) AS documents
FROM corpus c
FULL JOIN (SELECT sha256 FROM registry0 WHERE status = 'indexed') r ON r.sha256 = c.sha256 GROUP BY 1"""
    )
    sql["expand_dictionary"] = _expansion()
    seen = _seen_parts("updates")
    sql["apply_seen"] = with_parts(registry_row("seen"), seen)
    sql["retired_rows"] = with_parts(
        """
SELECT sha256, s3_bucket, s3_key, retired_by, retired_seq
FROM (SELECT *, first_value(next_hash) OVER run AS retired_by, first_value(next_seq) OVER run AS retired_seq,
             row_number() OVER (PARTITION BY sha256 ORDER BY seq DESC) AS back
      FROM seen_runs WINDOW run AS (PARTITION BY s3_bucket, s3_key, run ORDER BY seq DESC))
WHERE back = 1 AND retired_by IS NOT NULL""",
        {
            **seen,
            # Sightings of one hash after another at a place are a run; the next row opens the next run.
            "seen_places": """
SELECT seq, sha256, s3_bucket, s3_key, lead(sha256) OVER here AS next_hash, lead(seq) OVER here AS next_seq,
       coalesce((sha256 IS DISTINCT FROM lag(sha256) OVER here)::INT, 1) AS opens
FROM seen_events WINDOW here AS (PARTITION BY s3_bucket, s3_key ORDER BY seq)""",
            "seen_runs": """
SELECT *, sum(opens) OVER (PARTITION BY s3_bucket, s3_key ORDER BY seq) AS run FROM seen_places""",
        },
    )
    sql["apply_outcomes"] = with_parts(
        f"""
SELECT sha256, s3_bucket, s3_key,
       CASE WHEN extracted THEN 'text/' || sha256 || '.txt' ELSE text_s3_key END AS text_s3_key,
       filename, content_type, size_bytes, etag,
       CASE WHEN extracted THEN 'v2' ELSE extractor_version END AS extractor_version,
       {time_text(f"CASE WHEN extracted THEN {AS_OF} ELSE extracted_at END")} AS extracted_at,
       {time_text(f"CASE WHEN was_indexed THEN {AS_OF} ELSE indexed_at END")} AS indexed_at,
       {time_text("seen_at")} AS seen_at, coalesce(last_action, status) AS status,
       CASE WHEN faulted THEN last_error ELSE error END AS error
FROM registry0 LEFT JOIN (
  SELECT sha256, arg_max(action, seq) AS last_action, bool_or(action = 'extracted') AS extracted,
         bool_or(action = 'indexed') AS was_indexed, bool_or(action <> 'extracted') AS faulted,
         (max({{'seq': seq, 'error': error}}) FILTER (action <> 'extracted')).error AS last_error
  FROM outcomes GROUP BY sha256) USING (sha256)"""
    )
    sql["corpus_upsert"] = with_parts(
        f"""
SELECT sha256, md5(content) AS content_md5, coalesce(u.filename, {base_name("u.s3_key")}) AS filename,
       u.s3_key, 'v2' AS extractor_version
FROM (SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY seq DESC) = 1) u
JOIN corpus USING (sha256)
UNION ALL
SELECT sha256, md5(content), filename, s3_key, 'v1' FROM corpus
WHERE sha256 NOT IN (SELECT sha256 FROM updates)"""
    )
    sql["count_by_status"] = with_parts(
        "SELECT status, count(*) AS documents FROM registry0 GROUP BY status"
    )
    sql["list_by_status"] = with_parts(
        registry_row("registry0") + " WHERE status = 'error' ORDER BY registry0.seen_at, sha256"
    )
    sql["tokenize"] = f"SELECT doc_id, array_to_string({words_of('text')}, ' ') AS words FROM documents"
    sql["stopword_filter"] = with_parts(
        f"SELECT sha256, count(*) AS kept_words, min(pos) AS first_pos, max(pos) AS last_pos "
        f"FROM content_words WHERE word NOT IN {STOPS} GROUP BY sha256"
    )
    sql["lemmatize"] = with_parts(
        "SELECT word, coalesce(lemma, word) AS lemma FROM vocabulary LEFT JOIN lemmas ON surface = word"
    )
    sql["ascii_fold"] = with_parts(f"SELECT word, {folded('word')} AS folded FROM vocabulary")
    sql["analyze_fields"] = with_parts(
        """
SELECT sha256, field, count(*) AS terms, count(DISTINCT pos) AS positions,
       md5(string_agg(e, ' ' ORDER BY e)) AS terms_md5
FROM (SELECT *, concat(pos, ':', term) AS e FROM field_words) GROUP BY sha256, field"""
    )
    sql["postings"] = with_parts(
        "SELECT field, term, sha256, tf, dl, array_to_string(positions, ',') AS positions "
        "FROM posts JOIN lengths USING (field, sha256)"
    )
    sql["term_stats"] = with_parts("SELECT * FROM terms")
    sql["field_stats"] = with_parts(
        "SELECT field, docs, round(avg_length, 6) AS avg_length FROM fields"
    )
    sql["fuzzy_terms"] = _search(
        "SELECT query_id, field, pos, query_term, term, distance, round(boost, 6) AS boost FROM weighted"
    )
    sql["bm25_scores"] = _search(
        "SELECT query_id, sha256, field, round(score, 6) AS score FROM scores"
    )
    sql["best_fields"] = _search("SELECT query_id, sha256, round(score, 6) AS score FROM ranked")
    sql["search_total"] = _search(
        "SELECT query_id, count(r.sha256) AS total FROM fixed_queries LEFT JOIN ranked r USING (query_id) GROUP BY query_id"
    )
    sql["search_page"] = sql["search_extended"] = _search(PAGE.format(20))
    sql["search_second_page"] = _search(PAGE.format(25) + " AND rank > 20")
    sql["search_exact"] = _search(PAGE.format(20), fuzzy=False)
    sql["search_many"] = _search(PAGE.format(10), "many_queries")
    sql["highlights"] = _search(
        "SELECT query_id, sha256, row_number() OVER (PARTITION BY query_id, sha256 ORDER BY fragment_no) - 1 AS n, "
        "highlight FROM marked"
    )
    sql["search_hits"] = _search(
        """
SELECT query_id, rank, filename, score, s3_bucket, s3_key, coalesce(fragments, 0) AS fragments
FROM (SELECT * FROM pages_shown WHERE rank <= 20) JOIN corpus USING (sha256)
LEFT JOIN (SELECT query_id, sha256, count(*) AS fragments FROM marked GROUP BY ALL) USING (query_id, sha256)"""
    )
    sql["quoted_query"] = _search(PAGE.format(20))
    sql["extract_text"] = f"SELECT page_id, {markup_text('html')} AS text FROM pages"
    title = markup_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
    values = {
        "Content-Type": "'text/html'",
        "Content-Encoding": """regexp_extract(html, '(?is)<meta[^>]*\\scharset="?([A-Za-z0-9_-]+)', 1)""",
        "dc:language": """regexp_extract(html, '(?is)<html[^>]*\\slang="([^"]*)"', 1)""",
        "dc:title": f"trim({title}, ' ' || chr(10))",
    }
    sql["extract_metadata"] = "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT page_id, {lit(k)} AS name, {v} AS value FROM pages" for k, v in values.items()
    ) + ") WHERE value <> ''"
    after = _seen_parts("job_updates")
    for name in ("ingest_jobs", "stream_ingest"):
        sql[name] = with_parts(registry_row("ingested"), after)
    sql["ingest_corpus"] = with_parts(
        f"""
SELECT sha256, content_md5, filename, s3_key, extractor_version, {time_text("extracted_at")} AS extracted_at,
       {time_text("indexed_at")} AS indexed_at FROM searchable""",
        after,
    )
    sql["replay_idempotent"] = with_parts(
        "SELECT i.sha256, i.s3_key, i.status, (s.sha256 IS NOT NULL)::BIGINT AS searchable "
        "FROM ingested i LEFT JOIN searchable s ON s.sha256 = i.sha256",
        after,
    )
    return sql
