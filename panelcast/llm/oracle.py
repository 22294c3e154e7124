"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from panelcast.llm.catalog import SHARD_BYTES

_SQL: dict[str, str] = {}

_SQL["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_SQL["op2_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)
), sized AS (
  SELECT *, length(role) + length(text) + 4 + 2 + 8
    + length(text) - length(replace(text, '\', ''))
    - 2 * ((length(replace(text, '\', '\s')) - length(replace(replace(text, '\', '\s'), '### ', ''))) // 4)
    - 5 * ((length(text) - length(replace(text, '</turn>', ''))) // 7)
    + length(role) - length(replace(role, '\', '')) AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_SQL["op3_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[s:s + 2] AS shingle
  FROM words, generate_series(1, greatest(1, len(w) - 2)) AS g(s) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 90 * (p.n + q.n - c)
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, low) AS component_id
FROM words LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) USING (doc_id)
"""

_SQL["op7_decontamination"] = r"""
WITH cut AS (
  SELECT 'd' AS side, doc_id::VARCHAR AS id, text FROM documents
  UNION ALL SELECT 'b', item_id::VARCHAR, text FROM benchmark
), words AS (
  SELECT side, id, row_number() OVER () AS r,
    list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda w: w <> '') AS w
  FROM cut
), items AS (
  SELECT DISTINCT id AS item, w[s:s + 9] AS win
  FROM words, generate_series(1, greatest(1, len(w) - 9)) AS g(s) WHERE side = 'b' AND len(w) > 0
), sizes AS (SELECT DISTINCT len(win) AS n FROM items
), places AS (
  SELECT r, s, n, w[s:s + n - 1] AS win
  FROM words, sizes, generate_series(1, len(w) - n + 1) AS g(s) WHERE side = 'd'
), hits AS (SELECT p.r, p.s, p.n, i.item FROM places p JOIN items i USING (win)
), covered AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (
    SELECT r, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list
  FROM hits GROUP BY r
)
SELECT id::BIGINT AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN named USING (r) WHERE side = 'd'
"""

# The pages of the given tables link to their own hosts only, so a host's scores are its seeds.
_SQL["op9_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM cut
), rules(rule, says) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'),
  ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')
), fits AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(says, length(rule)) AS says
  FROM (SELECT DISTINCT page_id, host, path FROM parts) p, rules
  WHERE (host = split_part(rule, '/', 1) OR suffix(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id
), ruled AS (SELECT p.*, rule, says FROM parts p LEFT JOIN fits USING (page_id)
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (says = 'allow') AS good, count(*) FILTER (says = 'block') AS bad
  FROM ruled WHERE host <> '' GROUP BY host
), seeds AS (
  SELECT host, good / n AS good, bad / n AS bad FROM hosts
), scores AS (
  SELECT host, coalesce(good / nullif(sum(good) OVER (), 0), 0) AS trust,
    coalesce(bad / nullif(sum(bad) OVER (), 0), 0) AS distrust FROM seeds
)
SELECT page_id, host, path, rule,
  coalesce(says, CASE WHEN distrust > 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN scores USING (host)
"""

_SQL["op10_extendible_shards"] = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), buckets AS (
  SELECT d, h >> (60 - d) AS cell, sum(n_bytes) AS total, count(*) AS n
  FROM hashed, generate_series(0, 60) AS s(d) GROUP BY ALL
), leaves AS (
  SELECT h.doc_id, h.n_bytes, h.h, min_by(struct_pack(d := b.d, total := b.total, n := b.n), b.d) AS leaf
  FROM hashed h JOIN buckets b
    ON b.cell = h.h >> (60 - b.d) AND (b.total <= {SHARD_BYTES} OR b.d = 60)
  GROUP BY ALL
)
SELECT doc_id, n_bytes, 's' || right(lpad(bin(h >> (60 - leaf.d)), 60, '0'), leaf.d) AS shard,
       leaf.d::BIGINT AS depth, leaf.total::BIGINT AS shard_bytes, leaf.n AS shard_rows
FROM leaves
"""


def _merkle_sql(group_levels: int = 7, top_levels: int = 4) -> str:
    """Levels are unrolled: up to 16^7 rows a group and 16^4 groups. A node's run is a list of the
    digests in it; a level of one node leaves it as it is."""

    def level(name: str, before: str) -> str:
        return (
            f"{name}_runs AS (SELECT g, i // 16 AS i, list(d ORDER BY i) AS ds, any_value(n) AS n "
            f"FROM {before} GROUP BY ALL), "
            f"{name} AS (SELECT g, i, (n + 15) // 16 AS n, "
            "CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d "
            f"FROM (SELECT g, i, ds, n FROM {name}_runs))"
        )

    def climb(name: str, before: str, runs: str, key: str) -> str:
        left, right = "array_to_string(r.ds[:p % 16], '')", "array_to_string(r.ds[p % 16 + 2:], '')"
        return (
            f"{name} AS (SELECT b.* REPLACE (p // 16 AS p, proof || {left} || {right} AS proof, "
            f"CASE WHEN r.n = 1 THEN acc ELSE sha256({left} || acc || {right}) END AS acc) "
            f"FROM {before} b JOIN {runs} r ON r.g = b.{key} AND r.i = b.p // 16)"
        )

    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    head = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(text, '{upper}', '{upper.lower()}')"
    crc = (
        "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), "
        "lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), "
        "lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    )
    parts = [
        f"leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256({head} || "
        f"{field.format('text')}) AS leaf, sha256({head} || {field.format(lowered)}) AS low, "
        f"coalesce({crc} % 5 = 0, false) AS bent FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 "
        "AS i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
    ]
    before = "placed"
    for k in range(group_levels):
        parts.append(level(f"n{k}", before))
        before = f"n{k}"
    parts.append(
        "subs AS (SELECT g AS own, d, 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, "
        f"count(*) OVER () AS n FROM {before})"
    )
    top = "subs"
    for k in range(top_levels):
        parts.append(level(f"t{k}", top))
        top = f"t{k}"
    parts.append(
        "c AS (SELECT doc_id, g, leaf, i AS p, '' AS proof, "
        "CASE WHEN bent THEN low ELSE leaf END AS acc FROM placed)"
    )
    at = "c"
    for k in range(group_levels):
        parts.append(climb(f"c{k}", at, f"n{k}_runs", "g"))
        at = f"c{k}"
    parts.append(
        "d AS (SELECT doc_id, leaf, proof, acc, s.i AS p, s.d AS subroot, 0 AS z "
        f"FROM {at} JOIN subs s ON s.own = {at}.g)"
    )
    at = "d"
    for k in range(top_levels):
        parts.append(climb(f"d{k}", at, f"t{k}_runs", "z"))
        at = f"d{k}"
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, "
        f"acc AS folded_root, acc = root AS verified FROM {at}, (SELECT d AS root FROM {top})"
    )


_SQL["op12_merkle_manifest"] = _merkle_sql()

_SQL["op13_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, k, w[s:s + k - 1] AS p, count(*)::HUGEINT AS f
  FROM words, generate_series(1, 5) AS g(k), generate_series(1, len(w) - k + 1) AS h(s)
  WHERE len(w) >= k GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, x.k AS cut, l.f AS l, r.f AS r, n, 1000 * c.f * n // (l.f * r.f) AS score
  FROM grams c JOIN generate_series(1, 4) AS x(k) ON x.k < c.k
  JOIN grams l ON l.lang = c.lang AND l.p = c.p[:x.k]
  JOIN grams r ON r.lang = c.lang AND r.p = c.p[x.k + 1:]
  JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), inside AS (
  SELECT DISTINCT b.lang, b.p[s:s + m - 1] AS p, b.f
  FROM grams b, generate_series(2, 4) AS g(m), generate_series(1, 4) AS h(s)
  WHERE m < b.k AND s <= b.k - m + 1
), kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.p = c.p AND 100 * i.f >= 100 * c.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
  array_to_string(p, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
  score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
