"""DuckDB SQL of corpus queries, written independently of how the operators work."""

from __future__ import annotations

#: (kind, pattern, group whose length counts, its least length), as the scanner's rules have them.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_QUOTE = "[\"'']"
_SPANS = (
    ("assign", rf"({_WORDS}){_QUOTE}?\x20*[:=]\x20*{_QUOTE}?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA([A-Z0-9]+)", 1, 16),
    ("hex", "([0-9a-f]{24,})", 1, 24),
    ("forge", "gh[pousr]_([A-Za-z0-9]+)", 1, 30),
    ("chat", "xox[abprs]-([A-Za-z0-9-]+)", 1, 12),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 1, 8),
    ("pem", "-----BEGIN [A-Z ]*(PRIVATE KEY-----)", 1, 1),
)


def _scan_sql() -> str:
    # A match starts behind all gaps before it and all earlier matches.
    per_kind = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, {group} AS g, {least} AS least, '{pattern}' AS p,
                   regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS gap FROM texts"""
        for k, (kind, pattern, group, least) in enumerate(_SPANS)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind, *_ in _SPANS[:3])
    at = "kind || ':' || s || ':' || (s + length(hit))"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), scanned AS ({per_kind}
), hits AS (
  SELECT doc_id, k, kind, least, g, p, unnest(m) AS hit, unnest(range(1, len(m) + 1)) AS i, m, gap FROM scanned WHERE len(m) > 0
), placed AS (
  SELECT doc_id, k, kind, hit,
         CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM hits WHERE CASE g WHEN 2 THEN length(regexp_extract(hit, '{_SPANS[0][1]}', 2))
                        ELSE length(hit) - CASE kind {" ".join(f"WHEN '{kind}' THEN length(hit) - length(regexp_extract(hit, '{pattern}', 1))" for kind, pattern, group, _ in _SPANS if group == 1)} END END >= least
), told AS (
  SELECT doc_id, {counts},
         coalesce(string_agg({at}, ',' ORDER BY s, k) FILTER (WHERE k < 3), '') AS base, coalesce(string_agg({at}, ',' ORDER BY s, k), '') AS spans
  FROM placed GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN told USING (doc_id)
"""


_CLUSTERS_SQL = """
WITH RECURSIVE parts AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), sound AS (
  SELECT * FROM parts
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reached AS (
  SELECT u AS node, u AS there FROM links UNION SELECT r.node, l.v FROM reached r JOIN links l ON r.there = l.u
), component AS (
  SELECT node, min(there) AS component_id FROM reached GROUP BY node
), degree AS (
  SELECT u, count(*) AS n_links FROM links GROUP BY u
)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN component c ON c.node = e.vec_id LEFT JOIN degree d ON d.u = e.vec_id
"""

_WORD_TOTALS_SQL = r"""
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs,
       CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens
FROM documents GROUP BY source, lang
"""

_SHINGLES_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), reached AS (
  SELECT u AS node, u AS there FROM links UNION SELECT r.node, l.v FROM reached r JOIN links l ON r.there = l.u
), component AS (
  SELECT node, min(there) AS component_id FROM reached GROUP BY node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN component c ON c.node = d.doc_id
"""


def _packing_sql(buckets: int = 12, budget: int = 16384) -> str:
    layers = ["layer0 AS (SELECT j, CASE WHEN j = 0 THEN 0::DOUBLE ELSE 'inf'::DOUBLE END AS best, 0 AS choice FROM sums)"]
    for k in range(1, buckets + 1):
        layers.append(f"""layer{k} AS (
  SELECT 0 AS j, 0::DOUBLE AS best, 0 AS choice
  UNION ALL
  SELECT s.j, min(l.best + s.cell * (s.total - o.total)), arg_min(o.j, (l.best + s.cell * (s.total - o.total), o.j))
  FROM sums s JOIN sums o ON o.j < s.j JOIN layer{k - 1} l ON l.j = o.j WHERE s.j > 0 GROUP BY s.j)""")
    steps = [f"step{buckets} AS (SELECT max(j) AS j FROM sums)"]
    for k in range(buckets - 1, -1, -1):
        steps.append(f"step{k} AS (SELECT choice AS j FROM layer{k + 1} WHERE j = (SELECT j FROM step{k + 1}))")
    chosen = " UNION ".join(f"SELECT j FROM step{k}" for k in range(1, buckets + 1))
    return rf"""
WITH lengths AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS length FROM documents
), stepped AS (
  SELECT *, CAST(pow(2, greatest(0, floor(log2(greatest(length, 1))) - 9)) AS BIGINT) AS step FROM lengths
), cells AS (
  SELECT CAST(ceil(length / step) * step AS BIGINT) AS cell, count(*) AS n FROM stepped GROUP BY ALL
), sums AS (
  SELECT 0 AS j, 0::DOUBLE AS cell, 0::DOUBLE AS total
  UNION ALL
  SELECT CAST(row_number() OVER (ORDER BY cell) AS INT), cell::DOUBLE, CAST(sum(n) OVER (ORDER BY cell) AS DOUBLE) FROM cells
), {", ".join(f"{x.split(' AS ', 1)[0]} AS MATERIALIZED {x.split(' AS ', 1)[1]}" for x in [*layers, *steps])}
, bounds AS (
  SELECT list(CAST(cell AS BIGINT) ORDER BY cell) AS b FROM sums WHERE j > 0 AND j IN ({chosen})
), bucketed AS (
  SELECT doc_id, length, CAST(len(list_filter(b, lambda x: x < length)) AS INT) AS bucket, b FROM lengths, bounds
), placed AS (
  SELECT *, b[bucket + 1] AS boundary, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS LAST, length) - 1 AS place FROM bucketed
), roomy AS (
  SELECT *, greatest(1, CAST(floor({budget} / greatest(boundary, 1)) AS BIGINT)) AS room FROM placed
)
SELECT doc_id, length, bucket, boundary, CAST(place // room AS BIGINT) AS batch, CAST(place % room AS BIGINT) AS slot FROM roomy
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": _scan_sql(),
        "op3_embedding_dedup": _CLUSTERS_SQL,
        "word_totals": _WORD_TOTALS_SQL,
        "op8_minhash_dedup": _SHINGLES_SQL,
        "op9_packing": _packing_sql(),
    }
