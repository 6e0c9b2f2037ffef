"""DuckDB SQL for the contract queries that SQL can express.

The others (2, 3, 5, 6, 9, 10) are tested against plain versions in tests/llm:
SQL has no iterated covariance estimates, context trees, tokenizers or XXH64.
"""

from __future__ import annotations

from .secret_scan import BASE_RULES, RULES
from .suffix_index import LENGTH
from .suffix_tree import WINDOW

OP1 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d)),
hit AS (SELECT doc_id, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, min(i) AS lo, max(i) + {LENGTH} AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k),
piece AS (SELECT d.doc_id, lo, substr(h, 2 * coalesce(lag(hi) OVER (PARTITION BY d.doc_id ORDER BY lo), 0) + 1, 2 * (lo - coalesce(lag(hi) OVER (PARTITION BY d.doc_id ORDER BY lo), 0))) AS s FROM d JOIN run ON run.doc_id = d.doc_id),
sums AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last FROM run GROUP BY doc_id),
heads AS (SELECT doc_id, string_agg(s, '' ORDER BY lo) AS s FROM piece GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(heads.s, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN heads ON heads.doc_id = d.doc_id
"""

OP4 = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
hit AS (SELECT doc_id, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, (SELECT unnest(range({WINDOW})) AS k)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def _op7() -> str:
    total = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)".format
    parts = []
    for k, r in enumerate(RULES):
        pattern = r.java.replace("'", "''")
        found = f"SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g, string_split_regex(t, '{pattern}') AS p FROM d"
        each = f"SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM ({found})"
        begin = f"({total('p[1:i]')} + {total('m[1:i - 1]')})"
        parts.append(f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {begin}::bigint AS s, ({begin} + length(m[i]))::bigint AS e FROM ({each}) WHERE length(g[i]) >= {r.least}")
    kinds = len(BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), span AS ({' UNION ALL '.join(parts)}),
a AS (SELECT doc_id, {counts}, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {kinds}), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""


OP8 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, min(page_id) AS first FROM p GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN g USING (digest)
"""


def all_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1, "op4_suffix_tree_dedup": OP4, "op7_secret_scan": _op7(), "op8_warc_writer": OP8}
