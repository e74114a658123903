"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from .bpe import op8_bpe
from .collocations import op13_collocations
from .embedding_dup import op3_embedding_dup
from .language_id import op7_language_id
from .lloyd import op12_lloyd
from .media_copies import op2_media_copies
from .near_dup import op4_near_dup
from .packing import op5_packing
from .pii import op6_pii
from .quality_crf import op1_quality
from .token_count import op10_token_count
from .url_filter import op9_url_filter
from .warc import op11_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_media_copies": op2_media_copies,
    "op3_embedding_dup": op3_embedding_dup,
    "op4_near_dup": op4_near_dup,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_language_id": op7_language_id,
    "op8_bpe": op8_bpe,
    "op9_url_filter": op9_url_filter,
    "op10_token_count": op10_token_count,
    "op11_warc": op11_warc,
    "op12_lloyd": op12_lloyd,
    "op13_collocations": op13_collocations,
}

#: Components as the least id of each closure; small graphs only, as the checks have. The other operators rest on
#: fitted models, merge tables or cascades of rewriting that SQL can't express.
_CLOSURE = "c(id, m) AS (SELECT id, id FROM nodes UNION SELECT c.id, p.b FROM c JOIN pairs p ON p.a = c.m), comp AS (SELECT id, min(m) AS component_id FROM c GROUP BY id)"



def _lloyd_sql(rounds: int = 3, k: int = 16, dim: int = 64) -> str:
    """Rounds of assignment and exact means, one table each; `c` rows are (cluster, components)."""
    with_ = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)::HUGEINT) AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS cluster, e FROM v QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        with_.append(f"d{i} AS (SELECT r, cluster, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i} c)")
        with_.append(f"a{i} AS (SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM d{i} GROUP BY r)")
        if i < rounds:
            with_.append(f"u{i} AS (SELECT cluster, unnest(e) AS x, unnest(range(1, {dim + 1})) AS j FROM v JOIN a{i} USING (r))")
            with_.append(f"s{i} AS (SELECT cluster, j, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::HUGEINT AS x FROM u{i} GROUP BY cluster, j)")
            with_.append(f"m{i} AS (SELECT cluster, list(x ORDER BY j) AS e FROM s{i} GROUP BY cluster)")
            with_.append(f"c{i + 1} AS (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (cluster))")
    tables = ", ".join(f"{w.split(' AS ', 1)[0]} AS MATERIALIZED {w.split(' AS ', 1)[1]}" for w in with_)
    return f"""WITH {tables} SELECT vec_id, a.cluster::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.cluster = a.cluster"""


ORACLES: dict[str, str] = {
    "op3_embedding_dup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS size FROM v),
pairs AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id <> y.id AND len(x.e) = len(y.e) WHERE list_inner_product(x.e, y.e) / (x.size * y.size) >= 0.95),
nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings),
{_CLOSURE}
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON id = vec_id""",
    "op4_near_dup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
one AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
pairs AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
nodes AS (SELECT DISTINCT doc_id AS id FROM documents),
{_CLOSURE}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN comp ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM m""",
    "op12_lloyd": _lloyd_sql(),
    "op13_collocations": """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
g AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))))) AS g FROM w),
f AS MATERIALIZED (SELECT lang, g, len(g) - len(replace(g, ' ', '')) + 1 AS len, count(*) AS f FROM g GROUP BY lang, g),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT lang, g, len, f, string_split(g, ' ') AS w FROM f WHERE f >= 30),
parts AS (SELECT lang, g, f AS a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, len)) AS k FROM often)),
cuts AS (SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM parts c JOIN often x ON x.lang = c.lang AND x.g = c.x JOIN often y ON y.lang = c.lang AND y.g = c.y),
low AS (SELECT lang, g, arg_min({'a': a, 'l': l, 'r': r, 'score': score}, (score, k)) AS s FROM cuts GROUP BY lang, g),
held AS (SELECT lang, f, unnest(flatten(list_transform(range(2, len), lambda m: list_transform(range(1, len - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS g FROM often WHERE len > 2),
longest AS (SELECT lang, g, max(f) AS f FROM held GROUP BY lang, g),
kept AS (SELECT low.lang, low.g AS phrase, s.a AS a, s.l AS l, s.r AS r, s.score::BIGINT AS score FROM low LEFT JOIN longest h ON h.lang = low.lang AND h.g = low.g WHERE h.f IS NULL OR 100 * h.f < 80 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
