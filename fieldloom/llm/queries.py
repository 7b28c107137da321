"""The queries of the training-data problems and the SQL that DuckDB checks them with."""

from __future__ import annotations

import importlib

#: Query name -> module of this package that defines it.
WHERE = {
    "p1_found": "history",
    "p1_links": "history",
    "p1_clusters": "history",
    "p2_found": "communities",
    "p2_communities": "communities",
    "p2_members": "communities",
    "p3_found": "retellings",
    "p3_groups": "retellings",
    "p3_shares": "retellings",
    "p4_found": "spans",
    "p4_shares": "spans",
    "p5_found": "neighbours",
    "p6_ids": "encoding",
    "p7_containers_1": "packing",
    "p7_containers_2": "packing",
    "p7_containers_3": "packing",
    "p7_containers_4": "packing",
    "p7_containers_5": "packing",
    "p8_found": "sentences",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"fieldloom.llm.{module}"), name) for name, module in WHERE.items()}


WORDS = "regexp_extract_all(lower(replace(body, 'İ', 'i' || chr(775))), '[\\p{L}\\p{N}_]+')"
ALIKE = f"""WITH t AS (SELECT record_id, {WORDS} AS w FROM tape_records WHERE body IS NOT NULL), l AS (SELECT * FROM t WHERE len(w) >= 40),
g AS (SELECT DISTINCT record_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT record_id, w, unnest(range(1, len(w) - 1)) AS i FROM l)), n AS (SELECT record_id, count(*) AS n FROM g GROUP BY 1),
s AS (SELECT a.record_id AS record_a, b.record_id AS record_b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.record_id < b.record_id GROUP BY ALL),
p AS (SELECT record_a, record_b FROM s JOIN n x ON x.record_id = record_a JOIN n y ON y.record_id = record_b WHERE shared::DOUBLE / (x.n + y.n - shared) >= 0.7::DOUBLE)"""
LINKED = ALIKE + ", k AS (SELECT record_a AS x, record_b AS y FROM p UNION ALL SELECT record_b, record_a FROM p), d AS (SELECT l.record_id, count(y) AS links FROM l LEFT JOIN k ON x = l.record_id GROUP BY 1)"
GOOD = "vec IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0"
SPANS = """WITH w AS (SELECT record_id, i, substr(body, i, 200) AS s FROM (SELECT record_id, body, unnest(range(1, length(body) - 198)) AS i FROM tape_records WHERE length(body) >= 200)),
m AS (SELECT s FROM w GROUP BY 1 HAVING min(record_id) <> max(record_id)), h AS (SELECT record_id, i - 1 AS s, i + 199 AS e FROM w SEMI JOIN m USING (s)),
o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY record_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM h), g AS (SELECT *, sum(new) OVER (PARTITION BY record_id ORDER BY s) AS k FROM o)
, spans AS (SELECT record_id, min(s)::INT AS span_start, max(e)::INT AS span_end FROM g GROUP BY record_id, k)"""
SQL = {
    "p3_found": ALIKE + " SELECT record_a, record_b FROM p",
    "p3_groups": LINKED + ", c AS (WITH RECURSIVE r(x, y) AS (SELECT record_id, record_id FROM l UNION SELECT r.x, k.y FROM r JOIN k ON r.y = k.x) SELECT x, min(y) AS grp FROM r GROUP BY 1), f AS (SELECT l.record_id, min(z.record_id) AS cls FROM l JOIN tape_records b USING (record_id) JOIN tape_records z ON z.body = b.body GROUP BY 1) SELECT d.record_id, cls, grp, links FROM d JOIN c ON c.x = d.record_id JOIN f ON f.record_id = d.record_id",
    "p3_shares": LINKED + " SELECT doc_id, count(*) AS records, round(avg((links > 0)::INT::DOUBLE), 6) AS retelling_share FROM d JOIN tape_records USING (record_id) WHERE doc_id >= 0 GROUP BY 1",
    "p4_found": SPANS + " SELECT record_id, span_start, span_end FROM spans",
    "p4_shares": SPANS + ", c AS (SELECT record_id, sum(span_end - span_start)::BIGINT AS n, count(*) AS spans FROM spans GROUP BY 1) SELECT record_id, CASE WHEN starts_with(origin, 'transcript') THEN 'message' ELSE 'chunk' END AS side, length(body) AS chars, coalesce(n, 0) AS shared_chars, coalesce(spans, 0) AS spans, CASE WHEN body IS NULL THEN NULL WHEN length(body) = 0 THEN 0 ELSE round(coalesce(n, 0)::DOUBLE / length(body), 6) END AS share FROM tape_records LEFT JOIN c USING (record_id)",
    "p5_found": f"""WITH c0 AS (SELECT chunk_id, list_transform(vec, lambda x: x::DOUBLE) AS v FROM chunks WHERE {GOOD}), c AS (SELECT chunk_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM c0),
s AS (SELECT a.chunk_id AS q, b.chunk_id AS nbr, round(list_inner_product(a.v, b.v), 6) AS w FROM c a JOIN c b ON a.chunk_id <> b.chunk_id), k AS (SELECT q, nbr FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY w DESC, nbr) AS r FROM s WHERE w >= 0.8::DOUBLE) WHERE r <= 5)
SELECT DISTINCT least(q, nbr) AS chunk_a, greatest(q, nbr) AS chunk_b FROM k""",
}


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables where that is feasible; the other queries are tested against brute force and exact round trips."""
    return dict(SQL)
