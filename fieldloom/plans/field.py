"""Queries over vectors: scans, nearest neighbours, edges, communities, residuals, fronts.

The table embeddings stands for a small field: document = vec_id div 4, lane = label, arrival by document. Whole-field
searches over chunks take every chunk whose id is divisible by 50 as a query, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fieldloom.functions import vectors as V
from fieldloom.operators import graph, knn, partitions as P, series as S
from fieldloom.plans.registry import query
from fieldloom.sources.tables import table

U = """WITH e0 AS (SELECT vec_id, vec_id // 4 AS doc, label, list_transform(embedding, lambda x: x::DOUBLE) AS v0 FROM embeddings),
u AS (SELECT vec_id, doc, label, list_transform(v0, lambda x: x / (sqrt(list_inner_product(v0, v0)) + 1e-9::DOUBLE)) AS v FROM e0)"""
NEAR = U + """, s AS (SELECT a.vec_id AS q, b.vec_id AS nbr, a.doc AS qdoc, b.doc AS ndoc, round(list_inner_product(a.v, b.v), 6) AS w FROM u a JOIN u b ON a.doc <> b.doc),
k3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY w DESC, nbr) AS r FROM s WHERE w >= 0.30::DOUBLE) WHERE r <= 3),
edges AS (SELECT least(q, nbr) AS a, greatest(q, nbr) AS b, max(w) AS w FROM k3 GROUP BY ALL),
k10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY w DESC, nbr) AS r FROM s WHERE w >= 0.30::DOUBLE) WHERE r <= 10),
mutual AS (SELECT least(q, nbr) AS a, greatest(q, nbr) AS b, max(w) AS w FROM k10 GROUP BY ALL HAVING count(*) = 2)"""


def field(spark, sf) -> DataFrame:
    """(id, grp, pos, label, v) of embeddings, normalised."""
    e = table(spark, sf, "embeddings")
    doc = F.floor(F.col("vec_id") / 4).cast("bigint")
    return e.select(F.col("vec_id").cast("bigint").alias("id"), doc.alias("grp"), doc.alias("pos"), "label", V.normalise(F.col("embedding")).alias("v"))


def near3(spark, sf) -> DataFrame:
    f = field(spark, sf)
    return knn.block_topk(f, f, 3, 0.30)


def edges(spark, sf) -> DataFrame:
    return knn.either_lists(near3(spark, sf))


def mutual(spark, sf) -> DataFrame:
    f = field(spark, sf)
    return knn.both_list(knn.block_topk(f, f, 10, 0.30))


Q0 = "list_transform(embedding, lambda x: round(x::DOUBLE * 127::DOUBLE)::BIGINT)"


@query("scan_topk", f"WITH q AS (SELECT vec_id, label, {Q0} AS v FROM embeddings) SELECT q.vec_id, q.label, list_inner_product(q.v, z.v)::BIGINT AS score FROM q, (SELECT v FROM q WHERE vec_id = 0) z ORDER BY score DESC, vec_id LIMIT 10")
def scan_topk(spark, sf):
    """Quantised scan: the ten best of all vectors for vector 0, exact integers."""
    q = table(spark, sf, "embeddings").select("vec_id", "label", V.quantise(F.col("embedding")).alias("v"))
    top = knn.scan(q, q.where("vec_id = 0").select(F.col("v").alias("query")), V.int_dot(F.col("v"), F.col("query")), 10, "vec_id")
    return top.join(q.select("vec_id", "label"), "vec_id").select("vec_id", "label", "score")


@query("scan_two_pass", f"WITH q AS (SELECT vec_id, {Q0} AS v FROM embeddings), z AS (SELECT v FROM q WHERE vec_id = 0), c AS (SELECT q.vec_id, q.v, list_inner_product(q.v[1:16], z.v[1:16])::BIGINT AS coarse FROM q, z ORDER BY coarse DESC, vec_id LIMIT 128) SELECT c.vec_id, coarse, list_inner_product(c.v, z.v)::BIGINT AS score FROM c, z ORDER BY score DESC, vec_id LIMIT 20")
def scan_two_pass(spark, sf):
    """Coarse top 128 on 16 head dimensions, rescored in full, top 20."""
    q = table(spark, sf, "embeddings").select("vec_id", V.quantise(F.col("embedding")).alias("v"))
    z = F.broadcast(q.where("vec_id = 0").select(F.col("v").alias("query")))
    head = lambda c: F.slice(c, 1, 16)
    coarse = q.join(z).select("vec_id", "v", "query", V.int_dot(head("v"), head("query")).alias("coarse")).orderBy(F.desc("coarse"), "vec_id").limit(128)
    return coarse.select("vec_id", "coarse", V.int_dot(F.col("v"), F.col("query")).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query("vec_norms", "SELECT chunk_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM (SELECT chunk_id, list_transform(vec, lambda x: x::DOUBLE) AS v FROM chunks WHERE vec IS NOT NULL AND len(list_filter(vec, lambda x: isnan(x))) = 0)")
def vec_norms(spark, sf):
    c = table(spark, sf, "chunks").where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: F.isnan(x)))
    return c.select("chunk_id", F.round(V.norm(F.col("vec")), 6).alias("norm"))


@query("quantised_sums", f"SELECT vec_id, list_sum({Q0})::BIGINT AS total, list_max({Q0})::BIGINT AS largest FROM embeddings")
def quantised_sums(spark, sf):
    q = table(spark, sf, "embeddings").select("vec_id", V.quantise(F.col("embedding")).alias("v"))
    return q.select("vec_id", F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.array_max("v").cast("bigint").alias("largest"))


GOOD = "vec IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0"


@query("field_knn", f"WITH c0 AS (SELECT chunk_id, doc_id, list_transform(vec, lambda x: x::DOUBLE) AS v0 FROM chunks WHERE {GOOD}), c AS (SELECT chunk_id, doc_id, list_transform(v0, lambda x: x / (sqrt(list_inner_product(v0, v0)) + 1e-9::DOUBLE)) AS v FROM c0), s AS (SELECT a.chunk_id AS q, b.chunk_id AS nbr, round(list_inner_product(a.v, b.v), 6) AS w FROM c a JOIN c b ON a.doc_id <> b.doc_id WHERE a.chunk_id % 50 = 0) SELECT q, nbr, w FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY w DESC, nbr) AS r FROM s WHERE w >= 0.6::DOUBLE) WHERE r <= 3")
def field_knn(spark, sf):
    """Chunk neighbours of other documents: k = 3 at cosine .60, the reference's defaults."""
    c = table(spark, sf, "chunks").where(V.usable(F.col("vec"), 64))
    rows = c.select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("grp"), F.lit(0).cast("bigint").alias("pos"), V.normalise(F.col("vec")).alias("v"))
    return knn.block_topk(rows.where("id % 50 = 0"), rows, 3, 0.6)


@query("knn_top3", NEAR + " SELECT q, nbr, w FROM k3")
def knn_top3(spark, sf):
    return near3(spark, sf)


@query("knn_links", NEAR + ", l AS (SELECT a AS x, b AS y, w FROM edges UNION ALL SELECT b, a, w FROM edges) SELECT u.vec_id, count(l.y) AS links, count(l.y) FILTER (WHERE l.w >= 0.45::DOUBLE) AS dup_links FROM u LEFT JOIN l ON l.x = u.vec_id GROUP BY 1")
def knn_links(spark, sf, duplicate: float = 0.45):
    """Of each vector its number of symmetrised top-3 links, and of those that are duplicates rather than sem.

    The vectors of embeddings have no pair at .97; passage_links has that threshold on the passages.
    """
    both = graph.both_ways(edges(spark, sf))
    n = both.groupBy("src").agg(F.count("*").alias("links"), F.count_if(F.col("w") >= duplicate).alias("dup_links"))
    return field(spark, sf).select(F.col("id").alias("vec_id")).join(n, F.col("vec_id") == F.col("src"), "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("dup_links", F.lit(0)).alias("dup_links"))


@query("knn_mutual", NEAR + " SELECT a, b, w FROM mutual")
def knn_mutual(spark, sf):
    return mutual(spark, sf)


DOCV = U + ", x AS (SELECT doc, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM u), m AS (SELECT doc, dim, avg(x) AS x FROM x GROUP BY ALL), z AS (SELECT doc, sqrt(sum(x * x)) + 1e-9::DOUBLE AS n FROM m GROUP BY 1)"


@query("doc_vectors", DOCV + " SELECT m.doc, (dim - 1)::INT AS dim, round(x / n, 6) AS x FROM m JOIN z USING (doc)")
def doc_vectors(spark, sf):
    """Normalised mean of each document's chunk vectors, by coordinates."""
    d = P.mean_vectors(field(spark, sf), "grp", "v")
    return d.select(F.col("grp").alias("doc"), F.posexplode("centroid").alias("dim", "x")).select("doc", "dim", F.round("x", 6).alias("x"))


@query("doc_knn", DOCV + ", d AS (SELECT doc, list(x / n ORDER BY dim) AS v FROM m JOIN z USING (doc) GROUP BY 1), s AS (SELECT a.doc AS q, b.doc AS nbr, round(list_inner_product(a.v, b.v), 6) AS w FROM d a JOIN d b ON a.doc <> b.doc) SELECT q, nbr, w FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY w DESC, nbr) AS r FROM s WHERE w >= 0.2::DOUBLE) WHERE r <= 4")
def doc_knn(spark, sf):
    d = P.mean_vectors(field(spark, sf), "grp", "v").select(F.col("grp").alias("id"), "grp", F.lit(0).cast("bigint").alias("pos"), F.col("centroid").alias("v"))
    return knn.block_topk(d, d, 4, 0.2)


def bridge_rows(spark, sf) -> DataFrame:
    """Pairs of different documents and lanes at .35 <= w < .45: the strongest 160, by w, a and b descending."""
    f = field(spark, sf).select("id", "grp", F.col("label").cast("bigint").alias("label"), "v")
    return knn.band_pairs(f, 0.35, 0.45, 160)


BR = NEAR + ", br AS (SELECT s.q AS a, s.nbr AS b, s.w FROM s JOIN u x ON x.vec_id = s.q JOIN u y ON y.vec_id = s.nbr WHERE s.q < s.nbr AND s.w >= 0.35::DOUBLE AND s.w < 0.45::DOUBLE AND x.label <> y.label ORDER BY s.w DESC, a DESC, b DESC LIMIT 160)"


@query("bridges", BR + " SELECT a, b, w FROM br")
def bridges(spark, sf):
    return bridge_rows(spark, sf)


@query("bridge_merge", BR + " SELECT coalesce(e.a, br.a) AS a, coalesce(e.b, br.b) AS b, coalesce(e.w, br.w) AS w, br.a IS NOT NULL AS bridge FROM edges e FULL OUTER JOIN br ON e.a = br.a AND e.b = br.b")
def bridge_merge(spark, sf):
    """Existing edges flagged as bridges, other bridges added."""
    b = bridge_rows(spark, sf).withColumnRenamed("w", "bw").withColumn("is", F.lit(True))
    return edges(spark, sf).join(b, ["a", "b"], "full_outer").select("a", "b", F.coalesce("w", "bw").alias("w"), F.coalesce("is", F.lit(False)).alias("bridge"))


@query("bridges_out", BR + ", m AS (SELECT vec_id FROM u WHERE label = 3) SELECT a, b, w FROM br WHERE (a IN (SELECT vec_id FROM m)) <> (b IN (SELECT vec_id FROM m))")
def bridges_out(spark, sf):
    """Bridges with exactly one end in lane 3."""
    m = field(spark, sf).where("label = 3").select("id")
    b = bridge_rows(spark, sf).join(m.select(F.col("id").alias("a"), F.lit(True).alias("ia")), "a", "left").join(m.select(F.col("id").alias("b"), F.lit(True).alias("ib")), "b", "left")
    return b.where(F.col("ia").isNull() != F.col("ib").isNull()).select("a", "b", "w")


@query("degree", NEAR + ", l AS (SELECT a AS node, w FROM edges UNION ALL SELECT b, w FROM edges) SELECT node, count(*) AS degree, round(sum(w) + 1e-9::DOUBLE, 5) AS strength FROM l GROUP BY 1")
def degree(spark, sf):
    return graph.degree(edges(spark, sf)).select("node", "degree", F.round(F.col("strength") + 1e-9, 5).alias("strength"))


@query("dark_matter", NEAR + " SELECT vec_id FROM u WHERE vec_id NOT IN (SELECT a FROM edges UNION ALL SELECT b FROM edges) ORDER BY vec_id LIMIT 40")
def dark_matter(spark, sf):
    """The first forty vectors without an edge."""
    linked = graph.both_ways(edges(spark, sf)).select(F.col("src").alias("vec_id"))
    return field(spark, sf).select(F.col("id").alias("vec_id")).join(linked, "vec_id", "left_anti").orderBy("vec_id").limit(40)


@query("inner_duplicates", NEAR + ", m AS (SELECT vec_id FROM u WHERE label IN (2, 3)) SELECT a, b, w FROM edges WHERE w >= 0.4::DOUBLE AND a IN (FROM m) AND b IN (FROM m)")
def inner_duplicates(spark, sf):
    """Heavy edges with both ends in a member set, by two semi joins."""
    m = field(spark, sf).where("label in (2, 3)").select("id")
    return edges(spark, sf).where("w >= 0.4").join(m.select(F.col("id").alias("a")), "a", "left_semi").join(m.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "w")


@query("one_hop", NEAR + ", l AS (SELECT a AS x, b AS y, w FROM edges UNION ALL SELECT b, a, w FROM edges) SELECT y AS node, max(w) AS w FROM l WHERE x < 20 AND w >= 0.35::DOUBLE GROUP BY 1")
def one_hop(spark, sf):
    seeds = field(spark, sf).where("id < 20").select(F.col("id").alias("node"))
    return graph.one_hop(seeds, edges(spark, sf), 0.35)


@query("connected_components", NEAR + ", l AS (SELECT a AS x, b AS y FROM mutual UNION ALL SELECT b, a FROM mutual), c AS (WITH RECURSIVE r(x, y) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x) SELECT x AS node, min(y) AS component FROM r GROUP BY 1) SELECT node, component FROM c")
def connected_components(spark, sf):
    return graph.components(field(spark, sf).select(F.col("id").alias("node")), mutual(spark, sf))


@query("modularity", NEAR + ", t AS (SELECT sum(w) AS m FROM mutual), i AS (SELECT x.label AS c, sum(w) AS inner_w FROM mutual JOIN u x ON x.vec_id = a JOIN u y ON y.vec_id = b WHERE x.label = y.label GROUP BY 1), l AS (SELECT a AS n, w FROM mutual UNION ALL SELECT b, w FROM mutual), k AS (SELECT label AS c, sum(w) AS k FROM l JOIN u ON vec_id = n GROUP BY 1) SELECT round(sum(coalesce(inner_w, 0) / m - (k / (2 * m)) * (k / (2 * m))), 6) AS modularity FROM k LEFT JOIN i USING (c), t")
def modularity(spark, sf):
    """Of the mutual edges under the partition by label."""
    m = field(spark, sf).select(F.col("id").alias("node"), F.col("label").cast("bigint").alias("community"))
    return graph.modularity(mutual(spark, sf), m)


@query("louvain_partition")
def louvain_partition(spark, sf):
    f = field(spark, sf).select(F.col("id").alias("node"))
    return graph.louvain(f, mutual(spark, sf))


@query("partition_consensus")
def partition_consensus(spark, sf, runs: int = 3):
    """Components of the edges on which runs with other seeds agree."""
    from fieldloom.session import materialise

    nodes = field(spark, sf).select(F.col("id").alias("node"))
    links = materialise(mutual(spark, sf), "mutual")
    runs_ = None
    for s in range(runs):
        one = graph.louvain(nodes, links, seed=s).withColumn("run", F.lit(s))
        runs_ = one if runs_ is None else runs_.unionByName(one)
    return graph.consensus(nodes, links, runs_)


CENT = U + ", x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM u), m AS (SELECT label, dim, avg(x) AS x FROM x GROUP BY ALL), z AS (SELECT label, sqrt(sum(x * x)) + 1e-9::DOUBLE AS n FROM m GROUP BY 1), cent AS (SELECT label, list(x / n ORDER BY dim) AS v FROM m JOIN z USING (label) GROUP BY 1), nc AS (SELECT vec_id, label, c, w FROM (SELECT u.vec_id, u.label, cent.label AS c, round(list_inner_product(u.v, cent.v), 6) AS w, row_number() OVER (PARTITION BY u.vec_id ORDER BY round(list_inner_product(u.v, cent.v), 6) DESC, cent.label) AS r FROM u, cent) WHERE r = 1)"


def label_centroids(spark, sf) -> DataFrame:
    return P.mean_vectors(field(spark, sf), "label", "v").select(F.col("label").cast("bigint").alias("community"), "centroid", "n")


@query("centroids", CENT + ", k AS (SELECT label, count(*) AS n FROM u GROUP BY 1) SELECT label::BIGINT AS community, (dim - 1)::INT AS dim, round(x / z.n, 6) AS x, k.n FROM m JOIN z USING (label) JOIN k USING (label)")
def centroids(spark, sf):
    return label_centroids(spark, sf).select("community", F.posexplode("centroid").alias("dim", "x"), "n").select("community", "dim", F.round("x", 6).alias("x"), "n")


def nearest_label(spark, sf):
    return P.nearest_centroid(field(spark, sf), label_centroids(spark, sf), "id")


@query("nearest_centroid", CENT + " SELECT vec_id AS id, c::BIGINT AS community, w FROM nc")
def nearest_centroid(spark, sf):
    return nearest_label(spark, sf)


@query("drift", CENT + " SELECT round(avg((c <> label)::INT::DOUBLE), 6) AS drift FROM nc")
def drift(spark, sf):
    return P.drift(field(spark, sf).select("id", F.col("label").cast("bigint").alias("community")), nearest_label(spark, sf), "id")


@query("ari", CENT + ", p AS (SELECT label AS x, c AS y FROM nc), n AS (SELECT x, y, count(*) AS n FROM p GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS idx, sum(n) AS t FROM n), a AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM n GROUP BY x)), b AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM n GROUP BY y)) SELECT round((idx - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM i, a, b")
def ari(spark, sf):
    pairs = field(spark, sf).select("id", F.col("label").alias("x")).join(nearest_label(spark, sf).select("id", F.col("community").alias("y")), "id")
    return P.adjusted_rand(pairs)


VERSIONS = "WITH m AS (SELECT partition_version, chunk_id, min(community_of) AS c FROM memberships WHERE community_of IS NOT NULL GROUP BY ALL), p AS (SELECT a.c AS before, b.c AS after FROM m a JOIN m b USING (chunk_id) WHERE a.partition_version = 1 AND b.partition_version = 2)"


def versions(spark, sf):
    """(before, after): communities of each chunk in the two frozen partitions; repeated rows count once, by the smallest."""
    m = table(spark, sf, "memberships").where("community_of is not null").groupBy("partition_version", "chunk_id").agg(F.min("community_of").alias("c"))
    return m.where("partition_version = 1").select("chunk_id", F.col("c").alias("before")).join(m.where("partition_version = 2").select("chunk_id", F.col("c").alias("after")), "chunk_id")


@query("moved_share", VERSIONS + ", n AS (SELECT before, after, count(*) AS n FROM p GROUP BY ALL), best AS (SELECT after, before AS maps_to FROM (SELECT *, row_number() OVER (PARTITION BY after ORDER BY n DESC, before) AS r FROM n) WHERE r = 1) SELECT round(sum(CASE WHEN maps_to <> before THEN n ELSE 0 END) / sum(n), 6) AS moved FROM n JOIN best USING (after)")
def moved_share(spark, sf):
    return P.moved_share(versions(spark, sf))


@query("version_map", VERSIONS + ", n AS (SELECT before, after, count(*) AS n FROM p GROUP BY ALL) SELECT after, before AS maps_to, n FROM (SELECT *, row_number() OVER (PARTITION BY after ORDER BY n DESC, before) AS r FROM n) WHERE r = 1")
def version_map(spark, sf):
    """Old community of each new one: the largest overlap."""
    n = versions(spark, sf).groupBy("before", "after").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("after").orderBy(F.desc("n"), "before"))).where("r = 1").select("after", F.col("before").alias("maps_to"), "n")


@query("partition_ari", VERSIONS + ", n AS (SELECT before AS x, after AS y, count(*) AS n FROM p GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS idx, sum(n) AS t FROM n), a AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM n GROUP BY x)), b AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM n GROUP BY y)) SELECT round((idx - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM i, a, b")
def partition_ari(spark, sf):
    return P.adjusted_rand(versions(spark, sf).select(F.col("before").alias("x"), F.col("after").alias("y")))


FOLD = NEAR + """, l AS (SELECT a AS x, b AS y FROM mutual UNION ALL SELECT b, a FROM mutual), comp AS (WITH RECURSIVE r(x, y) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x) SELECT x AS id, min(y) AS k FROM r GROUP BY 1),
sz AS (SELECT k, count(*) AS n FROM comp GROUP BY 1), kept AS (SELECT k FROM sz WHERE n >= 3 OR (k = (SELECT k FROM sz ORDER BY n DESC, k LIMIT 1) AND (SELECT max(n) FROM sz) < 3)), x AS (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM comp JOIN kept USING (k) JOIN u ON vec_id = id), a AS (SELECT k, dim, avg(x) AS x FROM x GROUP BY ALL),
z AS (SELECT k, sqrt(sum(x * x)) + 1e-9::DOUBLE AS n FROM a GROUP BY 1), cent AS (SELECT k, list(x / n ORDER BY dim) AS v FROM a JOIN z USING (k) GROUP BY 1), near AS (SELECT id, cent.k, row_number() OVER (PARTITION BY id ORDER BY round(list_inner_product(u.v, cent.v), 6) DESC, cent.k) AS r FROM comp JOIN u ON vec_id = id, cent WHERE comp.k NOT IN (FROM kept))
SELECT id, k AS community FROM comp WHERE k IN (FROM kept) UNION ALL SELECT id, k FROM near WHERE r = 1"""


@query("fold_small", FOLD)
def fold_small(spark, sf):
    """Components below three members folded into the nearest larger one."""
    f = field(spark, sf)
    comp = graph.components(f.select(F.col("id").alias("node")), mutual(spark, sf)).select(F.col("node").alias("id"), F.col("component").alias("community"))
    return P.fold_small(f, comp, "id", "v")


CAPPED = U + """, cut AS (SELECT floor(count(DISTINCT doc) * 0.8::DOUBLE) AS cut FROM u), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM u, cut WHERE doc < cut), a AS (SELECT label, dim, avg(x) AS x FROM x GROUP BY ALL), z AS (SELECT label, sqrt(sum(x * x)) + 1e-9::DOUBLE AS n FROM a GROUP BY 1),
k AS (SELECT label, count(*) AS n FROM u, cut WHERE doc < cut GROUP BY 1), cent AS (SELECT label, list(x / z.n ORDER BY dim) AS v FROM a JOIN z USING (label) GROUP BY 1), names AS (SELECT label, v, k.n, row_number() OVER (ORDER BY label) AS c FROM cent JOIN k USING (label)), cap AS (SELECT greatest(1, floor(2 * avg(n)))::BIGINT AS cap FROM names),
prefs AS (SELECT vec_id, list(c ORDER BY round(list_inner_product(u.v, names.v), 6) DESC, names.label) AS p FROM u, cut, names WHERE doc >= cut GROUP BY 1), nw AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS i FROM prefs),
rec AS (WITH RECURSIVE rec(i, rooms, vec_id, pick) AS (SELECT 0::BIGINT, (SELECT list(greatest(cap - n, 0) ORDER BY c) FROM names, cap), NULL::BIGINT, NULL::BIGINT UNION ALL SELECT i, list_transform(rooms, lambda room, j: CASE WHEN j = pick THEN room - 1 ELSE room END), vec_id, pick FROM (SELECT nw.i, r.rooms, nw.vec_id, list_filter(nw.p, lambda c: r.rooms[c] > 0)[1] AS pick FROM rec r JOIN nw ON nw.i = r.i + 1)) SELECT vec_id, pick FROM rec WHERE i > 0)
SELECT vec_id AS id, coalesce(label, -1)::BIGINT AS community FROM rec LEFT JOIN names ON c = pick"""


@query("assign_capped", CAPPED)
def assign_capped(spark, sf):
    """Vectors of the later documents join the frozen communities of the earlier ones, each up to twice the mean size."""
    f = field(spark, sf)
    cut = f.agg(F.floor(F.count_distinct("grp") * 0.8)).first()[0]
    base = P.mean_vectors(f.where(F.col("grp") < cut), "label", "v").select(F.col("label").cast("bigint").alias("community"), "centroid", "n")
    return P.assign_capped(f.where(F.col("grp") >= cut), base, "id", "v")


CURVE = U + ", s AS (SELECT a.vec_id, a.doc, max(round(list_inner_product(a.v, b.v), 6)) AS best FROM u a JOIN u b ON b.doc < a.doc GROUP BY ALL), curve AS (SELECT doc, avg(1 - best) AS residual, avg((best >= 0.45::DOUBLE)::INT::DOUBLE) AS retelling_share, count(*) AS n_chunks FROM s GROUP BY 1)"


def curve(spark, sf) -> DataFrame:
    return S.residual_curve(field(spark, sf).select("id", "grp", "pos", "v"), 0.45)


@query("residual_curve", CURVE + " SELECT doc, round(residual + 1e-9::DOUBLE, 6) AS residual, round(retelling_share, 6) AS retelling_share, n_chunks FROM curve")
def residual_curve(spark, sf):
    return curve(spark, sf).select(F.col("grp").alias("doc"), F.round(F.col("residual") + 1e-9, 6).alias("residual"), F.round("retelling_share", 6).alias("retelling_share"), "n_chunks")


DEC = CURVE + ", o AS (SELECT *, row_number() OVER (ORDER BY doc) - 1 AS i, count(*) OVER () AS n FROM curve), dec AS (SELECT (ceil((i + 1) * 10 / n::DOUBLE) - 1)::INT AS decile, avg(residual) AS residual, avg(retelling_share) AS retelling_share FROM o GROUP BY 1)"


@query("residual_deciles", DEC + " SELECT decile, round(residual, 6) AS residual, round(retelling_share, 6) AS retelling_share FROM dec")
def residual_deciles(spark, sf):
    return S.deciles(curve(spark, sf)).select("decile", F.round("residual", 6).alias("residual"), F.round("retelling_share", 6).alias("retelling_share"))


SHUF = DEC + ", k AS (SELECT DISTINCT doc FROM u), ord AS (SELECT t.s, doc, row_number() OVER (PARTITION BY t.s ORDER BY md5(t.s || '-' || doc), doc) AS pos FROM k, (SELECT unnest([0, 1, 2]) AS s) t), sb AS (SELECT x.s, a.vec_id, a.doc, x.pos, max(round(list_inner_product(a.v, b.v), 6)) AS best FROM u a JOIN ord x ON x.doc = a.doc JOIN ord y ON y.s = x.s AND y.pos < x.pos JOIN u b ON b.doc = y.doc GROUP BY ALL), sc AS (SELECT s, doc, pos, avg(1 - best) AS residual FROM sb GROUP BY ALL), so AS (SELECT s, residual, row_number() OVER (PARTITION BY s ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM sc), sd AS (SELECT s, (ceil((i + 1) * 10 / n::DOUBLE) - 1)::INT AS decile, avg(residual) AS residual FROM so GROUP BY ALL), sh AS (SELECT decile, avg(residual) AS shuffled FROM sd GROUP BY 1)"


def shuffled_deciles(spark, sf, shuffles: int = 3) -> DataFrame:
    """Mean decile residuals over orders of the documents by md5(seed-document)."""
    f, out = field(spark, sf), None
    docs = f.select("grp").distinct()
    for s in range(shuffles):
        order = S.running(docs, [F.md5(F.concat(F.lit(f"{s}-"), F.col("grp").cast("string"))), "grp"], "pos")
        one = S.deciles(S.residual_curve(f.drop("pos").join(order, "grp").select("id", "grp", "pos", "v"), 0.45)).withColumn("s", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("decile").agg(F.avg("residual").alias("shuffled"))


@query("shuffle_deciles", SHUF + " SELECT decile, round(shuffled, 6) AS shuffled FROM sh")
def shuffle_deciles(spark, sf):
    return shuffled_deciles(spark, sf).select("decile", F.round("shuffled", 6).alias("shuffled"))


@query("advantage", SHUF + " SELECT decile, round((shuffled - residual) / shuffled, 6) AS advantage FROM dec JOIN sh USING (decile)")
def advantage(spark, sf):
    """How much lower the residual is in arrival order than shuffled, per decile."""
    return S.deciles(curve(spark, sf)).join(shuffled_deciles(spark, sf), "decile").select("decile", F.round(F.try_divide(F.col("shuffled") - F.col("residual"), F.col("shuffled")), 6).alias("advantage"))


@query("residual_quantiles", CURVE + " SELECT round(quantile_cont(residual, 0.1), 6) AS q10, round(quantile_cont(residual, 0.5), 6) AS q50, round(quantile_cont(residual, 0.9), 6) AS q90 FROM curve")
def residual_quantiles(spark, sf):
    q = lambda p: F.round(F.percentile("residual", F.lit(p)), 6)
    return curve(spark, sf).agg(q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90"))


Z = "WITH d AS (SELECT doc_id, min(arrival_pos) AS pos, avg(residual) AS residual FROM doc_scores WHERE residual IS NOT NULL AND arrival_pos IS NOT NULL GROUP BY 1), o AS (SELECT residual, (row_number() OVER (ORDER BY pos, doc_id) - 1)::INT AS i FROM d), f AS (SELECT *, avg(residual) OVER a AS ma, avg(residual) OVER p AS mp, stddev_pop(residual) OVER p AS sd, count(*) OVER a AS ca, count(*) OVER p AS cp FROM o WINDOW a AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), p AS (ORDER BY i ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)), z AS (SELECT i, residual, CASE WHEN ca = 8 AND cp = 40 THEN CASE WHEN sd > 1e-9::DOUBLE THEN round((ma - mp) / sd, 9) ELSE 0 END END AS z FROM f)"


def stored_scores(spark, sf) -> DataFrame:
    """(i, residual) of the stored document scores in arrival order; repeated rows are averaged, null ones left out."""
    d = table(spark, sf, "doc_scores").where("residual is not null and arrival_pos is not null").groupBy("doc_id").agg(F.min("arrival_pos").alias("pos"), F.avg("residual").alias("residual"))
    return S.running(d, ["pos", "doc_id"], "i").select("residual", "i")


@query("front_z", Z + " SELECT i, round(z, 6) AS z FROM z")
def front_z(spark, sf):
    return S.front_z(stored_scores(spark, sf)).select("i", F.round("z", 6).alias("z"))


FRONTS = Z + ", s AS (SELECT *, coalesce(last_value(CASE WHEN z > 1 THEN 1 WHEN z <= 0 THEN 0 END IGNORE NULLS) OVER (ORDER BY i), 0) AS st FROM z WHERE z IS NOT NULL), w AS (SELECT *, coalesce(lag(st) OVER (ORDER BY i), 0) AS was FROM s), g AS (SELECT *, sum(CASE WHEN st = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (ORDER BY i) AS isl FROM w)"


@query("fronts", FRONTS + " SELECT min(i) AS opened_at, max(CASE WHEN st = 0 THEN i END) AS closed_at, round(max(z), 6) AS peak_z, round(max(residual), 6) AS peak_residual, count(*) AS n_documents, coalesce(max(CASE WHEN st = 0 THEN i END) - min(i) + 1, 1) AS length FROM g WHERE st = 1 OR was = 1 GROUP BY isl")
def fronts(spark, sf):
    found = S.fronts(S.front_z(stored_scores(spark, sf)))
    return found.withColumn("peak_z", F.round("peak_z", 6)).withColumn("peak_residual", F.round("peak_residual", 6))


@query("central_chunks", CENT + " SELECT c AS community, vec_id, w, r FROM (SELECT u.label::BIGINT AS c, u.vec_id, round(list_inner_product(u.v, cent.v), 6) AS w, row_number() OVER (PARTITION BY u.label ORDER BY round(list_inner_product(u.v, cent.v), 6) DESC, u.vec_id)::INT AS r FROM u JOIN cent USING (label)) WHERE r <= 6")
def central_chunks(spark, sf):
    """The six vectors nearest to each lane's normalised mean."""
    scored = field(spark, sf).join(F.broadcast(label_centroids(spark, sf)), F.col("label") == F.col("community")).withColumn("w", F.round(V.dot(F.col("v"), F.col("centroid")), 6))
    r = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("w"), "id"))
    return scored.withColumn("r", r).where("r <= 6").select("community", F.col("id").alias("vec_id"), "w", "r")


@query("viewer_neighbours", BR + ", e AS (SELECT coalesce(e.a, br.a) AS a, coalesce(e.b, br.b) AS b, coalesce(e.w, br.w) AS w, br.a IS NOT NULL AS bridge FROM edges e FULL OUTER JOIN br ON e.a = br.a AND e.b = br.b), l AS (SELECT a AS node, b AS nbr, w, bridge FROM e UNION ALL SELECT b, a, w, bridge FROM e) SELECT node, nbr, w, bridge FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY bridge DESC, w DESC, nbr) AS r FROM l) WHERE r <= 14")
def viewer_neighbours(spark, sf):
    """Up to 14 neighbours of a node: bridges first, then by weight."""
    e = bridge_merge(spark, sf)
    both = e.select(F.col("a").alias("node"), F.col("b").alias("nbr"), "w", "bridge").unionAll(e.select(F.col("b"), F.col("a"), "w", "bridge"))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("bridge"), F.desc("w"), "nbr"))).where("r <= 14").drop("r")


@query("rank_flow", NEAR + """, l AS (SELECT a AS x, b AS y, w FROM edges UNION ALL SELECT b, a, w FROM edges), o AS (SELECT x, sum(w) AS o, count(*) AS deg FROM l GROUP BY 1), m0 AS (SELECT vec_id AS node, 1::DOUBLE AS mass FROM u WHERE vec_id < 5),
m1 AS (SELECT node, sum(mass) AS mass FROM (SELECT y AS node, sum(m.mass * w / o / ln(2.718281828459045::DOUBLE + deg)) * 0.85::DOUBLE AS mass FROM l JOIN m0 m ON m.node = l.x JOIN o USING (x) GROUP BY 1 UNION ALL SELECT node, mass * 0.15::DOUBLE FROM m0) GROUP BY 1),
m2 AS (SELECT node, sum(mass) AS mass FROM (SELECT y AS node, sum(m.mass * w / o / ln(2.718281828459045::DOUBLE + deg)) * 0.85::DOUBLE AS mass FROM l JOIN m1 m ON m.node = l.x JOIN o USING (x) GROUP BY 1 UNION ALL SELECT node, mass * 0.15::DOUBLE FROM m0) GROUP BY 1) SELECT node, round(mass, 6) AS mass FROM m2""")
def rank_flow(spark, sf):
    """Two hops of personalised PageRank with damped hubs."""
    seeds = field(spark, sf).where("id < 5").select(F.col("id").alias("node"), F.lit(1.0).alias("mass"))
    return graph.rank_flow(seeds, edges(spark, sf), hops=2).select("node", F.round("mass", 6).alias("mass"))


@query("poincare", U + " SELECT vec_id, round(v[1] / (1 + sqrt(1 + v[1] * v[1] + v[2] * v[2] + v[3] * v[3])) * 300, 6) AS x, round(v[2] / (1 + sqrt(1 + v[1] * v[1] + v[2] * v[2] + v[3] * v[3])) * 300, 6) AS y, round(v[3] / (1 + sqrt(1 + v[1] * v[1] + v[2] * v[2] + v[3] * v[3])) * 300, 6) AS z FROM u")
def poincare(spark, sf):
    """Three coordinates from the hyperboloid into the ball of radius 300: H / (1 + sqrt(1 + |H|^2))."""
    f = field(spark, sf)
    h = [F.element_at("v", i) for i in (1, 2, 3)]
    scale = 1 + F.sqrt(1 + h[0] * h[0] + h[1] * h[1] + h[2] * h[2])
    return f.select(F.col("id").alias("vec_id"), *[F.round(c / scale * 300, 6).alias(n) for c, n in zip(h, "xyz")])


@query("lorentz_levels", "SELECT level, round(ln(b) * level, 6) AS radius, round(tanh(ln(b) * level / 2), 6) AS rho FROM (SELECT unnest([0, 1, 2, 3]) AS level, 8::DOUBLE AS b)")
def lorentz_levels(spark, sf):
    """Radii of the levels of a tree of branching 8, and their place in the ball."""
    r = F.log(F.lit(8.0)) * F.col("id")
    return spark.range(4).select(F.col("id").cast("int").alias("level"), F.round(r, 6).alias("radius"), F.round(F.tanh(r / 2), 6).alias("rho"))
