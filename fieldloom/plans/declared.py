"""Queries for what the reference only declares or specifies, and for digests and stability."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fieldloom.functions import vectors as V
from fieldloom.operators import graph, knn, partitions as P
from fieldloom.plans import field, texts
from fieldloom.plans.registry import query
from fieldloom.session import materialise
from fieldloom.sources import files
from fieldloom.sources.tables import table


@query("scan_digest", f"WITH q AS (SELECT vec_id, {field.Q0} AS v FROM embeddings), s AS (SELECT q.vec_id, list_inner_product(q.v, z.v)::BIGINT AS score FROM q, (SELECT v FROM q WHERE vec_id = 0) z), t AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 100) SELECT md5(string_agg(vec_id || ':' || score, ',' ORDER BY score DESC, vec_id)) AS digest FROM t")
def scan_digest(spark, sf):
    """One digest of the ordered hits of a scan: equal in any session and on any partitioning."""
    q = table(spark, sf, "embeddings").select("vec_id", V.quantise(F.col("embedding")).alias("v"))
    top = knn.scan(q, q.where("vec_id = 0").select(F.col("v").alias("query")), V.int_dot(F.col("v"), F.col("query")), 100, "vec_id")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))
    return top.agg(F.md5(F.array_join(F.transform(rows, lambda r: F.concat(r.vec_id.cast("string"), F.lit(":"), (-r.s).cast("string"))), ",")).alias("digest"))


PLACED = "WITH p AS (SELECT DISTINCT chunk_id, lane, residual::DOUBLE AS r, placed_at FROM placements WHERE residual IS NOT NULL AND lane IS NOT NULL AND placed_at IS NOT NULL), m AS (SELECT lane, avg(r) AS mean, stddev_pop(r) AS sd FROM p GROUP BY 1)"


@query("lane_cusum", PLACED + ", c AS (SELECT lane, chunk_id, placed_at, r, sum(r - mean - 0.5::DOUBLE * sd) OVER w AS c FROM p JOIN m USING (lane) WINDOW w AS (PARTITION BY lane ORDER BY placed_at, chunk_id, r ROWS UNBOUNDED PRECEDING)), s AS (SELECT lane, c - least(0, min(c) OVER (PARTITION BY lane ORDER BY placed_at, chunk_id, r ROWS UNBOUNDED PRECEDING)) AS s FROM c) SELECT lane, round(max(s), 6) AS peak FROM s GROUP BY 1")
def lane_cusum(spark, sf):
    """Largest one-sided cumulative sum of each lane's residuals: the running sum over its running minimum."""
    p = texts.placed(spark, sf).withColumn("r", F.col("residual").cast("double"))
    m = p.groupBy("lane").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))
    w = Window.partitionBy("lane").orderBy("placed_at", "chunk_id", "r").rowsBetween(Window.unboundedPreceding, 0)
    c = p.join(F.broadcast(m), "lane").withColumn("c", F.sum(F.col("r") - F.col("mean") - 0.5 * F.col("sd")).over(w))
    return c.withColumn("s", F.col("c") - F.least(F.lit(0.0), F.min("c").over(w))).groupBy("lane").agg(F.round(F.max("s"), 6).alias("peak"))


@query("habituation", texts.LANES + " SELECT lane, round(1 / greatest(ema, 1e-6::DOUBLE), 4) AS weight FROM ema")
def habituation(spark, sf):
    """The inverse of each lane's volatility."""
    return texts.lane_state(spark, sf).select("lane", F.round(1 / F.greatest("ema", F.lit(1e-6)), 4).alias("weight"))


@query("retelling_trough", "WITH b AS (SELECT (floor((1 - residual::DOUBLE) * 20))::INT AS bin, count(*) AS n FROM placements WHERE residual IS NOT NULL GROUP BY 1), k AS (SELECT unnest(range(10, 20))::INT AS bin), f AS (SELECT k.bin, coalesce(n, 0) AS n FROM k LEFT JOIN b USING (bin)) SELECT bin / 20::DOUBLE AS cosine, n FROM f ORDER BY n, bin DESC LIMIT 1")
def retelling_trough(spark, sf):
    """The emptiest twentieth of the best cosine from .5 on, the highest on ties: where retellings part from the rest."""
    bins = table(spark, sf, "placements").where("residual is not null").groupBy(F.floor((1 - F.col("residual").cast("double")) * 20).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(10, 20).select(F.col("id").cast("int").alias("bin"))
    return every.join(bins, "bin", "left").select((F.col("bin") / 20.0).alias("cosine"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("n", F.desc("cosine")).limit(1)


@query("lorentz_radii", "WITH c AS (SELECT partition_version AS v, community_of AS k, max(sizes)::DOUBLE AS n FROM centroids WHERE sizes > 0 GROUP BY ALL), m AS (SELECT v, avg(n) AS mean FROM c GROUP BY 1) SELECT v, k, round(ln(8::DOUBLE) - least(greatest(0.5::DOUBLE * ln(n / mean), -ln(8::DOUBLE) / 2), ln(8::DOUBLE) / 2), 6) AS radius FROM c JOIN m USING (v)")
def lorentz_radii(spark, sf):
    """Radius of each community: one level, larger ones further in, by at most half a level."""
    c = table(spark, sf, "centroids").where("sizes > 0").groupBy(F.col("partition_version").alias("v"), F.col("community_of").alias("k")).agg(F.max("sizes").cast("double").alias("n"))
    level = F.log(F.lit(8.0))
    shift = 0.5 * F.log(F.col("n") / F.avg("n").over(Window.partitionBy("v")))
    return c.select("v", "k", F.round(level - F.least(F.greatest(shift, -level / 2), level / 2), 6).alias("radius"))


@query("co_classification", field.NEAR + " SELECT round(avg(((x.label % 2 = y.label % 2)::INT + (x.label % 3 = y.label % 3)::INT) / 2::DOUBLE), 6) AS agreement, count(*) AS edges FROM mutual JOIN u x ON x.vec_id = a JOIN u y ON y.vec_id = b")
def co_classification(spark, sf):
    """Mean agreement of two labellings (label modulo 2 and 3) on the mutual edges: existing edges only, never all pairs."""
    f = field.field(spark, sf)
    runs = None
    for run, k in enumerate((2, 3)):
        one = f.select(F.lit(run).alias("run"), F.col("id").alias("node"), (F.col("label") % k).alias("community"))
        runs = one if runs is None else runs.unionByName(one)
    return graph.agreement(field.mutual(spark, sf), runs).agg(F.round(F.avg("agree"), 6).alias("agreement"), F.count("*").alias("edges"))


@query("seed_stability")
def seed_stability(spark, sf):
    """ARI of partitions with other seeds against the first."""
    nodes, links = field.field(spark, sf).select(F.col("id").alias("node")), materialise(field.mutual(spark, sf), "mutual")
    first = materialise(graph.louvain(nodes, links, seed=0), "first").select("node", F.col("community").alias("x"))
    out = None
    for s in (1, 2):
        pairs = first.join(graph.louvain(nodes, links, seed=s).select("node", F.col("community").alias("y")), "node")
        one = P.adjusted_rand(pairs).withColumn("seed", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


@query("selftest_digest")
def selftest_digest(spark, sf, seed: int = 20260903, n: int = 20_000, dim: int = 256, head: int = 64):
    """Digest of a two-pass scan over synthetic vectors, which a seed gives alike on any machine: coarse top 512, fine top 32."""
    vectors = lambda rows, width, k: files.synthetic_i8(spark, rows, width, seed + k)
    one = lambda width, k: vectors(1, width, k).select(F.col("v").alias("query"))
    hits = knn.two_pass(vectors(n, head, 1), vectors(n, dim, 2), one(head, 3), one(dim, 4), V.int_dot(F.col("v"), F.col("query")), 512, 32)
    rows = [(r.id, r.score) for r in hits.orderBy(F.desc("score"), "id").collect()]  # 32 rows
    return spark.createDataFrame([(seed, len(rows), knn.digest(rows))], "seed bigint, hits int, digest string")
