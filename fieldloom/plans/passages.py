"""Queries over the passages' own vectors (chunks.vec): links, bridges, residuals, placement of new documents, dossiers, reports.

A passage takes part if its vector is usable; its community is that of the stored partition version 2 (the smallest of several,
none if it overflowed). Ties go to the smaller chunk_id. Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fieldloom.functions import text as T, vectors as V
from fieldloom.operators import blocks, graph, knn, partitions as P, series as S, tape
from fieldloom.plans import texts
from fieldloom.plans.field import GOOD
from fieldloom.plans.registry import query
from fieldloom.session import materialise
from fieldloom.sources.tables import table

NEAR, DUPLICATE, BRIDGE, HOP, TOPIC = 0.60, 0.97, 0.62, 0.65, "ledger"

C = f"""WITH c0 AS (SELECT chunk_id, doc_id, lane, heading, n_tokens, doc_date, list_transform(vec, lambda x: x::DOUBLE) AS v0 FROM chunks WHERE {GOOD}),
c AS (SELECT chunk_id, doc_id, lane, heading, n_tokens, doc_date, list_transform(v0, lambda x: x / (sqrt(list_inner_product(v0, v0)) + 1e-9::DOUBLE)) AS v FROM c0),
m AS (SELECT chunk_id, min(community_of) AS com FROM memberships WHERE partition_version = 2 AND community_of >= 0 GROUP BY 1)"""
E = C + """, s AS (SELECT a.chunk_id AS q, b.chunk_id AS nbr, round(list_inner_product(a.v, b.v), 6) AS w FROM c a JOIN c b ON a.doc_id <> b.doc_id),
e AS (SELECT least(q, nbr) AS a, greatest(q, nbr) AS b, max(w) AS w FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY w DESC, nbr) AS r FROM s WHERE w >= 0.6::DOUBLE) WHERE r <= 3 GROUP BY ALL),
br AS (SELECT q AS a, nbr AS b, w FROM s JOIN m x ON x.chunk_id = q JOIN m y ON y.chunk_id = nbr WHERE q < nbr AND w >= 0.62::DOUBLE AND w < 0.97::DOUBLE AND x.com <> y.com ORDER BY w DESC, a DESC, b DESC LIMIT 160)"""


def rows(spark, sf) -> DataFrame:
    """(id, grp document, v, raw before it was normalised, lane, heading, tokens, day) of the usable passages."""
    c = table(spark, sf, "chunks").where(V.usable(F.col("vec"), 64))
    return c.select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("grp"), V.normalise(F.col("vec")).alias("v"), F.col("vec").alias("raw"), "lane", "heading", F.col("n_tokens").alias("tokens"), F.col("doc_date").alias("day"))


def side(df: DataFrame, pos=None) -> DataFrame:
    return df.select("id", "grp", (F.lit(0) if pos is None else pos).cast("bigint").alias("pos"), "raw", *["dim"] * ("dim" in df.columns))


def packed(r: DataFrame) -> DataFrame:
    """(id, grp, raw as bytes, dim): a join sends these, not arrays of floats."""
    return blocks.pack(r.select("id", "grp", "raw"), "raw")


def communities(spark, sf) -> DataFrame:
    """(id, com): the stored community of each passage that has one."""
    m = table(spark, sf, "memberships").where("partition_version = 2 and community_of >= 0")
    return m.groupBy(F.col("chunk_id").alias("id")).agg(F.min("community_of").alias("com"))


def edges(spark, sf) -> DataFrame:
    r = side(rows(spark, sf))
    return knn.either_lists(knn.block_topk(r, r, 3, NEAR))


def bridge_pairs(spark, sf) -> DataFrame:
    r = packed(rows(spark, sf)).join(communities(spark, sf), "id").select("id", "grp", F.col("com").cast("bigint").alias("label"), "raw", "dim")
    return knn.band_pairs(r, BRIDGE, DUPLICATE, 160)


@query("passage_links", E + " SELECT a, b, CASE WHEN w >= 0.97::DOUBLE THEN 'dup' ELSE 'sem' END AS slice, w FROM e")
def passage_links(spark, sf):
    """Links between passages of different documents, kept if either end lists the other among its three nearest: dup from .97 on, else sem."""
    return edges(spark, sf).select("a", "b", F.when(F.col("w") >= DUPLICATE, "dup").otherwise("sem").alias("slice"), "w")


@query("passage_bridges", E + " SELECT a, b, w FROM br")
def passage_bridges(spark, sf):
    """Pairs of different documents and communities at .62 <= w < .97: the strongest 160."""
    return bridge_pairs(spark, sf)


R = C + """, d AS (SELECT doc_id, row_number() OVER (ORDER BY when_s, doc_id) - 1 AS pos FROM documents WHERE when_s IS NOT NULL), p AS (SELECT c.chunk_id, c.doc_id, d.pos, c.v FROM c JOIN d USING (doc_id)),
b AS (SELECT a.chunk_id, a.doc_id, a.pos, max(round(list_inner_product(a.v, b.v), 6)) AS best FROM p a JOIN p b ON b.pos < a.pos GROUP BY ALL),
r AS (SELECT doc_id, pos, avg(1 - best) AS residual, avg((best >= 0.97::DOUBLE)::INT::DOUBLE) AS share, count(*) AS n FROM b GROUP BY ALL)"""


def curve(spark, sf) -> DataFrame:
    """Residual curve (grp, pos, residual, retelling_share, n_chunks) of the dated documents in arrival order."""
    order = S.arrival(table(spark, sf, "documents").select("doc_id", "when_s"), "when_s", "doc_id").select(F.col("doc_id").alias("grp"), "pos")
    r = rows(spark, sf)
    return S.residual_curve(side(packed(r).join(order, "grp"), F.col("pos")), DUPLICATE, r.select("id", "grp").join(order, "grp"))


@query("passage_residuals", R + " SELECT doc_id, round(residual + 1e-9::DOUBLE, 6) AS residual, round(share, 6) AS retelling_share, n AS n_chunks FROM r")
def passage_residuals(spark, sf):
    """Residual and retelling share of each document against its past only, over whole passages."""
    return curve(spark, sf).select(F.col("grp").alias("doc_id"), F.round(F.col("residual") + 1e-9, 6).alias("residual"), F.round("retelling_share", 6).alias("retelling_share"), "n_chunks")


@query("report", R + " SELECT (SELECT count(*) FROM documents WHERE when_s IS NOT NULL) AS documents, (SELECT count(*) FROM c) AS passages, count(*) AS scored, round(quantile_cont(residual, 0.1) + 1e-9::DOUBLE, 5) AS q10, round(quantile_cont(residual, 0.5) + 1e-9::DOUBLE, 5) AS q50, round(quantile_cont(residual, 0.9) + 1e-9::DOUBLE, 5) AS q90 FROM r")
def report(spark, sf):
    """One row: dated documents, usable passages, scored documents and the quantiles of their residuals."""
    q = lambda p: F.round(F.percentile("residual", F.lit(p)) + 1e-9, 5)
    one = curve(spark, sf).agg(F.count("*").alias("scored"), q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90"))
    docs = table(spark, sf, "documents").where("when_s is not null").agg(F.count("*").alias("documents"))
    return docs.join(rows(spark, sf).agg(F.count("*").alias("passages"))).join(one)  # three one-row tables


PLACED = C + f""", d AS (SELECT doc_id, batch_no, source FROM documents WHERE batch_no IS NOT NULL), n AS (SELECT c.*, d.source FROM c JOIN d USING (doc_id) WHERE batch_no = 8), o AS (SELECT c.* FROM c JOIN d USING (doc_id) WHERE batch_no < 8),
k AS (SELECT * FROM (SELECT n.chunk_id, n.doc_id, n.source, o.chunk_id AS nbr, round(list_inner_product(n.v, o.v), 6) AS w, row_number() OVER (PARTITION BY n.chunk_id ORDER BY round(list_inner_product(n.v, o.v), 6) DESC, o.chunk_id) AS r FROM n, o) WHERE r <= 5),
h AS (SELECT k.*, coalesce(com, -1) AS com FROM k LEFT JOIN m ON m.chunk_id = k.nbr), g AS (SELECT chunk_id, doc_id, source, com, count(*)::DOUBLE AS n, max(w) AS w, count(*) FILTER (WHERE w >= 0.62::DOUBLE) AS near FROM h GROUP BY ALL),
pp AS (SELECT chunk_id, doc_id, source, 1 - max(w) AS residual, 0::DOUBLE - sum(n / t * ln(n / t)) AS entropy, count(*) FILTER (WHERE near > 0) AS joins FROM g JOIN (SELECT chunk_id, count(*)::DOUBLE AS t FROM h GROUP BY 1) USING (chunk_id) GROUP BY ALL),
dd AS (SELECT doc_id, source, avg(residual) AS residual, max(residual) AS top, avg(residual * residual) AS r2, count(*) AS n_chunks, count(*) FILTER (WHERE joins > 1) AS bridges FROM pp GROUP BY ALL), {texts.LANES.replace("WITH p AS", "p AS")}"""


def placed_passages(spark, sf) -> DataFrame:
    """(id, grp, residual, entropy, joins) of the newest batch's passages against those of earlier batches."""
    batch = table(spark, sf, "documents").where("batch_no is not null").select(F.col("doc_id").alias("grp"), "batch_no")
    r = rows(spark, sf).select("id", "grp", "raw").join(batch, "grp")
    best = materialise(knn.block_topk(side(r.where("batch_no = 8")).withColumn("grp", F.lit(-1).cast("bigint")), side(r.where("batch_no < 8")).withColumn("grp", F.lit(-2).cast("bigint")), 5), "placed")
    hits = best.join(communities(spark, sf).withColumnRenamed("id", "nbr"), "nbr", "left").withColumn("com", F.coalesce("com", F.lit(-1)))
    per = hits.groupBy("q", "com").agg(F.count("*").alias("n"), F.max("w").alias("w"), F.count_if(F.col("w") >= BRIDGE).alias("near"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("q"))
    out = per.withColumn("p", p).groupBy(F.col("q").alias("id")).agg((1 - F.max("w")).alias("residual"), (F.lit(0.0) - F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.count_if(F.col("near") > 0).alias("joins"))
    return out.join(r.select("id", "grp"), "id")


@query("place_passages", PLACED + " SELECT chunk_id, round(residual, 6) AS residual, round(entropy + 1e-9::DOUBLE, 6) AS entropy, joins > 1 AS bridging FROM pp")
def place_passages(spark, sf):
    """Of each new passage its residual, the entropy of its five neighbours' communities, and whether it joins two of them at .62 or more."""
    return placed_passages(spark, sf).select(F.col("id").alias("chunk_id"), F.round("residual", 6).alias("residual"), F.round(F.col("entropy") + 1e-9, 6).alias("entropy"), (F.col("joins") > 1).alias("bridging"))


@query("place_documents", PLACED + """ SELECT doc_id, n_chunks, round(residual + 1e-9::DOUBLE, 6) AS residual, round(top, 6) AS residual_max, bridges, CASE WHEN round(residual + 1e-9::DOUBLE, 6) < 0.05::DOUBLE THEN 'RETELLING' WHEN round(residual + 1e-9::DOUBLE, 6) > 0.45::DOUBLE THEN 'NOVEL' WHEN bridges > 0 THEN 'BRIDGING' WHEN round(residual + 1e-9::DOUBLE, 6) < 0.30::DOUBLE THEN 'ROUTINE' ELSE 'RELATED' END AS verdict,
CASE WHEN ema > 0 THEN round(residual / sqrt(ema), 4) END AS priority, round(CASE WHEN ema IS NULL THEN r2 ELSE 0.9::DOUBLE * ema + 0.1::DOUBLE * r2 END, 6) AS ema_after FROM dd LEFT JOIN ema ON ema.lane = dd.source""")
def place_documents(spark, sf):
    """Verdict of each new document: mean residual, bridges, priority by the lane's volatility before it, and that volatility after it."""
    pp = placed_passages(spark, sf)
    per = pp.groupBy(F.col("grp").alias("doc_id")).agg(F.avg("residual").alias("mean"), F.max("residual").alias("top"), F.avg(F.col("residual") * F.col("residual")).alias("r2"), F.count("*").alias("n_chunks"), F.count_if(F.col("joins") > 1).alias("bridges"))
    lanes = texts.lane_state(spark, sf).select(F.col("lane").alias("source"), "ema")
    d = per.join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").join(F.broadcast(lanes), "source", "left")  # a row a lane
    residual = F.round(F.col("mean") + 1e-9, 6)
    after = F.when(F.col("ema").isNull(), F.col("r2")).otherwise(F.lit(0.9) * F.col("ema") + F.lit(0.1) * F.col("r2"))
    return d.select("doc_id", "n_chunks", residual.alias("residual"), F.round("top", 6).alias("residual_max"), "bridges", tape.verdict(residual, F.col("bridges") > 0).alias("verdict"), F.when(F.col("ema") > 0, F.round(F.col("mean") / F.sqrt("ema"), 4)).alias("priority"), F.round(after, 6).alias("ema_after"))


D = E + """, z AS (SELECT v FROM c WHERE regexp_matches(heading, '(?i)\\bledger\\b') ORDER BY chunk_id LIMIT 1), sim AS (SELECT chunk_id, round(list_inner_product(c.v, z.v), 6) AS sim FROM c, z),
seed AS (SELECT chunk_id FROM (SELECT * FROM sim WHERE sim > 0.5::DOUBLE ORDER BY sim DESC, chunk_id LIMIT 40) UNION SELECT chunk_id FROM c WHERE regexp_matches(heading, '(?i)\\bledger\\b')),
l AS (SELECT a AS x, b AS y, w FROM e UNION ALL SELECT b, a, w FROM e), mem AS (SELECT chunk_id FROM seed UNION SELECT y FROM l JOIN seed ON x = chunk_id WHERE w >= 0.65::DOUBLE AND w < 0.97::DOUBLE),
age AS (SELECT chunk_id, coalesce(doc_date, '9999') AS day FROM c JOIN mem USING (chunk_id)), later AS (SELECT DISTINCT p.chunk_id FROM l JOIN age p ON p.chunk_id = x JOIN age o ON o.chunk_id = y WHERE w >= 0.97::DOUBLE AND (o.day, o.chunk_id) < (p.day, p.chunk_id)),
mm AS (SELECT chunk_id FROM mem WHERE chunk_id NOT IN (FROM later))"""


class Dossier:
    """A topic's passages: forty nearest, all headings that mention it (the seeds), one hop, later retellings dropped.

    The topic's vector is that of the first passage whose heading mentions it. Links are found only where they touch a seed, or from .97 on
    join two members; every member that is no seed has such a link from HOP on and below .97.
    """

    def __init__(self, spark, sf, topic: str = TOPIC):
        self.rows = r = rows(spark, sf)
        named = r.where(T.mentions(F.col("heading"), topic))
        z = named.orderBy("id").limit(1).select(F.col("v").alias("z"))
        self.sim = materialise(r.join(F.broadcast(z)).select("id", "day", F.round(V.dot(F.col("v"), F.col("z")), 6).alias("sim")), "dossier-sim")
        seeds = self.sim.where("sim > 0.5").orderBy(F.desc("sim"), "id").limit(40).select("id").union(named.select("id")).distinct()
        self.seeds = materialise(seeds, "dossier-seeds")
        self.field = knn.Field(side(r), 3)

    def members(self, of: DataFrame | None = None) -> DataFrame:
        """(id, sim); only those among of (id), if that is given: of others no link is sought but from these and their retellings."""
        field, seeds, x, dups = self.field, self.seeds, None, None
        if of is None:
            e = field.lists(seeds, HOP).unionByName(field.listed_by(seeds, HOP))
        else:
            dups = materialise(knn.either_lists(field.lists(of, DUPLICATE).unionByName(field.listed_by(of, DUPLICATE))), "dossier-dups")
            x = materialise(of.union(dups.select("a")).union(dups.select("b")).distinct(), "dossier-near")
            e = field.lists(x, HOP).unionByName(field.listed_by(x, HOP, seeds))
        e = knn.either_lists(e).where(F.col("w") < DUPLICATE)
        hop = graph.one_hop(seeds.select(F.col("id").alias("node")), e, HOP)
        there = self.sim if x is None else self.sim.join(x, "id", "left_semi")
        mem = materialise(there.join(seeds.union(hop.select("node")).distinct(), "id", "left_semi"), "dossier-members")
        age = mem.select("id", F.struct(F.coalesce("day", F.lit("9999")), "id").alias("age"))
        pairs = graph.both_ways(knn.either_lists(field.lists(mem.select("id"), DUPLICATE)) if dups is None else dups)
        later = pairs.join(age.select(F.col("id").alias("src"), F.col("age").alias("mine")), "src").join(age.select(F.col("id").alias("dst"), F.col("age").alias("other")), "dst").where("other < mine").select(F.col("src").alias("id")).distinct()
        kept = mem.join(later, "id", "left_anti").select("id", "sim")
        return materialise(kept if of is None else kept.join(of, "id", "left_semi"), "dossier-kept")


@query("dossier_documents", D + " SELECT doc_id, lane, min(coalesce(doc_date, '9999')) AS day, count(*) AS passages, sum(n_tokens)::BIGINT AS tokens, min(chunk_id) AS first, round(count(*)::DOUBLE / any_value(t), 2) AS share FROM mm JOIN c USING (chunk_id) JOIN (SELECT doc_id, count(*) AS t FROM c GROUP BY 1) USING (doc_id) GROUP BY ALL")
def dossier_documents(spark, sf):
    """The topic's timeline: documents with their day, number of member passages, tokens and the share of the document."""
    d = Dossier(spark, sf)
    mem, r = d.members(), d.rows
    d.field.close()
    whole = r.groupBy("grp").agg(F.count("*").alias("t"))
    per = r.join(mem.select("id"), "id", "left_semi").groupBy("grp", "lane").agg(F.min(F.coalesce("day", F.lit("9999"))).alias("day"), F.count("*").alias("passages"), F.sum("tokens").alias("tokens"), F.min("id").alias("first"))
    return per.join(whole, "grp").select(F.col("grp").alias("doc_id"), "lane", "day", "passages", "tokens", "first", F.round(F.col("passages") / F.col("t"), 2).alias("share"))


@query("dossier_bridges", D + " SELECT CASE WHEN a IN (FROM mm) THEN a ELSE b END AS inside, CASE WHEN a IN (FROM mm) THEN b ELSE a END AS outside, w FROM br WHERE (a IN (FROM mm)) <> (b IN (FROM mm)) ORDER BY w DESC, inside, outside LIMIT 20")
def dossier_bridges(spark, sf):
    """Bridges with exactly one end among the topic's passages: the strongest twenty."""
    b = materialise(bridge_pairs(spark, sf), "dossier-bridges")
    d = Dossier(spark, sf)
    mem = d.members(b.select(F.col("a").alias("id")).union(b.select("b")).distinct())
    d.field.close()
    m = lambda c: mem.select(F.col("id").alias(c), F.lit(True).alias(f"in_{c}"))
    b = b.join(m("a"), "a", "left").join(m("b"), "b", "left").where(F.col("in_a").isNull() != F.col("in_b").isNull())
    out = b.select(F.when(F.col("in_a"), F.col("a")).otherwise(F.col("b")).alias("inside"), F.when(F.col("in_a"), F.col("b")).otherwise(F.col("a")).alias("outside"), "w")
    return out.orderBy(F.desc("w"), "inside", "outside").limit(20)


@query("dossier_dark", D + " SELECT chunk_id FROM mm WHERE chunk_id NOT IN (SELECT x FROM l WHERE w < 0.97::DOUBLE) ORDER BY 1 LIMIT 40")
def dossier_dark(spark, sf):
    """Member passages that no semantic link touches: the first forty."""
    d = Dossier(spark, sf)
    # a member that is no seed has the semantic link that it is reached by; one whose list isn't full of retellings is linked by its own list or not at all
    own = d.field.lists(d.seeds, NEAR)
    bare = materialise(d.seeds.join(own.groupBy(F.col("q").alias("id")).agg(F.min("w").alias("least"), F.count("*").alias("n")), "id", "left").where(F.col("least").isNull() | (F.col("least") >= DUPLICATE)), "dossier-bare")
    linked = d.field.listed_by(bare.where(F.col("n") == d.field.k).select("id"), NEAR).where(F.col("w") < DUPLICATE).select(F.col("nbr").alias("id"))
    mem = d.members(materialise(bare.select("id").join(linked, "id", "left_anti"), "dossier-dark"))
    d.field.close()
    return mem.select(F.col("id").alias("chunk_id")).orderBy("chunk_id").limit(40)


@query("dossier_plan", D + " SELECT chunk_id, sim, com FROM mm JOIN sim USING (chunk_id) LEFT JOIN m USING (chunk_id) ORDER BY sim DESC, chunk_id LIMIT 8")
def dossier_plan(spark, sf):
    """The eight member passages to read first, with their communities."""
    d = Dossier(spark, sf)
    mem = d.members()
    d.field.close()
    top = mem.orderBy(F.desc("sim"), "id").limit(8)
    return top.join(communities(spark, sf), "id", "left").select(F.col("id").alias("chunk_id"), "sim", "com")


@query("unit_central", C + """, x AS (SELECT com, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM c JOIN m USING (chunk_id)), a AS (SELECT com, dim, avg(x) AS x FROM x GROUP BY ALL), z AS (SELECT com, sqrt(sum(x * x)) + 1e-9::DOUBLE AS n FROM a GROUP BY 1), cent AS (SELECT com, list(x / n ORDER BY dim) AS v FROM a JOIN z USING (com) GROUP BY 1),
s AS (SELECT com, chunk_id, round(list_inner_product(c.v, cent.v), 5) AS w FROM c JOIN m USING (chunk_id) JOIN cent USING (com)) SELECT com, chunk_id, w, r FROM (SELECT *, row_number() OVER (PARTITION BY com ORDER BY w DESC, chunk_id)::INT AS r FROM s) WHERE r <= 6""")
def unit_central(spark, sf):
    """What a unit map shows of each community: the six passages nearest to its normalised mean."""
    r = rows(spark, sf).select("id", "v").join(communities(spark, sf), "id")
    scored = r.join(P.mean_vectors(r, "com", "v").select("com", "centroid"), "com").withColumn("w", F.round(V.dot(F.col("v"), F.col("centroid")), 5))
    rank = F.row_number().over(Window.partitionBy("com").orderBy(F.desc("w"), "id"))
    return scored.withColumn("r", rank).where("r <= 6").select("com", F.col("id").alias("chunk_id"), "w", "r")


@query("grow")
def grow(spark, sf, fraction: float = 0.8):
    """One row: the field's partition at a fraction of its growth against the whole's: frozen drift and overflow, ARI and moved share of a re-fit."""
    order = S.arrival(table(spark, sf, "documents").select("doc_id", "when_s"), "when_s", "doc_id").select(F.col("doc_id").alias("grp"), "pos")
    r = materialise(rows(spark, sf).select("id", "grp", "v", "raw").join(order, "grp"), "grow")
    cut = int(r.select("grp").distinct().count() * fraction)
    bound = r.select("pos").distinct().orderBy("pos").limit(cut + 1).agg(F.max("pos")).first()[0]

    def fit(part: DataFrame) -> DataFrame:
        s = side(part)
        links = materialise(knn.both_list(knn.block_topk(s, s, 10, 0.50)), "grow-links")
        labels = graph.louvain(part.select(F.col("id").alias("node")), links).select(F.col("node").alias("id"), "community")
        return materialise(P.fold_small(part, labels, "id", "v"), "grow-labels")

    base = r.where(F.col("pos") < bound)
    frozen, whole = fit(base), fit(r)
    cents = materialise(P.mean_vectors(base.join(frozen, "id"), "community", "v"), "grow-centroids")
    new = materialise(P.assign_capped(r.where(F.col("pos") >= bound), cents), "grow-new")
    drift = P.drift(frozen.unionByName(new), P.nearest_centroid(r, cents, "id"), "id")
    pairs = frozen.select("id", F.col("community").alias("x")).join(whole.select("id", F.col("community").alias("y")), "id")
    ari = P.adjusted_rand(pairs).withColumnRenamed("ari", "refit_ari")
    moved = P.moved_share(pairs.select(F.col("x").alias("before"), F.col("y").alias("after"))).withColumnRenamed("moved", "refit_moved")
    return new.agg(F.count("*").alias("n_new"), F.count_if(F.col("community") < 0).alias("overflow")).join(drift).join(ari).join(moved)  # one-row tables
