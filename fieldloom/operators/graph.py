"""Graph operators on edge tables (a, b, w)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window, functions as F

from fieldloom.session import discard, materialise


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionAll(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))


def _unsettled(now: DataFrame) -> int:
    """1 while a node of edges (u, v), v < u, has two smaller neighbours, or a smaller and a larger one; else 0: all are stars."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    per = now.select(F.inline(ends)).groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return per.where("down > 1 or (down = 1 and up = 1)").limit(1).count()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each; nodes without edges are their own.

    Large-star and small-star steps until all edges form stars round the smallest, on edges whose lineage is cut at every round: each round is two
    shuffles, the number of rounds grows with the logarithm of the longest chain, and a hub's neighbours are pre-aggregated to
    their minimum.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    while _unsettled(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        nxt = materialise(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
        discard(now)
        now = nxt
    roots = now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select("node").distinct().join(roots, F.col("node") == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: sum over communities of (inner weight / m - (strength / 2m)^2). membership: (node, community)."""
    m = edges.agg(F.sum("w").alias("m"))
    inside = edges.join(membership.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(membership.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("inner_w"))
    strength = degree(edges).join(membership, "node").groupBy("community").agg(F.sum("strength").alias("k"))
    terms = strength.join(inside, "community", "left").join(m)
    return terms.agg(F.round(F.sum(F.coalesce("inner_w", F.lit(0.0)) / F.col("m") - (F.col("k") / (2 * F.col("m"))) ** 2), 6).alias("modularity"))


def louvain(nodes: DataFrame, edges: DataFrame, seed: int = 7, resolution: float = 1.0) -> DataFrame:
    """(node, community): synchronous modularity moves, level by level; communities are named by their smallest node.

    In each sweep a hash of (node, seed, sweep) lets half of the nodes move to the neighbouring community of the largest gain,
    the smaller name on ties. Sweeps go on until two running move nothing, or until modularity has not risen for some sweeps;
    levels until one moves nothing. The same seed gives the same result on any partitioning.
    """
    membership = materialise(nodes.select("node", F.col("node").alias("community")), "louvain")
    level_edges = materialise(edges.select("a", "b", F.col("w").cast("double").alias("w")), "louvain-level")
    total = level_edges.agg(F.sum("w")).first()[0]
    if not total:
        return membership
    for level in itertools.count():
        now = materialise(both_ways(level_edges).groupBy("src", "dst").agg(F.sum("w").alias("w")), "louvain-edges")
        strength = materialise(now.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), "louvain-strength")
        state = materialise(strength.select("node", F.col("node").alias("community"), "k"), "louvain-state")
        moved_any = False
        best_q, since, quiet = None, 0, 0
        for sweep in itertools.count():
            totals = state.groupBy("community").agg(F.sum("k").alias("tot"))
            links = now.where("src <> dst").join(state.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), F.col("community").alias("c")).agg(F.sum("w").alias("w_in"))
            mine = state.select("node", "community", "k")
            options = links.join(mine, "node").join(totals.select(F.col("community").alias("c"), "tot"), "c")
            others = F.when(F.col("c") == F.col("community"), F.col("tot") - F.col("k")).otherwise(F.col("tot"))
            gain = F.round(F.col("w_in") - F.lit(resolution) * F.col("k") * others / F.lit(2.0 * total), 9)
            scored = options.withColumn("gain", gain)
            stay = scored.where("c = community").select("node", F.col("gain").alias("here"))
            best = scored.groupBy("node").agg(F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("best"))
            turn = F.pmod(F.xxhash64("node", F.lit(seed), F.lit(sweep + 100 * level)), F.lit(2)) == 0
            alone = -F.lit(resolution) * F.col("k") * (F.col("tot") - F.col("k")) / F.lit(2.0 * total)
            chosen = mine.join(best, "node", "left").join(stay, "node", "left").join(totals, "community")
            goes = turn & F.col("best").isNotNull() & (F.col("best.gain") > F.coalesce("here", F.round(alone, 9)))
            nxt = materialise(chosen.select("node", F.when(goes, -F.col("best.c")).otherwise(F.col("community")).cast("bigint").alias("community"), "k", goes.alias("moved")), "louvain-state")
            moves = nxt.where("moved").count()
            discard(state)
            state = nxt.drop("moved")
            state.written_at = nxt.written_at
            moved_any |= moves > 0
            quiet = 0 if moves else quiet + 1
            if quiet == 2:
                break
            if sweep % 4 == 3:  # nodes that move at once can undo each other's gain: what counts is the whole
                inner = now.join(state.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(state.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst").where("cs = cd").agg(F.sum("w")).first()[0] or 0.0
                spread = state.groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
                q = inner / (2.0 * total) - resolution * spread / (4.0 * total * total)
                since = 0 if best_q is None or q > best_q + 1e-9 else since + 1
                best_q = q if best_q is None else max(q, best_q)
                if since == 2:
                    break
        if not moved_any:
            break
        merged = membership.join(state.select(F.col("node").alias("community"), F.col("community").alias("next")), "community", "left").select("node", F.coalesce("next", "community").alias("community"))
        membership = materialise(merged, "louvain")
        of = state.select("node", "community")
        level_edges = materialise(now.where("src <= dst").join(of.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst").groupBy("a", "b").agg(F.sum(F.when(F.col("src") == F.col("dst"), F.col("w") / 2).otherwise(F.col("w"))).alias("w")), "louvain-level")  # loops stand twice in `now`
    names = membership.groupBy("community").agg(F.min("node").alias("name"))
    return membership.join(names, "community").select("node", F.col("name").alias("community"))


def agreement(edges: DataFrame, memberships: DataFrame) -> DataFrame:
    """Of each existing edge the share of runs that put both ends together. memberships: (run, node, community)."""
    a = memberships.select("run", F.col("node").alias("a"), F.col("community").alias("ca"))
    b = memberships.select("run", F.col("node").alias("b"), F.col("community").alias("cb"))
    return edges.join(a, "a").join(b, ["b", "run"]).groupBy("a", "b").agg(F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("agree"))


def consensus(nodes: DataFrame, edges: DataFrame, memberships: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(node, component): components of the edges that enough runs agree on."""
    kept = agreement(edges, memberships).where(F.col("agree") >= threshold)
    return components(nodes, kept.select("a", "b", F.lit(1.0).alias("w")))


def one_hop(seeds: DataFrame, edges: DataFrame, floor: float = 0.0) -> DataFrame:
    """(node, w): neighbours of the seeds over edges of at least the floor, with the heaviest such edge."""
    return both_ways(edges).where(F.col("w") >= floor).join(seeds.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.max("w").alias("w"))


def rank_flow(seeds: DataFrame, edges: DataFrame, hops: int = 3, restart: float = 0.15, keep: int | None = None) -> DataFrame:
    """(node, mass): personalised PageRank from seeds (node, mass) for some hops, hubs damped by 1 / ln(e + degree).

    With keep, only the keep heaviest nodes fire at each hop.
    """
    links = both_ways(edges)
    out = links.groupBy("src").agg(F.sum("w").alias("out"), F.count("*").alias("deg"))
    mass = seeds.select("node", F.col("mass").cast("double").alias("mass"))
    for _ in range(hops):
        fire = mass if keep is None else mass.orderBy(F.desc("mass"), "node").limit(keep)
        moved = links.join(fire.withColumnRenamed("node", "src"), "src").join(out, "src")
        flow = moved.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("mass") * F.col("w") / F.col("out") / F.log(F.lit(2.718281828459045) + F.col("deg"))).alias("mass"))
        mass = flow.select("node", (F.col("mass") * (1 - restart)).alias("mass")).unionAll(seeds.select("node", (F.col("mass").cast("double") * restart).alias("mass"))).groupBy("node").agg(F.sum("mass").alias("mass"))
    return mass


def lead_lag(rows: DataFrame, key: str, order: list[str], node: str) -> DataFrame:
    """(a, b): each row and its successor within a key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.select(F.col(node).alias("a"), F.lead(node).over(w).alias("b")).where(F.col("b").isNotNull())
