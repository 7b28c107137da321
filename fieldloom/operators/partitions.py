"""Partitions of vectors into communities, frozen and grown by assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fieldloom.functions import vectors as V


def mean_vectors(rows: DataFrame, key: str, vec: str, normalised: bool = True) -> DataFrame:
    """(key, centroid, n): mean by coordinates, summed in partial aggregates, then scaled to length 1."""
    cells = rows.where(F.col(vec).isNotNull()).select(key, F.posexplode(vec).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    joined = cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s.x).alias("centroid"), F.max("n").alias("n"))
    return joined.withColumn("centroid", V.normalise(F.col("centroid"))) if normalised else joined


def nearest_centroid(rows: DataFrame, centroids: DataFrame, id_col: str, vec: str = "v", most: int = 1 << 16) -> DataFrame:
    """(id, community, w): the centroid with the largest dot product, the smaller community on ties.

    The centroids are sent to every task only while there are at most `most`; above that they are joined in blocks.
    """
    from fieldloom.operators.knn import block_topk

    n = centroids.count()
    if n > most:
        side = lambda df, i, v: df.select(F.col(i).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("grp"), F.lit(0).cast("bigint").alias("pos"), F.col(v).alias("v"))
        q = side(rows, id_col, vec).withColumn("grp", F.lit(-1).cast("bigint"))
        return block_topk(q, side(centroids, "community", "centroid").withColumn("grp", F.lit(-2).cast("bigint")), 1).select(F.col("q").alias(id_col), F.col("nbr").alias("community"), "w")
    scored = rows.join(F.broadcast(centroids.select("community", "centroid"))).withColumn("w", F.round(V.dot(F.col(vec), F.col("centroid")), 6))
    best = scored.groupBy(id_col).agg(F.max(F.struct("w", (-F.col("community")).alias("c"))).alias("best"))
    return best.select(id_col, (-F.col("best.c")).alias("community"), F.col("best.w").alias("w"))


def fold_small(rows: DataFrame, membership: DataFrame, id_col: str, vec: str, least: int = 3) -> DataFrame:
    """(id, community): communities below `least` are folded into the nearest surviving centroid; if none survives, into the largest."""
    sizes = membership.groupBy("community").count()
    kept = sizes.where(F.col("count") >= least)
    if not kept.limit(1).count():
        kept = sizes.orderBy(F.desc("count"), "community").limit(1)
    members = membership.join(kept.select("community"), "community", "left_semi")
    cents = mean_vectors(rows.join(members, id_col), "community", vec)
    orphans = rows.join(membership.join(kept.select("community"), "community", "left_anti").select(id_col), id_col, "left_semi")
    return members.select(id_col, "community").unionByName(nearest_centroid(orphans, cents, id_col, vec).select(id_col, "community"))


def assign_capped(new: DataFrame, centroids: DataFrame, id_col: str = "id", vec: str = "v", cap_factor: float = 2.0, cap: int | None = None) -> DataFrame:
    """(id, community): in order of id each vector joins the nearest community with room, else -1. Nothing that exists moves.

    centroids: (community, centroid, n). cap = max(1, int(cap_factor * mean n)) unless given. One row after another by definition, so
    the decisions are taken in rounds: all vectors bid for their best open community, each community admits the first
    bids by id up to its room, and a vector refused by a full one bids for its next. A vector may only be displaced by an
    earlier one, so the outcome is the sequential one; a round is a shuffle.
    """
    stats = centroids.agg(F.avg("n").alias("mean"), F.count("*").alias("c")).first()
    if not stats.c:
        return new.select(id_col, F.lit(-1).cast("bigint").alias("community"))
    cap = max(1, int(cap_factor * stats["mean"])) if cap is None else cap
    cents = centroids.select("community", "centroid", F.greatest(F.lit(cap) - F.col("n"), F.lit(0)).alias("room")).orderBy("community").toPandas()
    matrix = np.stack(cents.centroid.map(np.asarray)).astype(np.float64)
    names, room = cents.community.to_numpy(np.int64), cents.room.to_numpy(np.int64)
    shared = new.sparkSession.sparkContext.broadcast((matrix, names))

    def prefer(batches):
        m, c = shared.value
        for pdf in batches:
            sims = np.round(np.stack(pdf[vec].map(np.asarray)) @ m.T, 6) if len(pdf) else np.zeros((0, len(c)))
            yield pd.DataFrame({id_col: pdf[id_col], "prefs": [c[np.lexsort((c, -s))].tolist() for s in sims]})

    from fieldloom.session import materialise

    prefs = materialise(new.select(id_col, vec).mapInPandas(prefer, f"{id_col} bigint, prefs array<bigint>"), "assign-prefs")
    rooms = new.sparkSession.createDataFrame([(int(a), int(b)) for a, b in zip(names, room)], "community bigint, room bigint")
    state = prefs.withColumn("at", F.lit(1))
    while True:  # every further round moves at least one bid on, so it ends
        bids = state.where(F.col("at") <= len(names)).withColumn("community", F.element_at("prefs", F.col("at")))
        rank = F.row_number().over(Window.partitionBy("community").orderBy(id_col))
        judged = bids.withColumn("rank", rank).join(F.broadcast(rooms), "community")
        refused = judged.where("rank > room").select(id_col, F.lit(1).alias("no"))
        nxt = materialise(state.join(refused, id_col, "left").select(id_col, "prefs", (F.col("at") + F.coalesce("no", F.lit(0))).alias("at"), F.coalesce("no", F.lit(0)).alias("no")), "assign-state")
        again = nxt.where("no = 1").limit(1).count()
        state = nxt.drop("no")
        if not again:
            break
    return state.select(id_col, F.when(F.col("at") <= len(names), F.expr("element_at(prefs, least(at, size(prefs)))")).otherwise(F.lit(-1)).cast("bigint").alias("community"))


def drift(membership: DataFrame, nearest: DataFrame, id_col: str) -> DataFrame:
    """One row: share of members (community >= 0) whose nearest centroid is another's; 0 without members."""
    both = membership.where("community >= 0").join(nearest.select(id_col, F.col("community").alias("near")), id_col)
    return both.agg(F.round(F.coalesce(F.avg((F.col("near") != F.col("community")).cast("double")), F.lit(0.0)), 6).alias("drift"))


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """One row: ari of two labellings (x, y), from the contingency counts; 1 if both are trivial."""
    two = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    cells = pairs.groupBy("x", "y").agg(F.count("*").alias("n"))
    index = cells.agg(two("n").alias("idx"), F.sum("n").cast("double").alias("total"))
    a = cells.groupBy("x").agg(F.sum("n").alias("n")).agg(two("n").alias("sa"))
    b = cells.groupBy("y").agg(F.sum("n").alias("n")).agg(two("n").alias("sb"))
    r = index.join(a).join(b)  # three one-row tables
    expected = F.col("sa") * F.col("sb") / (F.col("total") * (F.col("total") - 1) / 2)
    top = (F.col("sa") + F.col("sb")) / 2
    return r.select(F.round(F.when(top == expected, F.lit(1.0)).otherwise((F.col("idx") - expected) / (top - expected)), 6).alias("ari"))


def moved_share(pairs: DataFrame) -> DataFrame:
    """One row: share of rows (before, after) that leave the old community their new one overlaps most, the smaller old on ties."""
    cells = pairs.groupBy("before", "after").agg(F.count("*").alias("n"))
    best = cells.withColumn("r", F.row_number().over(Window.partitionBy("after").orderBy(F.desc("n"), "before"))).where("r = 1").select("after", F.col("before").alias("maps_to"))
    return cells.join(best, "after").agg(F.round(F.sum(F.when(F.col("maps_to") != F.col("before"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("moved"))
