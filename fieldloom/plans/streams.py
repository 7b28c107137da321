"""Streaming queries, run to the end of their source."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import vectors as V
from fieldloom.operators import partitions as P
from fieldloom.plans import field
from fieldloom.plans.registry import query
from fieldloom.session import materialise
from fieldloom.sources.tables import table
from fieldloom.streaming import jobs


@query("stream_lane_ema", "WITH p AS (SELECT lane, placed_at, residual::DOUBLE AS r FROM placements WHERE residual IS NOT NULL AND lane IS NOT NULL), l AS (SELECT lane, list(r * r ORDER BY placed_at, r) AS xs FROM p GROUP BY 1) SELECT lane, round(list_reduce(xs, lambda s, x: 0.9::DOUBLE * s + 0.1::DOUBLE * x), 6) AS ema, len(xs) AS n FROM l")
def stream_lane_ema(spark, sf):
    """Lane volatility kept as streaming state; the last state of each lane, every delivered row counted."""
    rows = jobs.source(spark, f"{sf}/placements.parquet").select("lane", F.col("placed_at").alias("at"), F.col("residual").alias("r"))
    out = jobs.drain(jobs.lane_averages(rows), "lane-ema")
    last = out.groupBy("lane").agg(F.max_by("ema", "n").alias("ema"), F.max("n").alias("n"))
    return last.select("lane", F.round("ema", 6).alias("ema"), "n")


@query("stream_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    """Six-hour windows of the events by type under a watermark of a day, with those that are still open at the end."""
    out = jobs.drain_updates(jobs.windowed_counts(jobs.source(spark, f"{sf}/events.parquet")), "windows", ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_first_deliveries", "SELECT hash_hex, min(record_id) AS record_id FROM tape_records WHERE t_tape IS NOT NULL GROUP BY 1")
def stream_first_deliveries(spark, sf):
    """Records by hash, each once."""
    rows = jobs.source(spark, f"{sf}/tape_records.parquet").where("t_tape is not null").select("record_id", "hash_hex", "t_tape")
    kept = jobs.drain(jobs.first_deliveries(rows, "hash_hex", "t_tape", "4000 days"), "deliveries").select("hash_hex")
    return table(spark, sf, "tape_records").where("t_tape is not null").join(kept, "hash_hex", "left_semi").groupBy("hash_hex").agg(F.min("record_id").alias("record_id"))


@query("stream_lane_fronts", "WITH p AS (SELECT lane, placed_at, residual::DOUBLE AS r FROM placements WHERE residual IS NOT NULL AND lane IS NOT NULL), z AS (SELECT lane, row_number() OVER o - 1 AS i, avg(r) OVER a AS ma, avg(r) OVER b AS mb, stddev_pop(r) OVER b AS sd, count(*) OVER a AS ca, count(*) OVER b AS cb FROM p WINDOW o AS (PARTITION BY lane ORDER BY placed_at, r), a AS (PARTITION BY lane ORDER BY placed_at, r ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), b AS (PARTITION BY lane ORDER BY placed_at, r ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)) SELECT lane, i, round(CASE WHEN sd > 1e-9::DOUBLE THEN (ma - mb) / sd ELSE 0 END, 5) AS z FROM z WHERE ca = 8 AND cb = 40")
def stream_lane_fronts(spark, sf):
    """The front detector kept as streaming state per lane, on the stored residuals as they were placed."""
    rows = jobs.source(spark, f"{sf}/placements.parquet").select("lane", F.col("placed_at").alias("at"), F.col("residual").alias("r"))
    return jobs.drain(jobs.lane_fronts(rows), "lane-fronts").select("lane", "i", F.round("z", 5).alias("z"))


@query("stream_assign", field.CAPPED)
def stream_assign(spark, sf):
    """Later vectors of embeddings stream into the frozen lanes of the earlier ones, each up to twice the mean size."""
    f = field.field(spark, sf)
    cut = f.agg(F.floor(F.count_distinct("grp") * 0.8)).first()[0]
    base = P.mean_vectors(f.where(F.col("grp") < cut), "label", "v").select(F.col("label").cast("bigint").alias("community"), "centroid", "n")
    cap = max(1, int(2.0 * base.agg(F.avg("n")).first()[0]))
    e = jobs.source(spark, f"{sf}/embeddings.parquet").where(F.floor(F.col("vec_id") / 4) >= cut)
    return jobs.frozen_assignments(e.select(F.col("vec_id").cast("bigint").alias("id"), V.normalise(F.col("embedding")).alias("v")), materialise(base, "frozen"), cap, "assign")
