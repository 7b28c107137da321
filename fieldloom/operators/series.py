"""Ordered statistics: residual curves, deciles, fronts, moving averages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.operators.knn import best_past
from fieldloom.session import materialise

RETELLING = 0.97


def running(rows: DataFrame, order: list, name: str, value: Column | None = None) -> DataFrame:
    """rows with `name`: the number of rows before each in a total order, or the sum of their values.

    Rows are divided into ranges of the order; each range counts by itself and starts from the sum of the ranges before it, so
    no task holds them all. Order columns must tell all rows apart.
    """
    keys = [o if isinstance(o, Column) else F.col(o) for o in order]
    ranged = rows.withColumns({f"_o{i}": k for i, k in enumerate(keys)} | {"_v": F.lit(1) if value is None else value})
    names = [f"_o{i}" for i in range(len(keys))]
    ranged = materialise(ranged.repartitionByRange(*names).withColumn("_p", F.spark_partition_id()), "running")
    sums = sorted((r["_p"], r["s"]) for r in ranged.groupBy("_p").agg(F.sum("_v").alias("s")).collect())  # a row a range
    before, total = [], 0
    for p, s in sums:
        before.append((p, total))
        total += s or 0
    kind = "bigint" if value is None else "double"
    starts = F.broadcast(rows.sparkSession.createDataFrame([(p, int(b) if value is None else float(b)) for p, b in before], f"_p int, _b {kind}"))
    within = Window.partitionBy("_p").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(starts, "_p").withColumn(name, F.col("_b") + F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return out.select(*rows.columns, name)


def arrival(docs: DataFrame, when: str, doc: str) -> DataFrame:
    """docs with pos, from 0 in the order (when, doc); undated rows have none."""
    return running(docs.where(F.col(when).isNotNull()), [when, doc], "pos")


def residual_curve(chunks: DataFrame, retelling: float = RETELLING, of: DataFrame | None = None) -> DataFrame:
    """(grp, pos, residual, retelling_share, n_chunks) of each document against its past only.

    chunks: (id, grp document, pos arrival of the document, v). A document without a past is not scored. of: their (id, grp, pos), where these
    are had without the vectors.
    """
    best = best_past(chunks).join((chunks if of is None else of).select(F.col("id").alias("q"), "grp", "pos"), "q")
    return best.groupBy("grp", "pos").agg(F.avg(1 - F.col("w")).alias("residual"), F.avg((F.col("w") >= retelling).cast("double")).alias("retelling_share"), F.count("*").alias("n_chunks"))


def decile_of(rank: Column, n: Column, k: int = 10) -> Column:
    """Bin q of 0-based rank i holds int(q n / k) <= i < int((q + 1) n / k)."""
    return (F.ceil((rank + 1) * F.lit(k) / n) - 1).cast("int")


def deciles(scores: DataFrame, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """Mean residual and retelling share per bin of arrival; bins without a document have no row."""
    by = by or []
    if by:
        ranked = scores.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    else:
        ranked = running(scores, ["pos"], "i")
        ranked = ranked.join(F.broadcast(ranked.agg(F.count("*").alias("n"))))  # one row
    return ranked.withColumn("decile", decile_of(F.col("i"), F.col("n"), k)).groupBy(*by, "decile").agg(F.avg("residual").alias("residual"), F.avg("retelling_share").alias("retelling_share"))


def front_z(series: DataFrame, window: int = 8, trailing: int = 40, order: str = "i", value: str = "residual", by: str | None = None) -> DataFrame:
    """series with z: the mean of the next `window` values against the trailing ones, in their population deviations.

    Null where either frame is not full; 0 where the deviation is at most 1e-9. With `by` each key has its own series.
    """
    w = Window.partitionBy(by).orderBy(order) if by else Window.orderBy(order)
    ahead, past = w.rowsBetween(0, window - 1), w.rowsBetween(-trailing, -1)
    z = (F.avg(value).over(ahead) - F.avg(value).over(past)) / F.stddev_pop(value).over(past)
    full = (F.count("*").over(past) == trailing) & (F.count("*").over(ahead) == window)
    return series.withColumn("z", F.when(full, F.when(F.stddev_pop(value).over(past) > 1e-9, F.round(z, 9)).otherwise(0.0)))


def fronts(series: DataFrame, open_z: float = 1.0, close_z: float = 0.0, order: str = "i", value: str = "residual", by: str | None = None) -> DataFrame:
    """(opened_at, closed_at, peak_z, peak_residual, n_documents, length): stretches from z > open_z to z <= close_z.

    The closing row belongs to its front; a front still open at the end has a null closed_at and length 1, as the reference counts.
    """
    by_ = [by] if by else []
    w = Window.partitionBy(*by_).orderBy(order) if by else Window.orderBy(order)
    marked = series.where(F.col("z").isNotNull()).withColumn("on", F.last(F.when(F.col("z") > open_z, 1).when(F.col("z") <= close_z, 0), ignorenulls=True).over(w))
    marked = marked.withColumn("on", F.coalesce("on", F.lit(0))).withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0)))
    grouped = marked.withColumn("island", F.sum(F.when((F.col("on") == 1) & (F.col("was") == 0), 1).otherwise(0)).over(w)).where("on = 1 or was = 1")
    closing = F.max(F.when(F.col("on") == 0, F.col(order)))
    out = grouped.groupBy(*by_, "island").agg(F.min(order).alias("opened_at"), closing.alias("closed_at"), F.max("z").alias("peak_z"), F.max(value).alias("peak_residual"), F.count("*").alias("n_documents"))
    return out.drop("island").withColumn("length", F.coalesce(F.col("closed_at") - F.col("opened_at") + 1, F.lit(1)))


def moving_average(rows: DataFrame, key: str, order: list[str], value: Column, keep: float = 0.9) -> DataFrame:
    """(key, ema, n): exponential average in order, the first value as the seed. Null values are skipped.

    A stretch of values takes an average s to a s + b, so stretches are summed up apart, wherever a range of the order is cut,
    and put together per key: no key needs a task of its own.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = [f"_o{i}" for i in range(len(order))]
    ordered = rows.where(value.isNotNull()).select(key, *[F.col(o).alias(n) for o, n in zip(order, names)], value.cast("double").alias("x"))
    ordered = ordered.repartitionByRange(key, *names).sortWithinPartitions(key, *names).select(key, "x", F.spark_partition_id().alias("p"))

    def stretches(batches):
        now, n, a, b, seeded, part = None, 0, 1.0, 0.0, 0.0, 0
        for batch in batches:
            out = []
            for k, x, p in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if k != now or not n:
                    if n:
                        out.append((now, part, n, a, b, seeded))
                    now, n, a, b, seeded, part = k, 1, keep, (1 - keep) * x, x, p
                else:
                    n, a, b, seeded = n + 1, keep * a, keep * b + (1 - keep) * x, keep * seeded + (1 - keep) * x
            yield table(out)
        yield table([(now, part, n, a, b, seeded)] if n else [])

    def table(rows_: list) -> pa.RecordBatch:
        columns = list(zip(*rows_)) if rows_ else [()] * 6
        types = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([None if v is None else str(v) for v in c] if i == 0 else list(c), t) for i, (c, t) in enumerate(zip(columns, types))], names=["key", "p", "n", "a", "b", "seeded"])

    parts = ordered.select(F.col(key).cast("string").alias(key), "x", "p").mapInArrow(stretches, "key string, p int, n bigint, a double, b double, seeded double")
    listed = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("p", "n", "a", "b", "seeded"))).alias("xs"))  # a stretch per range
    ema = F.aggregate("xs", F.lit(None).cast("double"), lambda s, r: F.when(s.isNull(), r.seeded).otherwise(r.a * s + r.b))
    return listed.select(F.col("key").cast(kind).alias(key), ema.alias("ema"), F.aggregate("xs", F.lit(0).cast("bigint"), lambda s, r: s + r.n).cast("int").alias("n"))


def average_before(rows: DataFrame, key: str, order: list[str], value: str, keep: float = 0.9) -> DataFrame:
    """rows with ema: the moving average of each key's values before the row, null for the first. Values must not be null.

    A key's rows pass in order through one task, batch by batch, and only the average is carried on; the sort can spill.
    """
    names = rows.columns

    def run(batches):
        now, ema = None, None
        for b in batches:
            before = []
            for k, x in zip(b.column(key).to_pylist(), b.column(value).to_pylist()):
                if k != now:
                    now, ema = k, None
                before.append(ema)
                ema = x if ema is None else keep * ema + (1 - keep) * x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.float64())], names=[*names, "ema"])

    schema = ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, ("ema", "double")])
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
