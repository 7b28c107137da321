"""Structured Streaming: lane state, windows with late data, and scoring before inserting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldloom.session import new_path


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, into a table of the shared folder, and read that back."""
    spark, out = stream.sparkSession, new_path(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", out + "-progress").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Run a stream in update mode over what there is; of each key the row written last, whether its window is closed or still open.

    A micro-batch that runs again after a failure replaces what its first run wrote.
    """
    spark, out = stream.sparkSession, new_path(stream.sparkSession, name)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", out + "-progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("last")).select("last.*")


def source(spark: SparkSession, path: str) -> DataFrame:
    """A folder or file of parquet as a stream."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if not name.endswith(".parquet") or _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def lane_averages(rows: DataFrame, keep: float = 0.9) -> DataFrame:
    """(lane, ema, n) whenever a lane gets rows: the state of a lane is its average and count. rows: (lane, at, r).

    Within a micro-batch rows are taken by (at, r); rows with a null lane or value are skipped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "r"])
        for r in rows.r:
            ema = r * r if ema is None else keep * ema + (1 - keep) * r * r
            n += 1
        state.update((ema, n))
        yield pd.DataFrame({"lane": [key[0]], "ema": [ema], "n": [n]})

    clean = rows.where("lane is not null and r is not null").select("lane", "at", F.col("r").cast("double").alias("r"))
    return clean.groupBy("lane").applyInPandasWithState(step, "lane string, ema double, n long", "ema double, n long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "1 day", size: str = "6 hours") -> DataFrame:
    """Windows of the event stream by type; rows later than the watermark are dropped. In append mode only closed windows come out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_deliveries(records: DataFrame, key: str, at: str, within: str = "30 days") -> DataFrame:
    """The stream without rows whose key came already within the watermark."""
    return records.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def frozen_assignments(stream: DataFrame, centroids: DataFrame, cap: int, name: str) -> DataFrame:
    """(id, community) of arriving vectors (id, v) in a frozen partition: the nearest community with room for it, else -1.

    Each micro-batch starts from the sizes that the earlier ones left, kept beside the output; the assigned never move. A batch
    that runs again after a failure replaces what its first run wrote and sees only the batches before it.
    """
    from fieldloom.operators.partitions import assign_capped

    spark, out = stream.sparkSession, new_path(stream.sparkSession, name)

    def each(batch: DataFrame, batch_id: int) -> None:
        sizes = centroids
        if batch_id:
            taken = spark.read.schema("id bigint, community bigint, batch bigint").parquet(out).where(F.col("batch") < batch_id).groupBy("community").agg(F.count("*").alias("more"))
            sizes = centroids.join(taken, "community", "left").select("community", "centroid", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        assign_capped(batch, sizes, cap=cap).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.select("id", "v").writeStream.foreachBatch(each).option("checkpointLocation", out + "-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id bigint, community bigint, batch bigint").parquet(out).drop("batch")


def lane_fronts(rows: DataFrame, window: int = 8, trailing: int = 40) -> DataFrame:
    """(lane, i, z) as soon as the window after a lane's i-th value is full: its mean against the `trailing` values before.

    rows: (lane, at, r). The state of a lane is its count and its last window + trailing values. Within a micro-batch rows are taken
    by (at, r); rows with a null lane or value are skipped. z is 0 where the trailing values deviate by 1e-9 or less.
    """
    kept = window + trailing

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, [])
        last, out = list(last), []
        for r in pd.concat(list(batches)).sort_values(["at", "r"]).r:
            last, n = [*last, r][-kept:], n + 1
            if len(last) == kept:
                past = pd.Series(last[:trailing])
                sd = past.std(ddof=0)
                out.append((key[0], n - window, (sum(last[trailing:]) / window - past.mean()) / sd if sd > 1e-9 else 0.0))
        state.update((n, last))
        yield pd.DataFrame(out, columns=["lane", "i", "z"])

    clean = rows.where("lane is not null and r is not null").select("lane", "at", F.col("r").cast("double").alias("r"))
    return clean.groupBy("lane").applyInPandasWithState(step, "lane string, i long, z double", "n long, last array<double>", "append", GroupStateTimeout.NoTimeout)


def score_then_insert(stream: DataFrame, field_path: str, score, name: str) -> DataFrame:
    """Prequential order: score(batch, field so far) is written for each micro-batch before the batch joins the field.

    A batch that is run again after a failure replaces what its first run wrote: both outputs are kept by batch id.
    """
    spark, out = stream.sparkSession, new_path(stream.sparkSession, name)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        field = spark.read.schema(batch.schema).parquet(field_path).where(F.lit(True)) if _exists(spark, field_path) else spark.createDataFrame([], batch.schema)
        score(batch, field).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.write.mode("overwrite").parquet(f"{field_path}/batch={batch_id}")
        batch.unpersist()

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", out + "-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
