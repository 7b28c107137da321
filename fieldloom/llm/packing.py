"""Problem 7: items of varying length into containers of one capacity.

The sizes' histogram has at most `capacity` bins, whatever the number of items. Combinations of up to three sizes that
fill a window below the capacity are enumerated, their repeat counts solved against the histogram by non-negative least
squares and rounded down to what the histogram holds; what is left is packed greedily, largest first, still on the
histogram. The items then look up their places by size and rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldloom.llm import tokenizers as T
from fieldloom.session import materialise
from fieldloom.sources.tables import table

#: Combinations fill at least this share of the capacity; partners tried for each size at each depth.
WINDOW, PARTNERS = 0.005, 3
#: Salt of the ranks within one size.
SALT = 64


def combinations(sizes: np.ndarray, capacity: int, window: float = WINDOW, partners: int = PARTNERS) -> np.ndarray:
    """Rows of three indices into the ascending sizes (-1: none) whose sum lies in [capacity * (1 - window), capacity]."""
    low = int(np.ceil(capacity * (1 - window)))
    rows = [(i, -1, -1) for i, s in enumerate(sizes) if low <= s <= capacity]
    for i in range(len(sizes)):
        left = capacity - sizes[i]
        top = min(np.searchsorted(sizes, left, "right") - 1, i)
        for j in range(top, max(-1, top - partners), -1):
            if sizes[i] + sizes[j] >= low:
                rows.append((i, j, -1))
        # for the third: seconds spread over what fits
        for j in np.unique(np.linspace(0, top, min(2 * partners, top + 1)).astype(int)) if top >= 0 else ():
            k = np.searchsorted(sizes, left - sizes[j], "right") - 1
            if 0 <= k <= j and sizes[i] + sizes[j] + sizes[k] >= low:
                rows.append((i, j, k))
    return np.array(sorted(set(rows)), np.int64).reshape(-1, 3)


def non_negative_least_squares(combos: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that bring A x near the counts, by accelerated projected gradients."""
    n, m = len(counts), len(combos)
    used = combos >= 0
    row = np.repeat(np.arange(m), 3)[used.reshape(-1)]
    col = combos.reshape(-1)[used.reshape(-1)]
    forward = lambda x: np.bincount(col, x[row], n)
    back = lambda r: np.bincount(row, r[col], m)
    v = np.ones(m)
    for _ in range(20):  # the step: the largest eigenvalue of A'A by power iteration
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-12)
    x = y = np.zeros(m)
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - back(forward(y) - counts) / (1.05 * norm))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where the items go: (size, first rank, ranks, first container, containers), and the number of containers.

    Rank r of the interval goes to container first + (r - first rank) % containers.
    """
    order = np.argsort(sizes)
    sizes, left = sizes[order].astype(np.int64), counts[order].astype(np.int64).copy()
    taken, places, container = np.zeros(len(sizes), np.int64), [], 0

    def put(items: dict[int, int], times: int) -> None:
        nonlocal container
        for i, m in items.items():
            places.append((int(sizes[i]), int(taken[i]), m * times, container, times))
            taken[i] += m * times
            left[i] -= m * times
        container += times

    combos = combinations(sizes, capacity)
    if len(combos):
        x = non_negative_least_squares(combos, left.astype(float))
        for c in np.argsort(-x, kind="stable"):
            items: dict[int, int] = {}
            for i in combos[c]:
                if i >= 0:
                    items[int(i)] = items.get(int(i), 0) + 1
            times = min(int(x[c] + 1e-6), *(int(left[i]) // m for i, m in items.items()))
            if times > 0:
                put(items, times)
    alive = np.flatnonzero(left > 0)
    while alive.size:
        items, room, top = {}, capacity, alive.size
        while True:
            top = min(top, int(np.searchsorted(sizes[alive], room, "right")))
            if top == 0:
                break
            i = int(alive[top - 1])
            m = min(room // int(sizes[i]), int(left[i]))
            items[i] = m
            room -= m * int(sizes[i])
            top -= 1
        put(items, min(int(left[i]) // m for i, m in items.items()))
        alive = alive[left[alive] > 0]
    return places, container


def token_sizes(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text", tokenizers: str | None = None) -> DataFrame:
    """(key, size): tokens of each text; null and empty texts have size 0."""

    def run(batches):
        encode = T.encoder(name, tokenizers)
        for b in batches:
            texts, size = b.column(1).to_pylist(), []
            for s in range(0, len(texts), 256):
                size += [len(x) for x in encode(texts[s : s + 256])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64())], names=[key, "size"])

    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, f"{key} bigint, size bigint")


def pack(sized: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """(container, key, piece, tok_start, tok_end): every item once, and whole unless it exceeds the capacity.

    An item above the capacity gives full pieces, a container each, and its rest as one more piece. Items of size 0 take
    no room and stand in container 0. Keys must be unique; an empty table gives no rows; a null size counts as 0.
    """
    spark = sized.sparkSession
    size = F.coalesce(F.greatest(F.col("size"), F.lit(0)), F.lit(0))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(size / F.lit(capacity)) - 1, F.lit(0)).cast("int"))
    cut = sized.select(key, size.alias("whole"), F.explode(pieces).alias("piece"))
    cut = cut.withColumn("tok_start", F.col("piece").cast("bigint") * capacity).withColumn("tok_end", F.least("whole", F.col("tok_start") + capacity))
    items = materialise(cut.select(key, "piece", "tok_start", "tok_end", (F.col("tok_end") - F.col("tok_start")).cast("int").alias("size"), F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int").alias("salt")), "p7-items")
    counts = items.where("size > 0").groupBy("size", "salt").count()
    offset = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.withColumn("before", F.coalesce(F.sum("count").over(offset), F.lit(0))), "p7-counts")
    histogram = offsets.groupBy("size").agg(F.sum("count").alias("n")).collect()  # at most `capacity` rows
    places, _ = plan(np.array([r["size"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], np.int64), capacity)
    rows = np.array(places, np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = spark.sparkContext.broadcast(rows)  # some intervals for each of at most `capacity` sizes
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy(key, "piece")) - 1
    ranked = items.where("size > 0").withColumn("rank", rank).join(offsets.select("size", "salt", "before"), ["size", "salt"])

    def place(batches):
        rows = shared.value
        code = rows[:, 0] * (1 << 40) + rows[:, 1]
        for b in batches:
            size, rank = np.asarray(b.column(4)).astype(np.int64), np.asarray(b.column(5)).astype(np.int64)
            at = np.searchsorted(code, size * (1 << 40) + rank, "right") - 1
            container = rows[at, 3] + (rank - rows[at, 1]) % rows[at, 4]
            yield pa.RecordBatch.from_arrays([pa.array(container), *(b.column(i) for i in range(4))], names=["container", key, "piece", "tok_start", "tok_end"])

    schema = f"container bigint, {key} bigint, piece int, tok_start bigint, tok_end bigint"
    packed = ranked.select(key, "piece", "tok_start", "tok_end", "size", (F.col("rank") + F.col("before")).alias("rank")).mapInArrow(place, schema)
    none = items.where("size = 0").select(F.lit(0).cast("bigint").alias("container"), key, "piece", "tok_start", "tok_end")
    return packed.unionByName(none)


def containers(spark: SparkSession, sf_dir: str, budget: int) -> DataFrame:
    """All documents in containers of one read budget."""
    row = table(spark, sf_dir, "read_budgets").where(F.col("budget_id") == budget).first()
    sized = materialise(token_sizes(table(spark, sf_dir, "documents").select("doc_id", "text"), row.tokenizer), "p7-sizes")
    return pack(sized, row.capacity_tokens).select(F.lit(budget).alias("budget_id"), "container", "doc_id", "piece", "tok_start", "tok_end")


def p7_containers_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(spark, sf_dir, 1)


def p7_containers_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(spark, sf_dir, 2)


def p7_containers_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(spark, sf_dir, 3)


def p7_containers_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(spark, sf_dir, 4)


def p7_containers_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(spark, sf_dir, 5)
