"""Problem 3: texts that differ by small edits, by MinHash with Bayesian pruning.

Equal texts are one class from the start. Bands of MinHash values propose pairs of classes; of each pair the signatures
are compared STEP values at a time, and it is dropped as soon as the posterior probability that its similarity reaches the
threshold falls below TOLERANCE. Only for what remains are the texts fetched, and their shingle sets compared exactly.
"""

from __future__ import annotations

from functools import cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldloom.llm import text as X
from fieldloom.operators.graph import components
from fieldloom.session import discard, materialise
from fieldloom.sources.tables import table

SHINGLE, THRESHOLD, MIN_WORDS = 3, 0.70, 40
#: BANDS keys of ROWS MinHash values each: a pair at similarity .7 shares none with probability below 7e-4.
BANDS, ROWS = 40, 5
STEP, TOLERANCE = 20, 1e-4
#: Classes of one band that meet in one group; larger bands are joined block by block.
BAND_BLOCK = 2048
SIGNATURE = BANDS * ROWS
_rng = np.random.default_rng(20250101)
_A = _rng.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """SIGNATURE MinHash values, of which 16 bits are kept."""
    out = np.empty(SIGNATURE, np.uint16)
    for s in range(0, SIGNATURE, 50):
        out[s : s + 50] = (((shingle_set[None, :] * _A[s : s + 50, None] + _B[s : s + 50, None]) >> np.uint64(16)).min(1)).astype(np.uint16)
    return out


@cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each number of compared values (STEP, 2 STEP, ...) the fewest matches with P(similarity >= threshold | matches) >= tolerance.

    The prior is uniform, so the posterior is Beta(m + 1, n - m + 1); its tail is summed on a fine grid.
    """
    s = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(STEP, SIGNATURE + 1, STEP):
        for m in range(n + 1):
            log = lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(s) + (n - m) * np.log1p(-s)
            if np.exp(log)[s >= threshold].sum() / 20000 >= tolerance:
                break
        out.append(m)
    return np.array(out)


def may_reach(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which rows of two signature blocks survive the incremental comparison."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(threshold)):
        at = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (a[alive, at] == b[alive, at]).sum(1)
        alive = alive[matches[alive] >= least]
        if not alive.size:
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _describe(batches):
    """(class, body) to (class, signature) of the bodies that are long enough."""
    known = X.WordHashes()
    for b in batches:
        ids, sig = [], []
        for i, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = X.words(body)
            if len(w) < MIN_WORDS:
                continue
            ids.append(i), sig.append(signature(X.shingles(np.array([known[x] for x in w], np.uint64), SHINGLE)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sig, pa.binary())], names=["cls", "sig"])


def _bands(batches):
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(n, BANDS, ROWS).astype(np.uint64)
        key = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :]
        for r in range(ROWS):
            key = X.mix(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, :, r])
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(b.column(0)), BANDS))], names=["band", "cls"])


def _pruned(batches):
    for b in batches:
        n = b.num_rows
        if n:
            sig = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(n, SIGNATURE) for k in (2, 3)]
            take = pa.array(np.flatnonzero(may_reach(*sig)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take)], names=["a", "b"])


def _verified(batches):
    def runs(body: str) -> set:
        w = X.words(body)
        return set(zip(w, w[1:], w[2:]))

    for b in batches:
        rows, jac, at, p = [], [], None, set()
        firsts = b.column(0).to_pylist()
        for r, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            if firsts[r] != at:
                at, p = firsts[r], runs(x)
            q = runs(y)
            shared = len(p & q)
            if shared >= THRESHOLD * (len(p) + len(q) - shared) - 1e-9 and shared / (len(p) + len(q) - shared) >= THRESHOLD:
                rows.append(r), jac.append(shared / (len(p) + len(q) - shared))
        take = pa.array(np.array(rows, np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(jac, pa.float64())], names=["a", "b", "similarity"])


def candidates(described: DataFrame, block: int = BAND_BLOCK) -> DataFrame:
    """(a, b), a < b: classes that share a band. A band of many classes is cut into blocks by a hash; each two blocks meet in a group of their own."""
    bands = described.mapInArrow(_bands, "band bigint, cls bigint").withColumn("n", F.count("*").over(Window.partitionBy("band"))).where("n > 1")
    cuts = F.ceil(F.col("n") / block).cast("int")
    own = materialise(bands.select("band", "cls", cuts.alias("cuts"), F.pmod(F.xxhash64("cls"), cuts).cast("int").alias("own")), "p3-bands")
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls")
    left, right = sent.withColumnsRenamed({"cls": "a", "own": "oa"}), sent.withColumnsRenamed({"cls": "b", "own": "ob"})
    met = left.join(right, ["band", "i", "j"]).where((F.col("a") < F.col("b")) & ((F.col("i") == F.col("j")) | (F.col("oa") != F.col("ob"))))
    return met.select("a", "b").distinct()


def _with_both(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """(a, b, value of a, value of b), by sending the pairs' ends to the rows (cls, value), which are shuffled once."""
    ends = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("cls"), F.lit(True).alias("first")), F.struct(F.col("b").alias("cls"), F.lit(False).alias("first")))).alias("end")).select("a", "b", "end.*")
    met = ends.join(rows.select("cls", value), "cls")
    return met.groupBy("a", "b").agg(F.max(F.when(F.col("first"), F.col(value))).alias("x"), F.max(F.when(~F.col("first"), F.col(value))).alias("y"))


def classes(records: DataFrame) -> DataFrame:
    """(record_id, cls): cls is the smallest record_id with the same body."""
    hashed = records.where(F.col("body").isNotNull() & F.col("record_id").isNotNull()).select(F.col("record_id").cast("bigint").alias("record_id"), F.xxhash64("body").alias("h1"), F.substring(F.md5("body"), 1, 16).alias("h2"))
    first = hashed.groupBy("h1", "h2").agg(F.min("record_id").alias("cls"), F.count("*").alias("n"))
    return hashed.join(first, ["h1", "h2"]).select("record_id", "cls", "n")


def class_links(records: DataFrame, block: int = BAND_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity), a < b, between classes of equal bodies, and the classes' members (record_id, cls, n)."""
    members = materialise(classes(records), "p3-classes")
    own = members.where(F.col("record_id") == F.col("cls")).select("cls")
    bodies = records.select(F.col("record_id").cast("bigint").alias("cls"), "body")
    described = materialise(bodies.join(own, "cls").mapInArrow(_describe, "cls bigint, sig binary"), "p3-described")
    likely = materialise(_with_both(candidates(described, block), described, "sig").mapInArrow(_pruned, "a bigint, b bigint"), "p3-likely")
    links = materialise(_with_both(likely, bodies, "body").mapInArrow(_verified, "a bigint, b bigint, similarity double"), "p3-links")
    # classes long enough to be like themselves
    whole = materialise(members.join(described.select("cls"), "cls"), "p3-members")
    discard(members, described, likely)
    return links, whole


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs record_a < record_b of long enough bodies whose likeness reaches the threshold.

    Null, empty and short bodies take no part; equal bodies are alike; only record_id and body are read.
    """
    links, members = class_links(table(spark, sf_dir, "tape_records").select("record_id", "body"))
    a, b = members.select(F.col("cls").alias("a"), F.col("record_id").alias("ra")), members.select(F.col("cls").alias("b"), F.col("record_id").alias("rb"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b"))
    many = members.where(F.col("n") > 1)
    copies = many.select("cls", F.col("record_id").alias("record_a")).join(many.select("cls", F.col("record_id").alias("record_b")), "cls").where(F.col("record_a") < F.col("record_b"))
    return across.unionByName(copies.select("record_a", "record_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each long enough record its class of equal bodies, its group (the smallest record it is linked to, in any number of steps) and its links."""
    links, members = class_links(table(spark, sf_dir, "tape_records").select("record_id", "body"))
    grouped = components(members.select(F.col("cls").alias("node")), links.select("a", "b", F.lit(1.0).alias("w")))
    sizes = members.select("cls", "n").distinct()
    both = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionAll(links.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    others = both.join(sizes.select(F.col("cls").alias("other"), "n"), "other").groupBy("cls").agg(F.sum("n").alias("others"))
    out = members.join(grouped.select(F.col("node").alias("cls"), F.col("component").alias("grp")), "cls").join(others, "cls", "left")
    return out.select("record_id", "cls", "grp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document with long enough records their number and the share that some other record retells."""
    groups = p3_groups(spark, sf_dir)
    of = table(spark, sf_dir, "tape_records").where("doc_id >= 0").select("record_id", "doc_id")
    return of.join(groups, "record_id").groupBy("doc_id").agg(F.count("*").alias("records"), F.round(F.avg((F.col("links") > 0).cast("double")), 6).alias("retelling_share"))
