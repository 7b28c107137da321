"""Exact top-k joins of vectors by blocks of both sides, as matrix products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from fieldloom.operators import blocks
from fieldloom.session import discard, materialise

#: Rows of a block; a task holds one block of queries and one of data.
BLOCK = 16384


def block_topk(queries: DataFrame, data: DataFrame, k: int, floor: float | None = None, block: int = BLOCK, digits: int = 6, earlier: bool = False) -> DataFrame:
    """(q, nbr, w): of each query the k best of the data by dot product descending, then nbr ascending.

    Both sides are (id bigint, grp bigint, pos bigint, v array<double>), or raw array<float> in place of v for vectors to be normalised: rows of equal grp are never neighbours (give
    each row its own to allow all); with earlier=True only data of a smaller pos are. Vectors must all have the same
    length; rows whose id or v is null are dropped; ids must be unique on each side. Each side is written once in
    blocks; a block of queries is one task, reads those data blocks that can hold a better row, and returns k rows a query.
    """
    same = queries is data
    d = _dense(data, ["id", "grp", "pos"])
    q = d if same else _dense(queries, ["id", "grp", "pos"])
    centres = _centres(d, block, _width(q))
    right = blocks.write(*d, centres, block, by_pos=earlier)
    left = right if same else blocks.write(*q, centres, block, by_pos=earlier)
    discard(d[0], q[0])
    found = blocks.topk(left, right, q[1:], d[1:], k, floor, digits, earlier, same)
    return blocks.finish(found, "topk", *([right] if same else [left, right]))


class Field:
    """A table as block_topk() has it in blocks, to find the lists of some of its rows and those that name some of them."""

    def __init__(self, rows: DataFrame, k: int, block: int = BLOCK, digits: int = 6):
        self.k, self.block, self.digits = k, block, digits
        rows, self.vec, self.scaled = dense = _dense(rows, ["id", "grp", "pos"])
        self.centres = _centres(dense, block)
        self.side = blocks.write(*dense, self.centres, block)
        discard(rows)

    def part(self, ids: DataFrame) -> blocks.Side:
        """The rows of ids (id, and bar if there is one) in blocks, small enough for many tasks."""
        rows = materialise(self.side.files.select("id", "grp", "pos", self.vec).join(ids.distinct(), "id"), "part")
        side = blocks.write(rows, self.vec, self.scaled, self.centres, max(256, min(self.block, -(-rows.count() // 24))))
        discard(rows)
        return side

    def lists(self, ids: DataFrame, floor: float | None) -> DataFrame:
        """(q, nbr, w): the k best of each row of ids, as block_topk(rows, rows, k, floor) has them; those from bar on (in units of the last digit) if ids has it."""
        left, vec = self.part(ids), (self.vec, self.scaled)
        return blocks.finish(blocks.topk(left, self.side, vec, vec, self.k, floor, self.digits, False, False), "lists", left)

    def listed_by(self, ids: DataFrame, floor: float | None, among: DataFrame | None = None) -> DataFrame:
        """(q, nbr, w): the entries of block_topk(rows, rows, k, floor) whose nbr is among ids; only those whose q is in among, if that is given.

        Rows that ids are near enough to, as far as their own unit tells, get their lists down to the farthest of these; no others do.
        """
        right, vec = self.part(ids), (self.vec, self.scaled)
        left = self.side if among is None else self.part(among)
        near = blocks.finish(blocks.topk(left, right, vec, vec, self.k, floor, self.digits, False, False, own=True), "near", right, *[left] * (among is not None))
        bars = materialise(near.groupBy(F.col("q").alias("id")).agg(F.round(F.min("w") * 10.0**self.digits).cast("bigint").alias("bar")), "bars")
        found = self.lists(bars, floor).join(ids.select(F.col("id").alias("nbr")).distinct(), "nbr", "left_semi").select("q", "nbr", "w")
        discard(near, bars)
        return found

    def close(self) -> None:
        discard(self.side.files)


def _dense(rows: DataFrame, names: list[str]) -> tuple[DataFrame, str, bool]:
    """The usable rows with their vectors as bytes, written down once, those not yet scaled if there are such; the vectors' name; whether they are to be scaled."""
    vec = "raw" if "raw" in rows.columns else "v"
    packed = dict(rows.dtypes)[vec] == "binary"
    there = [F.col(c).isNotNull() for c in ("id", vec, *[c for c in names if c == "label"])]
    kept = rows.select(*(F.col(c).cast("bigint").alias(c) for c in names), vec, *["dim"] * packed)
    for x in there:
        kept = kept.where(x)
    return materialise(kept if packed else blocks.pack(kept, vec), "vectors"), vec, vec == "raw"


def _width(dense: tuple[DataFrame, str, bool]) -> int:
    one = dense[0].select("dim").first()
    return one[0] if one else 1


def _centres(dense: tuple[DataFrame, str, bool], block: int, least: int = 1) -> np.ndarray:
    n = dense[0].count()
    centres = blocks.fit_centres(blocks.sample(dense[0], dense[1], n)) if n > block else np.zeros((0, 1))
    return centres if len(centres) else np.zeros((0, max(least, _width(dense))), np.float32)


def band_pairs(rows: DataFrame, low: float, high: float, k: int, block: int = BLOCK, digits: int = 6) -> DataFrame:
    """(a, b, w), a < b: of all pairs of different grp and label at low <= w < high the k best by w, a and b descending.

    rows: (id bigint, grp bigint, label bigint, v array<double> or raw array<float>). The band and both tests hold inside each pair of blocks before
    its k best are taken, so pairs outside the band, however many, displace none.
    """
    one, vec, scaled = dense = _dense(rows, ["id", "grp", "label"])
    side = blocks.write(one, vec, scaled, _centres(dense, block), block)
    discard(one)
    found = blocks.finish(blocks.pairs(side, (vec, scaled), low, high, k, digits), "band", side)
    return found.orderBy(F.desc("w"), F.desc("a"), F.desc("b")).limit(k)


def either_lists(near: DataFrame, floor: float | None = None) -> DataFrame:
    """Undirected edges (a, b, w), a < b, kept if either end lists the other."""
    kept = near if floor is None else near.where(F.col("w") >= floor)
    return kept.select(F.least("q", "nbr").alias("a"), F.greatest("q", "nbr").alias("b"), "w").groupBy("a", "b").agg(F.max("w").alias("w"))


def both_list(near: DataFrame, floor: float | None = None) -> DataFrame:
    """Undirected edges (a, b, w), a < b, kept if both ends list each other: no hub can gather the graph."""
    kept = near if floor is None else near.where(F.col("w") >= floor)
    pairs = kept.select(F.least("q", "nbr").alias("a"), F.greatest("q", "nbr").alias("b"), "w")
    return pairs.groupBy("a", "b").agg(F.max("w").alias("w"), F.count("*").alias("n")).where(F.col("n") == 2).drop("n")


def best_past(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(q, nbr, w): of each row its best match among the rows of smaller pos."""
    return block_topk(chunks, chunks, 1, block=block, earlier=True)


def digest(hits: list[tuple[int, int]]) -> str:
    """FNV-1a, 64 bits, over the little-endian 32-bit words of (id, score) of an ordered list of hits (a top-k, so a bounded one)."""
    h = 1469598103934665603  # Fixed values: offset basis and prime of the scan's digest.
    for byte in np.array(hits, np.int64).astype(np.uint32).astype("<u4").tobytes():
        h = (h ^ byte) * 1099511628211 % (1 << 64)
    return f"{h:016x}"


def two_pass(coarse: DataFrame, fine: DataFrame, coarse_query: DataFrame, fine_query: DataFrame, score, coarse_k: int, final_k: int, id_col: str = "id") -> DataFrame:
    """(id, score): the coarse_k best of the coarse vectors, scored anew on the fine ones: final_k best. Tables are (id, v), queries one-row (query)."""
    first = scan(coarse, coarse_query, score, coarse_k, id_col).select(id_col)
    return scan(fine.join(F.broadcast(first), id_col, "left_semi"), fine_query, score, final_k, id_col)


def scan(data: DataFrame, query: DataFrame, score, k: int, id_col: str) -> DataFrame:
    """One query vector (a one-row table with column query) against all rows: k best by score descending, id ascending."""
    return data.join(F.broadcast(query)).select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(max(k, 0))
