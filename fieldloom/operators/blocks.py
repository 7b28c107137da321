"""Blocks of vectors in files that all executors share, and exact searches over them.

Each row is written once, with the rows near the same centre; a task holds one block of queries and reads one block of data after
another from the shared folder, so no row is copied from block to block. Of a unit (the rows of a centre in a block) with mean direction m
and radius r no row x has q.x above q.m + |q| r: units whose bound is below what a query has already are left out. Any centres
give the exact result; good ones leave out more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldloom.session import discard, materialise

#: Rows that centres are fitted on, and the cosine from which a row belongs to its nearest centre; nearer than CORE it is in the inner ring.
SAMPLE_ROWS, NEAR, CORE = 8192, 0.70, 0.85
#: Rows of queries and of data multiplied at a time.
STRIP, STEP = 1024, 2048
#: What products in single precision may be off, for vectors of length 1.
SLACK = 2e-5


def as_matrix(column) -> np.ndarray:
    """Rows of doubles from a list column of equally long vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def pack(rows: DataFrame, vec: str) -> DataFrame:
    """rows with the vectors of vec as bytes, and their length as dim: floats as float16 where that loses nothing, else as they are."""
    wide = rows.dtypes[rows.columns.index(vec)][1] == "array<double>"
    names = [c for c in rows.columns if c != vec]

    def run(batches):
        for b in batches:
            dim = len(b.column(b.num_columns - 1)[0]) if b.num_rows else 1
            x = np.ascontiguousarray(as_matrix(b.column(b.num_columns - 1)), np.float64 if wide else np.float32)
            with np.errstate(over="ignore"):
                half = x.astype(np.float16)
            short = np.zeros(len(x), bool) if wide else (half == x).all(1)
            if len(x) and (short.all() or not short.any()):
                y = half if short.all() else x
                offsets = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (y.itemsize * dim))
                column = pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(np.ascontiguousarray(y))])
            else:
                column = pa.array([h.tobytes() if s else r.tobytes() for h, r, s in zip(half, x, short)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], column, pa.array(np.full(len(x), dim), pa.int32())], names=[*names, vec, "dim"])

    kinds = dict(rows.dtypes)
    return rows.select(*names, vec).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f"{', ' * bool(names)}`{vec}` binary, dim int")


def unpack(column, dim: int) -> np.ndarray:
    """Rows of doubles from a column that pack() made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dim))
    large = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    data, size = np.frombuffer(column.buffers()[2], np.uint8), np.diff(offsets)
    for kind in (np.float16, np.float32, np.float64):
        if (size == dim * np.dtype(kind).itemsize).all():
            return np.ascontiguousarray(data[offsets[0] : offsets[-1]]).view(kind).reshape(-1, dim).astype(np.float64)
    out = np.empty((len(column), dim))
    for kind in (np.float16, np.float32, np.float64):
        at = np.flatnonzero(size == dim * np.dtype(kind).itemsize)
        out[at] = data[offsets[at][:, None] + np.arange(dim * np.dtype(kind).itemsize)].view(kind)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(1)) + 1e-9)[:, None]


def fit_centres(sample: np.ndarray, floor: float = 0.80, least: int = 3) -> np.ndarray:
    """Unit centres of the dense places of a sample, densest first."""
    x = unit_rows(sample).astype(np.float32)
    near = np.concatenate([(x[s : s + 512] @ x.T >= floor).sum(1) for s in range(0, len(x), 512)]) if len(x) else np.zeros(0, int)
    free, centres = near >= least, []
    for i in np.argsort(-near, kind="stable"):
        if free[i]:
            members = x @ x[i] >= floor
            mean = x[members].mean(0)
            centres.append(mean / np.linalg.norm(mean))
            free &= x @ centres[-1] < floor
            free[i] = False
    return np.asarray(centres, np.float32).reshape(len(centres), x.shape[1])


@dataclass
class Side:
    """A table in blocks: its files, the units of each block (block, unit, n, least and most pos), their means and radii."""

    files: DataFrame
    blocks: int
    of_block: list[np.ndarray]
    mean: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    longest: float
    centres: np.ndarray


@dataclass
class Block:
    """Rows in the order of their units; span gives each unit's place."""

    x: np.ndarray
    x32: np.ndarray
    units: np.ndarray
    columns: dict[str, np.ndarray]

    def spans(self):
        edges = np.flatnonzero(np.r_[True, self.units[1:] != self.units[:-1], True])
        return [(int(self.units[a]), int(a), int(b)) for a, b in zip(edges, edges[1:])]


def sample(rows: DataFrame, vec: str, n: int) -> np.ndarray:
    """At most SAMPLE_ROWS vectors by a hash of the id, to fit centres on."""
    part = rows if n <= SAMPLE_ROWS else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE_ROWS / n))
    got = part.select(vec, "dim").limit(2 * SAMPLE_ROWS).toArrow()
    return unpack(got.column(0), got.column(1)[0].as_py() if len(got) else 1)


def write(rows: DataFrame, vec: str, scaled: bool, centres: np.ndarray, block: int, by_pos: bool = False) -> Side:
    """rows (id, extra columns of bigint, vec as pack() has it) in blocks of about `block` rows. scaled: vectors are divided by their length + 1e-9.

    by_pos: blocks of the same unit are ranges of pos.
    """
    extra, dim = [c for c in rows.columns if c not in ("id", vec, "dim")], centres.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # fitted on SAMPLE_ROWS

    def place(batches):
        c = shared.value
        for b in batches:
            x = unpack(b.column(b.num_columns - 1), dim)
            x = unit_rows(x) if scaled else x
            cell, dot, n2 = np.full(len(x), -1), np.zeros(len(x)), (x * x).sum(1)
            if len(c) and len(x):
                cos = x.astype(np.float32) @ c.T
                at = cos.argmax(1)
                dot = (x * c[at]).sum(1)
                near = dot >= NEAR * np.sqrt(n2)
                cell = np.where(near, 2 * at + (dot < CORE * np.sqrt(n2)), -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(dot), pa.array(n2)], names=[*b.schema.names, "cell", "dot", "n2"])

    names = ["id", *extra, vec]
    placed = rows.select(*names).mapInArrow(place, ", ".join(f"`{c}` bigint" for c in ["id", *extra]) + f", `{vec}` binary, cell int, dot double, n2 double")
    low = F.min("pos") if "pos" in extra else F.lit(0)
    high = F.max("pos") if "pos" in extra else F.lit(0)
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.avg("dot").alias("mid"), F.min("dot").alias("least"), F.max("n2").alias("n2"), low.alias("low"), high.alias("high")).orderBy("cell").collect()  # a row a ring
    plan, at, room = [], 0, 0  # unit = its number among (ring, part); small rings share a block
    for s in stats:
        parts = max(1, -(-s.n // block))
        if parts > 1 or room + s.n > block:
            at, room = at + (room > 0), 0
        for p in range(parts):
            plan.append((s.cell, p, parts, len(plan), at, s.low or 0, s.high or 0))
            if parts > 1:
                at += 1
        room = 0 if parts > 1 else room + s.n
    blocks = max([p[4] for p in plan], default=-1) + 1
    told = {s.cell: s for s in stats}
    mean, radius = np.zeros((len(plan), centres.shape[1]), np.float64), np.zeros(len(plan))
    for cell, _, _, u, _, _, _ in plan:
        s = told[cell]
        a = s.mid if cell >= 0 else 0.0
        c = centres[cell // 2].astype(np.float64) * a if cell >= 0 else np.zeros(centres.shape[1])
        mean[u], radius[u] = c, np.sqrt(max(s.n2 - 2 * a * s.least + c @ c, 0.0)) + 1e-6
    table = F.broadcast(rows.sparkSession.createDataFrame([(c, p, n, u, b, lo, hi) for c, p, n, u, b, lo, hi in plan] or [(-2, 0, 1, 0, 0, 0, 0)], "cell int, part int, parts int, unit int, block int, low bigint, high bigint"))  # a row a unit
    share = (F.col("pos") - F.col("low")) / (F.col("high") - F.col("low") + 1) if by_pos else F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(1 << 20)
    sizes = F.broadcast(rows.sparkSession.createDataFrame(sorted({(c, n, lo, hi) for c, _, n, _, _, lo, hi in plan}) or [(-2, 1, 0, 0)], "cell int, parts int, low bigint, high bigint"))
    numbered = placed.join(sizes, "cell").withColumn("part", F.floor(share * F.col("parts")).cast("int"))
    out = numbered.join(table.select("cell", "part", "unit", "block"), ["cell", "part"]).select("block", "unit", *names)
    files = materialise(out.repartition(max(1, min(blocks, 200)), "block"), "blocks", "block")
    first = np.full(len(plan), np.iinfo(np.int64).min)
    if by_pos:
        for r in files.groupBy("unit").agg(F.min("pos").alias("pos")).collect():  # a row a unit
            first[r.unit] = r.pos
    of_block = [np.array([p[3] for p in plan if p[4] == b]) for b in range(blocks)]
    return Side(files, blocks, of_block, mean, radius, first, float(np.sqrt(max([s.n2 for s in stats], default=0.0))), centres)


def caps(q: np.ndarray, size: np.ndarray, mean: np.ndarray, radius: np.ndarray, centres: np.ndarray, longest: float) -> np.ndarray:
    """What the product of each query with a row of each unit is at most.

    A unit without a mean holds rows that lie beyond the angle of NEAR from every centre: a query at a smaller angle from one is at
    least the difference away from them.
    """
    cap = q @ mean.T + size[:, None] * radius
    outside = ~mean.any(1)
    if len(centres) and outside.any():
        cos = (q @ centres.T).max(1) / np.maximum(size, 1e-12)
        apart = np.maximum(np.arccos(NEAR + 1e-5) - np.arccos(np.clip(cos - 1e-5, -1, 1)), 0)
        cap[:, outside] = np.minimum(cap[:, outside], (size * longest * np.cos(apart) + 1e-5)[:, None])
    return cap.astype(np.float32)


def reader(side: Side, vec: str, scaled: bool):
    """A function that reads a block; it runs in tasks."""
    jvm, session = side.files.sparkSession._jvm, side.files.sparkSession._jsparkSession
    at = jvm.org.apache.hadoop.fs.Path(side.files.written_at)
    at = at.getFileSystem(session.sessionState().newHadoopConf()).makeQualified(at).toString()
    dim = side.centres.shape[1]

    def read(block: int) -> Block:
        from pyarrow import fs, parquet

        system, path = fs.FileSystem.from_uri(f"{at.replace('file:/', 'file:///') if at.startswith('file:/') and not at.startswith('file://') else at}/block={block}")
        files = [f for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
        t = pa.concat_tables([parquet.read_table(f.path, filesystem=system, partitioning=None) for f in files])
        order = np.lexsort((t.column("id").to_numpy(), t.column("unit").to_numpy()))
        x = unpack(t.column(vec), dim)[order]
        x = unit_rows(x) if scaled else x
        return Block(x, x.astype(np.float32), t.column("unit").to_numpy()[order], {c: t.column(c).to_numpy()[order] for c in t.column_names if c not in ("unit", vec)})

    return read


class Best:
    """The k best of each query so far."""

    def __init__(self, n: int, k: int, floor: float | None, slack: float):
        self.w, self.nbr = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.k, self.floor, self.slack = k, -np.inf if floor is None else floor, slack
        self.least = np.full(n, self.floor - slack, np.float32)

    def add(self, row: np.ndarray, w: np.ndarray, nbr: np.ndarray) -> None:
        good = w >= self.floor
        row, w, nbr = row[good], w[good], nbr[good]
        if not row.size:
            return
        touched = np.unique(row)
        row = np.r_[row, np.repeat(touched, self.k)]
        w, nbr = np.r_[w, self.w[touched].ravel()], np.r_[nbr, self.nbr[touched].ravel()]
        order = np.lexsort((nbr, -w, row))
        row, w, nbr = row[order], w[order], nbr[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(row.size) - np.repeat(starts, np.diff(np.r_[starts, row.size]))
        keep = rank < self.k
        self.w[row[keep], rank[keep]], self.nbr[row[keep], rank[keep]] = w[keep], nbr[keep]
        self.least[touched] = np.maximum(self.least[touched], np.maximum(self.w[touched, -1], self.floor) - self.slack)


def topk(queries: Side, data: Side, q_vec: tuple[str, bool], d_vec: tuple[str, bool], k: int, floor: float | None, digits: int, earlier: bool, same: bool, own: bool = False) -> DataFrame:
    """(q, nbr, w) of queries and data with columns id, grp and pos, as knn.block_topk() has it. same: both sides are one table. Of queries with a column bar only rows from there on, in units of the last digit, are sought.

    own: the data is a part of the queries' table, and of its rows only those come out that a query's own unit doesn't keep from the k best.
    """
    spark = queries.files.sparkSession
    read_q, read_d = reader(queries, *q_vec), reader(data, *d_vec)
    shared = spark.sparkContext.broadcast((data.mean.astype(np.float32), data.radius, data.first, data.of_block, data.centres, data.longest, queries.mean.any(1)))
    slack = SLACK * max(1.0, queries.longest * data.longest) + 0.5 * 10.0**-digits

    def run(batches):
        mean, radius, first, of_block, centres, longest, round_centre = shared.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                q = read_q(number)
                qc = q.columns
                best, bar = Best(len(q.x), k, floor, slack), np.full(len(q.x), -np.inf)
                if "bar" in qc:
                    best.least = np.maximum(best.least, qc["bar"] * 10.0**-digits - slack).astype(np.float32)
                size = np.sqrt((q.x * q.x).sum(1))
                cap = caps(q.x32, size, mean, radius, centres, longest)
                meets = (cap >= best.least[:, None]).any(1)
                for u, start, end in q.spans() if own else []:
                    for s in range(start, end, STRIP) if round_centre[u] else []:
                        rows = np.arange(s, min(end, s + STRIP))
                        rows = rows[meets[rows]]
                        if not rows.size:
                            continue
                        sims = q.x32[rows] @ q.x32[start:end].T
                        sims[qc["grp"][rows][:, None] == qc["grp"][start:end][None, :]] = -np.inf
                        if end - start > k:
                            bar[rows] = np.partition(sims, end - start - k, axis=1)[:, end - start - k]
                bar = np.where(bar > -np.inf, bar - slack, -np.inf)
                best.least = np.maximum(best.least, bar - slack).astype(np.float32)
                toward = (q.x32 @ mean.T).astype(np.float32)
                score = (toward.mean(0) if same else toward.max(0)) if len(mean) else np.zeros(0)
                order = sorted(range(len(of_block)), key=lambda b: (not (same and b == number), -max(score[of_block[b]], default=0)))
                for b in order:
                    wanted = set()
                    for u in of_block[b]:
                        may = cap[:, u] >= best.least
                        if earlier:
                            may &= qc["pos"] > first[u]
                        if may.any():
                            wanted.add(int(u))
                    if not wanted:
                        continue
                    d = q if same and b == number else read_d(b)
                    dc = d.columns
                    for u, start, end in d.spans():
                        if u not in wanted:
                            continue
                        s, step = start, 128  # a short first step gives every query a bound
                        while s < end:
                            to = min(end, s + step)
                            may = cap[:, u] >= best.least
                            if earlier:
                                may &= qc["pos"] > dc["pos"][s:to].min()
                            at = np.flatnonzero(may)
                            y = d.x32[s:to].T.copy()
                            for a in range(0, at.size, STRIP):
                                rows = at[a : a + STRIP]
                                sims = q.x32[rows] @ y
                                hit = sims >= best.least[rows][:, None]
                                if np.count_nonzero(hit) > sims.size // 20:
                                    sims[qc["grp"][rows][:, None] == dc["grp"][s:to][None, :]] = -np.inf
                                    if earlier:
                                        sims[dc["pos"][s:to][None, :] >= qc["pos"][rows][:, None]] = -np.inf
                                    hit = sims >= best.least[rows][:, None]
                                    if sims.shape[1] > k:
                                        hit &= sims >= (np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k] - 2 * slack)[:, None]
                                    hit &= sims > -np.inf
                                r, c = np.divmod(np.flatnonzero(hit), to - s)
                                r, c = rows[r], c + s
                                ok = qc["grp"][r] != dc["grp"][c]
                                if earlier:
                                    ok &= dc["pos"][c] < qc["pos"][r]
                                r, c = r[ok], c[ok]
                                if r.size:
                                    w = np.concatenate([np.einsum("ij,ij->i", q.x[r[i : i + 65536]], d.x[c[i : i + 65536]]) for i in range(0, r.size, 65536)])
                                    best.add(r, np.round(w, digits), dc["id"][c])
                            s, step = to, STEP
                r, c = np.nonzero((best.w > -np.inf) & (best.w >= bar[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(qc["id"][r], pa.int64()), pa.array(best.nbr[r, c], pa.int64()), pa.array(best.w[r, c])], names=["q", "nbr", "w"])

    return spark.range(0, queries.blocks, 1, max(1, queries.blocks)).mapInArrow(run, "q bigint, nbr bigint, w double")


def pairs(side: Side, vec: tuple[str, bool], low: float, high: float, k: int, digits: int) -> DataFrame:
    """(a, b, w): of each block of rows (id, grp, label) and those after it the k best pairs, as knn.band_pairs() has it."""
    spark = side.files.sparkSession
    read = reader(side, *vec)
    shared = spark.sparkContext.broadcast((side.mean.astype(np.float32), side.radius, side.of_block, side.centres, side.longest))
    slack = SLACK * max(1.0, side.longest**2) + 0.5 * 10.0**-digits

    def run(batches):
        mean, radius, of_block, centres, longest = shared.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                q = read(number)
                qc = q.columns
                cap = caps(q.x32, np.sqrt((q.x * q.x).sum(1)), mean, radius, centres, longest)
                kept, least = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), low
                for b in range(number, len(of_block)):
                    wanted = {int(u) for u in of_block[b] if (cap[:, u] >= least - slack).any()}
                    if not wanted:
                        continue
                    d = q if b == number else read(b)
                    dc = d.columns
                    for u, start, end in d.spans():
                        if u not in wanted:
                            continue
                        for s in range(start, end, STEP):
                            to = min(end, s + STEP)
                            at = np.flatnonzero(cap[:, u] >= least - slack)
                            y = d.x32[s:to].T.copy()
                            for a in range(0, at.size, STRIP):
                                rows = at[a : a + STRIP]
                                sims = q.x32[rows] @ y
                                hit = (sims >= least - slack) & (sims < high + slack)
                                if np.count_nonzero(hit) > sims.size // 20:
                                    hit &= qc["label"][rows][:, None] != dc["label"][s:to][None, :]
                                r, c = np.divmod(np.flatnonzero(hit), to - s)
                                r, c = rows[r], c + s
                                ok = (qc["grp"][r] != dc["grp"][c]) & (qc["label"][r] != dc["label"][c])
                                if b == number:
                                    ok &= qc["id"][r] < dc["id"][c]
                                r, c = r[ok], c[ok]
                                for i in range(0, r.size, 65536):
                                    x, z = r[i : i + 65536], c[i : i + 65536]
                                    w = np.round(np.einsum("ij,ij->i", q.x[x], d.x[z]), digits)
                                    ok = (w >= least) & (w < high)
                                    i1, i2 = qc["id"][x][ok], dc["id"][z][ok]
                                    p, o, w = (np.concatenate(t) for t in zip(kept, (np.minimum(i1, i2), np.maximum(i1, i2), w[ok])))
                                    first = np.lexsort((-o, -p, -w))[:k]
                                    kept = p[first], o[first], w[first]
                                    least = max(low, kept[2][-1]) if len(kept[2]) == k else low
                yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1]), pa.array(kept[2])], names=["a", "b", "w"])

    return spark.range(0, side.blocks, 1, max(1, side.blocks)).mapInArrow(run, "a bigint, b bigint, w double")


def finish(found: DataFrame, name: str, *sides: Side) -> DataFrame:
    """The result written down, and the blocks it was found in dropped."""
    out = materialise(found, name)
    discard(*(s.files for s in sides))
    return out
