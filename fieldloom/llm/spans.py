"""Problem 4: long stretches that recur, character for character, in other records.

Suffix trees divided by prefixes. Sparse: of each run of SPAN characters the smallest hash among its substrings of PREFIX
characters names an anchor, so equal runs name equal anchors, and each run has exactly one; only the suffixes of runs whose
anchor two records share are sent, as one stretch of text an anchor. A group holds the suffixes that share a prefix: PREFIX
characters at first. Where more than HOT_ROWS stretches share it, the runs are halved by where the anchor lies in them: the
runs of each half have a longer substring in common (half way to SPAN, then three quarters, ...), which is their new
prefix, until the groups fit or the prefix is the whole run. In a group the suffixes are sorted by their characters; the
internal nodes of depth SPAN or more are the stretches of that order with common prefixes so long, and those with
more than one record below are the repeats. Hashes divide the work; characters decide. Equal bodies go in once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldloom.llm import text as X
from fieldloom.session import discard, materialise
from fieldloom.sources.tables import table

SPAN, PREFIX = 200, 100
#: Code points that are hashed at once, and runs that one task sorts about, prefix by prefix.
CHUNK, GROUP_RUNS = 1 << 19, 1 << 20
#: Stretches of one prefix that are sorted together.
HOT_ROWS = 2048


def _chunks(ids: list[int], bodies: list[str], span: int):
    """Bodies of at least `span` code points, joined to arrays of about CHUNK: (ids, starts, code points)."""
    at, parts, size = [], [], 0
    for i, body in zip(ids, bodies):
        if body is None or len(body) < span:
            continue
        if size and size + len(body) > CHUNK:
            yield at, parts
            at, parts, size = [], [], 0
        at.append(i), parts.append(X.code_points(body))
        size += len(body)
    if at:
        yield at, parts


def _anchors(parts: list[np.ndarray], span: int, prefix: int):
    """Of joined bodies: their starts, and for each anchor its hash, position, first and last run (joined positions), and its body's number."""
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths) - lengths
    points = np.concatenate(parts)
    hashes = X.window_hashes(points, prefix)
    bits = np.uint64(max(20, int(len(points)).bit_length()))
    packed = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
    width, size, best = span - prefix + 1, 1, packed
    while 2 * size <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    at = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # anchor of the run at each position
    owner = np.repeat(np.arange(len(parts)), np.maximum(lengths - span + 1, 0))
    run = np.concatenate([s + np.arange(n - span + 1) for s, n in zip(starts, lengths)])
    named = at[run]
    first = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:], len(run)] - 1
    return starts, hashes[named[first]], named[first], run[first], run[last], owner[first]


def _thin(span: int, prefix: int):
    def run(batches):
        for b in batches:
            for ids, parts in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist(), span):
                starts, h, at, lo, hi, own = _anchors(parts, span, prefix)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.array(ids, np.int64)[own]), pa.array((lo - starts[own]).astype(np.int32)), pa.array((hi - starts[own]).astype(np.int32)), pa.array((at - starts[own]).astype(np.int32))],
                    names=["prefix", "record_id", "low", "high", "anchor"],
                )

    return run


STRETCH = "prefix bigint, record_id bigint, other bigint, low int, anchor int, near int, far int, text string"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    names = [c.split()[0] for c in STRETCH.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=names)


def _stretches(span: int, prefix: int):
    """(record_id, body, anchors) to a row per anchor with the text of its runs, which start up to span - prefix before the anchor."""

    def run(batches):
        for b in batches:
            columns = (b.column(k).to_pylist() for k in range(3))
            yield _table([(a["prefix"], i, a["other"], a["low"], a["anchor"], 0, span - prefix, body[a["low"] : a["high"] + span]) for i, body, anchors in zip(*columns) for a in anchors])

    return run


def _halved(span: int):
    """Stretches whose runs start `near` to `far` before the anchor to stretches of the nearer and of the farther half.

    The new prefix is what all runs of a half have in common.
    """

    def run(batches):
        for b in batches:
            out = []
            for i, other, low, anchor, near, far, text in zip(*(b.column(k).to_pylist() for k in range(1, 8))):
                high, middle = low + len(text) - span, (near + far) // 2
                for n, f in ((near, middle), (middle + 1, far)):
                    s, e = max(low, anchor - f), min(high, anchor - n)
                    if s <= e:
                        common = text[anchor - n - low : anchor - f + span - low]
                        key = xxhash.xxh3_64_intdigest(f"{n} {f} {common}".encode()) - (1 << 63)
                        out.append((key, i, other, s, anchor, n, f, text[s - low : e - low + span]))
            yield _table(out)

    return run


def deep_nodes(texts: list[str], span: int):
    """Internal nodes of depth `span` or more in the suffix tree of the texts' runs: lists of (text number, start)."""
    suffixes = sorted((t[j:], o, j) for o, t in enumerate(texts) for j in range(len(t) - span + 1))
    node: list[tuple[int, int]] = []
    head = None
    for s, o, j in suffixes:
        if head is not None and s.startswith(head):
            node.append((o, j))
            continue
        if len(node) > 1:
            yield node
        node, head = [(o, j)], s[:span]
    if len(node) > 1:
        yield node


def _repeats(span: int):
    def run(group: pa.Table) -> pa.Table:
        key = np.asarray(group.column("prefix"))
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        ids, others, low = (np.asarray(group.column(c)) for c in ("record_id", "other", "low"))
        texts = group.column("text").to_pylist()
        out: list[tuple[int, int, int]] = []
        for s, e in zip(starts, np.r_[starts[1:], len(key)]):
            at = order[s:e]
            if ids[at].min() == others[at].max():
                continue
            # equal stretches of several records are repeats as a whole, and one leaf for the rest
            rows_of: dict[str, list[int]] = {}
            for k in at.tolist():
                rows_of.setdefault(texts[k], []).append(k)
            leaves = list(rows_of)
            least, most = np.array([ids[r].min() for r in rows_of.values()]), np.array([others[r].max() for r in rows_of.values()])
            for t, k, a, b in zip(leaves, rows_of.values(), least, most):
                if a != b:
                    out += [(int(ids[r]), int(low[r]), int(low[r]) + len(t)) for r in k]
            if len(leaves) == 1:
                continue
            hit: dict[int, list[int]] = {}
            for node in deep_nodes(leaves, span):
                under = [o for o, _ in node]
                if least[under].min() != most[under].max():
                    for o, j in node:
                        if least[o] == most[o]:
                            hit.setdefault(o, []).append(j)
            for o, found in hit.items():
                js = np.sort(np.array(found))
                cut = np.flatnonzero(np.diff(js) > 1)
                for a, b in zip(js[np.r_[0, cut + 1]], js[np.r_[cut, js.size - 1]]):
                    out += [(int(ids[r]), int(low[r] + a), int(low[r] + b) + span) for r in rows_of[leaves[o]]]
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("record_id", "s", "e"), columns)})

    return run


def shared_spans(records: DataFrame, key: str = "record_id", body: str = "body", span: int = SPAN, prefix: int = PREFIX, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(record_id, span_start, span_end): maximal stretches covered by runs of `span` characters that another record holds too.

    Null bodies and bodies of fewer than `span` characters give no row; runs that repeat only in their own record don't
    count; null keys are dropped and keys must be unique. Only key and body are read. Characters are compared, not hashes
    (but for equal bodies, which are told by 128 bits).
    """
    source = records.where(F.col(key).isNotNull() & (F.length(body) >= span)).select(F.col(key).cast("bigint").alias("record_id"), F.col(body).alias("body"))
    hashed = source.select("record_id", F.length("body").alias("chars"), F.xxhash64("body").alias("h1"), F.substring(F.md5("body"), 1, 16).alias("h2"))
    classes = hashed.groupBy("h1", "h2").agg(F.min("record_id").alias("cls"), F.max("record_id").alias("other"))
    copies = hashed.join(classes.where("cls <> other"), ["h1", "h2"]).select("record_id", F.lit(0).cast("bigint").alias("s"), F.col("chars").cast("bigint").alias("e"))
    firsts = materialise(classes.select(F.col("cls").alias("record_id"), "other"), "p4-classes")
    thin = materialise(source.mapInArrow(_thin(span, prefix), "prefix bigint, record_id bigint, low int, high int, anchor int"), "p4-anchors")
    shared = thin.groupBy("prefix").agg(F.min("record_id").alias("a"), F.max("record_id").alias("b")).where("a <> b").select("prefix")
    hits = thin.join(shared, "prefix", "left_semi").join(firsts, "record_id")
    lists = hits.groupBy("record_id").agg(F.collect_list(F.struct("prefix", "other", "low", "high", "anchor")).alias("anchors"))
    rows = source.join(lists, "record_id").select("record_id", "body", "anchors").mapInArrow(_stretches(span, prefix), STRETCH)
    rows, found, used = materialise(rows, "p4-stretches"), copies, [thin, firsts]
    single = None
    while True:
        counts = rows.groupBy("prefix").agg(F.count("*").alias("n"), F.sum(F.length("text") - span + 1).alias("runs"))
        counts = materialise(counts.where("n > 1"), "p4-counts")
        total = counts.agg(F.sum("runs")).first()[0] or 0
        groups = max(1, -(-int(total) // GROUP_RUNS) * 4)
        fits = rows.join(counts.where(F.col("n") <= hot_rows).select("prefix"), "prefix", "left_semi").withColumn("grp", F.pmod("prefix", F.lit(groups)).cast("int"))
        now = materialise(fits.groupBy("grp").applyInArrow(_repeats(span), "record_id bigint, s bigint, e bigint"), "p4-found")
        found = found.unionByName(now)
        hot = counts.where(F.col("n") > hot_rows).select("prefix")
        if not hot.limit(1).count():
            break
        halves = materialise(rows.join(hot, "prefix", "left_semi").select(*rows.columns).mapInArrow(_halved(span), STRETCH), "p4-halves")
        # a whole run is its own prefix: all that is left to know is whether two records hold it
        whole = halves.where("near = far").select("record_id", "other", "low", "text")
        single = whole if single is None else single.unionByName(whole)
        used += [rows, counts]
        rows = halves.where("near < far")
    if single is not None:
        several = single.groupBy("text").agg(F.min("record_id").alias("a"), F.max("other").alias("b")).where("a <> b").select("text")
        found = found.unionByName(single.join(several, "text", "left_semi").select("record_id", F.col("low").cast("bigint").alias("s"), (F.col("low") + span).cast("bigint").alias("e")))
    discard(*used)
    before = Window.partitionBy("record_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("record_id").orderBy("s", "e")
    opens = found.withColumn("new", F.coalesce(F.col("s") > F.max("e").over(before), F.lit(True)).cast("int"))
    islands = opens.withColumn("island", F.sum("new").over(upto))
    return islands.groupBy("record_id", "island").agg(F.min("s").cast("int").alias("span_start"), F.max("e").cast("int").alias("span_end")).drop("island")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of tape_records.body that other records hold too."""
    return shared_spans(table(spark, sf_dir, "tape_records").select("record_id", "body"))


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each record: its side, length in code points, characters found elsewhere, and their share (0 for empty, null for null bodies)."""
    records = table(spark, sf_dir, "tape_records")
    covered = shared_spans(records.select("record_id", "body")).groupBy("record_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("spans"))
    side = F.when(F.col("origin").startswith("transcript"), "message").otherwise("chunk")
    shared = F.coalesce("shared_chars", F.lit(0))
    share = F.when(F.col("body").isNull(), None).when(F.length("body") == 0, 0.0).otherwise(F.round(shared / F.length("body"), 6))
    return records.select("record_id", "origin", "body").join(covered, "record_id", "left").select("record_id", side.alias("side"), F.length("body").alias("chars"), shared.alias("shared_chars"), F.coalesce("spans", F.lit(0)).alias("spans"), share.alias("share"))
