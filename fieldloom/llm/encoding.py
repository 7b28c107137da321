"""Problem 6: token ids of a whole corpus, encoding each content-defined chunk once.

Texts are cut where a rolling hash of the last WINDOW characters hits a pattern, so equal passages give equal chunks
wherever they stand; distinct chunks are encoded once and their ids joined to all places they occur. A raw cut may fall
inside a token. The join is repaired by moving the cut on to the next place where the pattern of the tokenizer ends a piece
whatever stands before and after it; from there on the encoding of the chunks and that of the whole text agree exactly:
no piece holds a blank or line feed after a visible character, nor a punctuation mark after a letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldloom.llm import text as X
from fieldloom.llm import tokenizers as T
from fieldloom.sources.tables import table

NAME = "byte_bpe_50k"
WINDOW = 16
#: A chunk has LEAST characters or more, and about LEAST + MASK on average.
LEAST, MASK = 512, 511
#: A chunk that a batch holds this often is encoded by up to POPULAR_TASKS tasks, so that no task sends out all its places.
POPULAR, POPULAR_TASKS = 64, 32
#: Characters hashed at once.
BLOCK = 1 << 19

# Ranges of letters (Latin, Cyrillic, Arabic, Thai consonants, kana, CJK) and marks that are no letters in
# every version of Unicode.
LETTERS = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0x410, 0x44F), (0x621, 0x63A), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5))
MARKS = " \n!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~。、，！？；：「」（）"


def boundaries(points: np.ndarray) -> np.ndarray:
    """Positions i at which a piece ends in any context, judged by the characters i-1 and i."""
    letter = np.zeros(len(points), bool)
    for a, b in LETTERS:
        letter |= (points >= a) & (points <= b)
    visible = letter | ((points > 0x20) & (points < 0x7F))
    blank = (points == 0x20) | (points == 0x0A)
    mark = np.isin(points, np.frombuffer(MARKS.encode("utf-32-le"), np.uint32))
    return np.flatnonzero((blank[1:] & visible[:-1]) | (mark[1:] & letter[:-1])) + 1


def cut_all(texts: list[str]) -> list[list[int]]:
    """The cuts of each text: 0, those inside, its length."""
    points = [X.code_points(t) for t in texts]
    lengths = np.array([len(p) for p in points])
    joined = np.concatenate(points) if points else np.zeros(0, np.uint32)
    h = X.window_hashes(joined, WINDOW)
    marks = np.flatnonzero((h & np.uint64(MASK)) == 0) + WINDOW
    ends = boundaries(joined) if len(joined) else np.zeros(0, np.int64)
    out, start = [], 0
    for n in lengths.tolist():
        cuts, last = [0], 0
        if n > LEAST:
            for m in (marks[np.searchsorted(marks, start + WINDOW) : np.searchsorted(marks, start + n)] - start).tolist():
                if m - last < LEAST:
                    continue
                k = np.searchsorted(ends, start + m)
                if k == len(ends) or ends[k] - start >= n:
                    break
                last = int(ends[k]) - start
                cuts.append(last)
        cuts.append(n)
        out.append(cuts)
        start += n
    return out


def _blocks(values):
    size, part = 0, []
    for v in values:
        if part and size + len(v[1]) > BLOCK:
            yield part
            size, part = 0, []
        part.append(v)
        size += len(v[1])
    if part:
        yield part


def _chunked(batches):
    """A row per distinct chunk of a batch: two hashes, its text and the places (doc, whole, seq) that hold it."""
    for b in batches:
        rows: dict[tuple[int, int], list] = {}
        for part in _blocks((i, t or "") for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            for (i, text), cuts in zip(part, cut_all([t for _, t in part])):
                whole = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                for seq, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    chunk = text[s:e]
                    digest = xxhash.xxh3_128_intdigest(chunk.encode("utf-8", "surrogatepass"))
                    key = ((digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63))
                    rows.setdefault(key, [chunk, [], [], []])
                    for at, v in zip(rows[key][1:], (i, whole, seq)):
                        at.append(v)
        offsets = np.cumsum([0, *(len(r[1]) for r in rows.values())]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array([v for r in rows.values() for v in r[k]], t)) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.int64()), pa.array([k[1] for k in rows], pa.int64()), pa.array([T.clean(r[0]) for r in rows.values()], pa.string()), *lists], names=["h1", "h2", "chunk", "docs", "wholes", "seqs"])


def _encoded(name: str, at: str | None, most: int = 50_000):
    """Rows of one partition, which holds all rows of its chunks: ids of each chunk, encoded once, for each place."""

    def run(batches):
        encode = T.encoder(name, at)
        known: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            new = {k: r for r, k in enumerate(keys) if k not in known}
            if len(known) > most:  # forgetting costs a second encoding, no more
                known.clear()
                new = {k: r for r, k in enumerate(keys)}
            texts = b.column(2)
            for k, ids in zip(new, encode([texts[r].as_py() for r in new.values()])):
                known[k] = np.array(ids, np.int32)
            docs, wholes, seqs = (b.column(c) for c in (3, 4, 5))
            times = np.asarray(docs.value_lengths())
            of = np.repeat(np.arange(len(keys)), times)
            pieces = [known[keys[r]] for r in of]
            # one chunk may stand in very many places: rows go out in parts
            flat = [x.flatten() for x in (docs, wholes, seqs)]
            for s in range(0, len(of), 20_000):
                part = pieces[s : s + 20_000]
                offsets = np.cumsum([0, *map(len, part)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part) if part else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*(x.slice(s, len(part)) for x in flat), ids], names=["doc_id", "whole", "seq", "ids"])

    return run


def encode_corpus(docs: DataFrame, name: str = NAME, key: str = "doc_id", text: str = "text", tokenizers: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    Null and empty texts have an empty list; strings that look like special tokens are ordinary text. Rows that repeat both
    key and text give one row; null keys are dropped. Only key and text are read. Works for the rank files, whose pattern
    the cuts are made for.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    some, none = rows.where(F.length("text") > 0), rows.where(F.coalesce(F.length("text"), F.lit(0)) == 0)
    chunks = some.mapInArrow(_chunked, "h1 bigint, h2 bigint, chunk string, docs array<bigint>, wholes array<bigint>, seqs array<int>")
    salt = F.when(F.size("docs") >= POPULAR, F.pmod(F.xxhash64(F.element_at("docs", 1)), F.lit(POPULAR_TASKS))).otherwise(0)
    placed = chunks.repartition("h1", "h2", salt).mapInArrow(_encoded(name, tokenizers), "doc_id bigint, whole bigint, seq int, ids array<int>")
    gathered = placed.groupBy("doc_id", "whole").agg(F.collect_set(F.struct("seq", "ids")).alias("parts"))
    encoded = gathered.select(F.col("doc_id").alias(key), F.flatten(F.transform(F.array_sort("parts"), lambda p: p.ids)).alias("ids"))
    return encoded.unionByName(none.select(F.col("doc_id").alias(key)).distinct().withColumn("ids", F.array().cast("array<int>")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids by byte_bpe_50k of every document."""
    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))
