"""Intake of marked-down files, the chunker, transcripts with quantised vectors, and the store's sinks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fieldloom.functions import text as T, vectors as V

#: Bytes of an admissible file, tokens of a chunk, and characters a chunk must exceed: the reference's limits.
LEAST_BYTES, MOST_BYTES, CHUNK_TOKENS, LEAST_CHARS = 800, 320_000, 700, 200
#: Tokens of a chunk that the next one of its section repeats.
OVERLAP_TOKENS = 40
# Fixed value: the odd constant of the splitmix64 generator.
GOLDEN = 0x9E3779B97F4A7C15


def collect_files(spark: SparkSession, roots: list[tuple[str, str]], glob: str = "*.md") -> DataFrame:
    """(path, lane, name, bytes, modified, text) of the files directly in each root; of a path met twice the first root's.

    Names that mark generated files and sizes outside the limits are left out; bytes that are no UTF-8 are replaced.
    """
    out = None
    for rank, (root, lane) in enumerate(roots):
        one = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root).select(F.lit(rank).alias("rank"), F.lit(lane).alias("lane"), "path", "length", "modificationTime", "content")
        out = one if out is None else out.unionByName(one)
    first = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy("rank"))
    name = F.element_at(F.split("path", "/"), -1)
    kept = out.withColumn("name", name).where(F.col("length").between(LEAST_BYTES, MOST_BYTES) & ~F.col("name").rlike(T.SKIPPED_NAMES)).withColumn("r", first).where("r = 1")
    return kept.select("path", "lane", F.regexp_replace("name", r"\.md$", "").alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def dated(files: DataFrame) -> DataFrame:
    """files with day and date_source: the date in the name if it is a real day, else the file's."""
    named = F.expr(f"try_cast(nullif(regexp_extract(name, '{T.DATE_IN_NAME}', 1), '') AS date)")
    return files.withColumn("day", F.coalesce(named, F.to_date("modified"))).withColumn("date_source", F.when(named.isNotNull(), "name").when(F.col("modified").isNotNull(), "mtime").otherwise("absent"))


_SECTION = re.compile(r"<!--\s*section:\s*(.*?)\s*-->")
_HEADING = re.compile(r"#{1,6}\s+(.*)")


def split_chunks(text: str | None, budget: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[str, str]]:
    """(section, body) of the chunks of one text: whole lines packed up to the budget of tokens (characters / 4).

    A heading or a section comment starts a chunk; recap comments and the quotes after them are left out; bodies of LEAST_CHARS
    characters or fewer are dropped. A line longer than the budget stands alone. A chunk that the budget closes hands its last
    whole lines of up to `overlap` tokens on to the next.
    """
    out, section, lines, size, recap = [], "", [], 0, False

    def close(full: bool = False) -> None:
        nonlocal lines, size
        body = "\n".join(lines).strip()
        if len(body) > LEAST_CHARS:
            out.append((section[:160], body))
        kept: list[str] = []
        while full and lines[1:] and sum(map(len, kept)) + len(kept) + len(lines[-1]) <= overlap * 4:
            kept.insert(0, lines.pop())
        lines, size = kept, sum(map(len, kept)) + len(kept)

    for line in (text or "").split("\n"):
        if line.startswith("<!--"):
            close()
            m = _SECTION.match(line)
            section = m[1] if m else section
            recap = recap or "recap:" in line
            continue
        if recap and (line.startswith(">") or not line.strip()):
            continue
        recap = False
        m = _HEADING.match(line)
        if m or (lines and size + len(line) > budget * 4):
            close(full=not m)
        if m:
            section = m[1]
        lines.append(line)
        size += len(line) + 1
    close()
    return out


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = CHUNK_TOKENS) -> DataFrame:
    """(key, seq, section, body, tokens): the chunks of every text; null and short texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(i, n, s, body, max(1, len(body) // 4)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, (s, body) in enumerate(split_chunks(t, budget))]
            cols = list(zip(*rows)) if rows else [()] * 5
            types = (b.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[key, "seq", "section", "body", "tokens"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, seq int, section string, body string, tokens int")


def embed(texts: DataFrame, cache: DataFrame, encode: Column, key: Column) -> tuple[DataFrame, DataFrame]:
    """(all texts with key and vec, new cache rows): only texts whose key the cache lacks are encoded, each once.

    A vector that fails to come (null) is kept as null and not cached.
    """
    keyed = texts.withColumn("key", key)
    fresh = keyed.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti").withColumn("vec", encode).select("key", "vec").where("vec is not null")
    known = cache.select("key", "vec").unionByName(fresh)
    return keyed.join(known, "key", "left"), fresh


def transcripts(messages: DataFrame, vectors: DataFrame, since: Column, dim: int) -> DataFrame:
    """Messages with their dequantised, normalised vector: class 0, chunk 0, since a time, 120 characters or more."""
    v = vectors.where((F.col("chunk") == 0) & (F.size("q") == dim)).select("uuid", V.normalise(V.dequantise(F.col("q"), F.col("scale"))).alias("vec"))
    return messages.where((F.col("class") == 0) & (F.col("ts") >= since) & (F.length("text") >= 120)).join(v, "uuid")


def write_store(path: str, **tables: DataFrame) -> None:
    """Each table as parquet under path; edges by slice, without the containment links, which the chunks hold anyway."""
    for name, df in tables.items():
        if name == "edges":
            df.where("slice <> 'con'").write.mode("overwrite").partitionBy("slice").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{n}") for n in names]


def to_json_lines(df: DataFrame, path: str) -> None:
    """One JSON document per row, '</' escaped so that it can stand in a page."""
    df.select(F.replace(F.to_json(F.struct("*")), F.lit("</"), F.lit("<\\/")).alias("value")).write.mode("overwrite").text(path)


def synthetic_i8(spark: SparkSession, n: int, dim: int, seed: int) -> DataFrame:
    """(id, v): counter-based int8 vectors: the splitmix64 finaliser of index + golden * (seed + 1), its low byte less 128.

    The same on any partitioning; index is the element's place in the whole matrix.
    """

    def run(batches):
        for b in batches:
            ids = np.asarray(b.column(0)).astype(np.uint64)
            index = ids[:, None] * np.uint64(dim) + np.arange(dim, dtype=np.uint64)[None, :]
            z = index + np.uint64(GOLDEN * (seed + 1) % (1 << 64))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            values = ((z & np.uint64(0xFF)).astype(np.int16) - 128).astype(np.int8)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, dim, dtype=np.int32)), pa.array(values.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), rows], names=["id", "v"])

    return spark.range(n).mapInArrow(run, "id bigint, v array<tinyint>")
