"""SimHash near-duplicate detection over a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import strings, with_arrow, written
from .components import connected_components

BYTES = 8
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # bits of each byte value


def simhash64(text: str, shingle_words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one whole text (no words: 0)."""
    words = text.encode("utf-8").lower().split()  # bytes.lower() and split() know ASCII only, as wanted
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - shingle_words + 1
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    ends = ends[shingle_words - 1:].tolist()
    digest = xxhash.xxh64_digest  # canonical, that is big-endian, bytes
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        part = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at:at + 65536], ends[at:at + 65536])])
        columns = np.frombuffer(part, np.uint8).reshape(-1, BYTES)
        for k in range(BYTES):
            ones[8 * k:8 * k + 8] += np.bincount(columns[:, k], minlength=256) @ BITS
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(``id_col``, fp): one SimHash per row as a signed 64-bit integer. A null text counts as empty."""
    def hashed(batch: pa.RecordBatch) -> list[pa.Array]:
        fp = np.array([simhash64(t, shingle_words) for t in strings(batch.column(1))], dtype=np.uint64)
        return [pa.array(fp.view(np.int64))]

    return with_arrow(docs.select(id_col, F.col(text_col).cast("string")), hashed, "fp long").select(id_col, "fp")


def masks(max_bits: int) -> list[int]:
    """Byte-position masks of the inverted index, as signed 64-bit integers.

    Two fingerprints that differ in at most ``max_bits`` bits share at least ``8 - max_bits`` bytes at the same
    positions.  A posting therefore names that many positions with their bytes at once: whatever meets in it has
    reached the guaranteed minimum of shared positional bytes.  (Postings of single bytes would hold 1/256 of all
    rows each, and their tallies would grow with the square of the input.)
    """
    shared = BYTES - max_bits
    if not 0 < shared <= BYTES:
        raise ValueError("max_bits must be 0 to 7")
    out = []
    for chosen in combinations(range(BYTES), shared):
        mask = sum(0xFF << (8 * k) for k in chosen)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def near(a: str, b: str, max_bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def link_fingerprints(distinct_fp: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, component): exact components of distinct fingerprints under "at most ``max_bits`` bits differ".

    Only fingerprints with a neighbour are returned.  Every posting first links its members, in order, to their
    predecessor and to its first member; then only members of postings that still hold two or more components are
    compared, and only across components.  So a dense cluster of m near copies costs about m comparisons, not
    m * m, and no link that could join two components is left out.
    """
    postings = distinct_fp.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks(max_bits)])))
    postings = postings.select(F.xxhash64("pos", F.col("fp").bitwiseAND(F.col("col"))).alias("posting"), "fp")
    within = Window.partitionBy("posting").orderBy("fp")
    met = written(
        postings.select("posting", "fp", F.lag("fp").over(within).alias("before"), F.first("fp").over(within)
                        .alias("first"), F.lead("fp").over(within).alias("after"))
        .where("before is not null or after is not null").select("posting", "fp", "before", "first"), "postings")
    direct = (met.select("fp", F.explode(F.array("before", "first")).alias("b")).where(near("fp", "b", max_bits))
              .select(F.col("fp").alias("a"), "b").where("a <> b").distinct())
    direct = written(direct, "links")
    first = connected_components(direct)
    placed = (met.select("posting", "fp").join(first.withColumnRenamed("node", "fp"), "fp", "left")
              .select("posting", "fp", F.coalesce("component", "fp").alias("component")))
    placed = written(placed, "placed")
    mixed = placed.groupBy("posting").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_ = placed.join(mixed.select("posting"), "posting", "left_semi")
    left, right = (open_.select("posting", F.col("fp").alias(f"fp_{s}"), F.col("component").alias(f"c_{s}"))
                   for s in "ab")
    across = (left.join(right, (left["posting"] == right["posting"]) & (F.col("c_a") < F.col("c_b"))
                        & near("fp_a", "fp_b", max_bits))
              .select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct())
    found = written(across, "links")
    if found.isEmpty():
        return first.withColumnRenamed("node", "fp")
    return connected_components(direct.unionByName(found)).withColumnRenamed("node", "fp")


def simhash_groups(prints: DataFrame, id_col: str = "doc_id", max_bits: int = 4) -> DataFrame:
    """One row per fingerprint of ``prints`` (``id_col``, fp): fp, component_id (smallest id reachable) and keeper,
    the fingerprint that holds it.  Copies are collapsed before anything is compared.  Null ids never become a
    component_id unless the group has no other."""
    by_fp = written(prints.groupBy("fp").agg(F.min(id_col).alias("low")), "by_fp")
    linked = link_fingerprints(by_fp.select("fp"), max_bits)
    placed = by_fp.join(linked, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    placed = written(placed, "by_component")
    best = placed.groupBy("component").agg(
        F.min("low").alias("component_id"), F.min_by("fp", F.struct(F.col("low").isNull(), "low", "fp")).alias("keeper"))
    return placed.join(best, "component").select("fp", "component_id", "keeper")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4,
                  max_bits: int = 4) -> DataFrame:
    """One row per document: ``id_col``, fingerprint (16 lowercase hex digits), component_id.

    Null and empty texts and texts without words get fingerprint zero and are linked like any other.  Repeated rows
    stay repeated.  An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle_words), "prints")
    groups = simhash_groups(prints, id_col, max_bits)
    return (prints.join(groups, "fp")
            .select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4,
             max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id (ties, that is repeated ids:
    the smallest hash of the text).  The text is shuffled once, by fingerprint."""
    columns = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # own names: the input may use any
    key, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"

    def hashed(batch: pa.RecordBatch) -> list[pa.Array]:
        fp = np.array([simhash64(t, shingle_words) for t in strings(batch.column(text))], dtype=np.uint64)
        return [pa.array(fp.view(np.int64))]

    marked = written(with_arrow(flat, hashed, "fp long"), "marked")
    groups = simhash_groups(marked.select(F.col(key).alias(id_col), "fp"), id_col, max_bits)
    keepers = groups.where("fp = keeper").select("fp")
    order = Window.partitionBy("fp").orderBy(F.col(key).isNull(), F.col(key), F.xxhash64(text))
    one = marked.join(keepers, "fp", "left_semi").withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return one.drop("fp", "rank").toDF(*columns)
