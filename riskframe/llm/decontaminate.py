"""Benchmark decontamination: prefix-filtered set join with positional verification, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, text_or_empty, written

#: Everything that is not a digit, a letter a-z or beyond ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def item_windows(bench: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(window, n, items): distinct windows of ``size`` consecutive words, with the ids (as text) of their items.
    An item of fewer words is one window; an item without words has none."""
    w = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                     words(text_or_empty(text_col)).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1))))
    cut = w.select("item", "w", at.alias("at")).select("item", F.slice("w", F.col("at"), F.lit(size)).alias("window"))
    return (cut.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
            .select("window", F.size("window").alias("n"), "items"))


def parts(df: DataFrame, key: str, rows: int, most: int) -> list[DataFrame]:
    """``df`` in as many hash parts as keep each at about ``most`` rows: a checked size for broadcasting."""
    k = -(-rows // most) or 1
    return [df] if k == 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(k)) == i) for i in range(k)]


def match_windows(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = 10,
                  broadcast_rows: int = 100_000) -> DataFrame:
    """Every occurrence of an item window in a document: (``id_col``, text_hash, start, n, items).

    Words are ordered by rarity, counted over all documents.  An occurrence holds all words of its window, so one
    necessary prefix token is enough: the window's rarest word.  Document words are joined to those tokens alone;
    where a token stands at position p and offset o of a window, only the start p - o can match, it must leave room
    for the whole window, and the words there are compared exactly.  Both joined tables come from the benchmark;
    they are broadcast in parts of ``broadcast_rows`` rows, so a large benchmark costs more passes, never more memory.
    """
    windows = written(item_windows(bench, item_col, item_text_col, size), "windows")
    vocabulary = written(windows.select(F.explode("window").alias("word")).distinct(), "vocabulary")
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    tokens = base.select(F.explode(words(F.col("text"))).alias("word"))
    counts = reduce(DataFrame.unionByName, [
        tokens.join(F.broadcast(part), "word").groupBy("word").agg(F.count("*").alias("seen"))
        for part in parts(vocabulary, "word", vocabulary.count(), broadcast_rows)])
    spots = windows.select("window", "n", "items", F.posexplode("window").alias("offset", "word"))
    rarest = (spots.join(counts, "word").groupBy("window", "n")
              .agg(F.count("*").alias("known"), F.first("items").alias("items"),
                   F.min(F.struct("seen", "word", "offset")).alias("least"))
              .where("known = n")  # a word that no document has rules the window out
              .select("window", "n", "items", F.col("least.word").alias("word"), F.col("least.offset").alias("offset")))
    rarest = written(rarest, "prefix")
    split = base.select("id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    at = split.select("id", "text_hash", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    found = [
        at.join(F.broadcast(part), "word")
        .where("pos >= offset and pos - offset + n <= n_words")
        .where(F.slice("w", F.col("pos") - F.col("offset") + 1, F.col("n")) == F.col("window"))
        .select("id", "text_hash", (F.col("pos") - F.col("offset")).alias("start"), "n", "items")
        for part in parts(rarest, "window", rarest.count(), broadcast_rows)]
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_col)


def hit_documents(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document with an occurrence: (``id_col``, text_hash, n_hit, n_items, items_sha256). Hit words are the union
    of the occurrences' spans, so overlaps and repeats count once."""
    before = (Window.partitionBy(id_col, "text_hash").orderBy("start", "end")
              .rowsBetween(Window.unboundedPreceding, -1))
    spans = matches.withColumn("end", F.col("start") + F.col("n"))
    spans = spans.withColumn("covered", F.max("end").over(before))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("covered", F.lit(0))))
    each = spans.select(id_col, "text_hash", new.alias("new"), "items")
    sums = each.groupBy(id_col, "text_hash").agg(F.sum("new").alias("n_hit"))
    items = (each.select(id_col, "text_hash", F.explode("items").alias("item")).distinct()
             .groupBy(id_col, "text_hash").agg(F.sort_array(F.collect_list("item")).alias("items")))
    same = sums[id_col].eqNullSafe(items[id_col]) & (sums["text_hash"] == items["text_hash"])
    return sums.join(items, same).select(
        sums[id_col], sums["text_hash"], F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; empty tables give empty or all-clean results; rows repeat as they do in
    ``docs`` (equal ids with different texts are told apart by the text); other columns are not read.
    """
    hits = hit_documents(match_windows(docs, bench, id_col, text_col, item_col, item_text_col, size), id_col)
    hits = hits.withColumnRenamed(id_col, "hit_id").withColumnRenamed("text_hash", "hit_hash")
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col), F.xxhash64(text).alias("text_hash"), F.size(words(text)).alias("n_words"))
    same = F.col(id_col).eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    return base.join(hits, same, "left").select(
        id_col, F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """``docs`` without the documents in which a window of an item occurs."""
    hits = match_windows(docs, bench, id_col, text_col, item_col, item_text_col, size)
    hits = hits.select(F.col(id_col).alias("hit_id"), "text_hash").distinct()
    same = docs[id_col].eqNullSafe(hits["hit_id"]) & (
        F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == hits["text_hash"])
    return docs.join(hits, same, "left_anti")


#: The same result by plain window equality.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[s + 1 : s + n], ' ') AS x FROM bs),
ds AS (SELECT k, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d, (SELECT DISTINCT n FROM bw)),
dw AS (SELECT k, n, s, array_to_string(w[s + 1 : s + n], ' ') AS x FROM ds),
m AS (SELECT k, dw.n AS n, s, item FROM dw JOIN bw ON dw.x = bw.x AND dw.n = bw.n),
p AS (SELECT k, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT k, s, n FROM m)),
h AS (SELECT k, count(DISTINCT pos) AS n_hit FROM p GROUP BY k),
i AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT k, item FROM m) GROUP BY k)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.k = h.k LEFT JOIN i ON d.k = i.k
"""
