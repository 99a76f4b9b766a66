"""Ranked lexical search over a length-stratified index.

Documents of equal length normaliser m form a stratum, cut into blocks of bounded size. A block holds its postings by
term and falling tf, so an impact is worked out once per tf; the block's bound for an item, from the greatest tf of each
term, orders the visits and lets a search skip the blocks that cannot reach the item's k-th best score so far."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import small_batches, written
from .tokens import pieces

#: Fixed values of the score.
NORM_BASE, NORM_LENGTH = 25, 75
IMPACT, TF_FACTOR, NORM_FACTOR = 1_000_000_000, 1000, 8
#: A block has at most so many documents, and so many terms unless it is one long document.
BLOCK_DOCS, BLOCK_TERMS = 512, 65_536
#: Items and their terms reach the workers in parts of at most so many bytes of text.
ITEM_BYTES = 1 << 20
#: A matrix product of one block takes at most so many (term, item) cells at a time.
CELLS = 1 << 22

#: Digits, letters a-z and everything beyond ASCII stay, A-Z become a-z, all else separates.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text, in lists of bounded size."""
    for _, group in pieces([text.translate(FOLD)]):
        for part in group:
            yield part.split()


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): the length of every document in terms, and its counts of the vocabulary's terms."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for text in batch.column(1):
                n, seen = 0, Counter()
                for part in term_lists(text.as_py() or b""):
                    n += len(part)
                    seen.update(map(vocabulary.get, part))
                seen.pop(None, None)
                lengths.append(n)
                terms.append(list(seen.keys()))
                tfs.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    return base.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


INDEX = "m long, docs array<long>, known array<boolean>, terms array<int>, tfs array<int>, sizes array<int>, at array<int>"


def stratified_index(counts: DataFrame, documents: int, total: int) -> DataFrame:
    """The index over ``counts``: a row per block of a stratum.

    Rows are range-partitioned by (m, hash), so a length that a third of all documents share is spread over many tasks;
    a task cuts its sorted rows into blocks as m changes or a block is full. ``docs`` are the block's ids (``known``
    tells a null id apart), and group g of postings is term ``terms[g]`` at ``tfs[g]`` with ``sizes[g]`` document
    numbers in ``at``, by term and falling tf. Documents without a term of the vocabulary have no postings."""
    m = F.expr(f"{NORM_BASE} + ({NORM_LENGTH} * n * {documents}) div {total}")
    rows = counts.where(F.size("terms") > 0).select(m.alias("m"), "doc_id", "n", "terms", "tfs")
    ranged = rows.repartitionByRange("m", F.xxhash64("doc_id", "terms")).sortWithinPartitions("m")

    def block(m: int, docs: list, terms: list, tfs: list) -> tuple:
        term, tf = np.concatenate(terms), np.concatenate(tfs)
        at = np.repeat(np.arange(len(docs), dtype=np.int32), [len(t) for t in terms])
        order = np.lexsort((at, -tf, term))
        term, tf, at = term[order], tf[order], at[order]
        first = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(tf) != 0)])
        return (m, [d or 0 for d in docs], [d is not None for d in docs], term[first], tf[first],
                np.diff(np.r_[first, len(term)]).astype(np.int32), at)

    def arrow(blocks: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.list_(pa.int32())] * 4]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*blocks), kinds)],
                                          names=[f.split()[0] for f in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, docs, terms, tfs, done = None, 0, [], [], [], []
        for batch in batches:
            lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(3), batch.column(4))]
            for i, (m, doc, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if docs and (m != now or len(docs) == BLOCK_DOCS or words + n > BLOCK_TERMS):
                    done.append(block(now, docs, terms, tfs))
                    words, docs, terms, tfs = 0, [], [], []
                    if len(done) == 64:
                        yield arrow(done)
                        done = []
                now, words = m, words + n
                docs.append(doc)
                for kept, (values, offsets) in zip((terms, tfs), lists):
                    kept.append(values[offsets[i]:offsets[i + 1]].copy())
        if docs:
            done.append(block(now, docs, terms, tfs))
        if done:
            yield arrow(done)

    return ranged.mapInArrow(run, INDEX)


class Best:
    """The k best (score, document) of each item so far; ``least`` is the score that a new document must reach."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items)
        self.held = tuple(np.empty(0, t) for t in (np.int64, np.float64, np.int64, bool))  # item, score, doc, known
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        self.new.append((item, score, doc, known))
        self.waiting += len(item)
        if self.waiting > 4 * self.k * len(self.least):
            self.settle()

    def settle(self) -> None:
        item, score, doc, known = (np.concatenate(c) for c in zip(self.held, *self.new))
        order = np.lexsort((doc, known, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order = order[place < self.k]
        self.held, self.new, self.waiting = (item[order], score[order], doc[order], known[order]), [], 0
        full = place[place < self.k] == self.k - 1
        self.least[self.held[0][full]] = self.held[1][full]


def search(index: DataFrame, items: list[tuple[str | None, np.ndarray, np.ndarray]], weights: np.ndarray, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): the k best documents of each item within each task. ``items`` are (id, term
    numbers, their repeats). Blocks come in batches and are visited by falling bound; a block is scored for the items
    alone whose least kept score its bound reaches, as one matrix product of impacts and repeats (all are integers
    below 2**53, so doubles hold them exactly)."""
    ids = [i for i, _, _ in items]
    of_term = np.concatenate([terms for _, terms, _ in items])
    order = np.argsort(of_term, kind="stable")  # the items of each term, with their repeats, one term after another
    holder = np.repeat(np.arange(len(items)), [len(terms) for _, terms, _ in items])[order]
    repeats = np.concatenate([times for _, _, times in items])[order]
    starts = np.searchsorted(of_term[order], np.arange(len(weights) + 1))
    small_batches(index.sparkSession)

    def holders(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``terms``, item, repeats) of every item that holds one of ``terms``."""
        sizes = starts[terms + 1] - starts[terms]
        place = np.repeat(np.arange(len(terms)), sizes)
        at = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[terms][place]
        return place, holder[at], repeats[at]

    def impacts(m: int, tfs: np.ndarray) -> np.ndarray:
        different, which = np.unique(tfs, return_inverse=True)
        different = different.astype(np.int64)
        return (IMPACT * different // (TF_FACTOR * different + NORM_FACTOR * m))[which]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items), k)
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                blocks = []
                for i in range(batch.num_rows):
                    m, terms, tfs = (batch.column(c)[i] for c in (0, 3, 4))
                    terms, tfs = terms.values.to_numpy(), tfs.values.to_numpy()
                    value = weights[terms] * impacts(m.as_py(), tfs)  # once per term and tf
                    first = np.flatnonzero(np.r_[True, np.diff(terms) != 0])  # the greatest tf of each term
                    place, item, times = holders(terms[first])
                    bound = np.bincount(item, value[first][place] * times, len(items))
                    blocks.append((bound, i, value, terms[first], np.diff(np.r_[first, len(terms)])))
                for bound, i, value, terms, groups in sorted(blocks, key=lambda b: -b[0].max()):
                    asked = np.flatnonzero(bound >= best.least)
                    if not len(asked):
                        continue
                    docs, sizes, at = (batch.column(c)[i].values.to_numpy() for c in (1, 5, 6))
                    known = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                    dense = np.zeros((len(docs), len(terms)))
                    column = np.repeat(np.repeat(np.arange(len(terms)), groups), sizes)
                    dense[at, column] = np.repeat(value, sizes)
                    place, item, times = holders(terms)
                    step = max(1, CELLS // len(terms))
                    for some in (asked[a:a + step] for a in range(0, len(asked), step)):
                        own = np.searchsorted(some, item)
                        mine = some[np.minimum(own, len(some) - 1)] == item
                        matrix = np.zeros((len(terms), len(some)))
                        matrix[place[mine], own[mine]] = times[mine]
                        score = dense @ matrix
                        doc, asker = np.nonzero(score >= best.least[some])
                        best.add(some[asker], score[doc, asker], docs[doc], known[doc])
        best.settle()
        item, score, doc, known = best.held
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array([ids[i] for i in item], pa.string()),
             pa.array(doc, mask=~known), pa.array(score.astype(np.int64))], names=["item", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item int, item_id string, doc_id long, score long")


def lexical_search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", k: int = 10,
                   item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item_col``, rank, ``id_col``, score: the k best documents with a score above 0 of every row of ``queries``.

    Null and empty texts have no terms; an item without terms, or whose terms no document holds, has no rows, and so
    have empty tables. Every row is a document of its own, so repeated rows rank beside each other; equal scores go by
    ascending id, null ids first. Repeated items have their ranks each. Other columns are not read.

    Items reach the workers in parts of at most ``item_bytes`` of text (by their measured total), each with one pass
    over the documents, so many items cost passes and not memory. A task keeps k documents per item; only these are
    shuffled for the final ranks."""
    spark = docs.sparkSession
    ensure = T.StructType([T.StructField(item_col, T.StringType()), T.StructField("rank", T.IntegerType()),
                           T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())])
    asked = written(queries.select(F.col(f"`{item_col}`").cast("string").alias("item_id"),
                                   F.col(f"`{item_text_col}`").cast("binary").alias("text"),
                                   F.monotonically_increasing_id().alias("row")), "lexical-items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // item_bytes)
    out = []
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).orderBy("row").toLocalIterator()
        out.append(one_part(spark, docs, id_col, text_col, rows, k, part))
    found = [df for df in out if df is not None]
    if not found:
        return spark.createDataFrame([], ensure)
    order = Window.partitionBy("part", "item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


def one_part(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, rows: Iterable, k: int,
             part: int) -> DataFrame | None:
    """The search of one bounded part of the items: counts, index and the best documents of each task."""
    vocabulary: dict[bytes, int] = {}
    items = []
    for row in rows:
        seen = Counter(vocabulary.setdefault(t, len(vocabulary)) for terms in term_lists(bytes(row["text"] or b"")) for t in terms)
        if seen:
            items.append((row["item_id"], np.array(list(seen.keys())), np.array(list(seen.values()), dtype=np.float64)))
    if not items:
        return None
    counts = written(term_counts(docs, vocabulary, id_col, text_col), "lexical-counts")
    n, length = counts.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    if not length:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the vocabulary
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    index = written(stratified_index(counts, n, length), "lexical-index")
    return search(index, items, weights, k).withColumn("part", F.lit(part))


#: The same result by plain joins.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
t AS (SELECT k, any_value(doc_id) AS doc_id, any_value(n) AS n, term, CAST(count(*) AS BIGINT) AS tf
      FROM (SELECT k, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) GROUP BY k, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
      FROM t, s GROUP BY term, nn),
b AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT item, item_id, k, doc_id,
        CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
      FROM b JOIN f USING (term) JOIN t USING (term), s GROUP BY item, item_id, k, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM p WHERE score > 0)
SELECT CAST(item_id AS VARCHAR) AS item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
