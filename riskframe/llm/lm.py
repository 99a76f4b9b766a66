"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays in the shared folder,
memory-mapped by the workers that score texts."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import held_out, small_batches, strings, text_or_empty, with_arrow
from .tokens import hash_table, mix, token_groups

#: Hashes of the marks before the first and after the last word.
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
FLUSH_TOKENS = 3_000_000
BLOB = "shard int, context binary, run binary, word binary, seen binary"
SUMS = "kind string, shard int, key binary, a binary, b binary, c binary, d binary"
TOTALS = [f"t{i}" for i in range(8)]
#: Counts of this size and more stand in a second list of their own.
LARGE = 255
#: A worker keeps at most so many of the model's files mapped.
MAPPED = 8192


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir as a path that all workers can map: the setting must name a mounted
    shared file system."""
    url = urlparse(scratch_path(spark, name))
    if url.scheme not in ("", "file"):
        raise ValueError(f"workers map the model's files: spark.checkpoint.dir must be a mounted folder, not {url.scheme}:")
    return url.path


def encoded(column: pa.Array) -> list[bytes]:
    return [t.encode("utf-8").lower() for t in strings(column)]


def sequence(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words with their end marks, their contexts, first token of each text)."""
    ends = np.cumsum(counts + 1) - 1
    word = np.empty(len(hashes) + len(counts), np.uint64)
    inner = np.ones(len(word), bool)
    inner[ends] = False
    word[inner], word[ends] = hashes, END
    first = ends - counts
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[first] = BEGIN
    return word, context, first


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash's upper bits, so sorted hashes lie together by shard."""
    return ((h >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context ^ (word * np.uint64(0xFF51AFD7ED558CCD)))


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in columns that are sorted together."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def unit_of(context: np.ndarray, word: np.ndarray, spread_bits: int) -> np.ndarray:
    """The hash that deals pairs to shards: a context's pairs fall into 2**spread_bits units by their words, so the
    continuations of a very frequent word lie in many shards."""
    return mix(context + (word >> np.uint64(64 - spread_bits)) * BEGIN) if spread_bits else mix(context)


def save(folder: str, name: str, key: np.ndarray, *counts: np.ndarray) -> None:
    """Sorted keys with their counts as one file; a repeated task writes the same bytes and replaces the file at once.
    A count takes one byte; those of ``LARGE`` or more are marked by it and stand, exact, in a list with their places."""
    os.makedirs(folder, exist_ok=True)
    places = [np.flatnonzero(c >= LARGE) for c in counts]
    parts = [np.array([len(key), *map(len, places)], np.int64), key.astype(np.uint64)]
    for c, at in zip(counts, places):
        parts += [at.astype(np.int64), c[at].astype(np.int64)]
    parts += [np.minimum(c, LARGE).astype(np.uint8) for c in counts]
    part = os.path.join(folder, f"{name}-{uuid.uuid4().hex}.tmp")
    with open(part, "wb") as out:
        for x in parts:
            out.write(x.tobytes())
    os.replace(part, os.path.join(folder, f"{name}.bin"))


def load(path: str, columns: int):
    """(keys, [(bytes, places of large counts, large counts)]) as views of one mapped file."""
    whole = np.memmap(path, np.uint8, "r")
    sizes = whole[:8 * (columns + 1)].view(np.int64).tolist()
    at = 8 * (columns + 1)

    def take(n: int, dtype) -> np.ndarray:
        nonlocal at
        begin, at = at, at + n * np.dtype(dtype).itemsize
        return whole[begin:at].view(dtype)

    key = take(sizes[0], np.uint64)
    large = [(take(n, np.int64), take(n, np.int64)) for n in sizes[1:]]
    return key, [(take(sizes[0], np.uint8), *x) for x in large]


def look_up(keys: np.ndarray, wanted: np.ndarray, counts: list) -> list[np.ndarray]:
    """Counts of sorted ``wanted`` keys (0 where absent)."""
    if not len(keys):
        return [np.zeros(len(wanted), np.int64) for _ in counts]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    out = []
    for small, places, large in counts:
        found = np.where(hit, small[at], 0).astype(np.int64)
        more = np.flatnonzero(found == LARGE)
        if len(more):
            found[more] = large[np.searchsorted(places, at[more])]
        out.append(found)
    return out


def packed(x: np.ndarray) -> bytes:
    """Counts in 32 bits where all fit, exactly."""
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.int64).tobytes()


def unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint32 if len(blob) == 4 * n else np.int64).astype(np.int64)


def dealt(kind: str, shards: int, key: np.ndarray, *counts: np.ndarray) -> list[tuple]:
    """Rows of ``SUMS``: sorted keys with their counts, cut by shard."""
    edge = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
    return [(kind, int(s), key[edge[s]:edge[s + 1]].tobytes(),
             *[packed(c[edge[s]:edge[s + 1]]) for c in counts], *[None] * (4 - len(counts)))
            for s in np.flatnonzero(np.diff(edge))]


def count_pairs(docs: DataFrame, shards: int, spread_bits: int) -> DataFrame:
    """Bigram counts, summed per about ``FLUSH_TOKENS`` tokens before the shuffle, as packed arrays by shard."""

    small_batches(docs.sparkSession)

    def blobs(held: list[tuple[np.ndarray, np.ndarray]]):
        word, context = (np.concatenate(x) for x in zip(*held))
        unit = unit_of(context, word, spread_bits)
        order = np.argsort((unit & ~np.uint64(0xFFFFFF)) | (word >> np.uint64(24)) & np.uint64(0xFFFFFF))
        word, context, unit = word[order], context[order], unit[order]
        begin = runs(context, word)
        seen = np.diff(np.append(begin, len(word))).astype(np.uint32)
        word, context = word[begin], context[begin]
        edge = np.searchsorted(shard_of(unit[begin], shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edge)):
            a, b = edge[s], edge[s + 1]
            head = runs(context[a:b])
            run = np.diff(np.append(head, b - a)).astype(np.uint32)
            yield (int(s), context[a:b][head].tobytes(), run.tobytes(), word[a:b].tobytes(), seen[a:b].tobytes())

    def batch_of(rows):
        shard, *rest = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(shard, pa.int32()), *[pa.array(c, pa.binary()) for c in rest]],
            names=["shard", "context", "run", "word", "seen"])

    def count(batches):
        table, held, size = hash_table(), [], 0
        for batch in batches:
            for _, hashes, counts in token_groups(encoded(batch.column(0)), table):
                word, context, _ = sequence(hashes, counts)
                held.append((word, context))
                size += len(word)
                if size >= FLUSH_TOKENS:
                    yield batch_of(blobs(held))
                    held, size = [], 0
        if held:
            yield batch_of(blobs(held))

    return docs.select(text_or_empty("text").alias("t")).mapInArrow(count, BLOB)


def merge_pairs(folder: str, shards: int):
    """One shard of pairs: writes its sorted pairs, returns its part of the sums by context and by word."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        join = lambda c, t: np.frombuffer(b"".join(pdf[c]), t)
        context = np.repeat(join("context", np.uint64), join("run", np.uint32))
        word, seen = join("word", np.uint64), join("seen", np.uint32)
        order = np.lexsort((word, context))
        word, context, seen = word[order], context[order], seen[order]
        begin = runs(context, word)
        seen = np.add.reduceat(seen.astype(np.int64), begin)
        word, context = word[begin], context[begin]
        key = pair_key(context, word)
        order = np.argsort(key)
        save(folder, f"pairs{shard}", key[order], seen[order])
        head = runs(context)
        add = lambda x: np.add.reduceat(x.astype(np.int64), head)
        out = dealt("contexts", shards, context[head], add(seen), add(seen == 1), add(seen == 2), add(seen >= 3))
        stats = np.array([(seen == k).sum() for k in (1, 2, 3, 4)], np.int64)
        out.append(("pairs", shard, None, stats.tobytes(), None, None, None))
        order = np.argsort(word)
        word, seen = word[order], seen[order]
        begin = runs(word)
        out += dealt("words", shards, word[begin], np.add.reduceat(seen, begin), np.diff(np.append(begin, len(word))))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SUMS.split(", ")])

    return merge


def merge_sums(folder: str):
    """One shard of contexts or words: adds the parts of each key and writes them sorted; returns a few totals."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, shard = pdf["kind"].iloc[0], int(pdf["shard"].iloc[0])
        total = np.zeros(8, np.int64)
        if kind == "pairs":
            total[:4] = np.frombuffer(b"".join(pdf["a"]), np.int64).reshape(-1, 4).sum(axis=0)
        else:
            key = np.frombuffer(b"".join(pdf["key"]), np.uint64)
            columns = "ab" if kind == "words" else "abcd"
            counts = [np.concatenate([unpacked(x, len(k) // 8) for x, k in zip(pdf[c], pdf["key"])]) for c in columns]
            order = np.argsort(key, kind="stable")
            key = key[order]
            begin = runs(key)
            counts = [np.add.reduceat(c[order], begin) for c in counts]
            save(folder, f"{kind}{shard}", key[begin], *counts)
            if kind == "words":
                seen, before = counts
                total[:] = [len(seen), seen.sum(), before.sum(), *[(before == k).sum() for k in (1, 2, 3, 4)],
                            (before >= 3).sum()]
        return pd.DataFrame([(kind, *total)], columns=["kind", *TOTALS])

    return merge


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of n-grams seen 1 to 4 times.
    Where a number is missing or the rule leaves its range, half of the count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *[d if 0 < d < k else k / 2 for k, d in enumerate(raw, 1)]])


def train(docs: DataFrame, shard_chars: int = 12_000_000, spread_bits: int = 6) -> dict:
    """Train on the column ``text`` of ``docs``.  The number of shards follows the text's size, so a shard stays at
    about ``shard_chars`` characters.  A word's continuations lie in up to ``2 ** spread_bits`` shards, and the sums by
    context and by word are added up in a second shuffle.  One row of totals a kind reaches the driver; the arrays never
    do."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    folder = shared_folder(spark, "ngrams")
    # one task a shard: hashed shard numbers would meet several times in some tasks
    pairs = (count_pairs(docs, shards, spread_bits).repartitionById(shards, F.col("shard")).groupBy("shard")
             .applyInPandas(merge_pairs(folder, shards), SUMS))
    slot = F.col("shard") + F.when(F.col("kind") == "words", shards).otherwise(0)
    done = (pairs.withColumn("slot", slot).repartitionById(2 * shards, F.col("slot")).groupBy("slot", "kind")
            .applyInPandas(merge_sums(folder), f"kind string, {', '.join(f'{t} long' for t in TOTALS)}"))
    sums = {r[0]: list(r[1:]) for r in done.groupBy("kind").agg(*[F.sum(t).alias(t) for t in TOTALS]).collect()}
    none = [0] * len(TOTALS)
    words = sums.get("words", none)
    return {"folder": folder, "shards": shards, "spread_bits": spread_bits, "types": words[0], "tokens": words[1],
            "pairs": words[2], "pair_discount": discounts(np.array(sums.get("pairs", none)[:4])),
            "word_discount": discounts(np.array(words[3:7])), "word_n": [words[3], words[4], words[7]]}


class Scorer:
    """Scores token sequences against the mapped files."""

    def __init__(self, model: dict):
        self.m, self.open = model, OrderedDict()

    def find(self, kind: str, shard: np.ndarray, wanted: np.ndarray, columns: int) -> list[np.ndarray]:
        """Counts of the ``wanted`` keys, each in its shard's file."""
        out = [np.zeros(len(wanted), np.int64) for _ in range(columns)]
        order = np.lexsort((wanted, shard))
        edge = np.searchsorted(shard[order], np.arange(self.m["shards"] + 1))
        for s in np.flatnonzero(np.diff(edge)):
            sel = order[edge[s]:edge[s + 1]]
            part = self.part(kind, int(s), columns)
            if part is not None:
                for o, v in zip(out, look_up(part[0], wanted[sel], part[1])):
                    o[sel] = v
        return out

    def part(self, kind: str, shard: int, columns: int):
        """A shard's file, mapped; the one not used for longest is let go beyond ``MAPPED`` of them."""
        if (kind, shard) not in self.open:
            path = os.path.join(self.m["folder"], f"{kind}{shard}.bin")
            self.open[kind, shard] = load(path, columns) if os.path.exists(path) else None
            if len(self.open) > MAPPED:
                self.open.popitem(last=False)
        self.open.move_to_end((kind, shard))
        return self.open[kind, shard]

    def score(self, word: np.ndarray, context: np.ndarray):
        """(count of each token's word, its log10 probability)."""
        m, shards = self.m, self.m["shards"]
        types, of = np.unique(word, return_inverse=True)
        seen, before = (x[of] for x in self.find("words", shard_of(types, shards), types, 2))
        d, n = m["word_discount"], m["word_n"]
        free = sum(d[k + 1] * n[k] for k in range(3)) / max(m["pairs"], 1) if m["pairs"] else 1.0
        low = (np.maximum(before - d[np.minimum(before, 3)], 0) / max(m["pairs"], 1) + free / (m["types"] + 1))
        heads, of = np.unique(context, return_inverse=True)
        total, n1, n2, n3 = (x[of] for x in self.find("contexts", shard_of(heads, shards), heads, 4))
        at = shard_of(unit_of(context, word, m["spread_bits"]), shards)
        pair = self.find("pairs", at, pair_key(context, word), 1)[0]
        d = m["pair_discount"]
        rest = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1), 1.0)
        high = np.maximum(pair - d[np.minimum(pair, 3)], 0) / np.maximum(total, 1)
        return seen, np.log10(high + rest * low)


def score_texts(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens (words and the end), n_known, base_score (add-0.1 unigram model) and score."""
    at = docs.columns.index(text_col)
    tokens, types = model["tokens"], model["types"]
    held: list[Scorer] = []  # one per task: the files stay mapped from batch to batch

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        if not held:
            held.append(Scorer(model))
        table, scorer, parts = hash_table(), held[0], []
        for _, hashes, counts in token_groups(encoded(batch.column(at)), table):
            word, context, first = sequence(hashes, counts)
            seen, score = scorer.score(word, context)
            base = np.log10((seen + 0.1) / (tokens + 0.1 * (types + 1)))
            parts.append((counts + 1, *[np.add.reduceat(x, first) for x in ((seen > 0).astype(np.int64), base, score)]))
        if not parts:
            return [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        return [pa.array(np.concatenate(c)) for c in zip(*parts)]

    return with_arrow(docs, run, "n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Train on all documents outside the held-out fold, score all: ``id_col``, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    A null text counts as empty and scores its end alone.  Unknown words share the mass left for one further word.
    An empty table gives an empty result.  Rows repeat as they do in ``docs``.
    """
    base = docs.select(id_col, held_out(id_col, folds).alias("held_out"), text_or_empty(text_col).alias("text"))
    model = train(base.where("not held_out").select("text"))
    return score_texts(base, model).select(
        id_col, "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        "base_score", "score")
