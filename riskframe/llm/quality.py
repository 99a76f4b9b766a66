"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, strings, text_or_empty, with_arrow
from .linear import fit_hinge, fit_sigmoid, sigmoid
from .tokens import hash_table, hash_words, pieces

CHAR_BITS, SHAPE_BITS = 16, 13
SIZE = (1 << CHAR_BITS) + (1 << SHAPE_BITS)

#: Byte classes of a word's shape: 0 lower case, 1 upper case, 2 digit, 3 stop or comma, 4 other mark, 5 beyond ASCII.
CLASSES = np.array([2 if 48 <= b < 58 else 1 if 65 <= b < 91 else 0 if 97 <= b < 123 else 3 if b in (44, 46) else
                    5 if b > 127 else 4 for b in range(256)], np.uint32)


def indicators(text: str, table: np.ndarray) -> np.ndarray:
    """Features of one whole text: which hashed byte trigrams occur, and which n-grams (1 to 3) of word shapes.  A
    word's shape is the classes of its first, second and last byte and whether it repeats the word before it."""
    seen = np.zeros(SIZE, bool)
    last = None  # shapes and hash at the end of the piece before
    for _, group in pieces([text.encode("utf-8")]):
        data = group[0]
        a = np.frombuffer(data, np.uint8).astype(np.uint32)
        if len(a) > 2:
            code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
            seen[(code * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS)] = True
        h, starts, ends = hash_words(data.lower(), table)
        if not len(h):
            continue
        k = CLASSES[a]
        second = np.minimum(starts + 1, ends - 1)
        same = np.zeros(len(h), np.uint32)
        same[1:] = h[1:] == h[:-1]
        same[0] = last is not None and last[1] == h[0]
        shape = 1 + (((same * 6 + k[starts]) * 6 + k[second]) * 6 + k[ends - 1]).astype(np.uint32)
        run = np.concatenate([last[0] if last else np.zeros(2, np.uint32), shape])
        for code in (run[2:], run[2:] + 512 * run[1:-1], run[2:] + 512 * run[1:-1] + 262144 * run[:-2]):
            code = (code + np.uint32(1)) * np.uint32(2246822519)
            seen[(1 << CHAR_BITS) + ((code ^ (code >> np.uint32(15))) * np.uint32(3266489917)
                                     >> np.uint32(32 - SHAPE_BITS))] = True
        last = (run[-2:], h[-1])
    return np.flatnonzero(seen)


def log_count_ratio(rows: list[np.ndarray], positive: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed class shares of each indicator."""
    p, q = (np.full(SIZE, alpha) for _ in range(2))
    for idx, yes in zip(rows, positive):
        (p if yes else q)[idx] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit(rows: list[np.ndarray], positive: np.ndarray, c: float = 1.0, mean_share: float = 0.25) -> dict:
    """Weights over ratio-scaled, length-normalised indicators; ``mean_share`` of the mean weight is mixed in, as NB-SVM
    interpolation does. One class alone gives a model that always answers it."""
    if len(rows) == 0 or positive.all() or not positive.any():
        return {"always": 1.0 if len(rows) and positive.all() else 0.0 if len(rows) else 0.5}
    ratio = log_count_ratio(rows, positive)
    scaled = [(i, ratio[i] / max(1e-12, np.linalg.norm(ratio[i]))) for i in rows]
    w, b = fit_hinge(scaled, np.where(positive, 1.0, -1.0), SIZE, c)
    w = (1 - mean_share) * w + mean_share * np.abs(w).mean() * np.sign(w)
    margin = np.array([w[i] @ v + b for i, v in scaled])
    a, shift = fit_sigmoid(margin, positive)
    return {"ratio": ratio.astype(np.float32), "weight": (w * ratio).astype(np.float32), "bias": b, "a": a, "b": shift}


def score(idx: np.ndarray, model: dict) -> float:
    if "always" in model:
        return model["always"]
    norm = max(1e-12, float(np.linalg.norm(model["ratio"][idx])))
    return float(sigmoid(model["a"] * (float(model["weight"][idx].sum()) / norm + model["bias"]) + model["b"]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", folds: int = 5, per_class: int = 1500) -> dict:
    """Fit on a bounded sample: about ``per_class`` labelled training rows of each class, chosen by a hash of the id.
    The chosen ids (at most some thousands) are broadcast; workers make the features of the whole texts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"),
                          held_out(id_col, folds).alias("out")).where("not out and y in (0, 1)").select("id", "y").distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(1_000_000))
    wanted = F.lit(False)
    for y, n in counts.items():
        wanted = wanted | ((F.col("y") == y) & (part < min(1_000_000, -(-per_class * 1_000_000 // n))))
    chosen = F.broadcast(known.where(wanted))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(chosen, "id")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        table = hash_table()
        return [pa.array([indicators(t, table).tolist() for t in strings(batch.column(1))], pa.list_(pa.int32()))]

    made = with_arrow(texts.select("y", "text"), run, "idx array<int>").select("y", "idx").collect()
    return fit([np.array(r["idx"], np.int64) for r in made], np.array([r["y"] == 1 for r in made], bool))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", folds: int = 5, per_class: int = 1500, threshold: float = 0.3) -> DataFrame:
    """Per document: ``id_col``, held_out, score (0 to 1, higher: better), predicted.

    A null text counts as empty and is scored like any other. Only the text is an input of a score. Rows repeat as in
    ``docs``; an empty table gives an empty result; without labels every score is 0.5.
    """
    model = train(docs, labels, id_col, text_col, label_col, folds, per_class)
    base = docs.select(id_col, held_out(id_col, folds).alias("held_out"), text_or_empty(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        table = hash_table()
        return [pa.array([score(indicators(t, table), model) for t in strings(batch.column(2))], pa.float64())]

    out = with_arrow(base, run, "score double")
    return out.select(id_col, "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
