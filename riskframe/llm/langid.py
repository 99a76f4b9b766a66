"""Hierarchical language identification: the family first, then one-versus-one linear SVMs inside the family."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, strings, with_arrow, written
from .linear import fit_hinge, sigmoid
from .tokens import pieces

#: Families of closely related languages by ISO 639-1 code; a code not listed is its own family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}
UNKNOWN = "und"
BITS = 15
SCALE = 20.0  # relative frequencies are small; the SVMs see them times this
SAMPLE_BYTES = 256 << 20
LETTERS = re.compile(r"[^\W\d_]+")


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for m in LETTERS.finditer(text) for c in m[0])


def trigrams(texts: list[str]):
    """(text numbers, hashed byte trigrams of the lower-cased texts) in bounded memory; no trigram spans two texts."""
    for of, group in pieces([b" " + t.lower().encode("utf-8") + b" " for t in texts], overlap=2):
        size = np.array([max(0, len(p) - 2) for p in group])
        a = np.frombuffer(b"".join(group), np.uint8).astype(np.uint32)
        ends = np.cumsum([len(p) for p in group])
        inner = np.ones(len(a), bool)
        for back in (1, 2):
            inner[np.maximum(ends - back, 0)] = False
        at = np.flatnonzero(inner)
        code = (a[at] << 16) | (a[at + 1] << 8) | a[at + 2]
        yield np.array(of), size, (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def frequencies(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, relative frequencies) of each text's trigrams."""
    out = []
    for text in texts:  # one dense histogram at a time
        counts = sum(np.bincount(code, minlength=1 << BITS) for _, _, code in trigrams([text]))
        idx = np.flatnonzero(counts)
        out.append((idx, SCALE * counts[idx] / max(1, counts.sum())))
    return out


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, per_lang: int) -> DataFrame:
    """(lang, text) of about ``per_lang`` training documents of each language, chosen by a hash of id and text."""
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
                        held_out(id_col, folds).alias("out"), F.xxhash64(id_col, text_col).alias("h"))
    known = known.where("not out and lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    wanted = F.lit(False)
    for lang, n in sorted(counts.items()):
        share = min(1_000_000, -(-per_lang * 1_000_000 // n))
        wanted = wanted | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1_000_000)) < share))
    return known.where(wanted).select("lang", "text")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5,
          per_lang: int = 600, c: float = 1.0, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """The models, fitted on a bounded sample of about ``per_lang`` documents per language and at most about
    ``sample_bytes`` of features.  Workers make the sparse features of whole texts; only those of the sample reach the
    driver, packed.  Families are told apart by one model each against the rest; inside a family of m languages
    there are m * (m - 1) / 2 machines, each fitted on the documents of its two languages alone."""
    sample = labelled_sample(docs, id_col, text_col, lang_col, folds, per_lang)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = frequencies(strings(batch.column(1)))
        return [pa.array([i.astype(np.int32).tobytes() for i, _ in rows], pa.binary()),
                pa.array([v.astype(np.float64).tobytes() for _, v in rows], pa.binary())]

    made = written(with_arrow(sample, run, "idx binary, val binary").select("lang", "idx", "val"), "language-sample")
    size = made.agg(F.sum(F.octet_length("idx") + F.octet_length("val"))).first()[0] or 0
    share = min(1_000_000, sample_bytes * 1_000_000 // max(size, 1))
    made = made.where(F.pmod(F.xxhash64("idx", "val"), F.lit(1_000_000)) < share).orderBy("lang", "idx", "val").collect()
    rows = [(np.frombuffer(r["idx"], np.int32).astype(np.int64), np.frombuffer(r["val"])) for r in made]
    langs = np.array([r["lang"] for r in made], dtype=object)
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family(lang), []).append(lang)
    columns: list[tuple[np.ndarray, float]] = []

    def machine(some: list[int], positive) -> int:
        """The column of a model of the rows ``some``, those where ``positive`` holds against the others."""
        y = np.array([1.0 if positive(i) else -1.0 for i in some])
        columns.append(fit_hinge([rows[i] for i in some], y, 1 << BITS, c))
        return len(columns) - 1

    names = sorted(families)
    of = [family(x) for x in langs]
    top = [machine(range(len(rows)), lambda i, f=f: of[i] == f) for f in names] if len(names) > 1 else None
    groups = []
    for f in names:
        duels = []
        for a, b in combinations(range(len(families[f])), 2):
            one, other = families[f][a], families[f][b]
            some = [i for i in range(len(rows)) if langs[i] in (one, other)]
            duels.append((a, b, machine(some, lambda i, one=one: langs[i] == one)))
        groups.append((families[f], duels))
    weights = np.stack([w for w, _ in columns], axis=1) if columns else np.zeros((1 << BITS, 1))
    return {"weights": (SCALE * weights).astype(np.float32), "bias": np.array([b for _, b in columns] or [0.0]),
            "top": top, "groups": groups}


def votes(margin: np.ndarray, names: int, duels: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(winner, its lead) of every row from the machines (first, second, column): a margin of at least 0 is a vote for the
    first.  Most votes win; ties go to the larger sum of a language's margins over its machines, then to the first
    name.  The lead is the winner's margin over the next in that order."""
    n = len(margin)
    count, total, duel = np.zeros((n, names)), np.zeros((n, names)), np.zeros((n, names, names))
    for a, b, column in duels:
        m = margin[:, column]
        count[:, a] += m >= 0
        count[:, b] += m < 0
        total[:, a] += m
        total[:, b] -= m
        duel[:, a, b], duel[:, b, a] = m, -m
    order = np.lexsort((np.broadcast_to(np.arange(names), (n, names)), -total, -count), axis=1)
    return order[:, 0], duel[np.arange(n), order[:, 0], order[:, 1]]


def predict(texts: list[str], model: dict) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text: the family of the largest margin, and in it the language with most votes.  The
    score multiplies, over both levels, the sigmoid of the lead over the next; a level with one class counts 1."""
    w, n = model["weights"], len(texts)
    total, sums = np.zeros(n), np.zeros((n, w.shape[1]))
    for of, size, code in trigrams(texts):
        full = np.flatnonzero(size)
        if len(full):
            begin = (np.cumsum(size) - size)[full]
            np.add.at(sums, of[full], np.add.reduceat(w[code], begin, axis=0, dtype=np.float64))
            np.add.at(total, of[full], size[full])
    margin = sums / np.maximum(total, 1)[:, None] + model["bias"]

    def best(columns, rows):
        m = margin[rows][:, columns]
        order = np.argsort(-m, axis=1, kind="stable")
        lead = np.take_along_axis(m, order[:, :1], 1) - np.take_along_axis(m, order[:, 1:2], 1)
        return order[:, 0], sigmoid(4 * lead[:, 0])

    lang, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
    rows = np.array([i for i, t in enumerate(texts) if has_letter(t)], dtype=np.int64)
    if len(rows) and model["groups"]:
        group, p = best(model["top"], rows) if model["top"] else (np.zeros(len(rows), np.int64), np.ones(len(rows)))
        for g, (names, duels) in enumerate(model["groups"]):
            mine = rows[group == g]
            if len(mine):
                k, lead = votes(margin[mine], len(names), duels) if duels else (np.zeros(len(mine), np.int64), None)
                lang[mine] = np.array(names, dtype=object)[k]
                # a machine's two sides differ by twice its margin
                score[mine] = p[group == g] * (1.0 if lead is None else sigmoid(8 * lead))
    return lang.tolist(), score


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. Null texts, texts without a letter and all texts of a model that learned
    nothing are ``und`` with score 0. Other columns pass as they are and are no input."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, langs, scores = strings(batch.column(at)), [], []
        for k in range(0, len(texts), 500):
            lang, score = predict(texts[k:k + 500], model)
            langs += lang
            scores.append(score)
        return [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]

    return with_arrow(docs.withColumn(text_col, F.col(text_col).cast("string")), run, "lang_pred string, score double")


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    folds: int = 5, per_lang: int = 600) -> DataFrame:
    """Per document: ``id_col``, held_out, lang_pred, score.

    Null and empty texts, and texts without a letter, are ``und``; null languages teach nothing; rows repeat as they do
    in ``docs``; an empty table gives an empty result; other columns are not read, whatever their names."""
    model = train(docs, id_col, text_col, lang_col, folds, per_lang)
    base = docs.select(id_col, held_out(id_col, folds).alias("held_out"), F.col(text_col).alias("text"))
    return identify(base, model).select(id_col, "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5,
               per_lang: int = 600, min_score: float = 0.3) -> DataFrame:
    """``docs`` without the documents that have no language (``und``) or whose best score is below ``min_score``.
    The score of a clear decision is near 1 and that of a tie at both levels 0.25.  Null and empty texts have no
    language; repeated rows stay or go together; an empty table stays empty; all columns pass as they are."""
    model = train(docs, id_col, text_col, lang_col, folds, per_lang)
    columns = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    found = identify(flat, model, f"c{columns.index(text_col)}")
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).drop("lang_pred", "score").toDF(*columns)
