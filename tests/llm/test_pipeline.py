"""corpus_pipeline.run() against a brute-force version of every stage, in both directions, and the stages on odd tables."""

import collections
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from riskframe.llm import langid, mixing, pii

from test_operators import slow_base, slow_simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def windows(items):
    out = collections.defaultdict(set)
    for text in items:
        w = words(text)
        n = min(len(w), 10)
        for s in range(len(w) - n + 1 if w else 0):
            out[n].add(tuple(w[s:s + n]))
    return out


def touched(text, marks):
    w = words(text)
    return any(tuple(w[s:s + n]) in known for n, known in marks.items() for s in range(len(w) - n + 1))


def survivors(texts):
    """The smallest id of each component of fingerprints that differ in at most 4 bits."""
    ids = sorted(texts)
    fp = np.array([slow_simhash(texts[i]) for i in ids], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    label = np.arange(len(ids))
    while True:
        new = np.where(near, label[None, :], len(ids)).min(axis=1)
        if (new == label).all():
            return {i for k, i in enumerate(ids) if label[k] == k}
        label = new


def planted(clean, items):
    """Copies, near copies, benchmark passages and personal data, under ids of their own and some under smaller ones."""
    long = [r for r in clean if r["text"] and len(r["text"].split()) > 60][:12]
    at = 10 ** 6
    for k, r in enumerate(long):
        w = r["text"].split()
        changed = [*w[:30], "other", *w[31:]]
        texts = [r["text"], " ".join(changed), r["text"] + f" mail someone{k}@host.example or +49 30 1234 5678",
                 " ".join([*w[:40], items[k % len(items)], *w[40:]])]
        for n, t in enumerate(texts):
            yield (-(k + 1) if n == 1 and k % 2 else at, t, r["lang"], r["source"], len(t))
            at += 1
    for t in (None, "", " \n ", "123 456", "?!"):
        yield (at, t, None, "odd", len(t or ""))
        at += 1


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    bench.write.parquet(f"{path}/benchmark.parquet")
    items = [r["text"] for r in bench.collect() if len(words(r["text"])) >= 10]
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and items
    more = spark.createDataFrame(list(planted(docs.collect(), items)), docs.schema)
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mixture"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_the_brute_force_of_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == docs.count()
    said = langid.identify(docs.select("doc_id", "text"), langid.train(docs)).collect()
    kept = {r["doc_id"] for r in said if r["lang_pred"] != "und" and r["score"] >= 0.3}
    assert {i for i in rows if i not in kept} >= {i for i, r in rows.items() if r["source"] == "odd"}
    assert kept >= {i for i, r in rows.items() if r["lang"] is not None and len((r["text"] or "").split()) > 20}
    one = survivors({i: rows[i]["text"] for i in kept})
    assert 0 < len(kept) - len(one) and any(i < 0 for i in one)
    marks = windows([r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    clean = {i for i in one if not touched(rows[i]["text"], marks)}
    assert clean and clean < one
    text = {i: pii.mask(rows[i]["text"], pii.find_spans(rows[i]["text"])) for i in clean}
    assert any(text[i] != rows[i]["text"] for i in clean) and not any(slow_base(t) for t in text.values())
    left = [(i, t, rows[i]["lang"], rows[i]["source"], len(t) if t != rows[i]["text"] else rows[i]["n_chars"])
            for i, t in text.items()]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", left)
    mixed = con.sql(mixing.ORACLE).fetchall()  # without the limit of 4 passes
    assert mixed and max(r[3] for r in mixed) <= 4
    held = {r[0]: r for r in left}
    want = collections.Counter((*held[i], n, k, b, r) for i, _, n, k, b, r in mixed)
    out = corpus_pipeline.run(spark, folder)
    got = collections.Counter(tuple(r) for r in out.select(
        "doc_id", "text", "lang", "source", "n_chars", "n_tokens", "pass", "block", "rank").collect())
    assert got == want


ODD = ("doc_id long, text string, lang string, source string, n_chars int, fp string, rank int, text_hash string, "
       "word string, lang_pred string, score double, item string, tokens string, u string, copy int")


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(1, "", "en", "a", 0), (1, "", "en", "a", 0)],
                                  [(1, "one two three", "en", None, 13), (1, "one two three", "en", None, 13),
                                   (2, "x" * 300_000, None, "a", None), (3, "der Hund und die Katze " * 20, "de", "a", 5)]])
def test_stages_take_odd_tables(spark, folder, rows):
    """Nulls in every column, no rows, repeated rows, a very long word, and extra columns with names of the operators' own."""
    more = ("f", 1, "h", "w", "l", 0.5, "i", "t", "u", 7)
    docs = spark.createDataFrame([(*r, *more) for r in rows], ODD)
    before = collections.Counter(tuple(r) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        got = [tuple(r) for r in out.collect()]
        if name == "mixture":
            assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in rows if r[1]}
            assert {r["source"] for r in out.collect()} == {r[3] or "" for r in rows if r[1]}
            continue
        assert out.columns == docs.columns, name
        assert not collections.Counter(got) - before, name
        if name == "language":
            assert not any(r[1] in (None, "") for r in got)
        if name == "near_duplicates":
            assert len(got) == len({slow_simhash(r[1]) for r in rows})
        if name in ("decontamination", "personal_data"):
            assert collections.Counter(got) == before
