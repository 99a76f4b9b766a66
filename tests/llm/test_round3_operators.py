"""Whitening, WARC and lexical search against brute force, and their rules for nulls, empty and long values, repeated rows,
ties, empty tables and extra columns with clashing names."""

import base64
import collections
import gzip
import hashlib
import math
import os
import re
from fractions import Fraction

import numpy as np
import pytest

from riskframe.llm import lexical, warc, whitening


# ------------------------------------------------------------------ 11 whitening
VECTORS = "vec_id long, embedding array<double>, n string, component int, _x string, whitened double"


def vector_rows(vectors, first=1):
    return [(None if i == 4 else i + first, v, "x", 1, "y", 0.5) for i, v in enumerate(vectors)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0], [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0]]
    return base.tolist() + [base[0].tolist()] * 30 + [(base[1] + 1e-9).tolist()] + odd


def exact_whitening(vectors):
    good = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in good]
    fit = sorted(set(x))
    n, dim = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(dim)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n) for j in range(dim)] for i in range(dim)]
    values, basis = np.linalg.eigh(np.array(cov))
    return x, n, sums, values[::-1], basis[:, ::-1]


def test_whitening_matches_exact_fractions(spark, vectors):
    df = spark.createDataFrame(vector_rows(vectors), VECTORS).repartition(5)
    got = whitening.whitened(df, components=3).collect()
    x, n, sums, values, basis = exact_whitening(vectors)
    ids = [r[0] for r in vector_rows(vectors)[:len(x)]]
    assert len(got) == 3 * len(x)
    by = collections.defaultdict(list)
    for r in got:
        by[r["vec_id"], r["component"]].append(r)
    for k in range(1, 4):
        sign = 0
        for vec_id, v in zip(ids, x):
            (r,) = by[vec_id, k]
            want = float(sum(float(Fraction(n * c - s, n)) * b for c, s, b in zip(v, sums, basis[:, k - 1]))) / math.sqrt(values[k - 1])
            sign = sign or (1 if r["whitened"] * want > 0 else -1)
            assert r["whitened"] == pytest.approx(sign * want, abs=1e-9)
            assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(v, sums))
            assert r["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-10)
            assert 0 <= r["identity_error"] < 1e-9


def test_polarised_covariance_is_exact_for_large_entries():
    rng = np.random.default_rng(2)
    y = rng.integers(-2 ** 40, 2 ** 40, (300, 3))
    assert whitening.squares(y) == [sum(int(a) ** 2 for a in c) for c in (
        y[:, 0], y[:, 0] + y[:, 1], y[:, 0] + y[:, 2], y[:, 1], y[:, 1] + y[:, 2], y[:, 2])]
    n, total = len(y), [int(s) for s in y.sum(axis=0)]
    floor, rest = [s // n for s in total], [s % n for s in total]
    v = whitening.covariance(n, rest, whitening.squares(y - np.array(floor)))
    for i in range(3):
        for j in range(3):
            want = sum((Fraction(int(a)) - Fraction(total[i], n)) * (Fraction(int(b)) - Fraction(total[j], n))
                       for a, b in zip(y[:, i], y[:, j])) / n
            assert v[i, j] == float(want)


def test_whitening_of_few_constant_and_empty_vectors(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for data in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [[], None]):
        got = whitening.whitened(spark.createDataFrame(vector_rows(data), VECTORS))
        assert got.columns == columns and got.count() == 0
    two = whitening.whitened(spark.createDataFrame(vector_rows([[0.0, 3.0], [1.0, 3.0]]), VECTORS)).collect()
    assert sorted((r["component"], abs(r["whitened"]), r["deviation"]) for r in two) == [(1, 1.0, 64 ** 2)] * 2
    with pytest.raises(ValueError, match="several lengths"):
        whitening.whitened(spark.createDataFrame(vector_rows([[1.0], [1.0, 2.0]]), VECTORS))
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(spark.createDataFrame(vector_rows([[1e300], [1.0]]), VECTORS))


# ------------------------------------------------------------------ 12 WARC
PAGES = "page_id long, url string, html string, key string, range int, role string, copies long"
ARTICLE = "<html><p>" + "word " * 400 + "</p></html>"


def page_rows():
    rows = [(i, f"http://h{i % 3}.example/p/{i}", f"<p>{i} {'é' * i}</p>") for i in range(40)]
    rows += [(100 + i, f"http://copy.example/{i % 7}", ARTICLE) for i in range(30)]
    rows += [(107, "http://copy.example/0", ARTICLE)] * 3 + [(200, "http://copy.example/z", ARTICLE)] * 2
    rows += [(300, None, None), (301, "", ""), (None, "http://null.example/", "only"), (None, None, "only"), (302, "u", "only")]
    rows += [(400, "http://odd.example/a b\r\nX: ü<>?q=1%20", "x"), (401, "http://long.example/" + "y" * 3000, "z" * 3_000_000)]
    return [(*r, "k", 1, "r", 2) for r in rows]


@pytest.fixture(scope="module")
def page_table(spark):
    return spark.createDataFrame(page_rows(), PAGES).repartition(4)


def expected(rows, least=0):
    body = [(r[0], r[1], (r[2] or "").encode()) for r in rows]
    by = collections.defaultdict(list)
    for i, r in enumerate(body):
        by[r[2]].append(i)
    out = collections.Counter()
    for data, group in by.items():
        top = max(group, key=lambda i: (body[i][0] is not None, body[i][0] or 0, body[i][1] is not None, body[i][1] or ""))
        for i in group:
            own = i == top or len(data) < least
            out[body[i][0], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                "response" if own else "revisit", None if own else body[top][0]] += 1
    return out


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


def files_of(root):
    return {f: hashlib.sha256(open(f"{root}/{f}", "rb").read()).hexdigest() for f in os.listdir(root) if f.endswith(".gz")}


@pytest.mark.parametrize("least", [0, 100])
def test_warc_round_trip(page_table, tmp_path, least):
    got = warc.archived(page_table, f"{tmp_path}/a", min_revisit_bytes=least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert counted(got) == expected(page_rows(), least)


def test_warc_files_do_not_depend_on_partitions(spark, page_table, tmp_path):
    small = {"range_bytes": 20_000, "file_bytes": 1500}
    first = warc.write_archive(page_table, f"{tmp_path}/a", **small)
    warc.write_archive(spark.createDataFrame(page_rows()[::-1], PAGES).repartition(9, "html"), f"{tmp_path}/b", **small)
    files = files_of(f"{tmp_path}/a")
    assert files == files_of(f"{tmp_path}/b") == {r["file"]: r["sha256"] for r in first.collect()}
    ranges = collections.Counter(r["range"] for r in first.collect())
    assert len(ranges) > 3 and max(ranges.values()) > 2  # several ranges, and files rolled inside one
    assert all(r["compressed_bytes"] < 1500 + 6000 for r in first.collect())
    assert not os.path.exists(f"{tmp_path}/a/_temporary")
    uris = [re.findall(rb"WARC-Target-URI: (\S+)", gzip.open(f"{tmp_path}/a/{f}").read()) for f in sorted(files)]
    assert [u for x in uris for u in x if len(u) < 200] == sorted(u for x in uris for u in x if len(u) < 200)


def test_warc_records_refer_and_decode(spark, page_table, tmp_path):
    root = f"{tmp_path}/a"
    warc.write_archive(page_table, root, range_bytes=20_000)
    with pytest.raises(ValueError, match="holds an archive"):
        warc.write_archive(page_table, root)
    open(f"{root}/part-99999-00000.warc.gz", "wb").write(b"left by a lost attempt")  # not in the manifest
    rows = warc.read_archive(spark, root, payloads=True).collect()
    by_id = {r["record_id"]: r for r in rows}
    assert len(by_id) == len(rows) == len(page_rows())
    for r in rows:
        if r["record_type"] == "revisit":
            kept = by_id[r["refers_to_id"]]
            assert r["payload"] is None and kept["record_type"] == "response"
            assert (kept["page_id"], kept["payload_digest"]) == (r["refers_to"], r["payload_digest"])
        else:
            assert base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode() == r["payload_digest"]
    urls = {r["page_id"]: r["url"] for r in rows}
    assert urls[300] is None and urls[400] == "http://odd.example/a%20b%0D%0AX:%20%C3%BC%3C%3E?q=1%20"
    name = next(f for f in files_of(root) if f != "part-99999-00000.warc.gz")
    data = bytearray(open(f"{root}/{name}", "rb").read())
    data[len(data) // 2] ^= 1
    open(f"{root}/{name}", "wb").write(data)
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read_archive(spark, root).collect()


def test_warc_of_an_empty_table(page_table, tmp_path):
    assert warc.archived(page_table.where("false"), f"{tmp_path}/a").count() == 0
    assert files_of(f"{tmp_path}/a") == {}


def test_warc_record_checks():
    data = warc.record([("WARC-Type", "x")], b"block\r\n\r\nblock")
    assert warc.parsed(data)[1] == b"block\r\n\r\nblock"
    for bad in (data.replace(b"block", b"clock", 1), data[:-1], b"WARC/0.9" + data[8:]):
        with pytest.raises(ValueError):
            warc.parsed(bad)


# ------------------------------------------------------------------ 13 lexical search
DOCS = "doc_id long, text string, m long, docs string, terms string, rank int, score double"
WORDS = [f"w{i}" for i in range(30)]


def doc_rows():
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(WORDS, int(n), p=np.arange(30, 0, -1) / 465)) for n in rng.integers(1, 90, 150)]
    texts += ["w1 w2 w3"] * 25 + [None, "", " -- ! ", "W1,w2;W29", "ÉTÉ été Été w29", "w29 " * 700, "w0" * 5000]
    texts.append(" ".join(f"x{i}" for i in range(90_000)) + " w29 w28")
    return [(None if i % 50 == 7 else 1000 - i, t, 1, "d", "t", 1, 0.0) for i, t in enumerate(texts)]


ITEMS = [("a", "w29 w28 w28"), ("b", "W1 w2 unknown"), ("b", "W1 w2 unknown"), (None, "été"), ("c", None), ("d", "nowhere"),
         ("e", "w0 w1 w2 w3 w4 w5"), ("f", "x89999,x5"), ("g", "")]


def slow_search(docs, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    n, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = collections.Counter()
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 25 + 75 * sum(c.values()) * n // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        for rank, (s, known, d) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, d if known else None, -s] += 1
    return out


def test_lexical_search_matches_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame(doc_rows(), DOCS).repartition(5)
    items = spark.createDataFrame([(*i, 1, "x") for i in ITEMS], "item_id string, text string, doc_id long, term string")
    want = slow_search([r[:2] for r in doc_rows()], ITEMS)
    got = lexical.lexical_search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert counted(got) == want
    assert counted(lexical.lexical_search(docs, items, item_bytes=20)) == want  # items in several parts
    for name, value in (("BLOCK_DOCS", 3), ("BLOCK_TERMS", 100), ("CELLS", 5)):
        monkeypatch.setattr(lexical, name, value)
    assert counted(lexical.lexical_search(docs, items)) == want


def test_lexical_index_has_equal_m_per_block(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 10)
    vocabulary = {w.encode(): i for i, w in enumerate(WORDS)}
    counts = lexical.term_counts(spark.createDataFrame(doc_rows(), DOCS), vocabulary, "doc_id", "text").cache()
    n, length = counts.where("n > 0").count(), counts.agg({"n": "sum"}).first()[0]
    blocks = lexical.stratified_index(counts, n, length).collect()
    assert sum(len(b["docs"]) for b in blocks) == counts.where("size(terms) > 0").count()
    assert all(len(b["docs"]) <= 10 and sum(b["sizes"]) == len(b["at"]) for b in blocks)
    for b in blocks:
        groups = list(zip(b["terms"], b["tfs"]))
        assert groups == sorted(groups, key=lambda g: (g[0], -g[1])) and len(set(groups)) == len(groups)


def test_lexical_search_of_empty_tables(spark):
    docs = spark.createDataFrame(doc_rows(), DOCS)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("text is null"), items),
                 (docs, items.where("item_id = 'g'"))):
        got = lexical.lexical_search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


# ------------------------------------------------------------------ 8 votes, 1 few vectors, 4 limits
def test_one_versus_one_votes_against_brute_force():
    from riskframe.llm import langid
    rng = np.random.default_rng(5)
    names = 4
    duels = [(a, b, k) for k, (a, b) in enumerate((a, b) for a in range(names) for b in range(a + 1, names))]
    margin = rng.normal(size=(300, len(duels))).round(1)  # zeros and ties occur
    margin[:20] = 0.0
    margin[20] = [1, -1, 0.5, 1, 0.5, 0.5]  # 0 beats 1, 1 beats 2, 2 beats 0: all beat 3
    winner, lead = langid.votes(margin, names, duels)
    for row, w, d in zip(margin, winner, lead):
        count, total, against = [0] * names, [0.0] * names, {}
        for a, b, k in duels:
            count[a if row[k] >= 0 else b] += 1
            total[a] += row[k]
            total[b] -= row[k]
            against[a, b], against[b, a] = row[k], -row[k]
        order = sorted(range(names), key=lambda i: (-count[i], -total[i], i))
        assert w == order[0] and d == pytest.approx(against[order[0], order[1]])
    assert winner[0] == 0 and winner[20] in (0, 1, 2)


def test_three_languages_of_a_family_are_told_apart(spark):
    from riskframe.llm import langid
    rng = np.random.default_rng(1)
    syllables = {"en": "th ing er and wh", "de": "sch ung ein und cht", "nl": "ij oe een het ge", "fi": "ää kk nen yö ll"}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang].split(), 3)) for _ in range(25)), lang)
            for i, lang in enumerate(np.random.default_rng(2).choice(list(syllables), 400))]
    docs = spark.createDataFrame([(int(i), t, str(lang), 1.0) for i, t, lang in rows], "doc_id long, text string, lang string, score double")
    model = langid.train(docs, per_lang=60)
    assert sorted(len(d) for _, d in model["groups"]) == [0, 3]
    got = {r["doc_id"]: r for r in langid.language_report(docs, per_lang=60).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) / len(held) > 0.97
    small = langid.train(docs, per_lang=60, sample_bytes=60_000)  # a sample bounded in bytes still knows every language
    assert sorted(len(d) for _, d in small["groups"]) == [0, 3]


@pytest.mark.parametrize("n", [2, 7, 8, 11, 12, 20, 30])
def test_nearest_finds_all_that_are_due_in_small_tables(spark, n):
    from riskframe.llm import ann
    x = np.random.default_rng(n).normal(size=(n, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, every=4, k=10, probe_share=0.2).collect():
        got[r["query_id"]].append(r["rank"])
    assert set(got) == set(range(0, n, 4))
    assert all(sorted(v) == list(range(1, min(10, n - 1) + 1)) for v in got.values())


def test_mixing_meets_budgets_with_equal_rows_and_keeps_the_limit(spark):
    from riskframe.llm import mixing
    data = [(1, "a b c d e f g h i j", "same", "x")] * 20 + [(i, "a b", f"s{i % 3}", "y") for i in range(2, 62)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, rank string").repartition(6)
    total = 20 * 10 + 60 * 2
    got = mixing.mix_sources(docs, target_entropy=1.0, max_epochs=None, block_tokens=50, keep=["doc_id", "text"]).collect()
    spent = collections.Counter()
    for r in got:
        spent[r["source"]] += r["n_tokens"]
    assert all(abs(spent[s] - total / 4) <= 10 for s in ("same", "s0", "s1", "s2")) and spent["same"] == 80
    blocks = collections.defaultdict(list)
    for r in got:
        blocks[r["block"]].append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in blocks.values())
    for limit in (1.5, 2.0, 3.0):
        passes = [r["pass"] for r in mixing.mix_sources(docs, budget_ratio=limit, target_entropy=1.0, max_epochs=limit).collect()]
        assert max(passes) <= math.ceil(limit)
    with pytest.raises(ValueError, match="no mixture"):
        mixing.mix_sources(docs, budget_ratio=6.0, max_epochs=4.0)
    with pytest.raises(ValueError, match="no mixture"):
        mixing.mix_sources(docs.where("source = 'same'"), budget_ratio=6.0, max_epochs=4.0)


# ------------------------------------------------------------------ 6 broken markup, names, long alignments
def text_of(page):
    from riskframe.llm import pages
    found = pages.blocks(page)
    return pages.assemble([t for t, _ in found], [k for _, k in found], [False] * len(found))


def test_quotes_open_values_only_after_an_equals_sign():
    assert text_of("<p title=it's>Hello</p><p>World it's fine</p><p>End</p>") == "Hello\nWorld it's fine\nEnd"
    assert text_of('<article><a href=x title="5" tall">link</a> text</article>') == "link text"
    assert text_of('<p a="x > y">in</p><p b=">out') == "in\n" + 'out'
    assert text_of("<p>1 < 2 and <b>3</b> <4") == "1 < 2 and 3 <4"
    assert text_of("<!-- <p>no</p> --><p>yes</p><!-- open <p>no") == "yes"


@pytest.mark.parametrize("unit", ["a <b ", "<b =\"", "<b ='\">", "<! ", "<a href='x\" ", "</p <", "<p><div></b>", "<b><div></b>", "<p><b>x</i>", "<!--"])
def test_broken_markup_takes_linear_time(unit):
    import time
    from riskframe.llm import pages
    page = "<p>x</p>" + unit * (400_000 // len(unit))
    began = time.process_time()
    found = pages.blocks(page)
    assert time.process_time() - began < 3 and found[0] == ("x", pages.OTHER)


@pytest.mark.parametrize("name,gone", [("article-comments", True), ("user-comments", True), ("post-comments", True), ("related-articles", True),
                                       ("has-comments", False), ("no-sidebar", False), ("entry-header", False), ("overflow-hidden", False)])
def test_names_of_reader_comments_and_the_like(name, gone):
    assert text_of(f"<article><p>one</p><div class='{name}'><p>two</p></div></article>") == ("one" if gone else "one\ntwo")


def test_alignment_in_halves_is_as_long(monkeypatch):
    from riskframe.llm import pages
    rng = np.random.default_rng(3)
    for n, m in ((60, 80), (1, 30), (200, 3), (0, 5), (37, 37)):
        a, b = rng.integers(0, 9, n).tolist(), rng.integers(0, 9, m).tolist()
        monkeypatch.setattr(pages, "ROW_BITS", 1 << 26)
        whole = pages.common_lines(a, b)
        monkeypatch.setattr(pages, "ROW_BITS", 40)
        halves = pages.common_lines(a, b)
        assert sum(whole) == sum(halves)
        it = iter(b)
        assert all(x in it for x, s in zip(a, halves) if s)  # the marked lines are a subsequence of b


# ------------------------------------------------------------------ 5 files of the language model
def test_counts_of_any_size_are_kept_exactly(tmp_path):
    from riskframe.llm import lm
    key = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 500, dtype=np.uint64))
    counts = [np.arange(len(key)) * step for step in (1, 0, 1 << 33)]
    lm.save(str(tmp_path), "x", key, *counts)
    got, columns = lm.load(str(tmp_path / "x.bin"), 3)
    assert (got == key).all()
    wanted = np.sort(np.concatenate([key, key + np.uint64(1)]))
    for found, c in zip(lm.look_up(got, wanted, columns), counts):
        true = dict(zip(key.tolist(), c.tolist()))
        assert found.tolist() == [true.get(k, 0) for k in wanted.tolist()]
    for x in (np.array([0, 254, 255, 256]), np.array([1 << 32, 7]), np.array([], np.int64)):
        assert lm.unpacked(lm.packed(x), len(x)).tolist() == x.tolist()
    lm.save(str(tmp_path), "empty", np.array([], np.uint64), np.array([], np.int64))
    none, columns = lm.load(str(tmp_path / "empty.bin"), 1)
    assert lm.look_up(none, wanted, columns)[0].sum() == 0


def test_model_does_not_depend_on_shards_and_units(spark, monkeypatch):
    from riskframe.llm import lm
    rng = np.random.default_rng(5)
    texts = [" ".join("the " + f"w{int(x)}" for x in rng.zipf(1.3, 400) % 3000) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate([*texts, "", None])), "doc_id long, text string").repartition(3)
    train = d.where("text is not null")

    def scores(**how):
        model = lm.train(train, **how)
        rows = lm.score_texts(d, model).collect()
        return model, {r["doc_id"]: (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows}

    one, true = scores(spread_bits=0)
    monkeypatch.setattr(lm, "MAPPED", 3)
    many, got = scores(shard_chars=20_000, spread_bits=6)
    assert one["shards"] == 1 and many["shards"] > 5
    assert {k: one[k] for k in ("types", "tokens", "pairs", "word_n")} == {k: many[k] for k in ("types", "tokens", "pairs", "word_n")}
    for i, row in true.items():
        assert row[:2] == got[i][:2] and np.allclose(row[2:], got[i][2:], rtol=1e-12)
    # the continuations of the most frequent word lie in many shards
    word = np.random.default_rng(7).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    unit = lm.unit_of(np.full(5000, 12345, np.uint64), word, 6)
    assert len(np.unique(unit)) == 64 and len(np.unique(lm.shard_of(unit, 40))) > 20


# ------------------------------------------------------------------ 6 every page is aligned, marked or not
def random_page(rng, vocabulary=24):
    """(html, lines, sections): no line twice and all in one order, so the longest common subsequence is the lines in both.
    A section is (kind, lines, whether it has an h1)."""
    words = sorted(rng.choice(vocabulary, rng.integers(0, 12), replace=False).tolist())
    kinds = rng.choice(["nav", "p", "article", "hint"], 4, p=[.2, .3, .3, .2]).tolist()
    cuts = sorted(rng.integers(0, len(words) + 1, 3).tolist())
    sections, page = [], ""
    for kind, first, last in zip(kinds, [0, *cuts], [*cuts, len(words)]):
        lines, headed = [f"line {w}" for w in words[first:last]], bool(rng.random() < .3)
        sections.append((kind, lines, headed and bool(lines)))
        tag = "h1" if headed else "p"
        inside = "".join(f"<{tag}>{x}</{tag}>" for x in lines)
        page += {"nav": f"<nav>{inside}</nav>", "p": inside, "article": f"<article>{inside}</article>",
                 "hint": f"<div class='post-body'>{inside}</div>"}[kind]
    return page, [x for s in sections for x in s[1]], sections


def expected_text(sections, other):
    """(text, shared lines, restored lines) given the lines of the page to differ from."""
    kept = []
    for kind in ("article", "hint", "p"):
        found = [s for s in sections if s[0] == kind and s[1]]
        if found and kind != "p":
            own = [any(x not in other for x in s[1]) for s in found]
            kept = [x for s, o in zip(found, own) if o or s[2] or not any(own) for x in s[1]]
            break
        lines = [x for s in found for x in s[1]]
        kept = [x for x in lines if x not in other] or lines
    return "\n".join(kept), sum(x in other for s in sections for x in s[1]), sum(x in other for x in kept)


def test_every_page_is_differenced_against_its_nearest_url(spark, monkeypatch):
    from riskframe.llm import pages
    rng = np.random.default_rng(8)
    rows, made = [], {}
    for i in range(400):
        page, lines, sections = random_page(rng)
        url = f"http://{rng.choice(['a.com', 'B.com', 'c.org'])}/{rng.choice(['x', 'yy', 'yz'])}/{i * 7 % 400}" if i % 40 else None
        made[i] = (lines, sections)
        rows += [(i, url, page)] * (3 if i % 50 == 7 else 1)
    rows.append((None, "http://alone.net", "<article>one</article>"))
    made[None] = (["one"], [("article", ["one"], False)])

    def place(row):
        host, _, path = (row[1] or "").split("://", 1)[-1].partition("/")
        return host.lower(), path, -1 if row[0] is None else row[0]

    ordered = sorted(rows, key=place)
    want = collections.Counter()
    for at, row in enumerate(ordered):
        host, path, _ = place(row)
        near = [r for r in ordered[max(at - 1, 0):at] + ordered[at + 1:at + 2] if place(r)[0] == host]
        best = max(near, key=lambda r: len(os.path.commonprefix([place(r)[1], path])), default=None)
        text, shared, restored = expected_text(made[row[0]][1], set(made[best[0]][0]) if best else set())
        want[row[0], row[1], text, len(text), shared, restored] += 1
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts, size in ((1, 1 << 27), (3, 1500), (50, 400)):  # 8, 38 and 141 ranges asked for
        monkeypatch.setattr(pages, "RANGE_BYTES", size)
        got = collections.Counter(map(tuple, pages.main_texts(d.repartition(parts)).collect()))
        assert got == want
    assert sum(k[5] * n for k, n in want.items()) > 50  # lines that markup brought back


def test_named_elements_that_neighbours_repeat_are_template(spark):
    from riskframe.llm import pages
    teaser = "<article class=card><h2>Read next</h2><p>Ten tips</p></article>"
    both = "<p>Republished</p>"
    data = [(1, "http://h.com/a/1", f"<article><p>One</p>{both}</article>{teaser}"), (2, "http://h.com/a/2", f"<article><p>Two</p>{both}</article>{teaser}"),
            (3, "http://i.com/a/1", f"<article><p>One</p></article>{teaser}"), (4, "http://i.com/a/2", f"<article><p>One</p></article>{teaser}"),
            (5, "http://j.com/a/1", "<div class=post-title><h1>News</h1></div><div class=post-body>One</div><div class=content-strip>Hot</div>"),
            (6, "http://j.com/a/2", "<div class=post-title><h1>News</h1></div><div class=post-body>Two</div><div class=content-strip>Hot</div>")]
    got = {r["page_id"]: r["text"] for r in pages.main_texts(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[1] == "One\nRepublished" and got[2] == "Two\nRepublished"  # lines inside the page's own article stay
    assert got[3] == got[4] == "One\nRead next\nTen tips"  # copies tell nothing about their template
    assert got[5] == "News\nOne" and got[6] == "News\nTwo"
