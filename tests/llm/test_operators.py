"""The training-data operators against brute force, and their rules for nulls, empty and long texts, repeated rows, empty
tables and extra columns with clashing names."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from riskframe.llm import ann, decontaminate, langid, licenses, linear, lm, mixing, pages, pii, quality, simhash

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, fp string, rank int, text_hash string, "
        "word string, component string")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def rows_of(texts, first=1):
    return [(None if i == 3 else i + first, t, ("en", "fr", None)[i % 3], (None, "a", "b")[i % 3], len(t or ""),
             "x", 1, "h", "w", "c") for i, t in enumerate(texts)]


TEXTS = [None, "", "   \n", "one two", "one two", "The quick brown fox jumps over the lazy dog " * 4,
         "The quick brown fox jumps over the lazy dog " * 4, "!!! 123 ...", LONG, LONG + " tail", "x" * 50_000,
         f"before {BENCH.upper()} after", "mail a.b@c.de or +49 (30) 1234-5678, card 4111 1111 1111 1111, ip 10.0.0.255",
         "é ü ñ 日本語 " * 20, "alpha beta"]


@pytest.fixture(scope="module")
def docs(spark):
    data = rows_of(TEXTS)
    return spark.createDataFrame(data + data[4:6], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def counted(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


# ------------------------------------------------------------------ 10 SimHash
def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(n)]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > n) << b for b in range(64))


def test_simhash_matches_brute_force(docs):
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [slow_simhash(t) for _, t in data]
    label = list(range(len(fps)))
    for _ in fps:
        label = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(fps))]
    low = {c: min((d for (d, _), x in zip(data, label) if x == c and d is not None), default=None) for c in set(label)}
    want = collections.Counter((d, f"{f:016x}", low[c]) for (d, _), f, c in zip(data, fps, label))
    assert counted(simhash.simhash_dedup(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert {r["doc_id"] for r in kept.collect()} == set(low.values())


def test_simhash_links_a_chain_and_a_dense_cluster(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    chain = [base]
    for k in range(12):
        chain.append(chain[-1] ^ (0b1111 << (4 * k)))  # each 4 bits from the last, far from the first
    dense = [int(rng.integers(1 << 62))]
    dense += [dense[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (40, 2))]
    fps = list(dict.fromkeys(chain + dense + [int(x) for x in rng.integers(1 << 62, size=200)]))
    got = {r["fp"]: r["component_id"] for r in simhash.simhash_groups(
        spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")).collect()}
    label = {f: i for i, f in enumerate(fps)}
    while True:
        new = {f: min(label[g] for g in fps if (f ^ g).bit_count() <= 4) for f in fps}
        if new == label:
            break
        label = new
    assert got == label


# ------------------------------------------------------------------ 9 decontamination
def slow_hits(text, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    w, hit, found = split(text), set(), set()
    for item, t in items:
        x = split(t)
        n = min(len(x), 10)
        for k in range(len(x) - n + 1 if x else 0):
            for s in range(len(w) - n + 1):
                if w[s:s + n] == x[k:k + n]:
                    hit |= set(range(s, s + n))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_matches_brute_force(spark, docs, none):
    items = [(1, BENCH), (2, "one"), (10, "alpha beta"), (3, None), (4, "..."), (None, "lazy dog"), (5, BENCH + " nu")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    data = [(r["doc_id"], r["text"]) for r in docs.where("length(text) < 60000 or text is null").collect()]
    got = counted(decontaminate.contamination(docs.where("length(text) < 60000 or text is null"), bench), "doc_id",
                  "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == collections.Counter((d, *slow_hits(t, items)) for d, t in data)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert not {"one two", "alpha beta"} & {r["text"] for r in clean.collect()}
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_in_broadcast_parts(spark, docs):
    bench = spark.createDataFrame([(1, BENCH), (2, "quick brown fox")], "item_id long, text string")
    whole = counted(decontaminate.match_windows(docs, bench), "doc_id", "start", "n")
    assert whole and counted(decontaminate.match_windows(docs, bench, broadcast_rows=1), "doc_id", "start", "n") == whole


# ------------------------------------------------------------------ 2 personal data
def slow_base(text):
    spans = []
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19
              and pii.luhn(re.sub("[^0-9]", "", m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15)]
    for k, (kind, rule, ok) in enumerate(rules):
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(rule, text or "") if ok(m[0])]
    return ",".join(s for _, _, s in sorted(spans))


def test_pii_base_spans_match_the_plain_rules(docs):
    rng = np.random.default_rng(2)
    alphabet = list("0123456789.@+- ()ab%4é")
    made = ["".join(rng.choice(alphabet, 60)) for _ in range(3000)] + [r["text"] for r in docs.collect() if len(r["text"] or "") < 60000]
    for text in made:
        mine = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in pii.find_spans(text or "") if k in pii.KINDS[:4])
        assert mine == slow_base(text), text


def test_pii_report_and_redaction(docs, none):
    got = {r["doc_id"]: r for r in pii.pii_report(docs).collect()}
    hit = got[13]
    assert (hit["n_email"], hit["n_ip"], hit["n_card"], hit["n_phone"]) == (1, 1, 1, 1)
    assert hit["base_sha256"] == hashlib.sha256(slow_base(TEXTS[12]).encode()).hexdigest()
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["spans"] == ""
    out = {r["doc_id"]: r for r in pii.redact(docs, length_col="n_chars").collect()}
    assert out[13]["text"] == "mail <EMAIL> or <PHONE>, card <CARD>, ip <IP>" and out[13]["n_chars"] == len(out[13]["text"])
    assert out[1]["text"] is None and out[6]["text"] == TEXTS[5] and pii.redact(none).count() == 0


def test_pii_checksums_and_context():
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    assert [s[0] for s in pii.find_spans("IBAN DE89 3704 0044 0532 0130 00.")] == ["iban"]
    assert [s[0] for s in pii.find_spans("ssn 123-45-6789")] == ["ssn"] and not pii.find_spans("part 123-45-6789")


def test_iban_before_a_short_token():
    for iban in ("ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "BE68539007547034",
                 "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "NO9386011117947", "GB29NWBK60161331926819"):
        for tail in ("", " 2024", " I", " 12 euros", " EUR", " AB12 and", ".", f" {iban}"):
            text = f"pay to {iban}{tail}"
            got = [text[a:b] for k, a, b, _ in pii.find_spans(text) if k == "iban"]
            assert got == [iban] * (1 + (tail[1:] == iban)), text
            assert pii.mask(text, pii.find_spans(text)).startswith("pay to <IBAN>")
        assert not list(pii.ibans(iban + "9")) and not list(pii.ibans("x" + iban)) and not list(pii.ibans(iban[:-1]))


# ------------------------------------------------------------------ 4 mixing
def test_mixing_budgets_and_blocks(spark, none):
    data = [(i, " ".join(["w"] * (1 + i % 7)), "hot" if i % 2 else f"s{i % 10}") for i in range(2000)]
    data += [(9001, None, "s0"), (9002, "", None), (9003, "a b", None)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix_sources(d, target_entropy=0.95, max_epochs=3.0, block_tokens=300).collect()
    tokens = collections.Counter()
    for _, t, s in data:
        tokens[s or ""] += len((t or "").split())
    total, share = sum(tokens.values()), {s: n / sum(tokens.values()) for s, n in tokens.items() if n}
    spent, passes = collections.Counter(), collections.Counter()
    for r in got:
        spent[r["source"]] += r["n_tokens"]
        passes[r["doc_id"], r["pass"]] += 1
    assert set(passes.values()) == {1} and max(p for _, p in passes) <= 4 and not {9001, 9002} & {d for d, _ in passes}

    def weights(a):
        z = sum(p ** a for p in share.values())
        return {s: p ** a / z for s, p in share.items()}

    limit = lambda a: max(w / share[s] for s, w in weights(a).items()) <= 3.0
    flat = lambda a: -sum(w * math.log(w) for w in weights(a).values()) <= 0.95 * math.log(len(share))
    alpha = max(mixing.bisect(limit), mixing.bisect(flat))
    for s, w in weights(alpha).items():
        assert abs(spent[s] - w * total) <= 8, s
    blocks = collections.defaultdict(list)
    for r in got:
        blocks[r["block"]].append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in blocks.values()) and len(blocks) > 10
    e = spark.createDataFrame([], d.schema)
    assert mixing.mix_sources(e).count() == 0


# ------------------------------------------------------------------ 5 language model
def test_language_model_matches_brute_force(docs, none):
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm.lm_scores(docs).collect()}
    tok = lambda t: (t or "").encode().lower().split() + [None]
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c, bi = collections.Counter(), collections.Counter()
    for d, t in data:
        if not held(d):
            c.update(tok(t))
            bi.update(zip([0, *tok(t)[:-1]], tok(t)))
    before, total, kinds = collections.Counter(w for _, w in bi), collections.Counter(), collections.defaultdict(lambda: [0] * 4)
    for (a, _), n in bi.items():
        total[a] += n
        kinds[a][min(n, 3)] += 1
    dp = lm.discounts([sum(v == k for v in bi.values()) for k in (1, 2, 3, 4)])
    dw = lm.discounts([sum(v == k for v in before.values()) for k in (1, 2, 3, 4)])
    free = sum(dw[min(n, 3)] for n in before.values()) / len(bi)

    def p(a, w):
        low = max(before[w] - dw[min(before[w], 3)], 0) / len(bi) + free / (len(c) + 1)
        if not total[a]:
            return low
        n = bi[a, w]
        return max(n - dp[min(n, 3)], 0) / total[a] + sum(dp[k] * kinds[a][k] for k in (1, 2, 3)) / total[a] * low

    for d, t in data:
        w, r = tok(t), got[d, len(tok(t))]
        assert r["held_out"] == held(d) and r["train_tokens"] == sum(c.values())
        assert r["n_known"] == sum(x in c for x in w)
        assert math.isclose(r["score"], sum(math.log10(p(a, x)) for a, x in zip([0, *w[:-1]], w)), rel_tol=1e-9)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.1) / (sum(c.values()) + 0.1 * (len(c) + 1))) for x in w),
                            rel_tol=1e-9)
    assert lm.lm_scores(none).count() == 0


# ------------------------------------------------------------------ 7 and 8 classifiers
def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.1, 1.0, -1.0)
    w, b = linear.fit_hinge([(np.arange(5), v) for v in x], y, 5, c=10.0, epochs=100)
    assert (np.sign(x @ w + b) == y).mean() > 0.97


def test_language_id(spark, docs, none):
    import duckdb
    src = "/root/testdata/sf0.01/documents.parquet"
    d = spark.read.parquet(src).withColumnRenamed("n_chars", "score")
    got = {r["doc_id"]: r for r in langid.language_report(d).collect()}
    truth = dict(duckdb.connect().sql(f"select doc_id, lang from '{src}'").fetchall())
    out = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in out) / len(out) > 0.97
    model = langid.train(d)
    said = {r["doc_id"]: r for r in langid.identify(docs.select("doc_id", "text"), model).collect()}
    assert [said[i]["lang_pred"] for i in (1, 2, 8)] == ["und"] * 3 and said[1]["score"] == 0
    kept = langid.keep_known(docs, min_score=0.0)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0
    assert langid.language_report(none).count() == 0
    same = docs.withColumn("lang", docs["lang"].substr(0, 0))  # one class only
    assert {r["lang_pred"] for r in langid.language_report(same).collect()} <= {"", "und"}


def test_language_stage_at_its_own_threshold(spark):
    import corpus_pipeline
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    some = {r["lang"]: r["text"].split() for r in clean.where("lang is not null").limit(200).collect()}
    mixed = [" ".join(w for words in some.values() for w in words[k:k + n]) for k in range(8) for n in (1, 2, 6)]
    odd = [None, "", "123 !!!", *mixed]
    d = clean.unionByName(spark.createDataFrame([(10**6 + i, t, None, "x", len(t or "")) for i, t in enumerate(odd)], clean.schema))
    said = langid.identify(d.select("doc_id", "text"), langid.train(d)).collect()
    want = {r["doc_id"] for r in said if r["lang_pred"] != "und" and r["score"] >= 0.3}
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, d, "").collect()}
    assert kept == want and kept >= {r["doc_id"] for r in clean.collect()} and not kept & {10**6, 10**6 + 1, 10**6 + 2}


def test_quality(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.quality_scores(d, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = [i for i in truth if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.quality_scores(docs, labels).count() == docs.count()
    assert {r["score"] for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0


# ------------------------------------------------------------------ 6 pages
PAGE = ("<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a>Home</a></nav>"
        "<div class='cookie notice'>We use cookies</div><div id=main><p>%s</p><p>Fish &amp;\n  chips<br>here</p></div>"
        "<div>Call us</div><form><input><button>Go</button></form><div class=comments><p>First!</p></div>"
        "<script>var t='</p>';</script><footer>&copy; x</footer></body></html>")


PLAIN = "<html><body><div>Our site</div><p>%s</p><div>Call us today</div></body></html>"


def test_page_text(spark):
    data = [(1, "http://h.com/a/1", PAGE % "One story"), (2, "http://h.com/a/2", PAGE % "Another story"),
            (2, "http://h.com/a/2", PAGE % "Another story"), (3, None, None), (4, "", ""), (None, "http://h.com/b", "plain  text"),
            (6, "http://t.com/a/1", PLAIN % "One story"), (7, "http://t.com/a/2", PLAIN % "Another story"),
            (5, "http://x.org/z", "<article><h1>T</h1><p>A<p><b>B</b>c<aside>no</aside><div class=share>no</div></article><p>out")]
    d = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, text string")
    got = counted(pages.main_texts(d), "page_id", "text", "n_chars")
    one = "One story\nFish & chips here"
    assert got[1, one, len(one)] == 1  # inside a named container shared lines stay
    assert got[3, "", 0] == 1 and got[4, "", 0] == 1 and got[None, "plain text", 10] == 1
    assert got[6, "One story", 9] == 1 and got[7, "Another story", 13] == 1  # shared lines without a mark go
    assert got[5, "T\nA\nBc", 6] == 1 and sum(got.values()) == len(data)
    assert pages.main_texts(d.where("false")).count() == 0


def test_page_marks_take_whole_names():
    def kept(page):
        found = pages.blocks(page)
        return pages.assemble([t for t, _ in found], [k for _, k in found], [False] * len(found))

    body = "<html class='no-sidebar'><body class='has-sidebar menu' id=page>%s</body></html>"
    for page in ("<main class='no-sidebar'><p>Text</p></main>", "<article class='overflow-hidden comment'><p>Text</p></article>",
                 "<div class='overflow-hidden'><article><p>Text</p></article></div>", "<article><div class='entry-header'>Text</div></article>",
                 "<div style='overflow: hidden'><p>Text</p></div>", "<div data-hidden='hidden' title='hidden'><p>Text</p></div>",
                 "<div class='entry-header'><p>Text</p></div>", "<div aria-hidden='false'><p>Text</p></div>"):
        assert kept(body % page) == kept(page) == "Text", page
    for attrs in ("hidden", "hidden=''", "style='color:red; display : none'", "STYLE='visibility:hidden'", "aria-hidden=true",
                  "class='x sidebar'", "class='site-footer'", "role=navigation", "id=cookie-banner", "aria-label='breadcrumb'"):
        assert kept(f"<div {attrs}><p>Gone</p></div><p>Text</p>") == "Text", attrs
    for inline in ("<span class='ad'>Buy</span>", "<a href=x class=share>Share</a>", "<b hidden>no</b>", "<button>Go</button>"):
        assert kept(f"<article><p>One {inline} two</p><p>{inline} three</p><p>four</p></article>") == "One two\nthree\nfour", inline
        assert kept(f"<p>One</p>{inline} two") == "One\ntwo", inline
    assert kept("<div class='post-comments'><p>Gone?</p></div><div class='post-body'><p>Text</p></div>") == "Text"


def test_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(4)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(500):
        a, b = (rng.integers(0, 4, rng.integers(0, 9)).tolist() for _ in range(2))
        kept = [x for x, k in zip(a, pages.common_lines(a, b)) if k]
        rest = iter(b)
        assert len(kept) == length(a, b) and all(x in rest for x in kept)


# ------------------------------------------------------------------ 1 vectors
def test_nearest_recall_ties_and_invalid_vectors(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1500, 24))
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    data += [(2000 + i, data[100][1]) for i in range(300)]  # copies, queries among them
    data += [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [None] * 24), (5400, [1.0]), (None, data[0][1])]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(d, every=100, probe_share=0.8).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    fine = [(i, np.array(x)) for i, x in data if i is not None and i < 5000]
    ids, m = np.array([i for i, _ in fine]), np.stack([x for _, x in fine])
    recall = []
    assert set(got) == {i for i, _ in fine if i % 100 == 0}
    for q, found in got.items():
        dist = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, dist)) if ids[k] != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(
            math.isclose(s, dist[ids == i][0], abs_tol=1e-12) for _, i, s in found)
        recall.append(len({i for _, i, _ in found} & set(ids[order])) / 10)
        if q in (100, 2000, 2100, 2200):
            assert [i for _, i, _ in found] == ids[order].tolist()  # equal distances: smaller ids first
    assert np.mean(recall) > 0.9
    assert ann.nearest(d.where("false")).count() == 0
    assert ann.nearest(d.where("vec_id in (100, 200)"), k=10).count() == 2


# ------------------------------------------------------------------ 3 licences
def test_license_scan_and_inheritance(spark):
    data = [(1, "p/LICENSE", "Released under the MIT License."), (2, "p/a/x.py", "code only"), (3, "p/b/LICENSE.txt", None),
            (4, "p/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\nmore"), (5, "p/b/c/z.py", ""),
            (6, "q/x.py", "nothing here about it"), (7, None, "All rights reserved."), (2, "p/a/x.py", "code only"),
            (8, "p/b/c/COPYING", "long preamble\nThis work is licensed under the GNU General Public License, version 3.")]
    d = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, path string, text string, license string")
    got = counted(licenses.license_scan(d, "doc_id"), "doc_id", "own_license", "license", "inherited_from")
    assert got == collections.Counter({
        (1, "MIT", "MIT", None): 1, (2, None, "MIT", "p"): 2, (3, None, "MIT", "p"): 1,
        (4, "Apache-2.0", "Apache-2.0", None): 1, (5, None, "GPL-3.0", "p/b/c"): 1, (6, None, None, None): 1,
        (7, "LicenseRef-all-rights-reserved", "LicenseRef-all-rights-reserved", None): 1, (8, "GPL-3.0", "GPL-3.0", None): 1})
    assert licenses.license_scan(d.where("false"), "doc_id").count() == 0


def test_common_words_weigh_little_at_any_corpus_size(spark):
    header = "Released under the MIT License en that"
    for lines in (300, 30_000):
        data = [(0, "LICENSE", header), *((i + 1, f"f{i}", "en that word\n" * 100 + f"w{i}") for i in range(lines // 100))]
        d = spark.createDataFrame(data, "doc_id long, path string, text string")
        seen = collections.Counter(w for _, _, t in data for x in t.lower().split("\n") for w in set(licenses.WORD.findall(x)))
        n = sum(len(t.split("\n")) for _, _, t in data)
        w = {t: math.log((n + 1) / (seen[t] + 1)) + 1 for t in licenses.WORD.findall(header.lower())}
        norm = math.sqrt(sum(w[t] ** 2 for t in "released under the mit license".split()))
        r = licenses.license_scan(d, "doc_id").where("doc_id = 0").first()
        assert r["own_license"] == "MIT"
        assert math.isclose(r["own_score"], norm / math.sqrt(sum(x * x for x in w.values())), abs_tol=1e-8)


def test_near_licences_are_told_apart(spark):
    texts = {"GNU General Public License, version 2": "GPL-2.0", "GNU Lesser General Public License, version 3": "LGPL-3.0",
             "CC BY-SA 4.0": "CC-BY-SA-4.0", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
             "(* SPDX-License-Identifier: MIT OR GPL-2.0-only *)": "MIT OR GPL-2.0", "Licensed under the BSD License.": None,
             "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
             "Licensed under the Apache License, Version 1.1": None, "GNU General Public License, version 4": None,
             "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General "
             "Public License as published by\n# the Free Software Foundation, either version 3 of the License, or": "GPL-3.0"}
    folder = licenses.Path(licenses.__file__).parent / "license_texts"
    texts |= {"Copyright 2020 A. Body\n\n" + f.read_text(): f.stem for f in folder.glob("*.txt")}
    d = spark.createDataFrame([(i, f"{i}/x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["own_license"] for r in licenses.license_scan(d, "doc_id").collect()}
    assert got == dict(enumerate(texts.values()))
    own = spark.createDataFrame([("GPL-3.0", "GNU General Public License, version 3"), ("X", "Use it as you like, friend")],
                                "license string, text string")
    got = {r["text"]: r["own_license"] for r in licenses.license_scan(d, "doc_id", templates=own).join(d, "doc_id").collect()}
    assert got["GNU General Public License, version 2"] is None and got["GNU Lesser General Public License, version 3"] is None
    assert licenses.license_scan(d.limit(1).withColumn("text", licenses.F.lit("use it as you like, friend")), "doc_id",
                                 templates=own).first()["own_license"] == "X"
