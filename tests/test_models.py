"""Rows-only operators: SMOTE and kNN against brute force, bundles, calibration, files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import train as TR
from riskframe.operators.sampling import knn_within, smote
from riskframe.session import scratch_path
from riskframe.sources import files as FS

SMALL = "/root/testdata/sf0.001"


def _points(spark, n=60, dim=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).round(3)
    rows = [(i + 1, x[i].tolist(), int(i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, vec array<double>, y int"), x


@pytest.mark.parametrize("tile_rows", [7, 1000])
def test_knn_matches_bruteforce(spark, tile_rows):
    df, x = _points(spark)
    got = knn_within(df, "id", "vec", 4, tile_rows=tile_rows).toPandas()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        expect = (np.argsort(d[i], kind="stable")[:4] + 1).tolist()
        g = got[got.qid == i + 1].sort_values("nn_rank")
        assert g.rid.tolist() == expect
        assert np.allclose(g.dist.to_numpy(), np.sort(d[i])[:4])


def test_smote_balances_and_interpolates(spark):
    df, x = _points(spark)
    out = smote(df, "id", "vec", "y", k=3, tile_rows=5).toPandas()
    counts = out.groupby("y").size().to_dict()
    assert counts[0] == counts[1] == 45
    syn = out[out.is_synthetic]
    assert len(syn) == 30 and (syn.id < 0).all() and syn.id.is_unique
    minority = x[[i for i in range(len(x)) if i % 4 == 0]]
    # every synthetic point lies on a segment between two minority points
    for v in syn.vec:
        v = np.asarray(v)
        ok = False
        for a in minority:
            for b in minority:
                ab = b - a
                denom = ab @ ab
                if denom == 0:
                    continue
                u = (v - a) @ ab / denom
                if -1e-9 <= u <= 1 + 1e-9 and np.allclose(a + u * ab, v, atol=1e-9):
                    ok = True
                    break
            if ok:
                break
        assert ok


def test_smote_is_deterministic(spark):
    df, _ = _points(spark)
    a = smote(df, "id", "vec", "y", k=3).orderBy("id").collect()
    b = smote(df, "id", "vec", "y", k=3).orderBy("id").collect()
    assert a == b


def _tab(spark, n=400):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = ((a + 0.5 * b + rng.normal(scale=0.5, size=n)) > 0).astype(int)
    rows = [(i, float(a[i]) if i % 17 else None, float(b[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "k long, a double, b double, y int")


def test_bundle_roundtrip_and_soft_vote(spark):
    df = _tab(spark)
    b1 = TR.Bundle("lr", ["a", "b"], "y", "logreg").fit(df)
    b2 = TR.Bundle("rf", ["a", "b"], "y", "forest", params={"numTrees": 10, "maxDepth": 3}).fit(df)
    p1 = b1.transform(df).select("k", "p").orderBy("k").toPandas()
    # the caller's columns are untouched by scoring
    assert b1.transform(df).select("a").orderBy("k").collect() == df.select("a").orderBy("k").collect()
    path = b1.save(spark, scratch_path(spark, "test_bundle"))
    back = TR.Bundle.load(spark, path)
    q1 = back.transform(df).select("k", "p").orderBy("k").toPandas()
    assert np.allclose(p1.p, q1.p)
    p2 = b2.transform(df).select("k", "p").orderBy("k").toPandas()
    sv = TR.soft_vote(df, [b1, b2]).select("k", "p").orderBy("k").toPandas()
    assert np.allclose(sv.p, (p1.p + p2.p) / 2)


def test_isotonic_is_monotone_and_clipped(spark):
    df = _tab(spark)
    b = TR.Bundle("lr", ["a", "b"], "y", "logreg").fit(df)
    s = b.transform(df).select("p", "y")
    iso = TR.isotonic_fit(s)
    out = iso.transform(s).orderBy("p").toPandas()
    assert (np.diff(out.p_cal.to_numpy()) >= -1e-12).all()
    assert out.p_cal.between(0, 1).all()


def test_fold_calibrated_members(spark):
    df = _tab(spark)
    members = TR.fold_calibrated(df, lambda: TR.Bundle("lr", ["a", "b"], "y", "logreg"), "k", 3)
    assert len(members) == 3
    out = TR.calibrated_transform(df, members).toPandas()
    assert len(out) == 400 and out.p.between(0, 1).all()


def test_headerless_header_row_becomes_null(spark):
    df = spark.createDataFrame([(1, "x", 30.0), (2, "y", 41.0)], "id long, s string, age double")
    path = FS.write_table(df.coalesce(1), scratch_path(spark, "t_headerless"), "csv")  # one header line
    spec = FS.SourceSpec("h", path, "csv", header=False, positions={0: "id", 2: "age"}, numeric=("id", "age"))
    got = sorted(FS.read_source(spark, spec).collect(), key=lambda r: (r.id is not None, r.id or 0))
    assert got[0].id is None and got[0].age is None          # the header line
    assert [(r.id, r.age) for r in got[1:]] == [(1.0, 30.0), (2.0, 41.0)]


def test_absent_source_is_skipped(spark):
    df = spark.createDataFrame([(1, "a")], "id long, s string")
    path = FS.write_table(df, scratch_path(spark, "t_present"), "json")
    frames, skipped = FS.load_sources(spark, [FS.SourceSpec("ok", path, "json", multiline=False),
                                              FS.SourceSpec("gone", path + "-nope", "csv"),
                                              FS.SourceSpec("held", path, "json")], exclude=["held"])
    assert len(frames) == 1 and frames[0].count() == 1
    assert sorted(r.reason for r in skipped.collect()) == ["absent", "excluded"]


def test_random_search_ranks(spark):
    df = _tab(spark)
    out = TR.random_search(spark, df, ["a", "b"], "y", "logreg", {"regParam": [0.0, 0.1, 1.0]}, n_iter=3,
                           folds=2, parallelism=2, key="k").orderBy("rank").toPandas()
    assert out["rank"].tolist() == [1, 2, 3]
    assert (np.diff(out.mean_recall.to_numpy()) <= 1e-12).all()


def test_rfe_keeps_requested_count(spark):
    df = _tab(spark).withColumn("noise", F.rand(1))
    out = TR.recursive_elimination(spark, df, ["a", "b", "noise"], "y", 2, numTrees=10, maxDepth=3).toPandas()
    assert out.selected.sum() == 2


COMPARED = ["n_events", "Stress", "Sleep", "Workload", "CompositeRisk", "RollingMean_7D", "ConsecutiveRiskDays",
            "history_len"]


def _same_days(got, batch):
    m = got.merge(batch, on=["user_id", "day"], suffixes=("_s", "_b"))
    assert len(m) == len(got) > 0 and not got.duplicated(["user_id", "day"]).any()
    for c in COMPARED:
        assert np.allclose(m[c + "_s"].astype(float).fillna(-1), m[c + "_b"].astype(float).fillna(-1), atol=1e-9)
    assert (m.status_s == m.status_b).all()


def test_stream_matches_batch_on_closed_days(spark):
    from riskframe.sources import fixtures as fx
    from riskframe.streaming import daily_state as DS
    ev = fx.table(spark, SMALL, "events")
    src = DS.split_by_time(ev, scratch_path(spark, "t_feed"), pieces=3)
    sink, ckpt = scratch_path(spark, "t_sink"), scratch_path(spark, "t_ckpt")
    out = DS.run_available(spark, src, sink, ckpt).toPandas()
    batch = DS.daily_state_batch(ev).toPandas()
    _same_days(out, batch)
    # only each user's trailing open day(s) may be missing
    last = batch.groupby("user_id").day.max()
    missing = batch.merge(out[["user_id", "day"]], how="left", indicator=True)
    missing = missing[missing._merge == "left_only"]
    assert (missing.day.to_numpy() >= missing.user_id.map(last).to_numpy() - np.timedelta64(1, "D")).all()
    # a second run from the same checkpoint goes on from the kept state and closes them
    DS.write_end_mark(spark, src)
    out = DS.run_available(spark, src, sink, ckpt).toPandas()
    assert len(out) == len(batch)
    _same_days(out, batch)


def test_stream_leaves_out_rows_without_time_or_value_and_ends_when_empty(spark):
    from riskframe.streaming import daily_state as DS
    data = [(1, "2024-01-01 10:00:00", 3.0, "error"), (1, "2024-01-01 23:59:59", None, "error"), (1, None, 1.0, "x"),
            (1, "2024-01-03 00:00:00", 150.0, None), (None, "2024-01-02 00:00:00", 7.25, "x")]
    ev = spark.createDataFrame(data, "user_id long, ts string, value double, event_type string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    src = DS.split_by_time(ev, scratch_path(spark, "t_feed"), pieces=1)
    DS.write_end_mark(spark, src)
    got = DS.run_available(spark, src, scratch_path(spark, "t_sink"), scratch_path(spark, "t_ckpt")).toPandas()
    assert sorted(map(str, got.user_id)) == sorted(map(str, DS.daily_state_batch(ev).toPandas().user_id))
    _same_days(got[got.user_id.notna()], DS.daily_state_batch(ev.where("user_id = 1")).toPandas())
    none = DS.split_by_time(ev.where("false"), scratch_path(spark, "t_feed"))
    DS.write_end_mark(spark, none)
    assert DS.run_available(spark, none, scratch_path(spark, "t_sink"), scratch_path(spark, "t_ckpt")).count() == 0


def test_permuted_copies_are_permutations(spark):
    df = _tab(spark).withColumn("c", F.col("k") * 10.0)
    out = TR.permuted_copies(df, "k", ["b", "c"], 5).toPandas()
    base = df.toPandas().sort_values("k")
    assert len(out) == 3 * 400
    for f in ["", "b", "c"]:
        part = out[out._feature == f].sort_values("k")
        assert part.k.tolist() == base.k.tolist()
        for col in ["a", "b", "c"]:
            same = np.array_equal(part[col].to_numpy(), base[col].to_numpy(), equal_nan=True)
            if col == f:
                assert not same and sorted(part[col]) == sorted(base[col])
            else:
                assert same


def test_permutation_importance_finds_the_signal(spark):
    df = _tab(spark).withColumn("noise", F.rand(3))
    b = TR.Bundle("lr", ["a", "b", "noise"], "y", "logreg").fit(df)
    out = {r.feature: r.importance for r in TR.permutation_importance(spark, b, df, "k").collect()}
    assert out["a"] > out["b"] > out["noise"] - 0.02


def test_knn_chunking_matches(spark):
    from riskframe.operators.neighbours import nearest_pairs
    rng = np.random.default_rng(11)
    x, ids, far = rng.normal(size=(50, 4)), np.arange(50, dtype=np.int64), np.full(50, np.inf)
    a = nearest_pairs(x, ids, far, x, ids, 3, chunk=7).sort_values(["qid", "dist", "rid"]).reset_index(drop=True)
    b = nearest_pairs(x, ids, far, x, ids, 3, chunk=1000).sort_values(["qid", "dist", "rid"]).reset_index(drop=True)
    assert len(a) == 150 and a[["qid", "rid"]].equals(b[["qid", "rid"]])
    assert np.allclose(a.dist, b.dist, rtol=0, atol=1e-12)


def test_bundle_reuses_superset_statistics(spark):
    from riskframe.operators.prep import MedianImputer, PopulationScaler
    df = _tab(spark)
    imp = MedianImputer(["a", "b"]).fit(df)
    sc = PopulationScaler(["a", "b"]).fit(imp.transform(df))
    own = TR.Bundle("lr", ["a"], "y", "logreg").fit(df)
    shared = TR.Bundle("lr", ["a"], "y", "logreg").fit(df, imputer=imp, scaler=sc)
    assert own.imputer.medians == shared.imputer.medians
    assert np.allclose(own.scaler.stats["a"], shared.scaler.stats["a"])


def test_saved_calibrators_give_the_same_scores(spark):
    from riskframe.operators.experiments import load_calibrated, save_calibrated
    df = _tab(spark)
    members = TR.fold_calibrated(df, lambda: TR.Bundle("lr", ["a", "b"], "y", "logreg"), "k", 3)
    path = save_calibrated(spark, members, scratch_path(spark, "t_calibrated"))
    before = TR.calibrated_transform(df, members).select("k", "p").orderBy("k").toPandas()
    after = TR.calibrated_transform(df, load_calibrated(spark, path, 3)).select("k", "p").orderBy("k").toPandas()
    assert np.allclose(before.p, after.p, rtol=0, atol=1e-12)


@pytest.mark.parametrize("key,rows", [("dual_model", 2)])
def test_harness_rows(spark, key, rows):
    from riskframe.plans import all_queries
    from riskframe.plans.registry import query_map
    all_queries.load()
    out = query_map()[key](spark, SMALL).toPandas()
    assert len(out) == rows and (out["n"] > 0).all() and out["brier"].between(0, 1).all()


# ---------------------------------------------------------------- round 3: work that grows with the rows alone
def test_poisson_computes_its_rate_once(spark):
    from riskframe.functions.noise import poisson
    df = spark.range(3000).select("id", (F.col("id") % 40 / 10.0).alias("r"))
    drawn = df.select("id", poisson("id", F.col("r") * 1.2345, 42, "t").alias("k"))
    # once for the NULL test and once for the draw, not at every step of the recurrence
    assert drawn._jdf.queryExecution().optimizedPlan().toString().count("1.2345") <= 2
    means = drawn.join(df, "id").groupBy("r").agg(F.avg("k").alias("k")).toPandas()
    assert (means.k - means.r * 1.2345).abs().max() < 1.5
    assert abs(drawn.agg(F.avg("k")).first()[0] - 1.95 * 1.2345) < 0.15


def test_random_search_fits_one_imputer_per_fold(spark, monkeypatch):
    fits, fit = [], TR.Imputer.fit
    monkeypatch.setattr(TR.Imputer, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    df = _tab(spark).withColumn("a", F.when(F.col("k") % 7 != 0, F.col("a")))
    space = {"regParam": [0.0, 0.1, 1.0, 10.0]}
    got = TR.random_search(spark, df, ["a", "b"], "y", "logreg", space, n_iter=3, folds=2, parallelism=2, key="k").orderBy("trial").collect()
    assert len(fits) == 2
    # each fold by hand
    x = df.select(F.col("a").cast("double"), F.col("b").cast("double"), F.col("y").cast("double").alias("label"), TR.fold_id("k", 2).alias("f"))
    for row, params in zip(got, TR.sample_params(space, 3)):
        recalls = []
        for f in range(2):
            fill = TR.Imputer(inputCols=["a", "b"], outputCols=["fa", "fb"], strategy="median", relativeError=0.0001)
            pipe = TR.Pipeline(stages=[fill, TR.VectorAssembler(inputCols=["fa", "fb"], outputCol="features"), TR.classifier("logreg", **params)])
            out = pipe.fit(x.where(F.col("f") != f)).transform(x.where(F.col("f") == f))
            recalls.append(out.where("label = 1").agg(F.avg((F.col("prediction") == 1).cast("double"))).first()[0])
        assert abs(row["mean_recall"] - sum(recalls) / 2) < 1e-9


def test_parts_of_a_split_stay_small(spark, monkeypatch):
    from riskframe.operators import experiments, prep
    monkeypatch.setattr(prep, "ROWS_PER_TASK", 50)
    df = spark.range(0, 1000, 1, 1).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"))
    split = experiments.split_cached(df, "k", "y")
    assert max(r["n"] for r in split.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) <= 100
    assert split.where("is_test").count() == 200 and split.select("k").distinct().count() == 1000
    monkeypatch.undo()
    assert experiments.split_cached(df, "k", "y").rdd.getNumPartitions() <= 4  # small tables are left alone


def test_stream_feed_in_several_files_a_piece(spark, monkeypatch):
    from riskframe.streaming import daily_state as DS
    monkeypatch.setattr(DS, "ROWS_PER_FILE", 50)
    ev = spark.range(0, 600, 1, 1).select((F.col("id") % 5).alias("user_id"), F.timestamp_seconds(1704067200 + F.col("id") * 3600).alias("ts"),
                                          (F.col("id") % 97).cast("double").alias("value"), F.lit("click").alias("event_type"))
    files = DS.files_per_piece(ev, 3)
    assert files == 4 and DS.files_per_piece(ev.limit(1), 3) == 1
    src = DS.split_by_time(ev, scratch_path(spark, "t_feed"), 3, files)
    assert len(spark.read.parquet(src).inputFiles()) == 12 and spark.read.parquet(src).count() == 600
    DS.write_end_mark(spark, src)
    got = DS.run_available(spark, src, scratch_path(spark, "t_sink"), scratch_path(spark, "t_ckpt"), files).toPandas()
    batch = DS.daily_state_batch(ev).toPandas()
    assert len(got) == len(batch) == 125
    _same_days(got, batch)
