"""JSON arrays in byte ranges against ``json.load``, and mapping configs with their errors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from riskframe.sources import json_arrays as JA
from riskframe.sources import mapping as MP


def odd_records(n=60, seed=1):
    r = random.Random(seed)
    bits = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "日", "\n", "x", " ", "\\\"", "\\\\"]
    text = lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
    return [{"id": i, "a": text(), "b": {"c": [text(), {"d": text()}], "e": i / 7}, text(): None} for i in range(n)]


@pytest.mark.parametrize("part_bytes", [1, 2, 3, 7, 64, 1000, 10 ** 6])
@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_yield_every_record_once(part_bytes, indent):
    want = odd_records(25 if part_bytes < 8 else 60)
    data = (" " + json.dumps(want, ensure_ascii=False, indent=indent) + "\n").encode()
    state, depth, got = JA.OUT, 0, []
    for at in range(0, len(data), part_bytes):
        part = data[at:at + part_bytes]
        more = (data[a:a + 5] for a in range(at + part_bytes, len(data), 5))
        got += [json.loads(t) for t in JA.records(part, more, state, depth)]
        change = JA.summary(part, state)
        state, depth = change[0], depth + change[1]
    assert got == want and (state, depth) == (JA.OUT, 0)


def test_files_and_folders_read_in_parts(spark, tmp_path):
    want = odd_records(80, 3)
    for i, part in enumerate((want[:50], want[50:], [])):
        (tmp_path / f"f{i}.json").write_text(json.dumps(part, ensure_ascii=i == 0))
    (tmp_path / "_SUCCESS").write_text("")
    got = [json.loads(r["value"]) for r in JA.json_array_texts(spark, str(tmp_path), part_bytes=97).collect()]
    assert sorted(got, key=lambda r: r["id"]) == want
    rows = JA.read_json_arrays(spark, f"{tmp_path}/f0.json", "id INT, a STRING, missing STRING", 33).orderBy("id").collect()
    assert [(r["id"], r["a"], r["missing"]) for r in rows] == [(w["id"], w["a"], None) for w in want[:50]]
    assert JA.json_array_texts(spark, f"{tmp_path}/f0.json", 97).rdd.getNumPartitions() > 5
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"a": ')
    with pytest.raises(Exception, match="ends inside a record"):
        JA.json_array_texts(spark, f"{tmp_path}/cut.json", 4).collect()


def test_arrays_written_are_arrays(spark, tmp_path):
    df = spark.range(30).select("id", F.lit('q"}').alias("t")).repartition(4)
    path = JA.write_json_arrays(df.unionByName(df.where("false")), f"{tmp_path}/out")
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part")]
    assert sorted(r["id"] for f in files for r in json.loads(f.read_text())) == list(range(30))
    assert JA.read_json_arrays(spark, path, "id LONG, t STRING").where("t = 'q\"}'").count() == 30


@pytest.fixture(scope="module")
def csv(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("csv") / "a")
    spark.createDataFrame([("7", " High ", "2", None), ("x", "3.5", None, "9")], "s string, w string, q1 string, q2 string").write.option("header", True).csv(path)
    return path


def entry(csv, **more):
    return {"source_name": "A", "path": csv, "fmt": "csv", "column_map": {"s": "Score"}, **more}


def config(*entries):
    return {"common_features": ["Score", "w", "total", "Other"], "sources": list(entries)}


def test_steps_and_missing_columns(spark, csv):
    e = entry(csv, words={"w": {"HIGH": 8}}, items={"total": {"sum": ["q1", "q2"], "clip": [0, 5]}}, scaling={"Score": 2}, target_rule="w > 4 AND Score > 10")
    out, skipped = MP.unify(spark, [config(e), json.dumps(config({"source_name": "B", "path": csv + "-no"}, {"source_name": "WFH_Corporate", "path": csv}))])
    got = {(r["Score"], r["w"], r["total"], r["Other"], r["RiskCategory"], r["DatasetSource"]) for r in out.collect()}
    assert got == {(14.0, 8.0, 2.0, None, 1, "A"), (None, 3.5, 5.0, None, 0, "A")}
    assert {(r["source"], r["reason"]) for r in skipped.collect()} == {("B", "absent"), ("WFH_Corporate", "excluded")}


@pytest.mark.parametrize("more,message", [
    ({"wordz": {}}, "A: unknown setting wordz"), ({"words": {"nope": {}}}, "A: words: no column nope"),
    ({"scaling": {"nope": 2}}, "A: scaling: no column nope"), ({"items": {"t": {"sum": ["q1", "q9"]}}}, "A: items: no column q9"),
    ({"items": {"t": {"add": ["q1"]}}}, "A: items of t"), ({"target_rule": "nope > 1"}, "A: target_rule of RiskCategory: UNRESOLVED_COLUMN"),
    ({"target_rule": "Score >"}, "A: target_rule of RiskCategory: PARSE"), ({"path": None}, "A: source_name and path")])
def test_bad_entries_are_rejected_by_name(spark, csv, more, message):
    with pytest.raises(MP.MappingError, match=message):
        MP.unify(spark, [config({**entry(csv), **more})])


def test_bad_configs(spark, csv):
    with pytest.raises(MP.MappingError, match="unknown setting more"):
        MP.compile_config({**config(), "more": 1})
    with pytest.raises(MP.MappingError, match="A is named twice"):
        MP.compile_config(config(entry(csv), entry(csv)))
    assert MP.unify(spark, [config()])[0] is None


def test_json_ranges_share_tasks_and_read_little_beyond(spark, tmp_path):
    rows = [{"id": i, "t": "x" * (i % 50)} for i in range(3000)]
    (tmp_path / "f.json").write_text(json.dumps(rows))
    got = JA.json_array_texts(spark, f"{tmp_path}/f.json", 100)
    assert got.rdd.getNumPartitions() <= JA.LEAST_TASKS  # more than 1,000 ranges
    assert sorted(json.loads(r["value"])["id"] for r in got.collect()) == list(range(3000))
    asked = []

    class Source:
        def read_at(self, n, at):
            asked.append(n)
            return b"x" * n

    next(JA.read_on(Source(), 10, 50_000_000))
    assert sum(asked) <= 1 << 12
    assert sum(map(len, JA.read_on(Source(), 10, 5_000_000))) == 5_000_000 - 10
