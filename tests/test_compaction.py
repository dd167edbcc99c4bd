import itertools

import pytest

from cinegrid.operators import compaction as C
from cinegrid.operators.copies import class_pairs

SCHEMA = "file_id long, file_path string, sample_id string, artifact string, body string, digest string, n int"


def files(spark, bodies, sample="s", artifact="metadata.json"):
    return spark.createDataFrame([(i, f"p{i}", sample, artifact, b, "clash", 1) for i, b in enumerate(bodies, 1)], SCHEMA)


BODIES = ['{"a": 1, "b": "x"}', '{"b":"x","a":1.0}', '{"a": 1e0, "b": "\\u0078"}', '{"a": 2, "b": "x"}', '{"a": "1", "b": "x"}', '{"a": true}', '{"a": 1}', "{}", "{ }", "[1]", "null", "", None, '{"a": NaN}', '{"a": -0.0}', '{"a": 0}',
          '{"a": 1', '{"a": {"c": [1, 2.0], "b": null}}', '{"a": {"b": null, "c": [1.0, 2]}}', '{"a": 12345678901234567890}', '{"a": 1.2345678901234567e19}', "[" * 100_000]


def test_digest_classes(spark):
    pairs = {(r[0], r[1]) for r in C.copies(files(spark, BODIES)).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (8, 9), (15, 16), (18, 19), (20, 21)}


def test_samples_and_artifacts_are_apart(spark):
    df = files(spark, BODIES[:2]).union(files(spark, BODIES[:2], "t").selectExpr("file_id + 10", "file_path", "sample_id", "artifact", "body", "digest", "n")).union(
        files(spark, BODIES[:2], None, None).selectExpr("file_id + 20", "file_path", "sample_id", "artifact", "body", "digest", "n"))
    assert {(r[0], r[1]) for r in C.copies(df).collect()} == {(1, 2), (11, 12), (21, 22)}


def test_compaction_keeps_each_record_once(spark, tmp_path):
    df = files(spark, BODIES * 3)
    path = f"file://{tmp_path}/out"
    for _ in range(2):  # the second one replaces the first
        report = C.compact(df, path, target_bytes=100)
    rows = spark.read.parquet(f"{path}/records")
    assert len(list((tmp_path / "out" / "records").glob("*.parquet"))) > 1
    order = [r.file_id for f in sorted((tmp_path / "out" / "records").glob("*.parquet")) for r in spark.read.parquet(f"file://{f}").select("file_id").collect()]
    assert order == sorted(order)  # one sample and artifact, so the files are in the order of the ids
    members = spark.read.parquet(f"{path}/members").collect()
    assert sorted(r.file_id for r in members) == list(range(1, report.rows_in + 1)) and {r.rep for r in members} == {r.file_id for r in rows.collect()}
    assert report.rows_in == 3 * len(BODIES) and report.records + report.copies == report.rows_in
    assert rows.agg({"copies": "sum"}).first()[0] == report.rows_in
    assert rows.where("digest is null").count() == report.broken == 3 * 7
    assert report.files > 1 and not [p for p in tmp_path.iterdir() if "staging" in p.name or ".old-" in p.name]


def test_empty(spark, tmp_path):
    report = C.compact(files(spark, []), f"file://{tmp_path}/out")
    assert (report.rows_in, report.records) == (0, 0)
    assert C.copies(files(spark, [])).count() == 0


def test_failed_reconciliation_leaves_the_old_files(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    C.compact(files(spark, BODIES), path)
    before = spark.read.parquet(f"{path}/records").count()
    monkeypatch.setattr(C, "placed", lambda rows: rows.selectExpr("*", "file_id as rep", "cast(2 as long) as copies"))
    with pytest.raises(ValueError):
        C.compact(files(spark, BODIES), path)
    assert spark.read.parquet(f"{path}/records").count() == before > 0 and spark.read.parquet(f"{path}/members").count() == len(BODIES) and not [p for p in tmp_path.iterdir() if "staging" in p.name]


def test_class_pairs(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (7, 7), (7, 8)], "rep long, id long")
    links = spark.createDataFrame([(1, 7), (7, 9)], "rep_a long, rep_b long")
    every = {(r.a, r.b) for r in class_pairs(members, links).collect()}
    one, two = [1, 2, 3], [7, 8]
    assert every == {*itertools.combinations(one, 2), *itertools.combinations(two, 2), *itertools.product(one, two), (7, 9), (8, 9)}
    rows = class_pairs(members, links, expand=1).collect()
    star = {(r.a, r.b) for r in rows}
    assert len(rows) == len(star) and star == {(1, 2), (1, 3), (7, 8), (1, 7), (2, 7), (3, 7), (1, 8), (7, 9), (8, 9)}
