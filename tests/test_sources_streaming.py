"""JSON record layouts (reference one-file-per-record and JSON Lines), record-path features, incremental scoring."""

import json

import pytest
from pyspark.sql import functions as F

from spreadlens.operators import features
from spreadlens.sources import propagation_json

RECORDS = {
    "a.json": {"label": "fake", "nodes": [{"tweet_text": "aa bb"}, {"delay": 10}, {"delay": 3}],
               "edges": [{"source": "1", "target": "2"}, {"source": "2", "target": "1"}]},
    "b.json": {"label": "real", "nodes": [{"tweet_text": "cc"}],
               "edges": [{"source": "1", "target": "2"}, {"source": "2", "target": "3"}, {"source": "3", "target": "1"}]},
    "c.json": {"label": "real", "nodes": [{"tweet_text": "dd"}, {"delay": 1}], "edges": []},
}


def _write_files(tmp_path):
    d = tmp_path / "test"
    d.mkdir()
    for name, rec in RECORDS.items():
        (d / name).write_text(json.dumps(rec, indent=2))
    (d / "notes.txt").write_text("ignored")
    return str(d)


def test_files_layout_scan_and_features(spark, tmp_path):
    path = _write_files(tmp_path)
    rec = propagation_json.read(spark, path, layout="files")
    assert sorted(r.propagation_id for r in rec.collect()) == ["a.json", "b.json", "c.json"]
    f = {r.propagation_id: r for r in features.record_features(rec).collect()}
    assert f["a.json"].median_retweet_time == 6.5 and f["a.json"].avg_degree_centrality == 1.0
    assert f["a.json"].eigenvector_centrality == pytest.approx(0.707107, abs=1e-6)
    assert f["b.json"].eigenvector_centrality == pytest.approx(0.577350, abs=1e-6)
    assert f["c.json"].graph_status == "empty" and f["c.json"].median_retweet_time == 1.0
    assert {r.propagation_id: r.text for r in propagation_json.corpus_scan(spark, path).collect()}["a.json"] == "aa bb"
    assert {r.propagation_id: r.label for r in propagation_json.true_labels(spark, path).collect()}["a.json"] == "fake"


def test_lines_layout_roundtrip(spark, tmp_path):
    rec = propagation_json.read(spark, _write_files(tmp_path), layout="files")
    out = str(tmp_path / "lines")
    propagation_json.write_lines(rec, out)
    back = propagation_json.read(spark, out, layout="lines")
    assert sorted(map(tuple, back.select("propagation_id", "label").collect())) == sorted(
        map(tuple, rec.select("propagation_id", "label").collect()))


def test_incremental_two_drops_score_each_key_once(spark, tmp_path):
    from spreadlens.plans import scoring
    from spreadlens.streaming.incremental import incremental_score

    train = spark.createDataFrame(
        [(1, "aa bb", "fake", 0.5, 0.5, 1.0), (2, "cc dd", "real", 0.2, 0.3, 9.0), (3, "aa cc", "real", 0.1, 0.2, 4.0)],
        "doc_id long, text string, label string, avg_degree_centrality double, eigenvector_centrality double, "
        "median_retweet_time double")
    rec = propagation_json.read(spark, _write_files(tmp_path), layout="files")
    inp, store, ckpt = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ckpt")
    propagation_json.write_lines(rec.filter("propagation_id = 'a.json'"), inp)
    first = incremental_score(spark, inp, store, ckpt, train, k=1)
    assert [r.propagation_id for r in first.collect()] == ["a.json"]
    propagation_json.write_lines(rec.filter("propagation_id <> 'a.json'"), inp)
    second = incremental_score(spark, inp, store, ckpt, train, k=1)
    assert sorted(r.propagation_id for r in second.collect()) == ["a.json", "b.json", "c.json"]
    assert spark.read.parquet(store).count() == 3          # no key scored twice
    assert {r.propagation_id: r.prediction for r in second.collect()}["a.json"] == "fake"


def test_feature_cache_key_includes_input_and_fit(spark, tmp_path):
    from spreadlens.sources import feature_cache

    calls = []

    def build(v):
        def b():
            calls.append(v)
            return spark.createDataFrame([(v,)], "v long")
        return b

    a1 = feature_cache.load_or_build(spark, {"input": "/data/a/test", "fit": "f1"}, build(1))
    a2 = feature_cache.load_or_build(spark, {"input": "/data/a/test", "fit": "f1"}, build(2))
    b1 = feature_cache.load_or_build(spark, {"input": "/data/b/test", "fit": "f1"}, build(3))
    c1 = feature_cache.load_or_build(spark, {"input": "/data/a/test", "fit": "f2"}, build(4))
    assert [a1.first().v, a2.first().v, b1.first().v, c1.first().v] == [1, 1, 3, 4]
    assert calls == [1, 3, 4]
