"""Scoring with a pluggable client, resume (anti-join before scoring), dedup, JSON result import/export."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spreadlens.plans import scoring
from spreadlens.sources import feature_cache, propagation_json

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # test clients travel to the Python workers by value

KEY = ["doc_id", "strategy", "model", "num_shots", "temperature", "replicate"]


def _requests(spark, ids):
    rows = [(i, "topk", "m", 1, 0.0, 1, "sys", f"user {i}", [{"slot": 1, "label": "fake", "similarity": 0.5}])
            for i in ids]
    return spark.createDataFrame(rows, "doc_id string, strategy string, model string, num_shots int, temperature double, "
                                       "replicate int, system_prompt string, user_prompt string, "
                                       "exemplars array<struct<slot:int,label:string,similarity:double>>")


def Counting():
    """Client factory; the class is defined in the closure so it is shipped to the Python workers by value."""

    class Flaky:
        def complete(self, system, user, model, temperature, exemplars):
            if "boom" in user:
                raise RuntimeError("endpoint down")
            return " FAKE\n"

    return Flaky()


def test_resume_scores_only_pending(spark, tmp_path):
    store = str(tmp_path / "store")
    req = _requests(spark, ["a", "b", "c"])
    scoring.run_resumable(req.filter("doc_id = 'b'"), store, Counting, KEY, batch_id=0)
    todo = scoring.pending(req, scoring.read_store(spark, store), KEY)
    assert sorted(r.doc_id for r in todo.collect()) == ["a", "c"]
    out = scoring.run_resumable(req, store, Counting, KEY, batch_id=1)
    assert sorted(r.doc_id for r in out.collect()) == ["a", "b", "c"]
    assert {r.prediction for r in out.collect()} == {"fake"}
    before = spark.read.parquet(store).count()
    scoring.run_resumable(req, store, Counting, KEY, batch_id=2)       # second run: nothing pending
    assert spark.read.parquet(store).count() == before


def test_errors_are_rows_and_retried(spark, tmp_path):
    store = str(tmp_path / "store")
    req = _requests(spark, ["ok", "boom"])
    out = {r.doc_id: r for r in scoring.run_resumable(req, store, Counting, KEY, batch_id=0).collect()}
    assert out["boom"].error.startswith("RuntimeError") and out["boom"].raw_answer is None
    assert [r.doc_id for r in scoring.pending(req, scoring.read_store(spark, store), KEY).collect()] == ["boom"]


def test_dedup_latest_wins(spark):
    rows = [("a", "topk", "m", 1, 0.0, 1, "real", None, 0), ("a", "topk", "m", 1, 0.0, 1, "fake", None, 1)]
    store = spark.createDataFrame(rows, "doc_id string, strategy string, model string, num_shots int, temperature double, "
                                        "replicate int, prediction string, error string, batch_id long")
    assert [r.prediction for r in scoring.latest(store, KEY).collect()] == ["fake"]


def test_vote_stub_ties_are_real():
    c = scoring.VoteStubClient()
    assert c.complete("", "", "", 0.0, [{"label": "fake", "similarity": 0.3}, {"label": "real", "similarity": 0.3}]) == "Real\n"
    assert c.complete("", "", "", 0.0, [{"label": "fake", "similarity": 0.4}]) == "Fake\n"


def test_json_result_file_roundtrip(spark, tmp_path):
    f = tmp_path / "result.json"
    f.write_text(json.dumps({"x.json": "fake", "y.json": "real"}, indent=2))
    got = {r.propagation_id: r.prediction for r in scoring.import_json_map(spark, str(f)).collect()}
    assert got == {"x.json": "fake", "y.json": "real"}
    assert scoring.import_json_map(spark, str(tmp_path / "missing.json")).count() == 0
    preds = spark.createDataFrame([(i, "fake" if i % 2 else "real") for i in range(50)], "doc_id long, prediction string")
    out = str(tmp_path / "lines")
    scoring.export_json_map(preds, out, "doc_id")
    back = {r.propagation_id: r.prediction for r in scoring.import_json_map(spark, out).collect()}
    assert back == {str(i): ("fake" if i % 2 else "real") for i in range(50)}


def test_json_export_of_many_objects_comes_back_whole(spark, tmp_path):
    preds = spark.createDataFrame([(i, "fake") for i in range(100)], "doc_id long, prediction string")
    out = str(tmp_path / "grown")
    scoring.export_json_map(preds, out, "doc_id", object_chars=100)
    lines = spark.read.text(out).collect()
    assert len(lines) > 5 and all(len(r.value) <= 120 for r in lines)      # several objects of bounded size
    for by_line in (False, True):
        assert scoring.import_json_map(spark, out, lines=by_line).count() == 100
    odd = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z"), ("b", None), ("c", "q" * 500), ("d", 'line\nbreak "')], "k string, prediction string")
    scoring.export_json_map(odd.coalesce(1), out, "k", object_chars=100)
    got = sorted((r.k, r.prediction or "") for r in scoring.import_json_map(spark, out, "k", lines=True).collect())
    assert got == [("a", "x"), ("a", "y"), ("b", ""), ("c", "q" * 500), ("d", 'line\nbreak "')]


def test_broken_result_file_raises(spark, tmp_path):
    f = tmp_path / "result.json"
    f.write_text('{"x.json": "fake", "y.js')
    with pytest.raises(Exception):
        scoring.import_json_map(spark, str(f)).collect()


def test_retried_answer_replaces_the_error_of_an_equal_batch(spark, tmp_path):
    class Down:
        def complete(self, *a):
            raise RuntimeError("down")

    class Up:
        def complete(self, *a):
            return "Fake\n"

    store, req = str(tmp_path / "retry"), _requests(spark, ["a", "b"])
    first = scoring.run_resumable(req, store, Down, KEY, batch_id=0).collect()
    assert all(r.prediction is None for r in first)
    again = scoring.run_resumable(req, store, Up, KEY, batch_id=0).collect()
    assert [r.prediction for r in again] == ["fake", "fake"]
    batches = {r.batch_id for r in scoring.read_store(spark, store).select("batch_id").distinct().collect()}
    assert batches == {0, 1}
    tie = spark.read.parquet(store).withColumn("batch_id", F.lit(0).cast("long"))
    assert [r.prediction for r in scoring.latest(tie, KEY).collect()] == ["fake", "fake"]


def test_export_reads_its_predictions_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def client(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf.assign(prediction="real")

    ids = spark.range(20, numPartitions=2).withColumnRenamed("id", "doc_id")
    preds = ids.mapInPandas(client, "doc_id long, prediction string")
    scoring.export_json_map(preds, str(tmp_path / "once"), "doc_id")
    assert calls.value == 20


def test_truth_scan_raises_on_broken_and_unlabelled_records(spark, tmp_path):
    for name, text in (("broken", '{"label": "fa'), ("unlabelled", '{"nodes": []}')):
        d = tmp_path / name
        d.mkdir()
        (d / "a.json").write_text(text)
        with pytest.raises(Exception):
            propagation_json.true_labels(spark, str(d)).collect()


def test_feature_cache_inventory_follows_the_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    one = feature_cache.inventory(spark, str(tmp_path))
    (tmp_path / "b.json").write_text("{}")
    assert feature_cache.inventory(spark, str(tmp_path)) != one
