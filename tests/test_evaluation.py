"""Answer clean-up, label extraction, binarisation and the metric bundle (golden cases)."""

import pytest
from pyspark.sql import functions as F

from spreadlens.functions.labels import binarize_lenient, binarize_strict, extract_label, is_parsed, normalize_answer
from spreadlens.operators import evaluation


def test_answer_rules(spark):
    rows = [(" Fake\n",), ("FAKE.",), ("not fake",), ("yes",), ("real or fake",), ("unsure",), (None,)]
    df = spark.createDataFrame(rows, "raw string").select(normalize_answer(F.col("raw")).alias("p"))
    out = df.select(
        "p",
        binarize_strict(F.col("p")).alias("strict"),
        binarize_lenient(extract_label(F.col("p"))).alias("lenient"),
        is_parsed(extract_label(F.col("p"))).alias("parsed"),
    ).collect()
    assert [r.p for r in out] == ["fake", "fake.", "not fake", "yes", "real or fake", "unsure", None]
    assert [r.strict for r in out] == [1, 0, 0, 0, 0, 0, 0]
    assert [r.lenient for r in out] == [1, 1, 1, 1, 1, 0, 0]
    assert [r.parsed for r in out] == [True, True, True, True, True, False, False]


def test_whitespace_strip_like_python(spark):
    raw = " \t fake \x0b\x1c \n"
    assert spark.createDataFrame([(raw,)], "r string").select(normalize_answer(F.col("r"))).first()[0] == raw.strip().lower()


def _pairs(spark, tp, fp, fn, tn):
    rows = [("fake", "fake")] * tp + [("real", "fake")] * fp + [("fake", "real")] * fn + [("real", "real")] * tn
    return spark.createDataFrame([(i, l, p) for i, (l, p) in enumerate(rows)], "doc_id long, label string, prediction string")


def test_metrics_golden(spark):
    m = evaluation.metrics(_pairs(spark, 2, 1, 1, 6)).first()
    assert (m.tn, m.fp, m.fn, m.tp, m.n) == (6, 1, 1, 2, 10)
    assert m.accuracy == pytest.approx(0.8)
    assert m.precision == pytest.approx(2 / 3) and m.recall == pytest.approx(2 / 3) and m.f1 == pytest.approx(2 / 3)
    assert m.roc_auc == pytest.approx(0.761905, abs=1e-6) and m.fpr == pytest.approx(1 / 7)
    assert m.roc_auc == pytest.approx((m.tpr + 1 - m.fpr) / 2)


def test_metrics_degenerate(spark):
    no_pos = evaluation.metrics(_pairs(spark, 0, 0, 3, 5)).first()
    assert no_pos.precision == 0.0 and no_pos.f1 == 0.0
    one_class = evaluation.metrics(_pairs(spark, 0, 2, 0, 5)).first()
    assert one_class.roc_auc is None and one_class.tpr is None
    empty = spark.createDataFrame([], "doc_id long, label string, prediction string")
    e = evaluation.metrics(empty).first()
    assert (e.n, e.tp, e.fp) == (0, 0, 0) and e.accuracy is None and e.precision == 0.0 and e.roc_auc is None


def test_eval_joins(spark):
    truth = spark.createDataFrame([(1, "fake"), (2, "real"), (3, "real")], "doc_id long, label string")
    preds = spark.createDataFrame([(1, "fake"), (2, "Yes")], "doc_id long, prediction string")
    assert evaluation.eval_pairs_inner(preds, truth, "doc_id").count() == 2
    assert {r.prediction for r in evaluation.eval_common(preds, truth, "doc_id").collect()} == {"fake"}
    orphan = spark.createDataFrame([(9, "fake")], "doc_id long, prediction string")
    with pytest.raises(Exception):
        evaluation.eval_pairs_strict(orphan, truth, "doc_id").collect()


def test_report_format(spark):
    rep = evaluation.metrics_report(evaluation.metrics(_pairs(spark, 2, 1, 1, 6))).collect()
    assert {r.metric: r.value_text for r in rep}["roc_auc"] == "0.7619"
