"""Property tests: metric bundle vs a plain-Python computation; partner labels; cosine bounds on the fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spreadlens.operators import evaluation, retrieval
from spreadlens.sources import fixtures

SF01 = "/root/testdata/sf0.01"


def _expected(pairs):
    tp = sum(1 for t, p in pairs if t == "fake" and p == "fake")
    fp = sum(1 for t, p in pairs if t != "fake" and p == "fake")
    fn = sum(1 for t, p in pairs if t == "fake" and p != "fake")
    tn = len(pairs) - tp - fp - fn
    prec = tp / (tp + fp) if tp + fp else 0.0
    tpr = tp / (tp + fn) if tp + fn else None
    fpr = fp / (fp + tn) if fp + tn else None
    auc = (tpr + 1 - fpr) / 2 if tpr is not None and fpr is not None else None
    f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
    return tp, fp, fn, tn, prec, tpr, fpr, auc, f1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["fake", "real"]), st.sampled_from(["fake", "real", "unsure"])),
                min_size=1, max_size=40))
def test_metric_bundle_matches_python(spark, pairs):
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(pairs)], "doc_id long, label string, prediction string")
    m = evaluation.metrics(df).first()
    tp, fp, fn, tn, prec, tpr, fpr, auc, f1 = _expected(pairs)
    assert (m.tp, m.fp, m.fn, m.tn) == (tp, fp, fn, tn)
    assert m.precision == pytest.approx(prec) and m.f1 == pytest.approx(f1)
    assert m.accuracy == pytest.approx((tp + tn) / len(pairs))
    assert m.unparsed == sum(1 for _, p in pairs if p == "unsure")
    for got, want in ((m.tpr, tpr), (m.fpr, fpr), (m.roc_auc, auc)):
        assert (got is None and want is None) or got == pytest.approx(want)


def test_partner_has_other_label_and_cosines_in_range(spark):
    r = retrieval.build(fixtures.corpus(spark, SF01))
    lab = r.train.select("doc_id", "label")
    p = retrieval.nearest_opposite(r)
    j = p.join(lab.withColumnRenamed("doc_id", "train_id"), "train_id").join(
        lab.select(F.col("doc_id").alias("partner_id"), F.col("label").alias("plabel")), "partner_id")
    assert j.filter("label = plabel").count() == 0
    assert p.count() == r.train.count()
    top = retrieval.topk_similar(r, 8)
    assert top.filter("similarity < -1e-12 OR similarity > 1 + 1e-9").count() == 0
    # ranks are consecutive 1..k per test row and similarities never increase with rank
    w = top.groupBy("test_id").agg(F.count("*").alias("n"), F.max("rank").alias("mx"))
    assert w.filter("n != 8 OR mx != 8").count() == 0
