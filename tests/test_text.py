"""Tokens, TF-IDF, exact top-k (vs brute force), partners and balanced retrieval."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlens.functions.text import capitalize, fmt2, tokens
from spreadlens.operators import knn, retrieval, tfidf


def test_tokens(spark):
    df = spark.createDataFrame([("a bb çé_1 ½½ x-yz",)], "t string")
    assert df.select(tokens(F.col("t"))).first()[0] == ["bb", "çé_1", "½½", "yz"]


def test_number_and_label_display(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (1.005,), (12627.0,)], "x double")
    assert [r[0] for r in df.select(fmt2(F.col("x"))).collect()] == ["0.12", "2.67", "1.00", "12627.00"]
    lab = spark.createDataFrame([("fake",), ("fake NEWS",)], "l string")
    assert [r[0] for r in lab.select(capitalize(F.col("l"))).collect()] == ["Fake", "Fake news"]


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, label string, split string")


def test_tfidf_two_documents(spark):
    c = _corpus(spark, [(1, "aa bb", "fake", "train"), (2, "aa cc", "real", "train"), (3, "zz", "real", "test"),
                        (4, "", "real", "test")])
    r = retrieval.build(c)
    idf = {x.term: x.idf for x in r.model.idf.collect()}
    assert r.model.n_docs == 2
    assert idf["aa"] == pytest.approx(1.0) and idf["bb"] == pytest.approx(1.405465, abs=1e-6)
    v1 = {x.term: x.weight for x in r.train_vecs.filter("doc_id = 1").collect()}
    assert v1["aa"] == pytest.approx(0.579739, abs=1e-6) and v1["bb"] == pytest.approx(0.814802, abs=1e-6)
    pairs = knn.exact_topk(r.train, r.train, 2, query_vecs=r.train_vecs, base_vecs=r.train_vecs).filter(
        "qid = 1 AND bid = 2").first()
    assert pairs.sim == pytest.approx(0.336097, abs=1e-6)
    # zero vectors (no known term / empty text) still get k back-filled rows with similarity 0, lowest ids first
    top = retrieval.topk_similar(r, 2).orderBy("test_id", "rank").collect()
    assert [(t.test_id, t.train_id, t.similarity) for t in top] == [(3, 1, 0.0), (3, 2, 0.0), (4, 1, 0.0), (4, 2, 0.0)]


def test_balanced_retrieval_golden(spark):
    c = _corpus(spark, [(1, "aa bb", "fake", "train"), (2, "aa bb dd", "fake", "train"), (3, "aa cc", "real", "train"),
                        (10, "aa bb", "real", "test")])
    r = retrieval.build(c)
    b = retrieval.balanced(retrieval.topk_similar(r, 2), retrieval.nearest_opposite(r), 2)
    got = [(x.slot, x.kind, x.train_id) for x in b.orderBy("slot").collect()]
    assert got == [(1, "Similar", 1), (2, "Similar", 2), (3, "Contrastive", 3), (4, "Contrastive", 3)]


def test_no_opposite_label_no_partner_slots(spark):
    c = _corpus(spark, [(1, "aa bb", "fake", "train"), (2, "aa cc", "fake", "train"), (10, "aa", "real", "test")])
    r = retrieval.build(c)
    b = retrieval.balanced(retrieval.topk_similar(r, 2), retrieval.nearest_opposite(r), 2)
    assert sorted(x.kind for x in b.collect()) == ["Similar", "Similar"]


def test_equal_texts_lower_id_first(spark):
    c = _corpus(spark, [(7, "aa bb", "fake", "train"), (3, "aa bb", "real", "train"), (5, "cc", "real", "train"),
                        (10, "aa bb", "real", "test")])
    top = retrieval.topk_similar(retrieval.build(c), 2).orderBy("rank").collect()
    assert [t.train_id for t in top] == [3, 7]


def test_dense_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    q = rng.normal(size=(9, 5))
    b = rng.normal(size=(31, 5))
    qd = spark.createDataFrame([(i, q[i].tolist()) for i in range(9)], "id long, v array<double>")
    bd = spark.createDataFrame([(100 + i, b[i].tolist()) for i in range(31)], "id long, v array<double>")
    got = knn.exact_topk(qd, bd, 3, id_col="id", vec_col="v", q_block_rows=4, b_block_rows=8).collect()
    qn = q / np.linalg.norm(q, axis=1)[:, None]
    bn = b / np.linalg.norm(b, axis=1)[:, None]
    s = qn @ bn.T
    for r in got:
        best = sorted(range(31), key=lambda j: (-round(s[r.qid, j], 9), j))[r.rank - 1]
        assert r.bid == 100 + best


def test_similarity_join_threshold(spark):
    c = _corpus(spark, [(1, "aa bb", "fake", "train"), (2, "cc dd", "real", "train"), (10, "aa bb", "real", "test")])
    r = retrieval.build(c)
    pairs = knn.similarity_join(r.test, r.train, 0.5, query_vecs=r.test_vecs, base_vecs=r.train_vecs).collect()
    assert [(p.qid, p.bid) for p in pairs] == [(10, 1)]


def test_k_larger_than_train_returns_all_rows(spark):
    c = _corpus(spark, [(1, "aa bb", "fake", "train"), (2, "aa cc", "real", "train"), (10, "aa", "real", "test")])
    top = retrieval.topk_similar(retrieval.build(c), 10).collect()
    assert sorted(t.train_id for t in top) == [1, 2]
