"""Packed rows and stored blocks: the same vectors as the long tables, bounded blocks, and a search that shuffles neither side."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlens.operators import retrieval, routed, tfidf

WORDS = [f"w{i}" for i in range(60)]


def corpus(spark):
    rng = np.random.default_rng(9)
    text = lambda: " ".join(WORDS[min(int(rng.exponential(9)), 59)] for _ in range(rng.integers(0, 25)))
    rows = [(i, text(), ["real", "real", "fake", None][i % 4], "test" if i % 5 == 0 else "train") for i in range(90)]
    rows += [rows[1], (2, "aa w1 w1 new", "fake", "train"), (5, None, "real", "test"), (95, "Unknown WORDS w3", "real", "test"), (None, "w1 w2", "real", "train")]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, split string")


@pytest.mark.parametrize("frequent", [1 << 18, 7, 0])
def test_packed_rows_are_the_vectors(spark, monkeypatch, frequent):
    monkeypatch.setattr(tfidf, "FREQUENT", frequent)       # the idf of the other terms comes by the join
    r = retrieval.build(corpus(spark))
    r.train_vecs.cache(), r.test_vecs.cache()
    for side, vecs, docs, label in ((r.train_packed(), r.train_vecs, r.train, "label"), (r.test_packed(), r.test_vecs, r.test, None)):
        term = {x.code: x.term for x in side.terms.collect()}
        got = {(x.id, x.label, term[c]): w for x in side.rows.collect() for c, w in zip(x.codes, x.weights)}
        d, v = routed.sides(docs, vecs, "doc_id", label)
        want = {(x.id, x.label, x.term): x.weight for x in v.join(d, "id").collect()}
        assert set(got) == set(want) and all(got[x] == pytest.approx(w, abs=1e-12) for x, w in want.items())
        assert sum(x.postings for x in side.blocks.select("postings").collect()) == len(want)
    r.train_vecs.unpersist(), r.test_vecs.unpersist()


def test_a_term_with_the_code_of_another_is_left_out(spark, monkeypatch):
    rows = [(1, "aa bb", "real", "train"), (2, "cc", "real", "train"), (3, "strange cc", "real", "test")]
    monkeypatch.setattr(tfidf, "_code", lambda term, salt: F.xxhash64(F.when(term == "strange", "aa").otherwise(term), F.lit(salt)))
    top = retrieval.topk_similar(retrieval.build(spark.createDataFrame(rows, "doc_id long, text string, label string, split string")), 2)
    assert [(x.train_id, round(x.similarity, 9)) for x in top.orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]


def test_neither_side_is_shuffled_and_blocks_are_bounded(spark, monkeypatch):
    # before, every query crossed the network once for each block of the base
    monkeypatch.setattr(routed, "CHUNK", 6)
    monkeypatch.setattr(routed, "BLOCK_POSTINGS", 40)
    r = retrieval.build(corpus(spark))
    assert all(x.n <= 6 and (x.postings <= 40 or x.n == 1) for x in r.index().blocks.select("n", "postings").collect())
    q_docs, q = routed._queries(r.test, r.test_packed(), "doc_id", None)
    plan = routed._found(q_docs, q, r.index(), False, k=2, min_sim=None, exclude_self=False)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
