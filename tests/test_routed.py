"""Sharded search against brute force: ties, zero vectors, label predicates, hot shards, thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlens.operators import knn, routed


def matrix(rng, n, width, most=6):
    """Unit rows of few terms, some of them equal, some empty."""
    m = np.zeros((n, width))
    for i in range(n):
        if i % 9 == 8 and i > 9:
            m[i] = m[i - 3]                      # equal rows: ties by id
            continue
        terms = rng.choice(width, size=rng.integers(0, most), replace=False, p=np.arange(width, 0, -1) / (width * (width + 1) / 2))
        m[i, terms] = rng.random(len(terms)) + 0.05
    norm = np.linalg.norm(m, axis=1)
    return m / np.where(norm == 0, 1, norm)[:, None]


def tables(spark, m, labels, name=lambda i: i, kind="long"):
    docs = spark.createDataFrame([(name(i), labels[i]) for i in range(len(m))], f"doc_id {kind}, label string")
    rows = [(name(i), f"w{j}", float(m[i, j])) for i in range(len(m)) for j in np.flatnonzero(m[i])]
    return docs, spark.createDataFrame(rows, f"doc_id {kind}, term string, weight double")


def brute(q, b, k, ok):
    s = q @ b.T
    return {
        i: [(j, r + 1, round(s[i, j], 9)) for r, j in enumerate(sorted((j for j in range(len(b)) if ok(i, j)), key=lambda j: (-round(s[i, j], 9), j))[:k])]
        for i in range(len(q))
    }


def found(top):
    out = {}
    for r in sorted(top.collect(), key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append((r.bid, r.rank, round(r.sim, 9)))
    return out


@pytest.mark.parametrize("limits", [(4096, 2048, 4), (5, 3, 4), (2, 1, 1), (16, 4, 90)])
def test_topk_equals_brute_force(spark, monkeypatch, limits):
    shard_rows, chunk, k = limits
    monkeypatch.setattr(routed, "CHUNK", chunk)
    rng = np.random.default_rng(sum(limits))
    q, b = matrix(rng, 23, 40), matrix(rng, 57, 40)
    qd, qv = tables(spark, q, ["x"] * len(q))
    bd, bv = tables(spark, b, ["y"] * len(b))
    got = found(knn.exact_topk(qd, bd, k, query_vecs=qv, base_vecs=bv, shard_rows=shard_rows))
    assert got == brute(q, b, k, lambda i, j: True)


@pytest.mark.parametrize("shard_rows", [1000, 6])
def test_other_label_where_nearly_all_rows_share_one(spark, shard_rows):
    rng = np.random.default_rng(5)
    m = matrix(rng, 100, 30)
    labels = ["real"] * 100
    labels[41] = "fake"                          # 99 % of one label
    labels[97] = None                            # a label of its own
    d, v = tables(spark, m, labels)
    top = knn.exact_topk(d, d, 2, query_vecs=v, base_vecs=v, label_col="label", exclude_same_label=True, shard_rows=shard_rows)
    assert found(top) == brute(m, m, 2, lambda i, j: labels[i] != labels[j])
    index = routed.build(d, v, label_col="label", shard_rows=shard_rows)
    q_docs, q_vecs = routed.sides(d, v, "doc_id", "label")
    visits = routed._bounds(q_docs.where("label = '=real'"), q_vecs, index, True)
    assert visits.where("shard like '=real/%'").count() == 0
    alone = d.where("label = 'real'")
    assert knn.exact_topk(alone, alone, 1, query_vecs=v, base_vecs=v, label_col="label", exclude_same_label=True).count() == 0


def test_self_pairs_strings_and_empty_sides(spark):
    rng = np.random.default_rng(8)
    m = matrix(rng, 30, 12)
    name = lambda i: f"d{i:02d}"
    d, v = tables(spark, m, ["a"] * 30, name, "string")
    got = found(knn.exact_topk(d, d, 3, query_vecs=v, base_vecs=v, exclude_self=True, shard_rows=4))
    assert got == {name(i): [(name(j), r, s) for j, r, s in x] for i, x in brute(m, m, 3, lambda i, j: i != j).items()}
    none_d, none_v = d.limit(0), v.limit(0)
    assert knn.exact_topk(none_d, d, 3, query_vecs=none_v, base_vecs=v).count() == 0
    assert knn.exact_topk(d, none_d, 3, query_vecs=v, base_vecs=none_v).count() == 0
    assert knn.exact_topk(d, d, 0, query_vecs=v, base_vecs=v).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.999999999])
def test_threshold_join_equals_brute_force(spark, least):
    rng = np.random.default_rng(11)
    q, b = matrix(rng, 31, 25), matrix(rng, 64, 25)
    b[:5] = q[:5]
    qd, qv = tables(spark, q, ["x"] * len(q))
    bd, bv = tables(spark, b, ["y"] * len(b))
    got = {(r.qid, r.bid) for r in knn.similarity_join(qd, bd, least, query_vecs=qv, base_vecs=bv, shard_rows=7).collect()}
    s = np.round(q @ b.T, 9)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= least))} and got
    with pytest.raises(ValueError):
        knn.similarity_join(qd, bd, 0.0, query_vecs=qv, base_vecs=bv)


def test_bounds_keep_queries_out_of_shards(spark):
    # two vocabularies: a query visits the shards of its own one only, and every base row lies in one shard
    rng = np.random.default_rng(2)
    m = np.zeros((200, 40))
    m[:100, :20], m[100:, 20:] = matrix(rng, 100, 20), matrix(rng, 100, 20)
    d, v = tables(spark, m, ["a"] * 200)
    index = routed.build(d, v, shard_rows=10)
    assert index.postings.select("shard", "id").distinct().count() == v.select("doc_id").distinct().count()
    assert index.postings.groupBy("shard").agg(F.countDistinct("id").alias("n")).agg(F.max("n")).first()[0] <= 40
    q_docs, q_vecs = routed.sides(d, v, "doc_id", None)
    pairs = routed._bounds(q_docs, q_vecs, index, False)
    bound = {(r.id, r.shard): r.bound for r in pairs.collect()}
    shard_of = {r.id: r.shard for r in index.postings.select("id", "shard").distinct().collect()}
    s = m @ m.T
    assert all(s[i, j] <= bound[i, shard_of[j]] + 1e-9 for i in range(200) for j in shard_of if s[i, j] > 0)
    shards = len(set(shard_of.values()))
    assert len(bound) < 0.75 * len(shard_of) * shards


def test_rows_are_copied_for_blocks_not_for_shared_terms(spark):
    rng = np.random.default_rng(3)
    m = np.abs(rng.random((300, 8))) + 0.1       # every row shares every term with every other
    m /= np.linalg.norm(m, axis=1)[:, None]
    d, v = tables(spark, m, ["real"] * 200 + ["fake"] * 100)
    index = routed.build(d, v, label_col="label", shard_rows=10)
    assert index.rows.count() == 300             # a row travels packed, however many terms it has
    q_docs, _ = routed.sides(d, v, "doc_id", "label")
    groups, cells = routed._cells(index, q_docs, False)
    copies = 300 * max(cells) + 300 * len(cells)
    assert copies <= 3 * 300 * np.sqrt(2 * spark.sparkContext.defaultParallelism) + 600
    assert found(knn.exact_topk(d, d, 2, query_vecs=v, index=index)) == brute(m, m, 2, lambda i, j: True)


def test_labels_with_blocks_of_their_own_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(routed, "OWN_ROWS", 20)
    monkeypatch.setattr(routed, "BLOCK_ROWS", 7)
    monkeypatch.setattr(routed, "CHUNK", 11)
    rng = np.random.default_rng(6)
    m = matrix(rng, 90, 30)
    labels = [["real", "real", "fake", None, "x"][i % 5] for i in range(90)]
    d, v = tables(spark, m, labels)
    top = knn.exact_topk(d, d, 3, query_vecs=v, base_vecs=v, label_col="label", exclude_same_label=True, shard_rows=3)
    assert found(top) == brute(m, m, 3, lambda i, j: labels[i] != labels[j])


def test_terms_of_one_code_get_another_salt(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = matrix(rng, 40, 20)
    d, v = tables(spark, m, ["a"] * 40)
    monkeypatch.setattr(routed, "_code", lambda salt: F.xxhash64("term", F.lit(salt)) if salt else F.xxhash64(F.length("term")))
    index = routed.build(d, v, shard_rows=5)
    assert index.salt == 1
    # a query's term that the base lacks, of a code that the base has
    monkeypatch.setattr(routed, "_code", lambda salt: F.xxhash64(F.when(F.col("term") == "strange", "w1").otherwise(F.col("term")), F.lit(salt)))
    q, qv = spark.createDataFrame([(1, "a")], "doc_id long, label string"), spark.createDataFrame([(1, "strange", 1.0)], "doc_id long, term string, weight double")
    assert [(r.bid, r.sim) for r in knn.exact_topk(q, d, 2, query_vecs=qv, index=index).orderBy("rank").collect()] == [(0, 0.0), (1, 0.0)]


def test_dense_blocks_of_any_size_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "TILE", 5)
    rng = np.random.default_rng(12)
    m = rng.normal(size=(60, 4)).round(1)        # negative similarities too
    m[7] = m[3]
    m[9] = 0                                     # similarity 0 to all
    d = spark.createDataFrame([(i, m[i].tolist(), "ab"[i % 2]) for i in range(60)], "id long, v array<double>, label string")
    n = np.linalg.norm(m, axis=1)
    u = m / np.where(n == 0, 1, n)[:, None]
    for how, ok in (({"exclude_self": True}, lambda i, j: i != j), ({"label_col": "label", "exclude_same_label": True}, lambda i, j: i % 2 != j % 2)):
        top = knn.exact_topk(d, d, 40, id_col="id", vec_col="v", q_block_rows=7, b_block_rows=13, **how)
        assert found(top) == brute(u, u, 40, ok)


def test_a_dense_cell_holds_its_base_block_only(spark):
    # queries stream past the block: the grid has no more query blocks than the cores ask for
    assert knn._block_counts(spark, 10_000_000, 1000, 16384, 4)[0] <= 4
