"""Requests with the rows that they picked: against a plain dictionary, and what is shuffled for it."""

import collections
import random

from pyspark.sql import functions as F

from spreadlens.operators import gather, retrieval, routed, tfidf
from spreadlens.plans import sweeps


def test_rows_of_picks_as_a_dictionary_gives_them(spark, monkeypatch):
    monkeypatch.setattr(gather, "BATCH_BYTES", 200)
    rng = random.Random(3)
    ids = [*range(40), 7, 7, None]                                  # repeated and null request ids
    requests = [(i, f"own {n}") for n, i in enumerate(ids)]
    rows = [(i, f"text {i} " + "x" * rng.randrange(60), rng.choice(["fake", "real", None])) for i in [*range(30), 3, None]]
    picks = [(i, rng.randrange(35), s, rng.random()) for i in range(38) for s in range(1, rng.randrange(1, 6))]
    picked = collections.defaultdict(list)
    for i, r, s, sim in picks:
        picked[i] += [(s, sim, t, lab) for x, t, lab in rows if x == r]
    want = sorted(((i is None, i or 0, own, sorted(picked[i], key=str)) for i, own in requests), key=str)
    for share_picks in (5, 4096):
        got = gather.with_rows(spark.createDataFrame(requests, "doc_id long, own string"), spark.createDataFrame(picks, "doc_id long, row_id long, slot int, sim double"),
                               spark.createDataFrame(rows, "row_id long, text string, label string"), share_picks).collect()
        assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["own"], sorted((tuple(x) for x in r["picked"]), key=str)) for r in got), key=str) == want


def test_no_picks_and_no_rows(spark):
    requests, rows = spark.createDataFrame([("a",), ("b",)], "doc_id string"), spark.createDataFrame([], "row_id long, text string")
    for picks in ([], [("a", 1, 1)]):
        got = gather.with_rows(requests, spark.createDataFrame(picks, "doc_id string, row_id long, slot int"), rows).collect()
        assert sorted((r["doc_id"], r["picked"]) for r in got) == [("a", []), ("b", [])]


def test_prompts_are_made_where_the_rows_are(spark):
    """No shuffle carries prompts or one copy of a text for each pick: nothing is joined or grouped after the picked rows met
    their requests, and a row goes once to a share."""
    corpus = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), (F.col("id") % 7).cast("string"), F.lit(" same words")).alias("text"),
                                    F.lit("real").alias("label"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    r = retrieval.build(corpus)
    req = sweeps.topk_requests(r, retrieval.topk_similar(r, 4), [1, 4], [0.0, 0.5])
    plan = req._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")
    assert len(plan) > 1 and not any(x in plan[0] for x in ("Join", "Aggregate", "Repartition")), plan[0]
    assert "Distinct" in plan[1] or "Aggregate [share" in plan[1]
    assert req.count() == 12 * 2 * 2


def test_fitted_model_keeps_no_cache(spark):
    """A cached model would keep the shuffled texts that it was counted from on disk."""
    docs = spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id long, text string")
    model = tfidf.fit(docs)
    assert not model.idf.storageLevel.useDisk and "InMemoryRelation" not in model.idf._jdf.queryExecution().optimizedPlan().toString()
    assert {r["term"]: r["df"] for r in model.idf.collect()} == {"one": 1, "two": 2, "three": 1}


def test_blocks_and_rows_not_picked_are_gone_before_prompts(spark, monkeypatch, tmp_path):
    """Of what a search stored only its result is left when requests are dealt, and of the base only the rows that were picked."""
    monkeypatch.setattr(routed, "scratch_path", lambda _, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    corpus = spark.range(90).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 30, "near words").otherwise("far off").alias("text"),
                                    F.lit("real").alias("label"), F.when((F.col("id") < 30) & (F.col("id") % 5 == 0), "test").otherwise("train").alias("split"))
    r = retrieval.build(corpus)
    first = sorted(map(tuple, (top := retrieval.topk_similar(r, 2)).collect()))
    assert list(tmp_path.glob("shard-blocks-*"))
    r.release()
    assert not list(tmp_path.glob("shard-blocks-*"))
    req = sweeps.topk_requests(r, top, [2])
    picked = [spark.read.parquet(str(p)) for p in tmp_path.glob("picked-rows-*")]
    assert [sorted(x.row_id for x in p.collect()) for p in picked] == [[1, 2]]       # the least ids of equal rows
    assert req.count() == 6
    assert sorted(map(tuple, retrieval.topk_similar(r, 2).collect())) == first        # made again for a later search


def test_balanced_requests_leave_no_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(routed, "scratch_path", lambda _, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    rows = [(i, f"w{i % 4} same", ["fake", "real"][i % 2], "test" if i % 5 == 0 else "train", 0.1, 0.2, 3.0) for i in range(30)]
    names = "doc_id long, text string, label string, split string, avg_degree_centrality double, eigenvector_centrality double, median_retweet_time double"
    req, truth = sweeps.balanced_requests(spark.createDataFrame(rows, names), 2)
    assert not list(tmp_path.glob("shard-blocks-*"))
    assert sorted((x.doc_id, len(x.exemplars)) for x in req.collect()) == [(i, 4) for i in range(0, 30, 5)] and truth.count() == 6
