"""Request building for the three prompting strategies and the parameter grids, as one DataFrame per run.

A sweep never loops on the driver: retrieval runs once at the largest k, each grid cell keeps the ranks it needs
(``rank <= num_shots``), the temperature / model axes are exploded from literal arrays (no join at all), and a
single scoring job plus one grouped aggregate produce the metrics of every cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluation, gather, knn, retrieval, routed
from ..operators.retrieval import Retrieval
from . import prompts, scoring

# Fixed values that must match the reference's behaviour: model size label -> model tag.
MODEL_TAGS = {
    "1b": "llama3.2:1b",
    "3b": "llama3.2:latest",
    "8b": "llama3.1:latest",
    "27b": "gemma2:27b",
    "70b": "llama3.1:70b",
}
SHOTS_GRID = list(range(1, 9))
TEMPERATURE_GRID = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
MODEL_SIZE_GRID = ["1b", "3b", "27b"]

RUN_COLS = ["strategy", "model", "num_shots", "temperature", "replicate"]


def route_model(size: Column) -> Column:
    """Size label -> model tag; an unknown size fails the job (the reference silently reuses a stale value)."""
    tags = F.create_map(*[F.lit(x) for kv in MODEL_TAGS.items() for x in kv])
    tag = F.element_at(tags, size)
    return F.when(tag.isNull(), F.raise_error(F.concat(F.lit("unknown model size "), size))).otherwise(tag)


def grid(df: DataFrame, temperatures: list[float], model_sizes: list[str], replicates: int = 1) -> DataFrame:
    """Expand requests over temperature x model size x replicate without a join."""
    return (
        df.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
        .withColumn("model_size", F.explode(F.array(*[F.lit(s) for s in model_sizes])))
        .withColumn("model", route_model(F.col("model_size")))
        .withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    )


def cells(spark, strategy: str, shots: list[int], temperatures: list[float] = (0.0,), model_sizes: list[str] = ("8b",)) -> DataFrame:
    """The run keys (RUN_COLS) of a grid, before any request is built; types and values as the requests have them."""
    ks = F.array(*[F.lit(int(k)) for k in shots])
    one = spark.range(1).select(F.lit(strategy).alias("strategy"), F.explode(ks).alias("num_shots"))
    return grid(one, list(temperatures), list(model_sizes)).select(*RUN_COLS)


def topk_requests(r: Retrieval, top: DataFrame, shots: list[int], temperatures: list[float] = (0.0,),
                  model_sizes: list[str] = ("8b",), template=prompts.TEXT_ONLY, only: DataFrame | None = None) -> DataFrame:
    """Text-only strategy: one request per (test doc, num_shots, temperature, model); with ``only`` (doc_id, RUN_COLS) just
    those of these cells, which come to the texts, so that no prompt is shuffled to meet them."""
    ks = F.array(*[F.lit(int(k)) for k in shots])
    picks = top.where(F.col("rank") <= max(shots, default=0)).select(
        F.col("test_id").alias("doc_id"), F.col("train_id").alias("row_id"), F.col("rank").alias("slot"),
        F.lit("Similar").alias("kind"), F.col("similarity").alias("ex_similarity"))
    train = r.train.select(F.col("doc_id").alias("row_id"), F.col("text").alias("ex_text"), F.col("label").alias("ex_label"))
    # a request gets its rows once, for the largest k; the cells are made of them in place
    test = r.test.select("doc_id", "text")
    if only is not None:
        test = test.join(only.groupBy("doc_id").agg(F.collect_set(F.struct(*RUN_COLS)).alias("only")), "doc_id")
    cells = gather.with_rows(test, picks, train).withColumn("num_shots", F.explode(ks))
    mine = F.filter("picked", lambda x: x["slot"] <= F.col("num_shots"))
    req = prompts.from_picked(cells, mine, template, with_metrics=False, with_kind=False).select(
        "doc_id", "num_shots", "system_prompt", prompts.user_prompt(template, False).alias("user_prompt"), "exemplars",
        *([] if only is None else ["only"]))
    req = grid(req.withColumn("strategy", F.lit("topk")), list(temperatures), list(model_sizes))
    if only is None:
        return req
    return req.where(F.exists("only", lambda x: F.struct(*[x[c] for c in RUN_COLS]) == F.struct(*RUN_COLS))).drop("only")


def _feature_cols(prefix: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in ("avg_degree_centrality", "eigenvector_centrality",
                                                 "median_retweet_time")]


def balanced_requests(features: DataFrame, k: int = 3, model_size: str = "70b") -> tuple[DataFrame, DataFrame]:
    """Graph-aware balanced strategy on propagation feature rows (doc_id, text, label, split, metrics...).

    Returns (requests, truth)."""
    r = retrieval.build(features)
    partners, top = retrieval.nearest_opposite(r), retrieval.topk_similar(r, k)
    r.release()
    return balanced_requests_of(r.train, r.test, top, partners, k, model_size), r.test.select("doc_id", "label")


def balanced_requests_for(train: DataFrame, test: DataFrame, index: routed.Index, test_vecs: DataFrame | routed.Packed,
                          partners: DataFrame, k: int = 3, model_size: str = "70b") -> DataFrame:
    """Requests of test rows against a fitted train index (train rows, their sharded vectors, the partner table).

    Used, per micro-batch, by the incremental (streaming) run."""
    top = knn.exact_topk(test, train, k, query_vecs=test_vecs, index=index).select(
        F.col("qid").alias("test_id"), F.col("bid").alias("train_id"), "rank", F.col("sim").alias("similarity"))
    return balanced_requests_of(train, test, top, partners, k, model_size)


def balanced_requests_of(train: DataFrame, test: DataFrame, top: DataFrame, partners: DataFrame, k: int = 3, model_size: str = "70b") -> DataFrame:
    """Requests of test rows whose similar train rows (``top``) and these rows' partners are found."""
    sel = retrieval.balanced(top, partners, k)
    picks = sel.select(F.col("test_id").alias("doc_id"), F.col("train_id").alias("row_id"), "slot", "kind",
                       F.col("similarity").alias("ex_similarity"))
    ex_side = train.select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("ex_text"), F.col("label").alias("ex_label"),
        *_feature_cols("ex_"))
    own = test.select("doc_id", "text", "avg_degree_centrality", "eigenvector_centrality", "median_retweet_time")
    cells = gather.with_rows(own, picks, ex_side).withColumn("num_shots", F.lit(k))
    req = prompts.from_picked(cells, F.col("picked"), prompts.WITH_GRAPH, with_metrics=True, with_kind=True).select(
        "doc_id", "num_shots", "system_prompt", prompts.user_prompt(prompts.WITH_GRAPH, True).alias("user_prompt"),
        "exemplars")
    return grid(req.withColumn("strategy", F.lit("balanced")), [0.0], [model_size])


def fixed_requests(features: DataFrame, per_label: int = 3, seed: str = "exemplars",
                   model_size: str = "70b") -> tuple[DataFrame, DataFrame]:
    """Class-balanced exemplars independent of the test row (3 fake + 3 real by default), graph metrics shown.

    The exemplar set is bounded (per_label x labels rows), so its single prompt row is taken to the driver and
    attached to every test row as a literal — no join at all."""
    train = features.filter(F.col("split") == "train")
    picks = retrieval.stratified_exemplars(train, per_label, seed)
    # numbered over the exemplars present, per_label rows of each label at most
    order = Window.orderBy((F.col("label") == "fake").desc(), "label", "pick")
    ex = picks.join(train.withColumnRenamed("label", "_l"), "doc_id").select(
        F.lit("fixed").alias("strategy"),
        F.row_number().over(order).alias("slot"),
        F.lit("Fixed").alias("kind"), F.col("text").alias("ex_text"), F.col("label").alias("ex_label"),
        *_feature_cols("ex_"), F.lit(None).cast("double").alias("ex_similarity"))
    system = prompts.system_prompts(ex, ["strategy"], prompts.WITH_GRAPH, with_metrics=True, with_kind=False)
    row = system.first()
    test = features.filter(F.col("split") == "test")
    if row is None:
        raise ValueError("no train rows to draw fixed exemplars from")
    exemplars = F.array(*[
        F.struct(F.lit(e["slot"]).cast("int").alias("slot"), F.lit(e["label"]).alias("label"),
                 F.lit(e["similarity"]).cast("double").alias("similarity"))
        for e in row["exemplars"]
    ])
    req = test.select(
        "doc_id", F.lit("fixed").alias("strategy"), F.lit(len(row["exemplars"])).alias("num_shots"),
        F.lit(row["system_prompt"]).alias("system_prompt"),
        prompts.user_prompt(prompts.WITH_GRAPH, True).alias("user_prompt"), exemplars.alias("exemplars"))
    return grid(req, [0.0], [model_size]), test.select("doc_id", "label")


def score_and_evaluate(requests: DataFrame, truth: DataFrame, make_client=scoring.vote_stub,
                       mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """One scoring job over every cell, then metrics grouped by the run key."""
    key = ["doc_id", *RUN_COLS]
    preds = scoring.score(requests, make_client, key)
    pairs = evaluation.eval_pairs_strict(preds.select(*key, "prediction"), truth, "doc_id")
    return preds, evaluation.metrics(pairs, RUN_COLS, mode)
