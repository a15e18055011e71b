"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the driver tables.

Floats are rounded to 6 decimals and every column is aliased as in ``oracle.ORACLE``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eigen, features, graph, routed
from ..sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------------------------------------------ graphs
def _graphs(spark: SparkSession, sf_dir: str):
    ev = fixtures.graph_events(spark, sf_dir)
    return ev, graph.undirected_edges(fixtures.graph_edges(ev, "chain"))


@register
def q_undirected_edges(spark, sf_dir):
    _, e = _graphs(spark, sf_dir)
    return e


@register
def q_graph_vertices(spark, sf_dir):
    _, e = _graphs(spark, sf_dir)
    return graph.vertices(e)


@register
def q_degree_centrality(spark, sf_dir):
    _, e = _graphs(spark, sf_dir)
    return graph.degree_centrality(e).select(
        "propagation_id", "vertex", "degree", r6("degree_centrality").alias("degree_centrality"))


@register
def q_avg_degree_centrality(spark, sf_dir):
    _, e = _graphs(spark, sf_dir)
    return graph.avg_degree_centrality(e).select(
        "propagation_id", "n_vertices", "n_edges", r6("avg_degree_centrality").alias("avg_degree_centrality"))


@register
def q_eigenvector_centrality(spark, sf_dir):
    _, e = _graphs(spark, sf_dir)
    return eigen.eigenvector_centrality(e).select(
        "propagation_id", "vertex", r6("eigenvector_centrality").alias("eigenvector_centrality"), "iterations",
        "converged")


@register
def q_avg_eigenvector_centrality(spark, sf_dir):
    _, e = _graphs(spark, sf_dir)
    return features.eigenvector_summary(e).select(
        "propagation_id", r6("eigenvector_centrality").alias("eigenvector_centrality"), "eig_iterations",
        "eig_converged")


@register
def q_median_delay(spark, sf_dir):
    ev = fixtures.graph_events(spark, sf_dir)
    props = ev.filter(F.col("pos") == 0).select("propagation_id")
    med = graph.median_delay_sorted(fixtures.graph_delays(ev))
    return props.join(med, "propagation_id", "left").select(
        "propagation_id", r6(F.coalesce(F.col("median_retweet_time"), F.lit(0.0))).alias("median_retweet_time"))


def graph_features(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    ev = ev if ev is not None else fixtures.graph_events(spark, sf_dir, labelled=True)
    props = fixtures.propagations(spark, sf_dir, ev)
    return features.propagation_features(props, fixtures.graph_edges(ev, "chain"), fixtures.graph_delays(ev))


@register
def q_propagation_features(spark, sf_dir):
    f = graph_features(spark, sf_dir)
    return f.select(
        "propagation_id", "text", "label",
        r6("avg_degree_centrality").alias("avg_degree_centrality"),
        r6("eigenvector_centrality").alias("eigenvector_centrality"),
        r6("median_retweet_time").alias("median_retweet_time"),
        "graph_status",
    )


# ------------------------------------------------------------------------------------------------ text retrieval
TOPK = 8            # largest k of the shots sweep (1..8); one retrieval serves every cell
BALANCED_K = 3      # similar rows of the balanced run (3 similar + 3 contrastive)
DENSE_K = 5
EXEMPLAR_SEED = "exemplars"
EXEMPLARS_PER_LABEL = 3
SIMILARITY_JOIN_MIN = 0.5


def _retrieval(spark, sf_dir):
    from ..operators import retrieval
    return retrieval.build(fixtures.corpus(spark, sf_dir))


@register
def q_tokens(spark, sf_dir):
    from ..functions.text import tokens
    docs = fixtures.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token")).select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "token")


@register
def q_term_counts(spark, sf_dir):
    from ..operators import tfidf
    return tfidf.term_counts(fixtures.table(spark, sf_dir, "documents"))


@register
def q_idf(spark, sf_dir):
    from ..operators import tfidf
    train = fixtures.corpus(spark, sf_dir).filter(F.col("split") == "train")
    return tfidf.fit(train, n_docs=train.count()).idf.select("term", "df", r6("idf").alias("idf"))


@register
def q_tfidf_vectors(spark, sf_dir):
    from ..operators import retrieval
    r = retrieval.build(fixtures.corpus(spark, sf_dir), keep_counts=True)     # the vectors are the output
    return r.train_vecs.unionByName(r.test_vecs).select("doc_id", "term", r6("weight").alias("weight"))


@register
def q_cosine_pairs(spark, sf_dir):
    from ..operators import knn
    r = _retrieval(spark, sf_dir)
    pairs = knn.similarity_join(r.test, r.train, SIMILARITY_JOIN_MIN, query_vecs=r.test_packed(), index=r.index())
    return pairs.select(F.col("qid").alias("test_id"), F.col("bid").alias("train_id"), r6("sim").alias("similarity"))


@register
def q_topk_similar(spark, sf_dir):
    from ..operators import retrieval
    top = retrieval.topk_similar(_retrieval(spark, sf_dir), TOPK)
    return top.select("test_id", "train_id", "rank", r6("similarity").alias("similarity"))


@register
def q_nearest_opposite(spark, sf_dir):
    from ..operators import retrieval
    p = retrieval.nearest_opposite(_retrieval(spark, sf_dir))
    return p.select("train_id", "partner_id", r6("similarity").alias("similarity"))


def balanced_retrieval(spark, sf_dir, k=BALANCED_K):
    from ..operators import retrieval
    r = _retrieval(spark, sf_dir)
    b = retrieval.balanced(retrieval.topk_similar(r, k), retrieval.nearest_opposite(r), k)
    return r, b


@register
def q_balanced_retrieval(spark, sf_dir):
    r, b = balanced_retrieval(spark, sf_dir)
    lab = r.train.select(F.col("doc_id").alias("train_id"), "label")
    return b.join(lab, "train_id").select(
        "test_id", "slot", "kind", "train_id", "anchor_id", "label", r6("similarity").alias("similarity"))


@register
def q_balanced_random_exemplars(spark, sf_dir):
    from ..operators import retrieval
    train = fixtures.corpus(spark, sf_dir).filter(F.col("split") == "train")
    return retrieval.stratified_exemplars(train, EXEMPLARS_PER_LABEL, EXEMPLAR_SEED)


@register
def q_dense_topk(spark, sf_dir):
    """The DENSE_K nearest other embeddings of every embedding (all rows against all rows, self excluded)."""
    from ..operators import knn
    emb = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    top = knn.exact_topk(emb, emb, DENSE_K, id_col="vec_id", vec_col="embedding", exclude_self=True)
    return top.select(F.col("qid").alias("query_id"), F.col("bid").alias("base_id"), "rank",
                      r6("sim").alias("similarity"))


# ------------------------------------------------------------------------------------------------ answers & labels
@register
def q_normalize_answer(spark, sf_dir):
    from ..functions.labels import normalize_answer
    conv = fixtures.table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return conv.select("conv_id", "turn", normalize_answer(F.col("text")).alias("answer"))


@register
def q_extract_label(spark, sf_dir):
    from ..functions.labels import extract_label, normalize_answer
    conv = fixtures.table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return conv.select("conv_id", "turn", extract_label(normalize_answer(F.col("text"))).alias("label"))


# ------------------------------------------------------------------------------------------------ prompts & scoring
def _topk_run(spark, sf_dir, shots, temperatures=(0.0,), sizes=("8b",)):
    from ..operators import retrieval
    from . import sweeps
    r = _retrieval(spark, sf_dir)
    top = retrieval.topk_similar(r, max(shots))
    r.release()
    req = sweeps.topk_requests(r, top, list(shots), list(temperatures), list(sizes))
    return r, req


def graph_corpus(spark, sf_dir, ev: DataFrame | None = None) -> DataFrame:
    """Propagation feature rows as a labelled corpus: doc_id = graph index, split by graph index."""
    f = graph_features(spark, sf_dir, ev)
    # read by the fit, both transforms, the exemplar and the test side: computed once (graphs + power iteration)
    # and stored (compressed), which also cuts the lineage the retrieval plans would otherwise re-analyse
    return routed.staged(f.select(F.col("graph_idx").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                    "label", F.when(F.col("graph_idx") % 5 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
                    "avg_degree_centrality", "eigenvector_centrality", "median_retweet_time"
                    ), "graph-corpus")


@register
def q_prompts_topk(spark, sf_dir):
    _, req = _topk_run(spark, sf_dir, [BALANCED_K])
    return req.select("doc_id", "num_shots", "system_prompt", "user_prompt")


@register
def q_prompts_balanced(spark, sf_dir):
    from . import sweeps
    req, _ = sweeps.balanced_requests(graph_corpus(spark, sf_dir), BALANCED_K)
    return req.select("doc_id", "num_shots", "system_prompt", "user_prompt")


@register
def q_prompts_fixed(spark, sf_dir):
    from . import sweeps
    req, _ = sweeps.fixed_requests(graph_corpus(spark, sf_dir))
    return req.select("doc_id", "num_shots", "system_prompt", "user_prompt")


def scored_topk(spark, sf_dir):
    from . import scoring
    r, req = _topk_run(spark, sf_dir, [BALANCED_K])
    preds = scoring.score(req, scoring.vote_stub, ["doc_id", "strategy", "model", "num_shots", "temperature",
                                                   "replicate"])
    return r, preds


@register
def q_scored(spark, sf_dir):
    _, preds = scored_topk(spark, sf_dir)
    return preds.select("doc_id", "strategy", "model", "num_shots", "raw_answer", "prediction")


@register
def q_scored_balanced(spark, sf_dir):
    from . import scoring, sweeps
    req, _ = sweeps.balanced_requests(graph_corpus(spark, sf_dir), BALANCED_K)
    preds = scoring.score(req, scoring.vote_stub, ["doc_id", *sweeps.RUN_COLS])
    return preds.select("doc_id", "strategy", "model", "num_shots", "raw_answer", "prediction")


@register
def q_scored_fixed(spark, sf_dir):
    from . import scoring, sweeps
    req, _ = sweeps.fixed_requests(graph_corpus(spark, sf_dir))
    preds = scoring.score(req, scoring.vote_stub, ["doc_id", *sweeps.RUN_COLS])
    return preds.select("doc_id", "strategy", "model", "num_shots", "raw_answer", "prediction")


@register
def q_model_routing(spark, sf_dir):
    from . import sweeps
    test = fixtures.corpus(spark, sf_dir).filter(F.col("split") == "test").select("doc_id")
    g = sweeps.grid(test, [0.0], sweeps.MODEL_SIZE_GRID)
    return g.select("doc_id", "model_size", "model")


@register
def q_sweep_plan(spark, sf_dir):
    from . import sweeps
    test = fixtures.corpus(spark, sf_dir).filter(F.col("split") == "test").select("doc_id")
    g = sweeps.grid(test.withColumn("num_shots", F.lit(BALANCED_K)), sweeps.TEMPERATURE_GRID, ["8b"])
    return g.select("doc_id", "num_shots", "temperature", "model")


# ------------------------------------------------------------------------------------------------ evaluation
def _truth(spark, sf_dir):
    return fixtures.corpus(spark, sf_dir).filter(F.col("split") == "test").select("doc_id", "label")


def _preds(spark, sf_dir):
    _, p = scored_topk(spark, sf_dir)
    return p.select("doc_id", "prediction")


@register
def q_binarize_strict(spark, sf_dir):
    from ..operators import evaluation
    pairs = evaluation.eval_pairs_inner(_preds(spark, sf_dir), _truth(spark, sf_dir), "doc_id")
    return evaluation.binarized(pairs, "strict").select("doc_id", "label", "prediction", "y_true", "y_pred")


@register
def q_binarize_lenient(spark, sf_dir):
    from ..operators import evaluation
    pairs = evaluation.eval_common(_preds(spark, sf_dir), _truth(spark, sf_dir), "doc_id")
    return evaluation.binarized(pairs, "lenient").select("doc_id", "label", "prediction", "y_true", "y_pred")


@register
def q_eval_pairs_strict(spark, sf_dir):
    from ..operators import evaluation
    return evaluation.eval_pairs_strict(_preds(spark, sf_dir), _truth(spark, sf_dir), "doc_id").select(
        "doc_id", "label", "prediction")


@register
def q_eval_pairs_inner(spark, sf_dir):
    from ..operators import evaluation
    return evaluation.eval_pairs_inner(_preds(spark, sf_dir), _truth(spark, sf_dir), "doc_id").select(
        "doc_id", "label", "prediction")


@register
def q_eval_common(spark, sf_dir):
    from ..operators import evaluation
    return evaluation.eval_common(_preds(spark, sf_dir), _truth(spark, sf_dir), "doc_id").select(
        "doc_id", "label", "prediction")


METRIC_OUT = ["accuracy", "precision", "recall", "tpr", "f1", "roc_auc", "fpr"]


def _metric_select(m: DataFrame, group_cols: list[str]) -> DataFrame:
    return m.select(*group_cols, "n", "tn", "fp", "fn", "tp", "unparsed", *[r6(c).alias(c) for c in METRIC_OUT])


@register
def q_confusion(spark, sf_dir):
    from ..operators import evaluation
    pairs = evaluation.eval_pairs_inner(_preds(spark, sf_dir), _truth(spark, sf_dir), "doc_id")
    return evaluation.confusion(evaluation.binarized(pairs, "strict")).select("n", "tn", "fp", "fn", "tp")


@register
def q_metrics(spark, sf_dir):
    from ..operators import evaluation
    pairs = evaluation.eval_pairs_strict(_preds(spark, sf_dir), _truth(spark, sf_dir), "doc_id")
    return _metric_select(evaluation.metrics(pairs, [], "strict"), [])


@register
def q_metrics_strict(spark, sf_dir):
    from . import sweeps
    req, truth = sweeps.balanced_requests(graph_corpus(spark, sf_dir), BALANCED_K)
    _, m = sweeps.score_and_evaluate(req, truth)
    return _metric_select(m, ["strategy", "num_shots"])


@register
def q_metrics_lenient(spark, sf_dir):
    from ..operators import evaluation
    pairs = evaluation.eval_common(_preds(spark, sf_dir), _truth(spark, sf_dir), "doc_id")
    return _metric_select(evaluation.metrics(pairs, [], "lenient"), [])


@register
def q_metrics_report(spark, sf_dir):
    from ..operators import evaluation
    pairs = evaluation.eval_pairs_strict(_preds(spark, sf_dir), _truth(spark, sf_dir), "doc_id")
    return evaluation.metrics_report(evaluation.metrics(pairs, [], "strict"))


def _sweep_metrics(spark, sf_dir, shots, temps, sizes, group, client=None):
    from . import scoring, sweeps
    _, req = _topk_run(spark, sf_dir, shots, temps, sizes)
    _, m = sweeps.score_and_evaluate(req, _truth(spark, sf_dir), client or scoring.vote_stub)
    return _metric_select(m, group)


@register
def q_metrics_by_num_shots(spark, sf_dir):
    from . import sweeps
    return _sweep_metrics(spark, sf_dir, sweeps.SHOTS_GRID, [0.0], ["8b"], ["num_shots"])


@register
def q_metrics_by_temperature(spark, sf_dir):
    from . import scoring, sweeps
    return _sweep_metrics(spark, sf_dir, [BALANCED_K], sweeps.TEMPERATURE_GRID, ["8b"], ["temperature"],
                          scoring.leaning_stub)


@register
def q_metrics_by_model(spark, sf_dir):
    from . import scoring, sweeps
    return _sweep_metrics(spark, sf_dir, [BALANCED_K], [0.0], sweeps.MODEL_SIZE_GRID, ["model"],
                          scoring.leaning_stub)


# ------------------------------------------------------------------------------------------------ sources & stores
def _records_path(spark, sf_dir, test_only=False, files=None, ev=None):
    from ..session import scratch_path
    from ..sources import propagation_json
    ev = ev if ev is not None else fixtures.graph_events(spark, sf_dir, labelled=True)
    rec = fixtures.propagation_records(spark, sf_dir, ev, "chain")
    if test_only:
        rec = rec.join(ev.filter("pos = 0").select("propagation_id", "graph_idx"), "propagation_id").filter(
            F.col("graph_idx") % 5 == 0).drop("graph_idx")
    path = scratch_path(spark, "records")
    propagation_json.write_lines(rec.repartition(files) if files else rec, path)
    return path


def _records(spark, sf_dir):
    from ..sources import propagation_json
    return propagation_json.read(spark, _records_path(spark, sf_dir), layout="lines")


@register
def q_propagation_scan(spark, sf_dir):
    rec = _records(spark, sf_dir)
    return rec.select("propagation_id", "label", F.size("nodes").cast("long").alias("n_nodes"),
                      F.size("edges").cast("long").alias("n_edges"))


@register
def q_record_folder_scan(spark, sf_dir):
    """One file a record: every record is written as the file its key names and read back from the folder."""
    from ..session import scratch_path
    from ..sources import propagation_json, record_folder
    path = scratch_path(spark, "record-folder")
    rec = fixtures.propagation_records(spark, sf_dir, fixtures.graph_events(spark, sf_dir, labelled=True), "chain")
    record_folder.write(rec, path)
    back = propagation_json.read(spark, path, layout="folder")
    return back.select("propagation_id", "label", F.col("nodes")[0]["tweet_text"].alias("text"),
                       F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"))


@register
def q_corpus_scan(spark, sf_dir):
    from ..sources import propagation_json
    return propagation_json.corpus_scan(spark, _records_path(spark, sf_dir), layout="lines")


@register
def q_true_labels(spark, sf_dir):
    from ..sources import propagation_json
    return propagation_json.true_labels(spark, _records_path(spark, sf_dir), layout="lines")


@register
def q_root_text(spark, sf_dir):
    rec = _records(spark, sf_dir)
    return rec.select("propagation_id", graph.root_text(rec).alias("text"))


@register
def q_retweet_delays(spark, sf_dir):
    rec = _records(spark, sf_dir)
    d = rec.select("propagation_id", F.posexplode(graph.retweet_delays(F.col("nodes"))).alias("pos", "delay"))
    return d.select("propagation_id", (F.col("pos") + 1).cast("long").alias("pos"), r6("delay").alias("delay"))


@register
def q_record_features(spark, sf_dir):
    return _feature_select(features.record_features(_records(spark, sf_dir)))


def _feature_select(f):
    return f.select(
        "propagation_id", "text", "label",
        r6("avg_degree_centrality").alias("avg_degree_centrality"),
        r6("eigenvector_centrality").alias("eigenvector_centrality"),
        r6("median_retweet_time").alias("median_retweet_time"),
        "graph_status",
    )


def _exported_predictions(spark, sf_dir):
    from ..session import scratch_path
    from . import scoring
    path = scratch_path(spark, "predictions-json")
    scoring.export_json_map(_preds(spark, sf_dir), path, "doc_id")
    return scoring.import_json_map(spark, path, "item_id", lines=True)


@register
def q_predictions_scan(spark, sf_dir):
    return _exported_predictions(spark, sf_dir)


@register
def q_predicted_labels(spark, sf_dir):
    from ..functions.labels import extract_label
    p = _exported_predictions(spark, sf_dir)
    return p.select("item_id", extract_label(F.col("prediction")).alias("label"))


@register
def q_predictions_dedup(spark, sf_dir):
    """Two appends of the same batch (an at-least-once replay) read back as one answer per key, latest batch."""
    from ..session import scratch_path
    from . import scoring, sweeps
    _, req = _topk_run(spark, sf_dir, [BALANCED_K])
    key = ["doc_id", *sweeps.RUN_COLS]
    store = scratch_path(spark, "store")
    scored = scoring.score(req, scoring.vote_stub, key).checkpoint(eager=True)
    for batch in (0, 1):
        scoring.append_store(scored.withColumn("batch_id", F.lit(batch).cast("long")), store)
    latest = scoring.latest(spark.read.parquet(store), key)
    return latest.select("doc_id", "strategy", "model", "num_shots", "prediction", "batch_id")


@register
def q_pending(spark, sf_dir):
    """Resume: a shots sweep whose cells k <= 4 are already answered leaves exactly the cells k = 5..8."""
    from ..session import scratch_path
    from . import scoring, sweeps
    _, req = _topk_run(spark, sf_dir, sweeps.SHOTS_GRID)
    key = ["doc_id", *sweeps.RUN_COLS]
    store = scratch_path(spark, "store")
    scoring.run_resumable(req.filter(F.col("num_shots") <= 4), store, scoring.vote_stub, key, batch_id=0)
    todo = scoring.pending(req, scoring.read_store(spark, store), key)
    return todo.select("doc_id", "num_shots")


def _split_folders(spark, sf_dir):
    """The labelled records as a train and a test folder of JSON lines."""
    from ..session import scratch_path
    from ..sources import propagation_json
    ev = fixtures.graph_events(spark, sf_dir, labelled=True)
    number = ev.filter("pos = 0").select("propagation_id", (F.col("graph_idx") % 5 == 0).alias("test"))
    rec = fixtures.propagation_records(spark, sf_dir, ev, "chain").join(number, "propagation_id")
    out = {}
    for name, mine in (("train", ~F.col("test")), ("test", F.col("test"))):
        out[name] = scratch_path(spark, name)
        propagation_json.write_lines(rec.where(mine).drop("test"), out[name])
    return out["train"], out["test"]


@register
def q_run_sweep(spark, sf_dir):
    """A whole run over record folders, from the scan to the metrics file, which is read back."""
    from ..session import scratch_path
    from . import pipeline, scoring
    train, test = _split_folders(spark, sf_dir)
    out = scratch_path(spark, "metrics")
    m = pipeline.run_shots_sweep(spark, train, test, scratch_path(spark, "run-store"), scoring.vote_stub, shots=(2, BALANCED_K),
                                 layout="lines", metrics_out=out)
    return _metric_select(spark.read.schema(m.schema).json(out), ["num_shots"])


@register
def q_offline_evaluation(spark, sf_dir):
    """Result files against the true labels of a record folder, by common keys and with lenient labels."""
    from ..session import scratch_path
    from . import pipeline, scoring
    test, out = _records_path(spark, sf_dir, test_only=True), scratch_path(spark, "results")
    name = F.concat(F.lit("prop_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".json"))
    scoring.export_json_map(_preds(spark, sf_dir).withColumn("propagation_id", name), out, "propagation_id")
    return _metric_select(pipeline.offline_evaluation(spark, test, out, layout="lines"), [])


@register
def q_feature_cache(spark, sf_dir):
    """Feature rows that a second run loads from the cache instead of building them."""
    from ..sources import feature_cache, propagation_json
    path = _records_path(spark, sf_dir)
    key = {"records": path, "files": feature_cache.inventory(spark, path)}
    feature_cache.load_or_build(spark, key, lambda: features.record_features(propagation_json.read(spark, path, "lines")))

    def again():
        raise AssertionError("the cache was not used")

    return _feature_select(feature_cache.load_or_build(spark, key, again))


@register
def q_incremental_score(spark, sf_dir):
    from ..session import scratch_path
    from ..streaming.incremental import incremental_score
    ev = fixtures.graph_events(spark, sf_dir, labelled=True)                          # numbered once, read by both
    input_dir = _records_path(spark, sf_dir, test_only=True, files=2, ev=ev)  # two file drops -> two micro-batches
    train = graph_corpus(spark, sf_dir, ev).filter(F.col("split") == "train")
    out = incremental_score(spark, input_dir, scratch_path(spark, "stream-store"),
                            scratch_path(spark, "stream-ckpt"), train, k=BALANCED_K, max_files_per_trigger=1)
    return out.select("propagation_id", "strategy", "model", "num_shots", "prediction")


@register
def q_star_propagation_features(spark, sf_dir):
    """Feature rows when each graph is a star (first user linked to every later user) instead of a chain."""
    ev = fixtures.graph_events(spark, sf_dir, labelled=True)
    props = fixtures.propagations(spark, sf_dir, ev)
    f = features.propagation_features(props, fixtures.graph_edges(ev, "star"), fixtures.graph_delays(ev))
    return f.select(
        "propagation_id", "label",
        r6("avg_degree_centrality").alias("avg_degree_centrality"),
        r6("eigenvector_centrality").alias("eigenvector_centrality"),
        r6("median_retweet_time").alias("median_retweet_time"),
        "graph_status",
    )
