"""DuckDB twins of the registered queries (the driver runs them on the same parquet tables).

Every float is rounded to 6 decimals, every count is BIGINT and every column is aliased exactly as in Spark.
"""

from __future__ import annotations

from ..functions.text import WHITESPACE, sql_str_literal

# ---------------------------------------------------------------- graph fixtures (events -> one graph per document)
GRAPH_CTES = """
ev AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS uid, epoch_us(ts) AS micros,
         event_id % (SELECT greatest(count(*), 1) FROM documents) AS graph_idx
  FROM events),
pe AS (
  SELECT 'prop_' || lpad(CAST(graph_idx AS VARCHAR), 12, '0') || '.json' AS propagation_id, graph_idx, event_id, ts, uid,
         row_number() OVER (PARTITION BY graph_idx ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY graph_idx) AS n_events,
         (micros - min(micros) OVER (PARTITION BY graph_idx)) / 1e6 AS delay
  FROM ev),
raw_edges AS (
  SELECT c.propagation_id, p.uid AS source, c.uid AS target
  FROM pe c JOIN pe p ON p.propagation_id = c.propagation_id AND p.pos = c.pos - 1),
edges AS (SELECT DISTINCT propagation_id, least(source, target) AS a, greatest(source, target) AS b FROM raw_edges),
verts AS (SELECT propagation_id, a AS vertex FROM edges UNION SELECT propagation_id, b FROM edges),
nv AS (SELECT propagation_id, count(*) AS n FROM verts GROUP BY propagation_id),
props AS (
  SELECT g.propagation_id, g.graph_idx, d.text, CASE WHEN l.toxic = 1 THEN 'fake' ELSE 'real' END AS label
  FROM (SELECT propagation_id, graph_idx FROM pe WHERE pos = 0) g
  JOIN documents d ON d.doc_id = g.graph_idx
  JOIN labels l ON l.doc_id = g.graph_idx)
"""

EIGEN_CTES = """
adj AS (
  SELECT propagation_id, a AS src, b AS dst FROM edges
  UNION ALL SELECT propagation_id, b, a FROM edges WHERE a <> b
  UNION ALL SELECT propagation_id, vertex, vertex FROM verts),
it(step, propagation_id, vertex, x, old, delta, n) AS (
  SELECT 0, v.propagation_id, v.vertex, 1.0 / nv.n, NULL::DOUBLE, 1e300, nv.n
  FROM verts v JOIN nv USING (propagation_id)
  UNION ALL
  SELECT step, propagation_id, vertex, xn, old, sum(abs(xn - old)) OVER (PARTITION BY propagation_id), n FROM (
    SELECT step, propagation_id, vertex, old, n,
           y / coalesce(nullif(sqrt(sum(y * y) OVER (PARTITION BY propagation_id)), 0), 1) AS xn
    FROM (
      SELECT it.step + 1 AS step, it.propagation_id, adj.dst AS vertex, sum(it.x) AS y,
             max(CASE WHEN adj.dst = adj.src THEN it.x END) AS old, max(it.n) AS n
      FROM it JOIN adj ON adj.propagation_id = it.propagation_id AND adj.src = it.vertex
      WHERE it.delta >= it.n * 1e-6 AND it.step < 1000
      GROUP BY it.step, it.propagation_id, adj.dst))),
eig AS (
  SELECT propagation_id, vertex, CASE WHEN delta < n * 1e-6 THEN x END AS eigenvector_centrality, step AS iterations,
         delta < n * 1e-6 AS converged
  FROM it WHERE step > 0 AND (delta < n * 1e-6 OR step = 1000))
"""


def with_graph(body: str, eigen: bool = False) -> str:
    ctes = GRAPH_CTES + ("," + EIGEN_CTES if eigen else "")
    return "WITH RECURSIVE " + ctes + body if eigen else "WITH " + ctes + body


ORACLE: dict[str, str] = {}

ORACLE["q_undirected_edges"] = with_graph("SELECT propagation_id, a, b FROM edges")

ORACLE["q_graph_vertices"] = with_graph("SELECT propagation_id, vertex FROM verts")

ORACLE["q_degree_centrality"] = with_graph("""
, deg AS (
  SELECT propagation_id, vertex, count(*) AS degree FROM (
    SELECT propagation_id, a AS vertex FROM edges UNION ALL SELECT propagation_id, b FROM edges)
  GROUP BY propagation_id, vertex)
SELECT deg.propagation_id, vertex, CAST(degree AS BIGINT) AS degree,
       round(CASE WHEN n = 1 THEN 1.0 ELSE degree / (n - 1.0) END, 6) AS degree_centrality
FROM deg JOIN nv USING (propagation_id)""")

AVG_DEGREE_SQL = """
, m AS (SELECT propagation_id, count(*) AS n_edges FROM edges GROUP BY propagation_id),
deg AS (
  SELECT propagation_id, CAST(n AS BIGINT) AS n_vertices, CAST(n_edges AS BIGINT) AS n_edges,
         CASE WHEN n = 1 THEN 1.0 ELSE 2.0 * n_edges / (n * (n - 1.0)) END AS avg_degree_centrality
  FROM nv JOIN m USING (propagation_id))
"""

ORACLE["q_avg_degree_centrality"] = with_graph(AVG_DEGREE_SQL + """
SELECT propagation_id, n_vertices, n_edges, round(avg_degree_centrality, 6) AS avg_degree_centrality FROM deg""")

ORACLE["q_eigenvector_centrality"] = with_graph("""
SELECT propagation_id, vertex, round(eigenvector_centrality, 6) AS eigenvector_centrality,
       CAST(iterations AS INTEGER) AS iterations, converged FROM eig""", eigen=True)

ORACLE["q_avg_eigenvector_centrality"] = with_graph("""
SELECT propagation_id, round(avg(eigenvector_centrality), 6) AS eigenvector_centrality,
       CAST(max(iterations) AS INTEGER) AS eig_iterations, bool_and(converged) AS eig_converged
FROM eig GROUP BY propagation_id""", eigen=True)

MEDIAN_SQL = """
, med AS (SELECT propagation_id, median(delay) AS median_retweet_time FROM pe WHERE pos >= 1 GROUP BY propagation_id)
"""

ORACLE["q_median_delay"] = with_graph(MEDIAN_SQL + """
SELECT p.propagation_id, round(coalesce(med.median_retweet_time, 0), 6) AS median_retweet_time
FROM (SELECT propagation_id FROM pe WHERE pos = 0) p LEFT JOIN med USING (propagation_id)""")

FEATURES_SQL = AVG_DEGREE_SQL + MEDIAN_SQL + """
, eigs AS (SELECT propagation_id, avg(eigenvector_centrality) AS eigenvector_centrality FROM eig GROUP BY propagation_id),
features AS (
  SELECT p.propagation_id, p.graph_idx, p.text, p.label, deg.avg_degree_centrality, eigs.eigenvector_centrality,
         coalesce(med.median_retweet_time, 0) AS median_retweet_time,
         CASE WHEN deg.n_vertices IS NULL THEN 'empty' WHEN eigs.eigenvector_centrality IS NULL THEN 'not_converged'
              ELSE 'ok' END AS graph_status
  FROM props p LEFT JOIN deg USING (propagation_id) LEFT JOIN eigs USING (propagation_id)
  LEFT JOIN med USING (propagation_id))
"""

ORACLE["q_propagation_features"] = with_graph(FEATURES_SQL + """
SELECT propagation_id, text, label, round(avg_degree_centrality, 6) AS avg_degree_centrality,
       round(eigenvector_centrality, 6) AS eigenvector_centrality,
       round(median_retweet_time, 6) AS median_retweet_time, graph_status
FROM features""", eigen=True)


# ---------------------------------------------------------------- text corpus, TF-IDF, retrieval
CORPUS_CTE = """
corpus AS (
  SELECT d.doc_id, coalesce(d.text, '') AS text, CASE WHEN l.toxic = 1 THEN 'fake' ELSE 'real' END AS label,
         CASE WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM documents d JOIN labels l USING (doc_id)),"""

TEXT_CTES = r"""
toks AS (SELECT doc_id, split, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM corpus),
tc AS (SELECT doc_id, split, term, count(*) AS tf FROM toks GROUP BY doc_id, split, term),
idf AS (
  SELECT term, count(*) AS df,
         ln((1.0 + (SELECT count(*) FROM corpus WHERE split = 'train')) / (1.0 + count(*))) + 1 AS idf
  FROM tc WHERE split = 'train' GROUP BY term),
w0 AS (SELECT tc.doc_id, tc.split, tc.term, tf * idf AS w FROM tc JOIN idf USING (term)),
vec AS (SELECT doc_id, split, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w0),
dots AS (
  SELECT a.doc_id AS qid, b.doc_id AS bid, sum(a.weight * b.weight) AS sim
  FROM vec a JOIN vec b USING (term) WHERE b.split = 'train' GROUP BY a.doc_id, b.doc_id),
test_train AS (
  SELECT t.doc_id AS test_id, r.doc_id AS train_id, coalesce(d.sim, 0) AS sim
  FROM corpus t JOIN corpus r ON t.split = 'test' AND r.split = 'train'
  LEFT JOIN dots d ON d.qid = t.doc_id AND d.bid = r.doc_id),
topk AS (
  SELECT test_id, train_id, sim,
         row_number() OVER (PARTITION BY test_id ORDER BY round(sim, 9) DESC, train_id) AS rank
  FROM test_train),
partner AS (
  SELECT train_id, partner_id, sim FROM (
    SELECT a.doc_id AS train_id, b.doc_id AS partner_id, coalesce(d.sim, 0) AS sim,
           row_number() OVER (PARTITION BY a.doc_id ORDER BY round(coalesce(d.sim, 0), 9) DESC, b.doc_id) AS rn
    FROM corpus a JOIN corpus b ON a.split = 'train' AND b.split = 'train' AND a.label <> b.label
    LEFT JOIN dots d ON d.qid = a.doc_id AND d.bid = b.doc_id)
  WHERE rn = 1),
balanced AS (
  SELECT test_id, rank AS slot, 'Similar' AS kind, train_id, train_id AS anchor_id, sim FROM topk WHERE rank <= 3
  UNION ALL
  SELECT t.test_id, t.rank + 3, 'Contrastive', p.partner_id, t.train_id, p.sim
  FROM topk t JOIN partner p USING (train_id) WHERE t.rank <= 3)
"""


def with_text(body: str, corpus: str = CORPUS_CTE, prefix: str = "WITH ") -> str:
    return prefix + corpus + TEXT_CTES + body


ORACLE["q_tokens"] = """
WITH tl AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM documents)
SELECT doc_id, CAST(unnest(generate_series(1, len(t))) AS BIGINT) AS pos, unnest(t) AS token FROM tl WHERE len(t) > 0"""

ORACLE["q_term_counts"] = r"""
WITH tl AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents)
SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM tl GROUP BY doc_id, term"""

ORACLE["q_idf"] = with_text("SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf")

ORACLE["q_tfidf_vectors"] = with_text("SELECT doc_id, term, round(weight, 6) AS weight FROM vec")

ORACLE["q_cosine_pairs"] = with_text("""
SELECT test_id, train_id, round(sim, 6) AS similarity FROM test_train WHERE round(sim, 9) >= 0.5""")

ORACLE["q_topk_similar"] = with_text("""
SELECT test_id, train_id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similarity FROM topk WHERE rank <= 8""")

ORACLE["q_nearest_opposite"] = with_text("SELECT train_id, partner_id, round(sim, 6) AS similarity FROM partner")

ORACLE["q_balanced_retrieval"] = with_text("""
SELECT b.test_id, CAST(b.slot AS INTEGER) AS slot, b.kind, b.train_id, b.anchor_id, c.label, round(b.sim, 6) AS similarity
FROM balanced b JOIN corpus c ON c.doc_id = b.train_id""")

ORACLE["q_balanced_random_exemplars"] = with_text("""
SELECT label, CAST(pick AS INTEGER) AS pick, doc_id FROM (
  SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY md5('exemplars' || CAST(doc_id AS VARCHAR)), doc_id) AS pick
  FROM corpus WHERE split = 'train') WHERE pick <= 3""")

ORACLE["q_dense_topk"] = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS nrm FROM e),
pairs AS (
  SELECT q.vec_id AS query_id, b.vec_id AS base_id,
         coalesce(list_dot_product(q.v, b.v) / nullif(q.nrm * b.nrm, 0), 0) AS sim
  FROM u q JOIN u b ON q.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, base_id) AS rank FROM pairs)
SELECT query_id, base_id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similarity FROM r WHERE rank <= 5"""


# ---------------------------------------------------------------- answers
WS = sql_str_literal(WHITESPACE)
NORM = f"lower(trim(text, {WS}))"
ORACLE["q_normalize_answer"] = f"""
SELECT conv_id, turn, {NORM} AS answer FROM conversations WHERE role = 'assistant'"""


def sql_extract_label(x: str) -> str:
    return (f"(CASE WHEN contains(lower({x}), 'fake') OR lower({x}) = 'yes' THEN 'fake' "
            f"WHEN contains(lower({x}), 'real') OR lower({x}) = 'no' THEN 'real' ELSE lower({x}) END)")


ORACLE["q_extract_label"] = f"""
SELECT conv_id, turn, {sql_extract_label(NORM)} AS label FROM conversations WHERE role = 'assistant'"""


# ---------------------------------------------------------------- prompts (string-equal to the Spark assembly)
def _prompt_sql():
    from . import prompts as P
    nl, sep = "chr(10)", "(chr(10) || chr(10))"
    lit = sql_str_literal

    def cap(x):
        return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"

    def num(x):
        return f"coalesce(format('{{:.2f}}', {x}), {lit(P.MISSING)})"

    def metric_lines(prefix):
        return (f"'Mean degree centrality: ' || {num(prefix + 'avg_degree_centrality')} || {nl} || "
                f"'Eigenvector centrality: ' || {num(prefix + 'eigenvector_centrality')} || {nl} || "
                f"'Median repost delay: ' || {num(prefix + 'median_retweet_time')} || ' seconds'")

    def block(with_metrics, with_kind):
        head = "'Example ' || CAST(slot AS VARCHAR) || " + ("' (' || kind || ')' || " if with_kind else "") + "':'"
        body = f"{head} || {nl} || 'Post: \"' || coalesce(ex_text, '') || '\"' || {nl} || "
        if with_metrics:
            body += f"{metric_lines('ex_')} || {nl} || "
        return body + f"'Label: ' || {cap('ex_label')}"

    def system(t, with_metrics, with_kind):
        return (f"{lit(t.intro)} || {sep} || {lit(t.header)} || {sep} || "
                f"string_agg({block(with_metrics, with_kind)}, {sep} ORDER BY slot) || {sep} || {lit(t.closing)}")

    def user(t, with_metrics, prefix="t."):
        s = f"'Post: ' || coalesce({prefix}text, '')"
        if with_metrics:
            s += f" || {nl} || " + metric_lines(prefix)
        return s + f" || {sep} || {lit(t.answer)}"

    return P, system, user


_P, _system, _user = _prompt_sql()

GRAPH_CORPUS_CTE = """
corpus AS (
  SELECT graph_idx AS doc_id, coalesce(text, '') AS text, label,
         CASE WHEN graph_idx % 5 = 0 THEN 'test' ELSE 'train' END AS split,
         avg_degree_centrality, eigenvector_centrality, median_retweet_time
  FROM features),"""


def with_graph_text(body: str) -> str:
    return ("WITH RECURSIVE " + GRAPH_CTES + "," + EIGEN_CTES + FEATURES_SQL + "," + GRAPH_CORPUS_CTE
            + TEXT_CTES + body)


TOPK_EX = """
, ex AS (
  SELECT t.test_id AS doc_id, t.rank AS slot, c.text AS ex_text, c.label AS ex_label, t.sim AS ex_similarity
  FROM topk t JOIN corpus c ON c.doc_id = t.train_id WHERE t.rank <= 3)"""

ORACLE["q_prompts_topk"] = with_text(TOPK_EX + f"""
, sys AS (SELECT doc_id, {_system(_P.TEXT_ONLY, False, False)} AS system_prompt FROM ex GROUP BY doc_id)
SELECT t.doc_id, 3 AS num_shots, s.system_prompt, {_user(_P.TEXT_ONLY, False)} AS user_prompt
FROM corpus t JOIN sys s USING (doc_id) WHERE t.split = 'test'""")

BAL_EX = """
, ex AS (
  SELECT b.test_id AS doc_id, b.slot, b.kind, c.text AS ex_text, c.label AS ex_label,
         c.avg_degree_centrality AS ex_avg_degree_centrality, c.eigenvector_centrality AS ex_eigenvector_centrality,
         c.median_retweet_time AS ex_median_retweet_time, b.sim AS ex_similarity
  FROM balanced b JOIN corpus c ON c.doc_id = b.train_id)"""

ORACLE["q_prompts_balanced"] = with_graph_text(BAL_EX + f"""
, sys AS (SELECT doc_id, {_system(_P.WITH_GRAPH, True, True)} AS system_prompt FROM ex GROUP BY doc_id)
SELECT t.doc_id, 3 AS num_shots, s.system_prompt, {_user(_P.WITH_GRAPH, True)} AS user_prompt
FROM corpus t JOIN sys s USING (doc_id) WHERE t.split = 'test'""")

FIXED_EX = """
, picks AS (
  SELECT label, doc_id,
         row_number() OVER (PARTITION BY label ORDER BY md5('exemplars' || CAST(doc_id AS VARCHAR)), doc_id) AS pick
  FROM corpus WHERE split = 'train'),
ex AS (
  SELECT row_number() OVER (ORDER BY p.label = 'fake' DESC, p.label, p.pick) AS slot, c.text AS ex_text, c.label AS ex_label,
         c.avg_degree_centrality AS ex_avg_degree_centrality, c.eigenvector_centrality AS ex_eigenvector_centrality,
         c.median_retweet_time AS ex_median_retweet_time
  FROM picks p JOIN corpus c USING (doc_id) WHERE p.pick <= 3)"""

ORACLE["q_prompts_fixed"] = with_graph_text(FIXED_EX + f"""
, sys AS (SELECT {_system(_P.WITH_GRAPH, True, False)} AS system_prompt FROM ex)
SELECT t.doc_id, CAST((SELECT count(*) FROM ex) AS INTEGER) AS num_shots, sys.system_prompt, {_user(_P.WITH_GRAPH, True)} AS user_prompt
FROM corpus t JOIN sys ON TRUE WHERE t.split = 'test'""")


# ---------------------------------------------------------------- offline stub scoring (similarity-weighted vote)
def vote_sql(src: str, keys: str) -> str:
    return f"""
, votes AS (
  SELECT {keys}, sum(CASE WHEN lower(ex_label) = 'fake' THEN ex_similarity ELSE 0 END) AS fv,
         sum(CASE WHEN lower(ex_label) = 'real' THEN ex_similarity ELSE 0 END) AS rv
  FROM {src} GROUP BY {keys}),
preds AS (
  SELECT {keys}, CASE WHEN round(coalesce(fv, 0), 9) > round(coalesce(rv, 0), 9) THEN 'Fake' ELSE 'Real' END || chr(10)
         AS raw_answer FROM votes)"""


ORACLE["q_scored"] = with_text(TOPK_EX + vote_sql("ex", "doc_id") + """
SELECT doc_id, 'topk' AS strategy, 'llama3.1:latest' AS model, 3 AS num_shots, raw_answer,
       lower(trim(raw_answer, chr(10))) AS prediction FROM preds""")

ORACLE["q_scored_balanced"] = with_graph_text(BAL_EX + vote_sql("ex", "doc_id") + """
SELECT doc_id, 'balanced' AS strategy, 'llama3.1:70b' AS model, 3 AS num_shots, raw_answer,
       lower(trim(raw_answer, chr(10))) AS prediction FROM preds""")

ORACLE["q_scored_fixed"] = with_graph_text(FIXED_EX + """
SELECT doc_id, 'fixed' AS strategy, 'llama3.1:70b' AS model, CAST((SELECT count(*) FROM ex) AS INTEGER) AS num_shots, 'Real' || chr(10) AS raw_answer,
       'real' AS prediction FROM corpus WHERE split = 'test'""")

ORACLE["q_model_routing"] = with_text("""
SELECT c.doc_id, m.model_size, m.model FROM corpus c
JOIN (VALUES ('1b', 'llama3.2:1b'), ('3b', 'llama3.2:latest'), ('27b', 'gemma2:27b')) m(model_size, model) ON TRUE
WHERE c.split = 'test'""")

ORACLE["q_sweep_plan"] = with_text("""
SELECT c.doc_id, 3 AS num_shots, CAST(t.temperature AS DOUBLE) AS temperature, 'llama3.1:latest' AS model FROM corpus c
JOIN (VALUES (0.0), (0.2), (0.4), (0.6), (0.8), (1.0)) t(temperature) ON TRUE WHERE c.split = 'test'""")


# ---------------------------------------------------------------- evaluation
TOPK_PREDS = TOPK_EX + vote_sql("ex", "doc_id") + """
, pairs AS (
  SELECT t.doc_id, t.label, lower(trim(p.raw_answer, chr(10))) AS prediction
  FROM corpus t JOIN preds p USING (doc_id) WHERE t.split = 'test')"""


def metrics_sql(pairs: str, group: list[str], lenient: bool = False) -> str:
    g = ", ".join(group)
    gsel = (g + ", ") if g else ""
    gby = f" GROUP BY {g}" if g else ""
    if lenient:
        pred = sql_extract_label("prediction")
        yt, yp = "(label IN ('fake', 'yes'))", f"({pred} IN ('fake', 'yes'))"
        parsed = f"coalesce({pred} IN ('fake', 'real'), false)"
    else:
        yt, yp = "(label = 'fake')", "(prediction = 'fake')"
        parsed = "coalesce(prediction IN ('fake', 'real'), false)"
    yt, yp = f"coalesce({yt}, false)", f"coalesce({yp}, false)"
    return f"""
, cm AS (
  SELECT {gsel}count(*) AS n, count_if(NOT {yt} AND NOT {yp}) AS tn, count_if(NOT {yt} AND {yp}) AS fp,
         count_if({yt} AND NOT {yp}) AS fn, count_if({yt} AND {yp}) AS tp, count_if(NOT {parsed}) AS unparsed
  FROM {pairs}{gby}),
mx AS (
  SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS tpr_, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr_
  FROM (SELECT {gsel}CAST(n AS DOUBLE) AS n, CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn,
               CAST(tp AS DOUBLE) AS tp, unparsed FROM cm))
SELECT {gsel}CAST(n AS BIGINT) AS n, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       CAST(tp AS BIGINT) AS tp, CAST(unparsed AS BIGINT) AS unparsed,
       round(CASE WHEN n > 0 THEN (tp + tn) / n END, 6) AS accuracy,
       round(coalesce(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 0), 6) AS precision,
       round(coalesce(tpr_, 0), 6) AS recall, round(tpr_, 6) AS tpr,
       round(coalesce(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 0), 6) AS f1,
       round(CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN (tpr_ + 1 - fpr_) / 2 END, 6) AS roc_auc,
       round(fpr_, 6) AS fpr
FROM mx"""


ORACLE["q_eval_pairs_strict"] = with_text(TOPK_PREDS + "\nSELECT doc_id, label, prediction FROM pairs")
ORACLE["q_eval_pairs_inner"] = ORACLE["q_eval_pairs_strict"]
ORACLE["q_eval_common"] = with_text(TOPK_PREDS + f"\nSELECT doc_id, label, {sql_extract_label('prediction')} AS prediction FROM pairs")

ORACLE["q_binarize_strict"] = with_text(TOPK_PREDS + """
SELECT doc_id, label, prediction, CAST(coalesce(label = 'fake', false) AS INTEGER) AS y_true,
       CAST(coalesce(prediction = 'fake', false) AS INTEGER) AS y_pred FROM pairs""")

ORACLE["q_binarize_lenient"] = with_text(TOPK_PREDS + f"""
SELECT doc_id, label, p AS prediction, CAST(coalesce(label IN ('fake', 'yes'), false) AS INTEGER) AS y_true,
       CAST(coalesce(p IN ('fake', 'yes'), false) AS INTEGER) AS y_pred
FROM (SELECT doc_id, label, {sql_extract_label('prediction')} AS p FROM pairs)""")

ORACLE["q_confusion"] = with_text(TOPK_PREDS + """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(label <> 'fake' AND prediction <> 'fake') AS BIGINT) AS tn,
       CAST(count_if(label <> 'fake' AND prediction = 'fake') AS BIGINT) AS fp,
       CAST(count_if(label = 'fake' AND prediction <> 'fake') AS BIGINT) AS fn,
       CAST(count_if(label = 'fake' AND prediction = 'fake') AS BIGINT) AS tp FROM pairs""")

ORACLE["q_metrics"] = with_text(TOPK_PREDS + metrics_sql("pairs", []))
ORACLE["q_metrics_lenient"] = with_text(TOPK_PREDS + metrics_sql("pairs", [], lenient=True))

ORACLE["q_metrics_report"] = with_text(TOPK_PREDS + metrics_sql("pairs", []).replace("SELECT CAST(n AS BIGINT)", """
, fin AS (SELECT CAST(n AS BIGINT)""", 1) + """)
SELECT metric, coalesce(format('{:.4f}', value), 'nan') AS value_text FROM (
  SELECT 'accuracy' AS metric, accuracy AS value FROM fin UNION ALL SELECT 'precision', precision FROM fin
  UNION ALL SELECT 'recall', recall FROM fin UNION ALL SELECT 'f1', f1 FROM fin UNION ALL SELECT 'roc_auc', roc_auc FROM fin)""")

ORACLE["q_metrics_strict"] = with_graph_text(BAL_EX + vote_sql("ex", "doc_id") + """
, pairs AS (
  SELECT t.doc_id, t.label, lower(trim(p.raw_answer, chr(10))) AS prediction, 'balanced' AS strategy, 3 AS num_shots
  FROM corpus t JOIN preds p USING (doc_id) WHERE t.split = 'test')""" + metrics_sql("pairs", ["strategy", "num_shots"]))

SWEEP_EX = """
, ks AS (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS num_shots),
ex AS (
  SELECT t.test_id AS doc_id, ks.num_shots, c.label AS ex_label, t.sim AS ex_similarity
  FROM topk t JOIN ks ON t.rank <= ks.num_shots JOIN corpus c ON c.doc_id = t.train_id)"""

ORACLE["q_metrics_by_num_shots"] = with_text(SWEEP_EX + vote_sql("ex", "doc_id, num_shots") + """
, pairs AS (
  SELECT t.doc_id, p.num_shots, t.label, lower(trim(p.raw_answer, chr(10))) AS prediction
  FROM corpus t JOIN preds p USING (doc_id) WHERE t.split = 'test')""" + metrics_sql("pairs", ["num_shots"]))

LEANING = """CASE WHEN round(coalesce(fv, 0) * (1 + 2 * {t} + (15 - length({m})) / 4.0), 9) > round(coalesce(rv, 0), 9)
         THEN 'fake' ELSE 'real' END AS prediction"""

ORACLE["q_metrics_by_temperature"] = with_text(TOPK_PREDS + """
, grid AS (SELECT p.doc_id, p.label, t.temperature, """ + LEANING.format(t="t.temperature", m="'llama3.1:latest'") + """
  FROM pairs p JOIN votes USING (doc_id)
  JOIN (SELECT CAST(unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS DOUBLE) AS temperature) t ON TRUE)""" + metrics_sql("grid", ["temperature"]))

ORACLE["q_metrics_by_model"] = with_text(TOPK_PREDS + """
, grid AS (SELECT p.doc_id, p.label, m.model, """ + LEANING.format(t="0", m="m.model") + """
  FROM pairs p JOIN votes USING (doc_id)
  JOIN (VALUES ('llama3.2:1b'), ('llama3.2:latest'), ('gemma2:27b')) m(model) ON TRUE)""" + metrics_sql("grid", ["model"]))


# ---------------------------------------------------------------- record sources, prediction stores, streaming
ORACLE["q_propagation_scan"] = with_graph("""
SELECT p.propagation_id, p.label, CAST(e.n AS BIGINT) AS n_nodes, CAST(coalesce(r.m, 0) AS BIGINT) AS n_edges
FROM props p JOIN (SELECT propagation_id, count(*) AS n FROM pe GROUP BY propagation_id) e USING (propagation_id)
LEFT JOIN (SELECT propagation_id, count(*) AS m FROM raw_edges GROUP BY propagation_id) r USING (propagation_id)""")

ORACLE["q_record_folder_scan"] = with_graph("""
SELECT p.propagation_id, p.label, p.text, CAST(e.n AS BIGINT) AS n_nodes, CAST(coalesce(r.m, 0) AS BIGINT) AS n_edges
FROM props p JOIN (SELECT propagation_id, count(*) AS n FROM pe GROUP BY propagation_id) e USING (propagation_id)
LEFT JOIN (SELECT propagation_id, count(*) AS m FROM raw_edges GROUP BY propagation_id) r USING (propagation_id)""")

ORACLE["q_corpus_scan"] = with_graph("SELECT propagation_id, text, label FROM props")
ORACLE["q_true_labels"] = with_graph("SELECT propagation_id, label FROM props")
ORACLE["q_root_text"] = with_graph("SELECT propagation_id, text FROM props")
ORACLE["q_retweet_delays"] = with_graph("""
SELECT propagation_id, CAST(pos AS BIGINT) AS pos, round(delay, 6) AS delay
FROM pe JOIN props USING (propagation_id) WHERE pos >= 1""")
ORACLE["q_record_features"] = ORACLE["q_propagation_features"]

ORACLE["q_predictions_scan"] = with_text(TOPK_PREDS + """
SELECT CAST(doc_id AS VARCHAR) AS item_id, prediction FROM pairs""")
ORACLE["q_predicted_labels"] = with_text(TOPK_PREDS + f"""
SELECT CAST(doc_id AS VARCHAR) AS item_id, {sql_extract_label('prediction')} AS label FROM pairs""")
ORACLE["q_predictions_dedup"] = with_text(TOPK_PREDS + """
SELECT doc_id, 'topk' AS strategy, 'llama3.1:latest' AS model, 3 AS num_shots, prediction, CAST(1 AS BIGINT) AS batch_id
FROM pairs""")
ORACLE["q_pending"] = with_text("""
SELECT c.doc_id, k.num_shots FROM corpus c JOIN (SELECT CAST(unnest(range(5, 9)) AS INTEGER) AS num_shots) k ON TRUE
WHERE c.split = 'test'""")
ORACLE["q_incremental_score"] = with_graph_text(BAL_EX + vote_sql("ex", "doc_id") + """
SELECT 'prop_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.json' AS propagation_id, 'balanced' AS strategy,
       'llama3.1:70b' AS model, 3 AS num_shots, lower(trim(raw_answer, chr(10))) AS prediction FROM preds""")

_CHAIN_EDGES = """raw_edges AS (
  SELECT c.propagation_id, p.uid AS source, c.uid AS target
  FROM pe c JOIN pe p ON p.propagation_id = c.propagation_id AND p.pos = c.pos - 1),"""
_STAR_EDGES = """raw_edges AS (
  SELECT c.propagation_id, p.uid AS source, c.uid AS target
  FROM pe c JOIN pe p ON p.propagation_id = c.propagation_id AND p.pos = 0 AND c.pos > 0),"""
assert _CHAIN_EDGES in GRAPH_CTES
ORACLE["q_star_propagation_features"] = (
    "WITH RECURSIVE " + GRAPH_CTES.replace(_CHAIN_EDGES, _STAR_EDGES) + "," + EIGEN_CTES + FEATURES_SQL + """
SELECT propagation_id, label, round(avg_degree_centrality, 6) AS avg_degree_centrality,
       round(eigenvector_centrality, 6) AS eigenvector_centrality,
       round(median_retweet_time, 6) AS median_retweet_time, graph_status
FROM features""")

ORACLE["q_run_sweep"] = "SELECT * FROM (" + ORACLE["q_metrics_by_num_shots"] + ") AS sweep WHERE num_shots IN (2, 3)"
ORACLE["q_offline_evaluation"] = ORACLE["q_metrics_lenient"]
ORACLE["q_feature_cache"] = ORACLE["q_record_features"]
