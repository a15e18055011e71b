"""Per-propagation graph features on long edge tables (one row per edge, never one row per graph).

Graph semantics: undirected simple graph; (a, b), (b, a) and repeats collapse to one edge; a self-loop is kept,
adds 2 to its vertex's degree and has weight 1 in the adjacency; the vertex set is the set of edge endpoints.
All aggregations are keyed by (propagation_id[, vertex]) and use partial (map-side) aggregation, so a hot graph
or a hub vertex is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PID = "propagation_id"


def undirected_edges(raw: DataFrame) -> DataFrame:
    """(propagation_id, source, target) -> distinct (propagation_id, a, b) with a <= b."""
    return (
        raw.filter(F.col("source").isNotNull() & F.col("target").isNotNull())
        .select(PID, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
        .distinct()
    )


def vertices(edges: DataFrame) -> DataFrame:
    """Distinct (propagation_id, vertex) over the endpoints of undirected edges."""
    return edges.select(PID, F.explode(F.array("a", "b")).alias("vertex")).distinct()


def graph_sizes(edges: DataFrame) -> DataFrame:
    """(propagation_id, n_vertices, n_edges) — n_edges counts a self-loop once."""
    m = edges.groupBy(PID).agg(F.count(F.lit(1)).alias("n_edges"))
    n = vertices(edges).groupBy(PID).agg(F.count(F.lit(1)).alias("n_vertices"))
    return n.join(m, PID)


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(propagation_id, vertex, degree, degree_centrality) = degree / (n - 1); 1.0 when n = 1."""
    ends = edges.select(PID, F.explode(F.array("a", "b")).alias("vertex"))  # a self-loop yields its vertex twice
    deg = ends.groupBy(PID, "vertex").agg(F.count(F.lit(1)).alias("degree"))
    n = deg.groupBy(PID).agg(F.count(F.lit(1)).alias("_n"))
    return deg.join(n, PID).select(
        PID,
        "vertex",
        "degree",
        F.when(F.col("_n") == 1, F.lit(1.0))
        .otherwise(F.col("degree") / (F.col("_n") - 1).cast("double"))
        .alias("degree_centrality"),
    )


def avg_degree_centrality(edges: DataFrame) -> DataFrame:
    """Mean degree centrality per graph in closed form 2m / (n (n - 1)) — no per-vertex table needed."""
    return graph_sizes(edges).select(
        PID,
        "n_vertices",
        "n_edges",
        F.when(F.col("n_vertices") == 1, F.lit(1.0))
        .otherwise(
            (F.lit(2.0) * F.col("n_edges")) / (F.col("n_vertices") * (F.col("n_vertices") - 1)).cast("double")
        )
        .alias("avg_degree_centrality"),
    )


def median_delay_sorted(delays: DataFrame) -> DataFrame:
    """Median repost delay when repost positions are already in delay order (events ordered by time).

    ``delays``: (propagation_id, pos >= 1, n_events, delay). Only the one or two middle rows of each graph survive
    the filter, so the aggregate never holds a whole group. Graphs without reposts are absent (caller uses 0).
    """
    r = F.col("n_events") - 1
    k = F.col("pos") - 1
    mid = delays.filter((k == F.floor((r - 1) / 2)) | (k == F.floor(r / 2)))
    return mid.groupBy(PID).agg(F.avg("delay").alias("median_retweet_time"))


def median_from_array(delays: F.Column) -> F.Column:
    """Median of an in-row array of numbers (record path); 0 for an empty array, mean of middle two if even."""
    s = F.array_sort(F.filter(delays, lambda x: x.isNotNull()))
    r = F.size(s)
    lo = F.element_at(s, (F.floor((r - 1) / 2) + 1).cast("int"))
    hi = F.element_at(s, (F.floor(r / 2) + 1).cast("int"))
    return F.when(r == 0, F.lit(0.0)).otherwise((lo + hi) / 2.0)


def record_edges(records: DataFrame) -> DataFrame:
    """Record path: nested edges array -> long (propagation_id, source, target)."""
    e = records.select(PID, F.explode("edges").alias("e"))
    return e.select(PID, F.col("e.source").alias("source"), F.col("e.target").alias("target"))


def root_text(records: DataFrame) -> F.Column:
    """nodes[0].tweet_text (ANSI mode: an empty nodes array raises, as indexing does in the reference)."""
    return F.col("nodes")[0]["tweet_text"]


def retweet_delays(nodes: F.Column) -> F.Column:
    """nodes[1:].delay as array<double>, order kept."""
    return F.transform(F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0))), lambda x: x["delay"])
