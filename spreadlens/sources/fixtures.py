"""Projection of the driver tables onto the propagation domain.

* text corpus  = documents JOIN labels on doc_id; label = 'fake' when toxic = 1 else 'real';
  split = 'test' when doc_id % 5 = 0 else 'train' (the whole corpus is used, split is a data rule).
* propagation graphs = events, one graph per document: event_id modulo the number of documents. Events of a graph
  ordered by (ts, event_id) are the nodes; node 0 is the original post, the others are reposts whose delay is the
  seconds since the first event. Chain shape: edge (previous user, user); star shape: edge (first user, user).
  (One graph per day or hour can be had instead; those graphs grow with the data, their number does not.)
* propagation text / label = documents / labels row with doc_id = graph index; graphs of unlabelled documents have
  no propagation row.

Everything is returned in long form (one row per event / edge) so no graph is ever gathered into one row or task;
positions inside a graph come from the range-partitioned numbering in ``operators.ordering``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import positions_within_groups
from ..session import spread

BUCKET_MICROS = {"day": 86_400_000_000, "hour": 3_600_000_000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_expr(toxic: F.Column) -> F.Column:
    return F.when(toxic == 1, F.lit("fake")).otherwise(F.lit("real"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, label, split) for every labelled document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        label_expr(F.col("toxic")).alias("label"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
    )


def epoch_micros(df: DataFrame, col: str) -> F.Column:
    """Microseconds since the epoch. A TIMESTAMP_NTZ wall time is read as UTC without consulting the session time
    zone (a cast to TIMESTAMP would shift it by the session's offset); a TIMESTAMP is already an instant."""
    c = F.col(col)
    if df.schema[col].dataType.typeName() == "timestamp_ntz":
        day = F.unix_date(F.to_date(c)).cast("long")
        secs = F.hour(c) * 3600 + F.minute(c) * 60
        frac = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")   # seconds incl. microseconds
        return day * 86_400_000_000 + secs.cast("long") * 1_000_000 + frac
    return F.unix_micros(c.cast("timestamp"))


def propagation_id(idx: F.Column) -> F.Column:
    return F.concat(F.lit("prop_"), F.lpad(idx.cast("string"), 12, "0"), F.lit(".json"))


def graph_events(spark: SparkSession, sf_dir: str, granularity: str = "document", labelled: bool = False) -> DataFrame:
    """(propagation_id, graph_idx, event_id, ts, uid, pos, n_events, delay) — one row per event.

    ``pos`` is the 0-based position inside the graph by (ts, event_id); ``delay`` is seconds since pos 0.
    ``labelled`` keeps the graphs of labelled documents only, before anything is sorted.
    """
    events = table(spark, sf_dir, "events")
    if granularity == "document":
        n_docs = max(table(spark, sf_dir, "documents").count(), 1)          # read from the file footers
        events = events.withColumn("graph_idx", F.col("event_id") % F.lit(n_docs).cast("long"))
    else:
        events = with_time_buckets(events, granularity)
    if labelled:
        ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("graph_idx"))
        events = events.join(ids, "graph_idx", "left_semi")
    return graph_events_from(events)


def with_time_buckets(events: DataFrame, granularity: str) -> DataFrame:
    """``graph_idx`` = zero-based day or hour of an event."""
    unit = BUCKET_MICROS[granularity]
    ev = events.withColumn("_micros", epoch_micros(events, "ts"))
    ev = ev.withColumn("_bucket", F.expr(f"_micros div {unit}")).drop("_micros")
    first_bucket = ev.select(F.min("_bucket")).scalar()
    return ev.withColumn("graph_idx", (F.col("_bucket") - first_bucket).cast("long")).drop("_bucket")


def graph_events_from(events: DataFrame) -> DataFrame:
    """``graph_events`` over any (graph_idx, event_id, ts, user_id) DataFrame."""
    ev = events.select("graph_idx", "event_id", "ts", "user_id")
    ev = ev.withColumn("_micros", epoch_micros(ev, "ts"))
    ev = positions_within_groups(ev, ["graph_idx"], ["ts", "event_id"], size_col="n_events")
    first = ev.groupBy("graph_idx").agg(F.min("_micros").alias("_first_micros"))
    ev = ev.join(first, "graph_idx")
    return ev.select(
        propagation_id(F.col("graph_idx")).alias("propagation_id"),
        "graph_idx",
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("uid"),
        "pos",
        "n_events",
        ((F.col("_micros") - F.col("_first_micros")) / F.lit(1e6)).alias("delay"),
    )


def graph_edges(events: DataFrame, shape: str = "chain") -> DataFrame:
    """Raw (propagation_id, source, target) edges, duplicates and reversed pairs included."""
    cur = events.select("propagation_id", "pos", F.col("uid").alias("target"))
    if shape == "chain":
        prev = events.select("propagation_id", (F.col("pos") + 1).alias("pos"), F.col("uid").alias("source"))
        return prev.join(cur, ["propagation_id", "pos"]).select("propagation_id", "source", "target")
    if shape == "star":
        root = events.filter(F.col("pos") == 0).select("propagation_id", F.col("uid").alias("source"))
        return cur.filter(F.col("pos") > 0).join(root, "propagation_id").select("propagation_id", "source", "target")
    raise ValueError(f"unknown graph shape {shape!r}")


def graph_delays(events: DataFrame) -> DataFrame:
    """Repost delays in order: (propagation_id, pos, delay) for pos >= 1 (node 0 is the original)."""
    return events.filter(F.col("pos") >= 1).select("propagation_id", "pos", "n_events", "delay")


def propagations(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """One row per graph of a labelled document: (propagation_id, graph_idx, text, label)."""
    graphs = events.filter(F.col("pos") == 0).select("propagation_id", "graph_idx")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("graph_idx"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("graph_idx"), "toxic")
    return graphs.join(labels, "graph_idx").join(docs, "graph_idx").select(
        "propagation_id", "graph_idx", "text", label_expr(F.col("toxic")).alias("label"))


def propagation_records(spark: SparkSession, sf_dir: str, events: DataFrame, shape: str = "chain") -> DataFrame:
    """Nested interchange records (propagation_id, label, nodes, edges) — the one-document-per-propagation
    format of the JSON source. A record holds one whole propagation by definition of that format; the analytics
    below never need it (they run on the long tables)."""
    props = propagations(spark, sf_dir, events)
    nodes = events.groupBy("propagation_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "delay"))).alias("_nodes")
    )
    edges = graph_edges(events, shape).groupBy("propagation_id").agg(
        F.collect_list(F.struct("source", "target")).alias("edges")
    )
    rec = props.join(nodes, "propagation_id").join(edges, "propagation_id", "left")
    return rec.select(
        "propagation_id",
        "label",
        F.transform(
            "_nodes",
            lambda n: F.struct(
                F.when(n["pos"] == 0, F.col("text")).alias("tweet_text"),
                F.when(n["pos"] > 0, n["delay"]).alias("delay"),
            ),
        ).alias("nodes"),
        F.coalesce(F.col("edges"), F.array().cast("array<struct<source:string,target:string>>")).alias("edges"),
    )
