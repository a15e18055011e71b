"""Skew-proof positions equal row_number; events -> graph mapping invariants."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from spreadlens.operators.ordering import positions_within_groups
from spreadlens.sources import fixtures

SF001 = "/root/testdata/sf0.001"


def test_positions_match_row_number_with_hot_group(spark):
    rows = [(0 if i % 3 else i % 7, i * 37 % 1001, i) for i in range(3000)]   # group 0 holds ~2/3 of the rows
    df = spark.createDataFrame(rows, "g long, t long, id long")
    got = positions_within_groups(df, ["g"], ["t", "id"], size_col="n", num_partitions=16)
    w = Window.partitionBy("g").orderBy("t", "id")
    ref = df.withColumn("rn", F.row_number().over(w) - 1).withColumn("cnt", F.count(F.lit(1)).over(Window.partitionBy("g")))
    bad = got.join(ref, ["g", "t", "id"]).filter((F.col("pos") != F.col("rn")) | (F.col("n") != F.col("cnt")))
    assert got.count() == 3000 and bad.count() == 0


def test_graph_events_invariants(spark):
    ev = fixtures.graph_events(spark, SF001, "day")
    assert ev.count() == spark.read.parquet(f"{SF001}/events.parquet").count()
    first = ev.filter("pos = 0")
    assert first.filter("delay != 0").count() == 0
    assert first.count() == ev.select("graph_idx").distinct().count()
    chain = fixtures.graph_edges(ev, "chain")
    assert chain.count() == ev.count() - first.count()


def test_graphs_and_propagations_grow_with_the_tables(spark):
    """One graph per document; a propagation row for every labelled document that has events, and for no other."""
    ev = fixtures.graph_events(spark, SF001)
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    assert ev.select("graph_idx").distinct().count() == docs.count()
    some = fixtures.graph_events(spark, SF001, labelled=True)
    got = {r.graph_idx for r in fixtures.propagations(spark, SF001, some).select("graph_idx").collect()}
    assert got == {r.doc_id for r in labels.collect()}
    assert some.count() == ev.join(labels, ev.graph_idx == labels.doc_id).count()


def test_hot_day_features_equal_window_reference(spark):
    """One day holds ~40% of all events: positions, chain edges and the median delay still equal a plain
    row_number / percentile computation, and the hot day is numbered by several tasks."""
    import datetime as dt

    from spreadlens.operators import graph

    rows = []
    base = dt.datetime(2024, 1, 1)
    for i in range(6000):
        day = 0 if i % 5 < 2 else 1 + i % 7
        rows.append((i, base + dt.timedelta(days=day, seconds=(i * 7919) % 86000), (i * 31) % 97))
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")
    ev = fixtures.graph_events_from(fixtures.with_time_buckets(events, "day"))
    hot = ev.filter("graph_idx = 0")
    assert hot.count() == 2400
    numbered = positions_within_groups(events.withColumn("d", F.to_date("ts")), ["d"], ["ts", "event_id"],
                                       num_partitions=8, part_col="task")
    assert numbered.filter("d = DATE'2024-01-01'").select("task").distinct().count() > 1   # hot day: many tasks
    w = Window.partitionBy("graph_idx").orderBy("ts", "event_id")
    ref = ev.withColumn("rn", F.row_number().over(w) - 1)
    assert ref.filter("rn != pos").count() == 0
    med = {r.propagation_id: r.median_retweet_time for r in graph.median_delay_sorted(fixtures.graph_delays(ev)).collect()}
    exact = {r.propagation_id: r.m for r in ev.filter("pos >= 1").groupBy("propagation_id").agg(
        F.median("delay").alias("m")).collect()}
    assert med.keys() == exact.keys()
    for k in med:
        assert abs(med[k] - exact[k]) < 1e-9
    chain = fixtures.graph_edges(ev, "chain")
    assert chain.count() == ev.count() - ev.select("graph_idx").distinct().count()
