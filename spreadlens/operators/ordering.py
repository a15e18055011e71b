"""Row positions within groups that stay balanced when one group holds a large share of all rows.

``row_number().over(Window.partitionBy(g).orderBy(...))`` sorts each group inside a single task. Here the rows are
range-partitioned on (group keys, order keys) instead, so a hot group is spread over many tasks; every task numbers
its rows locally and a small table of per-(task, group) counts supplies the offsets (a prefix sum over tasks).
The numbered table is checkpointed to the shared checkpoint folder so later readers see one stable numbering and
a lost executor does not force a re-sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root

_LOCAL_BITS = 33  # monotonically_increasing_id(): partition index in the upper bits, record index in the lower 33


def positions_within_groups(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[str],
    pos_col: str = "pos",
    size_col: str | None = None,
    num_partitions: int | None = None,
    part_col: str | None = None,
) -> DataFrame:
    """Add ``pos_col`` = 0-based position of each row inside its group, by ``order_cols`` ascending.

    ``group_cols + order_cols`` must be unique per row (a total order); otherwise ties could be numbered
    differently by two evaluations. ``size_col`` (optional) adds the group's row count; ``part_col`` (optional)
    keeps the index of the task that numbered the row (to observe how a hot group was split).
    """
    spark = df.sparkSession
    keys = group_cols + order_cols
    # without an explicit count AQE may merge small range partitions (adjacent ranges, order kept) while a large
    # group still spans many advisory-sized partitions
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys))
    ranged = ranged.sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    tagged = ranged.withColumn("_part", F.shiftright(mid, _LOCAL_BITS)).withColumn(
        "_local", mid.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    )
    checkpoint_root(spark)
    tagged = tagged.checkpoint(eager=True)

    stats = tagged.groupBy("_part", *group_cols).agg(
        F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_cnt")
    )
    before = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("_offset", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    if size_col:
        offsets = offsets.withColumn(size_col, F.sum("_cnt").over(Window.partitionBy(*group_cols)))
    keep = ["_part", *group_cols, "_first", "_offset"] + ([size_col] if size_col else [])
    out = tagged.join(offsets.select(*keep), ["_part", *group_cols])
    out = out.withColumn(pos_col, F.col("_offset") + F.col("_local") - F.col("_first"))
    if part_col:
        out = out.withColumnRenamed("_part", part_col)
    return out.drop("_part", "_local", "_first", "_offset")
