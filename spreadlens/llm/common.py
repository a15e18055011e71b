"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, scratch_path  # noqa: F401 (release is for the operators)

#: A word is a run of characters outside this class; the class is fixed by the query contracts.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The same class as bytes.
SPACES = (0x20, *range(0x09, 0x0E))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives a lost executor and lets
    later steps read only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of a finished execution at once instead of at the driver's next garbage
    collection; operators that run several jobs then need the disk of their largest job only."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def whole_text(column: str = "text") -> Column:
    """The text column with nulls read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared(spark: SparkSession, make, *plain):
    """A function that gives ``make(*plain)`` in a task. Only ``plain`` (numbers, strings, arrays and containers of them) is
    broadcast, as it needs no package on the executors; the object is made once per worker and broadcast."""
    data = spark.sparkContext.broadcast({"plain": plain})

    def get():
        held = data.value
        if "made" not in held:
            held["made"] = make(*held["plain"])
        return held["made"]

    return get


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it until no column of ``df`` has it (names are matched without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(doc_id: str, folds: int) -> Column:
    """Fold of a row: crc32 of the id written as text, modulo the number of folds (a null id counts as empty)."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "utf-8")) % folds


def words(text: Column) -> Column:
    """The words of a text, in order (native)."""
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def small_batches(spark: SparkSession, rows: int = 256, mb: int = 16) -> None:
    """Arrow batches that stay small when single texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def utf8(column):
    """The bytes of an Arrow string or binary column and the offsets of its rows, without copying; nulls are empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    c = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    _, offsets, data = c.buffers()
    at = np.frombuffer(offsets, np.int64)[c.offset:c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def byte_words(data, offsets):
    """The words of the rows of a buffer as one binary array, and the number of the words of each row."""
    import numpy as np
    import pyarrow as pa

    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    places = np.r_[np.cumsum(inside)[starts] - 1, np.count_nonzero(inside)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[inside])]), counts


def most_frequent(counts: DataFrame, n: str, at_most: int) -> DataFrame:
    """The rows of the greatest counts, at most ``at_most``: those above a limit that a histogram of the counts (64
    steps for each doubling, so a few thousand rows at any size) gives. No task sorts them all."""
    step = F.floor(F.log2(F.col(n)) * 64)
    steps = sorted(((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, limit = 0, None
    for s, k in steps:
        total += k
        if total > at_most:
            break
        limit = s
    return counts.where(step >= limit) if limit is not None else counts.limit(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, keep, per_class: int, max_chars: int):
    """(texts, 0/1 labels, share of label 1 among all labelled rows kept): a bounded sample for fitting a classifier.

    ``per_class`` rows of either label in order of a hash of their id, without texts of more than ``max_chars``, so at
    most ``2 * per_class * max_chars`` characters reach the driver. Rows with other labels, null ids or null texts are
    left out; a doc_id counts once. ``keep`` maps an id column name to the condition of the training fold."""
    import numpy as np

    rows = labels.select("doc_id", F.col(target).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & keep("doc_id"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [rows.where(F.col("y") == y).dropDuplicates(["doc_id"]).orderBy(*order).limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))
    got = (
        docs.where(F.col("text").isNotNull()).join(ids, "doc_id").where(F.length("text") <= max_chars)
        .groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy(*order).toArrow()
    )
    total = sum(counts.values())
    return got.column("text").to_pylist(), np.array(got.column("y").to_pylist(), np.int64), counts.get(1, 0) / total if total else 0.5
