"""Materialised feature tables in the shared checkpoint folder, keyed by everything they depend on.

The reference caches features under the input folder's base name only, so a changed input or a different fit
silently reuses stale rows. Here the key is the full input path, what lies there (``inventory``: names, lengths and
times of the files) and the caller's fit / parameter identity, and the
table is Parquet (column pruning and filter push-down on re-read), written once and read by later runs.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root


def inventory(spark: SparkSession, path: str) -> list[str]:
    """Number and digest of the files of a folder; it changes when a file comes, goes or is rewritten."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    digest = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)"))
    return [str(x) for x in files.agg(F.count("*"), digest).first()]


def cache_path(spark: SparkSession, key: dict) -> str:
    digest = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:24]
    return os.path.join(checkpoint_root(spark), "spreadlens", "feature-cache", digest)


def load_or_build(spark: SparkSession, key: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table cached under ``key`` or build, write and read it."""
    path = cache_path(spark, key)
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
