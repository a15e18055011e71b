"""Batch scoring of prompt requests through a user-supplied chat client, with resume.

* ``score``: ``mapInPandas`` over request partitions; the client is built once per partition by the picklable
  ``make_client`` the caller passes; a failing call is kept as a row with ``error`` set, never raised.
  ``max_parallel_calls`` repartitions the requests to bound concurrent calls against the endpoint.
* ``run_resumable``: left-anti join of the requests against the prediction store *before* the Python map
  (Catalyst cannot push a join through a Python operator), then one append of the new answers. A retried task
  re-scores only its own partition and the store is read back deduplicated, so no key is counted twice.

The offline ``VoteStubClient`` is the deterministic test double of the registered scoring queries: it answers
with the label carrying the larger similarity-weighted vote among the request's exemplars (ties -> Real). The
temperature and model sweeps use ``LeaningStubClient``, whose answers depend on both.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import normalize_answer


class VoteStubClient:
    """Offline client: similarity-weighted exemplar vote; ignores model and temperature."""

    def complete(self, system: str, user: str, model: str, temperature: float, exemplars) -> str:
        votes = {"fake": 0.0, "real": 0.0}
        for ex in exemplars if exemplars is not None else []:
            label = (ex["label"] or "").lower()
            if label in votes and ex["similarity"] is not None:
                votes[label] += float(ex["similarity"])
        return "Fake\n" if round(votes["fake"], 9) > round(votes["real"], 9) else "Real\n"


def vote_stub() -> VoteStubClient:
    return VoteStubClient()


class LeaningStubClient:
    """Offline client whose answer depends on every input: the fake vote gains weight with the temperature and with
    shorter model tags, so that the cells of a sweep differ."""

    def complete(self, system: str, user: str, model: str, temperature: float, exemplars) -> str:
        votes = {"fake": 0.0, "real": 0.0}
        for ex in exemplars if exemplars is not None else []:
            label = (ex["label"] or "").lower()
            if label in votes and ex["similarity"] is not None:
                votes[label] += float(ex["similarity"])
        weight = 1 + 2 * temperature + (15 - len(model)) / 4
        return "Fake\n" if round(votes["fake"] * weight, 9) > round(votes["real"], 9) else "Real\n"


def leaning_stub() -> LeaningStubClient:
    return LeaningStubClient()


def score(requests: DataFrame, make_client: Callable[[], object], key_cols: list[str],
          max_parallel_calls: int | None = None) -> DataFrame:
    """requests (key..., system_prompt, user_prompt, model, temperature, exemplars) ->
    (key..., raw_answer, error, prediction) with prediction = stripped, lower-cased answer."""
    fields = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    out_schema = ", ".join(f"`{c}` {fields[c]}" for c in key_cols) + ", raw_answer string, error string"
    cols = list(dict.fromkeys(key_cols + ["system_prompt", "user_prompt", "model", "temperature", "exemplars"]))
    req = requests.select(*cols)
    if max_parallel_calls:
        req = req.repartition(max_parallel_calls)

    def run(batches):
        client = make_client()
        for pdf in batches:
            answers, errors = [], []
            for system, user, model, temp, ex in zip(pdf["system_prompt"], pdf["user_prompt"], pdf["model"],
                                                     pdf["temperature"], pdf["exemplars"]):
                try:
                    answers.append(client.complete(system, user, model, temp, ex))
                    errors.append(None)
                except Exception as exc:  # the row is kept and can be re-scored by the next run
                    answers.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            out = pdf[key_cols].copy()
            out["raw_answer"] = pd.Series(answers, dtype=object, index=pdf.index)
            out["error"] = pd.Series(errors, dtype=object, index=pdf.index)
            yield out

    scored = req.mapInPandas(run, out_schema)
    return scored.withColumn("prediction", normalize_answer(F.col("raw_answer")))


#: Conditions of a table that is not there yet; any other error of a reader is raised.
ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The store, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ABSENT:
            raise
        return None


def latest(store: DataFrame, key_cols: list[str]) -> DataFrame:
    """Last answer wins per key: an answer before an error, then the newest batch."""
    w = Window.partitionBy(*key_cols).orderBy(F.col("error").isNull().desc(), F.col("batch_id").desc())
    return store.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def pending(requests: DataFrame, store: DataFrame | None, key_cols: list[str]) -> DataFrame:
    """Requests not answered yet (errors count as unanswered so they are retried)."""
    if store is None:
        return requests
    done = store.filter(F.col("error").isNull()).select(*key_cols)
    return requests.join(done, key_cols, "left_anti")


def next_batch(store: DataFrame | None, batch_id: int = 0) -> int:
    """``batch_id``, or the first number after the store's batches if they reach it: batch numbers only rise."""
    last = store.agg(F.max("batch_id")).first()[0] if store is not None else None
    return batch_id if last is None else max(batch_id, last + 1)


def run_resumable(requests: DataFrame, store_path: str, make_client: Callable[[], object], key_cols: list[str],
                  batch_id: int, max_parallel_calls: int | None = None) -> DataFrame:
    """Score what is pending, append it to the store, return the deduplicated store."""
    spark = requests.sparkSession
    store = read_store(spark, store_path)
    todo = pending(requests, store, key_cols)
    scored = score(todo, make_client, key_cols, max_parallel_calls)
    scored = scored.withColumn("batch_id", F.lit(next_batch(store, batch_id)).cast("long"))
    append_store(scored, store_path)
    return latest(spark.read.parquet(store_path), key_cols)


STORE_PARTITIONS = ["strategy", "model"]


def append_store(scored: DataFrame, store_path: str) -> None:
    """One append per batch; the run key names the folders (strategy=/model=) instead of result-file names, so a
    reader of one run prunes the others."""
    parts = [c for c in STORE_PARTITIONS if c in scored.columns]
    scored.write.mode("append").partitionBy(*parts).parquet(store_path)


def import_json_map(spark: SparkSession, path: str, key: str = "propagation_id", lines: bool = False) -> DataFrame:
    """(key, prediction) of result files: one JSON object {key: answer}, on one line or several, or any number of such
    objects after one another. With ``lines`` every line is an object, as ``export_json_map`` writes them: files of any
    size are then split over the cluster; otherwise a file is one row. A missing file is empty, a broken one raises."""
    try:
        raw = spark.read.text(path, wholetext=not lines)
    except AnalysisException as e:
        if e.getCondition() not in ABSENT:
            raise
        return spark.createDataFrame([], f"{key} string, prediction string")
    # a raw line break never stands inside a JSON string, so these are the borders of objects
    objects = raw.select(F.explode(F.split("value", r"(?<=\})\s*\n\s*(?=\{)")).alias("o")).where("trim(o) <> ''")
    return objects.select(F.explode(F.from_json("o", "map<string,string>", {"mode": "FAILFAST"})).alias(key, "prediction"))


#: Characters of an exported object at most, but for a single longer answer.
OBJECT_CHARS = 1 << 20


def export_json_map(preds: DataFrame, path: str, key: str, object_chars: int = OBJECT_CHARS) -> None:
    """Write {key: prediction} JSON objects of at most ``object_chars`` characters, one per line. Each task packs its own
    rows as they come, so nothing is shuffled and no row or task holds more than one object, at any number of rows. A key
    that a task meets again begins the next object, so no row is lost. A null key is left out, a null answer is null."""
    rows = preds.select(F.col(key).cast("string").alias("k"), F.col("prediction").cast("string").alias("p")).where("k is not null")

    def pack(batches):
        import pyarrow as pa

        def batch(lines):
            return pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

        held, size = {}, 0
        for b in batches:
            lines = []
            for k, p in zip(b.column("k").to_pylist(), b.column("p").to_pylist()):
                n = len(k) + len(p or "") + 8
                if held and (size + n > object_chars or k in held):
                    lines.append(json.dumps(held))
                    held, size = {}, 0
                held[k] = p
                size += n
            yield batch(lines)
        if held:
            yield batch([json.dumps(held)])

    rows.mapInArrow(pack, "value string").write.mode("overwrite").text(path)
