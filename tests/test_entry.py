"""Driver contract: entry smoke run, registry/oracle coverage, and a sample of oracle comparisons at sf0.01."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF01 = "/root/testdata/sf0.01"
TABLES = "events documents embeddings labels conversations".split()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "eigenvector_centrality" in df.columns


def test_every_query_has_an_oracle():
    """All but the optional training-data queries, of which SQL can express only some."""
    own = set(entry.queries()) - set(entry.LLM_QUERIES)
    assert own == set(entry.oracle_sql()) - set(entry.LLM_ORACLE) and set(entry.LLM_ORACLE) <= set(entry.LLM_QUERIES)


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", ["q_propagation_features", "q_topk_similar", "q_nearest_opposite",
                                  "q_metrics_by_num_shots", "q_prompts_topk"])
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    df = entry.queries()[name](spark, SF01)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    s = Counter(tuple(_norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    d = Counter(tuple(_norm(r[dcols.index(c)]) for c in sorted(dcols)) for r in res.fetchall())
    assert s == d


def test_runs_from_outside_the_repo_in_a_default_session(tmp_path):
    """Executors must not need the package on their path (functions are pickled by value), and event times
    must not depend on the session time zone."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
s = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')
     .config('spark.ui.showConsoleProgress', 'false').config('spark.sql.session.timeZone', 'Asia/Tokyo').getOrCreate())
s.sparkContext.setLogLevel('ERROR')
import __spark_entry__ as E
rows = E.entry(s).collect()
ids = sorted(r.propagation_id for r in rows)
n = E.queries()['q_dense_topk'](s, '/root/testdata/sf0.001').count()
print('RESULT', len(rows), ids[0], n)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    line = [l for l in out.stdout.splitlines() if l.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    _, n_rows, first_id, n_dense = line[0].split()
    assert int(n_rows) > 0 and first_id.startswith("prop_0000000") and int(n_dense) > 0
