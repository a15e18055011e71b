"""Operators and stages that keep rows: clashing names, equal ids, nulls in ids; and executors without the package."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spreadlens.llm import bpe_codec, decontaminate, simhash_dedup, suffix_dedup, toxicity

NAMES = ["matches", "_m0", "_matches", "ranges", "_ranges", "_k", "_bpe", "_toxic", "_digest", "odd name"]
ITEM = "Which river runs through the old town below the castle and past the three stone mills before it meets the sea? The long Danube river."


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["plain words of one text " * 3, "the same passage of many words again and again, " * 12, "before: " + "the same passage of many words again and again, " * 12, ITEM, None, ""]
    rows = [(i, t, *["mine"] * len(NAMES)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)).cache()


def kept_all(out, docs):
    assert set(docs.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    assert out.where(" or ".join(f"`{n}` <> 'mine'" for n in NAMES)).count() == 0
    return out


def test_clashing_names_stay(spark, docs):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    assert {r.doc_id for r in kept_all(decontaminate.clean(docs, bench), docs).collect()} == {0, 1, 2, 4, 5}
    assert kept_all(suffix_dedup.without_repeats(docs), docs).where("length(text) > 500").count() == 0
    assert kept_all(bpe_codec.encode(docs), docs).count() == docs.count()
    groups = simhash_dedup.near_duplicates(docs).select("component_id").distinct().count()
    assert kept_all(simhash_dedup.first_of_groups(docs), docs).count() == groups < docs.count()
    kept_all(toxicity.without_toxic(docs, toxicity.train(docs, labels)), docs)


def test_encoding_stage_replaces_columns_of_its_names(spark, docs):
    more = docs.withColumns({c: F.lit("old") for c in ("n_tokens", "ids", "decoded", "decoded_sha256")})
    out = corpus_pipeline.encode(spark, more, "")
    assert len(out.columns) == len(set(out.columns)) and out.where("decoded_sha256 = 'old'").count() == 0


def test_first_of_groups_keeps_a_row_of_every_group_where_ids_repeat(spark):
    a, b, c = ("first text of its own here", "quite another text about boats", "a third one that tells of hills and of snow")
    rows = spark.createDataFrame([(1, a), (2, b), (2, c), (3, c), (2, c), (None, c)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in simhash_dedup.first_of_groups(rows).collect())
    assert got == sorted([(1, a), (2, b), (2, c), (0, c)])


def test_items_with_null_and_repeated_ids(spark):
    other = ITEM.replace("river", "road").replace("Danube", "Roman")
    bench = spark.createDataFrame([(None, ITEM), (7, ITEM), (7, ITEM), (7, other), (2, None), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM), (2, other), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0) for r in decontaminate.matches(docs, bench).where("score > 0.99").collect())
    assert got == [(1, 0), (1, 7), (2, 7)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [3]


def test_executors_need_no_package(tmp_path):
    """The driver knows the package by sys.path alone, as a script outside the repository does; its workers don't."""
    code = """
        import sys; sys.path.insert(0, ROOT)
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
        from spreadlens.llm.queries import QUERIES
        for name in ("op2_decontaminate", "op3_lm_score", "op5_quality_cnn", "op6_toxicity", "op11_periodic_runs", "op13_fill_in_middle"):
            assert QUERIES[name](spark, "/root/testdata/sf0.001").limit(5).count() >= 0, name
            QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("all ran")
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" or "tokenizers" in v}
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code).replace("ROOT", repr(root))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "all ran" in done.stdout, done.stderr[-2000:]
