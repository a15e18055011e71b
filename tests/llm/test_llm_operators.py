"""Each operator against a plain version, and on odd rows: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import itertools
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spreadlens.llm import (
    bpe_codec, chat_format, decontaminate, lm_score, quality_cnn, quality_rules, simhash_dedup, suffix_dedup, token_count, toxicity,
)
from spreadlens.llm.components import components
from spreadlens.llm.oracle import ORACLE
from spreadlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"shared{i} passage" for i in range(40))
ODD = [
    None, "", "   ", "\n\n", "a", "Ärger ÜBER alles", PASSAGE, PASSAGE, "vor " + PASSAGE + " nach", "ab" * 3000, "x " * 400,
    "don't STOP we'll <|endoftext|> go <|startoftext|>", "日本語 テスト 🤖", "Σίσυφος ΣΑΣ", "tab\tline\n\n  end \x1c\x85 ", "</s>[INST] ok [/INST] \\b",
    " ".join(f"w{i * 7919 % 1000}" for i in range(3000)),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", f"s{i % 2}", 0, "extra") for i, t in enumerate(ODD)]
    rows += [(6, PASSAGE, "en", "s0", 0, "again"), (None, "no id at all", "en", "s0", 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(16)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def none_of(df):
    return df.limit(0)


def same(df, sql, con):
    want = con.sql(sql)
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    key = lambda rows: Counter(tuple(map(str, r)) for r in rows)
    assert key(df.select(*cols).collect()) == key(want.select(*cols).fetchall())


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_chat_format"])
def test_native_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same(QUERIES[name](spark, SF), ORACLE[name], con)


def test_op1_odd_rows_equal_sql(spark, odd):
    con = duckdb.connect()
    con.register("documents", odd.toArrow())
    same(quality_rules.quality_rules(odd), ORACLE["op1_quality_rules"], con)
    assert quality_rules.quality_rules(none_of(odd)).count() == 0


def test_op4_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 1, "user", "message", "hi [x]"), (1, 2, 2, "assistant", "delta", "bad"), (1, 3, 2, None, "regenerate", "ignored"),
        (1, 4, 2, None, "delta", "go"), (1, 5, 2, None, "delta", "od"), (1, 6, 1, None, "edit", "hello <s>\\l"), (None, 1, None, None, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, turn long, role string, kind string, text string")
    out = chat_format.format_chats(events).withColumn("turns", chat_format.parse(F.col("formatted")))
    out = {r.conv_id: r for r in out.withColumn("loss", chat_format.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "hello <s>\\l"), ("assistant", "good")]
    assert out[1].loss == "good" and [tuple(t) for t in out[None].turns] == [("", "")]
    assert chat_format.format_chats(none_of(events)).count() == 0


def exhaustive_bm25(items, text):
    words = [decontaminate.tokens(t or "") for _, t in items]
    df, mean = Counter(w for x in words for w in set(x)), sum(map(len, words)) / len(words)
    step, found = decontaminate.PASSAGE // 2, {}
    tokens = decontaminate.tokens(text or "")
    for at in range(0, max(1, len(tokens)), step):
        p = tokens[at:at + decontaminate.PASSAGE]
        for (item_id, t), w in zip(items, words):
            tf = Counter(w)
            idf = lambda x: np.log(1 + (len(items) - df[x] + 0.5) / (df[x] + 0.5))
            part = {x: idf(x) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, n in tf.items()}
            if part and sum(v for x, v in part.items() if x in p) / sum(part.values()) >= decontaminate.THRESHOLD:
                (_, question, answer), = decontaminate.parts(t)
                have = decontaminate.grams(p) | decontaminate.grams(p, 2) | decontaminate.grams(p, 1)
                share = lambda g: sum(x in have for x in g) / len(g) if g else 1
                if share(decontaminate.grams(question)) >= decontaminate.QUESTION and share(decontaminate.grams(answer)) >= decontaminate.ANSWER:
                    found[item_id] = True
    return set(found)


def test_op2_equals_exhaustive_search(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    planted = [(10**6 + i, "vorne " * i + t.upper() + " hinten" * 70) for i, (_, t) in enumerate(items[:25])]
    half = [(2 * 10**6 + i, " ".join(t.split()[: len(t.split()) // 3])) for i, (_, t) in enumerate(items[:10])]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(planted + half, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(rows, bench).collect()}
    want = {(r.doc_id, i) for r in rows.collect() for i in exhaustive_bm25(items, r.text)}
    assert got == want and {(10**6 + i, items[i][0]) for i in range(25)} <= got


def test_op2_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (1, PASSAGE), (4, "One question here? The short answer.")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(odd, bench).collect()} == {6, 7, 8}
    assert decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.matches(odd, none_of(bench)).count() == 0 and decontaminate.matches(none_of(odd), bench).count() == 0


def test_op2_a_short_last_sentence_does_not_decide(spark):
    item = "Which river runs through the old town below the castle and past the three stone mills before it meets the sea? Danube."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [(1, item), (2, item.replace("Danube", "Rhine")), (3, item.replace(" Danube.", "")), (4, "Danube. " * 9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(docs, bench).collect()} == {1, 2, 3}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {4}
    (words, question, answer), = decontaminate.parts(item)
    assert question + answer == words and len(answer) == len(words) // 3


def test_op3_base_score_and_normalisation(spark, odd):
    got = lm_score.score(odd.where("doc_id is not null")).collect()
    docs = [(r.doc_id, [*(r.text or "").encode().lower().split(), lm_score.END]) for r in odd.where("doc_id is not null").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in docs if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in docs)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    n = 20_000
    m = lm_score.Model.start(np.full(n, 1 / n))
    m.outputs *= 30
    m.classes *= 9
    seq = np.column_stack([np.tile([1, 2, 3], (n, 1)), np.arange(n)]).ravel()
    assert np.exp(m.log_probabilities(seq, np.arange(lm_score.CONTEXT, len(seq), lm_score.CONTEXT + 1))).sum() == pytest.approx(1, abs=1e-4)
    assert lm_score.score(none_of(odd)).count() == 0 and lm_score.score(odd).count() == odd.count()


def test_op3_rare_tokens_meet_their_counts_in_the_join(spark, odd, monkeypatch):
    rows = odd.where("doc_id is not null")
    whole = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in lm_score.score(rows).collect()}
    monkeypatch.setattr(lm_score, "FREQUENT", 3)
    assert {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in lm_score.score(rows).collect()} == whole


def test_op3_counts_words_without_an_object_for_each(spark, odd, monkeypatch):
    monkeypatch.setattr(lm_score, "HELD", 5)                        # counts are passed on in many parts
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    want = Counter(w for r in odd.collect() for w in [*(r.text or "").encode().lower().split(), lm_score.END])
    got = lm_score.token_counts(odd.select(F.coalesce("text", F.lit("")).alias("text"))).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.token: r.c for r in got} == want
    rows, word = np.array([0, 0, 0, 2, 2]), pa.array([b"b", b"a", b"b", b"", b"a"], pa.binary())
    assert [sorted((x["token"], x["n"]) for x in r) for r in lm_score.counted(rows, word, 4).to_pylist()] == [[(b"a", 1), (b"b", 2)], [], [(b"", 1), (b"a", 1)], []]
    assert lm_score.counted(rows[:0], word[:0], 2).to_pylist() == [[], []]
    tables = lm_score.Tables([lm_score.END, b"a", "ä".encode()], np.array([3.0, 2.0, 1.0]), 6, 3)
    ids, length, word = tables.coded(pa.array(["A ä x", None, "", "a A"]))
    assert ids.tolist() == [1, 2, -1, 0, 0, 0, 1, 1, 0] and length.tolist() == [4, 1, 1, 3] and word.to_pylist()[2] == b"x"


def test_op3_does_not_depend_on_the_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [{r.doc_id: r.score for r in lm_score.score(d).collect()} for d in (docs, docs.repartition(8), docs.repartition(64))]
    assert all(got[0][i] == pytest.approx(x[i], rel=1e-5) for x in got[1:] for i in got[0])
    r = lm_score.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[0] - r[1] > 0.12 * r[2]


def test_op3_averages_shards_in_bounded_fans(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD", 30_000)
    monkeypatch.setattr(lm_score, "LEAST_STEPS", 20)
    monkeypatch.setattr(lm_score, "STEP", 1024)
    monkeypatch.setattr(lm_score, "FAN_IN", 4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = [lm_score.score(d).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first() for d in (docs, docs.repartition(40))]
    assert sums[0][0] == pytest.approx(sums[1][0], rel=1e-5) and sums[0][0] > sums[0][1]


def test_op3_context_tells_infrequent_words_apart(spark):
    # 500 pairs of words in random order, all alike in frequency: far more words than 256, each second one certain
    r = np.random.default_rng(1)
    texts = [(i, " ".join(f"left{k} right{k}" for k in r.integers(0, 500, 300))) for i in range(500)]
    got = lm_score.score(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).where("held_out")
    score, base, n = got.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (score - base) / n > 0.5     # a model of the 255 first words and one class gains nothing on the others
    tables = lm_score.Tables([lm_score.END, *(b"w%d" % i for i in range(5000))], np.array([5.0] + [9.0] * 5000), 45_005, 5001)
    model = lm_score.Model.start(tables.share)
    assert len(tables.share) == 5002 and len(model.outputs) == 5002 and len(model.inputs) == 5003
    seq, at = lm_score.sequence(np.array([7, 5001, 0, 0]), np.array([3, 1]), tables.words)
    assert seq.tolist() == [5002] * 3 + [7, 5001, 0] + [5002] * 3 + [0] and at.tolist() == [3, 4, 5, 9]


def test_op5_and_op6_learn(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    q = quality_cnn.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (q.predicted == q.quality).mean() > 0.93
    t = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    ranks = t.score.rank()
    n1 = (t.toxic == 1).sum()
    auc = (ranks[t.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(t) - n1))
    assert auc > 0.75 and ((t.predicted == 1) & (t.toxic == 0)).mean() < 0.1


@pytest.mark.parametrize("module", [quality_cnn, toxicity])
def test_op5_and_op6_odd_rows(spark, odd, labels, module):
    out = module.score(odd, labels).toPandas()
    assert len(out) == odd.count() and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    assert module.score(none_of(odd), labels).count() == 0
    alone = module.score(odd, labels.where("quality = 1 and toxic = 1")).toPandas()
    assert (alone.score == 1).all()


def test_op5_long_documents_pool_over_all_parts(monkeypatch):
    n = quality_cnn.Network()
    data = np.random.default_rng(0).integers(32, 127, 5000).astype(np.uint8)
    whole = n.pooled(data, np.array([0, 5000]))
    parts = [n.pooled(data[: k], np.array([0, k])) for k in (2504, 5000)]
    assert (whole >= parts[0] - 1e-5).mean() > 0.9 and np.allclose(whole, parts[1])
    monkeypatch.setattr(quality_cnn, "PART", 1000)
    assert np.allclose(n.pooled(data, np.array([0, 5000])), whole, atol=0.5)


@pytest.mark.parametrize("size", [4999, 5000, 5001])
def test_op5_parts_equal_the_whole(monkeypatch, size):
    n = quality_cnn.Network()
    n.p["filt"] *= 3
    r = np.random.default_rng(2)
    data = np.concatenate([np.tile(r.integers(32, 127, 40), 30), r.integers(32, 127, size - 1200)]).astype(np.uint8)
    whole = n.pooled(data, np.array([0, size]))
    for part in (8, 64, 1000):
        monkeypatch.setattr(quality_cnn, "PART", part)
        assert np.allclose(n.pooled(data, np.array([0, size])), whole, atol=1e-4)


def brute_windows(texts, w=suffix_dedup.THRESHOLD):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + w] for t in raw for i in range(len(t) - w + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - w + 1):
            if seen[t[i:i + w]] > 1:
                gone[i:i + w] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("limits", [(4096, 4096), (1, 3)])
def test_op7_equals_brute_force(spark, odd, monkeypatch, limits):
    monkeypatch.setattr(suffix_dedup, "MAX_GROUP", limits[0])
    monkeypatch.setattr(suffix_dedup, "GATHER", limits[1])
    base = " ".join(f"unique{i}" for i in range(200))
    near = [(100 + k, base[:600] + f" edit{k} " + base[600:1200] + "z" * k) for k in range(12)]
    rows = odd.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string")).collect()
    got = suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute_windows([r.text for r in rows])))
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize("share", [1 / 1024, 0.3, 1.0])
def test_op7_runs_of_repeated_spans_whatever_counts_as_hot(spark, monkeypatch, share):
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)
    rows = [(1, 7, i) for i in range(40)] + [(1, 8, 40), (2, 7, 41), (2, 9, 42), (2, 9, 43), (2, 9, 44)]
    split = spark.createDataFrame(rows, "gram long, span long, _k long").repartition(3)
    spans = split.groupBy("gram", "span").count().select("gram", "span", (F.col("count") > 1).cast("int").alias("n"), F.col("count").alias("runs"))
    spans = spans.withColumn("n", F.col("n") + 1)
    got = [r["_k"] for r in suffix_dedup.runs_of_spans(split, spans).collect()]
    assert sorted(got) == [*range(40), 42, 43, 44]
    assert suffix_dedup.runs_of_spans(split.limit(0), spans.limit(0)).count() == 0


def test_op7_cuts_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    text = " ".join(f"n{i}" for i in range(2000))
    docs = spark.createDataFrame([(1, text), (2, text[3000:9000]), (3, "a" * 2500)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.removals(docs).collect()}
    assert got == {1: (text[:3000] + text[9000:]).encode(), 2: b"", 3: b""}
    assert suffix_dedup.removals(none_of(docs)).count() == 0


def test_op8_and_op10_equal_the_library(spark, odd):
    rows = odd.collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)] += 1
    out = bpe_codec.encode(odd)
    assert out.columns == [*odd.columns, "ids", "decoded", "n_tokens"] or set(odd.columns) <= set(out.columns)
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in out.collect()) == want
    digests = bpe_codec.digests(odd).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == Counter({(a, b, sha(c), sha(d.encode())): n for (a, b, c, d), n in want.items()})
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_count.count_tokens(odd).collect()) == lengths
    assert token_count.count_tokens(none_of(odd)).count() == 0 and bpe_codec.digests(none_of(odd)).count() == 0


def test_op8_cuts_only_where_no_token_spans(monkeypatch):
    c = bpe_codec.codec(bpe_codec.default_vocabulary())
    word = "日本語テストqzxjkvwŋaaaa".encode() * 9
    cut, final = c.fragments([word, b"the"])
    assert len(cut) > 3 and b"".join(cut) == word + b"the" and sum(final) == 2
    symbols = lambda: [c.symbol[0][b] for b in word[:-1]] + [c.symbol[1][word[-1]]]
    assert c.encoded([word])[0] == tuple(c.merge(symbols())) == tuple(c.merge_long(symbols()))
    monkeypatch.setattr(bpe_codec, "LONG", 10**6)
    assert c.encoded([word])[0] == tuple(c.merge(symbols()))


def test_op8_random_texts_equal_the_library(monkeypatch):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyzABCÉéßΣσ' \n\t0123456789.,!?日本語🤖\u0301\u00a0\x1c") + ["<|endoftext|>", " the", "ing ", "'ll"]
    texts = ["".join(r.choice(letters, r.integers(0, 60))) for _ in range(3000)] + ["ab" * 400, "q" * 1000, "".join(r.choice(letters[:26], 3000))]
    c = bpe_codec.Codec(bpe_codec.default_vocabulary())
    monkeypatch.setattr(bpe_codec, "CACHE", 5000)
    got = [x for a in range(0, len(texts), 200) for x in c.encode_batch(texts[a:a + 200])]
    for text, (ids, decoded, n) in zip(texts, got):
        want = t.encode(text, add_special_tokens=False).ids
        assert (np.frombuffer(ids, "<u4").tolist(), n) == (want, len(want)) and decoded == t.decode(want, skip_special_tokens=False)


def test_op9_triples_cover_all_quadruples():
    triples = [set(t) for t in simhash_dedup.covering_triples()]
    assert len(triples) == 20 and all(any(t <= set(q) for t in triples) for q in itertools.combinations(range(8), 4))


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("limits", [(32, 2048), (2, 8)])
def test_op9_links_equal_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(simhash_dedup, "JOIN_LIMIT", limits[0])
    monkeypatch.setattr(simhash_dedup, "BLOCK", limits[1])
    r = np.random.default_rng(3)
    fps = {int(x) for x in r.integers(-2**63, 2**63 - 1, 40)}
    for base in list(fps)[:6]:
        for _ in range(25):
            flips = r.choice(64, r.integers(1, 7), replace=False)
            x = base & (2**64 - 1)
            for f in flips:
                x ^= 1 << int(f)
            fps.add(x - 2**64 if x >= 2**63 else x)
    nodes = spark.createDataFrame([(x,) for x in sorted(fps)], "fp long")
    got = {(c.node, c.root) for c in components(simhash_dedup.links(nodes), "a", "b").collect()}
    arr = np.array(sorted(fps), np.int64)
    root = {int(x): int(x) for x in arr}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(arr):
        for y in arr[i + 1:][np.bitwise_count((x ^ arr[i + 1:]).view(np.uint64)) <= 4]:
            a, b = sorted((find(int(x)), find(int(y))))
            root[b] = a
    sizes = Counter(find(int(x)) for x in arr)
    assert got == {(int(x), find(int(x))) for x in arr if sizes[find(int(x))] > 1}


def test_op9_odd_rows_and_first_of_groups(spark, odd):
    got = simhash_dedup.near_duplicates(odd).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r.doc_id, f"{plain_fingerprint(r.text):016x}") for r in odd.collect())
    by = {r.doc_id: r.component_id for r in got}
    assert by[0] == by[1] == by[2] == by[3] == 0 and by[7] == by[6] == 6
    kept = simhash_dedup.first_of_groups(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert ids == sorted({c for c in by.values() if c is not None}) and kept.where("doc_id is null").count() == 1
    assert simhash_dedup.near_duplicates(none_of(odd)).count() == 0


def test_pipeline_stages_act_on_what_the_stage_before_kept(spark, odd, labels, tmp_path):
    bench = spark.createDataFrame([(1, "item " + PASSAGE)], "item_id long, text string")
    labels = labels.withColumn("toxic", (F.col("doc_id") == 3).cast("int"))     # so few that the base rate rejects none
    docs = odd.drop("words")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    empty = str(tmp_path / "none")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        after = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns, name
        assert after.count() <= before.count() and after.count() > 0
        before = after
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, SF).where("n_tokens is null or ids is null").count() == 0
