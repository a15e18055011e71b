"""The whole pipeline against a plain version of every stage after the other: loops over texts, all pairs, all windows."""

import numpy as np
import public_tokenizers
from test_llm_operators import SF, brute_windows, exhaustive_bm25, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from spreadlens.llm import toxicity


def first_of_components(rows):
    """Rows (doc_id, text) without those whose fingerprint reaches one of a lesser row, by comparing all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), doc_id), doc_id)
    return [r for i, r in enumerate(rows) if r[0] == best[find(i)]]


def test_run_equals_the_plain_stages(spark, tmp_path):
    docs, bench, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    passage = " ".join(f"shared{i} passage" for i in range(60))
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows += [(9001, rows[3][1]), (9002, "vor " + passage + " nach"), (9003, passage + " ganz anders"), (9004, "so " + items[0][1] + " it was"), (9005, None), (9006, "")]
    planted = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in (("documents", planted), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: (r.text, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    scorer = toxicity.train(planted, labels)
    left = [r for r, s in zip(rows, scorer.scores([t or "" for _, t in rows])) if s < 0.3]
    left = first_of_components(left)
    cut = [k.decode("utf-8", "ignore") for _, _, _, k in brute_windows([t for _, t in left])]
    left = [(i, None if t is None else c) for (i, t), c in zip(left, cut)]
    left = [(i, t) for i, t in left if not exhaustive_bm25(items, t)]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text in left:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i] = (text, len(ids), np.array(ids, "<u4").tobytes())
    assert got == want
    assert 9001 not in got and 9004 not in got and len(got) > 50
