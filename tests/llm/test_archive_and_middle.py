"""WARC archive and fill-in-the-middle: against plain versions and DuckDB, and on odd rows."""

import base64
import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spreadlens.llm import fill_in_middle, warc
from spreadlens.llm.oracle import ORACLE
from spreadlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "a", "abc", "don't stop", "a<P>b", "x <S", "> y", "<M>", "line\nline\r\n\x00 end", "日本語 テスト 🤖 é", "z" * 9000, "ab c" * 3000,
    "< M> <P <S M> and <P" * 7, "<" * 50, "P>S>M>" * 20,
]


def rows_of(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("name", ["op12_warc", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == Counter(tuple(map(str, r)) for r in want.select(*got.columns).fetchall())


def plain_middle(key, text, seed=1):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not units or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_op13_equals_a_plain_version_whatever_the_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(fill_in_middle, "PIECE", piece)
    monkeypatch.setattr(fill_in_middle, "CHUNK", 4 * piece)
    rows = [(100 * k + i, t) for i, t in enumerate(TEXTS) for k in range(6)] + [(None, "no key"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fill_in_middle.restore(fill_in_middle.fill_in_middle(docs))
    got = Counter((r.doc_id, r.text, r.units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect())
    assert got == Counter((i, t, *plain_middle(i, t)) for i, t in rows)
    assert made.where("restored <> coalesce(text, '')").count() == 0
    assert len({r.form for r in made.collect()}) == 3


def test_op13_keeps_columns_and_replaces_those_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "some text here", "mine", 7, "x", "y")], "doc_id long, text string, output string, units int, _fim string, `odd name` string")
    out = fill_in_middle.fill_in_middle(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_fim", "odd name", "units", "form", "prefix_chars", "middle_chars", "output"])
    r = out.first()
    assert (r._fim, r["odd name"]) == ("x", "y") and (r.units, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(1, "some text here")
    assert fill_in_middle.restore(fill_in_middle.fill_in_middle(docs.limit(0))).count() == 0


def plain_record(page_id, url, html, refers_to):
    payload = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {warc.DATE}"]
    lines += [] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]
    lines += [] if refers_to is None else [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {warc.PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


PAGES = [
    (1, "http://a/1", "<p>same</p>"), (7, "http://a/7", "<p>same</p>"), (3, "http://b/3?q=WARC-Type: x", "<p>same</p>"), (2, None, None), (9, "u", ""), (4, "é/日本", "Ünï 🤖 \r\n\r\n\x00 end"),
    (5, "x\r\nWARC-Type: revisit", "own"), (None, "n", "<p>same</p>"), (None, "n1", "only null"), (None, "n2", "only null"), (8, "v", "v" * 300_000), (7, "http://a/7", "<p>same</p>"),
]


@pytest.mark.parametrize("least", [0, 8])
def test_op12_rebuilds_the_exact_records(spark, tmp_path, least):
    pages = spark.createDataFrame([(*p, "extra", 1) for p in PAGES], "page_id long, url string, html string, payload string, address int").repartition(3)
    warc.write(pages, f"{tmp_path}/a", min_bytes=least)
    last = {}
    for i, _, html in PAGES:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    refers = lambda i, html: last.get(html or "") if len((html or "").encode()) >= least and i != last.get(html or "") else None
    got = warc.read(spark, f"{tmp_path}/a")
    assert Counter((bytes(r.record), bytes(r.payload)) for r in got.collect()) == Counter((plain_record(*p, refers(p[0], p[2])), (p[2] or "").encode()) for p in PAGES)
    fields = Counter((r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in warc.parse(got).collect())
    assert fields == Counter((i, "response" if refers(i, h) is None else "revisit", refers(i, h), (h or "").encode()) for i, _, h in PAGES)
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == len({h or "" for _, _, h in PAGES})


def test_op12_refuses_a_payload_that_does_not_match_its_address(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/a")
    spark.read.parquet(f"{tmp_path}/a/records").write.parquet(f"{tmp_path}/b/records")
    broken = F.when(F.col("response") == 5, F.lit(b"0wn")).otherwise(F.col("payload"))
    spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", broken).write.parquet(f"{tmp_path}/b/payloads")
    with pytest.raises(Exception, match="does not match its address"):
        warc.read(spark, f"{tmp_path}/b").collect()


def test_op12_empty_table(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").limit(0)
    warc.write(pages, f"{tmp_path}/e")
    assert warc.parse(warc.read(spark, f"{tmp_path}/e")).count() == 0
