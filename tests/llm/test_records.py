"""WARC and exact top-k."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroud.llm import topk, warc


def test_warc_round_trip(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 900
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/ x\n", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "y" * 999), (8, "u", "y" * 999), (9, "u", "z" * 1000), (10, "u", "z" * 1000), (10, "u", "z" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"{tmp_path}/w"
    warc.write_archives(pages, path, segment_bytes=2000, chunk_bytes=700)
    records = warc.read_records(spark, path)
    assert records.where("record_type = 'continuation'").count() > 10
    got = warc.reassemble(records).collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    want = {i: (t or "").encode() for i, _, t in rows}
    for r in got:
        assert r.payload_bytes == len(want[r.page_id]) and r.digest == hashlib.sha1(want[r.page_id]).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == want[r.page_id]
    kinds = sorted((r.page_id, r.record_type) for r in got)
    assert [k for k in kinds if k[1] == "revisit"] == [(1, "revisit"), (9, "revisit")] and (2, "response") in kinds
    # A lost segment, a lost end and a wrong order
    assert [r.complete for r in warc.reassemble(records.where("NOT (origin_id LIKE '<urn:page:2:%' AND segment = 2)")).collect() if r.page_id == 2] == [False]
    assert [r.complete for r in warc.reassemble(records.where("total_length IS NULL")).collect() if r.page_id == 2] == [False]
    assert all(r.complete for r in warc.reassemble(records.orderBy("segment", ascending=False)).collect())


def test_warc_headers_and_references(spark, tmp_path):
    """Mandatory headers on every record; a revisit names its response's record, and is only verified with it."""
    rows = [(i, f"http://h/{i}", "p" * 5000) for i in range(6)] + [(6, None, "q" * 1200), (6, None, "q" * 1200), (None, "u", "q" * 1200), (8, "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages")
    warc.write_archives(spark.read.parquet(f"{tmp_path}/pages"), f"{tmp_path}/w", segment_bytes=2000, date="2024-05-06T07:08:09Z")
    text = "\n".join(r.value for r in spark.read.option("lineSep", "\n").text(f"{tmp_path}/w").collect())
    heads = [h.split("\r\n\r\n")[0] for h in text.split("WARC/1.1\r\n")[1:]]
    names = [line.split(": ", 1)[1] for h in heads for line in h.split("\r\n") if line.startswith("WARC-Record-ID")]
    assert len(heads) == len(set(names)) > len(rows)
    for h in heads:
        fields = dict(line.split(": ", 1) for line in h.split("\r\n"))
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length"} <= set(fields) and fields["WARC-Date"] == "2024-05-06T07:08:09Z"
        assert fields["WARC-Type"] == "continuation" or fields["Content-Type"].startswith("application/http")
    back = warc.reassemble(warc.read_records(spark, f"{tmp_path}/w"))
    back = back.withColumn("payload_digest", F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("digest"))).drop("payload").cache()
    responses = {r.record_id for r in back.where("record_type = 'response'").collect()}
    revisits = back.where("record_type = 'revisit'").collect()
    assert len(revisits) == 6 and all(r.refers_to in responses for r in revisits) and {r.page_id for r in revisits} == {0, 1, 2, 3, 4, None}
    assert all(r.verified for r in warc.checked(back).collect()) and warc.checked(back).count() == len(rows)
    lost = warc.checked(back.where("NOT (record_type = 'response' AND page_id = 5)")).collect()
    assert {r.page_id for r in lost if not r.verified} == {0, 1, 2, 3, 4}
    other = F.when((F.col("record_type") == "response") & (F.col("page_id") == 5), F.lit("0" * 40)).otherwise(F.col("payload_digest"))
    assert {r.page_id for r in warc.checked(back.withColumn("payload_digest", other)).collect() if not r.verified} == {0, 1, 2, 3, 4, 5}


def test_warc_of_nothing(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.reassemble(warc.read_records(spark, f"{tmp_path}/w")).count() == 0


def test_chunked_framing():
    for n in (0, 1, 700, 701, 5000):
        data = bytes(range(256)) * 20
        assert warc.unchunked(warc.chunked(data[:n], 700)) == data[:n]
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"zz\r\n", b"0\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


@pytest.mark.parametrize("blocks", [(8192, 4096), (7, 3)])
def test_top_k(spark, blocks):
    r = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in np.round(r.normal(size=6), 1)]) for i in range(40)]
    rows += [(40, None), (41, [None] * 6), (42, [float("nan")] * 6), (43, [float("inf")] + [0.0] * 5), (44, []), (45, [1.0, 2.0]), (46, rows[5][1]), (46, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.scaled(df)
    got = topk.top_k(vectors.where("vec_id % 10 = 0"), vectors, 5, *blocks).collect()
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(vectors.where("vec_id < 0"), vectors.where("vec_id < 0")).count() == 0
