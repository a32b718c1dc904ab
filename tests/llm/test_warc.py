import hashlib

import pytest

from hearsay.llm import warc

DATA = "/root/testdata/sf0.001"


def test_framing():
    for n in (0, 1, 1999, 2000, 2001, 9000):
        payload = bytes(k * 7 % 256 for k in range(n))
        assert warc.unchunked(warc.chunked(payload)) == payload
    assert warc.unchunked(b"3;a=b\r\nabc\r\n0\r\nX: y\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"x\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(warc.ArchiveError):
            warc.unchunked(broken)


def read(spark, rows, path, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, row int")
    warc.write_archives(df, path, **more)
    responses, revisits = warc.read_archives(spark, path)
    return [(r.page_id, bytes(r.payload)) for r in responses.collect()], [tuple(r) for r in revisits.collect()]


def test_round_trip(spark, tmp_path):
    long = "é<p>\r\n\r\nWARC/1.1\r\n0\r\n\r\n" * 900
    same = "same " * 300
    rows = [(1, None, None), (2, "http://a/\r\nX: y", long), (3, "u", long + "!"), (4, "u", same), (9, "u", same), (9, "u", same), (5, "u", same), (6, "u", "tiny"), (7, "u", "tiny"), (None, "u", "none " * 300), (None, "u", "none " * 300), (8, "", "x" * 3_000_000)]
    responses, revisits = read(spark, rows, str(tmp_path / "a"), segment=500)
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(responses, key=key) == sorted(((p, (h or "").encode()) for p, _, h in rows if p not in (4, 5)), key=key)
    assert sorted((p, to) for p, _, to, _ in revisits) == [(4, 9), (5, 9)]
    assert read(spark, [], str(tmp_path / "b")) == ([], [])


def test_missing_segments_are_noticed():
    blocks = warc.records("urn:x", 1, "u", b"x" * 5000, hashlib.sha1(b"x" * 5000).hexdigest(), None, 1000)
    archive = b"".join(b + b"\r\n\r\n" for b in blocks)
    found = list(warc.parse(archive))
    assert [int(f["warc-segment-number"]) for f, _ in found] == list(range(1, len(found) + 1))
    assert int(found[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in found)
    with pytest.raises(warc.ArchiveError):
        list(warc.parse(archive[:-1]))
    import pyarrow as pa

    def decode(parts):
        r = {"origin": "o", "page_id": 1, "digest": hashlib.sha1(b"x" * 5000).hexdigest(), "total": sum(len(b) for _, b in found), "block": None, "segments": [{"segment": n, "block": b} for n, b in parts]}
        return list(warc._decode([pa.RecordBatch.from_pylist([r])]))[0].column(2)[0].as_py()

    numbered = [(n, b) for n, (_, b) in enumerate(found, 1)]
    assert decode(numbered) == b"x" * 5000
    with pytest.raises(warc.ArchiveError):
        decode(numbered[:2] + numbered[3:])


def test_query_against_brute_force(spark, tmp_path):
    real = spark.read.parquet(f"{DATA}/pages.parquet")
    # every third page again under other numbers, as far as they are long
    more = real.where("page_id % 3 = 0").selectExpr("page_id + 1000 AS page_id", "url", "html").union(real.where("page_id % 6 = 0").selectExpr("page_id + 500 AS page_id", "url", "html"))
    real.union(more).repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    pages = [tuple(r) for r in spark.read.parquet(str(tmp_path / "pages.parquet")).select("page_id", "html").collect()]
    last = {}
    for p, h in pages:
        d = (h or "").encode()
        if len(d) >= 1000:
            last[d] = max(p, last.get(d, p))
    want = []
    for p, h in pages:
        d = (h or "").encode()
        to = last.get(d, p)
        want.append((p, len(d), hashlib.sha1(d).hexdigest(), "response" if to == p else "revisit", None if to == p else to))
    assert sorted((tuple(r) for r in warc.query(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    assert sum(w[3] == "revisit" for w in want) > 20
