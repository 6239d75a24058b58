import base64
import glob
import gzip
import hashlib
import io
import json
import zlib

import pytest

from recordlens.llm import queries, warc
from tests.llm.conftest import SF


def plain(rows):
    digests = [base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
               for _, _, h in rows]
    least = {}
    for (page, _, _), d in zip(rows, digests):
        if page is not None:
            least[d] = min(least.get(d, page), page)
    return [(page, len((h or "").encode()), d,
             "response" if page == least.get(d) or d not in least else "revisit",
             None if page == least.get(d) else least.get(d))
            for (page, _, h), d in zip(rows, digests)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "u", ""), (4, "a\r\nb: c", "<p>x</p>"),
            (5, "ü", "é\U0001f600\r\n\r\nWARC/1.1"), (None, "n", "<p>x</p>"), (6, "l", "z" * 3_000_000),
            (1, "http://a/", "<p>x</p>")]
    return spark.createDataFrame([(*r, "extra", 1) for r in rows],
                                 "page_id long, url string, html string, payload string, digest int")


def test_query_against_plain_python(spark):
    rows = [(r.page_id, r.url, r.html)
            for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    found = queries.op4_warc_normaliser(spark, SF).collect()
    assert sorted(tuple(r) for r in found) == sorted(plain(rows))


def test_round_trip_of_odd_pages(pages):
    found = warc.round_trip(pages).collect()
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted([tuple(r)[:1] + tuple(r)[2:6] for r in found], key=str) == sorted(
        plain(rows), key=str)
    for r in found:
        if r.record_type == "response":
            assert r.payload.decode() in {h or "" for i, _, h in rows if i == r.page_id}
        else:
            assert r.payload is None
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_small_payloads_stay_responses(pages):
    found = {r.page_id: r.record_type for r in warc.round_trip(pages, min_bytes=1).collect()}
    assert (found[2], found[3], found[4]) == ("response", "response", "revisit")


def test_files(spark, pages, tmp_path):
    """One gzip stream before, a member per record and an index beside it after."""
    archives = warc.write_archives(pages, f"{tmp_path}/whole", archive_bytes=1_000_000)
    archives.write.parquet(f"{tmp_path}/archives")
    stored = spark.read.parquet(f"{tmp_path}/archives")
    warc.normalise(stored, f"{tmp_path}/members").write.parquet(f"{tmp_path}/index")
    whole, members = (sorted(
        f"{gzip.decompress(open(f, 'rb').read())}" for f in glob.glob(f"{tmp_path}/{d}/*.gz"))
        for d in ("whole", "members"))
    assert whole == members
    for file in glob.glob(f"{tmp_path}/members/*.gz"):
        data = open(file, "rb").read()
        rows = [json.loads(x) for x in open(f"{file}.idx")]
        assert sum(r["length"] for r in rows) == len(data)
        for r in rows:
            text = gzip.decompress(data[r["offset"]:r["offset"] + r["length"]])
            assert text.startswith(b"WARC/1.1\r\n") and r["record_id"].encode() in text
    for file in glob.glob(f"{tmp_path}/whole/*.gz"):
        raw = open(file, "rb").read()
        engine = zlib.decompressobj(31)
        engine.decompress(raw)
        assert engine.eof and not engine.unused_data  # a single member


def test_splitting_needs_no_whole_stream(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 64)
    records = [warc.record(i, f"u{i}", b"p" * (i * 97), warc.digest(b"p" * (i * 97)), None,
                           "1970-01-01T00:00:00Z") for i in range(9)]
    stream = io.BytesIO(gzip.compress(b"".join(records[:5])) + gzip.compress(b"".join(records[5:])))
    found = list(warc.split_records(warc.inflate(stream)))
    assert [data for _, _, data in found] == records
    with pytest.raises(ValueError, match="ends within a record"):
        list(warc.split_records(iter([b"".join(records)[:-50]])))


def parsed(data):
    return [(dict(h), block) for h, block, _ in warc.split_records(warc.inflate(io.BytesIO(data)))]


def test_archives_of_others():
    """Other spellings of names, no blank, folded lines, bare line feeds, padding, many members."""
    one = b"WARC/1.0\r\ncontent-length:5\r\nWARC-TYPE:response\r\n\r\nhello\r\n\r\n"
    two = (b"WARC/1.1\nWarc-Record-Id: <a>\nWARC-Target-URI: http://x/\n y\nContent-Length: 3\n\n"
           b"a\0b\n\n")
    empty = b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n\r\n\r\n"
    last = b"WARC/1.1\r\nContent-Length: 2\r\n\r\n\r\n"  # no line ends behind the block
    wanted = [({"content-length": "5", "warc-type": "response"}, b"hello"),
              ({"warc-record-id": "<a>", "warc-target-uri": "http://x/ y", "content-length": "3"},
               b"a\0b"), ({"content-length": "0"}, b""), ({"content-length": "2"}, b"\r\n")]
    records = [one, two, empty, last]
    members = b"".join(map(gzip.compress, records))
    assert parsed(gzip.compress(b"".join(records))) == parsed(members) == wanted
    assert parsed(members + b"\0" * 700) == wanted
    assert parsed(b"\0\0".join(map(gzip.compress, records))) == wanted
    head = next(warc.split_records(iter([one])))[0]
    assert head["Content-Length"] == "5" and head.get("WARC-Type") == "response"
    assert parsed(gzip.compress(b"")) == [] == parsed(b"")
    for bad in (b"WARC/1.1\r\nA: b\r\n\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\n",
                b"HTTP/1.1 200\r\nContent-Length: 0\r\n\r\n"):
        with pytest.raises(ValueError, match="without a version or length"):
            parsed(gzip.compress(bad))


def test_cut_archives_raise(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 16)
    records = [warc.record(i, "u", b"p" * 50, warc.digest(b"p" * 50), None, "d") for i in range(5)]
    data = gzip.compress(b"".join(records))
    assert len(parsed(data)) == 5
    for cut in range(1, len(data)):
        with pytest.raises((ValueError, zlib.error)):
            parsed(data[:cut])
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)  # cut where the writer flushed
    flushed = engine.compress(b"".join(records[:3])) + engine.flush(zlib.Z_FULL_FLUSH)
    with pytest.raises(ValueError, match="within a gzip member"):
        parsed(flushed)
