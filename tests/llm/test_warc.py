import struct

import pytest
import zstandard

import quillstream.llm.warc as m


def expected(rows):
    out = []
    for i, _, html in rows:
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        top = max(same, default=None)
        revisit = top is not None and (i is None or i < top)
        out.append((i, len((html or "").encode()), m.digest((html or "").encode()), "revisit" if revisit else "response", top if revisit else None))
    return out


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)


@pytest.mark.parametrize("size", [4 << 20, 300])
def test_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(m, "ARCHIVE_BYTES", size)
    rows = [(i, f"http://x.org/{i}", f"<p>{'é' * (i % 7)} some page body {i % 7}</p>") for i in range(60)]
    rows += [(70, None, None), (71, "a\r\nb", ""), (72, "u", "x" * 300_000), (None, "u", "alone"), (None, "u", rows[3][2]), (5, rows[5][1], rows[5][2])]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in m.round_trip(pages).collect()]
    assert sorted(found, key=key) == sorted(expected(rows), key=key)
    assert m.round_trip(pages.limit(0)).count() == 0


def archive(*records, dictionary=b"", compressed=True):
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    lead = m.leading_frame(dictionary) if compressed else struct.pack("<II", m.DICTIONARY_MAGIC, len(dictionary)) + dictionary
    return lead + b"".join(pack.compress(r) for r in records)


def test_dictionary_plain_or_compressed():
    dictionary = m.train_dictionary([b"<html><body>page %d of the site, number %d</body></html>" % (i, i * 7) for i in range(2000)])
    rec = m.record(1, "http://a/", b"<html><body>page 3 of the site</body></html>", None)
    for compressed in (True, False):
        [got] = m.read_archive(archive(rec, dictionary=dictionary, compressed=compressed))
        assert got[0] == "<urn:page:1>" and got[7] == b"<html><body>page 3 of the site</body></html>"


def test_faults_are_found():
    good = m.record(1, "http://a/", b"body", None)
    assert m.parse_record(good)[5] == 4
    for old, new in (
        (b"WARC/1.1", b"WARX/1.1"), (b"WARC/1.1", b"WARC/2.0"), (b"Content-Length: 4", b"Content-Length: 5"), (b"body", b"bodY"), (b"WARC-Date", b"X-Date"), (b"\r\n\r\nHTTP", b"\r\nHTTP"),
        (b"WARC-Type", b"Content-Length: 1\r\nWARC-Type"), (b"HTTP/1.1", b"SMTP/1.1"),
    ):
        with pytest.raises(m.WarcError):
            m.parse_record(good.replace(old, new, 1))
    whole = archive(good, good)
    assert len(list(m.read_archive(whole))) == len(list(m.read_archive(whole[len(m.leading_frame(b"")) :]))) == 2
    for bad in (whole[:-3], b"", b"\x00" + whole[1:], whole[:6], whole + b"ab"):
        with pytest.raises(m.WarcError):
            list(m.read_archive(bad))
    broken = archive(good, good.replace(b"body", b"bodY", 1), good)
    assert [r[8] is None for r in m.read_archive(broken + b"junk", strict=False)] == [True, False, True, False]


def made(kind, block, *extra, version=b"WARC/1.0", type_=b"application/http; msgtype=response"):
    head = [version, b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:6f1c0d4e-0000-4000-8000-000000000001>", b"WARC-Date: 2020-01-02T03:04:05Z", b"Content-Type: " + type_, b"Content-Length: %d" % len(block), *extra]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Folded: one\r\n two\r\nContent-Length: 5\r\n\r\nhello"
    hexed = b"WARC-Payload-Digest: sha256:2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    records = [
        made(b"warcinfo", b"software: x\r\n", type_=b"application/warc-fields"),
        made(b"request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b"WARC-Target-URI: http://a/", b"WARC-Concurrent-To: <urn:uuid:2>", b"WARC-Concurrent-To: <urn:uuid:3>", type_=b"application/http; msgtype=request"),
        made(b"response", http, b"WARC-Target-URI: http://a/"),
        made(b"response", http, hexed, b"WARC-Target-URI: http://b/", version=b"WARC/1.1"),
        made(b"response", b"HTTP/1.0 200 OK\nTransfer-Encoding: chunked\nContent-Length: 99\nodd line\n\nbody"),
        made(b"response", b"127.0.0.1", type_=b"text/dns"),
        made(b"revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", b"WARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified", b"WARC-Refers-To: <urn:uuid:9>"),
        made(b"resource", b"\x00\x01", type_=b"image/png"),
        made(b"metadata", b""),
        made(b"response", http[:-2], b"WARC-Truncated: length", b"WARC-Payload-Digest: sha1:AAAA"),
    ]
    whole = archive(*records)
    (tmp_path / "x.warc.zst").write_bytes(whole[:8] + b"" + whole[8:])
    rows = {i: r for i, r in enumerate(m.read_archive(whole))}
    assert [r[2] for r in rows.values()] == "warcinfo request response response response response revisit resource metadata response".split()
    assert [rows[i][7] for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)] == [b"software: x\r\n", b"", b"hello", b"hello", b"body", b"127.0.0.1", None, b"\x00\x01", b"", b"hel"]
    assert rows[2][6] == m.digest(b"hello") and rows[3][6].startswith("2cf24d") and rows[6][3] == "<urn:uuid:9>" and rows[6][5] is None and rows[2][4] == "2020-01-02T03:04:05Z"
    found = m.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted((r.record_type, r.payload_digest or "") for r in found) == sorted((r[2], r[6] or "") for r in rows.values())
    for bad in (made(b"response", http[:-1]), made(b"response", http, b"WARC-Payload-Digest: sha1:AAAA"), made(b"revisit", b"")):
        with pytest.raises(m.WarcError):
            m.parse_record(bad)


def test_reading_in_small_pieces(monkeypatch):
    records = [m.record(i, "http://a/", bytes([65 + i]) * (50 * i), None) for i in range(20)]
    whole = archive(*records, dictionary=m.train_dictionary([b"page %d of %d" % (i, i * 7) * 9 for i in range(2000)]))
    for chunk, bite in ((7, 3), (64, 64), (1 << 20, 100)):
        monkeypatch.setattr(m, "CHUNK", chunk)
        monkeypatch.setattr(m, "BITE", bite)
        assert [r[5] for r in m.read_archive(whole)] == [50 * i for i in range(20)]
