"""WARC archives: exact round trips, segments, broken records, and hard inputs."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import pytest

from loreweave.llm import warc


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(2)
    signs = ["a", "é", "😀", "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "WARC/1.1", "0\r\n\r\n", "<p>", " "]
    out = [(i, f"http://x/{i} \n", "".join(rng.choices(signs, k=rng.randint(0, 300)))) for i in range(60)]
    long = "😀WARC/1.1\r\n" * 3000
    return [*out, (60, None, None), (61, "u", ""), (62, "http://x/WARC/1.1", long), (63, "v", long), (64, "w", long + "x"), (65, "a", "WARC/1.1\r\n"), (66, "b", "\r\nWARC/1.1"), (67, "c", out[5][2]), (5, "d", out[5][2]), (67, "c", out[5][2]), (None, "n", out[6][2])]


SCHEMA = "page_id long, url string, html string, digest string, name string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("segment_bytes", [100, 1 << 14])
def test_round_trip(spark, pages, tmp_path, segment_bytes, monkeypatch):
    path = str(tmp_path / "w")
    warc.write_warc(frame(spark, pages), path, segment_bytes=segment_bytes)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(pages) and all(r.fault is None for r in got)
    least: dict[str, tuple] = {}
    for i, _, html in pages:
        least[html or ""] = min(least.get(html or "", (True, 1 << 60)), (i is not None, i or 0))
    by_id = {}
    for i, _, html in pages:
        by_id.setdefault(i, set()).add(html or "")
    want = sorted((i is not None, i or 0, len((html or "").encode()), digest((html or "").encode())) for i, _, html in pages)
    assert sorted((r.page_id is not None, r.page_id or 0, r.payload_bytes, r.payload_digest) for r in got) == want
    unique = {i for i in by_id if [p[0] for p in pages].count(i) == 1}
    of = {i: html or "" for i, _, html in pages}
    for r in got:
        if r.page_id in unique:
            first = least[of[r.page_id]] == (r.page_id is not None, r.page_id or 0)
            assert r.record_type == ("response" if first else "revisit")
            assert r.refers_to == (None if first or not least[of[r.page_id]][0] else least[of[r.page_id]][1])
    assert sum(r.record_type == "response" for r in got) == len(least)
    whole = [r for r in warc.read_records(spark, path, with_payload=True).collect() if r.kind == "response"]
    assert sorted(bytes(r.payload).decode() for r in whole) == sorted(least)


def test_archives_are_whole_records(spark, pages, tmp_path):
    """The files read one record after another, by their lengths alone, as any other reader would."""
    path = tmp_path / "w"
    warc.write_warc(frame(spark, pages), str(path), segment_bytes=1000)
    kinds = []
    for f in path.glob("part-*"):
        data = f.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(warc.BEGIN)
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert size <= 1000 and warc.BEGIN not in rest[:size] and rest[size : size + 4] == warc.END
            kinds.append(re.search(rb"WARC-Type: (\w+)", head)[1])
            data = rest[size + 4 :]
    assert {b"response", b"revisit", b"continuation"} == set(kinds)


def test_small_payloads_are_never_revisits(spark, pages, tmp_path):
    rows = [(i, "u", "ab") for i in range(5)] + [(i, "u", "abcd") for i in range(5, 10)]
    warc.write_warc(frame(spark, rows), str(tmp_path / "w"), least_bytes=3)
    assert sorted(r.page_id for r in warc.read_warc(spark, str(tmp_path / "w")).collect() if r.record_type == "response") == [0, 1, 2, 3, 4, 5]
    warc.write_warc(frame(spark, rows), str(tmp_path / "j"), revisits_most=0)
    assert sorted(r.page_id for r in warc.read_warc(spark, str(tmp_path / "j")).collect() if r.record_type == "response") == [0, 5]


def test_faults(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"

    def archive(*records):
        folder = tmp_path / f"a{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        (folder / "x.warc").write_bytes(b"".join(r + warc.END for r in records))
        return sorted((r.name or "", r.fault or "") for r in warc.read_records(spark, str(folder)).collect())

    def fields(kind, name, **more):
        return [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), *((k.replace("_", "-"), v) for k, v in more.items())]

    block = head + warc.chunked(b"payload")
    a = warc.record(fields("response", "a"), block)
    assert archive(a) == [("a", "")]
    assert archive(a[:-9]) == [("", "a record ends early")]
    assert archive(warc.record(fields("response", "a"), block[:-9])) == [("a", "a chunk ends early")]
    assert archive(warc.record(fields("response", "a", WARC_Payload_Digest="sha1:AAAA"), block)) == [("a", "the payload has another digest")]
    one = warc.record(fields("response", "a", WARC_Segment_Number="1"), block[:20])
    two = lambda total, n=2: warc.record(fields("continuation", f"a{n}", WARC_Segment_Origin_ID="<a>", WARC_Segment_Number=str(n), WARC_Segment_Total_Length=str(total)), block[20:])
    assert archive(two(len(block)), one) == [("a", "")]
    assert archive(one, two(len(block) + 1)) == [("a", "the segments have another length")]
    assert archive(one, two(len(block), 3)) == archive(two(len(block))) == [("a", "a segment is missing")]
    assert archive(one, two(len(block)), one, two(len(block))) == [("a", ""), ("a", "")]
    plain = warc.record(fields("response", "a"), b"HTTP/1.1 200 OK\r\n\r\nas it is")
    assert archive(warc.record(fields("warcinfo", "i"), b"software: x"), plain) == [("a", "")]


def test_framing():
    rng = random.Random(4)
    for _ in range(300):
        payload = b"".join(rng.choices([b"WARC/1.1\r\n", b"WARC/", b"1.1", b"\r\n", b"x", b"0"], k=rng.randint(0, 30)))
        body = warc.chunked(payload, rng.randint(1, 12))
        assert warc.dechunked(body) == payload and b"WARC/1.1" not in body
    assert warc.dechunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_empty(spark, pages, tmp_path):
    warc.write_warc(frame(spark, pages).limit(0), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0
