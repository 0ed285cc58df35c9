import base64
import glob
import hashlib
import struct

import pytest
import zstandard

from vexel.llm import warc


def brute(rows):
    first = {}
    for i, _, t in rows:
        p = (t or "").encode()
        if i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, _, t in rows:
        p = (t or "").encode()
        to = first.get(p) if first.get(p) != i else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def given(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ROWS = [(5, "http://a/x", "<p>one</p>"), (2, "http://b/é\r\nWARC-Type: evil\r\n\r\n", "<p>one</p>"), (9, None, None), (1, "", ""), (None, "u", "<p>one</p>"), (None, "v", "alone"), (7, "w", "x" * 3_000_000), (8, "w", "x" * 3_000_000), (4, "z", "\r\n\r\nWARC/1.1\r\n ü😀"), (2, "again", "<p>one</p>")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "s") for r in rows], "page_id long, url string, html string, payload int, same string")


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    table = table.unionByName(table.selectExpr("page_id + 100000 as page_id", "url", "html").where("page_id % 3 = 0"))
    assert given(warc.archived(table)) == brute([(r.page_id, r.url, r.html) for r in table.collect()])


def test_odd_rows(spark, tmp_path):
    assert given(warc.archived(pages(spark, ROWS).repartition(3))) == brute(ROWS)
    assert given(warc.archived(pages(spark, []))) == []
    warc.write(pages(spark, ROWS), f"{tmp_path}/a", least=11)
    found = warc.read(spark, f"{tmp_path}/a").collect()
    assert all(r.error is None for r in found)
    assert sorted((r.page_id for r in found if r.record_type == "revisit"), key=str) == [8]  # shorter payloads stand for themselves
    payloads = {(r.page_id, r.target_uri): bytes(r.payload) for r in found if r.record_type == "response"}
    assert payloads[4, "z"].decode() == ROWS[8][2] and payloads[9, ""] == b"" and payloads[2, "again"] == b"<p>one</p>"
    assert any(u.startswith("http://b/é%0D%0AWARC-Type:%20evil") for _, u in payloads)


def archive(spark, tmp_path, sf):
    warc.write(spark.read.parquet(f"{sf}/pages.parquet").coalesce(1), f"{tmp_path}/w")
    (name,) = [f for f in glob.glob(f"{tmp_path}/w/part-*") if not f.endswith(".crc")]
    return open(name, "rb").read()


def test_other_readers_can_decode_it(spark, tmp_path, sf):
    """By the library's own streaming, with nothing of this module."""
    data = archive(spark, tmp_path, sf)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    whole = reader.stream_reader(data[8 + size :], read_across_frames=True).read()
    table = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(table)
    assert all(r.html.encode() in whole for r in table)
    assert len(data) < 0.5 * len(whole)


def test_damage_is_told(spark, tmp_path, sf):
    data = archive(spark, tmp_path, sf)
    sound = list(warc.records(data))
    assert len(sound) == 250 and all(f["error"] is None for _, f in sound)
    at = [a for a, _ in sound]
    # A flipped byte within a frame: that record only.
    hurt = bytearray(data)
    hurt[at[5] + 40] ^= 0xFF
    found = list(warc.records(bytes(hurt)))
    assert found[5][1]["error"] and (len(found) < 250 or sum(f["error"] is not None for _, f in found) == 1)
    # Cut off: all before it, and one error.
    found = list(warc.records(data[: at[100] + 9]))
    assert len(found) == 101 and "cut off" in found[-1][1]["error"]
    assert "no frame" in list(warc.records(data[: at[3]] + b"garbage that is no frame"))[-1][1]["error"]
    # Too large for the reader.
    assert all("bytes" in f["error"] for _, f in warc.records(data, largest=10))
    # Spark's reader gives errors as rows, and the operator doesn't pass over them.
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc.zst").write_bytes(data[: at[2] + 9])
    rows = warc.read(spark, f"{tmp_path}/bad").collect()
    assert [r.error is None for r in rows] == [True, True, False]


def record(**change):
    block = change.pop("block", b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi")
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", "WARC-Date": "d", "Content-Type": "application/http", "Content-Length": len(block)} | change
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_records_are_checked():
    good = warc.parsed(record())
    assert good["payload"] == b"hi" and good["payload_bytes"] == 2 and good["payload_digest"] == warc.digest(b"hi") and good["page_id"] is None
    assert warc.parsed(record(**{"X-Folded": "a\r\n b", "WARC-Payload-Digest": "sha1:" + warc.digest(b"hi")}))["payload"] == b"hi"
    assert warc.parsed(record(**{"WARC-Type": "metadata", "Content-Type": "text/plain", "block": b"note"}))["payload"] == b"note"
    bad = [{"Content-Length": 3}, {"Content-Length": "x"}, {"Content-Length": None}, {"WARC-Type": None}, {"WARC-Date": ""}, {"WARC-Block-Digest": "sha1:AAAA"}, {"WARC-Payload-Digest": "sha1:AAAA"}, {"block": b"no response"}, {"block": b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhi"}, {"WARC-Type": "revisit"}]
    for change in bad:
        with pytest.raises(warc.Damaged):
            warc.parsed(record(**change))
    for data in (b"", b"WARC/1.1\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\n", record()[:-1], record() + b"x"):
        with pytest.raises(warc.Damaged):
            warc.parsed(data)


def test_archives_of_others():
    """A raw dictionary, other skippable frames, frames without size, and none of these."""
    samples = [record(block=b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nn%03d" % i) for i in range(200)]
    dictionary = zstandard.train_dictionary(2048, samples)
    packer = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False)
    raw = struct.pack("<II", 0x184D2A5D, len(dictionary.as_bytes())) + dictionary.as_bytes()
    gap = struct.pack("<II", 0x184D2A53, 5) + b"abcde"
    found = [f for _, f in warc.records(raw + b"".join(gap + packer.compress(s) for s in samples))]
    assert [f["payload"] for f in found] == [b"n%03d" % i for i in range(200)]
    plain = zstandard.ZstdCompressor()
    assert [f["payload_bytes"] for _, f in warc.records(plain.compress(samples[0]) + gap)] == [4]
    assert list(warc.records(b"")) == [] and list(warc.records(gap)) == []
    assert "dictionary" in list(warc.records(struct.pack("<II", 0x184D2A5D, 3) + b"abc" + plain.compress(samples[0])))[0][1]["error"]
