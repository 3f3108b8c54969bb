from __future__ import annotations

import hashlib
import io

import pytest
import zstandard

from offerscope.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long"


def pages():
    big = "<p>" + "same payload " * 30 + "</p>"
    rows = [(7, "http://a/1", big), (3, "http://a/2", big), (9, None, big), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", "é" * 50), (8, "u", "é" * 50), (10, "u", None), (11, "u", ""), (None, "u", big), (3, "http://a/2", big), (12, "bad\r\nurl", "long " * 200000)]
    rows += [(100 + i, f"http://b/{i}", f"<html><body><p>page {i}</p>" + f"<li>item {i % 7}</li>" * (i % 40) + "</body></html>") for i in range(120)]
    return [(*r, "clash", None) for r in rows]


def brute(rows, least=100):
    raw = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    first = {}
    for i, b in raw:
        if i is not None and len(b) >= least:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, b in raw:
        f = first.get(b)
        revisit = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == brute(pages())
    assert warc.round_trip(df.limit(0)).count() == 0


def test_only_committed_archives_are_read(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    df = spark.createDataFrame(pages(), SCHEMA).select("page_id", "url", "html").repartition(2)
    made = warc.write_archives(df, folder).collect()
    good = sorted((tuple(r) for r in warc.read_archives(spark, folder).collect()), key=str)
    assert len(good) == len(pages()) == sum(r.records for r in made)
    stray = warc.record(1, "http://x", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    (tmp_path / "warc" / "part-000000-000000000099-0000.warc.zst").write_bytes(archive([stray]))
    assert sorted((tuple(r) for r in warc.read_archives(spark, folder).collect()), key=str) == good
    (tmp_path / "warc" / made[0].file).write_bytes(archive([stray]))
    with pytest.raises(Exception, match="were written"):
        warc.read_archives(spark, folder).collect()


def archive(records, dictionary=b""):
    tool = zstandard.ZstdCompressor(write_checksum=True, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return warc.dictionary_frame(dictionary) + b"".join(map(tool.compress, records))


def test_reader_uses_the_dictionary_and_one_frame_for_each_record():
    texts = [b"<html>%d common words of all the pages %d</html>" % (i, i * 7) * 9 for i in range(200)]
    dictionary = zstandard.train_dictionary(4096, texts).as_bytes()
    records = [warc.record(i, "http://x", t, hashlib.sha256(t).hexdigest(), None) for i, t in enumerate(texts)]
    whole = archive(records, dictionary)
    got, decoded = warc.frames(whole)
    assert got == dictionary and list(decoded) == records
    assert [r["payload"] for r in warc.read_archive("x", whole)] == texts
    with pytest.raises(zstandard.ZstdError):  # another dictionary doesn't do
        list(warc.frames(warc.dictionary_frame(b"") + whole[8 + len(dictionary) :])[1])
    assert io.BytesIO(whole).read(4) == b"\x5d\x2a\x4d\x18"


@pytest.mark.parametrize("spoil", [lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"Content-Length: 5", b"Content-Length: 6"), lambda r: r[:-1], lambda r: r.replace(b"WARC-Type: response\r\n", b""), lambda r: r.replace(b"WARC-Type", b" WARC-Type"), lambda r: r.replace(b"hello", b"hallo"), lambda r: r.replace(b"\r\n\r\n", b"\r\n")])
def test_defects_are_errors(spoil):
    good = warc.record(1, "http://x", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    assert len(list(warc.read_archive("x", archive([good])))) == 1
    with pytest.raises(ValueError):
        list(warc.read_archive("x", archive([spoil(good)])))
    with pytest.raises(ValueError):
        list(warc.read_archive("x", archive([good])[:-6]))
    with pytest.raises(ValueError):
        list(warc.read_archive("x", archive([good])[8:]))
