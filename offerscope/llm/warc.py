"""WARC archives in Zstandard with a dictionary, written and read back as Spark jobs.

An archive starts with a skippable frame that holds the dictionary; then each record is one
Zstandard frame with its content size and checksum. The reader loads the dictionary from the
leading frame, decodes frame by frame, and validates version line, header fields, content
length, block ends and payload digests; a defect raises an error that names file and record.

Archives are written by the tasks to the shared folder under names of their own attempt. The
manifest, a Parquet table, has the files and record counts of the attempts that Spark committed; only
these are read back, so that what lost, repeated or speculative attempts left is never seen, and a
count that differs is an error. Only digests and ids are grouped, after pre-aggregation; a payload that
very many pages share is split by the engine's skew join handling.

Defined results: null html is an empty payload; payloads under `least` bytes are all responses;
a null page_id is written as an empty id, read back as null and never referred to (such a page
is a response unless a page with an id holds the same payload); repeated rows are records of
their own, all of them responses where the row holds the smallest id; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscope.llm.shared import scratch_dir
from offerscope.llm.words import lean

#: Payloads under so many bytes are never revisited.
LEAST = 100
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 8 << 20
#: The dictionary is trained on at most so many payloads, of which the first SAMPLE_BYTES count.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 32_768
#: Fixed value: magic number of the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ValueError(f"not a record id: {urn}")
    return int(urn[10:-1]) if urn[10:-1] else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit without the payload if refers_to is given."""
    block = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append(f"WARC-Payload-Length: {len(payload)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block) of a record, validated."""
    cut = raw.find(b"\r\n\r\n")
    if cut < 0:
        raise ValueError("header without end")
    lines = raw[:cut].decode().split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"version line {lines[0][:20]!r}")
    head: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"header line {line[:40]!r}")
        head[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "content-length"):
        if name not in head:
            raise ValueError(f"no {name}")
    size = head["content-length"]
    if not size.isdigit() or len(raw) != cut + 4 + int(size) + 4 or raw[-4:] != b"\r\n\r\n":
        raise ValueError(f"length {len(raw)}, content-length {size}")
    return head, raw[cut + 4 : -4]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frames(archive: bytes) -> tuple[bytes, Iterator[bytes]]:
    """(dictionary, decoded frames) of an archive."""
    if len(archive) < 8:
        raise ValueError("no leading frame")
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC or len(archive) < 8 + size:
        raise ValueError("no dictionary in the leading frame")
    dictionary = archive[8 : 8 + size]

    def decoded() -> Iterator[bytes]:
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if size else zstandard.ZstdDecompressor()
        at = 8 + size
        while at < len(archive):
            end = frame_end(archive, at)
            yield reader.decompress(archive[at:end])
            at = end

    return dictionary, decoded()


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends: header, blocks by their sizes, checksum."""
    try:
        end = at + zstandard.frame_header_size(data[at : at + 18])
        checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    except zstandard.ZstdError as e:
        raise ValueError(f"no frame at byte {at}") from e
    last = False
    while not last:
        block = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
        end += 3 + (1 if kind == 1 else size)
        if end > len(data) or kind == 3:
            raise ValueError(f"frame at byte {at} has no end")
    end += 4 * checksum
    if end > len(data):
        raise ValueError(f"frame at byte {at} has no end")
    return end


def _writer(folder: str, dictionary: bytes) -> Callable:
    """Rows (page_id, url, html, digest, refers_to) to archives; gives (file, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        made, count, held, parts = 0, 0, 0, []
        tool = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

        def close():
            nonlocal made, count, held
            # an attempt has files of its own; the manifest has those of the attempts that Spark committed
            name = f"part-{context.partitionId():06d}-{context.taskAttemptId():012d}-{made:04d}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(dictionary_frame(dictionary) + b"".join(parts))
            row = pa.RecordBatch.from_pydict({"file": [name], "records": [count], "size": [held]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("size", pa.int64())]))
            made, count, held = made + 1, 0, 0
            parts.clear()
            return row

        for batch in batches:
            for lo in range(0, len(batch), 200):
                for page, url, html, digest, refers in zip(*(batch.column(i).slice(lo, 200).to_pylist() for i in range(5)), strict=True):
                    parts.append(tool.compress(record(page, url, (html or "").encode(), digest, refers)))
                    count, held = count + 1, held + len(parts[-1])
                    if held >= ARCHIVE_BYTES:
                        yield close()
        if count:
            yield close()

    return run


def read_archive(name: str, archive: bytes) -> Iterator[dict]:
    """Validated records of one archive: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""
    _, records = frames(archive)
    for i, raw in enumerate(records):
        try:
            head, block = parse(raw)
            kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
            size = int(head["warc-payload-length"])
            if kind not in ("response", "revisit"):
                raise ValueError(f"record type {kind}")
            if kind == "response" and (size != len(block) or hashlib.sha256(block).hexdigest() != digest):
                raise ValueError("payload and digest or length differ")
            if kind == "revisit" and (block or "warc-refers-to" not in head):
                raise ValueError("revisit with a block or without a reference")
            yield {"page_id": _page(head["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page(head["warc-refers-to"]) if kind == "revisit" else None, "payload": block}
        except (ValueError, KeyError) as e:
            raise ValueError(f"{name}, record {i}: {e!r}") from e


def _reader(folder: str) -> Callable:
    """Rows (file, records) of the manifest: the records of these archives, as many as were written."""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    archive = f.read()
                rows = [{k: r[k] for k in kinds.names} for r in read_archive(name, archive)]
                if len(rows) != records:
                    raise ValueError(f"{name} has {len(rows)} records, {records} were written")
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return run


def train_dictionary(pages: DataFrame) -> bytes:
    """Zstandard dictionary from a bounded sample of payloads; empty where there are too few."""
    rows = pages.filter("html is not null").select(F.substring("html", 1, SAMPLE_BYTES).alias("html")).limit(SAMPLE_ROWS).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.html.encode() for r in rows]).as_bytes() if len(rows) >= 20 else b""
    except zstandard.ZstdError:
        return b""


def with_references(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds digest and refers_to (null for responses)."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.withColumn("digest", F.sha2(html, 256))
    first = pages.filter(F.octet_length(html) >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    return pages.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes all rows (page_id, url, html) to archives in a folder; returns (file, records, bytes)."""
    dictionary = train_dictionary(pages)
    rows = with_references(pages).select("page_id", "url", "html", "digest", "refers_to")
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base)
    made = rows.mapInArrow(lean(_writer(folder, dictionary)), "file string, records long, size long")
    made.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(made.schema).parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives that the folder's manifest names; files of lost or repeated task attempts aren't read."""
    manifest = spark.read.schema("file string, records long, size long").parquet(f"{folder}/manifest")
    files = manifest.select("file", "records").repartition(F.col("file"))  # an archive has ARCHIVE_BYTES at most, so a task holds one of them at a time
    return files.mapInArrow(lean(_reader(folder)), SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a table of pages to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    made = write_archives(rows, folder)
    return read_archives(spark, folder) if made.limit(1).count() else spark.createDataFrame([], SCHEMA)
