"""WARC archives with a Zstandard dictionary in front and records compressed one by one (operator 8)."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import cut, join_counted

#: Fixed values of the format: magic number of the skippable frame that holds a dictionary, and of a Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def response_record(page: int | None, url: str, payload: bytes, digest: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if page is None else page}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {url}\r\n"
        f"WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    )
    return b"".join((head.encode(), http, payload, b"\r\n\r\n"))


def revisit_record(page: int | None, url: str, size: int, digest: str, refers_to: int) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = (
        f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:{'' if page is None else page}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {url}\r\n"
        f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\n"
        f"WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    )
    return b"".join((head.encode(), http, b"\r\n\r\n"))


def parse_record(record: bytes) -> dict:
    """Fields of one record; the payload of a response, and its digest computed anew."""
    head, rest = record.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if not lines[0].startswith("WARC/") or len(rest) != int(fields["Content-Length"]) + 4:
        raise ValueError("not a whole WARC record")
    http, payload = rest[:-4].split(b"\r\n\r\n", 1)
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    page = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    kind = fields["WARC-Type"]
    written = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest32(payload) != written):
        raise ValueError("the payload differs from its digest")
    return {"page": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "bytes": size, "digest": written, "type": kind, "refers_to": page(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def dictionary(records: list[bytes], size: int) -> bytes:
    """A trained dictionary, or where there is too little to train on, the records' own beginnings."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[:1024] for r in records)[:size]


def archive(records: list[bytes], *, dictionary_bytes: int = 16 << 10, level: int = 3) -> bytes:
    """One archive: a skippable frame with the dictionary, then each record as a frame of its own."""
    import zstandard

    samples, room = [], 64 * dictionary_bytes
    for r in records[:: max(1, len(records) // 256)]:
        if room > 0:
            samples.append(r[:room])
            room -= len(r)
    raw = dictionary(samples, dictionary_bytes)
    with_it = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(with_it.compress, records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """Records of an archive, in order."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary in front")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        one = d.decompressobj()
        parts = [one.decompress(view[at : at + (1 << 16)])]
        at += min(1 << 16, len(data) - at)
        while not one.eof and at < len(data):
            parts.append(one.decompress(view[at : at + (1 << 16)]))
            at += min(1 << 16, len(data) - at)
        if not one.eof:
            raise ValueError("an archive ends inside a record")
        at -= len(one.unused_data)
        yield b"".join(parts)


def with_types(pages: DataFrame, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = 200_000) -> DataFrame:
    """(page, url, html, bytes, sha, refers_to) of every row; html only where the record is a response.

    Payloads are compared by digest and size, and only those of at least ``min_bytes`` that several rows have are looked
    up. Up to ``most`` of them are broadcast, and every row stays where it was read. Beyond, rows that revisit another are
    found without their html, and left out of the others by their ids; a payload that very many pages share is not dealt
    to one task. Rows with a null id revisit the largest id too; where no row of a payload has an id, all are responses.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    source = pages.select(F.col(id_col).cast("long").alias("page"), F.regexp_replace(F.coalesce(url_col, F.lit("")), r"[\r\n]", "").alias("url"), html.alias("html"))
    source = source.withColumns({"bytes": F.length("html").cast("long"), "sha": F.sha1("html")})
    names, key = ["page", "url", "html", "bytes", "sha", "refers_to"], ["sha", "bytes"]
    keyed = source.drop("html").where(F.col("bytes") >= min_bytes)
    copied = cut(keyed.groupBy(*key).agg(F.max("page").alias("keeper"), F.count("*").alias("_n")).where("_n > 1 and keeper is not null"), "copied")
    if copied.limit(most + 1).count() <= most:
        marked = source.join(F.broadcast(copied.drop("_n")), key, "left")
        marked = marked.withColumn("refers_to", F.when(~F.col("keeper").eqNullSafe(F.col("page")) & (F.col("bytes") >= min_bytes), F.col("keeper")))
        return marked.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html"))).select(names)
    keyed = cut(keyed, "keyed")
    revisits = cut(join_counted(keyed, copied, key, keyed.count()).where("not (page <=> keeper)"), "revisits")
    again = revisits.select(F.col("page").alias("_page"), F.col("sha").alias("_sha")).distinct().hint("merge")
    responses = source.join(again, F.col("page").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")), "left_anti").withColumn("refers_to", F.lit(None).cast("long"))
    return responses.select(names).unionAll(revisits.select("page", "url", F.lit(None).cast("binary").alias("html"), "bytes", "sha", F.col("keeper").alias("refers_to")))


def write_archives(typed: DataFrame, *, archive_bytes: int = 4 << 20, dictionary_bytes: int = 16 << 10, level: int = 3) -> DataFrame:
    """(archive string, records long, data binary): a row is a whole archive file of about ``archive_bytes`` before compression.

    A record is never split; a longer one has an archive of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = archive(held, dictionary_bytes=dictionary_bytes, level=level)
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:05d}-{number:05d}.warc.zst"]), pa.array([len(held)], pa.int64()), pa.array([data], pa.binary())], ["archive", "records", "data"])

        for whole in batches:
            for b in (whole.slice(start, 64) for start in range(0, whole.num_rows, 64)):
                for page, url, html, n, sha, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    r = response_record(page, url, html, digest) if refers_to is None else revisit_record(page, url, n, digest, refers_to)
                    if held and size + len(r) > archive_bytes:
                        yield flush()
                        held, size, number = [], 0, number + 1
                    held.append(r)
                    size += len(r)
        if held:
            yield flush()

    return typed.select("page", "url", "html", "bytes", "sha", "refers_to").mapInArrow(run, "archive string, records long, data binary")


def read_archives(archives: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives; payload digests of responses are checked against the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = [parse_record(r) for r in read_archive(data.as_py())]
                columns = [pa.array([r[k] for r in rows], t) for k, t in (("page", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()))]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
                if with_payload:
                    columns.append(pa.array([r["payload"] for r in rows], pa.binary()))
                    names.append("payload")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    return archives.select("data").mapInArrow(run, schema)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file into ``folder``, a path mounted on every executor; returns (archive, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            sizes = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                path = os.path.join(folder, name)
                with open(path + ".part", "wb") as f:
                    f.write(data.as_py())
                os.replace(path + ".part", path)
                sizes.append(os.path.getsize(path))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["archive", "bytes"])

    return archives.select("archive", "data").mapInArrow(run, "archive string, bytes long")


def archived(pages: DataFrame, *, min_bytes: int = 0, archive_bytes: int = 4 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_payload: bool = False) -> DataFrame:
    """Write all rows as WARC records to archives in the shared folder and read them back.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to, url[, payload]), one row per page. Null html is
    an empty payload, a null url an empty one. Rows with a null id revisit as others do. If an id has several rows with the chosen
    payload, all of them are responses.
    """
    typed = with_types(pages, min_bytes=min_bytes, id_col=id_col, url_col=url_col, html_col=html_col)
    return read_archives(cut(write_archives(typed, archive_bytes=archive_bytes), "warc"), with_payload=with_payload)
