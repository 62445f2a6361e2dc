"""Web archives: written with an index, read back by coalesced byte ranges.

Each write task streams gzip-compressed WARC records, one member per record, into a file of its own in the shared
folder and notes file, offset, length, URL and digest per record. The index is a table, written once: a task that
is tried again writes another file, and only the records of the attempt that ended are in the index. Readers sort
the selected index rows by file and offset, join neighbouring ranges into large reads, and cut the records out.

Of equal payloads (same SHA-256 and length) of at least min_revisit_bytes bytes the record with the largest page_id
is the response; the others are revisits, which carry the HTTP head with the payload's length and name the response.

Defined cases: a null html is an empty payload; a null url leaves the target header out; blanks and line breaks in a
url are percent-encoded; equal payloads below the bound are all responses; a row that repeats the response's page_id
is a response of its own; a null page_id stays null and is a response only if all its equals are null; an empty table
gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, scratch, stored
from .keyfilter import divided

#: A digest is hot if more than one in so many repeated pages has it.
HOT_SHARE = 20_000
#: What a task reads of the archives at most, about: compressed bytes and records.
PART_BYTES, PART_RECORDS = 16 << 20, 20_000
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
WARC_DATE = "2000-01-01T00:00:00Z"
INDEX_SCHEMA = "page_id long, url string, file string, offset long, length long, digest string"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_store(uri: str):
    """pyarrow file system and the path in it; a path without scheme is local."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def record_uri(page_id) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def record(page_id, url, payload: bytes, refers_to, date: str = WARC_DATE) -> bytes:
    """One WARC record, uncompressed."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_uri(page_id)}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{record_uri(refers_to)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; the payload of a response, checked against its digest, else None."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError("a payload doesn't match its digest")
    page = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:x-page:").removesuffix(">")) else None
    return {
        "page_id": page("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To"),
        "payload": None if revisit else payload,
    }


def with_originals(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: null for responses. Only digests are grouped. A page that a bitmap of the repeated
    digests rules out isn't shuffled, nor is one of a hot digest, of which there are fewer than HOT_SHARE."""
    key = ["__digest", "__bytes"]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"__digest": F.sha2("html", 256), "__bytes": F.octet_length("html")})
    first = rows.groupBy(*key).agg(F.max("page_id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    first = stored(first, "warc-copies")
    least = pieces(first.agg(F.sum("__n")).first()[0] or 0, HOT_SHARE)
    hot, cold = F.broadcast(first.filter(F.col("__n") > least)), first.filter(F.col("__n") <= least)
    likely, alone = divided(rows, first, key)
    again = likely.join(hot, key).unionByName(likely.join(hot.select(*key), key, "left_anti").join(cold, key, "left"), allowMissingColumns=True)
    again = again.unionByName(alone.withColumns({"__first": F.lit(None).cast("long"), "__n": F.lit(1).cast("long")}))
    revisit = (F.coalesce("__n", F.lit(1)) > 1) & (F.col("__bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return again.select("page_id", "url", "html", F.when(revisit, F.col("__first")).alias("refers_to"))


def write_archives(pages: DataFrame, uri: str | None = None, min_revisit_bytes: int = 0, level: int = 6) -> DataFrame:
    """Writes the archives below uri and returns their index."""
    uri = uri or scratch(pages.sparkSession, "warc")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(uri)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for frame in frames:
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                rows = []
                for page_id, url, html, refers_to in zip(frame["page_id"].astype(object), frame["url"], frame["html"], frame["refers_to"].astype(object)):
                    page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                    payload = html.encode("utf-8", "surrogatepass")
                    member = gzip.compress(record(page_id, url, payload, refers_to), level, mtime=0)
                    out.write(member)
                    rows.append((page_id, url, name, at, len(member), sha1_base32(payload)))
                    at += len(member)
                done = pd.DataFrame(rows, columns=["page_id", "url", "file", "offset", "length", "digest"])
                done["page_id"] = pd.array([r[0] for r in rows], dtype="Int64")
                yield done
        finally:
            if out is not None:
                out.close()

    index = with_originals(pages, min_revisit_bytes).mapInPandas(write, INDEX_SCHEMA)
    return stored(index.withColumn("file", F.concat(F.lit(uri + "/"), F.col("file"))), "warc-index")


def read_records(index: DataFrame, with_payload: bool = False, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """The records of the selected index rows, read by as many tasks as their bytes and number need."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, source = None, None
        try:
            for frame in frames:
                rows = list(zip(frame["file"], frame["offset"], frame["length"]))
                found, i = [], 0
                while i < len(rows):
                    file, start, length = rows[i]
                    end, j = start + length, i + 1
                    while j < len(rows) and rows[j][0] == file and rows[j][1] - end <= gap and rows[j][1] + rows[j][2] - start <= most:
                        end, j = max(end, rows[j][1] + rows[j][2]), j + 1
                    if opened != file:
                        if source is not None:
                            source.close()
                        store, path = open_store(file)
                        opened, source = file, store.open_input_file(path)
                    source.seek(start)
                    block = source.read(end - start)
                    found += [parse(gzip.decompress(block[o - start : o - start + n])) for _, o, n in rows[i:j]]
                    i = j
                if found:
                    out = pd.DataFrame(found)
                    for c in ("page_id", "refers_to"):
                        out[c] = pd.array([x[c] for x in found], dtype="Int64")
                    if not with_payload:
                        out["payload"] = None
                    yield out
        finally:
            if source is not None:
                source.close()

    wanted = index.select("file", "offset", "length")
    size = wanted.agg(F.sum("length"), F.count("*")).first()
    n_parts = max(pieces(size[0] or 0, PART_BYTES), pieces(size[1], PART_RECORDS))
    ordered = wanted.repartitionByRange(n_parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInPandas(read, RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes every page, reads every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_records(write_archives(pages, min_revisit_bytes=min_revisit_bytes)).drop("payload", "url")
