"""WARC archives: a writer of one gzip member per record and a splittable reader.

Tasks of the reader scan byte ranges. In its range a task looks for the gzip magic, takes a candidate only if the member
decodes to a WARC header, and owns every record that starts inside, reading past the end of the
range to finish the last one. After a record the next one starts where its member ended, so most of a range is
decoded once and only the first record is searched for.

Of records with equal payloads of ``revisit_bytes`` or more, that with the largest id is a response and the
others are revisits of it, which carry digest and length but no payload. Payloads travel compressed.
Writers name files by task attempt and report them; only reported files are read, so a lost executor leaves nothing behind
that counts. Archives are opened through pyarrow.fs, which must reach the shared folder (file, hdfs, s3, gs).

Null html is an empty payload; a null url has no target header; a null id is kept as such, is never the response
of others and is a response where no row of its group has an id. Rows that repeat the largest id are all
responses. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import State, query, table
from quillnet.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
WINDOW = 1 << 18


def record_id(key: int | None) -> str:
    return f"<urn:page:{'none' if key is None else key}>"


def read_id(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def member(kind: str, key: int | None, url: str | None, digest: str, size: int, payload: bytes, refers: int | None = None) -> bytes:
    """One gzip member with one record; revisits keep the HTTP header of the payload they do not repeat."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(key)), ("WARC-Date", DATE)]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        fields.append(("WARC-Target-URI", safe))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers))]
    fields += [
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return gzip.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", 6, mtime=0)


def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        members = []
        for key, present, url, html, digest in zip(frame["id"], frame["present"], frame["url"], frame["html"], frame["digest"]):
            payload = html.encode("utf-8", "surrogatepass")
            members.append(member("response", int(key) if present else None, url, digest, len(payload), payload))
        yield pd.DataFrame({**{c: frame[c] for c in ("id", "present", "url", "digest", "bytes")}, "member": members})


def write(folder: str):
    """Writes one archive per task; a row for each file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, size = None, None, 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                if out is None:
                    context = TaskContext.get()
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    path = f"{folder}/{name}"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                key = int(row.id) if row.present else None
                body = row.member
                if row.revisit:
                    body = member("revisit", key, row.url, row.digest, int(row.bytes), b"", int(row.response))
                out.write(body)
                size += len(body)
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [path], "size": [size]})

    return run


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 1000) -> DataFrame:
    """Writes the archives; (file, size) of each."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.col(key).isNotNull().alias("present"), F.col(url).alias("url"),
        payload.alias("html"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
    )
    long = rows.filter(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes")
    groups = long.agg(F.max(F.when(F.col("present"), F.col("id"))).alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    built = rows.mapInPandas(build, "id long, present boolean, url string, digest string, bytes long, member binary")
    revisit = F.col("response").isNotNull() & ~(F.col("present") & (F.col("id") == F.col("response")))
    marked = built.join(groups, ["digest", "bytes"], "left")
    # A revisit needs no payload; what is written of it is made anew.
    marked = marked.select(
        "id", "present", "url", "digest", "bytes", F.when(~revisit, F.col("member")).alias("member"), revisit.alias("revisit"),
        F.coalesce("response", F.lit(0)).alias("response"),
    )
    return State(marked.mapInPandas(write(scratch_path(pages.sparkSession, "warc")), "file string, size long"), "archives").df


class Member:
    """A gzip member at ``start``: its bytes, and where the next one begins. None where it is no record."""

    def __init__(self, file, start: int):
        self.body = None
        file.seek(start)
        decoder, parts, length, checked = zlib.decompressobj(31), [], 0, False
        while not decoder.eof:
            data = file.read(WINDOW if parts else 4096)
            if not data:
                return
            try:
                part = decoder.decompress(data)
            except zlib.error:
                return
            length += len(data)
            parts.append(part)
            if not checked and sum(map(len, parts)) >= 5:
                if not b"".join(parts).startswith(b"WARC/"):
                    return
                checked = True
        self.body, self.next = b"".join(parts), start + length - len(decoder.unused_data)


def records(file, start: int, end: int) -> Iterator[bytes]:
    """The records whose members start in [start, end)."""
    at = start
    while at < end:
        found = Member(file, at)
        if found.body is not None:
            yield found.body
            at = found.next
            continue
        at += 1
        while at < end:  # search for the next magic; a window keeps the bytes a magic may begin with
            file.seek(at)
            window = file.read(min(WINDOW, end - at) + len(MAGIC) - 1)
            place = window.find(MAGIC)
            if place >= 0:
                at += place
                break
            at += max(1, len(window) - len(MAGIC) + 1)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [field.split()[0] for field in READ.split(", ")]

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    for frame in frames:
        for name, start, end in zip(frame["file"], frame["start"], frame["end"]):
            store, path = fs.FileSystem.from_uri(name)
            rows, size = [], 0
            with store.open_input_file(path) as file:
                for record in records(file, int(start), int(end)):
                    fields, block = parse(record)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind = fields["WARC-Type"]
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {name}")
                    refers = read_id(fields.get("WARC-Refers-To"))
                    rows.append((read_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, length, digest, refers, payload))
                    size += len(payload)
                    if size > 1 << 24:
                        yield frame_of(rows)
                        rows, size = [], 0
            if rows:
                yield frame_of(rows)


def read_archives(files: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """The records of archives (file, size), read in ranges of ``split_bytes``."""
    ranges = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("file", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("end"))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "file", "start").mapInPandas(read_ranges, READ)


@query("op5_warc")
def warc_query(spark, folder):
    files = write_archives(table(spark, folder, "pages").select("page_id", "url", "html"))
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
