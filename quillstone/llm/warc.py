"""WARC archives: written with an index, read by ranges of bytes.

Tasks write one archive each, every record a gzip member of its own, and return offset, length, URL
and digest of each record; Spark commits these rows as the index. Files of lost tries are named in
no row. To read, the wanted rows of the index are sorted by file and offset, and neighbouring
ranges become one read. Of records with equal payloads one is a response, the others revisit it.
Archives are read and written through ``pyarrow.fs``, so the folder may be on any store it knows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..session import stage_table

DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 8 << 20  # of one range, unless a record is longer
GAP_BYTES = 64 << 10  # between two wanted records that are still read together

#: The profile of a revisit record.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pandas_udf(T.StringType())
def _digests(texts: pd.Series) -> pd.Series:
    return pd.Series([digest((t or "").encode()) for t in texts], dtype=object)


def _page_uri(page) -> str:
    return f"<urn:x-page:{'' if page is None else quote(str(page), safe='')}>"


def _page_of(uri: str | None) -> str | None:
    return unquote(uri[len("<urn:x-page:") : -1]) or None if uri else None


def record(page, url: str | None, payload: bytes, kind: str, refers_to=None, named: str | None = None) -> bytes:
    """One record. A revisit has the HTTP header of its payload but not the payload. Control characters
    in a URL are percent-encoded, and a missing URL leaves out its line."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_page_uri(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{named or digest(payload)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_page_uri(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record: page, url, kind, digest, refers_to, payload_bytes, payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, named = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != named):
        raise ValueError("a WARC payload does not match its digest")
    return {
        "page": _page_of(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "kind": kind,
        "digest": named,
        "refers_to": _page_of(fields.get("WARC-Refers-To")),
        "payload_bytes": size,
        "payload": payload if kind == "response" else None,
    }


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; also for Hadoop's way of writing file:/path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


_INDEX = "file string, offset long, length long, url string, digest string, kind string"


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", text: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` into archives in ``folder``; returns the index, a staged table.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the smallest key is
    a response and the others revisit it; smaller payloads are all responses. Payloads are equal
    when SHA-1 and length are. A NULL text is an empty payload. Rows that repeat the smallest key
    are all responses; a row without a key is one if all its equals have none. The index has a row
    per record: page_id (under the key's name), file, offset, length, url, digest, kind.
    """
    payload = F.coalesce(F.col(text), F.lit(""))
    named = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), payload.alias("_text"), _digests(text).alias("_digest"))
    sized = named.withColumn("_size", F.octet_length("_text"))
    kind = named.schema["_key"].dataType.simpleString()
    # Only payloads that occur twice need a lookup; the rest of the pages never waits for one.
    narrow = sized.select("_key", "_digest", "_size").filter(F.col("_size") >= least_bytes)
    groups = narrow.groupBy("_digest", "_size").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n"))
    shared = stage_table(groups.filter("_n > 1").drop("_n"))
    decided = sized.join(shared, ["_digest", "_size"], "left")
    revisits = F.col("_first").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_first"))
    decided = decided.select("_key", "_url", "_text", "_digest", F.when(revisits, F.col("_first")).alias("_refers_to"))

    def written(batches):
        stream = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                system, path = open_folder(folder)
                system.create_dir(path, recursive=True)
                path = f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                file, stream, at = f"{folder}/{path.rpartition('/')[2]}", system.open_output_stream(path, compression=None), 0
            offsets, lengths, kinds = [], [], []
            for page, address, content, name, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                kinds.append("response" if refers_to is None else "revisit")
                raw = gzip.compress(record(page, address, content.encode(), kinds[-1], refers_to, name), 6, mtime=0)
                stream.write(raw)
                offsets.append(at)
                lengths.append(len(raw))
                at += len(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([file] * len(kinds)), pa.array(offsets), pa.array(lengths), batch.column(1), batch.column(3), pa.array(kinds)],
                [key, "file", "offset", "length", "url", "digest", "kind"],
            )
        if stream is not None:
            stream.close()

    return stage_table(decided.mapInArrow(written, f"`{key}` {kind}, {_INDEX}"))


def read_archives(index: DataFrame, key: str = "page_id") -> DataFrame:
    """The records that ``index`` names: page (text of the key), url, kind, digest, refers_to (text), payload_bytes, payload.

    ``index`` may be any part of an archive's index. Payloads are checked against their digests.
    """
    wanted = stage_table(index.select("file", "offset", "length"))
    files = max(1, wanted.select("file").distinct().count())

    def read(batches):
        name, source = None, None
        for batch in batches:
            file, offset, length = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            at = 0
            while at < len(file):
                if file[at] != name:
                    name = file[at]
                    system, path = open_folder(name)
                    source = system.open_input_file(path)
                begin, end, stop = offset[at], at + 1, offset[at] + length[at]
                while end < len(file) and file[end] == name and offset[end] - stop <= GAP_BYTES and offset[end] + length[end] - begin <= READ_BYTES:
                    stop = offset[end] + length[end]
                    end += 1
                raw = source.read_at(stop - begin, begin)
                found = [parse(zlib.decompress(raw[offset[i] - begin : offset[i] - begin + length[i]], wbits=31)) for i in range(at, end)]
                yield pa.RecordBatch.from_pylist(found, _RECORDS)
                at = end

    dealt = wanted.repartitionByRange(files, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "page string, url string, kind string, digest string, refers_to string, payload_bytes long, payload binary")


_RECORDS = pa.schema(
    [("page", pa.string()), ("url", pa.string()), ("kind", pa.string()), ("digest", pa.string())]
    + [("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
