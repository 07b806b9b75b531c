"""WARC archives: writing with revisits and segments, reading with segment reassembly.

Writing: each row becomes one record of a gzip member, with an HTTP header and a chunked body.
Among equal payloads of at least ``least_revisit`` bytes the row with the largest id is a
response and the others are revisits without a body. A block longer than ``segment_bytes`` is
split: the first segment keeps the record's type, the others are continuation records with the
origin's identifier and a segment number, and the last one states the total length. Each task
writes archives of about ``archive_bytes`` into the shared folder and reports them; only
reported archives are read, so files of lost or repeated attempts do no harm.

Reading: archives are parsed per file. Records in one piece are decoded where they are read;
segments alone are shuffled, grouped by origin identifier, ordered by segment number, and
joined when the numbers run from 1 without gap and the lengths add up to the stated total.
Then the chunked framing is decoded. A group holds the segments of one record only.

Null payloads count as empty, null URLs leave their header out, and line breaks in a URL are
percent-encoded. Rows without id are responses unless a row with an id has their payload; of
rows repeated with the largest id all are responses. A record that does not check out is
returned with ``valid`` false and no payload, never dropped. Other columns are not read.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from riskloom.llm.common import KeyFilter, new_stage_path, stage

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "record_id string, record_type string, page_id string, refers_to string, digest string, origin string, "
    "segment int, total long, length long, block binary"
)


def with_record_types(pages: DataFrame, least_revisit: int = 1000) -> DataFrame:
    """``_id, _url, _payload, _digest, _refers`` for ``_id, _url, _payload`` rows; ``_refers`` is set for revisits."""
    rows = pages.withColumn("_digest", F.sha1("_payload")).withColumn("_len", F.octet_length("_payload").cast("long"))
    eligible = rows.filter(F.col("_len") >= least_revisit).groupBy("_digest", "_len")
    groups = eligible.agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_last")).filter("_n > 1")
    groups = stage(groups.select("_digest", "_len", "_last"), "payloads")
    key = F.xxhash64("_digest", "_len")
    marked = KeyFilter(groups, key).mark(rows, key, "_shared")
    columns = ["_id", "_url", "_payload", "_digest"]
    no_ref = F.lit(None).cast(rows.schema["_id"].dataType).alias("_refers")
    alone = marked.filter("not _shared").select(*columns, no_ref)
    refers = F.when(~F.col("_id").eqNullSafe(F.col("_last")), F.col("_last"))
    shared = marked.filter("_shared").join(groups, ["_digest", "_len"], "left").select(*columns, refers.alias("_refers"))
    return alone.unionAll(shared)


def chunked(body: bytes, size: int) -> bytes:
    """A body in chunked transfer framing."""
    parts = []
    for i in range(0, len(body), size):
        piece = body[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    parts.append(b"0\r\n\r\n")
    return b"".join(parts)


def unchunked(body: bytes) -> bytes | None:
    """The decoded body; None when the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    text = b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    return gzip.compress(text, compresslevel=1, mtime=0)


def records_of(name: str, page_id, url, payload: bytes, digest: str, refers, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The WARC records of one page; ``name`` must be unique, record identifiers derive from it."""
    origin = f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"
    fields = [("WARC-Record-ID", origin), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    content = ("Content-Type", "application/http;msgtype=response")
    if refers is not None:
        fields = [("WARC-Type", "revisit"), *fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Page-ID", str(refers))]
        return [_record([*fields, content], HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    fields = [("WARC-Type", "response"), *fields, content]
    if len(block) <= segment_bytes:
        return [_record(fields, block)]
    out, starts = [], range(0, len(block), segment_bytes)
    for number, at in enumerate(starts, 1):
        if number > 1:
            own = f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{number}').urn}>"
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", "1970-01-01T00:00:00Z")]
            fields.append(("WARC-Segment-Origin-ID", origin))
        own_fields = [*fields, ("WARC-Segment-Number", str(number))]
        if number == len(starts):
            own_fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(own_fields, block[at : at + segment_bytes]))
    return out


def _writer(root: str, segment_bytes: int, chunk_bytes: int, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(root)
        files.create_dir(folder, recursive=True)
        task = TaskContext.get()
        prefix = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        state = {"out": None, "path": "", "records": 0, "bytes": 0, "files": 0}
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            if state["out"] is not None:
                state["out"].close()
                done.append((f"{root}/{state['path']}", state["records"], state["bytes"]))
                state.update(out=None, records=0, bytes=0)

        row = 0
        for batch in batches:
            for page in batch.to_pylist():
                name = f"{root}/{prefix}/{row}"
                row += 1
                for record in records_of(
                    name, page["_id"], page["_url"], page["_payload"], page["_digest"], page["_refers"], segment_bytes, chunk_bytes
                ):
                    if state["out"] is None:
                        state["path"] = f"{prefix}-{state['files']:04d}.warc.gz"
                        state["files"] += 1
                        state["out"] = files.open_output_stream(f"{folder}/{state['path']}", compression=None)
                    state["out"].write(record)
                    state["records"] += 1
                    state["bytes"] += len(record)
                    if state["bytes"] >= archive_bytes:
                        close()
        close()
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["path", "records", "bytes"])

    return run


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_revisit: int = 1000,
    segment_bytes: int = 8192,
    chunk_bytes: int = 4096,
    archive_bytes: int = 16 << 20,
) -> DataFrame:
    """Write the archives; returns ``path, records, bytes`` of those that count."""
    root = new_stage_path(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"))
    typed = with_record_types(rows, least_revisit)
    writer = _writer(root, segment_bytes, chunk_bytes, archive_bytes)
    return stage(typed.mapInArrow(writer, "path string, records long, bytes long"), "archives")


def parse_archive(stream: io.BufferedReader) -> Iterator[dict]:
    """The records of an archive, compressed or not, in order; one record is held at a time."""
    packed = stream.peek(2)[:2] == b"\x1f\x8b"
    reader = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16) if packed else stream
    while True:
        line = reader.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := reader.readline().rstrip(b"\r\n")):
            key, _, value = line.partition(b":")
            fields[key.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        length = int(fields.get("content-length", 0))
        block = reader.read(length)
        segment, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        yield {
            "record_id": fields.get("warc-record-id"),
            "record_type": fields.get("warc-type"),
            "page_id": fields.get("warc-page-id"),
            "refers_to": fields.get("warc-refers-to-page-id"),
            "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "origin": fields.get("warc-segment-origin-id"),
            "segment": int(segment) if segment else None,
            "total": int(total) if total else None,
            "length": length,
            "block": block,
        }


def _reader(segmented: bool | None):
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                files, path = fs.FileSystem.from_uri(uri)
                rows: list[dict] = []
                held = 0
                with files.open_input_stream(path, compression=None) as source:
                    for record in parse_archive(io.BufferedReader(source, 1 << 20)):
                        if segmented is not None and segmented != (record["segment"] is not None):
                            continue
                        rows.append(record)
                        held += len(record["block"])
                        if held > 4 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return run


def read_records(archives: DataFrame, segmented: bool | None = None, per_task: int = 8) -> DataFrame:
    """All records of the archives named in ``path``, one row each, with their raw block.

    ``segmented``: only records in segments, or only records in one piece. The tasks open the
    archives themselves, ``per_task`` each where there are many, so their names stay out of the driver.
    """
    n = archives.count()
    least = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(n, max(least, -(-n // per_task))))
    return archives.select("path").repartition(tasks).mapInArrow(_reader(segmented), RECORD_SCHEMA)


def join_segments(segments: list[dict], total: int | None) -> bytes | None:
    """The block of a record from its segments; None if one is missing or repeated or the length is wrong."""
    segments = sorted(segments, key=lambda s: s["segment"])
    if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
        return None
    block = b"".join(s["block"] for s in segments)
    return block if len(block) == total else None


def decode_http(block: bytes | None) -> tuple[bytes | None, int | None]:
    """Body and stated length of an HTTP response; no body when the block or its framing is broken."""
    head, gap, body = (block or b"").partition(b"\r\n\r\n")
    if not gap:
        return None, None
    fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
    if fields.get(b"transfer-encoding", b"").strip() == b"chunked":
        return unchunked(body), None
    stated = fields.get(b"content-length")
    return body, int(stated) if stated and stated.isdigit() else None


DECODED = pa.struct([("payload", pa.binary()), ("stated", pa.int64())])


@F.arrow_udf(T.StructType().add("payload", T.BinaryType()).add("stated", T.LongType()))
def _decode(blocks: pa.Array) -> pa.Array:
    return pa.array([dict(zip(("payload", "stated"), decode_http(b.as_py()), strict=True)) for b in blocks], DECODED)


@F.arrow_udf(T.BinaryType())
def _joined(segments: pa.Array, total: pa.Array) -> pa.Array:
    return pa.array([join_segments(s.as_py(), t.as_py()) for s, t in zip(segments, total, strict=True)], pa.binary())


def read_pages(archives: DataFrame) -> DataFrame:
    """Per page of the archives named in ``path``:
    ``record_id, record_type, page_id, refers_to, digest, payload, stated, valid``.

    ``payload`` is null for revisits, whose length is ``stated`` in their HTTP header.
    """
    head = ["record_id", "record_type", "page_id", "refers_to", "digest"]
    whole = read_records(archives, segmented=False).select(*head, "block")
    key = F.when(F.col("record_type") == "continuation", F.col("origin")).otherwise(F.col("record_id"))
    first = F.col("record_type") != "continuation"
    parts = read_records(archives, segmented=True).groupBy(key.alias("record_id"))
    parts = parts.agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in head[1:]],
        F.max("total").alias("_total"),
        F.collect_list(F.struct("segment", "block")).alias("_segments"),
    )
    joined = parts.select(*head, _joined("_segments", "_total").alias("block"))
    pages = whole.unionAll(joined).withColumn("_d", _decode("block"))
    revisit = F.col("record_type") == "revisit"
    payload = F.when(~revisit, F.col("_d.payload"))
    valid = F.coalesce(F.when(revisit, F.col("_d.stated").isNotNull()).otherwise(F.sha1(payload) == F.col("digest")), F.lit(False))
    return pages.select(*head, payload.alias("payload"), F.col("_d.stated").alias("stated"), valid.alias("valid"))
