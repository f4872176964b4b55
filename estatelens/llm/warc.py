"""WARC archives: write one record per page, read records back by verified boundaries.

Writing: a payload's digest decides which record is the response and which are revisits of it; only narrow rows are
grouped, and page bodies move once, by page. Each task writes one archive.

Reading: archives are cut into byte ranges. A task reports every place in its range that looks like the start of a
record, with the place where that record's successor must start (from its length field). Payloads may hold such magic
too; pointer jumping from the start of each file keeps the candidates that the chain of records reaches, and no others.
Inside a range the chain is followed by the task, so the jumps span ranges and their number grows with the logarithm
of the ranges per file. Tasks then read their range from the verified entry on.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import file_system, put_file, saved
from estatelens.session import Scratch, shared_folder

MAGIC = b"WARC/1.1\r\n"
#: Fixed by the format: the profile of a revisit whose payload is the same.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLANK = b"\r\n\r\n"
#: Bytes read at once for a head; heads may be longer.
HEAD = 1 << 16


def record(kind: str, page_id, url: str, digest: str, size: int, payload: bytes, refers_to=None) -> bytes:
    """One record. A revisit holds no payload; its digest and size are those of the full payload."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Target-URI: {''.join(url.split())}", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha256:{digest}",
             f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Bytes: {size}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"X-Refers-To-Page-Id: {refers_to}"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return MAGIC + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def roles(pages: DataFrame, id_col: str, body: str, least: int) -> DataFrame:
    """(page_id, digest, refers_to), one row per distinct pair: refers_to is null for responses."""
    raw = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.unhex(F.sha2(raw, 256)).alias("digest"), F.length(raw).alias("size")).distinct()
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(first, "digest", "left")
    return joined.select("page_id", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", body: str = "html", least: int = 100) -> DataFrame:
    """Write the archives; returns (file, bytes, records), one row per archive.

    Null bodies count as empty. Of rows that repeat both page_id and body each gets the record its page has. Pages
    without an id are written with an empty id; they revisit the smallest page_id of their payload, and if none has an id, all are responses.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=12)
        for b in batches:
            raw = [(x.as_py() or "").encode("utf-8", "replace") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary()), pa.array([press.compress(r) for r in raw], pa.binary())], names=["page_id", "url", "digest", "packed"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, count = f"pages-{TaskContext.get().partitionId():05d}.warc", 0
        open_ = zstandard.ZstdDecompressor()

        def records():
            nonlocal count
            for b in batches:
                for page, link, digest, packed, refers in zip(*(c.to_pylist() for c in b.columns)):
                    raw = open_.decompress(packed)
                    count += 1
                    yield record("response" if refers is None else "revisit", page, link or "", digest.hex(), len(raw), raw, refers)

        size = put_file(f"{folder}/{name}", records())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["file", "bytes", "records"])

    packed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(body).alias("body")).mapInArrow(pack, "page_id long, url string, digest binary, packed binary")
    kind = roles(pages, id_col, body, least).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    ready = packed.join(kind, packed["page_id"].eqNullSafe(kind["_page"]) & (packed["digest"] == kind["_digest"])).select("page_id", "url", "digest", "packed", "refers_to")
    return saved(ready.mapInArrow(write, "file string, bytes long, records long"))


LENGTH = re.compile("[0-9]{1,18}").fullmatch  # of a body; anything else in a payload is no record


def _parse(head: bytes) -> tuple[int, dict[str, str]] | None:
    """(bytes up to the body, fields) of a record's start, or None if no whole header with a length is there."""
    end = head.find(b"\r\n\r\n")
    if not head.startswith(MAGIC) or end < 0:
        return None
    fields = {}
    for line in head[len(MAGIC):end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return (end + 4, fields) if LENGTH(fields.get("content-length", "")) else None


def _head_end(f, data: bytes, at: int, left: int) -> tuple[bytes, int]:
    """(data, where the blank line after ``at`` starts, -1 if there is none): reads on, up to ``left`` bytes, until the line is there."""
    end = data.find(BLANK, at)
    while end < 0 and left > 0:
        seen = len(data)
        data += f.read(min(max(HEAD, seen - at), left))
        left -= len(data) - seen
        if len(data) == seen:
            break
        end = data.find(BLANK, max(at, seen - len(BLANK) + 1))
    return data, end


def ranges(archives: DataFrame, block: int) -> DataFrame:
    """(file, bytes, block, lo, hi): byte ranges of each archive."""
    n = F.greatest(F.ceil(F.col("bytes") / block), F.lit(1)).cast("long")
    out = archives.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    return out.select("file", "bytes", "block", (F.col("block") * block).alias("lo"), F.least((F.col("block") + 1) * block, F.col("bytes")).alias("hi")).repartition("file", "block")


def boundaries(archives: DataFrame, folder: str, block: int = 4 << 20) -> DataFrame:
    """(file, block, lo, hi, entry): for each byte range, the first record of the file's chain that starts in it.

    Ranges in which no record of the chain starts have no row. A chain that does not end at the size of its file, or has not
    as many records as archives says (if it has such a column), raises an error.
    """
    parts = ranges(archives, block)

    def candidates(batches):
        for b in batches:
            for name, size, k, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                system, path = file_system(f"{folder}/{name}")
                with system.open_input_file(path) as f:
                    f.seek(lo)
                    data = f.read(min(hi + HEAD, size) - lo)
                    found, at, end = [], data.find(MAGIC), -1
                    while 0 <= at < hi - lo:
                        if end < at:
                            data, end = _head_end(f, data, at, size - lo - len(data))
                            end = len(data) if end < 0 else end
                        got = _parse(data[at:end + len(BLANK)])
                        nxt = None if got is None else at + got[0] + int(got[1]["content-length"]) + 4
                        if nxt is not None and lo + nxt <= size:
                            found.append((lo + at, lo + nxt))
                        at = data.find(MAGIC, at + 1)
                leave = {}  # where the chain through a candidate leaves the range, after how many records
                for at, nxt in reversed(found):
                    to, n = leave.get(nxt, (nxt, 0)) if nxt < hi else (nxt, 0)
                    leave[at] = to, n + 1
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([k] * len(found), pa.int64()), pa.array([a for a, _ in found], pa.int64()), pa.array([leave[a][0] for a, _ in found], pa.int64()), pa.array([leave[a][1] for a, _ in found], pa.int64())], names=["file", "block", "at", "leave", "steps"])

    with Scratch(archives.sparkSession) as scratch:
        found = scratch.keep(parts.mapInArrow(candidates, "file string, block long, at long, leave long, steps long"))
        # only where a range is entered is a place to jump from
        doors = found.select("file", F.col("leave").alias("at")).union(found.where("at = 0").select("file", "at")).distinct()
        entries = scratch.keep(found.join(doors, ["file", "at"], "left_semi"))
        scratch.drop(found)
        jump = entries.select("file", "at", F.col("leave").alias("to"))
        reached = entries.where("at = 0").select("file", "at")
        n = -1
        while True:  # reached doubles its steps each round
            ahead = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
            old, reached = reached, scratch.keep(reached.unionAll(ahead).distinct())
            scratch.drop(old)
            now = reached.count()
            if now == n:
                break
            n = now
            old, jump = jump, scratch.keep(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("far")), ["file", "to"]).select("file", "at", F.col("far").alias("to")))
            scratch.drop(old)
        ends = archives.where("bytes > 0").select("file", F.col("bytes").alias("at"))
        broken = ends.join(reached, ["file", "at"], "left_anti").first()
        if broken:
            raise ValueError(f"{broken['file']}: the chain of records does not end at {broken['at']}")
        entry = reached.join(entries, ["file", "at"]).groupBy("file", "block").agg(F.min(F.struct("at", "steps")).alias("e"))
        entry = scratch.keep(entry.select("file", "block", F.col("e.at").alias("entry"), F.col("e.steps").alias("steps")), outlives=True)
    if "records" in archives.columns:
        counts = entry.groupBy("file").agg(F.sum("steps").alias("found"))
        broken = archives.join(counts, "file", "left").where("records <> coalesce(found, 0)").first()
        if broken:
            raise ValueError(f"{broken['file']}: {broken['found']} of {broken['records']} records in the chain")
    return parts.join(entry, ["file", "block"]).select("file", "bytes", "block", "lo", "hi", "entry")


def read_records(archives: DataFrame, folder: str, block: int = 4 << 20) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of every record in the chains.

    A response whose payload does not have its recorded digest raises an error, as does a chain that breaks off.
    """
    starts = boundaries(archives, folder, block)

    def run(batches):
        for b in batches:
            for name, size, _, lo, hi, entry in zip(*(c.to_pylist() for c in b.columns)):
                system, path = file_system(f"{folder}/{name}")
                rows = []
                with system.open_input_file(path) as f:
                    f.seek(entry)
                    data, at, base = f.read(hi - entry), 0, entry
                    while base + at < hi:
                        if len(data) - at < HEAD and base + len(data) < size:
                            data, base, at = data[at:] + f.read(HEAD), base + at, 0
                        data, end = _head_end(f, data, at, size - base - len(data))
                        got = _parse(data[at:end + len(BLANK)]) if end >= 0 else None
                        if got is None:
                            raise ValueError(f"{name}: no record at {base + at}")
                        start, fields = at + got[0], got[1]
                        end = start + int(fields["content-length"])
                        if end + 4 > len(data):
                            data += f.read(end + 4 - len(data))
                        body = data[start:end]
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if fields["warc-type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"{name}: payload at {base + start} has another digest")
                        whole = int(fields["x-payload-bytes"])
                        refers, page = fields.get("x-refers-to-page-id"), fields.get("x-page-id")
                        rows.append((int(page) if page else None, whole, digest, fields["warc-type"], int(refers) if refers else None, fields.get("warc-target-uri"), body))
                        at = end + 4
                for i in range(0, len(rows), 256):
                    cols = list(zip(*rows[i:i + 256]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return starts.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
