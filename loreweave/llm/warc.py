"""WARC (operator 13): pages as records in archive files, and back. Long records are split into segments; reading groups
continuations by the record they continue, orders them by number, verifies the length and decodes the chunked framing."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import dropped, sent_if_small, written

#: The line that begins every record, and what stands behind it.
BEGIN, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a record's block at most, and of a chunk of its body.
SEGMENT_BYTES, CHUNK_BYTES = 1 << 14, 1 << 12
#: Bytes of records in a batch that leaves a task.
BATCH_BYTES = 8 << 20
#: How the id of a page's record begins; its page_id and digits of a hash follow.
HEAD = "urn:x-page:"
#: A block has no such place undivided.
MARK = (b"WARC/", b"1.1")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing. No chunk holds the line that begins a record, so that archives can be split at it."""
    out = []
    for piece in re.split(b"(?<=%b)(?=%b)" % tuple(map(re.escape, MARK)), payload):
        out += [b"%x\r\n%b\r\n" % (len(piece[i : i + size]), piece[i : i + size]) for i in range(0, len(piece), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken or ends early. Extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response: what follows its header, without transfer framing."""
    head, parted, body = block.partition(b"\r\n\r\n")
    if not parted:
        raise ValueError("no end of the header")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked[ \t]*\r?$", head) else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the separator behind it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return BEGIN + lines.encode() + b"\r\n" + block


def records(fields: list[tuple[str, str]], record_id: str, block: bytes, most: int) -> Iterator[bytes]:
    """One record, or a first segment and its continuations."""
    pieces = [block[i : i + most] for i in range(0, len(block), most)] or [b""]
    if len(pieces) == 1:
        yield record([*fields, ("WARC-Record-ID", f"<{record_id}>")], block)
        return
    yield record([*fields, ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Segment-Number", "1")], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] * (n == len(pieces))
        yield record([("WARC-Type", "continuation"), fields[1], ("WARC-Record-ID", f"<{record_id}:{n}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(n)), *last], piece)


def _plain_uri(url: str | None) -> str:
    """A target URI in one line: control characters and blanks are escaped, and what could end in a line that begins a record."""
    return re.sub(r"[\x00-\x20\x7f]|(?<=WARC)/(?=1\.1)", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, date: str = "1970-01-01T00:00:00Z", revisits_most: int = 32 << 20) -> None:
    """Writes an archive file per task below path: a response record per row, its payload html in UTF-8 (null: empty).

    Of rows with equal payloads of least_bytes or more, that with the smallest page_id (null before all) has the response;
    the others are revisits that refer to it. Where rows share that page_id too, one of them has the response; rows alike in page_id,
    url and html have equal records. Blocks above segment_bytes are split into segments. Spark's committer writes the
    files, one string per record, so a lost task leaves one copy; they are uncompressed, and split at record boundaries when
    read. An empty table gives an empty folder. Other columns are not looked at.
    """
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    p = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), text.alias("html"))
    digest = F.sha2("html", 256)
    name = F.concat(F.lit(HEAD), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(":"), F.substring(F.sha2(F.concat_ws("|", F.coalesce("url", F.lit("")), digest), 256), 1, 16))
    p = p.withColumn("name", name).withColumn("digest", digest)
    same = p.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "name")).alias("of")).where("n > 1")
    same = written(same.select("digest", F.col("of.name").alias("of")), "equal-payloads")
    known = sent_if_small(same, "digest", 160, revisits_most)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        size = 0
        for batch in batches:
            for address, text, own, of in zip(batch.column("url").to_pylist(), batch.column("html").cast(pa.binary()), batch.column("name").to_pylist(), batch.column("of").to_pylist()):
                payload, revisit = text.as_py(), of is not None and of != own
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", date), ("WARC-Target-URI", _plain_uri(address)), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response")]
                fields += [("WARC-Refers-To", f"<{of}>"), ("WARC-Profile", PROFILE)] * revisit
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                for r in records(fields, own, head if revisit else head + chunked(payload), segment_bytes):
                    out.append(r)
                    size += len(r)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = p.join(known, "digest", "left").select("url", "html", "name", "of").mapInArrow(made, "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).text(path)
    dropped(same)


def _parsed(body: bytes) -> tuple[dict[str, str], bytes]:
    """Fields by lower-case name, and the block; ValueError if the record is not whole."""
    head, parted, rest = body.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        k, colon, v = line.partition(":")
        if colon:
            fields[k.strip().lower()] = v.strip()
    size = int(fields.get("content-length", -1))
    if not parted or size < 0 or len(rest) < size:
        raise ValueError("a record ends early")
    return fields, rest[:size]


PARSED = "kind string, name string, origin string, segment long, total long, uri string, digest string, refers_to string, block binary, payload_bytes long, payload_digest string, fault string"
READ = "name string, copies long, kind string, uri string, digest string, refers_to string, payload_bytes long, payload_digest string, payload binary, fault string"


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record (segments joined) of the archives below path: name, kind, uri, digest and refers_to as its fields
    tell them, payload_bytes and payload_digest of the payload read (and payload, if asked), and fault: null, or what is wrong.

    Continuations meet at the record they continue, in order of their numbers; a missing segment, a wrong total length, broken
    chunks or a digest that differs make a fault, and so does a record shorter than it says. Segments that came twice,
    alike, with their record count as many records. Revisits have no payload of their own. Files are read in splits, so the line that begins a
    record must not stand in a block, as write_warc sees to; a record torn by one is a fault.
    """
    lines = spark.read.option("lineSep", BEGIN.decode()).text(path).where(F.octet_length("value") > 0).select(F.col("value").cast("binary").alias("value"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = lambda x: x and x.strip("<>")
        names = [c.split(" ")[0] for c in PARSED.split(", ")]
        kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        arrow = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in PARSED.split(", ")])
        for batch in batches:
            out = []
            for x in batch.column("value"):
                try:
                    f, block = _parsed(x.as_py())
                except ValueError as e:
                    out.append({"kind": "response", "fault": str(e)})
                    continue
                if f.get("warc-type") not in ("response", "revisit", "continuation"):
                    continue
                name, origin = bare(f.get("warc-record-id")), bare(f.get("warc-segment-origin-id"))
                row = {"kind": f["warc-type"], "name": name, "origin": origin or name, "uri": f.get("warc-target-uri"), "digest": (f.get("warc-payload-digest") or "").rpartition(":")[2] or None, "refers_to": bare(f.get("warc-refers-to"))}
                row |= {"segment": int(f.get("warc-segment-number", 0)), "total": int(t) if (t := f.get("warc-segment-total-length")) else None}
                if row["segment"] or with_payload:
                    row["block"] = block
                elif row["kind"] == "response":
                    row |= _read(block, row["digest"])[1]
                out.append(row)
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in out], arrow)

    each = lines.mapInArrow(parsed, PARSED)
    alone = each.where("segment = 0 or segment is null")
    part = each.where("segment > 0").groupBy("origin", "segment", "block").agg(F.count("*").alias("copies"), *[F.max(c).alias(c) for c in ("total", "uri", "digest", "refers_to")], F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"))
    whole = part.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "block", "copies"))).alias("s"), *[F.max(c).alias(c) for c in ("total", "uri", "digest", "refers_to", "kind")])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                block, fault, copies = b"".join(s["block"] or b"" for s in r["s"]), None, min(s["copies"] for s in r["s"])
                if [s["segment"] for s in r["s"]] != list(range(1, len(r["s"]) + 1)) or r["kind"] is None:
                    fault = "a segment is missing"
                elif r["total"] != len(block):
                    fault = "the segments have another length"
                payload, told = _read(block, r["digest"]) if fault is None and r["kind"] == "response" else (None, {"payload_bytes": None, "payload_digest": None, "fault": fault})
                yield pa.RecordBatch.from_pylist([{"name": r["origin"], "copies": copies, "kind": r["kind"] or "response", "uri": r["uri"], "digest": r["digest"], "refers_to": r["refers_to"], **told, "payload": payload if with_payload else None}], _read_schema())

    long = whole.mapInArrow(joined, READ).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
    if with_payload:
        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    payload, told = _read(r["block"], r["digest"]) if r["fault"] is None and r["kind"] == "response" else (None, {"payload_bytes": None, "payload_digest": None, "fault": r["fault"]})
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in ("name", "kind", "uri", "digest", "refers_to")} | {"copies": 1, "payload": payload} | told], _read_schema())

        single = alone.mapInArrow(opened, READ).drop("copies")
    else:
        single = alone.withColumn("payload", F.lit(None).cast("binary"))
    columns = ["name", "kind", "uri", "digest", "refers_to", "payload_bytes", "payload_digest", "fault", *["payload"] * with_payload]
    return single.select(columns).unionByName(long.select(columns))


def _read_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in READ.split(", ")])


def _read(block: bytes, digest: str | None) -> tuple[bytes | None, dict]:
    """A response's payload, and its size, its digest and what is wrong with it."""
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, {"payload_bytes": None, "payload_digest": None, "fault": str(e)}
    own = base32_sha1(payload)
    return payload, {"payload_bytes": len(payload), "payload_digest": own, "fault": None if digest in (None, own) else "the payload has another digest"}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, fault of every record that write_warc wrote. A revisit
    has the size of the payload it refers to; a missing one, or another digest there, is its fault."""
    page = lambda c: F.regexp_extract(c, f"^{HEAD}(-?[0-9]+):", 1).try_cast("long")
    told = written(read_records(spark, path), "records")
    first = told.where("kind = 'response'").select(F.col("name").alias("refers_to"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest")).distinct()
    again = told.where("kind = 'revisit'").join(first, "refers_to", "left")
    fault = F.when(F.col("of_digest").isNull(), F.lit("no record to refer to")).when(~F.col("of_digest").eqNullSafe(F.col("digest")), F.lit("the payload has another digest"))
    rows = told.where("kind = 'response'").select(page(F.col("name")).alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "fault")
    return rows.unionByName(again.select(page(F.col("name")).alias("page_id"), F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), page(F.col("refers_to")).alias("refers_to"), F.coalesce("fault", fault).alias("fault")))
