"""WARC archives: written by Spark's own writer, read back as one nested row per capture.

A page becomes a request, a response (or a revisit of an earlier response with the same payload) and a metadata record. Request and
metadata name the response in WARC-Concurrent-To. Reading splits archives into records and joins the records of
a capture through those headers, whichever side carries them and also at second hand (metadata that names the request).

Archives are files of whole records, of ``records_per_file`` at most from this writer; a reader holds one compressed file and unpacks it as a stream.
Files of other writers are read likewise, plain or gzip with one or more members.

Defined cases: a null payload is an empty one; a null url is left out of the headers; white space and control characters in a url are
percent-encoded; repeated rows give captures with the same ids, one per row of the table; an empty table gives an empty archive. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bestofk.session import materialise

CRLF = "\r\n"
#: Payloads below this size are never written as revisits.
REVISIT_FROM = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, kind string, concurrent_to array<string>, refers_to string, uri string, digest string, payload binary, payload_bytes bigint, payload_sha256 string, head string"
ANSWERS = ("response", "revisit")


def record_id(kind: str, page_id: Column, digest: Column) -> Column:
    """A urn:uuid made from the page id and the payload's digest, so that a repeated task writes the same record and no two payloads share one."""
    h = F.md5(F.concat(F.lit(kind + "|"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit("|"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def with_first(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """Adds payload_bytes, digest and first_id: the smallest page_id with the same payload, where it is another one.

    Only payloads that occur more than once are joined back; the aggregate has partial sums and the join can be
    split, so one payload may have any number of pages.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(
        "page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("digest")
    )
    shared = (
        pages.where(F.col("payload_bytes") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    )
    joined = pages.join(materialise(shared, "digests"), "digest", "left")
    return joined.withColumn("first_id", F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")))


def _record(headers: list[tuple[str, Column]], body: Column) -> Column:
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit("")))
    length = F.octet_length(body).cast("string")
    return F.concat(*lines, F.lit("Content-Length: "), length, F.lit(CRLF + CRLF), body)


def write_archives(pages: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 6000) -> None:
    """Writes ``pages`` (page_id, url, html) as gzip WARC files under ``path``."""
    rows = with_first(pages)
    pid, uri = F.col("page_id"), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    response, first = record_id("response", pid, digest), record_id("response", F.col("first_id"), digest)
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    answer = F.when(F.col("first_id").isNull(), _record(
        [("WARC-Type", F.lit("response")), ("WARC-Record-ID", response), *common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.col("html")),
    )).otherwise(_record(
        [("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", response), *common, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", first),
         ("WARC-Profile", F.lit(PROFILE)), ("Content-Type", F.lit("application/http; msgtype=response"))],
        http,
    ))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id("request", pid, digest)), *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id("metadata", pid, digest)), *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(pid.cast("string"), F.lit("")), F.lit(CRLF)),
    )
    (
        rows.select(F.explode(F.array(request, answer, metadata)).alias("value")).write
        .option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    )


#: Compressed bytes taken at once, and bytes a step unpacks at most.
TAKE, UNPACK = 1 << 18, 1 << 22


def _unpacked(content: bytes) -> Iterator[bytes]:
    """Content in pieces, gzip undone member after member."""
    view = memoryview(content)
    if content[:2] != b"\x1f\x8b":
        yield from (bytes(view[i : i + UNPACK]) for i in range(0, len(view), UNPACK))
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(view) or member.unconsumed_tail:
        data = member.unconsumed_tail or bytes(view[at : at + TAKE])
        if not member.unconsumed_tail:
            at += len(data)
        yield member.decompress(data, UNPACK)
        if member.eof:
            at -= len(member.unused_data)
            member = zlib.decompressobj(31)
            while at < len(view) and view[at] == 0:  # padding between members
                at += 1
    yield member.flush()


class _Buffer:
    """Bytes of a stream of pieces, as many as a record needs at a time."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.at, self.passed = pieces, bytearray(), 0, 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.passed += self.at
        del self.held[: self.at]
        self.at = 0
        self.held += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to ``mark``, which is passed over."""
        seen = 0
        while (end := self.held.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(mark))
            if not self.more():
                return None
        out, self.at = bytes(self.held[self.at : end]), end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self.more():
            pass
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out

    def skip_lines(self) -> bool:
        """Passes over line ends; False at the end of the stream."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in b"\r\n":
                self.at += 1
            if self.at < len(self.held):
                return True
            if not self.more():
                return False


def _records(pieces: Iterator[bytes]) -> Iterator[dict]:
    stream = _Buffer(pieces)
    while stream.skip_lines():
        begin = stream.passed + stream.at
        header = stream.until(b"\r\n\r\n")
        if header is None or not header.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {begin}")
        fields: dict[str, list[str]] = {}
        for line in header.decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        length = int(fields["content-length"][0])
        body = stream.take(length)
        if len(body) < length:
            raise ValueError(f"the record at byte {begin} is cut off")
        one = lambda name: fields.get(name, [None])[0]  # noqa: B023, E731
        head, payload = b"", body
        if (one("content-type") or "").startswith("application/http"):
            head, _, payload = body.partition(b"\r\n\r\n")
        yield {
            "record_id": one("warc-record-id"), "kind": one("warc-type"), "concurrent_to": fields.get("warc-concurrent-to", []),
            "refers_to": one("warc-refers-to"), "uri": one("warc-target-uri"), "digest": one("warc-payload-digest"),
            "payload": payload, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "head": head.decode("utf-8", "replace"),
        }


def read_records(spark: SparkSession, path: str, *, batch_bytes: int = 4_000_000, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``.

    ``payload_bytes`` and ``payload_sha256`` are measured on the payload as it is read. Without ``payloads`` those of
    responses and revisits are null. Archives are unpacked as a stream: a task holds one compressed file and the records of a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for row in _records(_unpacked(bytes(content))):
                    size += len(row["payload"])
                    if not payloads and row["kind"] in ANSWERS:
                        row["payload"] = None
                    rows.append(row)
                    if size >= batch_bytes:
                        yield pd.DataFrame(rows)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, kind, uri, digest, refers_to, head, payload, payload_bytes, request and metadata (nested, null if missing).

    Links go both ways: who names whom does not matter. A request or metadata record belongs to the answer it is linked with, else to the answer that
    a record linked with it belongs to. Records with no answer are not captures. Only ids move in the link joins; of several requests (or metadata records)
    of one capture the one with the smallest id is kept.
    """
    is_answer = F.col("kind").isin(*ANSWERS)
    ids = materialise(records.select("record_id", is_answer.alias("is_answer"), "concurrent_to"), "record-ids")
    named = ids.select(F.col("record_id").alias("x"), F.explode("concurrent_to").alias("y"))
    links = named.unionByName(named.select(F.col("y").alias("x"), F.col("x").alias("y")))
    answers = ids.where("is_answer").select(F.col("record_id").alias("y")).distinct()
    direct = links.join(answers, "y").groupBy("x").agg(F.min("y").alias("answer"))
    direct = materialise(direct, "links")
    second = (
        links.join(direct.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("answer").alias("answer_2"))
    )
    owner = direct.join(second, "x", "full").select(F.col("x").alias("record_id"), F.coalesce("answer", "answer_2").alias("answer"))
    others = (
        records.where(~is_answer & F.col("kind").isin("request", "metadata")).join(owner, "record_id")
        .groupBy("answer").pivot("kind", ["request", "metadata"])
        .agg(F.min(F.struct("record_id", "uri", "head", "payload")))
    )
    captures = records.where(is_answer).select("record_id", "kind", "uri", "digest", "refers_to", "head", "payload", "payload_bytes", "payload_sha256")
    return captures.join(others.withColumnRenamed("answer", "record_id"), "record_id", "left")


def with_full_payload(captures: DataFrame) -> DataFrame:
    """Adds page_id (from the metadata record), full_bytes, full_sha256 and refers_page: for a revisit those of the response it refers to."""
    page_id = F.regexp_extract(F.col("metadata.payload").cast("string"), r"page-id: (-?\d+)", 1)
    own = captures.withColumn("page_id", F.when(page_id != "", page_id.cast("long")))
    target = own.where("kind = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_page"), F.col("payload_bytes").alias("target_bytes"),
        F.col("payload_sha256").alias("target_sha256"))
    target = materialise(target.dropDuplicates(["refers_to"]), "responses")
    return own.join(target, "refers_to", "left").withColumns({
        "full_bytes": F.coalesce("target_bytes", "payload_bytes"), "full_sha256": F.coalesce("target_sha256", "payload_sha256"),
    }).drop("target_bytes", "target_sha256")
