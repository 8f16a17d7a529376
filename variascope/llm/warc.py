"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing: each task writes its pages as gzip members, one per record, into archives of its own and returns the index
rows (archive, offset, length, URL, digest). The index is a Parquet table; only rows of tasks that succeeded are in
it, so archives of lost or repeated attempts are never referred to. Of pages with equal payloads of at least
``least`` bytes the one with the largest id is a response, the others are revisit records without a payload. Digests
that may repeat are found with a Bloom filter (``bloom``); only those pages shuffle.

Reading: the selected index rows are sorted by archive and offset, ranges with gaps of at most ``gap`` bytes are
joined into reads of at most ``most`` bytes, and each record is cut from its read, parsed and checked by its digest.

Archives are opened with ``pyarrow.fs``, so the folder may be any file system it knows (file, hdfs, s3, gs); the
default is the shared checkpoint folder.

Defined cases: a null html is an empty payload, a null URL is left out; a page with a null id never stands for
others; pages repeated with id and payload are all responses when that id is the largest; an empty table gives an
empty index; only the id, the URL and the html columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variascope.llm import bloom
from variascope.llm.io import written
from variascope.plans.lineage import scratch

INDEX = "archive string, offset long, length long, url string, digest string, page_id {id}, record_type string"
RECORD = "page_id {id}, url string, record_type string, refers_to {id}, payload_bytes long, payload_digest string, payload binary"

# Fixed value: the profile of a revisit record with an identical payload.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    if folder.startswith("/"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit record, which leaves the payload out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=~-._' + chr(39))}"]),
        *([] if page_id is None else [f"X-Page-Id: {page_id}"]),
        *([f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{base32}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    header = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(header["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {header['WARC-Record-ID']} has a wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    return header, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _packed(raw: bytes, level: int) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def planned(pages: DataFrame, *, key: str, url: str, html: str, least: int) -> DataFrame:
    """(_id, _url, _html, _digest, _refers): every page and, for revisits, the page that holds the payload."""
    rows = pages.select(
        F.col(key).alias("_id"), F.col(url).alias("_url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("_html")
    )
    rows = rows.withColumn("_digest", F.sha1("_html")).withColumn("_bytes", F.octet_length("_html").cast("long"))
    narrow = written(rows.select("_id", "_digest", "_bytes"), "digests")
    bits = bloom.bits_for(narrow.count())
    words = bloom.repeated(narrow, "_digest", bits)
    maybe = bloom.flag(narrow.where(F.col("_bytes") >= least), "_digest", words, bits, "_maybe").where("_maybe")
    best = maybe.groupBy("_digest", "_bytes").agg(F.max("_id").alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    best = written(best.drop("_n"), "best")
    flagged = bloom.flag(rows, "_digest", words, bits, "_maybe").withColumn("_maybe", F.col("_maybe") & (F.col("_bytes") >= least))
    kind = pages.schema[key].dataType
    once = flagged.where(~F.col("_maybe")).select("_id", "_url", "_html", "_digest", F.lit(None).cast(kind).alias("_refers"))
    more = flagged.where("_maybe").join(best, ["_digest", "_bytes"], "left")
    refers = F.when(~F.col("_best").eqNullSafe(F.col("_id")), F.col("_best"))
    return once.unionByName(more.select("_id", "_url", "_html", "_digest", refers.alias("_refers")))


def write(
    pages: DataFrame,
    folder: str | None = None,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = 1000,
    level: int = 3,
    archive_bytes: int = 1 << 30,
) -> tuple[DataFrame, str]:
    """Write the archives; (index read from its table, folder)."""
    spark = pages.sparkSession
    folder = folder or scratch(spark)
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    schema = INDEX.format(id=pages.schema[key].dataType.simpleString())

    def run(batches):
        files, root = open_folder(folder)
        files.create_dir(f"{root}/archives", recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for page, address, body, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/archives/{name}", compression=None)
                        info = b"software: variascope\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        first = _packed(head.encode() + info + b"\r\n\r\n", level)
                        out.write(first)
                        at = len(first)
                    member = _packed(record_bytes(page, address, body, digest, refers, date), level)
                    out.write(member)
                    found.append((name, at, len(member), address, digest, page, "response" if refers is None else "revisit"))
                    at += len(member)
                columns = list(zip(*found)) or [()] * 7
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), batch.schema.field(0).type, pa.string()]
                names = ["archive", "offset", "length", "url", "digest", "page_id", "record_type"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        finally:
            if out is not None:
                out.close()

    planned(pages, key=key, url=url, html=html, least=least).mapInArrow(run, schema).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index"), folder


def ranges(rows: list[tuple[str, int, int]], gap: int, most: int):
    """Groups (archive, begin, end, rows) of sorted (archive, offset, length) rows that one read serves."""
    group, archive, begin, end = [], None, 0, 0
    for k, (name, offset, length) in enumerate(rows):
        if group and (name != archive or offset > end + gap or offset + length - begin > most):
            yield archive, begin, end, group
            group = []
        if not group:
            archive, begin, end = name, offset, offset
        group.append(k)
        end = max(end, offset + length)
    if group:
        yield archive, begin, end, group


def read(index: DataFrame, folder: str, *, gap: int = 64 << 10, most: int = 8 << 20, payload: bool = True) -> DataFrame:
    """The records of the index rows; digests of payloads are checked, those of revisits come from their headers."""
    kind = index.schema["page_id"].dataType.simpleString()
    schema = RECORD.format(id=kind)

    def run(batches):
        files, root = open_folder(folder)
        opened, name = None, None
        try:
            for batch in batches:
                rows = list(zip(*(c.to_pylist() for c in batch.columns)))
                for archive, begin, end, group in ranges(rows, gap, most):
                    if archive != name:
                        if opened is not None:
                            opened.close()
                        opened, name = files.open_input_file(f"{root}/archives/{archive}"), archive
                    piece = opened.read_at(end - begin, begin)
                    yield parsed([zlib.decompress(piece[rows[k][1] - begin : rows[k][1] - begin + rows[k][2]], 31) for k in group], batch)
        finally:
            if opened is not None:
                opened.close()

    whole = int if kind in ("bigint", "int", "smallint", "tinyint") else str
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def parsed(raws, batch):
        out = []
        for raw in raws:
            header, http, body = parse_record(raw)
            digest = base64.b32decode(header["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            if header["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                raise ValueError(f"record {header['WARC-Record-ID']} does not have its digest")
            ids = [None if (v := header.get(n)) is None else whole(v) for n in ("X-Page-Id", "X-Refers-To-Page-Id")]
            kept = body if payload and header["WARC-Type"] == "response" else None
            out.append((ids[0], header.get("WARC-Target-URI"), header["WARC-Type"], ids[1], int(http["Content-Length"]), digest, kept))
        types = [id_type, pa.string(), pa.string(), id_type, pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), types)],
            ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"],
        )

    ordered = index.select("archive", "offset", "length").repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, schema)
