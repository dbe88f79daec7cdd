"""Legacy ARC archives, and their conversion to WARC.

Both kinds are written as one gzip member per record. ARC header lines follow the version that
the archive's first record declares; the body has the length that the line declares.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import new_path

from .common import small_batches, written
from .storage import new_name, open_folder, read_exactly

# Fixed values of the formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum",
        "Location", "Offset", "Filename", "Archive-length"],
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20  # of records before compression
NO_URL = "urn:unknown"
FAST = 1
ROW_HEADER = "X-Row-Id"


@dataclass
class ArcRecord:
    number: int
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    record_id: str

    @property
    def is_http(self) -> bool:
        return self.block.startswith(b"HTTP/")

    @property
    def head(self) -> bytes:
        """HTTP header lines with the empty line; nothing for other protocols."""
        end = self.block.find(b"\r\n\r\n") if self.is_http else -1
        return self.block[:end + 4] if end >= 0 else b""

    @property
    def payload(self) -> bytes:
        return self.block[len(self.head):]


def arc_name(name: str) -> str:
    return f"filedesc://{name}"


def arc_record(version: int, values: dict[str, str], body: bytes) -> bytes:
    line = " ".join({**dict.fromkeys(ARC_FIELDS[version], "-"), **values,
                     "Archive-length": str(len(body))}[f] for f in ARC_FIELDS[version])
    return gzip.compress(line.encode() + b"\n" + body + b"\n", FAST)


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tallymark\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(version, {"URL": arc_name(name), "IP-address": "0.0.0.0",
                                "Archive-date": date, "Content-type": "text/plain"}, body)


def plain_url(url: str | None) -> str:
    """One word, as a header line needs it."""
    return "".join(c if c > " " and c != "\x7f" and not c.isspace()
                   else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass"))
                   for c in url) if url else NO_URL


def page_block(row_id, payload: bytes) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8",
             f"Content-Length: {len(payload)}"]
    if row_id is not None:
        lines.append(f"{ROW_HEADER}: {row_id}")
    return "\r\n".join([*lines, "", ""]).encode() + payload


def http_header(head: bytes, name: str) -> str | None:
    want = name.lower().encode() + b":"
    for line in head.split(b"\r\n")[1:]:
        if line.lower().startswith(want):
            return line[len(want):].strip().decode("latin-1")
    return None


def read_arc(stream) -> Iterator[ArcRecord]:
    """Records after the version block; the block says which header fields a line has."""
    fields: list[str] = ARC_FIELDS[1]
    name, number = "", 0
    while line := stream.readline():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text.strip():
            continue  # between records
        if number == 0:
            # The version block's own line has the fields of the version that follows.
            declared = text.rsplit(" ", 1)[-1]
            body = read_exactly(stream, int(declared))
            version = int(body.split(b" ", 1)[0])
            fields = body.split(b"\n")[1].decode().split() or ARC_FIELDS[version]
            name = text.split(" ", 1)[0].removeprefix("filedesc://")
            number = 1
            continue
        values = dict(zip(fields, text.rsplit(" ", len(fields) - 1)))
        if len(values) != len(fields) or not values["Archive-length"].isdigit():
            raise ValueError(f"{name}, record {number}: not a header line: {text[:100]!r}")
        block = read_exactly(stream, int(values["Archive-length"]))
        yield ArcRecord(number, values["URL"], values["IP-address"], values["Archive-date"],
                        values["Content-type"], block,
                        f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{arc_name(name)}#{number}')}")
        number += 1


def timestamp(date: str) -> str:
    """ARC dates have 14 digits, in old archives fewer."""
    d = date.ljust(8, "0")[:8] + date[8:].ljust(6, "0")[:6]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def warc_record(kind: str, record_id: str, date: str, block: bytes, **headers: str) -> bytes:
    lines = [WARC_VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>",
             f"WARC-Date: {date}", f"WARC-Block-Digest: sha256:{sha256(block)}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n", FAST)


def convert(record: ArcRecord, refers: dict | None) -> bytes:
    """The WARC record with the same content; a revisit keeps only the HTTP header."""
    payload = record.payload
    common = {"WARC_Target_URI": record.url,
              "WARC_Payload_Digest": f"sha256:{sha256(payload)}"}
    if record.ip != "0.0.0.0":
        common["WARC_IP_Address"] = record.ip
    if not record.is_http:
        return warc_record("resource", record.record_id, timestamp(record.date), record.block,
                           Content_Type=record.mime, **common)
    common["Content_Type"] = "application/http; msgtype=response"
    if refers is None:
        return warc_record("response", record.record_id, timestamp(record.date), record.block,
                           **common)
    return warc_record(
        "revisit", record.record_id, timestamp(record.date), record.head,
        WARC_Profile=REVISIT_PROFILE, WARC_Refers_To=f"<{refers['record_id']}>",
        WARC_Refers_To_Target_URI=refers["url"],
        WARC_Refers_To_Date=timestamp(refers["date"]), **common)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:60]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        yield headers, read_exactly(stream, int(headers["content-length"]))


def write_arc(pages: DataFrame, versions: tuple[int, ...] = (1, 2), date: str = "20240101000000",
              id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write each row as an HTTP response into legacy archives of bounded size.

    Returns the list of archives (folder, file, n_records). Tasks take the versions in turn. A
    null body is empty; a null or empty url becomes a placeholder, white space in it is escaped.
    Rows with a null or repeated id are records of their own. An empty table gives a list without
    files; columns but the three named are not read.
    """
    folder = new_path(pages.sparkSession, "arc")

    def write(batches):
        fs, root = open_folder(folder)
        part = TaskContext.get().partitionId()
        version = versions[part % len(versions)]
        out, files = None, []
        for batch in batches:
            for row_id, url, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if out is None or size > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"part-{part:06d}-{len(files):04d}"
                    files.append([new_name(name, ".arc.gz"), 0])
                    out, size = fs.open_output_stream(f"{root}/{files[-1][0]}"), 0
                    out.write(version_block(version, name, date))
                block = page_block(row_id, (body or "").encode("utf-8", "surrogatepass"))
                out.write(arc_record(version, {
                    "URL": plain_url(url), "IP-address": "0.0.0.0", "Archive-date": date,
                    "Content-type": "text/html", "Result-code": "200"}, block))
                size += len(block)
                files[-1][1] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([folder] * len(files), pa.string()), pa.array([f[0] for f in files],
             pa.string()), pa.array([f[1] for f in files], pa.int64())],
            ["folder", "file", "n_records"])

    small_batches(pages.sparkSession)
    return written(pages.select(id_col, url_col, F.col(body_col).cast("string"))
                   .mapInArrow(write, "folder string, file string, n_records long"), "arc-files")


def spread(files: DataFrame) -> DataFrame:
    """A task per archive, about."""
    return files.repartition(max(1, files.count()))


def arc_index(archives: DataFrame) -> DataFrame:
    """A row per record, without its content."""
    schema = ("file string, number long, record_id string, url string, date string, "
              "row_id long, bytes long, digest string, is_http boolean")
    names = [x.strip().split()[0] for x in schema.split(",")]

    def scan(batches):
        for batch in batches:
            for f in batch.to_pylist():
                fs, root = open_folder(f["folder"])
                rows = []
                with fs.open_input_stream(f"{root}/{f['file']}") as raw, gzip.open(raw) as stream:
                    for r in read_arc(stream):
                        row_id = http_header(r.head, ROW_HEADER)
                        rows.append((f["file"], r.number, r.record_id, r.url, r.date,
                                     int(row_id) if row_id else None, len(r.payload),
                                     sha256(r.payload), r.is_http))
                columns = list(zip(*rows)) or [[] for _ in names]
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(),
                         pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names)

    return spread(archives.select("folder", "file")).mapInArrow(scan, schema)


def revisits(index: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """The records that repeat an earlier one's payload, per file, with what they refer to.

    The earliest date keeps the content, then the smallest row id (none last), then the record
    id. One row per payload is kept before the join, and only of payloads that repeat.
    """
    order = F.struct("date", F.coalesce("row_id", F.lit(2 ** 63 - 1)), "record_id")
    same = index.filter(F.col("is_http") & (F.col("bytes") >= least_bytes))
    firsts = same.groupBy("digest").agg(
        F.min_by(F.struct("record_id", "url", "date"), order).alias("first"),
        F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    return (same.join(firsts, "digest").filter("record_id != first.record_id")
            .groupBy("file").agg(F.collect_list(F.struct(
                "number", "first.record_id", "first.url", "first.date")).alias("revisits")))


def convert_archives(archives: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES,
                     folder: str | None = None) -> DataFrame:
    """One WARC file per ARC file; returns the written list (folder, file, n_records).

    The files go to `folder`, by default one in the shared folder for intermediate data.

    HTTP records become `response`, or `revisit` if an earlier record has the same payload of
    at least `least_bytes` bytes; others become `resource`. Record ids derive from the archive's
    own name and the record's number, so a repeated run gives the same ids. Archives are read
    twice: once for lengths and digests, once to convert, each in one stream. Equal records are
    records of their own, the first a response; an empty list gives an empty list; columns but
    folder, file and n_records are not read.
    """
    index = written(arc_index(archives), "arc-index")
    folder = folder or new_path(archives.sparkSession, "warc")
    work = archives.join(revisits(index, least_bytes), "file", "left")

    def write(batches):
        for batch in batches:
            for f in batch.to_pylist():
                refers = {r["number"]: r for r in f["revisits"] or ()}
                source, root = open_folder(f["folder"])
                fs, target = open_folder(folder)
                name = new_name(f["file"].rsplit("-", 1)[0], ".warc.gz")
                n = 0
                with source.open_input_stream(f"{root}/{f['file']}") as raw, \
                        gzip.open(raw) as stream, \
                        fs.open_output_stream(f"{target}/{name}") as out:
                    out.write(warc_record(
                        "warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}",
                        "2024-01-01T00:00:00Z", b"software: tallymark\r\nformat: WARC 1.1\r\n",
                        WARC_Filename=name, Content_Type="application/warc-fields"))
                    for record in read_arc(stream):
                        out.write(convert(record, refers.get(record.number)))
                        n += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([folder]), pa.array([name]), pa.array([n])],
                    ["folder", "file", "n_records"])

    done = spread(work.select("folder", "file", "revisits")).mapInArrow(
        write, "folder string, file string, n_records long")
    return written(done, "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """A row per WARC record but warcinfo: row_id, url, date, record_type, record_id,
    refers_to_id, payload_bytes and payload_digest (of the full payload, also for revisits),
    payload (null for revisits). A file listed twice gives its records twice, an empty list none;
    other columns of the list are not read."""
    types = {"row_id": pa.int64(), "url": pa.string(), "date": pa.string(),
             "record_type": pa.string(), "record_id": pa.string(), "refers_to_id": pa.string(),
             "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())],
            list(types))

    def read(batches):
        for batch in batches:
            for f in batch.to_pylist():
                fs, root = open_folder(f["folder"])
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{f['file']}") as raw, gzip.open(raw) as stream:
                    for headers, block in read_warc(stream):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        row = warc_row(headers, block)
                        rows.append(row)
                        size += len(block)
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                yield batch_of(rows)

    return spread(files.select("folder", "file")).mapInArrow(
        read, "row_id long, url string, date string, record_type string, record_id string, "
        "refers_to_id string, payload_bytes long, payload_digest string, payload binary")


def warc_row(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers["warc-type"]
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    head, payload = (block[:end + 4], block[end + 4:]) if end >= 0 else (b"", block)
    if kind == "revisit":
        length, digest = int(http_header(head, "Content-Length")), None
        payload = None
    else:
        length, digest = len(payload), sha256(payload)
    declared = headers["warc-payload-digest"].removeprefix("sha256:")
    if digest not in (None, declared):
        raise ValueError(f"{headers['warc-record-id']}: payload and digest differ")
    row_id = http_header(head, ROW_HEADER)
    return (int(row_id) if row_id else None, headers.get("warc-target-uri"),
            headers["warc-date"], kind, headers["warc-record-id"].strip("<>"),
            headers["warc-refers-to"].strip("<>") if kind == "revisit" else None,
            length, declared, payload)


def with_referred_rows(records: DataFrame) -> DataFrame:
    """`records` with refers_to, the row_id of the record that a revisit refers to."""
    rows = records.select("row_id", "payload_bytes", "payload_digest", "record_type",
                          "record_id", "refers_to_id")
    rows = written(rows, "warc-rows")
    owners = rows.filter("record_type != 'revisit'").join(
        rows.select(F.col("refers_to_id").alias("record_id")).filter(
            "record_id IS NOT NULL").distinct(), "record_id").select(
        F.col("record_id").alias("refers_to_id"), F.col("row_id").alias("refers_to"))
    return rows.join(owners, "refers_to_id", "left")
