"""Zstandard WARC archives: a writer and a reader of one frame a record, with a dictionary in a leading skippable frame.

A file is a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself plain or compressed, then one
Zstandard frame for each record. The reader streams a file frame by frame, and checks of each record the version line,
the mandatory fields, that the block has Content-Length bytes, that CR LF CR LF and nothing else follows, and the
payload's digest; what fails is in the column `problem`, null for a sound record. Bytes that can't be decoded give one
row with a problem, and reading goes on with the next frame magic from which a whole frame decodes.

Tables: pages (page_id, url, html); other columns aren't read. A null html is an empty payload, a null url is left out
of the record. Of records with equal payloads of at least MIN_REVISIT bytes, that with the largest page_id is the
response and the others revisit it; rows that share that page_id are all responses, and a null page_id always revisits if any
other has one. Smaller payloads are responses. An empty table gives an empty archive and result.

Files are written with pyarrow's file systems to a folder whose address Hadoop resolves once, on the driver: a path
without a scheme is the cluster's default file system's, a mounted one is what it is mounted on, s3a is S3. Names are unique
to an attempt, and only those in the manifest, which Spark commits, are read. So lost and repeated tasks leave nothing
behind that counts.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.llm.common import discard, materialise, ready, remove
from tileflow.plans.lineage import shared_path

MIN_REVISIT = 1000
#: Uncompressed bytes after which a task begins another file, and of records that a file's dictionary is made from.
FILE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 32 << 20, 1 << 20, 16 << 10
READ_BYTES, PIECE_BYTES = 1 << 20, 8 << 10
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "path string, record_id string, record_type string, target_uri string, page_id long, payload binary, payload_bytes long, payload_digest string, refers_to long, problem string"


def record_kinds(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and refers_to: the page a record revisits, null for a response."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    first = read.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("first"))
    revisits = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first"))) & (F.octet_length("payload") >= min_revisit)
    return read.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(revisits, F.col("first")).alias("refers_to"))


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _record(fields: list[tuple[str, str | int]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit whose HTTP head still states the payload's length."""
    uri = [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))] if url else []
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", DATE), *uri, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _id(refers_to))]
    return _record(fields, http + (payload if refers_to is None else b""))


def info_record() -> bytes:
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s[: 64 << 10] for s in samples]) if len(samples) >= 16 else None
    except zstandard.ZstdError:  # too little to learn from: a file may do without
        return None


def resolved(spark: SparkSession, folder: str) -> str:
    """The folder, made if need be, as an address that every machine understands alike."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return address(fs.resolvePath(path).toString())


def address(uri: str) -> str:
    """A Hadoop URI as pyarrow writes it."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return re.sub(r"^file:/+", "file:///", uri)


class Writer:
    """Writes records to files below a folder; each file's first records make its dictionary."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSystem

        self.fs, self.folder = FileSystem.from_uri(folder)
        self.scheme = folder[: len(folder) - len(self.folder)] if folder.endswith(self.folder) else ""
        self.fs.create_dir(self.folder, recursive=True)
        self.held: list[bytes] = []
        self.held_bytes, self.out = 0, None

    def add(self, record: bytes) -> Iterator[tuple[str, int]]:
        if self.out is None:
            self.held.append(record)
            self.held_bytes += len(record)
            if self.held_bytes >= SAMPLE_BYTES:
                self._open()
        else:
            self._put(record)
        if self.out is not None and self.written >= FILE_BYTES:
            yield self._close()

    def _open(self) -> None:
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        self.out, self.written, self.records = self.fs.open_output_stream(self.path, compression=None), 0, 0
        learned = _dictionary(self.held)
        if learned:
            raw = learned.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=learned, write_checksum=True) if learned else zstandard.ZstdCompressor(level=3, write_checksum=True)
        self._put(info_record())
        for r in self.held:
            self._put(r)
        self.held, self.held_bytes = [], 0

    def _put(self, record: bytes) -> None:
        self.out.write(self.zstd.compress(record))
        self.written += len(record)
        self.records += 1

    def _close(self) -> tuple[str, int]:
        self.out.close()
        self.out = None
        return self.scheme + self.path, self.records - 1

    def finish(self) -> Iterator[tuple[str, int]]:
        if self.held:
            self._open()
        if self.out is not None:
            yield self._close()


def write_archives(spark: SparkSession, kinds: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of record_kinds(); returns the manifest (path, records) of the files that count."""
    ready(spark)
    folder = resolved(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder)

        def rows(files: list[tuple[str, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in files], pa.string()), pa.array([n for _, n in files], pa.int64())], ["path", "records"])

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if done := list(writer.add(page_record(*row))):
                    yield rows(done)
        if done := list(writer.finish()):
            yield rows(done)

    return materialise(spark, kinds.mapInArrow(write, "path string, records long"), "warc-manifest")


def frames(stream) -> Iterator[bytes | Exception]:
    """Each frame's content from a file-like of bytes, the leading dictionary applied; an error for each stretch that can't be decoded."""
    data, at = b"", 0
    decoder, first, lost = zstandard.ZstdDecompressor(), True, False

    def more() -> bool:
        nonlocal data, at
        new = stream.read(READ_BYTES)
        data, at = data[at:] + new, 0
        return bool(new)

    def decode() -> bytes:
        nonlocal at
        one, parts, used, size = decoder.decompressobj(), [], 0, PIECE_BYTES
        while not one.eof:
            if at + used == len(data) and not more():
                raise ValueError("the frame is cut off")
            piece = data[at + used : at + used + size]
            try:
                parts.append(one.decompress(piece))
            except zstandard.ZstdError as e:
                raise ValueError(f"the frame can't be decoded: {e}") from e
            used += len(piece) - len(one.unused_data)
            size = min(2 * size, READ_BYTES)
        at += used
        return b"".join(parts)

    while True:
        while len(data) - at < 8 and more():
            pass
        if at == len(data):
            return
        magic = struct.unpack_from("<I", data, at)[0] if len(data) - at >= 4 else 0
        try:
            if len(data) - at >= 8 and magic in SKIPPABLE:
                size = 8 + struct.unpack_from("<I", data, at + 4)[0]
                while len(data) - at < size and more():
                    pass
                if len(data) - at < size:
                    raise ValueError("the skippable frame is cut off")
                if first and magic == DICTIONARY_MAGIC:
                    raw = data[at + 8 : at + size]
                    try:
                        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw) if raw[:4] == FRAME_MAGIC else raw
                        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                    except zstandard.ZstdError as e:
                        raise ValueError(f"the dictionary can't be read: {e}") from e
                at += size
            else:
                found = decode()
                lost = False
                yield found
        except ValueError as e:
            if not lost:
                yield e
            lost = True
            while (there := data.find(FRAME_MAGIC, at + 1)) < 0:
                at = max(at, len(data) - 4)
                if not more():
                    return
            at = there
        first = False


def _fields(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:40]!r}")
        found.setdefault(name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip())
    return found


def _page(record_id: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(m[1]) if m else None


def parse_record(raw: bytes) -> dict:
    """One record's columns of RECORD_SCHEMA but path; problem tells what is wrong, if anything."""
    out = dict.fromkeys(("record_id", "record_type", "target_uri", "page_id", "payload", "payload_bytes", "payload_digest", "refers_to", "problem"))
    try:
        head, end, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.split(b"\r\n")
        if not end or version not in VERSIONS:
            raise ValueError("no version line" if version not in VERSIONS else "the header doesn't end")
        fields = _fields(lines)
        out |= {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "page_id": _page(fields.get("warc-record-id")), "refers_to": _page(fields.get("warc-refers-to"))}
        if missing := [f for f in MANDATORY if f.lower() not in fields]:
            raise ValueError(f"missing: {', '.join(missing)}")
        if not re.fullmatch(r"\d+", fields["content-length"]):
            raise ValueError("Content-Length is no number")
        size = int(fields["content-length"])
        if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise ValueError(f"Content-Length is {size}, the block has {len(rest) - 4} bytes")
        block = rest[:size]
        if fields.get("content-type", "").startswith("application/http"):
            http, end, body = block.partition(b"\r\n\r\n")
            if not end:
                raise ValueError("the HTTP head doesn't end")
            http_fields = _fields(http.split(b"\r\n")[1:])
            stated = http_fields.get("content-length", "")
            if not re.fullmatch(r"\d+", stated):
                raise ValueError("the HTTP Content-Length is no number")
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            if out["record_type"] == "revisit":
                if out["refers_to"] is None or not digest:
                    raise ValueError("a revisit without WARC-Refers-To or digest")
                out |= {"payload_bytes": int(stated), "payload_digest": digest}
            else:
                out |= {"payload": body, "payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest()}
                if int(stated) != len(body):
                    raise ValueError(f"the HTTP Content-Length is {stated}, the payload has {len(body)} bytes")
                if digest and digest != out["payload_digest"]:
                    raise ValueError("the payload's digest is another")
        else:
            out |= {"payload": block, "payload_bytes": size, "payload_digest": hashlib.sha1(block).hexdigest()}
    except ValueError as e:
        out["problem"] = str(e)
    return out


def read_archives(spark: SparkSession, paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row of RECORD_SCHEMA for each record of the files in paths (path string); a task reads one file after another."""
    ready(spark)
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        names = [f.name for f in schema]

        def rows(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(found, pa.schema([(n, types[n]) for n in names]))

        types = {"payload": pa.binary(), **dict.fromkeys(("page_id", "payload_bytes", "refers_to"), pa.int64())}
        types |= {n: pa.string() for n in names if n not in types}
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, place = FileSystem.from_uri(address(path if re.match(r"[A-Za-z][\w+.-]*:", path) else default + path))
                held, size = [], 0
                with fs.open_input_stream(place, compression=None) as stream:
                    for f in frames(stream):
                        one = {"problem": str(f)} if isinstance(f, Exception) else parse_record(f)
                        if not with_payload:
                            one["payload"] = None
                        held.append({n: one.get(n) for n in names} | {"path": path})
                        size += len(one.get("payload") or b"") + 500
                        if size > READ_BYTES:
                            yield rows(held)
                            held, size = [], 0
                if held:
                    yield rows(held)

    schema = spark.createDataFrame([], RECORD_SCHEMA).schema
    n = paths.count()  # files, not records
    return paths.select("path").repartition(max(1, min(n, 10_000))).mapInArrow(read, schema)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read them back and return a row a page; a record with a problem raises. The archives are deleted."""
    folder = shared_path(spark, "warc")
    manifest = write_archives(spark, record_kinds(pages), folder)
    records = read_archives(spark, manifest, with_payload=False).where("problem IS NOT NULL OR record_type <> 'warcinfo'")
    sound = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("a WARC record isn't sound: "), F.col("problem"))).cast("long")).otherwise(F.col("page_id"))
    out = materialise(spark, records.select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
    discard(spark, manifest)
    remove(spark, folder)
    return out
