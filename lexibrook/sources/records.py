"""Record files: 'FG', length, CRC-32 and id (big-endian, 18 bytes), then the payload; the CRC covers id and payload.

`spark.read.format("lexibrook_records")` gives the valid prefix of each file and one row that says how it ended. Record
boundaries depend on all earlier lengths, so a file is read by one task, as a stream; small files share a task, others are read in parallel.

An append is one commit: each task writes a hidden file, forced to the disk, and the driver then shows them all under the next commit
number, COMMIT-TASK.rec. So the order of names is the order of commits. A null payload is an empty one; a null id is an error; a
folder without files has no records; other columns are ignored."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from decimal import Decimal
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lexibrook.sources.files import open_path

MAGIC, HEADER, MOST_ID = b"FG", 18, (1 << 64) - 1
#: Bytes of a batch of rows, and of a row besides its payload.
BATCH, ROW = 4 << 20, 256
#: Tasks that small files are read in, where there are bytes for them, and bytes of a task's files.
GROUPS, LEAST, LARGEST = 64, 1 << 20, 64 << 20
SCHEMA = "path string, offset bigint, length bigint, checksum bigint, doc_id decimal(20,0), payload binary, status string, total bigint, reason string"


class RecordError(ValueError):
    pass


class InvalidDocumentId(RecordError):
    pass


class IncompleteRecord(RecordError):
    pass


class BadMagic(RecordError):
    pass


class BadLength(RecordError):
    pass


class BadChecksum(RecordError):
    pass


def encode(doc_id: int, payload: bytes) -> bytes:
    if not 0 <= doc_id <= MOST_ID:
        raise InvalidDocumentId(str(doc_id))
    body = struct.pack(">Q", doc_id) + payload
    return MAGIC + struct.pack(">II", len(payload), zlib.crc32(body)) + body


def header(data: bytes) -> tuple[int, int, int]:
    """(checksum, doc_id, length)."""
    if len(data) < HEADER:
        raise IncompleteRecord("shorter than a header")
    if data[:2] != MAGIC:
        raise BadMagic("not a record")
    length, checksum, doc_id = struct.unpack(">IIQ", data[2:HEADER])
    return checksum, doc_id, length


def decode(data: bytes) -> tuple[int, bytes]:
    checksum, doc_id, length = header(data)
    if len(data) != HEADER + length:
        raise BadLength(f"{len(data) - HEADER} bytes of payload, not {length}")
    if zlib.crc32(data[10:]) != checksum:
        raise BadChecksum("the checksum doesn't hold")
    return doc_id, data[HEADER:]


def scan(stream, total: int) -> Iterator[tuple]:
    """(offset, length, checksum, doc_id, payload, status, reason): records, then how the file ended, at the end of its valid prefix."""
    at, status, reason = 0, "ok", None
    while at < total:
        head = stream.read(HEADER)
        try:
            checksum, doc_id, length = header(head)
        except IncompleteRecord as e:
            status, reason = "incomplete_tail", str(e)
            break
        except BadMagic as e:
            status, reason = "corruption", str(e)
            break
        if at + HEADER + length > total:
            status, reason = "incomplete_tail", "the payload runs past the end"
            break
        payload = stream.read(length)
        if zlib.crc32(payload, zlib.crc32(head[10:])) != checksum:
            status, reason = "corruption", "the checksum doesn't hold"
            break
        yield at, length, checksum, doc_id, payload, "record", None
        at += HEADER + length
    yield at, None, None, None, None, status, reason


def files_at(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files there; none if there is nothing."""
    from pyarrow import fs as pafs

    fs, p = open_path(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.Directory:
        return sorted((x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(p)) if x.type == pafs.FileType.File and not x.base_name.startswith((".", "_")))
    return [] if info.type == pafs.FileType.NotFound else [(info.path, info.size)]


class Files(InputPartition):
    def __init__(self, root: str, files: list[tuple[str, int]]) -> None:
        self.root, self.files = root, files


def grouped(files: list[tuple[str, int]]) -> list[list[tuple[str, int]]]:
    """Files in order, several to a task: at least GROUPS groups where they are large enough, of LEAST to LARGEST bytes unless a file is larger."""
    each, out, size = min(max(sum(n for _, n in files) // GROUPS, LEAST), LARGEST), [], 0
    for f in files:
        if not out or size + f[1] > each:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f[1]
    return out


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payload = options["path"], options.get("payload") != "false"

    def partitions(self) -> list[InputPartition]:
        return [Files(self.path, group) for group in grouped(files_at(self.path)) or [[]]]

    def read(self, part: Files) -> Iterator:
        """Batches of rows of the schema, of about BATCH bytes; payloads are checked but left out, as nulls, if the option payload is false."""
        import pyarrow as pa

        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.decimal128(20, 0), pa.binary(), pa.string(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        whole = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        fs, _ = open_path(part.root)
        rows, size = [], 0
        for path, total in part.files:
            with fs.open_input_stream(path, buffer_size=1 << 20) as stream:
                for at, length, checksum, doc_id, payload, status, reason in scan(stream, total):
                    rows.append((path, at, length, checksum, None if doc_id is None else Decimal(doc_id), payload if self.payload else None, status, total, reason))
                    size += ROW + (len(payload or b"") if self.payload else 0)
                    if size > BATCH:
                        yield whole(rows)
                        rows, size = [], 0
        if rows:
            yield whole(rows)


def forced(fs, path: str) -> None:
    """Has the disk hold a local file's bytes; other file systems do when a stream is closed."""
    from pyarrow import fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        at = os.open(path, os.O_RDONLY)
        try:
            os.fsync(at)
        finally:
            os.close(at)


class Written(WriterCommitMessage):
    def __init__(self, temporary: str | None) -> None:
        self.temporary = temporary


class Writer(DataSourceArrowWriter):
    """Each task writes a hidden file; the driver shows them all once every task is done: that is the commit. One writer at a time."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, batches: Iterator) -> Written:
        rows = ((i.as_py(), p.as_py()) for b in batches for i, p in zip(b.column("doc_id"), b.column("payload")))
        first = next(rows, None)
        if first is None:
            return Written(None)
        fs, path = open_path(self.path)
        fs.create_dir(path, recursive=True)
        temporary = f"{path}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as out:
            for doc_id, payload in chain([first], rows):
                if doc_id is None:
                    raise InvalidDocumentId("null")
                out.write(encode(int(doc_id), payload or b""))
        forced(fs, temporary)
        return Written(temporary)

    def commit(self, messages: list) -> None:
        fs, path = open_path(self.path)
        number = 1 + max((int(n[0]) for p, _ in files_at(self.path) if (n := re.match(r"\d+(?=-\d+\.rec$)", p.rpartition("/")[2]))), default=0)
        for k, m in enumerate(messages):
            if m is not None and m.temporary:
                fs.move(m.temporary, f"{path}/{number:012}-{k:06}.rec")
        if fs.type_name == "local" and os.path.isdir(path):
            forced(fs, path)

    def abort(self, messages: list) -> None:
        fs, _ = open_path(self.path)
        for m in messages:
            if m is not None and m.temporary:
                fs.delete_file(m.temporary)


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexibrook_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of SCHEMA; without payload, which isn't needed to count records, payloads are checked but come as nulls."""
    spark.dataSource.register(Records)
    return spark.read.format("lexibrook_records").option("payload", str(payload).lower()).load(path)


def append_records(df: DataFrame, path: str) -> None:
    """Appends df(doc_id, payload) to a folder of record files, in one commit."""
    df.sparkSession.dataSource.register(Records)
    df.select("doc_id", "payload").write.format("lexibrook_records").mode("append").save(path)


def copy_files(spark: SparkSession, path: str, to: str) -> None:
    """The record files of a folder in another one, under their names, copied in tasks; a file is shown when it is whole."""
    def run(batches: Iterator) -> Iterator:
        fs, folder = open_path(to)
        for b in batches:
            for p in b.column(0).to_pylist():
                temporary = f"{folder}/.{uuid.uuid4().hex}"
                fs.copy_file(p, temporary)
                forced(fs, temporary)
                fs.move(temporary, f"{folder}/{p.rpartition('/')[2]}")
            yield b

    fs, folder = open_path(to)
    fs.create_dir(folder, recursive=True)
    found = spark.createDataFrame([(p,) for p, _ in files_at(path)], "path string").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    found.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def valid(scanned: DataFrame) -> DataFrame:
    return scanned.where("status = 'record'").select("path", "offset", "doc_id", "payload")


def status(scanned: DataFrame) -> DataFrame:
    """(path, n_valid, status, good_offset, total, reason) of each file."""
    end = lambda c: F.max(F.when(F.col("status") != "record", F.col(c)))
    return scanned.groupBy("path").agg(F.count_if(F.col("status") == "record").alias("n_valid"), end("status").alias("state"), end("offset").alias("good_offset"), F.max("total").alias("total"), end("reason").alias("reason")).withColumnRenamed("state", "status")


def truncate_tail(path: str, keep: int) -> int:
    """Cuts one file to its first `keep` bytes, by writing them anew and renaming; returns the bytes removed."""
    fs, p = open_path(path)
    size = fs.get_file_info(p).size or 0
    if keep >= size:
        return 0
    folder, _, name = p.rpartition("/")
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_input_stream(p) as source, fs.open_output_stream(temporary) as out:
        left = keep
        while left:
            part = source.read(min(left, 1 << 20))
            out.write(part)
            left -= len(part)
    fs.move(temporary, p)
    return size - keep


# The same format as column expressions, for one record a row.


def size_of(payload: Column) -> Column:
    return F.coalesce(F.octet_length(payload), F.lit(0)).cast("long") + HEADER


def number(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n), digits, "0")


def encoded(doc_id: Column, payload: Column) -> Column:
    """binary; doc_id: bigint. A null payload is an empty one."""
    payload = F.coalesce(payload, F.lit(b""))
    body = F.concat(F.unhex(number(doc_id, 16)), payload)
    return F.concat(F.lit(MAGIC), F.unhex(number(F.octet_length(payload).cast("long"), 8)), F.unhex(number(F.crc32(body), 8)), body)


def field(record: Column, start: int, n: int) -> Column:
    """An unsigned number of n bytes, as decimal(20,0)."""
    return F.conv(F.hex(F.substring(record, start, n)), 16, 10).cast("decimal(20,0)")


def fields(record: Column) -> Column:
    """struct<magic, length, checksum, doc_id, payload, error> of a one-record binary, in the decoder's order of checks."""
    payload = F.substring(record, F.lit(HEADER + 1), F.greatest(F.octet_length(record) - HEADER, F.lit(0)))
    length, checksum = field(record, 3, 4).cast("long"), field(record, 7, 4).cast("long")
    error = (
        F.when(F.octet_length(record) < HEADER, "incomplete").when(F.hex(F.substring(record, 1, 2)) != MAGIC.hex().upper(), "magic")
        .when(F.octet_length(payload) != length, "length").when(F.crc32(F.substring(record, F.lit(11), F.octet_length(record))) != checksum, "checksum")
    )
    return F.struct(F.hex(F.substring(record, 1, 2)).alias("magic"), length.alias("length"), checksum.alias("checksum"), field(record, 11, 8).alias("doc_id"), payload.alias("payload"), error.alias("error"))


def offsets(docs: DataFrame, span: int = 65536) -> DataFrame:
    """(doc_id, size, offset) of documents stored in order of doc_id, by a two-level prefix sum."""
    from pyspark.sql import Window

    rows = docs.select("doc_id", size_of(F.col("text")).alias("size")).withColumn("_span", F.expr(f"doc_id div {span}"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_span").agg(F.sum("size").alias("_n")).select("_span", before("_n", Window.orderBy("_span")).alias("_start"))
    inside = before("size", Window.partitionBy("_span").orderBy("doc_id"))
    return rows.withColumn("_inside", inside).join(starts, "_span").select("doc_id", "size", (F.col("_start") + F.col("_inside")).alias("offset"))
