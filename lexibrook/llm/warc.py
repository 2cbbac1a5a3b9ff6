r"""A deterministic sharded WARC writer, and its reader.

Pages are digested first (page_id, SHA-1, bytes: small rows). Of equal payloads the largest page_id is a response, the others
revisit it. These marks, as rows of their own, and the pages are range-partitioned by page_id (bounds from quantiles over all
pages) and sorted in one shuffle; a page's marks come before it, so the writer needs no join that would move payloads by digest,
where copies would meet. Each task regenerates headers and digests, compresses each record by itself (gzip), starts a new file
when one has ROLL compressed bytes, writes under temporary names and renames whole files. The manifest, a table committed by
Spark after all tasks, names the files that count: what lost or repeated tasks leave is never read.

A response's block is an HTTP head and the payload; a revisit's block is the head alone, whose Content-Length is the payload's.
Readers check block and payload digests of each record.

Edge cases: null html is an empty payload; null url is urn:page:ID; white space, controls and characters above ASCII in a url are
percent-encoded; null page_ids are written first and are always responses; rows that share the largest page_id of equal payloads
are all responses; an empty table gives no files and no rows; other columns are ignored."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibrook.llm.common import cuts_by_weight, forget, open_fs, range_of, saved, shared_dir, spread_join, table

ROLL, LEAST_BYTES, DATE = 64 << 20, 0, "2000-01-01T00:00:00Z"
#: What a record weighs beside its payload.
HEAD = 512
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One record, compressed by itself."""
    name = "null" if page_id is None else str(page_id)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{name}"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(block)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of a file, holding one record."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 18)
    while first := f.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        head = {}
        while (line := f.readline()) != b"\r\n":
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        block = f.read(int(head["content-length"]))
        if f.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end")
        yield head, block


def read_page(head: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), with digests checked."""
    if f"sha1:{base32(block)}" != head["warc-block-digest"]:
        raise ValueError("a block doesn't have its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
    if kind == "response" and (len(payload) != length or base32(payload) != digest):
        raise ValueError("a payload doesn't have its digest")
    number = lambda key: None if head[key] == "<urn:page:null>" else int(head[key][len("<urn:page:") : -1])
    return number("warc-record-id"), length, digest, kind, number("warc-refers-to") if kind == "revisit" else None


class Shards:
    """Files of one range, each under a temporary name until it is whole."""

    def __init__(self, folder: str, part: int, roll: int) -> None:
        (self.fs, self.path), self.part, self.roll = open_fs(folder), part, roll
        self.out, self.nth, self.done = None, 0, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temporary, self.n, self.bytes, self.digest = f"{self.path}/.{uuid.uuid4().hex}", 0, 0, hashlib.sha256()
            self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(data)
        self.digest.update(data)
        self.n, self.bytes = self.n + 1, self.bytes + len(data)
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"part-{self.part:06}-{self.nth:05}.warc.gz"
            self.fs.move(self.temporary, f"{self.path}/{name}")
            self.done.append((name, self.n, self.bytes, self.digest.hexdigest()))
            self.out, self.nth = None, self.nth + 1


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, roll: int = ROLL) -> DataFrame:
    """Writes pages(page_id, url, html) to the folder; returns the manifest (name, records, bytes, sha256)."""
    import pyarrow as pa

    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    digests = saved(rows.select("page_id", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").alias("n")), "warc-digests")
    groups = digests.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    marks = spread_join(digests.where(F.col("n") >= least_bytes), groups, ["digest"], F.xxhash64("page_id")).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    cuts = cuts_by_weight(digests.select("page_id", (F.col("n") + HEAD).alias("n")), "page_id", "n")
    both = rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to")).unionByName(marks.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("digest").alias("payload"), "refers_to"))
    digest = F.when(F.col("kind") == 1, F.unhex(F.sha1("payload"))).otherwise(F.col("payload"))
    dealt = both.withColumn("part", range_of(F.col("page_id"), cuts, F.xxhash64(digest))).repartitionById(len(cuts) + 1, "part")
    ordered = dealt.select("part", "page_id", "kind", "url", "payload", "refers_to").sortWithinPartitions("part", "page_id", "kind", "url", F.crc32("payload"))
    fs, path = open_fs(folder)
    fs.create_dir(f"{path}/files", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, done, at, revisits = None, [], object(), {}
        for b in batches:
            for p, page, kind, url, payload, refers in zip(*(c.to_pylist() for c in b.columns)):
                if shards is None or shards.part != p:
                    if shards:
                        shards.close()
                        done += shards.done
                    shards = Shards(f"{folder}/files", p, roll)
                if page != at:
                    at, revisits = page, {}
                digest = hashlib.sha1(payload).digest() if kind else payload
                if not kind:
                    revisits[digest] = refers
                else:
                    to = revisits.get(digest)
                    shards.add(record("response" if to is None else "revisit", page, url, payload, base64.b32encode(digest).decode(), to))
        if shards:
            shards.close()
            done += shards.done
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], ["name", "records", "bytes", "sha256"])

    ordered.mapInArrow(run, "name string, records long, bytes long, sha256 string").write.parquet(f"{folder}/manifest")
    forget(digests)
    return spark.read.parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the files that the manifest names."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, path = open_fs(folder)
                rows = []
                with fs.open_input_stream(f"{path}/files/{name}", compression=None) as f:
                    for head, block in records(f):
                        rows.append(read_page(head, block))
                        if len(rows) == 10_000:
                            yield batch(rows)
                            rows = []
                yield batch(rows)

    def batch(rows: list[tuple]):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    names = spark.read.parquet(f"{folder}/manifest").select("name").sort("name")
    return names.repartition(max(1, names.count())).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder)


_FIVE = "('0x' || substr(h, 5 * k + 1, 5))::INTEGER"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({v} >> {s}) & 31) + 1, 1)"
_BASE32 = "list_aggregate(list_transform(range(8), lambda k: " + " || ".join(_LETTER.format(v=_FIVE, s=s) for s in (15, 10, 5, 0)) + "), 'string_agg', '')"
OP3 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS top FROM p)
SELECT page_id, strlen(x)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM m
"""

QUERIES, SQL = {"op3_warc": op3_warc}, {"op3_warc": OP3}
