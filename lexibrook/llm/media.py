"""Media columns by content-defined chunking.

A payload is cut where a rolling gear hash (each byte's fixed number, shifted one bit a byte, over the last 32 bytes) has zeros in
its top CUT bits, with chunks of LEAST to MOST bytes, so that payloads that share a stretch share its chunks. Each task writes the
chunks it has not just written, compressed, to a pack file and lists all of its payloads' chunks by digest. A join-free minimum
by digest then names one place for each chunk; packs are rewritten with the chunks that were named, in WAVES waves. The new packs of
a wave are committed as a table; then a job deletes the wave's old packs, so the store holds every chunk once and never much more
than that. A run that begins again in the same folder leaves out the waves whose table is whole. A join of lists and places by
digest, split where media share a chunk, gives each medium's ordered chunk list.

A medium's stored form is its chunks' compressed bytes in order. Readers go through media in the order of their first chunk and
keep a bounded number of windows of the packs. They check each chunk's digest.

Edge cases: null or empty text is a payload of 64 zeros; repeated rows are media of their own with equal lists; null doc_ids are
allowed; an empty table gives no packs and no rows; other columns are ignored. Packs of lost or repeated tasks have names of
their own that no list mentions; those of ingest() go with their folder after the last wave."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibrook.llm.common import open_fs, parallelism, saved, shared_dir, spread_join, table, values

CUT, LEAST, MOST, LEVEL, RECENT, WAVES, WINDOW, WINDOWS, SEED = 11, 512, 16384, 3, 50_000, 4, 1 << 20, 24, 4


@lru_cache(maxsize=1)
def gears():
    import numpy as np

    return np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(payload: bytes) -> list[int]:
    """Ends of the payload's chunks."""
    import numpy as np

    out, n = [], len(payload)
    if n > LEAST:
        for at in range(0, n, 1 << 22):  # bounded memory: with the 31 bytes before
            low = max(0, at - 31)
            h = gears()[np.frombuffer(payload, np.uint8, min(n, at + (1 << 22)) - low, low)]
            for k in range(5):  # sums of 2, 4, ... 32 bytes
                s = 1 << k
                h[s:] += h[:-s] << np.uint32(s)
            out += (np.flatnonzero(h[at - low :] < np.uint32(1 << 32 - CUT)) + at + 1).tolist()
    ends, start = [], 0
    for c in out:
        if c - start < LEAST:
            continue
        while c - start > MOST:
            start += MOST
            ends.append(start)
        if c - start >= LEAST:
            ends.append(c)
            start = c
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the number of bytes before padding."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


class Pack:
    """A file of chunks that is written once; its name is its own."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = open_fs(folder)
        self.name, self.out, self.at = f"{uuid.uuid4().hex}.pack", None, 0

    def add(self, data: bytes) -> int:
        if self.out is None:
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


LISTS = "medium string, doc_id long, n_bytes long, nth int, digest binary, length int, pack string, at long, stored int"


def ingest(docs: DataFrame, folder: str) -> DataFrame:
    """Writes packs; a row for each chunk of each medium (LISTS)."""
    import pyarrow as pa

    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, known, number, squeeze = Pack(folder), OrderedDict(), 0, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), values(b.column(1))):
                payload, n = payload_of(text)
                start, medium = 0, f"{pack.name[:32]}-{number}"
                for nth, end in enumerate(cuts(payload)):
                    chunk = payload[start:end]
                    digest = hashlib.sha256(chunk).digest()
                    place = known.get(digest)
                    if place is None:
                        data = squeeze(chunk)
                        place = known[digest] = (pack.add(data), len(data))
                        if len(known) > RECENT:
                            known.popitem(last=False)
                    rows.append((medium, doc, n, nth, digest, end - start, pack.name, *place))
                    start = end
                number += 1
                if len(rows) > 20_000:
                    yield listed(rows)
                    rows = []
            yield listed(rows)
        pack.close()

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int32())
    names = [x.split()[0] for x in LISTS.split(", ")]

    def listed(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, LISTS), "media-lists")


def whole(path: str) -> bool:
    """A table was committed there."""
    from pyarrow import fs as pafs

    fs, p = open_fs(f"{path}/_SUCCESS")
    return fs.get_file_info(p).type == pafs.FileType.File


def deleted(packs: DataFrame, folder: str) -> None:
    """Deletes the folder's packs(pack), in tasks; those that are gone already are none of its concern."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, path = open_fs(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.File:
                    fs.delete_file(f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    packs.distinct().mapInArrow(run, "n long").agg(F.sum("n")).collect()


def rewrite(lists: DataFrame, folder: str, to: str) -> DataFrame:
    """One place for each digest, in packs that hold nothing else: (digest, pack, at, stored). Deletes the old packs and their folder."""
    import pyarrow as pa

    spark, chosen = lists.sparkSession, f"{to}-chosen"
    wave_of = F.pmod(F.crc32(F.col("pack").cast("binary")), F.lit(WAVES)).alias("wave")
    if not whole(chosen):
        lists.groupBy("digest").agg(F.min(F.struct("pack", "at", "stored")).alias("p")).select("digest", "p.*").select("*", wave_of).write.mode("overwrite").parquet(chosen)
    places = spark.read.schema("digest binary, pack string, at long, stored int, wave long").parquet(chosen)
    fs, path = open_fs(to)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, reader = Pack(to), Reader(folder)
        for b in batches:
            got = [pack.add(reader.read(*place)) for place in zip(*(b.column(k).to_pylist() for k in range(3)))]
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array([pack.name] * len(got), pa.string()), pa.array(got, pa.int64()), b.column(2)], ["digest", "pack", "at", "stored"])
        pack.close()

    out = None
    for wave in range(WAVES):
        table_path = f"{to}-places/{wave}"
        if not whole(table_path):
            some = places.where(F.col("wave") == wave).select("pack", "at", "stored", "digest").repartition(parallelism(spark), "pack", F.expr(f"at div {WINDOW}")).sortWithinPartitions("pack", "at")
            some.mapInArrow(run, "digest binary, pack string, at long, stored int").write.mode("overwrite").parquet(table_path)
        deleted(lists.select("pack", wave_of).where(F.col("wave") == wave).select("pack"), folder)
        done = spark.read.schema("digest binary, pack string, at long, stored int").parquet(table_path)
        out = done if out is None else out.union(done)
    fs, path = open_fs(folder)
    fs.delete_dir_contents(path, missing_dir_ok=True)
    return out


class Reader:
    """Reads places of packs, keeping WINDOWS windows of WINDOW bytes."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = open_fs(folder)
        self.windows: OrderedDict = OrderedDict()

    def window(self, pack: str, k: int) -> bytes:
        got = self.windows.get((pack, k))
        if got is None:
            with self.fs.open_input_file(f"{self.path}/{pack}") as f:
                f.seek(k * WINDOW)
                got = f.read(WINDOW)
            self.windows[pack, k] = got
            if len(self.windows) > WINDOWS:
                self.windows.popitem(last=False)
        else:
            self.windows.move_to_end((pack, k))
        return got

    def read(self, pack: str, at: int, n: int) -> bytes:
        out = b""
        while n:
            part = self.window(pack, at // WINDOW)[at % WINDOW :][:n]
            out, at, n = out + part, at + len(part), n - len(part)
        return out


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, as text."""
    import numpy as np

    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p, x = n / n.sum(), np.arange(256)
    mean = float((p * x).sum())
    return f"mean={mean:.4f};deviation={float(np.sqrt((p * (x - mean) ** 2).sum())):.4f};entropy={float(-(p[p > 0] * np.log2(p[p > 0])).sum()):.4f};kinds={int((n > 0).sum())}"


def media(lists: DataFrame, places: DataFrame) -> DataFrame:
    """(medium, doc_id, n_bytes, chunks): each medium's ordered chunk list, as long as its payload."""
    put = places.select("digest", F.struct("pack", "at", "stored").alias("place"))
    both = spread_join(lists.select("medium", "doc_id", "n_bytes", "nth", "digest", "length"), put, ["digest"], F.xxhash64("medium", "nth"))
    chunk = F.struct("nth", "digest", "length", "place.pack", "place.at", "place.stored")
    return both.groupBy("medium", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))


def read_media(listed: DataFrame, folder: str) -> DataFrame:
    """Each medium read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        reader, expand = Reader(folder), zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for doc, n, chunks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                parts, form, media_bytes = [], hashlib.sha256(), 0
                for c in chunks.as_py():
                    data = reader.read(c["pack"], c["at"], c["stored"])
                    parts.append(expand(data))
                    if hashlib.sha256(parts[-1]).digest() != c["digest"] or len(parts[-1]) != c["length"]:
                        raise ValueError("a chunk doesn't have its digest")
                    form.update(data)
                    media_bytes += len(data)
                payload = b"".join(parts)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), media_bytes, form.hexdigest(), features(payload)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    first = F.col("chunks")[0]
    near = listed.repartition(parallelism(listed.sparkSession) * 4, first["pack"], F.floor(first["at"] / (8 * WINDOW))).sortWithinPartitions(first["pack"], first["at"])
    return near.select("doc_id", "n_bytes", "chunks").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "media")
    lists = ingest(table(spark, sf_dir, "documents"), f"{folder}/packs")
    places = rewrite(lists, f"{folder}/packs", f"{folder}/store")
    return read_media(media(lists, places), f"{folder}/store")


QUERIES, SQL = {"op4_media": op4_media}, {}
