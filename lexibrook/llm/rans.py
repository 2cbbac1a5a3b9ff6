"""Token ids in files, by a static range asymmetric numeral system (rANS).

One frequency table, counted over all ids and scaled to 2**20, is shared by all files. A file is a run of blocks of BLOCK ids.
A block stands alone: LANES interleaved states (as many as ids, in a shorter block) each code every LANES-th id, and all lanes
write 32-bit words to one stream, so that a step is a few array operations. The footer lists each block's checkpoint (its place,
its first id's number, checksums of its bytes and of its ids), so that blocks can be decoded in parallel, and each document's id
and length.

    file   := MAGIC head-length head block* footer footer-length MAGIC
    block  := states of the lanes (unsigned 64-bit), words (unsigned 32-bit)

Writing: documents are encoded once, into a table; ranges of doc_id of about equal numbers of ids (cut by the running sum over all
documents) are dealt one to a task, which sorts by doc_id and starts a new file every FILE ids. Documents of one doc_id that fill
several ranges are dealt over them. Tasks write under temporary names and rename
at the end, and the manifest names the files that count, so lost or repeated tasks leave nothing that is read.

Edge cases: null or empty text is a document of the end id alone; null doc_ids stand first, repeated ones next to each other;
an empty table gives no files and no rows; other columns are ignored."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexibrook.llm.common import cuts_by_weight, forget, open_fs, range_of, saved, shared_dir, table, values
from lexibrook.llm.tokens import crc, encoder, vocabulary_path

MAGIC, BITS, LANES, BLOCK, FILE, END = b"LXBRANS1", 20, 4096, 1 << 20, 1 << 24, 0
LOW = 1 << 31


def scaled(counts, bits: int = BITS):
    """Frequencies that sum to 2**bits, at least 1 for each id that occurs."""
    import numpy as np

    counts, total = np.asarray(counts, np.float64), 1 << bits
    if not counts.sum():
        return counts.astype(np.uint64)
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * ((total - np.count_nonzero(counts)) / counts.sum()))), 0).astype(np.int64)
    freq[int(counts.argmax())] += total - freq.sum()
    return freq.astype(np.uint64)


class Coder:
    def __init__(self, freq, bits: int = BITS) -> None:
        import numpy as np

        self.bits, self.freq = bits, np.asarray(freq, np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(self.freq) else self.freq
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    def encode(self, ids, lanes: int = LANES) -> bytes:
        import numpy as np

        lanes = min(lanes, len(ids))
        x, words, k = np.full(lanes, LOW, np.uint64), [], np.uint64(32)
        f_all, c_all, bits = self.freq[ids], self.cum[ids], np.uint64(self.bits)
        bound = f_all << np.uint64(63 - self.bits)
        for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes) if lanes else ():
            f, c, b = f_all[at : at + lanes], c_all[at : at + lanes], bound[at : at + lanes]
            s = x[: len(f)]
            full = s >= b
            words.append(s[full].astype(np.uint32))
            s[full] >>= k
            q = s // f
            s[:] = (q << bits) + (s - q * f) + c
        return x.astype("<u8").tobytes() + np.concatenate(words[::-1] or [np.zeros(0, np.uint32)]).astype("<u4").tobytes()

    def decode(self, data: bytes, n: int, lanes: int = LANES):
        import numpy as np

        lanes = min(lanes, n)
        x = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
        words, at, k = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64), 0, np.uint64(32)
        out, mask, bits, low = np.empty(n, np.uint32), np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.uint64(LOW)
        for first in range(0, n, lanes or 1):
            s = x[: min(lanes, n - first)]
            slot = s & mask
            ids = self.symbol[slot.astype(np.int64)]
            out[first : first + lanes] = ids
            s[:] = self.freq[ids] * (s >> bits) + slot - self.cum[ids]
            short = s < low
            m = int(np.count_nonzero(short))
            s[short] = (s[short] << k) | words[at : at + m]
            at += m
        return out


class Writer:
    """One file after another in a folder, each under a temporary name until it is whole."""

    def __init__(self, folder: str, part: int, coder: Coder) -> None:
        self.fs, self.path = open_fs(folder)
        self.part, self.coder, self.nth, self.out, self.done = part, coder, 0, None, []

    def add(self, doc_id: int | None, ids) -> None:
        if self.out is None:
            self.temporary = f"{self.path}/.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary)
            head = json.dumps({"bits": self.coder.bits, "lanes": LANES, "block": BLOCK, "table_crc32": zlib.crc32(self.coder.freq.tobytes())}).encode()
            self.out.write(MAGIC + struct.pack("<I", len(head)) + head)
            self.at, self.docs, self.sizes, self.blocks, self.rest, self.held, self.total = len(MAGIC) + 4 + len(head), [], [], [], [], 0, 0
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.total += len(ids)
        while len(ids):
            self.rest.append(ids[: BLOCK - self.held])
            self.held += len(self.rest[-1])
            ids = ids[len(self.rest[-1]) :]
            if self.held == BLOCK:
                self.flush()
        if self.total >= FILE:
            self.close()

    def flush(self) -> None:
        import numpy as np

        if self.held:
            ids = np.concatenate(self.rest)
            data = self.coder.encode(ids)
            self.out.write(data)
            self.blocks.append({"at": self.at, "bytes": len(data), "first": self.blocks[-1]["first"] + self.blocks[-1]["n"] if self.blocks else 0, "n": len(ids), "crc32": zlib.crc32(data), "ids_crc32": crc(ids)})
            self.at += len(data)
            self.rest, self.held = [], 0

    def close(self) -> None:
        if self.out is None:
            return
        self.flush()
        footer = zlib.compress(json.dumps({"docs": self.docs, "sizes": self.sizes, "blocks": self.blocks}).encode(), 1)
        self.out.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        self.out.close()
        name = f"part-{self.part:06}-{self.nth:05}.rans"
        self.fs.move(self.temporary, f"{self.path}/{name}")
        self.done.append((name, self.part, self.nth, len(self.docs), self.total, self.at + len(footer) + 4 + len(MAGIC)))
        self.nth, self.out = self.nth + 1, None


def footer_of(f) -> dict:
    size = f.size()
    f.seek(size - len(MAGIC) - 4)
    n, magic = struct.unpack("<I8s", f.read(len(MAGIC) + 4))
    if magic != MAGIC:
        raise ValueError("not a whole file")
    f.seek(size - len(MAGIC) - 4 - n)
    return json.loads(zlib.decompress(f.read(n)))


def block_ids(f, block: dict, coder: Coder):
    """The ids of one block, by its checkpoint alone."""
    f.seek(block["at"])
    data = f.read(block["bytes"])
    if zlib.crc32(data) != block["crc32"]:
        raise ValueError("a block's bytes don't have its checksum")
    ids = coder.decode(data, block["n"])
    if crc(ids) != block["ids_crc32"]:
        raise ValueError("a block's ids don't have its checksum")
    return ids


def read_file(fs, path: str, coder: Coder) -> Iterator[tuple]:
    """(doc_id, ids) of each document, holding a block and the document that runs on from it."""
    import numpy as np

    with fs.open_input_file(path) as f:
        footer = footer_of(f)
        blocks, held, have = iter(footer["blocks"]), [], 0
        for doc, n in zip(footer["docs"], footer["sizes"]):
            while have < n:
                held.append(block_ids(f, next(blocks), coder))
                have += len(held[-1])
            whole = np.concatenate(held) if len(held) > 1 else held[0]
            yield doc, whole[:n]
            held, have = [whole[n:]], have - n


ENCODED = "doc_id long, ids binary, n long, counts binary"


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, ids, n, null) of each document, ids as n little-endian unsigned 16-bit numbers; after each batch a row (null, null, null,
    counts) of how often each id came in it, as 64-bit pairs, so that counting doesn't read the ids again."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(path)
        if enc.kind != "H":
            raise ValueError("these files hold ids below 65,536")
        for b in batches:
            total, held, size, out = np.zeros(1 << 16, np.int64), [], 0, []
            for t in chain(values(b.column(1)), [None]):
                if len(out) < b.num_rows:
                    out.append(enc.packed(t, end))
                    held.append(np.frombuffer(out[-1], "<u2"))
                    size += len(held[-1])
                if held and (size > 1 << 20 or len(out) == b.num_rows):
                    total += np.bincount(np.concatenate(held), minlength=1 << 16)
                    held, size = [], 0
            k = np.flatnonzero(total)
            pairs = np.stack([k, total[k]], axis=1).astype("<i8").tobytes()
            docs = pa.concat_arrays([b.column(0), pa.nulls(1, pa.int64())])
            yield pa.RecordBatch.from_arrays([docs, pa.array([*out, None], pa.binary()), pa.array([len(x) // 2 for x in out] + [None], pa.int64()), pa.array([None] * len(out) + [pairs], pa.binary())], ["doc_id", "ids", "n", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def counted(rows: DataFrame) -> list[tuple[int, int]]:
    """(id, count) over all documents: at most one for each id of the vocabulary."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                pairs = np.frombuffer(x, "<i8").reshape(-1, 2)
                total[pairs[:, 0]] += pairs[:, 1]
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k])], ["id", "n"])

    return [tuple(r) for r in rows.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect()]


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows of encoded(), kept in a table, to the folder; the manifest (name, part, nth, n_docs, n_tokens, bytes) is a table in it."""
    import numpy as np
    import pyarrow as pa

    spark, ids = rows.sparkSession, rows.where("n is not null").select("doc_id", "ids")
    freq = np.zeros(1 << 16, np.int64)
    for k, n in counted(rows):
        freq[k] = n
    freq = scaled(freq)
    fs, path = open_fs(folder)
    fs.create_dir(f"{path}/files", recursive=True)
    with fs.open_output_stream(f"{path}/frequencies") as f:
        f.write(freq.astype("<u8").tobytes())
    cuts = cuts_by_weight(rows.where("n is not null").select("doc_id", (F.col("n") * 2).alias("n")), "doc_id", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, done = Coder(freq), None, []
        for b in batches:
            for p, doc, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if writer is None or writer.part != p:
                    if writer:
                        writer.close()
                        done += writer.done
                    writer = Writer(f"{folder}/files", p, coder)
                writer.add(doc, np.frombuffer(x.as_py(), "<u2").astype(np.uint32))
        if writer:
            writer.close()
            done += writer.done
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["name", "part", "nth", "n_docs", "n_tokens", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names)

    order = F.crc32("ids")
    dealt = ids.withColumn("part", range_of(F.col("doc_id"), cuts, F.xxhash64("ids"))).select("part", "doc_id", "ids").repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "doc_id", order)
    dealt.mapInArrow(run, "name string, part int, nth int, n_docs long, n_tokens long, bytes long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that the manifest names."""
    import pyarrow as pa

    manifest = spark.read.parquet(f"{folder}/manifest")
    n = max(1, manifest.count())
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file of FILE ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder.cache_clear()
        coder = None
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = open_fs(folder)
                if coder is None:
                    with fs.open_input_stream(f"{path}/frequencies") as f:
                        coder = Coder(np.frombuffer(f.read(), "<u8"))
                rows: list[tuple] = []
                for doc, ids in read_file(fs, f"{path}/files/{name}", coder):
                    rows.append((doc, start, len(ids), crc(ids)))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    def batch(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("name", before.alias("start")).repartition(n)
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "rans-files")
    ids = saved(encoded(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json")), "rans-ids")
    write_files(ids, folder)
    forget(ids)
    return read_files(spark, folder)


QUERIES, SQL = {"op8_tokens": op8_tokens}, {}
