"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; two fingerprints link if at most RADIUS = 3 bits differ. Bit i gets a fixed vector m(i) of
r + 1 bits; table v (each non-zero vector of r + 1 bits) keeps bit i if <m(i), v> is odd. Any r positions span at most r
of the r + 1 dimensions, so some v is orthogonal to all of them: some of the 15 tables drops every differing bit, and
every pair within the radius collides there. That is a guarantee, not a probability.

Equal fingerprints are one node, and rows of one fingerprint (copies, empty texts), a component's fingerprints and a bucket's are each
joined in parts (spread_join), so none of them meets in one task. A bucket of more than LEAF fingerprints is covered anew on the bits its mask dropped (32,
then 16, then 8), with the same guarantee: at the third level at most 2**8 fingerprints can share a bucket. So no bucket is
capped, sampled or compared in full beyond LEAF, and a fingerprint is copied at most 15**3 times, only when it is in hot buckets.

Edge cases: null or empty text has fingerprint zero and links like any other; null doc_id takes part but is never a
component's id (the id is null if a component has no other); repeated doc_ids give one row each; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexibrook.llm.common import components, rested, saved, spread_join, table, values

RADIUS, LEAF, LEVELS = 3, 256, 3


def fingerprint_bits(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) > shingle:
        line, at, starts = b" ".join(words), 0, []
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ends = [s - 1 for s in starts[shingle:]] + [len(line)]
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts, ends)], np.uint64)
    else:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    n, total = len(h), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):  # bounded memory for long texts
        total += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3, hashed: bool = False) -> DataFrame:
    """(doc_id, fp, at) of every row of docs, at being its number in its task; with hashed, also the hash of all its columns, as row."""
    import pyarrow as pa

    more = [F.xxhash64(*docs.columns).alias("row")] if hashed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            at, n = pa.array(range(n, n + b.num_rows), pa.int64()), n + b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint_bits(t, shingle) for t in values(b.column(1))], pa.int64()), at, *b.columns[2:]], ["doc_id", "fp", "at", "row"][: b.num_columns + 1])
        rested()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more).mapInArrow(run, "doc_id long, fp long, at long" + ", row long" * hashed)


def covering(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over these bit positions: for any `radius` of the positions, some mask keeps none of them."""
    dims = radius + 1
    m = {b: 1 + (k * 7 + k // 15 * 4) % (2**dims - 1) for k, b in enumerate(bits)}  # non-zero, and evenly used
    return [sum(1 << b for b in bits if (m[b] & v).bit_count() & 1) for v in range(1, 2**dims)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask_tree(levels: int = LEVELS) -> list[list[list[int]]]:
    """By level, for each mask of the level before, the 15 masks below it; each holds its parent's bits too."""
    out, above = [], [0]
    for _ in range(levels):
        out.append([[p | c for c in covering([b for b in range(64) if not p >> b & 1])] for p in above])
        above = [c for row in out[-1] for c in row]
    return out


def bucket_links(lists: Iterator) -> Iterator:
    """Spanning links of the fingerprints in each bucket: (fp, least fp of its part)."""
    import numpy as np
    import pyarrow as pa

    for batch in lists:
        a, b = [], []
        for fps in batch.column(0).to_pylist():
            x = np.sort(np.array(fps, np.int64))
            near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= RADIUS
            if near.sum() == len(x):
                continue
            label, old = np.arange(len(x)), None
            while old is None or (label != old).any():
                old = label
                label = np.where(near, label[None, :], len(x)).min(axis=1)
            far = label != np.arange(len(x))
            a += x[label[far]].tolist()
            b += x[far].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links whose connected components are those of all pairs of the distinct fps within the radius."""
    rows, found = fps.select("fp", F.lit(0).alias("t")), None
    for level, tree in enumerate(mask_tree()):
        masks = F.array(*[F.array(*[F.lit(signed(x)) for x in row]) for row in tree])
        keyed = rows.select("fp", "t", F.posexplode(masks[F.col("t")]).alias("k", "mask"))
        keyed = keyed.select("fp", (F.col("t") * 15 + F.col("k")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        full = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = saved(spread_join(keyed, full, ["t", "key"], F.xxhash64("fp")), f"simhash-buckets-{level}")
        leaf = shared if level == LEVELS - 1 else shared.where(F.col("n") <= LEAF)
        more = leaf.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(bucket_links, "a long, b long")
        found = more if found is None else found.union(more)
        if level == LEVELS - 1:
            break
        rows = shared.where(F.col("n") > LEAF).select("fp", "t")
        if rows.isEmpty():
            break
    return found.distinct()


def grouped(ids: DataFrame) -> DataFrame:
    """ids with component (a fingerprint) and component_id (the least doc_id that links reach) of every row."""
    classes = saved(ids.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    joined = components(links(classes), "simhash-components")
    labelled = classes.join(joined.hint("merge"), classes.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = spread_join(labelled, least, ["component"], F.xxhash64("fp")).select("fp", "component", "component_id")
    return spread_join(ids, of_fp, ["fp"], F.col("at"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the least doc_id that links reach."""
    return grouped(saved(with_fingerprints(docs), "simhash-fingerprints")).select("doc_id", "fp", "component_id")


def hex16(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each group the row of the least doc_id stays, once, with its own columns.

    If several rows of the group have that doc_id, the one with the least hash of all columns stays; rows that share a doc_id but are
    in different groups are apart. Rows without a doc_id are compared with each other alone: of each group one of them stays."""
    ids = grouped(saved(with_fingerprints(docs, hashed=True), "simhash-fingerprints"))
    kept = ids.where("doc_id = component_id or doc_id is null").groupBy("component", "doc_id").agg(F.min("row").alias("row")).alias("k")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(*docs.columns).alias("h"))
    one = rows.join(kept, F.col("id").eqNullSafe(F.col("k.doc_id")) & (F.col("h") == F.col("k.row")), "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "h").orderBy("h"))
    return one.withColumn("nth", first).where("nth = 1").select("row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


QUERIES, SQL = {"op10_simhash": op10_simhash}, {}
