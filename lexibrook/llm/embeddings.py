"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector passes it if their inner product is at least ALPHA. Directions are random product codes: in
each of CODES codes, after a random rotation, each half of the space has m random unit vectors, and each pair of them is one of
m * m directions. List decoding finds a vector's filters from its 2 m block products, sorted, without looking at the m * m
directions. Vectors that pass a common filter are compared in double precision.

ALPHA and m follow from the number of vectors: a random vector passes a filter with probability about BUCKET / n, and two
vectors of cosine COSINE pass COMMON filters together on average; both come from integrals over the sphere. Rotations are random,
so this holds for any pair whatever the data. One code alone, whose filters depend on each other, would miss a tenth of the pairs
at the very threshold; ten miss less than one in a thousand there (measured at 500, 51,282 and 3,000,000 vectors) and fewer above.

Equal vectors are one row with its number of copies, which counts them as links; so a group of copies, however large, costs no
comparison. Filters are first joined as light rows: a vector's id and a sketch of SKETCH signs. In a filter of at most TILE vectors only those
with a neighbour whose sketch differs in at most APART signs go on (over six standard deviations beyond what the threshold gives).
Vectors themselves are dealt once, by filter; a filter with more than TILE vectors is dealt as tiles of two blocks of it, each
compared in a bounded matrix. A pair is counted in the least filter that has both. No pairs are written: a tile gives each vector's
number of links and spanning links, which connected components join.

Edge cases: null or zero vectors and vectors with null or non-finite components have no links and are their own component;
vectors of different lengths don't link; rows that share a vec_id are vectors of their own; a null vec_id is never a component's
id, and its row isn't kept; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibrook.llm.common import components, parallelism, saved, spread_join, table

COSINE, BUCKET, COMMON, CODES, TILE, SKETCH, APART, SEED = 0.9, 48, 20.0, 10, 1024, 128, 44, 20


def tails(dim: int):
    """(t, P(a random unit vector's first coordinate >= t)) on a grid."""
    import numpy as np

    t = np.linspace(-1, 1, 200_001)
    f = np.maximum(0, 1 - t * t) ** ((dim - 3) / 2)
    upper = np.concatenate([np.cumsum((f[1:] + f[:-1])[::-1])[::-1], [0.0]])
    return t, upper / upper[0]


@lru_cache(maxsize=8)
def parameters(n: int, dim: int) -> tuple[float, int]:
    """(alpha, m) for n vectors."""
    import numpy as np

    t, p = tails(dim)
    alpha = float(np.interp(-min(0.03, BUCKET / max(n, 1)), -p, t))
    s, q = tails(dim - 1)
    inside = t >= alpha
    need = (alpha - COSINE * t[inside]) / np.sqrt(np.maximum(1e-12, (1 - COSINE**2) * (1 - t[inside] ** 2)))
    mass = -np.diff(p[inside], append=0.0)
    both = float((mass * np.interp(need, s, q, left=1.0, right=0.0)).sum())
    return alpha, int(np.ceil(np.sqrt(COMMON / CODES / both)))


@lru_cache(maxsize=32)
def code(number: int, dim: int, m: int):
    """(rotation, code words of each half) of one code."""
    import numpy as np

    rng = np.random.default_rng([SEED, number, dim, m])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    halves = [rng.standard_normal((m, k)) for k in (dim - dim // 2, dim // 2)]
    return rotation, [h / np.linalg.norm(h, axis=1, keepdims=True) for h in halves]


def padded(x):
    import numpy as np

    return np.pad(x, ((0, 0), (0, max(8, x.shape[1]) - x.shape[1])))


def sketches(x):
    """The signs of SKETCH random projections of each row, as bytes."""
    import numpy as np

    x = padded(x)
    return np.packbits(x @ np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], SKETCH)) >= 0, axis=1)


def decoded(x, n: int) -> list[list[int]]:
    """The filters that each row of x, unit vectors, passes, in order."""
    import numpy as np

    given, x = x.shape[1], padded(x)
    dim = x.shape[1]
    alpha, m = parameters(n, dim)
    out: list[list[int]] = [[] for _ in x]
    step = max(16, 1_000_000 // m)
    for number in range(CODES):
        rotation, (first, second) = code(number, dim, m)
        name = given << 50 | number << 42
        for at in range(0, len(x), step):
            y = x[at : at + step] @ rotation
            a, b = y[:, : dim - dim // 2] @ first.T, y[:, dim - dim // 2 :] @ second.T
            i, j = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
            a, b = np.take_along_axis(a, i, 1), np.take_along_axis(b, j, 1)
            rows = np.arange(len(y))
            for k in range(m):
                need = alpha * np.sqrt(2.0) - a[:, k]
                rows = rows[b[rows, 0] >= need[rows]]
                if not len(rows):
                    break
                left = rows
                for h in range(m):
                    left = left[b[left, h] >= need[left]]
                    if not len(left):
                        break
                    for r, f in zip(left.tolist(), (i[left, k] * m + j[left, h]).tolist()):
                        out[at + r].append(name | f)
    return [sorted(f) for f in out]


def filtered(vectors: DataFrame, n: int) -> DataFrame:
    """(uid, sketch, filters) of the rows of (uid, x) that can link; x as it was given."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, xs, filters, sketch = b.column(0).to_pylist(), b.column(1).to_pylist(), {}, {}
            by: dict[int, list[int]] = {}
            for k, x in enumerate(xs):
                by.setdefault(len(x) // 8, []).append(k)
            for rows in by.values():
                y = units([xs[k] for k in rows])
                for k, f, s in zip(rows, decoded(y, n), sketches(y)):
                    filters[k], sketch[k] = f, s.tobytes()
            order = range(len(xs))
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array([sketch[k] for k in order], pa.binary()), pa.array([filters[k] for k in order], pa.list_(pa.int64()))], ["uid", "sketch", "filters"])

    return vectors.mapInArrow(run, "uid long, sketch binary, filters array<long>")


def units(xs: list[bytes]):
    """Rows of unit length of vectors given as 64-bit numbers."""
    import numpy as np

    y = np.array([np.frombuffer(x) for x in xs])
    y = y / np.abs(y).max(axis=1, keepdims=True)  # else squares could overflow
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def packed(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, x): x is null where a vector is null, zero or holds null or non-finite components."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            xs: list = []
            for v in b.column(2):
                v = v.as_py() if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False)
                x = None if v is None or not len(v) or isinstance(v, list) else np.asarray(v, np.float64)
                xs.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(xs, pa.binary())], ["uid", "vec_id", "x"])

    return vectors.mapInArrow(run, "uid long, vec_id long, x binary")


def runs(batches: Iterator, n: int) -> Iterator[tuple]:
    """(key, rows) of rows that come in order of their first n columns; None after each batch."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if key != r[:n]:
                if key:
                    yield key, rows
                key, rows = r[:n], []
            rows.append(r[n:])
        yield None, []
    if key:
        yield key, rows


def active(batches: Iterator) -> Iterator:
    """Of rows (f, uid, sketch) in order of f: (uid, f) of those with a neighbour by sketch."""
    import numpy as np
    import pyarrow as pa

    out: list[tuple] = []
    for key, rows in runs(batches, 1):
        if len(rows) > 1:
            s = np.frombuffer(b"".join(r[1] for r in rows), np.uint64).reshape(len(rows), -1)
            apart = sum(np.bitwise_count(s[:, None, k] ^ s[None, :, k]).astype(np.int16) for k in range(s.shape[1]))
            near = (apart <= APART).sum(axis=1) > 1  # itself and another
            out += [(rows[k][0], key[0]) for k in np.flatnonzero(near)]
        if key is None or len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], ["uid", "f"])
            out = []
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], ["uid", "f"])


def compared(x, filters: list[list[int]], sides, f: int, weight):
    """(links of each row that are counted here, least row of its part) of a tile; sides: the block of each row, which differs in pairs, or None; weight: copies of each row."""
    import numpy as np

    near = x @ x.T >= COSINE
    np.fill_diagonal(near, False)
    if sides is not None:
        near &= sides[:, None] != sides[None, :]
    if not near.any():
        return None
    label, old = np.arange(len(x)), None
    while old is None or (label != old).any():
        old = label
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
    pairs = np.argwhere(near)
    if len(pairs) <= 64:
        sets = {int(k): {g for g in filters[k] if g < f} for k in np.unique(pairs)}
        for a, b in pairs.tolist():
            if sets[a] & sets[b]:
                near[a, b] = False
    else:
        flat = np.concatenate([np.array(g, np.int64) for g in filters])
        row = np.repeat(np.arange(len(filters)), [len(g) for g in filters])
        row, flat = row[flat < f], flat[flat < f]
        _, column, copies = np.unique(flat, return_inverse=True, return_counts=True)
        shared = copies[column] > 1
        number = np.cumsum(copies > 1) - 1
        row, column = row[shared], number[column[shared]]
        for at in range(0, int((copies > 1).sum()), 2048):  # bounded memory
            here = (column >= at) & (column < at + 2048)
            member = np.zeros((len(x), 2048), np.float32)
            member[row[here], column[here] - at] = 1
            near &= ~(member @ member.T > 0)
    return near @ weight, label


def tiles(batches: Iterator) -> Iterator:
    """Rows (f, i, j, block, uid, x, fs, copies) in order of (f, i, j): (uid, n, root) of rows with links."""
    import numpy as np
    import pyarrow as pa

    out: list[tuple] = []
    for key, rows in runs(batches, 3):
        if len(rows) > 1:
            got = compared(units([r[2] for r in rows]), [r[3] for r in rows], np.array([r[0] for r in rows]) if key[1] != key[2] else None, key[0], np.array([r[4] for r in rows], np.int64))
            for r, n, k in zip(rows, got[0].tolist(), got[1].tolist()) if got else ():
                if n or rows[k][1] != r[1]:
                    out.append((r[1], n, rows[k][1]))
        if key is None:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["uid", "n", "root"])
            out = []
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["uid", "n", "root"])


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of embeddings(vec_id, embedding)."""
    n = parallelism(embeddings.sparkSession)
    v = saved(packed(embeddings.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))).withColumn("digest", F.unhex(F.sha2("x", 256))), "vectors")
    able = saved(v.where("x is not null").groupBy("digest", "x").agg(F.min("uid").alias("uid"), F.count("*").alias("copies")), "vectors-distinct")
    passed = saved(filtered(able.select("uid", "x"), able.count()), "vectors-filters").select("uid", "sketch", F.explode("filters").alias("f"))
    full = passed.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f", F.ceil(F.col("n") / TILE).cast("int").alias("blocks"))
    met = saved(passed.join(full, "f"), "vectors-met")
    few = met.where("blocks = 1").select("f", "uid", "sketch").repartition(n, "f").sortWithinPartitions("f").mapInArrow(active, "uid long, f long").withColumn("blocks", F.lit(1))
    own = few.unionByName(met.where("blocks > 1").select("uid", "f", "blocks")).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("f", "blocks"))).alias("own"))  # a vector's filters, some 50
    heavy = able.join(own, "uid").select("uid", "x", "copies", F.transform("own", lambda o: o.f).alias("fs"), F.explode("own").alias("o")).select("uid", "x", "copies", "fs", "o.f", "o.blocks")
    heavy = heavy.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    heavy = heavy.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = heavy.select("f", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "uid", "x", "fs", "copies")
    dealt = dealt.repartition(n, "f", "i", "j").sortWithinPartitions("f", "i", "j")
    found = saved(dealt.mapInArrow(tiles, "uid long, n long, root long").groupBy("uid", "root").agg(F.sum("n").alias("n")), "vectors-links")
    joined = components(found.where("uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b")), "vectors-components")
    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    classes = able.select("digest", "uid", "copies").join(counts, "uid", "left").join(joined, F.col("uid") == F.col("node"), "left")
    classes = classes.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", F.when(F.col("copies") > 1, F.col("uid"))).alias("component"))
    labelled = spread_join(v.select("uid", "vec_id", "digest"), classes, ["digest"], F.xxhash64("uid"), "left")  # copies can be a third of all rows
    labelled = saved(labelled.select("uid", "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component"), "vectors-labelled")
    least = labelled.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = spread_join(labelled, least, ["component"], F.xxhash64("uid"), "left").select("vec_id", "n_links", F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs: for the small tables that SQL checks run on.
OP2 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id
"""

QUERIES, SQL = {"op2_embeddings": op2_embeddings}, {"op2_embeddings": OP2}
