"""What the operators share: durable intermediate tables, file systems, joins of hot keys, ranges and connected components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibrook.sources.files import open_path as open_fs
from lexibrook.sources.files import saved, shared_dir

#: Tasks that a key's rows are dealt over in spread_join. Ranges: bytes of the least and the largest one, and how many there are at most.
SALT, LEAST_RANGE, LARGEST_RANGE, MOST_RANGES, LEAST_KEY = 64, 8 << 20, 256 << 20, 1 << 17, -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(df: DataFrame) -> None:
    """Deletes a table that saved() wrote, once nothing reads it any more."""
    fs, path = open_fs(df.saved_at)
    fs.delete_dir(path)


def values(column) -> Iterator:
    """The column's values one by one: a batch of long texts isn't held twice."""
    return (x.as_py() for x in column)


def rested() -> None:
    """Gives the system back what a worker process has freed; workers live on from stage to stage and would keep it beside the executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique, where a key may hold any share of left's rows.

    The rows of a key are dealt over SALT tasks by salt, which should differ between them. right is first joined with left's distinct
    (key, salt), of which a key has at most SALT. Both joins merge: either side may come from an explode, whose rows Spark's estimate
    leaves out, so it would broadcast tables of many times its threshold."""
    dealt = left.withColumn("_salt", F.pmod(salt, F.lit(SALT)).cast("int"))
    met = dealt.select(*keys, "_salt").distinct().join(right.hint("merge"), keys)
    return dealt.join(met.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def numbers(items: list[int]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(",".join(map(str, items))), ",").cast("array<bigint>") if items else F.expr("cast(array() as array<bigint>)")


def cuts_by_weight(rows: DataFrame, key: str, weight: str) -> list[int]:
    """Ascending keys at which ranges of about equal weight begin: twice as many ranges as shuffle partitions, but of LEAST_RANGE to
    LARGEST_RANGE bytes, and at most MOST_RANGES, so the list has a bound. A key of more weight than a range comes several times.

    rows(key, weight) is light and read in order of its key, null as the least number; the cuts follow from the sums over all rows
    before, so they don't depend on partitions."""
    import pyarrow as pa

    n = parallelism(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        task, total = TaskContext.get().partitionId(), 0
        for b in batches:
            sums = total + np.cumsum(b.column(1).to_numpy())
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([pa.array([task] * b.num_rows, pa.int32()), b.column(0), b.column(1), pa.array(sums, pa.int64())], ["task", "key", "weight", "until"])

    light = rows.select(F.coalesce(F.col(key), F.lit(LEAST_KEY)).cast("long").alias("key"), F.coalesce(F.col(weight), F.lit(0)).cast("long").alias("weight"))
    ordered = light.repartitionByRange(n, "key").sortWithinPartitions("key")
    summed = saved(ordered.mapInArrow(run, "task int, key long, weight long, until long"), "range-sums")
    tasks = summed.groupBy("task").agg(F.sum("weight").alias("n")).collect()  # a row for each of n tasks
    before, total = {}, 0
    for r in sorted(tasks, key=lambda r: r["task"]):
        before[r["task"]], total = total, total + r["n"]
    each = max(min(max(total // (2 * n), LEAST_RANGE), LARGEST_RANGE), -(-total // MOST_RANGES), 1)
    until = numbers([before.get(t, 0) for t in range(max(before, default=0) + 1)])[F.col("task")] + F.col("until")
    crossed = F.floor(until / each) - F.floor((until - F.col("weight")) / each)
    cuts = [k for r in summed.select("key", crossed.cast("long").alias("n")).where("n > 0").collect() for k in [r["key"]] * r["n"]]
    forget(summed)
    return sorted(cuts)


def range_of(key: Column, cuts: list[int], salt: Column) -> Column:
    """The number, from 0, of a key's range. Null is the least number; a key that is several cuts is dealt over its ranges by salt."""
    key, step = F.coalesce(key, F.lit(LEAST_KEY)), max(1, int(len(cuts) ** 0.5))
    every, coarse = numbers(cuts), numbers(cuts[step - 1 :: step])

    def below(test) -> Column:  # first among every step-th cut, then among the step cuts after those
        whole = F.size(F.filter(coarse, test)) * step
        return whole + F.size(F.filter(F.slice(every, whole + 1, step), test))

    low, high = below(lambda c: c < key), below(lambda c: c <= key)
    return F.when(high - low > 1, low + F.pmod(salt, high - low + 1)).otherwise(high).cast("int")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of the nodes of edges(a, b), component being the least node that can be reached.

    Alternating large-star and small-star rounds. A node's least neighbour is an aggregate that is joined back by spread_join, so a
    hub's neighbours are dealt over SALT tasks. Each round is a table in the shared folder, which the next one replaces."""
    e = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    before = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select("a", F.col("a").alias("component")).distinct())
        before, old = now, e
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = saved(spread_join(both, least, ["a"], F.xxhash64("b")).where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct(), name)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        down = spread_join(large, least, ["b"], F.xxhash64("a")).select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        e = saved(down.where("a < b").distinct(), name)
        forget(old)
        forget(large)
