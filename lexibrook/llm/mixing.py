"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources in code-point order (null last) weigh 1, 2, 3, repeating. Together they get the words of all documents; a target is
at most 3 times its source's words, and what is over goes to the others by weight. That water level follows in closed form
from the sources in order of cap over weight, with prefix sums over one row per source.

Each document of a source is expected target / source_size times. Within a source the documents stand in an order of size
(so that each stretch of the prefix sum holds like sizes); the prefix sum of expected copies, shifted by one offset in
[0, 1), crosses an integer once for each copy taken. The prefix sum is two-level: documents are counted in groups of
(source, size div 64, doc_id mod SPREAD), the groups are summed by source, and only a group is ranked in one task. A source
with a third of all rows is thus dealt over many tasks.

Edge cases: null text has size 0 and may be taken, adding no words; a source without words has target 0 and takes nothing;
null sources are one source; null doc_ids come first in their group; rows with the same doc_id are sampled as rows of their
own; an empty table gives no rows. The offset is a parameter, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexibrook.llm.common import saved, table

WORD, LIMIT, SPREAD, OFFSET = r"[^\x20\x09-\x0D]+", 3, 64, 0.5772156649


def targets(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, n_docs, target): one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = s.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * float(limit))
    every = Window.partitionBy()
    below = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(below), F.lit(0.0))).withColumn("lighter", F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.col("capped")) / (F.sum("weight").over(every) - F.col("lighter")))
    # the first source whose cap exceeds the level that is left for it and all after it
    s = s.withColumn("water", F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("capped"), F.col("level")))).over(every)["level"])
    return s.select("source", "source_size", "n_docs", F.least("cap", F.col("water") * F.col("weight")).alias("target"))


def with_sizes(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more)


def copies(sizes: DataFrame, rows: DataFrame | None = None, offset: float = OFFSET, limit: int = LIMIT) -> DataFrame:
    """rows(doc_id, source, size, ...) with source_size, target and copies, by systematic sampling within each source.

    sizes: the same rows without other columns, for the counts; rows is sizes unless given. Ties stand in the order of a row's hash."""
    rows, group = sizes if rows is None else rows, ["source", "bin", "part"]
    grouped = lambda df: df.withColumn("bin", F.expr("size div 64")).withColumn("part", F.coalesce(F.expr(f"pmod(doc_id, {SPREAD})"), F.lit(0)))
    counts = grouped(sizes).groupBy(*group).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bin", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*group, before.alias("first"))
    starts = starts.join(targets(sizes, limit).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = ["size", "doc_id"] + [F.xxhash64(*rows.columns)] * (len(rows.columns) > 3)
    ranked = grouped(rows).withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).alias("x")
    on = F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.bin") == F.col("y.bin")) & (F.col("x.part") == F.col("y.part"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("first") + F.col("r")
    taken = F.floor((at + 1) * each + offset) - F.floor(at * each + offset)
    keep = [F.col(f"x.{c}") for c in rows.columns]
    return ranked.join(starts.alias("y"), on).select(*keep, "source_size", "target", F.least(taken, F.lit(limit)).cast("long").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """docs, each row as often as the mix takes it: 0 to LIMIT times."""
    rows = with_sizes(docs, F.struct(*docs.columns).alias("row"))
    taken = copies(saved(with_sizes(docs), "mixing-sizes"), rows).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = saved(with_sizes(table(spark, sf_dir, "documents")), "mixing-sizes")
    return copies(sizes).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, sum(size)::DOUBLE * 3 AS cap FROM d GROUP BY source),
l AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS capped, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM s WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w AS (SELECT arg_min(level, capped) AS water FROM l WHERE cap / weight >= level),
t AS (SELECT source, source_size, least(cap, water * weight) AS target FROM l, w),
r AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source
        ORDER BY size // 64, coalesce(doc_id % {SPREAD}, 0), size, doc_id NULLS FIRST) - 1 AS r
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, CASE WHEN source_size > 0 THEN (least(3,
  floor((r + 1) * (target / source_size) + {OFFSET}::DOUBLE) - floor(r * (target / source_size) + {OFFSET}::DOUBLE)) * size)::BIGINT ELSE 0 END AS taken FROM r
"""

QUERIES, SQL = {"op7_mixing": op7_mixing}, {"op7_mixing": OP7}
