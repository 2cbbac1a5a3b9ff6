"""What a persisted index should hold, from its documents, against what it holds. Nothing is changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibrook.operators.index import postings


def compared(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(term, doc_id, expected, actual): null where a side has no such posting.

    Rows are sorted by doc_id first: a number settles most comparisons, where a common term would settle none."""
    want = postings(docs).withColumnRenamed("tf", "expected")
    both = want.join(index.select("term", "doc_id", F.col("tf").alias("actual")), ["doc_id", "term"], "full_outer")
    return both.select("term", "doc_id", "expected", "actual")


def document_drift(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """(kind, doc_id): missing from the index's documents, or extra in them."""
    missing = docs.select("doc_id").join(indexed, "doc_id", "left_anti").select(F.lit("missing").alias("kind"), "doc_id")
    return missing.unionByName(indexed.select("doc_id").join(docs, "doc_id", "left_anti").select(F.lit("extra").alias("kind"), "doc_id"))


def posting_drift(both: DataFrame) -> DataFrame:
    kind = F.when(F.col("actual").isNull(), "missing").otherwise("extra")
    return both.where("actual IS NULL OR expected IS NULL").select(kind.alias("kind"), "term", "doc_id")


def count_drift(both: DataFrame) -> DataFrame:
    return both.where("expected <> actual").select("doc_id", "term", "expected", "actual")


def extra_terms(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(term) of the index's terms that no document has. Terms are reduced where they are made, so postings aren't compared one by one."""
    sides = postings(docs).select("term", F.lit(True).alias("known")).unionByName(index.select("term", F.lit(False).alias("known")))
    return sides.groupBy("term").agg(F.bool_or("known").alias("known")).where("NOT known").select("term")


def report(docs: DataFrame, index: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: documents on each side, the number of findings of each kind, and ok. One pass over the comparison."""
    by_term = compared(docs, index).groupBy("term").agg(
        F.expr("count_if(actual IS NULL)").alias("missing"), F.expr("count_if(expected IS NULL)").alias("extra"), F.expr("count_if(expected <> actual)").alias("tf"), F.count("expected").alias("known")
    )
    terms = by_term.agg(
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_postings"), F.coalesce(F.sum("extra"), F.lit(0)).alias("extra_postings"),
        F.coalesce(F.sum("tf"), F.lit(0)).alias("tf_mismatches"), F.expr("count_if(known = 0)").alias("extra_terms"),
    )
    sides = docs.select("doc_id", F.lit(1).alias("s")).join(indexed.select("doc_id", F.lit(1).alias("i")), "doc_id", "full_outer")
    ids = sides.agg(F.count("s").alias("storage_docs"), F.count("i").alias("index_docs"), F.expr("count_if(i IS NULL)").alias("missing_docs"), F.expr("count_if(s IS NULL)").alias("extra_docs"))
    ok = F.expr("missing_docs + extra_docs + missing_postings + extra_postings + tf_mismatches + extra_terms = 0")
    return ids.crossJoin(terms).withColumn("ok", ok)
