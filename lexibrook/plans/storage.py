"""Stored documents and the log: guarded appends, lookup, ids, replay and reports, as relational plans.

Storage is Parquet, whose commits leave no torn tail, so opening it needs no prefix rule; record_store opens storage that is kept as
record files. Edge cases: null text is stored as it comes; a null doc_id is in no lookup; empty tables give empty results, and reports
of zeros; other columns are ignored or, in next_ids and replay, kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexibrook.sources import records


class DuplicateDocument(ValueError):
    pass


class DocumentNotFound(LookupError):
    pass


def lookup(stored: DataFrame, doc_id: int) -> DataFrame:
    """(doc_id, text) of one document: the id goes to the Parquet scan as a filter."""
    return stored.where(F.col("doc_id") == doc_id).select("doc_id", "text")


def get(stored: DataFrame, doc_id: int) -> str | None:
    """The text of one document, or DocumentNotFound."""
    row = lookup(stored, doc_id).first()
    if row is None:
        raise DocumentNotFound(str(doc_id))
    return row["text"]


def cut_tails(ends: DataFrame) -> int:
    """Cuts files down to their valid prefix; ends: a row (path, good_offset, total) for each file. Returns the bytes removed."""
    return sum(records.truncate_tail(r["path"], r["good_offset"]) for r in ends.where("good_offset < total").select("path", "good_offset").toLocalIterator())


def already_stored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return incoming.select("doc_id").join(stored.select("doc_id"), "doc_id", "left_semi").distinct()


def guarded(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming, or DuplicateDocument if an id is stored or comes twice."""
    again = incoming.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    first = already_stored(incoming, stored).unionByName(again).take(1)
    if first:
        raise DuplicateDocument(str(first[0]["doc_id"]))
    return incoming


def next_ids(incoming: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """incoming with new_id: dense, from the greatest stored id (0 if none) plus 1, in order of a unique column of whole numbers.

    A two-level number: only rows of one stretch of the order are numbered in a task."""
    rows = incoming.withColumn("_span", F.expr(f"{order} div 65536"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_span").agg(F.count("*").alias("_n")).select("_span", before.alias("_before"))
    last = stored.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("_last"))
    nth = F.row_number().over(Window.partitionBy("_span").orderBy(order))
    numbered = rows.withColumn("_nth", nth).join(starts, "_span").crossJoin(F.broadcast(last))
    return numbered.select((F.col("_last") + F.col("_before") + F.col("_nth")).cast("long").alias("new_id"), *incoming.columns)


def first_of_each(log: DataFrame) -> DataFrame:
    """The row with the least offset of each doc_id."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("offset"))
    return log.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def replay(log: DataFrame, stored: DataFrame) -> DataFrame:
    """The log's documents that storage lacks; the first version of each wins. Appending them makes a second replay empty."""
    return first_of_each(log).join(stored.select("doc_id"), "doc_id", "left_anti")


def replay_report(log: DataFrame, stored: DataFrame) -> DataFrame:
    """(examined, recovered, skipped) of a replay: valid records of the log, those that storage gets, and the others."""
    ids = log.groupBy("doc_id").agg(F.count("*").alias("n"))
    known = ids.join(stored.select("doc_id").distinct().withColumn("_known", F.lit(True)), "doc_id", "left")
    out = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("examined"), F.expr("count_if(_known IS NULL)").alias("recovered"))
    return out.withColumn("skipped", F.col("examined") - F.col("recovered"))


def recovery_report(log: DataFrame, stored: DataFrame, ends: DataFrame) -> DataFrame:
    """One row: replay_report and how the log's files ended: incomplete_tail, corruption, tail_truncated, truncated_bytes (what cutting the
    tails removes), completed (the whole log was valid) and reason (the first file's that has one). ends: records.status of the log."""
    bad = ends.agg(
        F.coalesce(F.bool_or(F.col("status") == "incomplete_tail"), F.lit(False)).alias("incomplete_tail"), F.coalesce(F.bool_or(F.col("status") == "corruption"), F.lit(False)).alias("corruption"),
        F.coalesce(F.sum(F.col("total") - F.col("good_offset")), F.lit(0)).alias("truncated_bytes"), F.min(F.when(F.col("reason").isNotNull(), F.struct("path", "reason"))).alias("first"),
    )
    whole = replay_report(log, stored).crossJoin(bad)
    return whole.select(
        "examined", "recovered", "skipped", "incomplete_tail", "corruption", (F.col("truncated_bytes") > 0).alias("tail_truncated"), "truncated_bytes",
        (~F.col("incomplete_tail") & ~F.col("corruption")).alias("completed"), F.coalesce("first.reason", F.lit("")).alias("reason"),
    )


def missing_from_storage(log: DataFrame, stored: DataFrame) -> DataFrame:
    return log.select("doc_id").distinct().join(stored.select("doc_id"), "doc_id", "left_anti")
