"""The inverted index: postings(term, doc_id, tf), derived from documents(doc_id, text)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexibrook.functions.text import STOPWORDS, raw_tokens, text_column, tokens
from lexibrook.sources.files import open_path

#: Documents for one row of a posting list: a term that stands in all documents has many rows, none of them large.
LIST_SPAN = 4096


def postings(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """One row for each term of each document, (term, doc_id, tf); with terms, of these normalized terms alone. doc_ids must be unique: see newest().

    A document's terms are counted within its row: its tokens are sorted, and a term's count is the length of its run. So nothing is
    shuffled. Null or empty text, or text of stop words alone, gives no rows. No row is filtered by its tokens, since Spark would
    move the test down and make the tokens once more for it; with terms, texts that don't hold one as a part aren't cut into tokens."""
    text = text_column(docs)
    if terms is None:
        words = tokens(text)
    else:
        wanted = sorted(set(terms) - set(STOPWORDS))
        docs = docs.where(reduce(or_, [F.lower(text).contains(t) for t in wanted], F.lit(False)))
        words = F.filter(raw_tokens(text), lambda t: t.isin(*wanted) if wanted else F.lit(False))
    words = docs.select("doc_id", F.sort_array(words).alias("_words"))
    first = lambda i: (i == 0) | (F.get("_words", i) != F.get("_words", i - 1))
    runs = words.withColumn("_at", F.when(F.size("_words") > 0, F.filter(F.sequence(F.lit(0), F.size("_words") - 1), first)))
    each = F.transform("_at", lambda at, k: F.struct(F.get("_words", at).alias("term"), (F.coalesce(F.get("_at", k + 1), F.size("_words")) - at).cast("long").alias("tf")))
    return runs.select("doc_id", F.explode(each).alias("_p")).select("_p.term", "doc_id", "_p.tf")


def newest(docs: DataFrame, version: str = "version") -> DataFrame:
    """One row for each doc_id, that of the greatest version: adding a document again replaces it. Ties go to the least text."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(version), *[c for c in ("text",) if c in docs.columns]))
    return docs.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def write_postings(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The index as Parquet, in ranges of terms, so that a query's terms meet few row groups.

    Postings are first written as they come, next to the index: finding the bounds of the ranges reads their terms there and doesn't
    tokenize again. One shuffle puts them in order; a common term is split by doc_id over as many ranges as it needs."""
    first = f"{path.rstrip('/')}.unsorted"
    postings(docs).write.mode("overwrite").parquet(first)
    rows = docs.sparkSession.read.schema("term string, doc_id bigint, tf bigint").parquet(first)
    rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode(mode).parquet(path)
    fs, at = open_path(first)
    fs.delete_dir(at)


def without(index: DataFrame, removed: DataFrame) -> DataFrame:
    """The index without the documents of removed(doc_id); terms left empty vanish."""
    return index.join(removed.select("doc_id"), "doc_id", "left_anti").select("term", "doc_id", "tf")


def posting_lists(index: DataFrame) -> DataFrame:
    """(term, span, n, doc_ids): ascending ids, comma-joined, of each stretch of LIST_SPAN ids."""
    lists = index.groupBy("term", F.expr(f"doc_id div {LIST_SPAN}").alias("span")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return lists.select("term", "span", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("doc_ids"))


def term_documents(index: DataFrame, term: str) -> DataFrame:
    return index.where(F.col("term") == term).select("doc_id")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def frequencies_of(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) of terms(term), 0 where the index doesn't have it."""
    return terms.join(document_frequency(index), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def token_frequencies(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of probes(doc_id, term), 0 where absent."""
    return probes.join(index, ["doc_id", "term"], "left").select("doc_id", "term", F.coalesce("tf", F.lit(0)).alias("tf"))


def stats(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(n_docs, n_terms): documents without tokens count."""
    return docs.agg(F.count("*").alias("n_docs")).crossJoin(index.agg(F.count_distinct("term").alias("n_terms")))
