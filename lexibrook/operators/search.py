"""Boolean search and TF-IDF ranking over postings.

Scores are ranked rounded to DIGITS, so that ranks don't depend on the order of additions; `exact` is the sum before rounding, for
display. Edge cases: documents without tokens (null or empty text) match nothing and score 0 as candidates; an empty index gives no
rows; postings of documents that are gone keep their place in results, with an empty preview; extra columns of documents are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexibrook.functions.text import query_terms, tokens

MODES, DIGITS = ("and", "or"), 6
#: Documents of equal score that are numbered in one task; results that are few, for hydrate.
RANK_SPAN, FEW = 65536, 1000


def checked(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    return mode


def match(index: DataFrame, terms: list[str], mode: str = "and") -> DataFrame:
    """(doc_id) of the documents with all, or any, of the normalized terms; none for no terms."""
    terms = sorted(set(terms))
    found = index.where(F.col("term").isin(*terms) if terms else F.lit(False))
    if checked(mode) == "or" or len(terms) < 2:
        return found.select("doc_id").distinct()
    return found.groupBy("doc_id").agg(F.count("*").alias("m")).where(F.col("m") == len(terms)).select("doc_id")


def search(index: DataFrame, query: str, mode: str = "and") -> DataFrame:
    """The same for a query's text."""
    return match(index, query_terms(query), checked(mode))


def search_batch(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) of queries(query_id, query, mode): one pass over the index for all of them."""
    terms = queries.select("query_id", "mode", F.array_distinct(tokens(F.col("query"))).alias("terms"))
    wanted = terms.select("query_id", "mode", F.size("terms").alias("k"), F.explode("terms").alias("term"))
    hits = index.join(wanted, "term").groupBy("query_id", "mode", "k", "doc_id").agg(F.count("*").alias("m"))
    return hits.where("mode = 'or' OR m = k").select("query_id", "doc_id")


def idf(index: DataFrame, n_docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, df, idf) with idf = ln(n / df); 0 for a term of terms(term) that no document has. n_docs: one row (n)."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    if terms is not None:
        df = terms.join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", F.when(F.col("df") > 0, F.log(F.col("n") / F.col("df"))).otherwise(0.0).alias("idf"))


def count_documents(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"))


def scored(docs: DataFrame, index: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, m, score, exact): m of the distinct terms stand in the document; exact sums tf * idf, score is that rounded to DIGITS."""
    terms = sorted(set(terms))
    found = index.where(F.col("term").isin(*terms) if terms else F.lit(False))
    weights = F.broadcast(idf(found, count_documents(docs)).select("term", "idf"))  # a row for each query term
    return found.join(weights, "term").groupBy("doc_id").agg(F.count("*").alias("m"), F.sum(F.col("tf") * F.col("idf")).alias("exact")).select("doc_id", "m", F.round("exact", DIGITS).alias("score"), "exact")


def numbered(hits: DataFrame, repeats: bool = False) -> DataFrame:
    """(rank, ...): hits(doc_id, score) numbered from 1 by score, then doc_id.

    Two-level: groups of equal score and near doc_id are counted, the counts are summed in order, and only a group is numbered in
    a task, so a common score isn't sorted in one place."""
    rows = hits.withColumn("_span", F.expr(f"doc_id div {RANK_SPAN}"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("score"), "_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("score", "_span").agg(F.count("*").alias("_n")).select("score", "_span", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy("score", "_span").orderBy("doc_id"))
    return rows.withColumn("_nth", nth).join(starts, ["score", "_span"]).select((F.col("_before") + F.col("_nth")).cast("long").alias("rank"), *hits.columns)


def rank_documents(docs: DataFrame, index: DataFrame, candidates: DataFrame, terms: list[str]) -> DataFrame:
    """(rank, doc_id, score) of the candidates as given, repeats and score 0 included; none for no terms."""
    if not terms:
        return numbered(candidates.select("doc_id", F.lit(0.0).alias("score")).where("false"))
    scores = scored(docs, index, terms)
    return numbered(candidates.join(scores, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score")))


def hits(docs: DataFrame, index: DataFrame, query: str, mode: str = "and", exact: bool = False) -> DataFrame:
    """(doc_id, score), with exact also that column: the test of the mode and the score come from one aggregate."""
    terms = sorted(set(query_terms(query)))
    if terms:
        checked(mode)
    found = scored(docs, index, terms)
    return (found if mode == "or" else found.where(F.col("m") == len(terms))).select("doc_id", "score", *["exact"] * exact)


def search_ranked(docs: DataFrame, index: DataFrame, query: str, mode: str = "and", exact: bool = False) -> DataFrame:
    """(rank, doc_id, score), with exact also that column. An empty query has no results, whatever the mode."""
    return numbered(hits(docs, index, query, mode, exact))


def search_top(docs: DataFrame, index: DataFrame, query: str, mode: str = "or", k: int = 10) -> DataFrame:
    """The first k of search_ranked, without ranking the rest (an extension)."""
    top = hits(docs, index, query, mode).orderBy(F.desc("score"), "doc_id").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long").alias("rank"), "doc_id", "score")


def hydrate(found: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Results with the first n characters of their texts; an empty preview where the document is gone.

    Results are computed here. Up to FEW rows come to the driver, and their ids go to the scan of the texts, so that row groups without
    them aren't read; more are joined with all texts."""
    first = found.limit(FEW + 1).toArrow()
    if first.num_rows <= FEW:
        ids = [i for i in first["doc_id"].unique().to_pylist() if i is not None]
        found, docs = docs.sparkSession.createDataFrame(first, found.schema), docs.where(F.col("doc_id").isin(*ids) if ids else F.lit(False))
    texts = docs.select("doc_id", F.substring("text", 1, n).alias("preview"))
    return found.join(texts, "doc_id", "left").withColumn("preview", F.coalesce("preview", F.lit("")))
