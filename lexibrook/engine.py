"""A folder of documents with its log and index, as one object.

    <root>/log        record files, numbered by add: the commit point
    <root>/documents  Parquet (doc_id, text), what the log was applied to
    <root>/postings   Parquet (term, doc_id, tf), derived; index() writes it anew
    <root>/indexed    Parquet (doc_id), the documents that the index was made from
    <root>/files      Parquet (doc_id, path), where documents came from that were added as files
    <root>/incoming   what an add is about to log, while it runs

One writer at a time. A null text is stored as an empty one; a null id is an error; other columns of what is added are ignored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibrook.functions.text import preview, query_terms
from lexibrook.operators import consistency, search
from lexibrook.operators.index import postings, write_postings
from lexibrook.plans import storage
from lexibrook.sources import records
from lexibrook.sources.files import open_path, read_text_files
from lexibrook.streaming.ingest import stored_documents


class NoDocuments(LookupError):
    pass


class Engine:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return bool(records.files_at(self.at(name)))

    def documents(self) -> DataFrame:
        return stored_documents(self.spark, self.at("documents"))

    def log(self) -> DataFrame:
        """Valid records of the log as (path, offset, doc_id, text); paths are in the order of commits. Ids that no bigint holds are an error."""
        scanned = records.valid(records.read_records(self.spark, self.at("log")))
        doc_id = F.when(F.col("doc_id") <= F.lit(str((1 << 63) - 1)).cast("decimal(20,0)"), F.col("doc_id")).otherwise(F.raise_error(F.lit("the log holds a document id of 2**63 or more")))
        return scanned.select("path", "offset", doc_id.cast("bigint").alias("doc_id"), F.decode("payload", "UTF-8").alias("text"))

    def taken(self) -> DataFrame:
        """(doc_id) of all that is stored or logged."""
        return self.documents().select("doc_id").unionByName(self.log().select("doc_id"))

    def incoming(self, rows: DataFrame) -> DataFrame:
        """rows, written once: what is added is read from here, so it can't differ between the guard, the log and storage."""
        path = f"{self.at('incoming')}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        out = self.spark.read.schema(rows.schema).parquet(path)
        out.written_at = path
        return out

    def clear(self, path: str | None = None) -> None:
        fs, at = open_path(path or self.at("incoming"))
        fs.delete_dir(at)

    def add(self, docs: DataFrame) -> None:
        """Adds docs(doc_id, text), whose ids are neither stored nor logged: to the log first, then to storage."""
        rows = self.incoming(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
        try:
            storage.guarded(rows, self.taken())
            records.append_records(rows.select("doc_id", F.encode("text", "UTF-8").alias("payload")), self.at("log"))
            rows.write.mode("append").parquet(self.at("documents"))
        finally:
            self.clear(rows.written_at)

    def add_files(self, path: str) -> DataFrame:
        """Adds text files, with the next ids in order of their paths; returns (doc_id, path)."""
        files = read_text_files(self.spark, path)
        paths = self.incoming(files.select("path").repartitionByRange("path").sortWithinPartitions("path").withColumn("nth", F.monotonically_increasing_id()))
        last = self.last_id()
        ids = self.incoming(storage.next_ids(paths, self.spark.createDataFrame([(last,)], "doc_id long"), "nth").select(F.col("new_id").alias("doc_id"), "path"))
        self.add(files.join(ids, "path").select("doc_id", "text"))
        ids.write.mode("append").parquet(self.at("files"))
        self.clear()
        return self.spark.read.schema("doc_id bigint, path string").parquet(self.at("files")).where(F.col("doc_id") > last)

    def last_id(self) -> int:
        """The greatest id that is stored or logged, 0 if there is none."""
        return self.taken().agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("n")).first()["n"]

    def get(self, doc_id: int) -> str:
        """The text of one document, or DocumentNotFound."""
        return storage.get(self.documents(), doc_id)

    def index(self) -> tuple[int, int]:
        """Builds the index anew; (documents, terms)."""
        docs = self.documents()
        write_postings(docs, self.at("postings"))
        docs.select("doc_id").write.mode("overwrite").parquet(self.at("indexed"))
        return docs.count(), self.postings().select("term").distinct().count()

    def postings(self) -> DataFrame:
        """The persisted index, or the documents' postings where there is none."""
        if self.exists("postings"):
            return self.spark.read.schema("term string, doc_id bigint, tf bigint").parquet(self.at("postings"))
        return postings(self.documents())

    def search(self, query: str, mode: str = "and", ranked: bool = False, n: int | None = None) -> DataFrame:
        """(doc_id, preview), or with ranked (rank, doc_id, score, exact, preview)."""
        if not self.exists("documents"):
            raise NoDocuments(self.root)
        docs, index = self.documents(), self.postings()
        if ranked:
            return search.hydrate(search.search_ranked(docs, index, query, mode, exact=True), docs, n or 80).orderBy("rank")
        return search.hydrate(search.match(index, query_terms(query), search.checked(mode)), docs, n or 120).orderBy("doc_id")

    def list_documents(self) -> DataFrame:
        return self.documents().select("doc_id", F.octet_length("text").alias("size"), preview(F.col("text"), 120).alias("preview"))

    def stats(self) -> dict:
        row = self.documents().agg(F.count("*").alias("documents"), F.min("doc_id").alias("min_id"), F.max("doc_id").alias("max_id"), F.coalesce(F.sum(records.size_of(F.col("text"))), F.lit(0)).alias("bytes")).first().asDict()
        ends = records.status(records.read_records(self.spark, self.at("log"), payload=False)).agg(F.coalesce(F.sum("n_valid"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("bad")).first()
        return row | {"next_id": self.last_id() + 1, "terms": self.postings().select("term").distinct().count(), "log_records": ends["n"], "log_bytes": ends["total"], "log_status": ends["bad"] or "ok"}

    def check(self) -> dict:
        """The consistency report of the persisted index."""
        docs = self.documents()
        indexed = self.spark.read.parquet(self.at("indexed")) if self.exists("indexed") else docs.select("doc_id")
        return consistency.report(docs, self.postings(), indexed).first().asDict()

    def recover(self) -> dict:
        """Applies what the log has and storage lacks, the first commit of each id, then cuts bad tails off the log's files. The report is
        storage.recovery_report's, and the bytes removed."""
        ends = records.status(records.read_records(self.spark, self.at("log"), payload=False))
        log, docs = self.log().select("doc_id", "text", F.struct("path", "offset").alias("offset")), self.documents()
        report = storage.recovery_report(log, docs, ends).first().asDict()
        storage.replay(log, docs).select("doc_id", "text").write.mode("append").parquet(self.at("documents"))
        return report | {"removed": storage.cut_tails(ends)}
