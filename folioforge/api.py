"""What a client calls, each a function from DataFrames to DataFrames: no server, no roles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import files as ff
from folioforge.functions.textops import preview
from folioforge.operators import chunking, classification, extraction, repository, retrieval, validation
from folioforge.session import stored
from folioforge.sources.files import read_document


def health(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(part, ready): whether each table, by its path, can be read."""
    rows = []
    for name, path in tables.items():
        try:
            spark.read.parquet(path).limit(1).count()
            rows.append((name, True))
        except Exception:
            rows.append((name, False))
    return spark.createDataFrame(rows, "part string, ready boolean")


def upload(files: DataFrame, docs: DataFrame, extract: Callable[[bytes, str], str] | None = None, ocr: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """What becomes of each of (name, content): a batch of any size, no file of which stops another.

    (original_filename, file_hash, success, is_duplicate, error, document_id of the stored document that a duplicate repeats, and of
    accepted files document_type, confidence, values, validation, company, invoice_number, total_amount, text_preview, chunks).
    A file is a duplicate where its hash is stored, or stands before in the batch (first by name).
    """
    named = files.select(F.col("name").alias("original_filename"), "name", "content", F.sha2("content", 256).alias("file_hash"))
    checked = named.withColumn("error", ff.upload_error(F.col("name"), F.col("content")))
    first = checked.filter("error IS NULL").groupBy("file_hash").agg(F.min("original_filename").alias("_first"))
    known = docs.filter("file_hash IS NOT NULL").groupBy("file_hash").agg(F.min("id").alias("document_id"))
    j = checked.join(first, "file_hash", "left").join(known, "file_hash", "left")
    again = F.col("error").isNull() & (F.col("document_id").isNotNull() | (F.col("_first") != F.col("original_filename")))
    outcome = stored(j.withColumn("is_duplicate", again).withColumn("success", F.col("error").isNull()).drop("_first"), "uploads")
    read = read_document(outcome.filter("success AND NOT is_duplicate"), "final", extract, ocr)
    told = classification.classify(read, "clean_text").withColumnRenamed("predicted_type", "document_type").withColumnRenamed("confidence_predicted", "confidence")
    told = told.withColumn("values", extraction.extract(F.col("clean_text"), F.col("document_type")))
    kept = repository.register_columns(F.col("document_type"), F.col("values"))
    made = told.select(
        "original_filename", "file_hash", "document_type", "confidence", "values", validation.validate(F.col("document_type"), F.col("values")).alias("validation"), kept.alias("_k"),
        preview(F.col("clean_text")).alias("text_preview"), F.size(chunking.packed(F.col("clean_text"))).alias("chunks"),
    ).select("*", "_k.*").drop("_k")
    return outcome.drop("name", "content").join(made, ["original_filename", "file_hash"], "left")


def batch_upload(files: DataFrame, docs: DataFrame, **readers) -> tuple[DataFrame, DataFrame]:
    """The outcomes of upload, and their counts in one row."""
    out = upload(files, docs, **readers)
    return out, repository.batch_outcomes(out.withColumn("processing_time_ms", F.lit(0.0)))


def documents(docs: DataFrame, query: str = "", status: str = "All", kind: str = "All") -> DataFrame:
    return repository.search(docs, query, status, kind)


def detail(docs: DataFrame, audit: DataFrame, key: int) -> DataFrame:
    return repository.audit_trail(docs, audit, key)


def edit(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents with the changed values of (id, changes map): merged into their flat values, checked again, shown in their columns.

    (id, values, validation, company, invoice_number, total_amount) of the changed documents.
    """
    j = docs.select("id", "document_type", repository.flat_values(docs).alias("values")).join(changes.select("id", "changes"), "id")
    j = j.withColumn("values", extraction.edited(F.col("values"), F.col("changes")))
    kept = repository.register_columns(F.col("document_type"), F.col("values"))
    return j.select("id", "values", validation.validate(F.col("document_type"), F.col("values")).alias("validation"), kept.alias("_k")).select("id", "values", "validation", "_k.*")


def assistant(questions: DataFrame, chunks: DataFrame, qkey: str, qtext: str, scope: str | None = None, features: int | None = retrieval.FEATURES) -> DataFrame:
    """An answer for each question, from all chunks or from the document that it names."""
    hits = stored(retrieval.retrieve(questions, chunks, qkey, qtext, "id", "chunk_text", features=features, scope=scope), "hits")
    spoken = stored(retrieval.best_sentences(hits, questions, chunks, qkey, qtext, "id", "chunk_text"), "sentences")
    return retrieval.every_answer(retrieval.answers(spoken, chunks, qkey, "id"), questions, qkey, qtext)


def dashboard(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return repository.dashboard(docs, chunks)


def recent_audit(audit: DataFrame, docs: DataFrame, limit: int = 50) -> DataFrame:
    """The last events; 1 to 200 of them."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    return repository.recent_audit(audit, docs, limit)


def audit_of_files(files: DataFrame) -> DataFrame:
    """A row for each file of what was found in it: type, confidence, missing fields and completeness."""
    told = classification.classify(files, "clean_text")

    def filled(k: str):
        f = extraction.fields(F.col("clean_text"), k)
        return F.struct(F.array_join(f["missing_fields"], ", ").alias("missing"), f["completeness"].alias("completeness"))

    kind = F.col("predicted_type")
    told = told.withColumn("_f", F.when(kind == "Invoice", filled("Invoice")).when(kind == "Resume", filled("Resume")).otherwise(filled("Other")))
    return told.select("name", "predicted_type", "confidence_predicted", F.coalesce(F.nullif(F.col("_f.missing"), F.lit("")), F.lit("None")).alias("missing_fields"), "_f.completeness")
