"""The queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.history import repeats
from folioforge.llm.leakage import leaks
from folioforge.llm.privacy import labelled, mentions, redacted
from folioforge.llm.scans import Findings, repaired
from folioforge.llm.sentences import sentence_units
from folioforge.llm.splitting import WHITE_SPACE, filled_pages, oversized, split_oversized
from folioforge.llm.tokens import encode
from folioforge.plans.registry import Registry
from folioforge.session import table

registry = Registry()


@registry.query("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["id", "document_type", "company", "invoice_number", "file_hash", "batch_no"]
    return repeats(table(spark, sf, "doc_records").select(*cols))


_WHITE = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)


@registry.query("p5_found", f"SELECT DISTINCT id FROM rag_chunks WHERE length(trim(chunk_text, {_WHITE})) > 350")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    chunks = oversized(table(spark, sf, "rag_chunks").select("id", "chunk_text"))
    return split_oversized(chunks).filter("piece_count > 1 AND piece_index = 0").select("id").distinct()


@registry.query("p5_pieces")
def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "rag_chunks")
    pages = filled_pages(chunks.select("id", "document_id", "chunk_index", "page_number").dropDuplicates(["id"]))
    long = oversized(chunks.select("id", "document_id", "chunk_text")).dropDuplicates(["id"]).join(pages.select("id", "page_number"), "id")
    cols = ["id", "document_id", "page_number", "chunk_text"]
    return split_oversized(long.select(*cols)).filter("piece_count > 1")


@registry.query("p7_ids")
def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents"))


@registry.query("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_items"))


@registry.query("p9_found")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_units(table(spark, sf, "documents"))


@registry.query("p9_units")
def p9_units(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_units(table(spark, sf, "documents"), with_text=True)


def _pii_texts(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(
        [
            ("documents_corpus", table(spark, sf, "documents_corpus"), "id", "text"),
            ("rag_chunks", table(spark, sf, "rag_chunks"), "id", "chunk_text"),
            ("doc_records", table(spark, sf, "doc_records"), "id", "text_preview"),
        ]
    )


@registry.query("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(_pii_texts(spark, sf)).select("table_name", "row_key", "pii_type", "start_pos").distinct()


@registry.query("p3_redacted")
def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    texts = _pii_texts(spark, sf)
    # repeated rows meet where the join has brought them, so texts move once
    return redacted(texts, mentions(texts)).select("table_name", "row_key", "text_redacted").distinct()


def _scan_texts(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "rag_chunks").select(
        F.lit("rag_chunks").alias("table_name"), F.col("id").cast("string").alias("row_key"), F.col("document_id").cast("string").alias("doc_key"), F.col("chunk_text").alias("text"), F.lit(True).alias("paged")
    )
    previews = table(spark, sf, "doc_records").select(
        F.lit("doc_records").alias("table_name"), F.col("id").cast("string").alias("row_key"), F.col("id").cast("string").alias("doc_key"), F.col("text_preview").alias("text"), F.lit(False).alias("paged")
    )
    return chunks.unionByName(previews)


@registry.query("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return Findings(_scan_texts(spark, sf)).kinds()


@registry.query("p6_repaired")
def p6_repaired(spark: SparkSession, sf: str) -> DataFrame:
    texts = _scan_texts(spark, sf)
    return repaired(texts, Findings(texts))
