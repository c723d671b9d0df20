"""Sources and sinks: files as bytes, labelled corpora, folders by category, models, downloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import files as ff
from folioforge.functions.textops import clean, token_count
from folioforge.operators.extraction import pdf_strings
from folioforge.session import file_system

LEAST_NATIVE_CHARS = 20
CORPUS = "id string, category string, text string"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, name, content, size, file_hash, mime_type, upload_error)."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    df = reader.load(path).select("path", name.alias("name"), "content", F.col("length").alias("size"))
    return df.withColumns({"file_hash": F.sha2("content", 256), "mime_type": ff.mime_type(F.col("name")), "upload_error": ff.upload_error(F.col("name"), F.col("content"))})


def read_text(files: DataFrame, extract: Callable[[bytes, str], str] | None = None, ocr: Callable[[bytes, str], str] | None = None, least: int = LEAST_NATIVE_CHARS) -> DataFrame:
    """files with raw_text, clean_text, method and token_count.

    extract reads native text (uncompressed PDF streams are read without it); ocr is asked only
    where that gives fewer than least characters, and its text counts only where it is longer.
    Neither may fail a row: an exception leaves its text empty.
    """

    def called(f: Callable[[bytes, str], str]):
        @F.pandas_udf("string")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for content, name in batches:
                out = []
                for c, n in zip(content, name):
                    try:
                        out.append(f(c, n) or "")
                    except Exception:
                        out.append("")
                yield pd.Series(out, dtype=object)

        return run

    native = called(extract)(F.col("content"), F.col("name")) if extract else pdf_strings(F.decode(F.col("content"), "ISO-8859-1"))
    df = files.withColumn("raw_text", F.coalesce(native, F.lit(""))).withColumn("method", F.lit("native"))
    if ocr:
        poor = F.length(F.trim("raw_text")) < least
        df = df.withColumn("_ocr", F.when(poor, called(ocr)(F.col("content"), F.col("name"))).otherwise(F.lit("")))
        better = F.length("_ocr") > F.length("raw_text")
        df = df.withColumn("method", F.when(better, "ocr").otherwise(F.col("method"))).withColumn("raw_text", F.when(better, F.col("_ocr")).otherwise(F.col("raw_text"))).drop("_ocr")
    df = df.withColumn("clean_text", clean(F.col("raw_text")))
    return df.withColumn("token_count", token_count(F.col("clean_text")))


#: What the stages take for a text good enough without recognition, and at how many dots an inch they recognise.
STAGES = {"final": {"least": 20, "dpi": 200}, "fifth": {"least": 40, "dpi": 150}, "third": {"least": 40, "dpi": 200}}


def read_document(files: DataFrame, stage: str = "final", extract: Callable[[bytes, str], str] | None = None, ocr: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """files with raw_text, clean_text and meta: struct(method, page_count, pages, char_count, token_count, dpi, is_readable).

    pages are the texts between form feeds; page_count is that of the PDF's page objects where it names any.
    """
    s = STAGES[stage]
    df = read_text(files, extract, ocr, s["least"])
    objects = F.size(F.regexp_extract_all(F.decode(F.col("content"), "ISO-8859-1"), F.lit(r"/Type\s*/Page(?![a-zA-Z])"), F.lit(0)))
    pages = F.split("raw_text", "\f")
    meta = F.struct(
        F.col("method"), F.when(objects > 0, objects).otherwise(F.size(pages)).alias("page_count"), F.transform(pages, lambda p: clean(p, compose=False)).alias("pages"),
        F.length("clean_text").alias("char_count"), F.col("token_count"), F.lit(s["dpi"]).alias("dpi"), (F.length("clean_text") >= s["least"]).alias("is_readable"),
    )
    return df.withColumn("meta", meta).drop("method", "token_count")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {id, category, text}."""
    return spark.read.schema(CORPUS).option("multiLine", True).json(path)


def write_by_category(df: DataFrame, path: str, kind: str = "document_type") -> None:
    """A folder for each category."""
    df.withColumn("category_dir", ff.folder(F.col(kind))).write.mode("append").partitionBy("category_dir").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def write_model_metadata(spark: SparkSession, path: str, facts: dict[str, str | float | int]) -> None:
    """What is known of a model, one JSON line beside it."""
    spark.range(1).select(*(F.lit(v).alias(k) for k, v in facts.items())).coalesce(1).write.mode("overwrite").json(path)


def delete_file(path: str) -> bool:
    """Deletes a stored file; False where there is none."""
    system, at = file_system(path)
    if not system.get_file_info(at).is_file:
        return False
    system.delete_file(at)
    return True


def read_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
