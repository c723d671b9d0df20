"""Chunks of texts for retrieval: sliding windows and packed paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.textops import stripped, token_count

SIZE, OVERLAP = 350, 60


def sliding(df: DataFrame, text: str, key: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, chunk_text, token_count): windows of size characters, each overlap into the next; blank ones are left out."""
    step = max(size - (overlap or OVERLAP), 50)
    t = df.select(F.col(key), stripped(F.coalesce(F.col(text), F.lit(""))).alias("_t")).filter("_t <> ''")
    starts = F.sequence(F.lit(0), F.length("_t") - 1, F.lit(step))
    w = t.select(key, "_t", F.explode(starts).alias("_s")).select(key, "_s", stripped(F.substring(F.col("_t"), F.col("_s") + 1, F.lit(size))).alias("chunk_text"))
    # a window counts only non-blank windows before it; only inner blanks of size characters could shift it
    return w.filter("chunk_text <> ''").select(key, (F.col("_s") / step).cast("int").alias("chunk_index"), "chunk_text", token_count(F.col("chunk_text")).alias("token_count"))


def packed(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed into chunks of at most size characters; a new chunk starts with the last overlap characters of the one before. A longer paragraph stays whole."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\n"), stripped), lambda p: p != "")

    def step(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        fits = F.length(cur) + F.length(p) + 1 <= size
        joined = stripped(F.concat(cur, F.lit("\n"), p))
        carried = F.when(F.length(cur) > overlap, F.concat(F.right(cur, F.lit(overlap)), F.lit(" "), p)).otherwise(p)
        done = F.when(fits | (cur == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(cur)))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(carried).alias("cur"))

    return F.aggregate(
        paragraphs,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")),
        step,
        lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))),
    )


def packed_chunks(df: DataFrame, text: str, key: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    return df.select(key, F.posexplode(packed(F.col(text), size, overlap)).alias("chunk_index", "chunk_text")).withColumn("token_count", token_count(F.col("chunk_text")))


def packed_pages(df: DataFrame, pages: str, key: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, page_number, chunk_text, token_count): each page of an array packed on its own, the counter runs on over the pages.

    Pages without text give no chunk but count as pages.
    """
    made = F.transform(F.col(pages), lambda p, i: F.transform(packed(p, size, overlap), lambda c: F.struct((i + 1).alias("page_number"), c.alias("chunk_text"))))
    flat = df.select(key, F.posexplode(F.flatten(made)).alias("chunk_index", "c")).select(key, "chunk_index", "c.page_number", "c.chunk_text")
    return flat.withColumn("token_count", token_count(F.col("chunk_text")))
