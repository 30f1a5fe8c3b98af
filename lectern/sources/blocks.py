"""Scans: tables, text lines, HTML elements and conversation turns as ordered blocks.

Every block carries (doc_id, ord): frames have no order of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text, stable_id

#: Lines of a page, where a source has no pages.
PAGE_LINES = 20
#: Upload gate: accepted endings and greatest size.
ENDINGS, MOST_BYTES = ("pdf", "docx", "txt"), 50 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, pos, line, page, block_id): a row a line, from whole texts."""
    rows = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("*", (F.floor(F.col("pos") / PAGE_LINES) + 1).cast("int").alias("page"), stable_id("blk", "doc_id", "pos").alias("block_id"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ord, tag, text) of h1, p and li elements; scripts, styles and comments are taken out first."""
    bare = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<((?:h1|p|li)\b[^>]*>[^<]*(?:<(?!/?(?:h1|p|li)\b)[^>]*>[^<]*)*)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "raw"))
    text = normalize_text(F.regexp_replace(F.regexp_replace("raw", r"^[^>]*>", ""), r"<[^>]*>", " "))
    return rows.select("page_id", "ord", F.lower(F.regexp_extract("raw", r"^([A-Za-z0-9]+)", 1)).alias("tag"), text.alias("text")).where("text <> ''")


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, ord, text): parts between blank lines."""
    rows = docs.select("doc_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("ord", "part"))
    return rows.select("doc_id", "ord", F.trim("part").alias("text")).where("text <> ''")


def turns(conversations: DataFrame) -> DataFrame:
    """Turns as blocks: the user speaks the source language, the assistant the target language; four turns are a page."""
    language = F.when(F.col("role") == "user", "zh").when(F.col("role") == "assistant", "en").otherwise("unknown")
    return conversations.select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").cast("int").alias("ord"),
        (F.floor(F.col("turn") / 4) + 1).cast("int").alias("page"),
        "role",
        language.alias("language"),
        "text",
        F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("block_id"),
    )


def upload_violation(path: Column, size: Column) -> Column:
    """Why a file is not accepted; null where it is."""
    ending = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    return F.when(~ending.isin(*ENDINGS), "unsupported type").when(size == 0, "empty file").when(size > MOST_BYTES, "larger than 50 MB")


def files(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """(path, length, content) of files, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
