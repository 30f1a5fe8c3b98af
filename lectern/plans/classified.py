"""Queries over classes of blocks and pages, headings and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as C
from ..sources import blocks as B
from .blocks import LINES
from .registry import query, values

BLOCKS = [
    (1, 0, "History of change", "paragraph", None, None, "revision_history", "ignored revision history"),
    (1, 1, "3 / 10", "paragraph", None, None, "page_number", "ignored page number"),
    (1, 2, "Document No: QM-01", "paragraph", None, None, "document_metadata", "ignored document metadata"),
    (1, 3, "Early words here", "paragraph", None, None, "main_english_translation", "ignored before review start"),
    (1, 4, "2.0 Quality system", "heading", "2.0", "2.0 Quality system", "section_title", "ignored heading"),
    (1, 5, "The company shall comply.", "paragraph", "2.0", "2.0 Quality system", "main_english_translation", "eligible"),
    (1, 6, "公司应遵守。", "paragraph", "2.0", "2.0 Quality system", "main_chinese_paragraph", "eligible"),
    (1, 7, "范围 Range", "paragraph", "2.0", "2.0 Quality system", "unknown", "ignored mixed short term"),
    (1, 8, "--", "paragraph", "2.0", "2.0 Quality system", "neutral", "neutral"),
    (1, 9, "logo", "image_or_visual", None, None, "image_or_visual", "ignored image or visual"),
]


@query("SELECT * FROM " + values([(b[0], b[1], b[6], b[7]) for b in BLOCKS], "doc_id, ord, class, route"))
def q_block_classes(spark, sf_dir):
    rows = spark.createDataFrame([b[:6] for b in BLOCKS], "doc_id int, ord int, text string, block_type string, section string, section_heading string")
    return C.classified(rows).select("doc_id", "ord", "class", "route")


PAGES = [
    (1, 1, "paragraph", "Cover"), (1, 2, "paragraph", "History of Change"), (1, 2, "table_row", "A | 2020-01-02 | first"), (1, 4, "table_row", "B | 2021-01-02 | next"), (1, 6, "paragraph", "Table of Contents"),
    (1, 9, "table_row", "QSP0401 | 4.2.3 | x"), (1, 9, "table_row", "QSP0402 | 4.2.4 | x"), (1, 9, "table_row", "WI0403 | 4.2.5 | x"),
]


@query("SELECT * FROM " + values([("contents", 1, 6), ("history", 1, 2), ("history", 1, 3), ("history", 1, 4), ("history", 1, 5), ("references", 1, 9)], "kind, doc_id, page"))
def q_special_pages(spark, sf_dir):
    rows = spark.createDataFrame(PAGES, "doc_id int, page int, block_type string, text string")
    contents = C.contents_pages(rows)
    kinds = {"contents": contents, "history": C.history_pages(rows, contents), "references": C.reference_pages(rows)}
    out = None
    for name, df in kinds.items():
        df = df.select(F.lit(name).alias("kind"), "doc_id", "page")
        out = df if out is None else out.unionByName(df)
    return out


TITLES = [("4.2 文件控制", "Control of Documents"), ("质量管理体系标准", "Quality Management System Specification"), ("测量、分析和改进", "Measurement, Analysis and Improvement"), ("本公司应建立文件控制程序。", None), ("plain", None)]


@query("SELECT * FROM " + values(TITLES, "text, english"))
def q_heading_glossary(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in TITLES], "text string").select("text", C.heading_translation("text").alias("english"))


@query("""SELECT topic, 'RF_' || substr(sha256(m), 1, 12) AS finding_id FROM (VALUES ('applicability and transition', 'mdd-mdr' || chr(31) || 'b1'), ('program naming', 'cmdcas' || chr(31) || 'b3')) t(topic, m)""")
def q_observations(spark, sf_dir):
    rows = [("EU MDD 93/42/EEC", "MDD 93/42/EEC", "b1"), ("EU MDR Regulation (EU) 2017/745", "EU MDR", "b2"), ("Canadian Medical Devices Regulations", "CMDCAS", "b3")]
    return C.observations(spark.createDataFrame(rows, "name string, citation string, block_id string"))


TARGETS = [("iso-13485", "ISO 13485", "2016", True), ("ISO 13485:2016", "ISO 13485", "2016", True), ("ISO 13485:2003", "ISO 13485", "2016", False), ("ISO 13485 unknown", "ISO 13485", "unknown", False)]


@query("SELECT * FROM " + values(TARGETS, "name, target, version, matches"))
def q_target_match(spark, sf_dir):
    return spark.createDataFrame([t[:3] for t in TARGETS], "name string, target string, version string").withColumn("matches", C.target_matches("name", "target", "version"))


@query(f"""WITH {LINES} SELECT doc_id, count(*) AS blocks, 0::BIGINT AS chinese, count(*) FILTER (regexp_matches(line, '[A-Za-z]')) AS english, 0::BIGINT AS mixed, count(*) FILTER (NOT regexp_matches(line, '[A-Za-z]')) AS neutral FROM lines GROUP BY doc_id""")
def q_language_summary(spark, sf_dir):
    return C.language_summary(B.lines(B.table(spark, sf_dir, "documents")).withColumnRenamed("line", "text"))


KEYED = [(1, 0, "---"), (1, 1, "Quality  Manual"), (1, 2, "Document No: QM-01"), (1, 3, "Revision: C"), (1, 30, "Document No: LATE"), (2, 0, "12")]


@query("SELECT * FROM " + values([(1, "Quality Manual", "QM-01", "C"), (2, None, None, None)], "doc_id, title, document_no, revision"))
def q_key_metadata(spark, sf_dir):
    return C.key_metadata(spark.createDataFrame(KEYED, "doc_id int, ord int, text string"))


RAW = [("key sk-abcdefgh12345 failed", "key [redacted] failed"), ("Authorization: Bearer abcdefghijkl", "Authorization: Bearer [redacted]"), ("plain", "plain")]


@query("SELECT * FROM " + values(RAW, "error, shown"))
def q_error_redaction(spark, sf_dir):
    return spark.createDataFrame([(r[0],) for r in RAW], "error string").select("error", T.redacted("error").alias("shown"))
