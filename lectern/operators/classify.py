"""Classes of blocks and pages, routing to review, observations over detected references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalogs import HEADINGS
from ..functions.text import HAN, HAN_PLAIN, category, classify_language, col, count_of, heading_key, normalize_text, plain_heading, reference_row, section_at_or_after, squeeze, stable_id, standalone_locator

#: Page numbers, metadata and section classes of the library workflow.
PAGE_NUMBER = r"(?iU)^\s*(?:第\s*)?\d+\s*(?:页(?:\s*共\s*\d+\s*页)?|/\s*\d+|of\s+\d+)?\s*$"
METADATA = (
    r"(?iU)(?:文件编号|文件名称|文件版本|版本号|修订号|生效日期|批准|审核|编写|签名|\bdoc(?:ument)?\s*(?:no|name|number)|\brevision\b|\brev(?:\.|\s*[:：])"
    r"|\beffective\s*date|\bprepared\s*by|\bapproved\s*by|\bsignature)"
)
SECTION_CLASSES = [
    ("table_of_contents", r"目录|table\s+of\s+contents|^\s*contents\s*$"),
    ("revision_history", r"更改历史|修订历史|版本历史|revision\s+history|history\s+of\s+change"),
    ("definitions_abbreviation", r"定义|简写|缩写|definitions?|abbreviations?"),
    ("regulation_reference", r"参考文件|引用文件|法规参考|reference\s+documents?|normative\s+references?"),
    ("clause_matrix", r"条款矩阵|clause\s+matrix|对照表|correlation\s+matrix"),
]
#: Classes and the status of blocks that are not paired on their account.
IGNORED = {
    "header_footer": "ignored header-footer",
    "heading": "ignored heading",
    "section_title": "ignored heading",
    "document_metadata": "ignored document metadata",
    "page_number": "ignored page number",
    "image_or_visual": "ignored image or visual",
    "table_of_contents": "ignored table of contents",
    "revision_history": "ignored revision history",
    "definitions_abbreviation": "ignored definitions",
    "regulation_reference": "ignored regulation reference",
    "clause_matrix": "ignored clause matrix",
}
SHORT_LABEL = 90


def block_class(start: str = "2.0") -> Column:
    """The class of a block (text, block_type, section, section_heading, ord, first_order), decided by the first rule that fits."""
    text = normalize_text("text")
    language = classify_language(text)
    by_section = category(F.lower(F.when(F.coalesce("section_heading", F.lit("")) == "", text).otherwise(normalize_text("section_heading"))), SECTION_CLASSES, "")
    main = F.when(language == "Chinese", "main_chinese_paragraph").when(language == "English", "main_english_translation").when(language == "Neutral", "neutral").otherwise("unknown")
    return (
        F.when(F.col("block_type") == "image_or_visual", "image_or_visual")
        .when(F.col("block_type").isin("header", "footer", "header_footer"), "header_footer")
        .when(text.rlike(PAGE_NUMBER), "page_number")
        .when(text.rlike(METADATA), "document_metadata")
        .when(by_section != "", by_section)
        .when(F.col("block_type") == "heading", F.when(text.rlike(r"^\s*\d+(?:\.\d+)*"), "section_title").otherwise("heading"))
        .otherwise(main)
    )


def before_start(start: str = "2.0") -> Column:
    """Whether a block stands before the section where review starts."""
    known = F.col("section").isNotNull() & ~section_at_or_after("section", F.lit(start))
    return F.coalesce(known | (F.col("ord") < F.col("first_order")), F.lit(False))


def classified(blocks: DataFrame, start: str = "2.0") -> DataFrame:
    """Blocks with class, first_order (where review starts in their document) and route: eligible, or why not."""
    head = F.when((F.col("block_type") == "heading") & section_at_or_after(plain_heading("text")["section"], F.lit(start)), F.col("ord"))
    rows = blocks.withColumn("first_order", F.min(head).over(Window.partitionBy("doc_id"))).withColumn("class", block_class(start))
    route = None
    for name, why in IGNORED.items():
        route = F.when(F.col("class") == name, why) if route is None else route.when(F.col("class") == name, why)
    mixed = classify_language("text") == "Mixed Chinese-English"
    route = route.when(before_start(start), "ignored before review start").when(mixed & (F.length("text") <= SHORT_LABEL), "ignored mixed short term")
    return rows.withColumn("route", route.when(F.col("class").startswith("main_") | mixed, "eligible").otherwise(F.col("class")))


def contents_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page) of pages of contents: by title, by column heads, or by counts of locators, labels and prose."""
    low = F.lower("text")
    bare = F.regexp_replace(low, r"(?U)\s+", "")
    title = (F.length("text") < 140) & ((F.trim(low) == "table of contents") | bare.isin("0.1目录tableofcontents", "目录tableofcontents") | F.col("text").rlike(r"(?U)^\s*0\.1\s*目录"))
    lines = F.filter(F.transform(F.split("text", "[\n\r]+"), normalize_text), lambda x: x != "")
    loose = F.filter(lines, lambda x: ~standalone_locator(x))
    rows = blocks.select(
        "doc_id", "page", title.alias("title"), bare.alias("bare"), low.alias("low"),
        F.size(F.filter(lines, standalone_locator)).alias("locators"),
        F.size(F.filter(lines, lambda x: x.rlike(HAN_PLAIN) & x.rlike("[A-Za-z]"))).alias("labels"),
        F.size(F.filter(loose, lambda x: (F.length(x) > 150) | x.rlike("[。；;]"))).alias("prose"),
    )
    has = lambda c, t: F.bool_or(F.col(c).contains(t))
    page = rows.groupBy("doc_id", "page").agg(
        F.bool_or("title").alias("title"), (has("bare", "章节chapter") & has("bare", "标题titles") & (has("bare", "页码page") | has("low", "page"))).alias("heads"),
        F.sum("locators").alias("locators"), F.sum("labels").alias("labels"), F.sum("prose").alias("prose"), has("low", "cover page").alias("cover"),
    )
    return page.where("title or heads or (locators >= 8 and labels >= 6 and cover) or (locators >= 3 and labels >= 3 and prose = 0)").select("doc_id", "page")


def history_pages(blocks: DataFrame, contents: DataFrame) -> DataFrame:
    """(doc_id, page) of the change history: pages with revision rows or its title, and those between, up to the next page of contents."""
    revision = F.col("text").rlike(r"^\s*[A-Z]\s*(?:\||$|\s)") & F.col("text").rlike(r"\b(?:\d{1,2}[-/](?:[A-Za-z]{3}|\d{1,2})[-/]\d{4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b")
    low = F.lower(F.trim("text"))
    title = (F.length("text") < 100) & (low.startswith("history of change") | low.startswith("更改历史记录"))
    rows = blocks.select("doc_id", "page", revision.alias("revision"), title.alias("title"))
    first = rows.groupBy("doc_id").agg(F.min(F.when(F.col("revision"), F.col("page"))).alias("first"))
    marked = rows.join(first, "doc_id").where("revision or (title and (first is null or page <= first))")
    span = marked.groupBy("doc_id").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    after = span.join(contents, "doc_id").where("page > low").groupBy("doc_id").agg(F.min("page").alias("next"))
    filled = span.join(after, "doc_id", "left").withColumn("end", F.coalesce(F.col("next") - 1, F.col("high")))
    return filled.where("end >= low").select("doc_id", F.explode(F.sequence("low", "end")).alias("page")).union(marked.select("doc_id", "page")).distinct()


def reference_pages(blocks: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, page) of pages with at least ``least`` table rows of codes."""
    rows = blocks.where("block_type = 'table_row'").where(reference_row("text"))
    return rows.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("doc_id", "page")


def heading_translation(c: Column | str) -> Column:
    """The glossary's translation of a short heading: of the terms it holds the longest, else null."""
    c = col(c)
    bare = F.regexp_replace(F.regexp_replace(c, r"(?U)^\s*(?:\d+\.)*\d+\s*", ""), r"(?U)[\s：:、]+", "")
    made = None
    for term, english in sorted(HEADINGS.items(), key=lambda x: -len(x[0])):
        hit = bare.contains(term.replace("、", ""))
        made = F.when(hit, english) if made is None else made.when(hit, english)
    return F.when((F.length(c) <= 90) & (count_of(c, HAN_PLAIN) <= 24) & ~c.rlike("[。；;！？!?]"), made)


def observations(detected: DataFrame) -> DataFrame:
    """(topic, finding_id) that detected references (name, citation, block_id) call for: an old and a new regulation side by side, and a program name that may be out of date."""
    old, new = "EU MDD 93/42/EEC", "EU MDR Regulation (EU) 2017/745"
    both = detected.groupBy().agg(F.max(F.when(F.col("name") == old, F.col("block_id"))).alias("block_id"), F.bool_or(F.col("name") == new).alias("new")).where("block_id is not null and new")
    first = both.select(F.lit("applicability and transition").alias("topic"), stable_id("RF", F.lit("mdd-mdr"), "block_id").alias("finding_id"))
    second = detected.where(F.upper("citation").contains("CMDCAS")).select(F.lit("program naming").alias("topic"), stable_id("RF", F.lit("cmdcas"), "block_id").alias("finding_id"))
    return first.unionByName(second)


def target_matches(name: Column | str, target: Column | str, version: Column | str) -> Column:
    """Whether a finding names the selected regulation: the same letters and digits, or those and its version."""
    key = lambda x: F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "")
    known = key(version) != "unknown"
    return (key(name) == key(target)) | (known & (key(name) == F.concat(key(target), key(version))))


def language_summary(blocks: DataFrame) -> DataFrame:
    """(doc_id, blocks, chinese, english, mixed, neutral): how many blocks of each language a document has."""
    label = classify_language("text")
    count = lambda v, n: F.count_if(label == v).alias(n)
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), count("Chinese", "chinese"), count("English", "english"), count("Mixed Chinese-English", "mixed"), count("Neutral", "neutral"))


def key_metadata(blocks: DataFrame, first: int = 20) -> DataFrame:
    """(doc_id, title, document_no, revision) from a document's first lines."""
    early = blocks.where(F.col("ord") < first)
    at = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("ord")))
    grab = lambda p: F.nullif(F.trim(F.regexp_extract("text", p, 1)), F.lit(""))
    title = F.when(F.col("text").rlike(f"[A-Za-z]|{HAN}"), squeeze("text"))
    return early.groupBy("doc_id").agg(at(title).alias("title"), at(grab(r"(?i)\bdoc(?:ument)?\.?\s*no\.?\s*[:：]?\s*([A-Za-z0-9-]+)")).alias("document_no"), at(grab(r"(?i)\brev(?:ision)?\.?\s*[:：]?\s*([A-Z0-9.]+)\b")).alias("revision"))


def section_numbering(template: Column, section: Column, heading_style: Column) -> Column:
    """Whether an automatic number is a section's: several placeholders, or one in a heading style, before '.0' or after a fixed parent; never with a bracket."""
    several = F.regexp_count(template, F.lit("%[1-9]")) > 1
    fixed = template.rlike(r"%[1-9]\s*\.\s*0\b") | template.rlike(r"\b\d+\s*\.\s*%[1-9]")
    numbered = F.coalesce(section, F.lit("")).rlike(r"^\d+(?:\.\d+)*$")
    return numbered & template.isNotNull() & ~template.contains(")") & (several | heading_style | fixed)


def heading_paragraph(text: Column, heading_style: Column, in_contents: Column) -> Column:
    """Whether a paragraph is a heading: by style, as a history title, or numbered, short and named in the contents."""
    t = normalize_text(text)
    return heading_style | t.startswith("更改历史记录") | F.lower(t).startswith("history of change") | (t.rlike(r"^\d+(?:\.\d+)*\s+") & in_contents & (F.length(t) <= 160))


#: Words of an address block, as heading keys.
ADDRESS = ["office", "address", "电话tel", "传真fax", "网址website", "hongkong"]


def paragraph_class(text: Column, section: Column) -> Column:
    """The content class of a paragraph by its section and words. Sections are compared by prefix, so 3.10 counts as 3.1 too."""
    key = heading_key(text)
    address = text.contains("香港")
    for word in ADDRESS:
        address = address | key.contains(word)
    section = F.coalesce(section, F.lit(""))
    return (
        F.when((section == "1.0") & address, "address_block").when(section.startswith("3.1"), "organization_chart_or_structure").when(section.startswith("3.2"), "job_description")
        .when(text.rlike(r"(?i)\bQSP\d{4}\b"), "procedure_reference").otherwise("bilingual_prose")
    )


DATE = r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"


def row_attributes(cells: Column) -> Column:
    """(revision_id, effective_date) of a row: its first cell if a single capital, and the first date of any cell; null where there is none."""
    first = F.get(cells, F.lit(0))
    dates = F.filter(F.transform(cells, lambda x: F.regexp_extract(normalize_text(x), DATE, 0)), lambda x: x != "")
    return F.struct(F.when(normalize_text(first).rlike("^[A-Z]$"), normalize_text(first)).alias("revision_id"), F.get(dates, F.lit(0)).alias("effective_date"))


def reference_language(text: Column) -> Column:
    han, latin = text.rlike("[㐀-鿿]"), text.rlike("[A-Za-z]")
    return F.when(han & latin, "Chinese and English").when(han, "Chinese").when(latin, "English").otherwise("Unknown")
