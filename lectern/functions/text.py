"""Scalar text functions as column expressions.

Everything here runs in the JVM, without UDFs. Patterns use ``(?U)`` where white
space and digits are meant as Unicode has them. ``han`` arguments name the script
class of the source language, so that the functions serve other script pairs too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The script classes.
HAN = r"[㐀-䶿一-鿿豈-﫿]"
HAN_PLAIN = r"[㐀-鿿]"
LATIN = "[A-Za-z]"
SENTENCE_MARKS = "[。；;!?！？]"

#: What counts as the id of a standard, procedure or regulation.
REFERENCE = (
    r"(?iU)\b(?:ISO[-\s]?\d{4,5}(?::\d{4})?|BS\s+EN\s+ISO\s+\d{4,5}(?::\d{4})?|QSP\d{4}|WI\d{3,5}|21\s+CFR(?:\s+Part)?\s*\d+"
    r"|(?:EU\s+)?(?:MDR|MDD)|YY/?T?\s*\d{4}|(?:\d{2}/\d{2}/EEC)|Regulation\s*\(EU\)\s*\d{4}/\d+|Directive\s*\d{2}/\d{2}/EEC)\b"
)
#: Entities compared between a text and its translation.
ENTITY = (
    r"(?iU)\b(?:QSP\d{4}|WI\d{3,5}|ISO[-\s]?\d+|21\s+CFR(?:\s+Part)?\s*\d+|EU\s+(?:MDR|MDD)|YY/?T?\s*\d+|[A-Z]{2,6}|\d+(?:\.\d+)+(?:\.[a-z]\)?)?)\b"
)
#: Latin spans that may stay on the source side.
SIDE_ALLOWED = r"(?U)\b(?:[A-Z]{2,8}\d*|QSP\d{3,6}|WI\d{3,6}|ISO[-\s]?\d{3,6}|YY/?T?\s*\d{3,6}|21\s*CFR(?:\s+Part)?\s*\d+|EU|MDR|MDD|[IVX]{1,5}\s*[a-z]?)\b"
SIDE_SPAN = r"[A-Za-z][A-Za-z0-9'’./&() -]*"

#: Section categories of the staged workflow, first match wins.
STAGED_CATEGORIES = [
    ("revision_history", r"修订历史|更改历史|版本历史|revision\s+history|history\s+of\s+change"),
    ("definitions_abbreviations", r"定义|术语|简写|缩写|definitions?|terms?\s+and\s+definitions?|abbreviations?"),
    ("regulation_references", r"适用法规|法规引用|规范性引用|references?|applicable\s+regulations?|regulatory\s+references?"),
    ("table_of_contents", r"目录|table\s+of\s+contents|contents"),
    ("scope", r"范围|适用范围|\bscope\b"),
    ("responsibilities", r"职责|责任|responsibilit(?:y|ies)"),
    ("procedure", r"程序|过程|方法|procedure|process|method"),
    ("records", r"记录|records?"),
]
#: Section categories of the library workflow, first match wins.
LIBRARY_CATEGORIES = [
    ("revision_history", r"更改历史|修订历史|revision history|history of change"),
    ("table_of_contents", r"目录|table of contents|contents"),
    ("purpose", r"目的|purpose"),
    ("scope", r"范围|scope"),
    ("references", r"参考文件|引用文件|reference document|references"),
    ("definitions", r"定义|简写|缩写|definition|abbreviation"),
    ("distribution_control", r"分发|distribution control"),
    ("clause_matrix", r"条款矩阵|clause matrix|对照表"),
    ("company_history", r"公司历史|company history"),
]
SEVERITIES = {"Observation": 0, "Minor": 1, "Major": 2, "Critical": 3}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def normalize_text(c: Column | str) -> Column:
    """Non-breaking spaces and NULs become blanks, white space collapses."""
    return squeeze(F.translate(col(c), " \u0000", "  "))


def count_of(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def language_of(c: Column | str, han: str = HAN, latin: str = LATIN) -> Column:
    """zh, en, mixed or unknown, by the shares of the two scripts; short unpunctuated labels with both are mixed."""
    zh, en = count_of(c, han), count_of(c, latin)
    total = zh + en
    label = (F.length(col(c)) <= 140) & (zh <= 24) & ~col(c).rlike(SENTENCE_MARKS)
    return (
        F.when(total == 0, "unknown")
        .when((zh > 0) & (en > 0) & label, "mixed")
        .when((zh / total >= 0.45) & (en / total >= 0.30), "mixed")
        .when(zh / total >= 0.35, "zh")
        .otherwise("en")
    )


def script_label(c: Column | str) -> Column:
    """Language of a block as the staged scan names it: mixed, zh, en, number or unknown."""
    c = col(c)
    return F.when(c.rlike(HAN) & c.rlike(LATIN), "mixed").when(c.rlike(HAN), "zh").when(c.rlike(LATIN), "en").when(c.rlike(r"^[\d\s\p{Punct}]+$") & c.rlike(r"\d"), "number").otherwise("unknown")


def classify_language(c: Column | str) -> Column:
    """Chinese, English, Mixed Chinese-English or Neutral; the library workflow leaves this undefined, and this is our definition."""
    c = col(c)
    return F.when(c.rlike(HAN) & c.rlike(LATIN), "Mixed Chinese-English").when(c.rlike(HAN), "Chinese").when(c.rlike(LATIN), "English").otherwise("Neutral")


SECTION_HEAD = r"(?iU)^\s*(?:section\s*)?(\d+(?:\.\d+)*(?:\.[a-zA-Z]\)?)?|附录\s*[IVX一二三四五六七八九十]+)(?=$|[\s:：、,，;\-]|[㐀-鿿])"


def extract_section(c: Column | str) -> Column:
    """The clause number or appendix that a text starts with, if the text goes on like a heading; else null."""
    c = col(c)
    head = F.substring(c, 1, 120)
    whole = F.regexp_extract(head, SECTION_HEAD, 0)
    section = F.trim(F.regexp_extract(head, SECTION_HEAD, 1))
    after = F.substring(c, F.length(whole) + 1, F.greatest(F.lit(0), 120 - F.length(whole)))
    prose = F.trim(after).rlike(r"[A-Za-z㐀-鿿]")
    decimal = section.rlike(r"^\d+(?:\.\d+)+(?:\.[a-zA-Z]\)?)?$")
    single = section.rlike(r"^\d+$")
    return (
        F.when(section == "", None)
        .when(decimal & ~prose, None)
        .when(single & (F.substring(after, 1, 1).isin("-", "/", ".") | ~prose | (F.length(section) > 9)), None)
        .when(single & (F.expr("1") == 1) & (F.try_to_number(F.when(single, section), F.lit("999999999")) > 15), None)
        .otherwise(section)
    )


def matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))


def references(c: Column | str) -> Column:
    """The distinct ids of standards and procedures in a text, in upper case."""
    return F.array_distinct(F.transform(matches(c, REFERENCE), lambda m: F.upper(normalize_text(m))))


def entities(c: Column | str) -> Column:
    return F.array_distinct(F.transform(matches(c, ENTITY), lambda m: F.upper(m)))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """The prefix and twelve digits of a digest of the parts; nulls count as empty."""
    made = F.concat_ws("\u001f", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(made, 256), 1, 12))


def compact_context(c: Column | str, limit: int = 260) -> Column:
    t = normalize_text(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))


def severity_rank(c: Column | str) -> Column:
    return reduce(lambda w, kv: w.when(col(c) == kv[0], kv[1]), list(SEVERITIES.items())[1:], F.when(col(c) == "Observation", 0)).otherwise(0)


def heading_key(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(col(c), r"(?U)[\s\p{Punct}，。；：、（）【】《》]+", ""))


def furniture_key(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.lower(col(c)), r"\d+", "#"))


def section_parts(c: Column | str) -> Column:
    """A dotted number as integers; null for anything else."""
    return F.when(col(c).rlike(r"^\d{1,9}(?:\.\d{1,9})*$"), F.split(col(c), r"\.").cast("array<int>"))


def section_level(c: Column | str) -> Column:
    return F.coalesce(F.size(section_parts(c)), F.lit(0))


def padded_parts(c: Column | str, width: int = 6) -> Column:
    """Leading number parts, filled up with zeros, so that arrays compare as sections do."""
    lead = F.regexp_extract(F.coalesce(col(c).cast("string"), F.lit("")), r"^\s*(\d{1,9}(?:\.\d{1,9})*)", 1)
    return F.when(lead != "", F.slice(F.concat(F.split(lead, r"\.").cast("array<int>"), F.array_repeat(F.lit(0), width)), 1, width))


def section_at_or_after(c: Column | str, start: Column | str) -> Column:
    """Whether a section is not before the start, numbers compared with zeros filled in."""
    return F.coalesce(padded_parts(c) >= F.coalesce(padded_parts(start), F.array_repeat(F.lit(0), 6)), F.lit(False))


def staged_key(c: Column | str) -> Column:
    """Sort key of a section in the staged workflow: blank, then numbers without zero filling, then appendices."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    number = F.transform(F.split(F.regexp_replace(t, r"[.)]+$", ""), r"\."), lambda p: F.when(p.rlike(r"^\d{1,9}$"), F.struct(F.lit(0).alias("k"), F.try_to_number(F.when(p.rlike(r"^\d{1,9}$"), p), F.lit("999999999")).cast("int").alias("n"), F.lit("").alias("s"))).otherwise(F.struct(F.lit(1).alias("k"), F.lit(0).alias("n"), F.lower(p).alias("s"))))
    appendix = F.lower(F.regexp_replace(t, r"(?iU)^(appendix|annex|附录|附件)\s*", ""))
    none = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit("").alias("s"))
    return F.when(t == "", F.struct(F.lit(0).alias("group"), F.array(none).alias("parts"))).when(t.rlike("(?i)^(appendix|annex|附录|附件)"), F.struct(F.lit(2).alias("group"), F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), appendix.alias("s"))).alias("parts"))).otherwise(F.struct(F.lit(1).alias("group"), number.alias("parts")))


def staged_at_or_after(c: Column | str, start: Column | str) -> Column:
    s = F.trim(F.coalesce(col(start), F.lit("")))
    return F.when(s == "", True).when(F.coalesce(col(c), F.lit("")) == "", False).otherwise(staged_key(c) >= staged_key(start))


def category(c: Column | str, rules: list[tuple[str, str]], default: str) -> Column:
    t = F.coalesce(col(c), F.lit(""))
    return reduce(lambda w, r: w.when(t.rlike(f"(?iU){r[1]}"), r[0]), rules[1:], F.when(t.rlike(f"(?iU){rules[0][1]}"), rules[0][0])).otherwise(default)


def staged_category(c: Column | str) -> Column:
    return category(c, STAGED_CATEGORIES, "main_content")


def library_category(c: Column | str) -> Column:
    return category(F.lower(normalize_text(c)), LIBRARY_CATEGORIES, "main_body")


PLAIN_HEADING = r"(?U)^\s*(\d+(?:\.\d+){1,3})(?:\s+|[、．):：-]\s*)(\S.*)?$"
APPENDIX_HEADING = r"(?iU)^\s*(appendix|annex|附录|附件)\s*([A-Za-z0-9一二三四五六七八九十]*)\s*[-—:：.]?\s*(.*)$"
NUMBERED_HEADING = r"(?U)^\s*(\d+(?:\.\d+)+(?:\.?\s?[A-Za-z](?=$|[\s).:：、-]))?)\s*[).:：、-]?\s*(.*)$"


def plain_heading(c: Column | str) -> Column:
    """(section, title) of a line like `4.2 Title`; null where it is none."""
    t = normalize_text(c)
    section = F.regexp_extract(t, PLAIN_HEADING, 1)
    return F.when(section != "", F.struct(section.alias("section"), F.regexp_extract(t, PLAIN_HEADING, 2).alias("title")))


def staged_heading(c: Column | str, block_type: Column | str) -> Column:
    """(section, title, type, level, category) where a block may begin a section; null elsewhere. Rows of cells, long text and untitled numbers need a heading hint."""
    t, kind = squeeze(F.coalesce(col(c), F.lit(""))), col(block_type)
    label, number = F.regexp_extract(t, APPENDIX_HEADING, 1), F.regexp_extract(t, APPENDIX_HEADING, 2)
    appendix = F.struct(F.trim(F.concat_ws(" ", F.initcap(label), number)).alias("section"), F.trim(F.regexp_extract(t, APPENDIX_HEADING, 3)).alias("title"), F.lit("appendix").alias("type"), F.lit(1).alias("level"), F.lit("appendix").alias("category"))
    raw = F.regexp_replace(F.regexp_extract(t, NUMBERED_HEADING, 1), r"\s+", ".")
    section = F.lower(F.regexp_replace(raw, r"\.\.", "."))
    title = F.trim(F.regexp_extract(t, NUMBERED_HEADING, 2))
    level = F.regexp_count(section, F.lit(r"\d+")) + F.when(section.rlike(r"\.[a-z]$"), 1).otherwise(0)
    numbered = F.struct(section.alias("section"), title.alias("title"), F.lit("numbered").alias("type"), level.cast("int").alias("level"), staged_category(t).alias("category"))
    hint = kind == "heading"
    return F.when((t == "") | (kind == "header_footer"), None).when(label != "", appendix).when((section == "") | (~hint & (t.contains("|") | (F.length(t) > 240) | (title == ""))), None).otherwise(numbered)


def clean_alignment(c: Column | str) -> Column:
    return normalize_text(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?i)</?(?:td|tr|th)(?:\s+[^>]*)?>", " "))


def replace_each(c: Column, pattern: str, change) -> Column:
    """Replaces every match by a function of it: the text is split at its matches and put together again."""
    gaps, hits = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), hits, lambda g, m: F.concat(g, change(m))), ""), F.element_at(gaps, -1))


def clean_chinese(c: Column | str) -> Column:
    """The source side of a mixed text; of Latin spans only codes and abbreviations stay."""
    t = clean_alignment(c)

    def kept(m: Column) -> Column:
        allowed = F.regexp_extract_all(m, F.lit(SIDE_ALLOWED), F.lit(0))
        return F.when(F.size(allowed) > 0, F.concat(F.lit(" "), F.array_join(allowed, " "), F.lit(" "))).otherwise(" ")

    t = replace_each(t, SIDE_SPAN, kept)
    t = F.regexp_replace(t, r"(?U)\s+([，。；：、（）])", "$1")
    return normalize_text(F.regexp_replace(t, r"(?U)([（])\s+", "$1"))


def clean_english(c: Column | str) -> Column:
    """The target side of a mixed text: no Han characters, no full-width marks."""
    t = F.regexp_replace(clean_alignment(c), HAN, " ")
    return normalize_text(F.regexp_replace(t, "[，。；：、（）【】《》]", " "))


def code_like(c: Column | str) -> Column:
    t = normalize_text(c)
    return (t == "") | ((F.size(references(t)) > 0) & (F.length(t) <= 24)) | t.rlike(r"(?U)^[\d\s./():;,_-]+$")


def structural_cell(c: Column | str) -> Column:
    t = normalize_text(c)
    return t.rlike("^[A-Z]$") | t.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$") | code_like(t)


def history_cell(c: Column | str) -> Column:
    compact = F.lower(F.regexp_replace(normalize_text(c), r"(?U)[\s:：/|_-]+", ""))
    return structural_cell(c) | compact.isin("版本revision", "revrevision", "revision", "生效日期effectivedate", "effectivedate")


def table_cells(c: Column | str) -> Column:
    """The non-empty cells of a row written with bars or tabs; none where there is neither."""
    t = F.regexp_replace(F.trim(col(c)), r"^\|+|\|+$", "")
    cells = F.filter(F.transform(F.split(t, r"\s*\|\s*|\t+"), clean_alignment), lambda x: x != "")
    return F.when(col(c).contains("|") | col(c).contains("\t"), cells).otherwise(F.array().cast("array<string>"))


def reference_row(c: Column | str) -> Column:
    """Whether a row of three cells and more holds mainly codes."""
    code = r"(?iU)\b(?:QSP\d{4}|WI\d{3,5}|21\s*CFR|820\.\d+|ISO\s*\d+|\d+(?:\.\d+){1,3}(?:\.[a-z]\)?)?)\b"
    cells = F.filter(F.transform(F.split(col(c), r"\|"), lambda x: squeeze(x)), lambda x: x != "")
    coded = F.size(F.filter(cells, lambda x: x.rlike(code) & (F.length(x) < 100)))
    return col(c).contains("|") & (F.size(cells) >= 3) & ((coded >= 2) | ((count_of(c, code) >= 3) & (count_of(c, r"[A-Za-z㐀-鿿]") < 280)))


def standalone_locator(c: Column | str) -> Column:
    return col(c).rlike(r"(?U)^\s*\d+(?:\.\d+)*\s*$")


def normalize_for_similarity(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.lower(normalize_text(c)), r"[^a-z0-9\s./:-]", " "))


def similarity_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(normalize_for_similarity(c), F.lit(r"[a-z0-9]+(?:[./:-][a-z0-9]+)*"), F.lit(0))


def normalized_reference(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "")


def provision_tokens(c: Column | str) -> Column:
    """Typed tokens (part, article, annex, section, clause, cfr) of the provisions that a text cites."""
    c = col(c)
    joined = r"(?:\s*(?:,|and|&|/)\s*"
    families = [
        ("cfr", rf"(?i)\b21\s+CFR(?:\s+Parts?)?\s*(\d+(?:\.\d+)?{joined}\d+(?:\.\d+)?)*)"),
        ("part", rf"(?i)\bParts?\s+(\d+{joined}\d+)*)"),
        ("article", rf"(?i)\bArticles?\s+(\d+[a-z]?{joined}\d+[a-z]?)*)"),
        ("annex", rf"(?i)\bAnnex(?:es)?\s+([IVXLCDM]+{joined}[IVXLCDM]+)*)\b"),
        ("section", rf"(?i)\bSections?\s+(\d+(?:\.\d+)*{joined}\d+(?:\.\d+)*)*)"),
        ("clause", rf"(?i)\bClauses?\s+(\d+(?:\.\d+)*{joined}\d+(?:\.\d+)*)*)"),
    ]
    parts = []
    for name, pattern in families:
        found = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda g: F.split(g, r"(?i)\s*(?:,|and|&|/)\s*")))
        label = F.lit(f"{name}:")
        parts.append(F.transform(F.filter(found, lambda x: x != ""), lambda x: F.concat(label, F.lower(F.trim(x)))))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def english_candidate(preferred: Column | str, english: Column | str) -> Column:
    """The preferred term where the text has it, else the longest run of capitalised words, first of several."""
    phrases = F.transform(F.regexp_extract_all(col(english), F.lit(r"(?:[A-Z][A-Za-z/-]*(?:\s+|$)){1,7}"), F.lit(0)), lambda p: F.trim(p))
    longest = F.aggregate(phrases, F.lit(None).cast("string"), lambda a, p: F.when(a.isNull() | (F.length(p) > F.length(a)), p).otherwise(a))
    return F.when(F.lower(col(english)).contains(F.lower(col(preferred))), col(preferred)).otherwise(longest)


def without_fence(c: Column | str) -> Column:
    """A JSON answer without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def redacted(c: Column | str) -> Column:
    """Error text with keys and bearer tokens taken out."""
    t = F.regexp_replace(col(c), r"(?i)\b(sk|pk|key|api)[-_][A-Za-z0-9_-]{8,}", "[redacted]")
    return F.regexp_replace(t, r"(?i)(bearer\s+)[A-Za-z0-9._-]{8,}", "$1[redacted]")
