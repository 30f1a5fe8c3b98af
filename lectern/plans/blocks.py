"""Queries over lines, elements and turns: scans, text functions, ordered operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as L
from ..sources import blocks as B
from .registry import query, values

LINES = """lines AS (SELECT doc_id, lang, source, (i - 1)::INT AS pos, l[i] AS line, ((i - 1) // 20 + 1)::INT AS page,
  'blk_' || substr(sha256(doc_id || chr(31) || (i - 1)), 1, 12) AS block_id
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) u(i))"""
TURNS = """turns AS (SELECT conv_id AS doc_id, turn::INT AS ord, (turn // 4 + 1)::INT AS page, role,
  CASE role WHEN 'user' THEN 'zh' WHEN 'assistant' THEN 'en' ELSE 'unknown' END AS language, text,
  't' || conv_id || '-' || turn AS block_id FROM conversations)"""
SQUEEZE = "trim(regexp_replace(translate({}, chr(160), ' '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


def _lines(spark, sf_dir):
    return B.lines(B.table(spark, sf_dir, "documents"))


def _turns(spark, sf_dir):
    return B.turns(B.table(spark, sf_dir, "conversations"))


@query(f"WITH {LINES} SELECT doc_id, pos, page, block_id, length(line) AS n_chars FROM lines")
def q_lines_scan(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", "page", "block_id", F.length("line").cast("long").alias("n_chars"))


@query(r"""WITH bare AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g') AS h FROM pages),
marked AS (SELECT page_id, string_split(regexp_replace(h, '(?i)<(/?)(h1|p|li)\b', chr(1) || '\1\2', 'g'), chr(1)) AS parts FROM bare),
each AS (SELECT page_id, i, parts[i] AS raw FROM marked, unnest(range(2, len(parts) + 1)) u(i)),
opened AS (SELECT page_id, i, regexp_extract(raw, '^([A-Za-z0-9]+)', 1) AS tag, regexp_replace(raw, '^[^>]*>', '') AS body FROM each WHERE NOT starts_with(raw, '/') AND contains(raw, '>')),
numbered AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS ord, lower(tag) AS tag,
  trim(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM opened)
SELECT * FROM numbered WHERE text <> ''""")
def q_html_blocks(spark, sf_dir):
    return B.html_blocks(B.table(spark, sf_dir, "pages"))


ACCENTED, PLAIN = "[À-ÖØ-öø-ÿ]", "[A-Za-z]"


@query(f"""WITH {LINES}, c AS (SELECT *, len(regexp_extract_all(line, '{ACCENTED}')) AS zh, len(regexp_extract_all(line, '{PLAIN}')) AS en FROM lines),
l AS (SELECT lang, CASE WHEN zh + en = 0 THEN 'unknown' WHEN zh > 0 AND en > 0 AND length(line) <= 140 AND zh <= 24 AND NOT regexp_matches(line, '[。；;!?！？]') THEN 'mixed'
  WHEN zh / (zh + en) >= 0.45 AND en / (zh + en) >= 0.30 THEN 'mixed' WHEN zh / (zh + en) >= 0.35 THEN 'zh' ELSE 'en' END AS label, zh, en FROM c)
SELECT lang, label, count(*) AS n_lines, sum(zh)::BIGINT AS accented, sum(en)::BIGINT AS plain FROM l GROUP BY ALL""")
def q_lang_profile(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    rows = rows.select("lang", T.language_of("line", ACCENTED, PLAIN).alias("label"), T.count_of("line", ACCENTED).alias("zh"), T.count_of("line", PLAIN).alias("en"))
    return rows.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("zh").alias("accented"), F.sum("en").alias("plain"))


LANGUAGE_ROWS = [("目录Table of Contents",), ("The manager shall approve.",), ("12.5 / 3",), ("公司应按照ISO 13485建立质量管理体系。",), ("质量方针。Quality",), ("质量方针管理。Quality",), ("策。Quality Manual",), ("",)]
LANGUAGE_WANT = ["mixed", "en", "unknown", "zh", "zh", "mixed", "en", "unknown"]


@query("SELECT * FROM " + values([(r[0], w) for r, w in zip(LANGUAGE_ROWS, LANGUAGE_WANT, strict=True)], "text, language"))
def q_language_rules(spark, sf_dir):
    return spark.createDataFrame(LANGUAGE_ROWS, "text string").select("text", T.language_of("text").alias("language"))


@query(f"""WITH {LINES}, n AS (SELECT doc_id, pos, {SQUEEZE.format("line")} AS t, line FROM lines)
SELECT doc_id, pos, t AS text, CASE WHEN length(t) <= 60 THEN t ELSE substr(t, 1, 59) || '…' END AS context,
  trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS furniture FROM n""")
def q_text_norm(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", T.normalize_text("line").alias("text"), T.compact_context("line", 60).alias("context"), T.furniture_key("line").alias("furniture"))


SECTIONS = [("3.2 Responsibilities", "3.2"), ("8.2", None), ("51", None), ("4 Quality system", "4"), ("16 Steps", None), ("2024-01-05 date", None), ("附录 一 说明", "附录 一"), ("3.2质量", "3.2"), ("5.1.a) Scope", "5.1.a)"), ("Section 7.4 Purchasing", "7.4"), ("4. Quality", None), ("no number", None)]


@query("SELECT * FROM " + values(SECTIONS, "text, section"))
def q_section_parse(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in SECTIONS], "text string").select("text", T.extract_section("text").alias("section"))


HEADINGS = [
    ("4.2 Control of documents", "4.2", "Control of documents", True),
    ("10.1 Later", "10.1", "Later", True),
    ("2. no", None, None, None),
    ("1.9.3 Early", "1.9.3", "Early", False),
    ("2.0 Same", "2.0", "Same", True),
    ("words", None, None, None),
]


@query("SELECT * FROM " + values(HEADINGS, "text, section, title, after_start"))
def q_heading_parse(spark, sf_dir):
    rows = spark.createDataFrame([(h[0],) for h in HEADINGS], "text string").withColumn("h", T.plain_heading("text"))
    return rows.select("text", "h.section", "h.title", F.when(F.col("h").isNotNull(), T.section_at_or_after("h.section", F.lit("2"))).alias("after_start"))


STAGED = [
    ("4.2 Control of records", "paragraph", "4.2", "Control of records", "numbered", 2, "records"),
    ("Appendix A - Forms", "paragraph", "Appendix A", "Forms", "appendix", 1, "appendix"),
    ("1.1 a | b", "paragraph", None, None, None, None, None),
    ("2.3 Scope", "header_footer", None, None, None, None, None),
    ("0.1 Table of Contents", "heading", "0.1", "Table of Contents", "numbered", 2, "table_of_contents"),
    ("plain words", "paragraph", None, None, None, None, None),
]


@query("SELECT * FROM " + values(STAGED, "text, block_type, section, title, type, level, category"))
def q_staged_heading(spark, sf_dir):
    rows = spark.createDataFrame([r[:2] for r in STAGED], "text string, block_type string").withColumn("h", T.staged_heading("text", "block_type"))
    return rows.select("text", "block_type", "h.section", "h.title", "h.type", "h.level", "h.category")


SIDES = [("按 ISO 13485:2016 执行", "按 ISO :2016 执行"), ("按ISO13485:2016执行", "按 ISO13485 :2016执行"), ("符合YY/T 0287要求", "符合 YY 要求"), ("按 21 CFR Part 820 执行", "按 21 CFR 执行"), ("按QSP0401执行", "按 QSP0401 执行")]


@query("SELECT * FROM " + values(SIDES, "text, side"))
def q_side_cleaner(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in SIDES], "text string").select("text", T.clean_chinese("text").alias("side"))


@query(f"""WITH {LINES}, k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS key FROM lines),
s AS (SELECT doc_id, key, count(DISTINCT page) AS pages FROM k WHERE key <> '' GROUP BY ALL),
m AS (SELECT doc_id, max(page) AS last FROM k GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS up, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS down FROM k)
SELECT e.doc_id, e.pos, coalesce(s.pages, 0) >= greatest(2, least(3, m.last)) AND (up <= 2 OR down <= 2) AS is_furniture
FROM e JOIN m USING (doc_id) LEFT JOIN s USING (doc_id, key)""")
def q_repeated_furniture(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc_id", F.col("pos").alias("ord"), "page", F.col("line").alias("text"))
    return L.mark_furniture(rows).select("doc_id", F.col("ord").alias("pos"), "is_furniture")


@query(f"""WITH {LINES} SELECT doc_id, page, pos, block_id FROM lines WHERE trim(line) <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, page, line ORDER BY pos) = 1""")
def q_exact_dedupe(spark, sf_dir):
    return L.first_of(_lines(spark, sf_dir).where("trim(line) <> ''"), ["doc_id", "page", "line"], ["pos"]).select("doc_id", "page", "pos", "block_id")


@query()
def q_near_dup(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc_id", "page", F.col("pos").alias("ord"), F.when(F.col("line").contains("|"), "table_row").otherwise("paragraph").alias("block_type"), F.col("line").alias("text"))
    return L.near_duplicates(rows)


@query(f"""WITH {TURNS}, f AS (SELECT *, CASE WHEN lag(language) OVER w IS NOT DISTINCT FROM language AND lag(page) OVER w IS NOT DISTINCT FROM page AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord, language, (sum(new) OVER (PARTITION BY doc_id ORDER BY ord))::INT AS run_id FROM f""")
def q_runs_islands(spark, sf_dir):
    return L.runs(_turns(spark, sf_dir), ["doc_id"], "ord", ["language", "page"]).select("doc_id", "ord", "language", "run_id")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""")
def q_forward_fill(spark, sf_dir):
    events = B.table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type")).first()[0]
    return L.carried(events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == first, F.col("event_id")), "carried").select("event_id", "user_id", "carried")


@query(f"WITH {TURNS} SELECT doc_id, ord, lag(text) OVER w AS context_before, lead(text) OVER w AS context_after FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
def q_lag_lead_context(spark, sf_dir):
    return L.with_context(_turns(spark, sf_dir), ["doc_id"], "ord").select("doc_id", "ord", "context_before", "context_after")


@query(f"""WITH {TURNS}, f AS (SELECT *, CASE WHEN lag(page) OVER w IS NOT DISTINCT FROM page AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
r AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id ORDER BY ord))::INT AS segment FROM f)
SELECT doc_id, segment, min(page) AS page_start, min(ord) AS order_start, max(ord) AS order_end, count(*) AS blocks, string_agg(block_id, ',' ORDER BY ord) AS block_ids FROM r GROUP BY ALL""")
def q_segments_agg(spark, sf_dir):
    rows = L.runs(_turns(spark, sf_dir), ["doc_id"], "ord", ["page"], "segment")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "block_id"))), lambda r: r["block_id"]), ",")
    return rows.groupBy("doc_id", "segment").agg(F.min("page").alias("page_start"), F.min("ord").alias("order_start"), F.max("ord").alias("order_end"), F.count(F.lit(1)).alias("blocks"), ids.alias("block_ids"))


GATES = [
    ("staged", None, "0.1", True), ("staged", "0.1", "0.2", True), ("staged", "0.1", "0.1.1", True), ("staged", "0.1", "1.0", True), ("staged", "4.2.3", "4.3", True), ("staged", "4.2.3", "5.0", True),
    ("staged", None, "1.0", False), ("staged", "0.1", "1.1", False), ("staged", "4.2.3", "5", False), ("staged", "0.1", "Appendix A", False),
    ("segment", "2.1", "2.1.1", True), ("segment", "2.1", "2.2", True), ("segment", "2.1", "3", True), ("segment", "2.1", "3.0", True), ("segment", "2.1.3", "2.2", True), ("segment", None, "9.9", True), ("segment", "2.1", "2.1.2", False), ("segment", "2.1", "8.2", False),
]


@query("SELECT * FROM " + values(GATES, "gate, active, candidate, accepted"))
def q_section_gate(spark, sf_dir):
    rows = spark.createDataFrame([g[:3] for g in GATES], "gate string, active string, candidate string")
    return rows.withColumn("accepted", F.when(F.col("gate") == "staged", L.staged_gate(F.col("active"), F.col("candidate"))).otherwise(L.segment_gate(F.col("active"), F.col("candidate"))))


CARRY = [(1, 0, "0.1"), (1, 1, None), (1, 2, "0.2"), (1, 3, "8.2"), (1, 4, "1.0"), (1, 5, "1.0.1"), (1, 6, None), (2, 0, "3.1"), (2, 1, "0.1"), (2, 2, "0.1.1")]
CARRIED = ["0.1", "0.1", "0.2", "0.2", "1.0", "1.0.1", "1.0.1", None, "0.1", "0.1.1"]


@query("SELECT * FROM " + values([(*r, s, r[2] is not None and r[2] == s) for r, s in zip(CARRY, CARRIED, strict=True)], "doc_id, ord, candidate, section, accepted"))
def q_section_carry(spark, sf_dir):
    return L.gated_sections(spark.createDataFrame(CARRY, "doc_id int, ord int, candidate string"), L.staged_gate)


MOST = 600


@query(f"""WITH RECURSIVE b AS (SELECT conv_id AS doc_id, turn, length(text) + 80 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT doc_id, turn, i, 1 AS chunk, cost AS used FROM b WHERE i = 1
  UNION ALL SELECT b.doc_id, b.turn, b.i, CASE WHEN p.used + b.cost > {MOST} THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.used + b.cost > {MOST} THEN b.cost ELSE p.used + b.cost END
  FROM p JOIN b ON b.doc_id = p.doc_id AND b.i = p.i + 1)
SELECT doc_id, turn::INT AS ord, chunk FROM p""")
def q_bin_pack(spark, sf_dir):
    return L.packed_chunks(_turns(spark, sf_dir).withColumn("size", F.length("text")), MOST)


@query(f"WITH {TURNS} SELECT doc_id, ord, ((row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) // 3)::INT AS batch FROM turns")
def q_batches(spark, sf_dir):
    from ..operators.ai import batched

    return batched(_turns(spark, sf_dir), 3).select("doc_id", "ord", "batch")


@query("""SELECT doc_id, sha256(lang || chr(31) || source || chr(31) || sha256(text)) AS fingerprint FROM documents""")
def q_fingerprint(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(F.concat_ws("\u001f", "lang", "source", F.sha2("text", 256)), 256).alias("fingerprint"))


@query("""SELECT lang, list_sort(list(DISTINCT source))::VARCHAR[] AS sources, count(DISTINCT source) AS n FROM documents GROUP BY lang""")
def q_set_ops(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return docs.select("lang", "source").distinct().groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("n"))


TOC = [(1, True, 0, "3", 5), (1, True, 1, "3", 6), (1, False, 2, "3", 9), (1, False, 3, "4", 8), (1, False, 4, "4", 10), (1, True, 5, "3.2", 7)]
PLACED = [(1, 0, "3.1", 8), (1, 1, "3.2.1", 9), (1, 2, "3.2.2", 11), (1, 3, "4.5", 7), (1, 4, None, 2), (1, 5, "9", 4)]


@query("SELECT * FROM " + values([(1, "3", 6), (1, "4", 8), (1, "3.2", 7)], "doc_id, section, page"))
def q_toc_index(spark, sf_dir):
    return L.toc_index(spark.createDataFrame(TOC, "doc_id int, from_table boolean, ord int, section string, page int"))


@query("SELECT * FROM " + values([(*r, p) for r, p in zip(PLACED, [6, 7, 9, 8, 2, 4], strict=True)], "doc_id, ord, section, raw_page, manual_page"))
def q_visible_pages(spark, sf_dir):
    toc = L.toc_index(spark.createDataFrame(TOC, "doc_id int, from_table boolean, ord int, section string, page int"))
    return L.visible_pages(spark.createDataFrame(PLACED, "doc_id int, ord int, section string, raw_page int"), toc)


#: Rows of tables, made of the rows of ``part`` so that every rule is met with all and with one too few of its labels.
_CELLS = {
    0: ["章节 Chapter", "标题 Title", "s", "页码 Page"], 1: ["评审 Reviewed by", "职位 Title", "姓名 Name", "签名 Signature"], 2: ["版本 Rev.", "更改描述 Change Description", "生效日期 Effective Date"],
    3: ["ISO 13485", "21 CFR 820", "Reference Procedures"], 4: ["ASL", "AVL", "CPAR", "SCAR"], 5: ["质量管理体系标准 Quality Management System Specification"], 6: ["A", "first", "2020-01-02"], 7: ["适用法规 Suitable Regulations"],
}


def _table_rows(spark, sf_dir):
    """Table p_partkey has two rows: a plain one and one of labels, which comes first or second; every other table lacks its last label."""
    parts = B.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    labels = F.array(*(F.array(*map(F.lit, _CELLS[k])) for k in range(8)))
    key = F.col("p_partkey")
    full = F.get(labels, (key % 8).cast("int"))
    mine = F.when((key / 8).cast("long") % 2 == 1, F.slice(full, 1, F.greatest(F.size(full) - 1, F.lit(1)))).otherwise(full)
    first = (key / 16).cast("long") % 2 == 0
    rows = parts.select(key.alias("doc_id"), F.lit("t").alias("table_id"), F.explode(F.array(F.struct(F.when(first, 0).otherwise(1).alias("row_index"), mine.alias("cells")), F.struct(F.when(first, 1).otherwise(0).alias("row_index"), F.array("p_name").alias("cells")))).alias("r"))
    return rows.select("doc_id", "table_id", "r.*")


_KEY = "lower(regexp_replace(array_to_string({}, ' '), '[\\s[:punct:]，。；：、（）【】《》]+', '', 'g'))"
_LABELS = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in _CELLS[k]) + "]" for k in range(8)) + "]"
TABLE_CLASSES = f"""WITH l AS (SELECT p_partkey, p_name, {_LABELS}[p_partkey % 8 + 1] AS cells FROM part),
m AS (SELECT p_partkey, p_name, CASE WHEN (p_partkey // 8) % 2 = 1 THEN cells[1:greatest(len(cells) - 1, 1)] ELSE cells END AS cells, (p_partkey // 16) % 2 = 0 AS first FROM l),
n AS (SELECT *, CASE WHEN first THEN cells ELSE [p_name] END AS r1, list_concat(CASE WHEN first THEN cells ELSE [p_name] END, CASE WHEN first THEN [p_name] ELSE cells END) AS r2, greatest(len(cells), 1) AS cols FROM m),
k AS (SELECT *, {_KEY.format("r1")} AS k1, {_KEY.format("r2")} AS k2 FROM n)
SELECT p_partkey AS doc_id, 't' AS table_id, CASE
  WHEN contains(k1, '章节chapter') AND contains(k1, '标题titles') AND contains(k1, '页码page') THEN 'table_of_contents'
  WHEN (contains(k2, '评审reviewedby') OR contains(k2, '批准approvedby')) AND contains(k2, '职位title') AND contains(k2, '姓名name') AND contains(k2, '签名signature') THEN 'approval_table'
  WHEN contains(k1, '版本rev') AND contains(k1, '更改描述changedescription') AND contains(k1, '生效日期effectivedate') THEN 'change_history'
  WHEN cols = 3 AND regexp_full_match(p_name, '[A-Z]') THEN 'change_history'
  WHEN contains(k2, 'iso13485') AND (contains(k2, 'qsr820') OR contains(k2, '21cfr820')) AND contains(k2, 'referenceprocedures') THEN 'regulatory_matrix'
  WHEN len(list_filter(['asl', 'avl', 'cpar', 'scar', 'dcc', 'dhf', 'dhr', 'dmr', 'qms'], lambda x: contains(k2, x))) >= 4 THEN 'definition_table'
  WHEN contains(k2, '质量管理体系标准qualitymanagementsystemspecification') OR contains(k2, '适用法规suitableregulations') THEN 'regulatory_references'
  ELSE 'bilingual_prose' END AS content_class FROM k"""


@query(TABLE_CLASSES)
def q_table_class(spark, sf_dir):
    """Classes of tables of labels, over all parts."""
    return L.table_class(_table_rows(spark, sf_dir))


WORDS = [(1, 1, 1, 1, 0, "Control", 1.0, 1.0, 4.0, 2.0, 0.9), (1, 1, 1, 1, 1, "of", 4.5, 1.0, 5.0, 2.1, 0.98), (1, 1, 1, 1, 2, "x", 6.0, 1.0, 7.0, 2.0, 0.1), (1, 1, 1, 2, 0, "Records", 1.0, 3.0, 5.0, 4.0, 0.5)]
WORD_COLUMNS = "page, block, par, line, ord, word, x0, y0, x1, y1, conf"


@query(f"""SELECT page, block, par, line, string_agg(word, ' ' ORDER BY ord) AS text, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1, round(least(avg(conf), 0.92), 6)::DOUBLE AS confidence
FROM {values(WORDS, WORD_COLUMNS)} WHERE conf >= 0.25 GROUP BY page, block, par, line""")
def q_ocr_lines(spark, sf_dir):
    words = spark.createDataFrame(WORDS, "page int, block int, par int, line int, ord int, word string, x0 double, y0 double, x1 double, y1 double, conf double")
    return L.ocr_lines(words).withColumn("confidence", F.round("confidence", 6))


BOXES = [("p1", 1, 0.0, 0.0, 2.0, 2.0), ("p2", 1, 5.0, 5.0, 7.0, 7.0), ("p3", 2, 0.0, 0.0, 2.0, 2.0)]


@query("SELECT * FROM " + values([("p1", True), ("p2", False), ("p3", False)], "block_id, in_table"))
def q_spatial_containment(spark, sf_dir):
    blocks = spark.createDataFrame(BOXES, "block_id string, page int, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    return L.in_tables(blocks, boxes).select("block_id", "in_table")


@query("SELECT * FROM " + values([(1, 0, 1), (1, 1, 1), (1, 2, 3), (1, 3, 3)], "doc_id, ord, page"))
def q_page_breaks(spark, sf_dir):
    rows = [(1, 0, "<w:p/>"), (1, 1, "<w:lastRenderedPageBreak/><w:lastRenderedPageBreak/>"), (1, 2, ""), (1, 3, "<w:r/>")]
    return L.page_breaks(spark.createDataFrame(rows, "doc_id int, ord int, xml string")).select("doc_id", "ord", "page")


GATED = [("a.pdf", 10, None), ("b.exe", 10, "unsupported type"), ("c.docx", 0, "empty file"), ("d.TXT", 60 * 1024 * 1024, "larger than 50 MB"), ("noending", 1, "unsupported type")]


@query("SELECT * FROM " + values(GATED, "path, length, violation"))
def q_upload_gate(spark, sf_dir):
    rows = spark.createDataFrame([g[:2] for g in GATED], "path string, length int")
    return rows.withColumn("violation", B.upload_violation(F.col("path"), F.col("length")))


FRAGMENTS = [(1, 0, 1, "2", "en", "The first", 0.0, 10.0, 5.0, 20.0, 0.9), (1, 1, 1, "2", "en", "goes on", 0.0, 30.0, 6.0, 40.0, 0.8), (1, 2, 1, "2", "en", "- bullet", 0.0, 50.0, 5.0, 60.0, 1.0), (1, 3, 1, "2", "en", "far", 0.0, 90.0, 5.0, 99.0, 1.0)]


@query("SELECT * FROM " + values([(1, 1, 0, 1, "2", "The first goes on", 0.0, 10.0, 6.0, 40.0, 0.8), (1, 2, 2, 1, "2", "- bullet", 0.0, 50.0, 5.0, 60.0, 1.0), (1, 3, 3, 1, "2", "far", 0.0, 90.0, 5.0, 99.0, 1.0)], "doc_id, part, ord, page, section, text, x0, y0, x1, y1, confidence"))
def q_merge_fragments(spark, sf_dir):
    return L.merged_fragments(spark.createDataFrame(FRAGMENTS, "doc_id int, ord int, page int, section string, language string, text string, x0 double, y0 double, x1 double, y1 double, confidence double"))


def top_rows(df, by, order, n):
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= n)


