"""Queries over work lists, counts, statuses, issue rows, headings, furniture and groups, with rows made of the generated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import layout as L
from ..operators import report as R
from ..sources import blocks as B
from .blocks import LINES, TURNS
from .registry import literal, query


def _table(spark, sf_dir, name, *exprs):
    return B.table(spark, sf_dir, name).selectExpr(*exprs)


def _turns(spark, sf_dir):
    return B.turns(B.table(spark, sf_dir, "conversations"))


#: The same expressions in both engines.
PAIR = [
    "o_orderkey AS pair_id", "CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'uncertain' ELSE 'missing_english' END AS status", "o_orderpriority AS method",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'header' WHEN o_orderkey % 4 = 1 THEN 'paragraph' WHEN o_orderkey % 4 = 2 THEN 'table_cell' ELSE 'reference_table' END AS block_type",
    "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderpriority END AS chinese_text",
]
SEVERITY = "CASE l_returnflag WHEN 'R' THEN 'Critical' WHEN 'A' THEN 'Major' ELSE CASE l_linestatus WHEN 'O' THEN 'Minor' ELSE 'Observation' END END AS severity"
PAIRS = f"pairs AS (SELECT {', '.join(PAIR)} FROM orders)"


def _pairs(spark, sf_dir):
    return _table(spark, sf_dir, "orders", *PAIR)


@query(f"WITH {TURNS} SELECT block_id, page FROM turns WHERE page BETWEEN 2 AND 3")
def q_page_range(spark, sf_dir):
    return R.page_range(_turns(spark, sf_dir), 2, 3).select("block_id", "page")


WORK = ["p_partkey AS block_id", "CASE WHEN p_partkey % 3 = 0 THEN p_name || ' 版本' WHEN p_partkey % 3 = 1 THEN p_name ELSE '' END AS text", "p_size % 4 = 0 AS ignored"]


@query(f"SELECT block_id, text FROM (SELECT {', '.join(WORK)} FROM part) WHERE NOT ignored AND contains(text, '版本')")
def q_to_translate(spark, sf_dir):
    return R.to_translate(_table(spark, sf_dir, "part", *WORK)).select("block_id", "text")


@query(f"WITH {TURNS}, said AS (SELECT block_id, substr(text, 1, 20) AS translation FROM turns WHERE ord % 2 = 0) SELECT t.block_id, coalesce(s.translation, '') AS translation FROM turns t LEFT JOIN said s USING (block_id)")
def q_with_translations(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    said = rows.where("ord % 2 = 0").select("block_id", F.substring("text", 1, 20).alias("translation"))
    return R.with_translations(rows, said).select("block_id", "translation")


@query(f"WITH {PAIRS} SELECT pair_id, status, block_type FROM pairs WHERE coalesce(chinese_text, '') <> '' AND status IN ('confirmed', 'uncertain') AND block_type NOT IN ('header', 'footer', 'reference_table')")
def q_usable_pairs(spark, sf_dir):
    return R.usable_pairs(_pairs(spark, sf_dir)).select("pair_id", "status", "block_type")


@query(f"""WITH {PAIRS}, o AS (SELECT {SEVERITY} FROM lineitem) SELECT (SELECT count(*) FROM conversations) AS blocks, (SELECT count(*) FROM pairs WHERE status = 'confirmed') AS confirmed, (SELECT count(*) FROM pairs WHERE status <> 'confirmed') AS not_confirmed,
  count(*) AS observations, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'Major') AS major, count(*) FILTER (severity = 'Minor') AS minor, count(*) FILTER (severity = 'Observation') AS observation FROM o""")
def q_report_counts(spark, sf_dir):
    return R.report_counts(_turns(spark, sf_dir), _pairs(spark, sf_dir), _table(spark, sf_dir, "lineitem", SEVERITY))


@query(f"WITH {PAIRS} SELECT method, count(*) AS pairs FROM pairs GROUP BY method")
def q_pair_counts(spark, sf_dir):
    return R.pair_counts(_pairs(spark, sf_dir), "method")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'paired' WHEN 'O' THEN 'uncertain' ELSE 'rejected' END"


@query(f"""WITH p AS (SELECT o_orderkey AS id, {STATUS} AS status FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT b.o_orderkey AS block_id, CASE WHEN b.o_custkey % 10 = 0 THEN 'header_footer' ELSE coalesce(x.status, y.status, 'unpaired') END AS status, CASE WHEN b.o_custkey % 10 <> 0 THEN coalesce(x.id, y.id) END AS pair_id
FROM orders b LEFT JOIN p x ON x.id = b.o_orderkey LEFT JOIN p y ON y.id = b.o_orderkey - 1""")
def q_block_statuses(spark, sf_dir):
    pairs = _table(spark, sf_dir, "orders", "o_orderkey AS pair_id", f"{STATUS} AS status", "array(o_orderkey) AS chinese_ids", "array(o_orderkey + 1) AS english_ids")
    blocks = _table(spark, sf_dir, "orders", "o_orderkey AS block_id", "CASE WHEN o_custkey % 10 = 0 THEN 'header_footer' ELSE 'paragraph' END AS block_type")
    return R.block_statuses(blocks, pairs)


@query("SELECT event_id AS position FROM events QUALIFY row_number() OVER (PARTITION BY user_id, substr(trim(regexp_replace(props, '\\s+', ' ', 'g')), 1, 80), event_type ORDER BY event_id) = 1")
def q_unique_issues(spark, sf_dir):
    issues = _table(spark, sf_dir, "events", "event_id AS position", "concat(' ', user_id) AS location", "props AS source_text", "event_type AS issue_type")
    return R.unique_issues(issues).select("position")


@query("SELECT user_id || '-' || event_type AS finding_id, min(event_id) AS position, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def q_unique_findings(spark, sf_dir):
    findings = _table(spark, sf_dir, "events", "concat(user_id, '-', event_type) AS finding_id", "event_id AS position", "value")
    return R.unique_findings(findings).select("finding_id", "position", "value")


REVIEWED = ["event_id", "CASE WHEN event_type = 'click' THEN 'OK' ELSE event_type END AS status", "CASE WHEN user_id % 3 = 0 THEN 'None' ELSE 'Major' END AS severity"]


@query("SELECT event_id FROM events WHERE event_type <> 'click' AND user_id % 3 <> 0")
def q_reported_rows(spark, sf_dir):
    return R.reported_rows(_table(spark, sf_dir, "events", *REVIEWED)).select("event_id")


@query("""SELECT l_orderkey AS pair_id, l_linenumber AS line, o_orderpriority AS location, o_orderstatus AS chinese_text, o_orderpriority AS english_text
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N'""")
def q_section_issues(spark, sf_dir):
    issues = _table(spark, sf_dir, "lineitem", "l_orderkey AS pair_id", "l_linenumber AS line", "CASE l_returnflag WHEN 'N' THEN 'none' ELSE 'Major' END AS severity")
    pairs = _table(spark, sf_dir, "orders", "o_orderkey AS pair_id", "o_orderpriority AS location", "o_orderstatus AS chinese_text", "o_orderpriority AS english_text")
    return R.section_issues(issues, pairs).select("pair_id", "line", "location", "chinese_text", "english_text")


@query("""WITH p AS (SELECT o_orderstatus AS document, o_custkey AS section_id, count(*) AS blocks FROM orders GROUP BY ALL),
r AS (SELECT o_orderstatus AS document, o_custkey AS section_id, count(*) AS pairs, count(*) FILTER (o_totalprice > 100000) AS issues FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT document, section_id, p.blocks, CASE WHEN r.pairs IS NULL THEN 'No' ELSE 'Yes' END AS processed, coalesce(pairs, 0) AS pairs, coalesce(issues, 0) AS issues, CASE WHEN r.pairs IS NULL THEN 'Not processed' ELSE 'done' END AS status FROM p LEFT JOIN r USING (document, section_id)""")
def q_section_results(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderstatus": "document", "o_custkey": "section_id"})
    by = orders.groupBy("document", "section_id").agg(F.count(F.lit(1)).alias("blocks"))
    done = orders.where("o_orderpriority = '1-URGENT'").groupBy("document", "section_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("o_totalprice") > 100000).alias("issues"), F.lit("done").alias("status"))
    return R.section_coverage(by, done)


@query("SELECT coalesce(sum(CASE WHEN event_type <> 'error' THEN user_id END), 0)::BIGINT AS input_tokens, coalesce(sum(event_id % 100), 0)::BIGINT AS output_tokens, count(*) AS requests FROM events")
def q_usage(spark, sf_dir):
    return R.usage(_table(spark, sf_dir, "events", "CASE WHEN event_type <> 'error' THEN user_id END AS prompt_tokens", "event_id % 100 AS completion_tokens"))


@query("""WITH u AS (SELECT p_brand, trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', ' ', 'g')) AS k, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, arg_min(k, (-n, k)) AS recommended, max(n) AS uses, count(*) AS variants FROM u GROUP BY p_brand""")
def q_chosen_translation(spark, sf_dir):
    return R.chosen_translation(_table(spark, sf_dir, "part", "p_brand", "concat(p_name, ' (', p_type, ')') AS english"), "p_brand", "english")


PLACED = [
    "doc_id", "pos AS ord", "page", "CASE WHEN pos % 20 = 0 AND doc_id % 7 = 0 THEN '文件编号 Doc No ' || line WHEN pos % 20 = 19 AND doc_id % 5 = 0 THEN '4.2 Scope' ELSE 'x ' || line END AS text",
    "CASE WHEN pos % 6 = 5 THEN 'footer' ELSE 'paragraph' END AS block_type", "CASE WHEN pos % 3 > 0 THEN CAST((pos % 20) * 45 AS DOUBLE) END AS y0", "CASE WHEN pos % 3 > 0 THEN CAST((pos % 20) * 45 + 40 AS DOUBLE) END AS y1",
    "CASE WHEN pos % 3 > 0 THEN CAST((pos * 3) % 7 AS DOUBLE) END AS x0",
]


def _placed(spark, sf_dir):
    return B.lines(B.table(spark, sf_dir, "documents")).selectExpr(*PLACED)


@query(f"""WITH {LINES}, b AS (SELECT {', '.join(PLACED)} FROM lines), n AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS pages FROM b)
SELECT doc_id, ord, CASE WHEN contains(lower(text), '文件编号 doc no') THEN true WHEN text = '4.2 Scope' THEN false ELSE pages > 2 AND (block_type = 'footer' OR coalesce(y1 <= 135 OR y0 >= 790, false)) END AS furniture FROM n""")
def q_running_furniture(spark, sf_dir):
    return L.running_furniture(_placed(spark, sf_dir)).select("doc_id", "ord", "furniture")


@query(f"WITH {LINES}, b AS (SELECT {', '.join(PLACED)} FROM lines) SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page, coalesce(y0, ord), coalesce(x0, 0), ord) AS place FROM b")
def q_reading_order(spark, sf_dir):
    return L.reading_order(_placed(spark, sf_dir)).select("doc_id", "ord", "place")


GROUPED = [
    "doc_id", "pos AS ord", "page", "CASE WHEN pos % 7 = 6 THEN 'Chinese' WHEN pos % 11 = 10 THEN 'Neutral' ELSE 'English' END AS language", "page AS segment_id", "CASE WHEN pos % 9 = 0 THEN 'heading' ELSE 'paragraph' END AS block_type",
    "CASE WHEN doc_id % 4 = 0 AND pos % 6 < 2 THEN 1 END AS table_index", "CASE WHEN doc_id % 4 = 0 AND pos % 6 < 2 THEN CAST(pos % 5 AS INT) END AS row_index", "CAST(NULL AS INT) AS cell_index",
    "CASE WHEN doc_id % 2 = 0 THEN CAST((doc_id * pos) % 40 AS DOUBLE) END AS x0", "CASE WHEN doc_id % 2 = 0 THEN CAST(pos * 30 AS DOUBLE) END AS y0", "CASE WHEN doc_id % 2 = 0 THEN CAST(pos * 30 + pos % 35 AS DOUBLE) END AS y1",
    "CASE WHEN pos % 4 = 3 THEN '- ' || line ELSE line END AS text",
]
_ENDED = r"regexp_matches({}, '[。！？.!?；;：:]$|[。！？.!?；;：:][”’''\")]$')"
_BULLET = r"regexp_matches({}, '^\s*(?:[-•●▪◦]|[(（]?[0-9]+[.)、）]|[A-Za-z][.)])\s*')"
PARAGRAPH_GROUPS = f"""WITH {LINES}, b AS (SELECT {', '.join(GROUPED)} FROM lines),
p AS (SELECT *, lag(page) OVER w AS p_page, lag(language) OVER w AS p_language, lag(segment_id) OVER w AS p_segment, lag(table_index) OVER w AS p_table, lag(row_index) OVER w AS p_row, lag(text) OVER w AS p_text, lag(x0) OVER w AS p_x0, lag(y1) OVER w AS p_y1, row_number() OVER w AS i
  FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
g AS (SELECT doc_id, ord, CASE WHEN i = 1 OR language NOT IN ('Chinese', 'English') OR language IS DISTINCT FROM p_language OR segment_id IS DISTINCT FROM p_segment OR page <> p_page THEN 1
  WHEN table_index IS NOT NULL OR p_table IS NOT NULL THEN CASE WHEN table_index IS NOT DISTINCT FROM p_table AND row_index IS NOT DISTINCT FROM p_row THEN 0 ELSE 1 END
  WHEN block_type = 'heading' OR {_BULLET.format("text")} OR ({_BULLET.format("p_text")} AND {_ENDED.format("p_text")}) THEN 1
  WHEN y0 IS NOT NULL AND p_y1 IS NOT NULL THEN CASE WHEN y0 - p_y1 < -2 OR y0 - p_y1 > 22 OR abs(x0 - p_x0) > 24 THEN 1 WHEN NOT {_ENDED.format("p_text")} THEN 0 WHEN y0 - p_y1 <= 8 AND abs(x0 - p_x0) <= 6 THEN 0 ELSE 1 END
  WHEN NOT {_ENDED.format("p_text")} AND length(p_text) < CASE WHEN language = 'English' THEN 90 ELSE 55 END THEN 0 ELSE 1 END AS new FROM p)
SELECT doc_id, ord, (sum(new) OVER (PARTITION BY doc_id ORDER BY ord))::INT AS group_id FROM g"""


@query(PARAGRAPH_GROUPS)
def q_paragraph_groups(spark, sf_dir):
    return L.paragraph_groups(B.lines(B.table(spark, sf_dir, "documents")).selectExpr(*GROUPED)).select("doc_id", "ord", "group_id")


def _pick(values: list, by: str) -> str:
    """One of some values, by a number, as SQL of both engines."""
    return "CASE " + " ".join(f"WHEN {by} % {len(values)} = {i} THEN {literal(v)}" for i, v in enumerate(values)) + " END"


TEMPLATES, SECTIONS = ["%1.%2", "%1.", "6.%2", "%1.0", "%1)", "%1.%2)", "%1", "a%3"], ["4.2", "", "10", "A.1", "1.0"]
NUMBERED = ["p_partkey", f"{_pick(TEMPLATES, 'p_partkey')} AS template", f"{_pick(SECTIONS, 'p_size')} AS section", "p_partkey % 3 = 0 AS styled"]


@query(f"""SELECT p_partkey, regexp_matches(section, '^[0-9]') AND NOT contains(template, ')') AND (template = '%1.%2' OR template IN ('6.%2', '%1.0') OR styled) AS is_section FROM (SELECT {', '.join(NUMBERED)} FROM part)""")
def q_section_numbering(spark, sf_dir):
    rows = _table(spark, sf_dir, "part", *NUMBERED)
    return rows.select("p_partkey", C.section_numbering(F.col("template"), F.col("section"), F.col("styled")).alias("is_section"))


HEADED = ["p_partkey", f"concat({_pick(['', '3.2 ', '更改历史记录 ', 'History of Change ', '3.2', '7  '], 'p_partkey')}, p_name, repeat('x', CAST((p_size % 7) * 40 AS INT))) AS text", "p_partkey % 5 = 0 AS styled", "p_size % 2 = 0 AS listed"]


@query(f"""SELECT p_partkey, styled OR text LIKE '更改历史记录%' OR lower(text) LIKE 'history of change%' OR (regexp_matches(text, '^[0-9]+(\\.[0-9]+)*\\s') AND listed AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 160) AS heading FROM (SELECT {', '.join(HEADED)} FROM part)""")
def q_heading_paragraphs(spark, sf_dir):
    rows = _table(spark, sf_dir, "part", *HEADED)
    return rows.select("p_partkey", C.heading_paragraph(F.col("text"), F.col("styled"), F.col("listed")).alias("heading"))


CLASSED = ["p_partkey", f"concat(p_name, {_pick([' Head Office', ' 香港', ' 电话 Tel', ' QSP1234', ' aQSP1234', '', ' Hong Kong'], 'p_partkey')}) AS text", f"{_pick(['1.0', '3.1.2', '3.10', '3.2', '4', ''], 'p_size')} AS section"]


@query(f"""SELECT p_partkey, CASE WHEN section = '1.0' AND (text LIKE '% Head Office' OR text LIKE '% 香港' OR text LIKE '% 电话 Tel' OR text LIKE '% Hong Kong') THEN 'address_block' WHEN section LIKE '3.1%' THEN 'organization_chart_or_structure'
  WHEN section LIKE '3.2%' THEN 'job_description' WHEN text LIKE '% QSP1234' THEN 'procedure_reference' ELSE 'bilingual_prose' END AS content_class FROM (SELECT {', '.join(CLASSED)} FROM part)""")
def q_paragraph_classes(spark, sf_dir):
    return _table(spark, sf_dir, "part", *CLASSED).select("p_partkey", C.paragraph_class(F.col("text"), F.col("section")).alias("content_class"))


ROWED = ["p_partkey", f"{_pick(['A', ' B ', 'AB', 'c', ''], 'p_partkey')} AS c0", f"{_pick(['on 2020-01-02', 'x2020-01-02', '2021/3/4 and 2022-05-06', 'none'], 'p_size')} AS c1", "CASE WHEN p_partkey % 2 = 0 THEN '1999-12-31' ELSE p_name END AS c2"]


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'A' WHEN p_partkey % 5 = 1 THEN 'B' END AS revision_id, CASE WHEN p_size % 4 = 0 THEN '2020-01-02' WHEN p_size % 4 = 2 THEN '2021/3/4' WHEN p_partkey % 2 = 0 THEN '1999-12-31' END AS effective_date FROM part""")
def q_row_attributes(spark, sf_dir):
    rows = _table(spark, sf_dir, "part", *ROWED).withColumn("r", C.row_attributes(F.array("c0", "c1", "c2")))
    return rows.select("p_partkey", "r.revision_id", "r.effective_date")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Chinese and English' WHEN 1 THEN 'Chinese' WHEN 2 THEN 'English' ELSE 'Unknown' END AS language FROM part")
def q_reference_language(spark, sf_dir):
    rows = _table(spark, sf_dir, "part", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN concat('标准 ', p_name) WHEN 1 THEN concat('标准 ', p_size) WHEN 2 THEN p_name ELSE concat(p_size, ' §') END AS text")
    return rows.select("p_partkey", C.reference_language(F.col("text")).alias("language"))


#: Whole documents as blocks, with lines of both languages, list items and a section among them.
def _mixed(line: str, i: str) -> str:
    return f"CASE WHEN {i} % 7 = 3 THEN '版本标准' WHEN {i} % 7 = 5 THEN '- item' WHEN {i} % 13 = 8 THEN '4.2 Scope' ELSE 'word ' || {line} END"


_NORMAL = "trim(regexp_replace(translate({}, chr(160), ' '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, len(l) AS n, i, {_mixed("l[i]", "(i - 1)")} AS t FROM d, unnest(range(1, len(l) + 1)) u(i)),
f AS (SELECT *, {_NORMAL.format("t")} AS x FROM e), k AS (SELECT *, CASE WHEN x = '版本标准' THEN 'zh' ELSE 'en' END AS language FROM f),
s AS (SELECT *, CASE WHEN language = lag(language) OVER w AND x NOT LIKE '-%' AND x <> '4.2 Scope' THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS piece FROM s)
SELECT doc_id, CASE WHEN n = 1 THEN 'b' || doc_id ELSE 'seg_' || substr(sha256('b' || doc_id || chr(31) || piece::INT || chr(31) || string_agg(x, ' ' ORDER BY i)), 1, 12) END AS block_id, piece::BIGINT + 100 * (doc_id % 9) AS ord, CASE WHEN n = 1 THEN string_agg(t, ' ') ELSE string_agg(x, ' ' ORDER BY i) END AS text, language
FROM g GROUP BY doc_id, n, piece, language""")
def q_split_mixed(spark, sf_dir):
    lines = "array_join(transform(split(text, '\n'), (l, i) -> {}), '\n') AS text".format(_mixed("l", "i"))
    return L.split_mixed(_table(spark, sf_dir, "documents", "doc_id", "concat('b', doc_id) AS block_id", "doc_id % 9 AS ord", lines))


SECTIONED = ["doc_id", "pos AS ord", "page", "CASE WHEN pos % 13 < 4 THEN NULL WHEN pos % 13 < 9 THEN '4.1' ELSE '4.2' END AS section"]


@query(f"""WITH {LINES}, b AS (SELECT {', '.join(SECTIONED)} FROM lines), n AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR section IS DISTINCT FROM lag(section) OVER w OR page <> lag(page) OVER w THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
g AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id ORDER BY ord))::INT AS segment_id FROM n) SELECT doc_id, segment_id, section, page, min(ord) AS start_ord, max(ord) AS end_ord, count(*) AS blocks FROM g GROUP BY ALL""")
def q_section_segments(spark, sf_dir):
    return L.section_segments(B.lines(B.table(spark, sf_dir, "documents")).selectExpr(*SECTIONED))


MOVES = ["l_orderkey", "l_linenumber", "CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 7 = 1 THEN concat(l_partkey % 4, '') ELSE concat(l_partkey % 4, '.', l_suppkey % 3) END AS previous", "CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber = 6 THEN 'x' WHEN l_linenumber % 2 = 0 THEN concat(l_orderkey % 4, '.', l_orderkey % 3, '.', l_partkey % 3) ELSE concat(l_orderkey % 4, '') END AS candidate"]


@query(f"""WITH m AS (SELECT {', '.join(MOVES)} FROM lineitem), p AS (SELECT *, list_transform(string_split(previous, '.'), lambda x: try_cast(x AS INT)) AS a, CASE WHEN candidate IN ('', 'x') THEN NULL ELSE list_transform(string_split(candidate, '.'), lambda x: try_cast(x AS INT)) END AS b FROM m)
SELECT l_orderkey, l_linenumber, CASE WHEN candidate = '' THEN false WHEN previous IS NULL OR previous = candidate OR b IS NULL THEN true WHEN b[1:len(a)] = a THEN true WHEN a[1:len(b)] = b THEN false ELSE b > a END AS allowed FROM p""")
def q_transition_allowed(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem", *MOVES)
    return rows.select("l_orderkey", "l_linenumber", L.transition_allowed(F.col("previous"), F.col("candidate")).alias("allowed"))


PACKED = ["o_orderstatus AS document", "concat(o_custkey % 12, '.', o_custkey % 7) AS section", "o_orderkey AS ord", "concat('b', o_orderkey) AS block_id", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS title", "CAST(o_custkey % 50 AS INT) AS page"]


@query(f"""WITH b AS (SELECT {', '.join(PACKED)}, o_custkey % 12 AS x, o_custkey % 7 AS y FROM orders)
SELECT document, section, coalesce(arg_min(title, ord) FILTER (title <> ''), '') AS title, min(page) AS page_start, max(page) AS page_end, list(block_id ORDER BY ord) AS block_ids, (row_number() OVER (PARTITION BY document ORDER BY x, y))::INT AS place FROM b WHERE x >= 2 GROUP BY document, section, x, y""")
def q_section_packages(spark, sf_dir):
    return R.section_packages(_table(spark, sf_dir, "orders", *PACKED))


@query("""WITH o AS (SELECT o_orderkey AS position, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'p' || (o_orderkey % 1000) END AS given, 'd' || (o_custkey % 3) AS document, '4.' || (o_custkey % 9) AS section, o_orderpriority, o_custkey FROM orders WHERE o_orderstatus <> 'P'),
i AS (SELECT *, CASE WHEN given = '' THEN document || ':' || section || ':pair:1' ELSE given END AS own FROM o)
SELECT CASE WHEN row_number() OVER (PARTITION BY own ORDER BY position) > 1 THEN document || ':' || section || ':' || own ELSE own END AS pair_id, document, section, CASE o_orderpriority WHEN '1-URGENT' THEN 0.9::DOUBLE WHEN '5-LOW' THEN 0.35::DOUBLE ELSE 0.65::DOUBLE END AS score FROM i""")
def q_answered_pairs(spark, sf_dir):
    pair = "array(named_struct('pair_id', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('p', o_orderkey % 1000) END, 'confidence', CASE o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '5-LOW' THEN 'Low' ELSE 'other' END, 'chinese_ids', array(concat('b', o_orderkey)), 'english_ids', cast(array() AS array<string>))) AS pairs"
    results = _table(spark, sf_dir, "orders", "concat('d', o_custkey % 3) AS document", "concat('4.', o_custkey % 9) AS section", "o_orderkey AS position", "CASE o_orderstatus WHEN 'P' THEN 'Failed' WHEN 'F' THEN 'OK' ELSE 'Needs review' END AS status", "1 AS page_start", pair)
    blocks = _table(spark, sf_dir, "orders", "concat('b', o_orderkey) AS block_id", "CAST(o_custkey % 50 AS INT) AS page").where("page > 5")
    return R.answered_pairs(results, blocks).select("pair_id", "document", "section", "score")
