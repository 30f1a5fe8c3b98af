"""Queries over checks, coverage, terms and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ai, checks, coverage
from ..sources import blocks as B
from .blocks import LINES
from .registry import query, values

#: Terms of the generated texts, as a stand-in for the bilingual catalogue.
TERMS = [("Apache", "Apache License"), ("MIT", "MIT License"), ("version", "Version"), ("token", "Token"), ("Licensed", "Licensed under")]


def _lines(spark, sf_dir):
    return B.lines(B.table(spark, sf_dir, "documents"))


@query(rf"""WITH {LINES}, w AS (SELECT unnest(regexp_extract_all(line, '[a-z]{{5,10}}')) AS term FROM lines)
SELECT term, count(*) AS uses FROM w WHERE length(term) > 6 OR NOT regexp_matches(term, 'tion|the') GROUP BY term HAVING count(*) >= 3""")
def q_terms_mining(spark, sf_dir):
    return checks.repeated_terms(_lines(spark, sf_dir).select(F.col("line").alias("text")), "[a-z]{5,10}", ["tion", "the"], 6)


def _uses(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("block_id", F.col("line").alias("source_text"), F.col("line").alias("target_text"))
    return checks.term_uses(rows, checks.term_table(spark, dict(TERMS)), "block_id")


_CANDIDATE = r"""CASE WHEN contains(lower(line), lower(preferred)) THEN preferred ELSE list_aggregate(list_transform(list_filter(ps, lambda p: length(p) = list_aggregate(list_transform(ps, lambda q: length(q)), 'max')), lambda p: p), 'first') END"""
USES = rf"""WITH {LINES}, m AS (SELECT t.term, t.preferred, block_id, line, list_transform(regexp_extract_all(line, '(?:[A-Z][A-Za-z/-]*(?:[ \t\n\r\f\v]+|$)){{1,7}}'), lambda p: trim(p)) AS ps
  FROM lines JOIN {values(TERMS, "term, preferred")} ON contains(line, t.term)), u AS (SELECT term, preferred, block_id, {_CANDIDATE} AS candidate FROM m)"""


@query(f"{USES} SELECT term, preferred, block_id, candidate FROM u")
def q_term_uses(spark, sf_dir):
    return _uses(spark, sf_dir)


@query(f"""{USES} SELECT term, preferred, count(*) AS frequency, count(DISTINCT candidate) AS variants, count(DISTINCT candidate) FILTER (lower(candidate) <> lower(preferred)) AS alternatives,
  count(DISTINCT candidate) > 1 OR count(DISTINCT candidate) FILTER (lower(candidate) <> lower(preferred)) > 0 AS is_issue FROM u GROUP BY term, preferred""")
def q_term_variants(spark, sf_dir):
    return checks.terminology(_uses(spark, sf_dir), "block_id")


PAIRS = [
    ("p1", "confirmed", True, "按QSP0401执行", "Follow QSP0402", ["a", "b"]),
    ("p2", "confirmed", True, "按 QSP0401 执行", "Follow QSP0401", ["a", "b"]),
    ("p3", "uncertain", False, "任意", "any", ["a", "b"]),
    ("p4", "confirmed", True, "A QSP0401", "B QSP0402", ["a"]),
]


@query("SELECT pair_id, refs_zh::VARCHAR[] AS refs_zh, refs_en, severity FROM " + values([("p1", [], ["QSP0402"], "Major")], "pair_id, refs_zh, refs_en, severity"))
def q_reference_check(spark, sf_dir):
    rows = spark.createDataFrame(PAIRS, "pair_id string, pair_status string, should_check_translation boolean, chinese_text string, english_text string, source_block_ids array<string>")
    return checks.reference_mismatches(rows).select("pair_id", "refs_zh", "refs_en", "severity")


RULED = [("r1", "应建立风险管理程序。", "A risk management procedure shall be established."), ("r2", "不得使用。", "It may be used."), ("r3", "可采购。", "Buy."), ("r4", "记录", "Records " * 40), ("r5", "", "alone")]
ISSUES = [("r2", "incorrect modal verb", "不得", "Major"), ("r2", "missing information", "negation", "Major"), ("r3", "inconsistent terminology", "采购", "Minor"), ("r3", "incorrect modal verb", "可", "Minor"), ("r3", "missing information", "short", "Major"), ("r4", "extra information", "long", "Minor")]


@query("SELECT * FROM " + values(ISSUES, "pair_id, issue_type, subject, severity"))
def q_rule_checks(spark, sf_dir):
    return checks.rule_issues(spark.createDataFrame(RULED, "pair_id string, chinese_text string, english_text string"))


STATUS = "CASE quality WHEN 1 THEN 'paired' WHEN 0 THEN 'uncertain' END"
COVERED = f"""WITH {LINES}, s AS (SELECT l.doc_id, {STATUS} AS st, CASE WHEN quality = 1 THEN l.doc_id END AS pair FROM labels l),
b AS (SELECT n.doc_id, n.lang, n.source, n.pos, n.page, CASE WHEN n.line = '' THEN 'header_footer' ELSE 'paragraph' END AS block_type, CASE WHEN n.lang = 'en' THEN 'en' ELSE 'zh' END AS language FROM lines n),
c AS (SELECT b.*, CASE WHEN block_type = 'header_footer' THEN 'header_footer' ELSE coalesce(st, 'unpaired') END AS status, CASE WHEN block_type <> 'header_footer' THEN pair END AS pair_id FROM b LEFT JOIN s USING (doc_id))"""


def _covered(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc_id", "lang", "source", "pos", "page", F.when(F.col("line") == "", "header_footer").otherwise("paragraph").alias("block_type"), F.when(F.col("lang") == "en", "en").otherwise("zh").alias("language"))
    labels = B.table(spark, sf_dir, "labels")
    status = labels.select("doc_id", F.when(F.col("quality") == 1, "paired").when(F.col("quality") == 0, "uncertain").alias("status"), F.when(F.col("quality") == 1, F.col("doc_id")).alias("pair_id"))
    return coverage.block_status(rows, status, ["doc_id"])


@query(f"{COVERED} SELECT lang, count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in coverage.STATUSES) + " FROM c GROUP BY lang")
def q_coverage_blocks(spark, sf_dir):
    return coverage.summary(_covered(spark, sf_dir), ["lang"])


_OPEN = "status IN ('unpaired', 'uncertain', 'missing_english', 'missing_chinese')"


@query(f"""{COVERED} SELECT doc_id, page, count(*) AS blocks, count(DISTINCT pair_id) AS pairs, count(*) FILTER ({_OPEN}) AS open,
  CASE WHEN count(*) FILTER ({_OPEN}) > 0 AND count(DISTINCT pair_id) > 0 THEN 'Partial coverage' WHEN count(*) FILTER ({_OPEN}) > 0 THEN 'Unpaired content' ELSE 'Covered' END AS state FROM c GROUP BY doc_id, page""")
def q_coverage_pages(spark, sf_dir):
    return coverage.page_coverage(_covered(spark, sf_dir))


@query(f"""{COVERED}, g AS (SELECT source AS section_id, count(*) AS blocks, count(*) FILTER (language = 'zh') AS zh, count(*) FILTER (language = 'en') AS en, count(DISTINCT pair_id) AS pairs,
  count(*) FILTER (language = 'zh' AND status <> 'paired') AS open_zh, count(*) FILTER (language = 'en' AND status <> 'paired') AS open_en, min(page) AS page_start, max(page) AS page_end FROM c WHERE block_type <> 'header_footer' GROUP BY source)
SELECT *, CASE WHEN pairs > 0 AND open_zh + open_en = 0 THEN 'Covered' WHEN pairs > 0 THEN 'Partial coverage' WHEN zh + en > 0 THEN 'Unpaired content' ELSE 'No bilingual main content' END AS state FROM g""")
def q_coverage_sections(spark, sf_dir):
    return coverage.section_coverage(_covered(spark, sf_dir), "source")


#: Topics of the generated texts (clause, title, keywords): clauses are sources, which stand in for sections.
TOPICS = [("src1", "licences", ["License", "Licensed"]), ("src2", "access", ["token =", "@mail"]), ("src3", "numbers", ["+1 ("]), ("none", "absent", ["zzzzzz"])]
_SCORE = "CASE WHEN source = clause OR starts_with(source, clause || '.') THEN 5 ELSE 0 END + list_sum(list_transform(keywords, lambda k: CASE WHEN contains(h, lower(k)) THEN 2 ELSE 0 END))"
MATCHED = rf"""WITH {LINES}, r AS (SELECT doc_id, pos, page, source, trim(regexp_replace(lower(line), '[ \t\n\r\f\v]+', ' ', 'g')) AS h FROM lines),
s AS (SELECT clause, title, doc_id, pos, page, source, ({_SCORE})::INT AS score FROM r, {values(TOPICS, "clause, title, keywords")}),
k AS (SELECT *, row_number() OVER (PARTITION BY clause ORDER BY score DESC, page, source, doc_id, pos) AS n FROM s WHERE score > 0), m AS (SELECT * FROM k WHERE n <= 8)"""


def _matched(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc_id", F.col("pos").alias("ord"), "page", F.col("source").alias("section"), F.col("line").alias("text"))
    return coverage.topic_matches(rows, TOPICS)


@query(f"{MATCHED} SELECT clause, doc_id, pos, page, source, score, n::INT AS n FROM m")
def q_topic_topk(spark, sf_dir):
    return _matched(spark, sf_dir).select("clause", "doc_id", F.col("ord").alias("pos"), "page", F.col("section").alias("source"), "score", "n")


FINDINGS = [("src2 access", "Minor", "a small thing"), ("src2 access", "Major", "these conflict"), ("none", "Minor", "unclear")]


@query(f"""{MATCHED}, t AS (SELECT * FROM {values([x[:2] for x in TOPICS], "clause, title")}),
a AS (SELECT clause, count(*) AS matches, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, array_to_string(list_sort(list(DISTINCT source)), ',') AS sections FROM m GROUP BY clause),
f AS (SELECT string_split(clause, ' ')[1] AS clause, max_by(severity, CASE severity WHEN 'Critical' THEN 4 WHEN 'Major' THEN 3 WHEN 'Minor' THEN 2 ELSE 1 END) AS worst, bool_or(contains(lower(issue), 'conflict')) AS conflict FROM {values(FINDINGS, "clause, severity, issue")} GROUP BY ALL)
SELECT t.clause, t.title, coalesce(matches, 0) AS matches, coalesce(pages, '') AS pages, coalesce(sections, '') AS sections,
  CASE WHEN conflict THEN 'conflict_found' WHEN worst IS NOT NULL THEN 'needs_human_confirmation' WHEN matches IS NULL THEN 'evidence_not_found' ELSE 'evidence_candidate_found' END AS decision,
  coalesce(worst, CASE WHEN matches IS NULL THEN 'Observation' ELSE 'None' END) AS severity FROM t LEFT JOIN a USING (clause) LEFT JOIN f USING (clause)""")
def q_topic_matrix(spark, sf_dir):
    findings = spark.createDataFrame(FINDINGS, "clause string, severity string, issue string")
    return coverage.topic_matrix(_matched(spark, sf_dir), coverage.topic_rows(spark, TOPICS), findings, complete=True)


@query("""SELECT role, count(*) AS n, count(*) FILTER (turn = 0) AS first_turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role""")
def q_status_counts(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("turn") == 0).alias("first_turns"), F.count_distinct("conv_id").alias("conversations"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN 'Critical' WHEN toxic = 1 THEN 'Major' WHEN quality = 0 THEN 'Minor' ELSE 'Observation' END AS severity FROM labels),
r AS (SELECT *, CASE severity WHEN 'Critical' THEN 3 WHEN 'Major' THEN 2 WHEN 'Minor' THEN 1 ELSE 0 END::INT AS rank FROM s) SELECT * FROM r WHERE rank >= 1""")
def q_severity_filter(spark, sf_dir):
    named = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "Critical").when(F.col("toxic") == 1, "Major").when(F.col("quality") == 0, "Minor").otherwise("Observation")
    rows = B.table(spark, sf_dir, "labels").select("doc_id", named.alias("severity"))
    return rows.withColumn("rank", T.severity_rank("severity")).where("rank >= 1")


CLAIMS = [
    ("c1", "ISO 13485", "iso-13485", ["p1"], "QSP0401", ["clause:4.2"], ["clause:4.2", "clause:4.3"]),
    ("c2", "ISO 14971", "ISO 13485", ["p1"], "QSP0401", ["clause:4.2"], ["clause:4.2"]),
    ("c3", "ISO 13485", "ISO 13485", ["p9"], "QSP0401", ["clause:9.9"], ["clause:4.2"]),
    ("c4", "ISO 13485", "ISO 13485", ["p1", "p2"], "not there", [], []),
]


@query("SELECT * FROM " + values([("c1", ""), ("c2", "target"), ("c3", "evidence,quote,provision"), ("c4", "quote")], "claim_id, failures"))
def q_prov_gates(spark, sf_dir):
    claims = spark.createDataFrame(CLAIMS, "claim_id string, target string, selected string, pair_ids array<string>, quote string, claimed array<string>, supported array<string>")
    pairs = spark.createDataFrame([("p1", "Follow qsp0401."), ("p2", "Other")], "pair_id string, text string")
    return checks.provenance(claims, pairs)


SENT = [("4.1", "a"), ("4.1", "b"), ("4.2", "c")]
ANSWERED = [("4.1", "a"), ("4.1", "a"), ("4.1", "z"), ("4.2", "c")]


@query(f"""SELECT section, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (s IS NULL) AS unknown, count(*) FILTER (n > 1) AS repeated FROM
  (SELECT coalesce(x.section, y.section) AS section, x.s, y.n FROM (SELECT section, block_id, 1 AS s FROM {values(SENT, "section, block_id")}) x
   FULL JOIN (SELECT section, block_id, count(*) AS n FROM {values(ANSWERED, "section, block_id")} GROUP BY ALL) y ON x.section = y.section AND x.block_id = y.block_id) GROUP BY section""")
def q_answer_audit(spark, sf_dir):
    return checks.audit(spark.createDataFrame(SENT, "section string, block_id string"), spark.createDataFrame(ANSWERED, "section string, block_id string"))


@query("""SELECT event_id, (props->>'k')::INT AS k, CASE WHEN props->>'k' IS NULL THEN 'not the schema' END AS violation FROM events""")
def q_json_contract(spark, sf_dir):
    events = B.table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.when(F.from_json("props", "k int")["k"].isNull(), "not the schema").alias("violation"))


VERDICTS = [("p1", "uncertain", "confirmed", True), ("p2", "uncertain", "uncertain", True), ("p3", "confirmed", "confirmed", False), ("p4", "uncertain", "uncertain", False)]


@query("SELECT * FROM " + values([(v[0], v[2], v[3]) for v in VERDICTS], "pair_id, pair_status, ai_validated"))
def q_verdict_merge(spark, sf_dir):
    pairs = spark.createDataFrame([v[:2] for v in VERDICTS], "pair_id string, pair_status string")
    verdicts = spark.createDataFrame([("p1", True, 0.9), ("p2", True, 0.7), ("p9", True, 1.0)], "pair_id string, correct boolean, confidence double")
    return ai.merged_verdicts(pairs, verdicts)


@query()
def q_ai_boundary(spark, sf_dir):
    rows = ai.batched(B.turns(B.table(spark, sf_dir, "conversations")))
    asked = ai.requests(rows, "translate", ["ord", "text"])
    return ai.parsed(ai.answers(asked), "struct<block_id:string,translated_english:string>").groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels WHERE quality = 1)
SELECT l.doc_id, (i % 20)::INT AS colour, CASE WHEN quality = 1 THEN 'confirmed' ELSE 'unpaired' END AS border FROM labels l LEFT JOIN p USING (doc_id)""")
def q_pair_colours(spark, sf_dir):
    labels = B.table(spark, sf_dir, "labels")
    paired = labels.where("quality = 1").select("doc_id")
    # Ranks over all pairs without one task: counts of id ranges first, then ranks inside them.
    parts = paired.withColumn("part", F.floor(F.col("doc_id") / 4096))
    from pyspark.sql import Window

    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = parts.withColumn("inside", F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1).join(before, "part")
    colour = ranked.select("doc_id", F.pmod(F.col("before") + F.col("inside"), F.lit(20)).cast("int").alias("colour"))
    return labels.join(colour, "doc_id", "left").select("doc_id", "colour", F.when(F.col("quality") == 1, "confirmed").otherwise("unpaired").alias("border"))


