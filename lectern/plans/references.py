"""Queries over cited references: mentions, roll-up, evidence, provisions, ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.catalogs import LICENCES, PROVISIONS, REGULATIONS
from ..operators import detect as D
from ..sources import blocks as B
from .blocks import LINES
from .registry import query, values


def _licences(spark, sf_dir):
    rows = B.lines(B.table(spark, sf_dir, "documents")).select("doc_id", F.col("pos").alias("ord"), "page", F.col("line").alias("text"))
    return D.mentions(rows, [(n, "licence", p, v) for n, p, v in LICENCES], "")


_PARTS = " UNION ALL ".join(
    f"SELECT '{name}' AS name, doc_id, pos AS ord, page, unnest(regexp_extract_all(line, '{pattern}')) AS hit FROM lines WHERE regexp_matches(line, '{pattern}')" for name, pattern, _ in LICENCES
)
_VERSIONS = "CASE name " + " ".join(f"WHEN '{n}' THEN regexp_extract(hit, '{v}', 1)" for n, _, v in LICENCES if v) + " ELSE '' END"
MENTIONS = f"""WITH {LINES}, raw AS ({_PARTS}),
m AS (SELECT name, doc_id, ord, page, hit, coalesce(nullif({_VERSIONS}, ''), 'unknown') AS version, CASE WHEN contains(lower(hit), lower(name)) THEN 0.98 ELSE 0.94 END::DOUBLE AS confidence FROM raw)"""


@query(
    f"""{MENTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY version <> 'unknown' DESC, confidence DESC, doc_id, ord) AS n FROM m)
SELECT name, count(*) AS mentions, count(DISTINCT doc_id) AS documents, max(version) FILTER (n = 1) AS version, max(confidence) FILTER (n = 1) AS confidence,
  max(hit) FILTER (n = 1) AS citation, max(doc_id) FILTER (n = 1) AS doc_id, max(ord) FILTER (n = 1) AS ord FROM r GROUP BY name"""
)
def q_detected_refs(spark, sf_dir):
    return D.detected(_licences(spark, sf_dir))


@query(f"{MENTIONS} SELECT name, doc_id, ord, page, hit, version, confidence FROM m")
def q_evidence_flat(spark, sf_dir):
    return _licences(spark, sf_dir).select("name", "doc_id", "ord", "page", "hit", "version", "confidence")


@query(f"{MENTIONS} SELECT version, name, count(*) AS n FROM m GROUP BY ALL")
def q_versions(spark, sf_dir):
    return _licences(spark, sf_dir).groupBy("version", "name").agg(F.count(F.lit(1)).alias("n"))


CITED = [
    (1, 0, "per ISO 13485:2016 and 21 CFR 807 and 820"),
    (1, 1, "EU MDR Article 10 and Annex II; MDD 93/42/EEC"),
    (1, 2, "CMDCAS"),
    (1, 3, "符合YY/T 0287-2017要求"),
    (1, 4, "nothing here"),
]
FOUND = [
    (1, 0, "ISO 13485", 4, 18, "2016", 0.98),
    (1, 0, "21 CFR Part 807", 23, 41, "unknown", 0.94),
    (1, 0, "21 CFR Part 820", 23, 41, "unknown", 0.94),
    (1, 1, "EU MDR Regulation (EU) 2017/745", 0, 6, "unknown", 0.94),
    (1, 1, "EU MDD 93/42/EEC", 32, 45, "93/42/EEC", 0.94),
    (1, 2, "Canadian Medical Devices Regulations", 0, 6, "unknown", 0.94),
]


def _cited(spark):
    return spark.createDataFrame(CITED, "doc_id int, ord int, text string")


@query("SELECT * FROM " + values(FOUND, "doc_id, ord, name, start_at, end_at, version, confidence"))
def q_regulation_spans(spark, sf_dir):
    found = D.mentions(_cited(spark).where("ord < 3"), REGULATIONS)
    return found.select("doc_id", "ord", "name", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "version", "confidence")


#: The row that FOUND leaves out; a Han letter right after the year keeps it out of the match, as in the application.
FOUND_REST = [(1, 3, "YY/T 0287", 2, 11, "unknown", 0.98)]


@query("SELECT * FROM " + values(FOUND + FOUND_REST, "doc_id, ord, name, start_at, end_at, version, confidence"))
def q_regulation_spans_all(spark, sf_dir):
    found = D.mentions(_cited(spark), REGULATIONS)
    return found.select("doc_id", "ord", "name", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "version", "confidence")


NEAR = [(1, 1, "EU MDR Regulation (EU) 2017/745", "Article 10"), (1, 1, "EU MDD 93/42/EEC", "Annex II")]


@query("SELECT * FROM " + values(NEAR, "doc_id, ord, name, provision"))
def q_provisions(spark, sf_dir):
    rows = _cited(spark)
    return D.nearest(D.mentions(rows, REGULATIONS), D.provisions(rows, PROVISIONS)).select("doc_id", "ord", "name", "provision")


EXPANDED = [("Articles 5, 6 and 7", ["Article 5", "Article 6", "Article 7"]), ("Annexes I and IX", ["Annex I", "Annex IX"]), ("§ 820.30(g)", ["§ 820.30(g)"]), ("Clause 4.2.3", ["Clause 4.2.3"])]


@query("SELECT * FROM " + values(EXPANDED, "text, provisions"))
def q_expand_provisions(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in EXPANDED], "text string").select("text", D.expanded("text").alias("provisions"))


IDS = [("Follow QSP0401 and iso 13485:2016", ["ISO 13485:2016", "QSP0401"]), ("按QSP0401执行", []), ("按 QSP0401 执行", ["QSP0401"]), ("21 CFR Part 820 and MDD", ["21 CFR PART 820", "MDD"]), ("none", [])]


@query("SELECT text, ids::VARCHAR[] AS ids FROM " + values(IDS, "text, ids"))
def q_ref_extract(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in IDS], "text string").select("text", F.array_sort(T.references("text")).alias("ids"))


_REF = T.REFERENCE.replace("(?iU)", "(?i)")


@query(f"""WITH {LINES}, r AS (SELECT doc_id, pos AS ord, list_sort(list_distinct(list_transform(regexp_extract_all(line, '{_REF}'), lambda m: upper(trim(regexp_replace(m, '\\s+', ' ', 'g')))))) AS ids FROM lines)
SELECT doc_id, ord, ids FROM r WHERE len(ids) > 0""")
def q_line_refs(spark, sf_dir):
    rows = B.lines(B.table(spark, sf_dir, "documents")).select("doc_id", F.col("pos").alias("ord"), F.array_sort(T.references("line")).alias("ids"))
    return rows.where("size(ids) > 0")


TOKENS = [("Articles 5, 6 and 7 of Annex IX", ["annex:ix", "article:5", "article:6", "article:7"]), ("Clause 4.2 and 4.3", ["clause:4.2", "clause:4.3"]), ("Parts 807 and 820", ["part:807", "part:820"]), ("nothing", [])]


@query("SELECT text, tokens::VARCHAR[] AS tokens FROM " + values(TOKENS, "text, tokens"))
def q_provision_tokens(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in TOKENS], "text string").select("text", T.provision_tokens("text").alias("tokens"))
