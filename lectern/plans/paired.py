"""Queries over pairs: candidates, assignment, leftovers, following rows, parallel runs, benchmark matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..operators import pairing as P
from ..operators.pair_blocks import pair_blocks
from ..sources import blocks as B
from .blocks import TURNS
from .registry import query, values


def _turns(spark, sf_dir):
    return B.turns(B.table(spark, sf_dir, "conversations")).drop("role")


def _sides(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    return rows.where("language = 'zh'"), rows.where("language = 'en'")


_TOKENS = "regexp_extract_all(trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\\s./:-]', ' ', 'g'), '\\s+', ' ', 'g')), '[a-z0-9]+(?:[./:-][a-z0-9]+)*')"
#: Words with letters beyond ASCII hold no entity; marks beyond it part words.
_PLAIN = r"regexp_replace(translate({}, '，。；：、（）【】《》！？“”‘’…–—', '                   '), '[A-Za-z0-9_]*[\x{{80}}-\x{{10FFFF}}][A-Za-z0-9_\x{{80}}-\x{{10FFFF}}]*', '‡', 'g')"
_ENTITY = r"(?i)\b(?:QSP[0-9]{4}|WI[0-9]{3,5}|ISO[-\s]?[0-9]+|21\s+CFR(?:\s+Part)?\s*[0-9]+|EU\s+(?:MDR|MDD)|YY/?T?\s*[0-9]+|[A-Z]{2,6}|[0-9]+(?:\.[0-9]+)+(?:\.[a-z]\)?)?)\b"
_REFERENCE = (
    r"(?i)\b(?:ISO[-\s]?[0-9]{4,5}(?::[0-9]{4})?|BS\s+EN\s+ISO\s+[0-9]{4,5}(?::[0-9]{4})?|QSP[0-9]{4}|WI[0-9]{3,5}|21\s+CFR(?:\s+Part)?\s*[0-9]+"
    r"|(?:EU\s+)?(?:MDR|MDD)|YY/?T?\s*[0-9]{4}|(?:[0-9]{2}/[0-9]{2}/EEC)|Regulation\s*\(EU\)\s*[0-9]{4}/[0-9]+|Directive\s*[0-9]{2}/[0-9]{2}/EEC)\b"
)
_FOUND = f"list_distinct(list_transform(list_concat(regexp_extract_all(plain, '{_ENTITY}'), regexp_extract_all(plain, '{_REFERENCE}')), lambda x: upper(x)))"
CANDIDATES = f"""WITH {TURNS}, t0 AS (SELECT *, {_PLAIN.format("text").replace("{{", "{").replace("}}", "}")} AS plain FROM turns), k AS (SELECT *, {_TOKENS.format("text")} AS tok, {_FOUND} AS found FROM t0),
pairs AS (SELECT a.doc_id, a.ord AS a_ord, b.ord AS b_ord, a.text AS a_text, b.text AS b_text, a.tok AS a_tok, b.tok AS b_tok, a.page AS a_page, b.page AS b_page, a.found AS a_found, b.found AS b_found
  FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.language = 'zh' AND b.language = 'en' AND abs(a.page - b.page) <= 2),
parts AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a_tok), lambda t: least(len(list_filter(a_tok, lambda x: x = t)), len(list_filter(b_tok, lambda x: x = t))))), 0)::DOUBLE / greatest(len(a_tok), 1) AS semantic,
  CASE WHEN len(a_found) + len(b_found) = 0 THEN 0.5 ELSE len(list_intersect(a_found, b_found))::DOUBLE / len(list_distinct(list_concat(a_found, b_found))) END AS entity_s,
  CASE abs(a_page - b_page) WHEN 0 THEN 1.0 WHEN 1 THEN 0.65 WHEN 2 THEN 0.2 ELSE 0.0 END::DOUBLE AS page_s, CASE WHEN a_page = b_page THEN 1.0 ELSE 0.0 END::DOUBLE AS section_s,
  CASE WHEN length(a_text) = 0 OR length(b_text) = 0 THEN 0.0 ELSE sqrt(least(length(a_text), length(b_text))::DOUBLE / greatest(length(a_text), length(b_text))) END AS length_s,
  CASE WHEN a_page <> b_page THEN 0.2 ELSE greatest(0.0, 1 - abs(a_ord - b_ord)::DOUBLE / 800) END::DOUBLE AS layout_s FROM pairs)"""
PARTS = ["semantic", "entities", "page", "section", "length", "layout"]


def _blocks(spark, sf_dir):
    """Turns as full blocks; a page is its own section."""
    none = lambda kind: F.lit(None).cast(kind)
    return _turns(spark, sf_dir).withColumns(
        {"section": F.concat(F.lit("p"), F.col("page").cast("string")), "content_class": F.lit("bilingual_prose"), "block_type": F.lit("paragraph"), "ignored": F.lit(False), "revision_id": none("string"),
         "effective_date": none("string"), "table_id": none("string"), "row_index": none("int"), "col_index": none("int"), "y0": none("double"), "y1": none("double")}
    )


def _scored(spark, sf_dir):
    rows = _blocks(spark, sf_dir)
    pairs = P.candidates(P.prepared(rows.where("language = 'zh'"), "text", True), P.prepared(rows.where("language = 'en'"), "text", False)).where(P.allowed(F.col("a"), F.col("b")))
    # Token recall stands for meaning here, as SQL has no edit-distance ratios; q_pair_blocks has the full score.
    rows = P.scored(pairs, S.bag_recall(F.col("a.bag"), F.col("b.bag")))
    return rows.select("doc_id", F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), *(F.round(f"{p}_score", 6).alias(f"{p}_score") for p in PARTS), F.round("score", 6).alias("score"))


@query(f"""{CANDIDATES} SELECT doc_id, a_ord, b_ord, round(semantic, 6) AS semantic_score, round(entity_s, 6) AS entities_score, page_s AS page_score, section_s AS section_score, round(length_s, 6) AS length_score, round(layout_s, 6) AS layout_score,
  round(least(0.55 * semantic + 0.15 * entity_s + 0.10 * page_s + 0.10 * section_s + 0.05 * length_s + 0.05 * layout_s, 1.0), 6) AS score FROM parts""")
def q_candidates(spark, sf_dir):
    return _scored(spark, sf_dir)


@query()
def q_pair_blocks(spark, sf_dir):
    """Every stage of the pairing, over all turns; a source turn's translation is the text of the next target turn with every third word left out."""
    blocks = _blocks(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("ord")
    words = F.filter(F.split(F.lead("text").over(w), " "), lambda x, i: i % 3 != 2)
    said = blocks.withColumn("translation", F.array_join(words, " ")).where("language = 'zh' and translation is not null").select("doc_id", "block_id", "translation")
    return pair_blocks(blocks, said).withColumns({"semantic": F.round("semantic", 6), "score": F.round("score", 6)})


#: The same choice, a candidate at a time in the order of scores. Scores are whole thousandths, so that both engines rank alike.
ASSIGNED = f"""WITH RECURSIVE {TURNS}, c AS (SELECT a.doc_id, a.ord AS a_ord, b.ord AS b_ord, (1000 * least(length(a.text), length(b.text)) // greatest(length(a.text), length(b.text), 1))::INT AS score
  FROM turns a JOIN turns b ON a.doc_id = b.doc_id AND a.language = 'zh' AND b.language = 'en' AND abs(a.page - b.page) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, a_ord, b_ord) AS i FROM c),
f AS (SELECT doc_id, 0::BIGINT AS i, []::INT[] AS used, -1 AS a_ord, -1 AS b_ord, 0 AS score, false AS taken FROM (SELECT DISTINCT doc_id FROM r)
  UNION ALL SELECT r.doc_id, r.i, CASE WHEN list_contains(f.used, r.a_ord) OR list_contains(f.used, r.b_ord) THEN f.used ELSE list_concat(f.used, [r.a_ord, r.b_ord]) END, r.a_ord, r.b_ord, r.score,
    NOT (list_contains(f.used, r.a_ord) OR list_contains(f.used, r.b_ord)) FROM f JOIN r ON r.doc_id = f.doc_id AND r.i = f.i + 1)"""


def _assigned(spark, sf_dir):
    a, b = F.length("a.text"), F.length("b.text")
    score = F.floor(1000 * F.least(a, b) / F.greatest(a, b, F.lit(1))).cast("int")
    rows = P.candidates(*_sides(spark, sf_dir)).select("doc_id", F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), score.alias("score"))
    return P.assign(rows, ["doc_id"], "a_ord", "b_ord", "score")


@query(f"{ASSIGNED} SELECT doc_id, a_ord, b_ord, score FROM f WHERE taken")
def q_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir).select("doc_id", "a_ord", "b_ord", "score")


@query(f"""{ASSIGNED}, u AS (SELECT doc_id, a_ord AS ord FROM f WHERE taken UNION ALL SELECT doc_id, b_ord FROM f WHERE taken)
SELECT t.doc_id, t.ord, t.block_id, CASE t.language WHEN 'zh' THEN 'missing_english' WHEN 'en' THEN 'missing_chinese' ELSE 'unpaired' END AS pair_status, true AS needs_manual_review
FROM turns t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = t.doc_id AND u.ord = t.ord)""")
def q_leftovers(spark, sf_dir):
    taken = _assigned(spark, sf_dir)
    rows = _turns(spark, sf_dir).withColumns({"ignored": F.lit(False), "content_class": F.lit("bilingual_prose")})
    name = lambda c: F.concat(F.lit("t"), F.col("doc_id").cast("string"), F.lit("-"), F.col(c).cast("string")).alias("block_id")
    return P.leftovers(rows, taken.select(name("a_ord")).unionByName(taken.select(name("b_ord"))))


@query(f"""WITH {TURNS}, n AS (SELECT * FROM turns WHERE language <> 'unknown'),
l AS (SELECT *, lead(ord) OVER w AS b_ord, lead(language) OVER w AS b_language, lead(page) OVER w AS b_page FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord AS a_ord, b_ord, round(least(0.78 - CASE WHEN b_ord - ord > 1 THEN 0.14 ELSE 0 END + CASE WHEN page = b_page THEN 0.06 ELSE 0 END, 0.98), 2)::DOUBLE AS score, b_ord - ord > 1 AS skipped_neutral
FROM l WHERE language = 'zh' AND b_language = 'en' AND b_page - page <= 1""")
def q_next_row_pair(spark, sf_dir):
    return P.following(_turns(spark, sf_dir))


PARALLEL = [(1, 0, 1, "zh"), (1, 1, 1, "zh"), (1, 2, 1, "en"), (1, 3, 1, "en"), (1, 4, 1, "zh"), (1, 5, 1, "en"), (2, 0, 1, "zh"), (2, 1, 1, "zh"), (2, 2, 2, "en"), (2, 3, 2, "en")]


@query("SELECT * FROM " + values([(1, 0, 2), (1, 1, 3)], "doc_id, a_ord, b_ord"))
def q_parallel_runs(spark, sf_dir):
    return P.parallel_runs(spark.createDataFrame(PARALLEL, "doc_id int, ord int, page int, language string"))


@query(f"""WITH {TURNS}, g AS (SELECT *, CASE WHEN language IS DISTINCT FROM lag(language) OVER w OR page IS DISTINCT FROM lag(page) OVER w THEN 1 ELSE 0 END AS new FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM g), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY ord) AS i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM r)
SELECT a.doc_id, a.ord AS a_ord, b.ord AS b_ord FROM i a JOIN i b ON a.doc_id = b.doc_id AND b.run = a.run + 1 AND a.i = b.i AND a.n = b.n AND a.page = b.page AND a.language = 'zh' AND b.language = 'en' AND a.n BETWEEN 2 AND 8""")
def q_parallel_turns(spark, sf_dir):
    return P.parallel_runs(_turns(spark, sf_dir))


@query(f"""WITH {TURNS}, m AS (SELECT a.block_id AS target_id, b.block_id, row_number() OVER (PARTITION BY a.block_id ORDER BY b.ord) AS n
  FROM turns a JOIN turns b ON a.doc_id = b.doc_id AND a.language = 'zh' AND abs(a.page - b.page) <= 1 AND a.block_id <> b.block_id)
SELECT target_id, n::INT AS n, block_id FROM m WHERE n <= 8""")
def q_context_topk(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    return P.nearby(rows, rows.where("language = 'zh'"))


UNITS = [
    ("文件控制 | Control of Documents", "bilingual_prose", ["文件控制"], ["Control of Documents"]),
    ("A | 2020-01-02 | 新增 | Added text", "change_history", ["新增"], ["Added text"]),
    ("Scope | 范围 | 目的", "bilingual_prose", ["范围"], ["Scope"]),
    ("目的Purpose", "bilingual_prose", ["目的"], ["Purpose"]),
    ("only english", "bilingual_prose", [], []),
]


@query("SELECT text, content_class, chinese::VARCHAR[] AS chinese, english::VARCHAR[] AS english FROM " + values(UNITS, "text, content_class, chinese, english"))
def q_alignment_units(spark, sf_dir):
    rows = spark.createDataFrame([u[:2] for u in UNITS], "text string, content_class string").withColumn("u", P.alignment_units(F.col("text"), F.col("content_class")))
    return rows.select("text", "content_class", F.col("u.chinese").alias("chinese"), F.col("u.english").alias("english"))


SHINGLE = 8


def _windows(df, key, text):
    """(key, g): hashes of windows of words; a shorter text is one window."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = df.select(key, words.alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, SHINGLE), " ")))
    return rows.select(key, F.explode(F.array_distinct(grams)).alias("g"))


def _benchmark_pairs(spark, sf_dir):
    """(doc_id, item_id) that share a window of words; the benchmark is the small side, by windows."""
    docs, items = B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "benchmark")
    return _windows(docs, "doc_id", "text").join(_windows(items, "item_id", "text"), "g").select("doc_id", "item_id").distinct()


@query("SELECT d.doc_id, b.item_id, (strpos(d.text, b.text))::INT AS found_at FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def q_benchmark_contain(spark, sf_dir):
    docs, items = B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "benchmark").withColumnRenamed("text", "passage")
    rows = _benchmark_pairs(spark, sf_dir).join(items, "item_id").join(docs.select("doc_id", "text"), "doc_id")
    return rows.where(F.contains("text", "passage")).select("doc_id", "item_id", F.expr("locate(passage, text)").alias("found_at"))


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1)) u(i)),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS g FROM v, unnest(range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1)) u(i)),
p AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)),
t AS (SELECT p.doc_id, p.item_id, {_TOKENS.format("b.text")} AS a, {_TOKENS.format("d.text")} AS b FROM p JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id))
SELECT doc_id, item_id, round(coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))), 0)::DOUBLE / greatest(len(a), 1), 6) AS recall FROM t""")
def q_token_recall(spark, sf_dir):
    docs, items = B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "benchmark").withColumnRenamed("text", "passage")
    rows = _benchmark_pairs(spark, sf_dir).join(items, "item_id").join(docs.select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "item_id", F.round(S.token_recall("passage", "text"), 6).alias("recall"))


@query()
def q_fuzzy_best(spark, sf_dir):
    docs, items = B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "benchmark").withColumnRenamed("text", "passage")
    lines = B.lines(docs).select("doc_id", "pos", "line").where("length(line) > 30").withColumn("line_id", F.xxhash64("doc_id", "pos"))
    shared = _windows(lines, "line_id", "line").join(_windows(items, "item_id", "passage"), "g").select("line_id", "item_id").distinct()
    # What shares a window gives a score that the best is not below; every line is then held against every item.
    met = shared.join(lines, "line_id").join(items, "item_id").withColumn("score", S.token_set_udf()(F.lower("passage"), F.lower("line")))
    floors = {r["item_id"]: r["score"] for r in met.groupBy("item_id").agg(F.max("score").alias("score")).collect()}
    bounded = [(r["item_id"], r["passage"]) for r in items.select("item_id", F.coalesce(F.lower("passage"), F.lit("")).alias("passage")).collect()]
    scored = P.best_lines(lines.withColumn("line", F.lower("line")).repartition(2 * spark.sparkContext.defaultParallelism), bounded, floors)
    best = scored.groupBy("item_id").agg(F.max_by(F.struct("doc_id", "pos", "score"), F.struct("score", -F.col("doc_id"), -F.col("pos"))).alias("b"))
    return best.select("item_id", "b.doc_id", "b.pos", "b.score", (F.col("b.score") < 82).alias("mismatch"))


SCORES = [("a b b c", "b b d", 0.5), ("the same", "the same", 1.0), ("", "x", 0.0)]


@query("SELECT * FROM " + values(SCORES, "a, b, recall"))
def q_recall_rules(spark, sf_dir):
    return spark.createDataFrame([s[:2] for s in SCORES], "a string, b string").select("a", "b", S.token_recall("a", "b").alias("recall"))


RATIOS = [("control of documents", "control of documents"), ("control of documents", "documents control"), ("abcd", "abxd"), ("", "x")]


@query("SELECT * FROM " + values([(*RATIOS[0], 100.0, 100.0, 1.0), (*RATIOS[1], 48.648649, 100.0, 0.486486), (*RATIOS[2], 75.0, 75.0, 0.75), (*RATIOS[3], 0.0, 0.0, 0.0)], "a, b, ratio, token_set, sequence"))
def q_ratio_rules(spark, sf_dir):
    rows = spark.createDataFrame(RATIOS, "a string, b string")
    return rows.select("a", "b", F.round(S.ratio_udf()("a", "b"), 6).alias("ratio"), F.round(S.token_set_udf()("a", "b"), 6).alias("token_set"), F.round(S.sequence_udf()("a", "b"), 6).alias("sequence"))


STRUCT = "struct<page:int,ord:int,section:string,table_id:string,row_index:int,col_index:int,y0:double,y1:double>"


@query("SELECT * FROM " + values([("near", 0.7, 0.726), ("row", 1.0, 0.78), ("far", 0.08, None)], "name, structural, candidate"))
def q_structural_rules(spark, sf_dir):
    block = lambda page, ord_, section, tid=None, row=None, cc=None: (page, ord_, section, tid, row, cc, None, None)
    rows = [("near", block(1, 1, "4.2"), block(1, 2, "4.2")), ("row", block(1, 1, "4.2", "t", 0, 0), block(1, 2, "4.2", "t", 0, 1)), ("far", block(1, 1, "4.2"), block(2, 9, "5"))]
    df = spark.createDataFrame(rows, f"name string, a {STRUCT}, b {STRUCT}").withColumn("structural", S.structural_score(F.col("a"), F.col("b")))
    return df.select("name", F.round("structural", 6).alias("structural"), F.round(S.structural_candidate(F.col("structural")), 6).alias("candidate"))


@query("SELECT * FROM " + values([("策划", "en", 0.5), ("QSP0401", "QSP0401 x", 1.0), ("QSP0401", "QSP0402", 0.0)], "source, target, score"))
def q_entity_rules(spark, sf_dir):
    rows = spark.createDataFrame([("策划", "en"), ("QSP0401", "QSP0401 x"), ("QSP0401", "QSP0402")], "source string, target string")
    lone = F.when(F.col("target") == "en", F.lit("")).when(F.col("target").endswith(" x"), F.lit("QSP0401")).otherwise(F.col("target"))
    return rows.select("source", "target", S.entity_score("source", F.lit(""), lone).alias("score"))


