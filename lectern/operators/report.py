"""What a review reports: work lists, counts, statuses of blocks, issue rows and their de-duplication, section coverage.

Frames: pairs (pair_id, status, method, block_type, chinese_text, chinese_ids, english_ids), observations
(severity), issues (position, ...). Nulls count as empty text; an empty frame gives zero counts or no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HAN, col, count_of, normalize_text, padded_parts, section_at_or_after

#: Severities in their order; block types that are not counted as content.
SEVERITIES = ["Critical", "Major", "Minor", "Observation"]
FURNITURE_TYPES = ["header", "footer", "reference_table"]


def page_range(blocks: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Blocks of the pages start..end; an end before the start, or a range without blocks, is an error."""
    if start is not None and end is not None and end < start:
        raise ValueError("the last page lies before the first")
    rows = blocks.where(F.col("page") >= start) if start is not None else blocks
    rows = rows.where(F.col("page") <= end) if end is not None else rows
    if rows.isEmpty():
        raise ValueError("no blocks in the page range")
    return rows


def to_translate(blocks: DataFrame) -> DataFrame:
    """Blocks with Han characters that are not ignored."""
    return blocks.where(~F.col("ignored") & (count_of("text", HAN) > 0))


def with_translations(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Blocks with their translation, empty where there is none."""
    return blocks.join(translations.select("block_id", "translation"), "block_id", "left").withColumn("translation", F.coalesce("translation", F.lit("")))


def usable_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that coverage counts: a source text, a pair status, and no furniture."""
    return pairs.where((F.coalesce("chinese_text", F.lit("")) != "") & F.col("status").isin("confirmed", "uncertain") & ~F.col("block_type").isin(*FURNITURE_TYPES))


def selected(detected: DataFrame, name: str) -> DataFrame:
    """The detected regulation of a name; an unknown name is an error."""
    rows = detected.where(F.col("name") == name)
    if rows.isEmpty():
        raise ValueError(f"not detected: {name}")
    return rows


def report_counts(blocks: DataFrame, pairs: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: blocks, confirmed pairs, all other pairs, observations, and observations of each severity."""
    tagged = lambda rows, kind, c: rows.select(F.lit(kind).alias("kind"), c.alias("value"))
    rows = tagged(blocks, "block", F.lit("")).unionByName(tagged(pairs, "pair", F.col("status"))).unionByName(tagged(observations, "observation", F.col("severity")))
    n = lambda kind, c=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if c is None else c))
    sure = F.col("value").eqNullSafe("confirmed")
    return rows.agg(
        n("block").alias("blocks"), n("pair", sure).alias("confirmed"), n("pair", ~sure).alias("not_confirmed"), n("observation").alias("observations"),
        *(n("observation", F.col("value") == s).alias(s.lower()) for s in SEVERITIES),
    )


def pair_counts(pairs: DataFrame, by: str) -> DataFrame:
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("pairs"))


def block_statuses(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(block_id, status, pair_id) of every block: furniture, its pair's status (of several pairs the last), or unpaired."""
    live = pairs.where(F.col("status").isin("paired", "uncertain"))
    taken = live.select("pair_id", "status", F.explode(F.concat("chinese_ids", "english_ids")).alias("block_id"))
    last = taken.groupBy("block_id").agg(F.max_by(F.struct("pair_id", "status"), "pair_id").alias("p"))
    rows = blocks.join(last, "block_id", "left")
    furniture = F.col("block_type") == "header_footer"
    return rows.select("block_id", F.when(furniture, "header_footer").otherwise(F.coalesce("p.status", F.lit("unpaired"))).alias("status"), F.when(~furniture, F.col("p.pair_id")).alias("pair_id"))


def unique_issues(issues: DataFrame) -> DataFrame:
    """Of issues with one location, the first 80 characters of one source text and one type, the first."""
    key = [normalize_text("location"), F.substring(normalize_text("source_text"), 1, 80), normalize_text("issue_type")]
    return issues.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("position"))).where("__n = 1").drop("__n")


def unique_findings(findings: DataFrame) -> DataFrame:
    """Of findings with one id the last, at the place of the first."""
    w = Window.partitionBy("finding_id")
    rows = findings.withColumns({"first_position": F.min("position").over(w), "__n": F.row_number().over(w.orderBy(F.col("position").desc()))})
    return rows.where("__n = 1").drop("__n", "position").withColumnRenamed("first_position", "position")


def reported_rows(rows: DataFrame) -> DataFrame:
    """Reviewed rows that are issues: not fine, and of some severity."""
    return rows.where((F.lower("status") != "ok") & (F.lower("severity") != "none"))


def section_issues(issues: DataFrame, pairs: DataFrame) -> DataFrame:
    """Issues of a section's review with the location and texts of their pair; those of unknown pairs or without a severity go."""
    real = issues.where(F.lower(F.coalesce("severity", F.lit("None"))) != "none")
    return real.join(pairs.select("pair_id", "location", "chinese_text", "english_text"), "pair_id")


def section_coverage(packages: DataFrame, results: DataFrame) -> DataFrame:
    """Packages (document, section_id, blocks) with what their result says; those without one are not processed."""
    rows = packages.join(results.withColumn("__known", F.lit(True)), ["document", "section_id"], "left")
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("document", "section_id", "blocks", F.when(F.col("__known"), "Yes").otherwise("No").alias("processed"), number("pairs"), number("issues"), F.coalesce("status", F.lit("Not processed")).alias("status"))


def usage(calls: DataFrame) -> DataFrame:
    """One row: tokens in, tokens out, requests; missing counts are none."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long")
    return calls.agg(total("prompt_tokens").alias("input_tokens"), total("completion_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("requests"))


def chosen_translation(uses: DataFrame, by: str, translation: str) -> DataFrame:
    """The translation that a term has most often, the smallest of several; compared without marks and case."""
    key = F.trim(F.regexp_replace(F.lower(col(translation)), "[^a-z0-9]+", " "))
    counted = uses.groupBy(by, key.alias("term_key")).agg(F.count(F.lit(1)).alias("uses"))
    best = F.min(F.struct((-F.col("uses")).alias("n"), "term_key")).alias("best")
    return counted.groupBy(by).agg(best, F.count(F.lit(1)).alias("variants")).select(by, F.col("best.term_key").alias("recommended"), (-F.col("best.n")).alias("uses"), "variants")


def section_packages(blocks: DataFrame, start: str = "2.0", tables: bool = True) -> DataFrame:
    """(document, section, place, title, page_start, page_end, block_ids) of sections from ``start`` on, placed by their numbers within a document."""
    rows = blocks.where((F.coalesce("section", F.lit("")) != "") & section_at_or_after("section", F.lit(start)))
    if not tables:
        rows = rows.where("table_index is null")
    held = F.sort_array(F.collect_list(F.struct("ord", "block_id")))
    title = F.min_by(F.when(F.col("title") != "", F.col("title")), F.when(F.col("title") != "", F.col("ord")))
    made = rows.groupBy("document", "section").agg(F.coalesce(title, F.lit("")).alias("title"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.transform(held, lambda x: x["block_id"]).alias("block_ids"))
    order = [F.coalesce(padded_parts("section"), F.array_repeat(F.lit(9999), 6)), "section"]
    return made.withColumn("place", F.row_number().over(Window.partitionBy("document").orderBy(*order)))


#: Scores of the words for confidence.
CONFIDENCE = {"High": 0.9, "Medium": 0.65, "Low": 0.35}


def answered_pairs(results: DataFrame, blocks: DataFrame) -> DataFrame:
    """(pair_id, document, section, score, page, chinese_ids, english_ids) of the pairs in usable section results (document, section, position, status, page_start, pairs).

    A pair without an id gets one of its place; an id met before is told apart by document and section. The page is that of the first known block, else the section's first.
    """
    item = results.where(F.col("status").isin("OK", "Needs review")).select("document", "section", "position", "page_start", F.posexplode("pairs").alias("i", "p"))
    made = F.concat_ws(":", "document", "section", F.lit("pair"), (F.col("i") + 1).cast("string"))
    rows = item.withColumn("own_id", F.when(F.coalesce(F.col("p.pair_id"), F.lit("")) != "", F.col("p.pair_id")).otherwise(made))
    again = F.row_number().over(Window.partitionBy("own_id").orderBy("position", "i")) > 1
    rows = rows.withColumn("pair_id", F.when(again, F.concat_ws(":", "document", "section", "own_id")).otherwise(F.col("own_id")))
    score = F.lit(CONFIDENCE["Medium"])
    for word, value in CONFIDENCE.items():
        score = F.when(F.col("p.confidence") == word, value).otherwise(score)
    ids = rows.select("pair_id", F.posexplode(F.concat("p.chinese_ids", "p.english_ids")).alias("n", "block_id"))
    page = ids.join(blocks.select("block_id", "page"), "block_id").groupBy("pair_id").agg(F.min_by("page", "n").alias("page"))
    return rows.join(page, "pair_id", "left").select("pair_id", "document", "section", score.alias("score"), F.coalesce("page", "page_start").alias("page"), F.col("p.chinese_ids").alias("chinese_ids"), F.col("p.english_ids").alias("english_ids"))
