"""Coverage: status of blocks, pages and sections, and the topic matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze

STATUSES = ["paired", "unpaired", "uncertain", "missing_english", "missing_chinese", "standalone", "header_footer"]
OPEN = ["unpaired", "uncertain", "missing_english", "missing_chinese"]
MATCHES = 8


def block_status(blocks: DataFrame, statuses: DataFrame, key: list[str]) -> DataFrame:
    """Blocks with status and pair_id; furniture has its own status, and blocks without one are unpaired."""
    joined = blocks.join(statuses, key, "left")
    furniture = F.col("block_type") == "header_footer"
    return joined.withColumns({"status": F.when(furniture, "header_footer").otherwise(F.coalesce("status", F.lit("unpaired"))), "pair_id": F.when(~furniture, F.col("pair_id"))})


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def page_coverage(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, page, blocks, pairs, open, state)."""
    out = rows.groupBy(by, "page").agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("pair_id").alias("pairs"), F.count_if(F.col("status").isin(*OPEN)).alias("open"))
    state = F.when((F.col("open") > 0) & (F.col("pairs") > 0), "Partial coverage").when(F.col("open") > 0, "Unpaired content").otherwise("Covered")
    return out.withColumn("state", state)


def section_coverage(rows: DataFrame, section: str = "section") -> DataFrame:
    """(section, blocks, zh, en, pairs, open_zh, open_en, page_start, page_end, state); furniture is left out."""
    kept = rows.where("block_type <> 'header_footer'").withColumn("section_id", F.coalesce(section, F.lit("front_matter")))
    side = lambda s: F.count_if(F.col("language") == s)
    open_ = lambda s: F.count_if((F.col("language") == s) & (F.col("status") != "paired"))
    out = kept.groupBy("section_id").agg(
        F.count(F.lit(1)).alias("blocks"), side("zh").alias("zh"), side("en").alias("en"), F.count_distinct("pair_id").alias("pairs"),
        open_("zh").alias("open_zh"), open_("en").alias("open_en"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
    )
    left = F.col("open_zh") + F.col("open_en") > 0
    state = F.when((F.col("pairs") > 0) & ~left, "Covered").when(F.col("pairs") > 0, "Partial coverage").when(F.col("zh") + F.col("en") > 0, "Unpaired content").otherwise("No bilingual main content")
    return out.withColumn("state", state)


def topic_score(section: Column, text: Column, clause: Column, keywords: Column) -> Column:
    """5 for a section that is the clause or below it, 2 for each keyword in the text, which is squeezed and in lower case."""
    at = F.when((section == clause) | section.startswith(F.concat(clause, F.lit("."))), 5).otherwise(0)
    return F.coalesce(at, F.lit(0)) + F.aggregate(keywords, F.lit(0), lambda s, k: s + F.when(text.contains(F.lower(k)), 2).otherwise(0))


def topic_rows(spark: SparkSession, topics) -> DataFrame:
    return spark.createDataFrame([(c, t, list(k)) for c, t, k in topics], "clause string, title string, keywords array<string>")


def topic_matches(rows: DataFrame, topics, most: int = MATCHES) -> DataFrame:
    """(clause, doc_id, ord, page, section, score, n): the best rows of each topic.

    The topics are a few rows, which every row scores in place as one array; only matches are exploded, and each
    group of rows hands on its best ``most``, so a common topic never gathers in one task.
    """
    listed = F.array(*(F.struct(F.lit(c).alias("clause"), F.array(*map(F.lit, k)).alias("keywords")) for c, _, k in topics))
    scores = lambda hay: F.transform(listed, lambda t: F.struct(t["clause"].alias("clause"), topic_score(F.col("section"), hay, t["clause"], t["keywords"]).alias("score")))
    met = F.transform(F.array(F.lower(squeeze("text"))), lambda hay: F.filter(scores(hay), lambda x: x["score"] > 0))[0]
    scored = rows.select(
        "doc_id", "ord", "page", "section", F.explode(met).alias("m"),
    ).select("doc_id", "ord", "page", "section", "m.*")
    order = [F.col("score").desc(), "page", F.coalesce("section", F.lit("")), "doc_id", "ord"]
    near = Window.partitionBy("clause", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    first = scored.withColumn("k", F.row_number().over(near)).where(F.col("k") <= most).drop("k")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("clause").orderBy(*order))).where(F.col("n") <= most)


def topic_matrix(matches: DataFrame, topics: DataFrame, findings: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """(clause, matches, pages, sections, decision, severity): every topic keeps a row."""
    rolled = matches.groupBy("clause").agg(F.count(F.lit(1)).alias("matches"), F.concat_ws(",", F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string"))).alias("pages"), F.concat_ws(",", F.array_sort(F.collect_set("section"))).alias("sections"))
    out = topics.select("clause", "title").join(rolled, "clause", "left")
    if findings is not None:
        rank = F.when(F.col("severity") == "Critical", 4).when(F.col("severity") == "Major", 3).when(F.col("severity") == "Minor", 2).otherwise(1)
        worst = findings.withColumn("clause", F.split("clause", " ")[0]).groupBy("clause").agg(F.max_by("severity", rank).alias("worst"), F.bool_or(F.lower("issue").contains("conflict")).alias("conflict"))
        out = out.join(worst, "clause", "left")
    else:
        out = out.withColumns({"worst": F.lit(None).cast("string"), "conflict": F.lit(None).cast("boolean")})
    absent = "evidence_not_found" if complete else "needs_human_confirmation"
    decision = F.when(F.col("conflict"), "conflict_found").when(F.col("worst").isNotNull(), "needs_human_confirmation").when(F.col("matches").isNull(), absent).otherwise("evidence_candidate_found")
    return out.select("clause", "title", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("pages", F.lit("")).alias("pages"), F.coalesce("sections", F.lit("")).alias("sections"), decision.alias("decision"), F.coalesce("worst", F.when(F.col("matches").isNull(), "Observation"), F.lit("None")).alias("severity"))
