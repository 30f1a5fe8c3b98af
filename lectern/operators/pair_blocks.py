"""The pairing of a document's blocks: within a block, run by run, block by block, and what is left.

Each stage takes the blocks that the ones before it left. All windows are over one
document; candidates are joined on document and page.

Blocks: doc_id, ord (reading order), block_id, page, section, text, language,
content_class, block_type, ignored, revision_id, effective_date, table_id, row_index,
col_index, y0, y1. Blocks of null or empty text are passed over; a null section is
the empty one. Translations: doc_id, block_id, translation; a block without one has
the empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.text import HAN, clean_alignment, clean_chinese, clean_english, count_of, stable_id
from . import pairing as P
from .classify import heading_translation
from .storage import stored

OUT = ["doc_id", "pair_id", "page", "first_ord", "chinese_block_id", "english_block_id", "chinese_text", "english_text", "translated", "semantic", "score", "status", "method", "should_check", "source_block_ids"]
#: Source characters and target words of the two sides of paired runs at least, and rows between members and between runs at most.
LONG_SIDE, MEMBER_GAP, RUN_GAP = 20, 4, 6


def status_of(score: Column, confirmed: float) -> Column:
    return F.when(score >= confirmed, "confirmed").otherwise("uncertain")


def within_blocks(blocks: DataFrame, confirmed: float = P.CONFIRMED) -> DataFrame:
    """Pairs of the units of blocks that hold both languages."""
    mixed = blocks.where(~F.col("ignored") & ~F.col("content_class").isin(*P.UNPAIRED_CLASSES) & (count_of("text", HAN) > 0) & F.col("text").rlike("[A-Za-z]"))
    listed = mixed.withColumn("units", P.alignment_units(F.col("text"), F.col("content_class")))
    rows = listed.select("*", F.size("units").alias("n_units"), F.posexplode("units").alias("unit", "u"))
    dated = lambda c: F.when(F.coalesce(F.col("effective_date"), F.lit("")) != "", F.replace(c, F.col("effective_date"), F.lit(" "))).otherwise(c)
    rows = rows.withColumns({"chinese": clean_chinese(dated(F.col("u.chinese"))), "english": clean_english(dated(F.col("u.english"))), "part": P.translation_of_unit(F.col("translation"), F.col("n_units"), F.col("unit"))}).where("chinese <> '' and english <> ''")
    rows = rows.withColumn("glossary", F.coalesce(heading_translation("chinese"), F.lit("")))
    listed_reference = F.col("content_class").isin("reference_table", "regulatory_references")
    heading = (F.col("block_type") == "heading") & (F.col("glossary") != "")
    reading = F.when(heading, F.col("glossary")).when(F.col("part") != "", F.col("part")).otherwise(F.col("glossary"))
    rows = rows.withColumn("reading", reading).withColumn("likeness", S.semantic_similarity("reading", "english", S.token_set_udf(), S.sequence_udf()))
    semantic = F.when(listed_reference, 1.0).otherwise(F.col("likeness"))
    score = F.when(listed_reference, 1.0).when(heading, F.greatest(F.lit(0.90), F.col("likeness"))).when(F.col("reading") != "", F.greatest(F.lit(0.84), F.col("likeness"))).otherwise(0.74)
    method = F.when(listed_reference, "table_row").when(heading, "heading_glossary").when(F.coalesce(F.col("table_id"), F.lit("")) != "", "table_row").otherwise("translated_chinese_similarity")
    usable = ~listed_reference & ~heading & (F.col("reading") != "") & P.eligible() & ~P.reference_mapping(F.col("chinese"), F.col("english")) & ~P.short_label(F.col("chinese"), F.col("english"))
    rows = rows.withColumns({"semantic": semantic, "score": score, "method": method}).withColumn("status", status_of(F.col("score"), confirmed))
    return rows.select(
        "doc_id", F.concat(stable_id("pair", "block_id"), F.lit("_"), F.lpad(F.col("unit").cast("string"), 3, "0")).alias("pair_id"), "page", F.col("ord").alias("first_ord"),
        F.col("block_id").alias("chinese_block_id"), F.col("block_id").alias("english_block_id"), F.col("chinese").alias("chinese_text"), F.col("english").alias("english_text"),
        clean_english(F.when(F.col("part") != "", F.col("part")).otherwise(F.col("glossary"))).alias("translated"), "semantic", "score", "status", "method",
        (usable & (F.col("status") == "confirmed")).alias("should_check"), F.array("block_id").alias("source_block_ids"),
    )


def paragraph_runs(blocks: DataFrame) -> DataFrame:
    """Blocks that may be checked, each with the number of its run: neighbours of one language that read as one paragraph."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    same = F.lit(True)
    for name in ("language", "page", "section", "content_class", "revision_id", "block_type"):
        same = same & F.col(name).eqNullSafe(F.lag(name).over(w))
    tables = F.coalesce((F.col("table_id") == F.lag("table_id").over(w)) | (F.col("table_id") == "") | (F.lag("table_id").over(w) == ""), F.lit(True))
    goes_on = same & tables & (F.col("block_type") != "heading") & (F.col("ord") - F.lag("ord").over(w) <= MEMBER_GAP)
    rows = blocks.where(F.col("language").isin("zh", "en") & P.eligible())
    return rows.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w)).drop("new")


def run_blocks(runs: DataFrame) -> DataFrame:
    """One block a run: the first one's fields, the texts and translations in order, the common box."""
    held = F.sort_array(F.collect_list(F.struct("ord", "block_id", "text", "translation")))
    first = lambda c: F.min_by(c, "ord").alias(c)
    rows = runs.groupBy("doc_id", "run").agg(held.alias("held"), *(first(c) for c in ("page", "section", "language", "content_class", "block_type", "revision_id", "table_id", "row_index")), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("ord").alias("ord"), F.max("ord").alias("last_ord"))
    text = clean_alignment(F.array_join(F.transform("held", lambda x: x["text"]), " "))
    translation = clean_alignment(F.array_join(F.transform("held", lambda x: x["translation"]), " "))
    return rows.select("*", text.alias("text"), translation.alias("translation"), F.transform("held", lambda x: x["block_id"]).alias("block_ids"), F.size("held").alias("members")).drop("held")


def between_runs(blocks: DataFrame, confirmed: float = P.CONFIRMED, uncertain: float = P.UNCERTAIN) -> DataFrame:
    """Pairs of neighbouring runs of the two languages, best score first."""
    merged = run_blocks(paragraph_runs(blocks))
    w = Window.partitionBy("doc_id").orderBy("run")
    fields = [c for c in merged.columns if c != "doc_id"]
    pairs = merged.select("doc_id", F.struct(*fields).alias("l"), F.lead(F.struct(*fields)).over(w).alias("r")).where("r is not null")
    near = (F.col("l.language") != F.col("r.language")) & ((F.col("l.members") > 1) | (F.col("r.members") > 1)) & (F.col("l.page") == F.col("r.page")) & (F.col("l.section") == F.col("r.section"))
    near = near & (F.col("r.ord") - F.col("l.last_ord") <= RUN_GAP) & (F.col("l.content_class") == F.col("r.content_class")) & F.col("l.revision_id").eqNullSafe(F.col("r.revision_id"))
    # As the rule has it, the left run counts source characters and the right one target words, whichever language each is in.
    long = (count_of(F.col("l.text"), HAN) >= LONG_SIDE) & (F.regexp_count("r.text", F.lit("[A-Za-z]+")) >= LONG_SIDE)
    zh_left = F.col("l.language") == "zh"
    sided = pairs.where(near & long).select("doc_id", F.when(zh_left, F.col("l")).otherwise(F.col("r")).alias("z"), F.when(zh_left, F.col("r")).otherwise(F.col("l")).alias("e")).where("z.translation <> ''")
    left = P.prepared(sided.select("doc_id", "z.*"), "translation", True)
    right = P.prepared(sided.select("doc_id", "e.*"), "text", False)
    both = sided.select("doc_id", F.col("z.run").alias("z_run"), F.col("e.run").alias("e_run"))
    both = both.join(left.select("doc_id", F.col("run").alias("z_run"), F.struct(*left.columns).alias("a")).dropDuplicates(["doc_id", "z_run"]), ["doc_id", "z_run"])
    both = both.join(right.select("doc_id", F.col("run").alias("e_run"), F.struct(*right.columns).alias("b")).dropDuplicates(["doc_id", "e_run"]), ["doc_id", "e_run"])
    bonus = F.when(F.col("b.ord") > F.col("a.last_ord"), 0.15).otherwise(0.08)
    rows = P.scored(both).withColumn("score", F.least(F.lit(1.0), F.col("score") + bonus)).where(F.col("score") >= uncertain)
    rows = P.assign(stored(rows), ["doc_id"], "z_run", "e_run", "score").withColumn("status", status_of(F.col("score"), confirmed))
    ids = F.concat("a.block_ids", "b.block_ids")
    return rows.select(
        "doc_id", F.concat(F.lit("pair_group_"), F.substring(F.sha2(F.array_join(ids, "\u001f"), 256), 1, 12)).alias("pair_id"), F.least("a.page", "b.page").alias("page"), F.least("a.ord", "b.ord").alias("first_ord"),
        F.col("a.block_ids")[0].alias("chinese_block_id"), F.col("b.block_ids")[0].alias("english_block_id"), clean_chinese(F.col("a.text")).alias("chinese_text"), clean_english(F.col("b.text")).alias("english_text"),
        clean_english(F.col("a.translation")).alias("translated"), F.col("semantic_score").alias("semantic"), "score", "status", F.lit("consecutive_paragraph_group").alias("method"),
        ((F.col("status") == "confirmed") & ~P.reference_mapping(F.col("a.text"), F.col("b.text"))).alias("should_check"), ids.alias("source_block_ids"),
    )


def between_blocks(blocks: DataFrame, confirmed: float = P.CONFIRMED, uncertain: float = P.UNCERTAIN) -> DataFrame:
    """One-to-one pairs of blocks of the two languages at most two pages apart, by translation, heading glossary or layout."""
    rows = blocks.withColumn("glossary", F.coalesce(heading_translation("text"), F.lit("")))
    rows = rows.withColumn("machine", F.when(F.col("translation") != "", F.col("translation")).otherwise(F.col("glossary")))
    zh = P.prepared(rows.where("language = 'zh'"), "machine", True)
    en = P.prepared(rows.where("language = 'en'"), clean_english("text"), False)
    pairs = P.candidates(zh, en).where(P.allowed(F.col("a"), F.col("b")))
    marked = P.scored(pairs)
    known = F.col("a.machine") != ""
    likely = F.when(known, F.col("score")).otherwise(0.0)
    layout = S.structural_candidate(S.structural_score(F.col("a"), F.col("b")), confirmed, uncertain)
    by_layout = layout.isNotNull() & (likely < uncertain)
    heading = known & (F.col("a.block_type") == "heading") & (F.col("a.glossary") != "")
    # A heading without a translation is scored by the glossary already.
    alike = F.when(F.col("a.translation") == "", F.col("semantic_score")).otherwise(S.semantic_similarity(F.col("a.glossary"), F.col("b.reading"), S.token_set_udf(), S.sequence_udf()))
    marked = marked.withColumns({"alike": F.when(heading, alike), "likely": F.when(by_layout, layout).otherwise(likely), "by_layout": by_layout, "semantic": F.when(known, F.col("semantic_score")).otherwise(0.0)})
    score = F.when(F.col("alike").isNotNull(), F.greatest("likely", 0.88 * F.col("alike") + 0.12)).otherwise(F.col("likely"))
    method = F.when(F.col("alike").isNotNull(), "heading_glossary").when(F.col("by_layout"), "layout_adjacency_candidate").otherwise("translated_chinese_similarity")
    ranked = marked.select("doc_id", F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), "a", "b", F.greatest("semantic", F.coalesce("alike", F.lit(0.0))).alias("semantic"), method.alias("method"), score.alias("score")).where(F.col("score") >= uncertain)
    taken = P.assign(stored(ranked), ["doc_id"], "a_ord", "b_ord", "score").withColumn("status", status_of(F.col("score"), confirmed))
    a, b = F.col("a.text"), F.col("b.text")
    usable = (F.col("status") == "confirmed") & (F.col("a.block_type") != "heading") & P.eligible(F.col("a")) & P.eligible(F.col("b")) & ~P.short_label(a, b) & ~P.reference_mapping(a, b)
    return taken.select(
        "doc_id", stable_id("pair", "a.block_id", "b.block_id").alias("pair_id"), F.least("a.page", "b.page").alias("page"), F.least("a_ord", "b_ord").alias("first_ord"), F.col("a.block_id").alias("chinese_block_id"),
        F.col("b.block_id").alias("english_block_id"), clean_chinese(a).alias("chinese_text"), clean_english(b).alias("english_text"), clean_alignment(F.col("a.machine")).alias("translated"), "semantic", "score", "status", "method",
        usable.alias("should_check"), F.array("a.block_id", "b.block_id").alias("source_block_ids"),
    )


def left_over(blocks: DataFrame) -> DataFrame:
    """Blocks that found no pair, as pairs of one side."""
    alone = (F.col("language") == "en") & F.col("content_class").isin(*P.SINGLE_CLASSES)
    status = F.when(F.col("language") == "zh", "missing_english").when((F.col("language") == "en") & ~alone, "missing_chinese").otherwise("unpaired")
    zh, en = F.when(F.col("language") == "zh", clean_chinese("text")).otherwise(""), F.when((F.col("language") == "en") & ~alone, clean_english("text")).otherwise("")
    rows = blocks.withColumns({"status": status, "chinese_text": zh, "english_text": en})
    own = lambda c: F.when(F.col(c) != "", F.col("block_id"))
    return rows.select(
        "doc_id", stable_id("pair", "block_id", "status").alias("pair_id"), "page", F.col("ord").alias("first_ord"), own("chinese_text").alias("chinese_block_id"), own("english_text").alias("english_block_id"), "chinese_text", "english_text",
        clean_english("translation").alias("translated"), F.lit(0.0).alias("semantic"), F.lit(0.0).alias("score"), "status", F.lit("translated_chinese_similarity").alias("method"), F.lit(False).alias("should_check"), F.array("block_id").alias("source_block_ids"),
    )


def unused(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    used = pairs.select("doc_id", F.explode("source_block_ids").alias("block_id")).distinct()
    return blocks.join(used, ["doc_id", "block_id"], "left_anti")


def pair_blocks(blocks: DataFrame, translations: DataFrame, confirmed: float = P.CONFIRMED, uncertain: float = P.UNCERTAIN) -> DataFrame:
    """All pairs of all documents (OUT, position): position is the pair's place in its document, by page, first block and id."""
    active = blocks.where("text <> ''").withColumn("section", F.coalesce("section", F.lit("")))
    said = translations.select("doc_id", "block_id", "translation")
    active = stored(active.join(said, ["doc_id", "block_id"], "left").withColumn("translation", F.coalesce("translation", F.lit(""))))
    done = stored(within_blocks(active, confirmed))
    rest = stored(unused(active, done))
    for stage in (between_runs, between_blocks):
        found = stored(stage(rest, confirmed, uncertain))
        done, rest = done.unionByName(found), stored(unused(rest, found))
    every = done.unionByName(left_over(rest)).select(*OUT)
    return every.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "first_ord", "pair_id")))
