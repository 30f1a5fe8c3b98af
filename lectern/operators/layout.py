"""Ordered operators: runs, carried values, furniture, near duplicates, gated sections, packing.

All name their order column. Windows are partitioned by document, and folds run
over one document's rows, which is what bounds them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import indel_ratio
from ..functions.text import extract_section, furniture_key, heading_key, language_of, normalize_text, section_parts, stable_id

#: Rows kept in view, and the ratio, of the near-duplicate pass.
VIEW, ALIKE = 30, 96.0
#: Characters that a block costs besides its text when chunks are packed.
OVERHEAD = 80


def runs(df: DataFrame, by: list[str], order: str, same: list[str], name: str = "run_id") -> DataFrame:
    """Numbers the runs of rows that agree in ``same`` with the row before (nulls agree)."""
    w = Window.partitionBy(*by).orderBy(order)
    first = F.lit(False)
    for c in same:
        first = first | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    new = F.when(F.row_number().over(w) == 1, 1).when(first, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w).cast("int")).drop("__new")


def carried(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that was not null, up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def with_context(df: DataFrame, by: list[str], order: str, text: str = "text") -> DataFrame:
    """The texts before and after each row."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({"context_before": F.lag(text).over(w), "context_after": F.lead(text).over(w)})


def mark_furniture(blocks: DataFrame, by: str = "doc_id", edge: int = 2) -> DataFrame:
    """Adds is_furniture: text that, digits masked, stands on enough pages of its document, at a page's edge.

    Keys are counted by an aggregation and joined back; a document's pages bound the threshold.
    """
    keyed = blocks.withColumn("__key", furniture_key("text"))
    spread = keyed.where("__key <> ''").groupBy(by, "__key").agg(F.count_distinct("page").alias("__pages"))
    last = keyed.groupBy(by).agg(F.max("page").alias("__last"))
    w = Window.partitionBy(by, "page")
    edged = keyed.withColumns({"__up": F.row_number().over(w.orderBy("ord")), "__down": F.row_number().over(w.orderBy(F.col("ord").desc()))})
    out = edged.join(spread, [by, "__key"], "left").join(last, by)
    often = F.coalesce(F.col("__pages"), F.lit(0)) >= F.greatest(F.lit(2), F.least(F.lit(3), F.col("__last")))
    return out.withColumn("is_furniture", often & ((F.col("__up") <= edge) | (F.col("__down") <= edge))).drop("__key", "__pages", "__last", "__up", "__down")


def first_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def near_duplicates(blocks: DataFrame, view: int = VIEW, alike: float = ALIKE) -> DataFrame:
    """(doc_id, ord, outcome): kept, dropped, or ignored, against the last rows kept of the same document.

    A later row like one in view is dropped; a table row stays and the earlier one is ignored.
    A length bound spares most comparisons.
    """

    def one(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page", "ord"], kind="stable")
        held: list[list] = []
        out = {}
        for r in rows.itertuples():
            drop = False
            for prior in held[-view:]:
                a, b = len(prior[1]), len(r.text)
                if prior[0] != r.page or 200 * min(a, b) < alike * (a + b):
                    continue
                if indel_ratio(prior[1], r.text) >= alike:
                    if r.block_type == "table_row":
                        out[prior[2]] = "ignored"
                    else:
                        drop = True
                    break
            out[r.ord] = "dropped" if drop else out.get(r.ord, "kept")
            if not drop:
                held.append([r.page, r.text, r.ord])
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[0], "ord": list(out), "outcome": list(out.values())})

    return blocks.select("doc_id", "page", "ord", "block_type", "text").groupBy("doc_id").applyInPandas(one, "doc_id long, ord int, outcome string")


def _ints(c: Column) -> Column:
    return F.split(c, r"\.").cast("array<int>")


def staged_gate(active: Column, candidate: Column) -> Column:
    """Whether a section may follow the active one: 0.1 first, then first child, next sibling, an ancestor's next sibling, or the next major section."""
    dotted = r"^\d{1,9}(?:\.\d{1,9})+$"
    a, c = _ints(active), _ints(candidate)
    n, m = F.size(a), F.size(c)
    child = F.slice(c, 1, F.greatest(m - 1, F.lit(0))) == a
    raised = lambda k: F.concat(F.slice(a, 1, k - 1), F.array(F.element_at(a, k) + 1))
    next_of = (m <= n) & (m > 1) & (c == raised(F.greatest(F.least(m, n), F.lit(1))))
    major = (m == 2) & (F.element_at(c, 1) == F.element_at(a, 1) + 1) & (F.element_at(c, F.lit(2)) == 0)
    legal = (child & (F.element_at(c, -1) == 1)) | next_of | major
    return F.when(active.isNull(), candidate == "0.1").when(~active.rlike(dotted) | ~candidate.rlike(dotted), False).otherwise(legal)


def segment_gate(active: Column, candidate: Column) -> Column:
    """As ``staged_gate``, but anything may come first, repeats pass, and the next major section may stand alone or end in zeros."""
    number = r"^\d{1,9}(?:\.\d{1,9})*$"
    a, c = _ints(active), _ints(candidate)
    n, m = F.size(a), F.size(c)
    child = (m == n + 1) & (F.slice(c, 1, F.greatest(m - 1, F.lit(0))) == a) & (F.element_at(c, -1) == 1)
    k = F.greatest(F.least(m, n), F.lit(1))
    next_of = (m <= n) & (c == F.concat(F.slice(a, 1, k - 1), F.array(F.element_at(a, k) + 1)))
    major = (F.element_at(c, 1) == F.element_at(a, 1) + 1) & F.forall(F.slice(c, 2, F.greatest(m - 1, F.lit(0))), lambda x: x == 0)
    return F.when(candidate.isNull(), False).when(active.isNull(), True).when(~active.rlike(number) | ~candidate.rlike(number), True).otherwise((a == c) | child | next_of | major)


def gated_sections(blocks: DataFrame, gate, by: str = "doc_id") -> DataFrame:
    """(by, ord, candidate, section, accepted): the candidate sections of (by, ord, candidate) rows carried on through a gate.

    The gate sees the section accepted last, so this is a fold over a document's rows.
    """
    rows = blocks.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("ord", "candidate"))).alias("rows"))
    kind = "array<struct<ord:int,candidate:string,section:string,accepted:boolean>>"
    zero = F.struct(F.lit(None).cast("string").alias("active"), F.array().cast(kind).alias("out"))

    def step(s: Column, r: Column) -> Column:
        ok = F.coalesce(r["candidate"].isNotNull() & gate(s["active"], r["candidate"]), F.lit(False))
        section = F.when(ok, r["candidate"]).otherwise(s["active"])
        row = F.struct(r["ord"].cast("int").alias("ord"), r["candidate"].alias("candidate"), section.alias("section"), ok.alias("accepted"))
        return F.struct(section.alias("active"), F.array_append(s["out"], row).alias("out"))

    folded = F.aggregate("rows", zero, step, lambda s: s["out"])
    return rows.select(by, F.inline(folded))


def packed_chunks(blocks: DataFrame, most: int, by: str = "doc_id", size: str = "size") -> DataFrame:
    """(by, ord, chunk): blocks packed in order; a chunk closes before it would grow over ``most``."""
    rows = blocks.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("ord", F.col(size).cast("long").alias("size")))).alias("rows"))
    zero = F.struct(F.lit(1).alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<ord:int,chunk:int>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        cost = r["size"] + OVERHEAD
        full = (s["used"] > 0) & (s["used"] + cost > most)
        chunk = F.when(full, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(full, cost).otherwise(s["used"] + cost).alias("used"), F.array_append(s["out"], F.struct(r["ord"].cast("int").alias("ord"), chunk.alias("chunk"))).alias("out"))

    return rows.select(by, F.inline(F.aggregate("rows", zero, step, lambda s: s["out"])))


def toc_index(rows: DataFrame) -> DataFrame:
    """(doc_id, section, page) of contents rows (doc_id, from_table, ord, section, page): within the table the last entry holds, and the table before paragraphs."""
    order = F.when(F.col("from_table"), F.col("ord")).otherwise(-F.col("ord"))
    return rows.groupBy("doc_id", "section").agg(F.max_by("page", F.struct("from_table", order)).alias("page"))


def visible_pages(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """Adds manual_page to (doc_id, ord, section, raw_page): the page of the nearest ancestor section in the contents, moved by the first offset seen under it."""
    parts = F.split("section", r"\.")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    up = blocks.where("section is not null").select("doc_id", "ord", F.explode(ancestors).alias("parent"))
    near = up.join(toc.withColumnRenamed("section", "parent").withColumnRenamed("page", "toc_page"), ["doc_id", "parent"]).groupBy("doc_id", "ord").agg(F.max_by(F.struct("parent", "toc_page"), F.length("parent")).alias("t"))
    joined = blocks.join(near, ["doc_id", "ord"], "left")
    w = Window.partitionBy("doc_id", "t.parent").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offset = F.first(F.when(F.col("raw_page") > F.col("t.toc_page"), F.col("raw_page") - F.col("t.toc_page")), ignorenulls=True).over(w)
    page = F.greatest(F.col("t.toc_page"), F.col("raw_page") - F.coalesce(offset, F.lit(0)))
    return joined.withColumn("manual_page", F.when(F.col("t").isNull(), F.col("raw_page")).otherwise(page).cast("int")).drop("t")


#: Abbreviations of a definition table, and how many of them it holds at least.
ABBREVIATIONS, LEAST_ABBREVIATIONS = ["asl", "avl", "cpar", "scar", "dcc", "dhf", "dhr", "dmr", "qms"], 4


def table_class(rows: DataFrame) -> DataFrame:
    """(doc_id, table_id, content_class) of table rows (doc_id, table_id, row_index, cells), by the labels of the first rows; the first rule that fits wins.

    Labels are compared as heading keys (no blanks, no marks, lower case). Null cells count as empty.
    """
    rows = rows.withColumn("cells", F.transform("cells", lambda x: normalize_text(F.coalesce(x, F.lit("")))))
    w = Window.partitionBy("doc_id", "table_id")
    placed = rows.withColumn("nth", F.row_number().over(w.orderBy("row_index")))
    full = F.exists("cells", lambda x: x != "")
    labelled = F.coalesce(F.get("cells", F.lit(0)), F.lit("")).rlike("^[A-Z]$")
    dated = F.coalesce(F.get("cells", F.lit(2)), F.lit("")).rlike(r"(?U)\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b")
    of = lambda n: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("nth") <= n, F.struct("nth", F.array_join("cells", " ").alias("t"))))), lambda r: r["t"]), " ")
    joined = placed.groupBy("doc_id", "table_id").agg(
        *(heading_key(of(n)).alias(f"k{n}") for n in (1, 2, 3, 6)), of(5).alias("t5"), F.max(F.size("cells")).alias("columns"),
        (F.count_if(full) > 0).alias("any"), F.every(~full | labelled).alias("lettered"), F.some(full & labelled & dated).alias("dated"),
    )
    has = lambda c, *words: F.forall(F.array(*map(F.lit, words)), lambda x: F.col(c).contains(x))
    goes_on = (F.col("columns") == 3) & F.col("any") & F.col("lettered") & F.col("dated")
    known = F.size(F.filter(F.array(*map(F.lit, ABBREVIATIONS)), lambda x: F.col("k6").contains(x)))
    kind = (
        F.when(has("k1", "章节chapter", "标题titles", "页码page"), "table_of_contents")
        .when((has("k2", "评审reviewedby") | has("k2", "批准approvedby")) & has("k2", "职位title", "姓名name", "签名signature"), "approval_table")
        .when(goes_on | has("k1", "版本rev", "更改描述changedescription", "生效日期effectivedate"), "change_history")
        .when(has("k3", "iso13485", "referenceprocedures") & (has("k3", "qsr820") | has("k3", "21cfr820")), "regulatory_matrix")
        .when((F.col("columns") >= 6) & has("t5", "QSP") & F.col("t5").rlike(r"(?U)\b\d+\.\d+(?:\.\d+)?\b"), "regulatory_matrix")
        .when(known >= LEAST_ABBREVIATIONS, "definition_table")
        .when(has("k3", "质量管理体系标准qualitymanagementsystemspecification") | has("k3", "适用法规suitableregulations"), "regulatory_references")
        .otherwise("bilingual_prose")
    )
    return joined.select("doc_id", "table_id", kind.alias("content_class"))


def ocr_lines(words: DataFrame, floor: float = 0.25, top: float = 0.92) -> DataFrame:
    """Words (page, block, par, line, ord, word, x0, y0, x1, y1, conf) to lines: text in order, box hull, mean confidence under a ceiling."""
    kept = words.where(F.col("conf") >= floor)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "word"))), lambda r: r["word"]), " ")
    return kept.groupBy("page", "block", "par", "line").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.least(F.avg("conf"), F.lit(top)).alias("confidence"))


def in_tables(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Blocks with in_table: whether a block's centre lies in a table box of its page. Joined by page, then by range."""
    x, y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    inside = (F.col("b.page") == F.col("t.page")) & x.between(F.col("t.x0"), F.col("t.x1")) & y.between(F.col("t.y0"), F.col("t.y1"))
    hit = blocks.alias("b").join(boxes.alias("t"), inside, "left_semi").select("block_id", F.lit(True).alias("in_table"))
    return blocks.join(hit, "block_id", "left").withColumn("in_table", F.coalesce("in_table", F.lit(False)))


def page_breaks(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """Adds page to (by, ord, xml): one more than the rendered breaks counted before and within earlier rows."""
    w = Window.partitionBy(by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("page", (F.coalesce(F.sum(F.regexp_count("xml", F.lit("lastRenderedPageBreak"))).over(w), F.lit(0)) + 1).cast("int"))


def merged_fragments(blocks: DataFrame, gap: float = 18.0) -> DataFrame:
    """Paragraph fragments (doc_id, page, section, language, ord, text, x0, y0, x1, y1, confidence) of one page, section and language a small gap apart, as one row."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    follows = F.col("page").eqNullSafe(F.lag("page").over(w)) & F.col("section").eqNullSafe(F.lag("section").over(w)) & F.col("language").eqNullSafe(F.lag("language").over(w)) & F.col("language").isin("zh", "en") & (F.col("y0") - F.lag("y1").over(w) <= gap) & ~F.substring("text", 1, 1).isin("-", "•", "·")
    rows = blocks.withColumn("__new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("__new").over(w).cast("int"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"]), " ")
    return rows.groupBy("doc_id", "part").agg(F.min("ord").alias("ord"), F.first("page").alias("page"), F.first("section").alias("section"), text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("confidence").alias("confidence"))


def section_of_lines(blocks: DataFrame) -> DataFrame:
    """Section candidates of text blocks carried on by the segmenter's gate."""
    return gated_sections(blocks.select("doc_id", "ord", extract_section("text").alias("candidate")), segment_gate)




#: Words of running heads, as written and without blanks.
HEAD_MARKS = ["文件编号 doc no", "文件版本 doc rev", "页次 page no"]
HEAD_MARKS_CLOSE = ["文件编号docno", "文件版本docrev", "页次pageno", "文件名称documentname"]
TOP, BOTTOM = 135, 790


def running_furniture(blocks: DataFrame) -> DataFrame:
    """Adds ``furniture``: running heads by their words, and in documents of more than two pages by type or place; numbered sections are kept unless marked."""
    lower = F.lower("text")
    close = F.regexp_replace(lower, r"(?U)\s+", "")
    pages = F.max("page").over(Window.partitionBy("doc_id"))
    marked = F.lit(False)
    for words, c in ((HEAD_MARKS, lower), (HEAD_MARKS_CLOSE, close)):
        for word in words:
            marked = marked | c.contains(word)
    section = (F.coalesce(extract_section("text"), F.lit("")) != "") & F.col("text").rlike("[A-Za-z㐀-鿿]")
    placed = F.coalesce((F.col("y1") <= TOP) | (F.col("y0") >= BOTTOM), F.lit(False)) | F.col("block_type").isin("header", "footer")
    return blocks.withColumn("furniture", F.when(marked, True).when(section, False).otherwise(placed & (pages > 2)))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds ``place``: by page, height (the order where there is no box), left edge and order."""
    order = ["page", F.coalesce("y0", F.col("ord").cast("double")), F.coalesce("x0", F.lit(0.0)), "ord"]
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


#: List marks, and ends of sentences.
BULLET = r"^\s*(?:[-•●▪◦]|[(（]?\d+[.)、）]|[A-Za-z][.)])\s*"
SENTENCE_END = r"[。！？.!?；;：:]$|[。！？.!?；;：:][”’'\")]$"
GAP, INDENT, CLOSE_GAP, CLOSE_INDENT = (-2, 22), 24, 8, 6


def paragraph_groups(blocks: DataFrame) -> DataFrame:
    """Adds ``group_id``: blocks (doc_id, ord, page, language, segment_id, section, block_type, table_index, row_index, cell_index, x0, y0, y1, text) that go on one from another.

    Only blocks in one language join; within tables those of one cell, elsewhere by place, list marks and ends of sentences.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    p = lambda c: F.lag(c).over(w)
    ended, bullet = lambda t: t.rlike(SENTENCE_END), lambda t: t.rlike("(?U)" + BULLET)
    other_page = F.coalesce((F.col("page") != p("page")) & (F.col("page") != 0) & (p("page") != 0), F.lit(False))
    in_table = F.col("table_index").isNotNull() | p("table_index").isNotNull()
    same_cell = F.lit(True)
    for c in ("table_index", "row_index", "cell_index"):
        same_cell = same_cell & F.col(c).eqNullSafe(p(c))
    fall, shift = F.col("y0") - p("y1"), F.abs(F.col("x0") - p("x0"))
    by_place = F.when((fall < GAP[0]) | (fall > GAP[1]) | (shift > INDENT), False).when(~ended(p("text")), True).otherwise((fall <= CLOSE_GAP) & (shift <= CLOSE_INDENT))
    by_text = ~ended(p("text")) & (F.length(p("text")) < F.when(F.col("language") == "English", 90).otherwise(55))
    goes_on = (
        F.when(~F.col("language").isin("Chinese", "English") | ~F.col("language").eqNullSafe(p("language")) | ~F.col("segment_id").eqNullSafe(p("segment_id")), False)
        .when(other_page, False).when(in_table, same_cell).when(F.col("block_type") == "heading", False).when(bullet(F.col("text")), False)
        .when(bullet(p("text")) & ended(p("text")), False).when(fall.isNotNull() & shift.isNotNull(), by_place).otherwise(by_text)
    )
    first = F.row_number().over(w) == 1
    return blocks.withColumn("__new", F.when(first | ~F.coalesce(goes_on, F.lit(False)), 1).otherwise(0)).withColumn("group_id", F.sum("__new").over(w).cast("int")).drop("__new")


def split_mixed(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_id, ord, text) cut into pieces (doc_id, block_id, ord, text, language): neighbouring lines of one language stay together.

    A line that opens a section or a list item starts a piece. Order is a hundred times the block's, plus the piece's number; a block of one line stays as it is.
    """
    lines = F.filter(F.transform(F.split("text", r"[\n\r]+"), normalize_text), lambda x: x != "")
    rows = blocks.withColumn("__lines", lines)
    single = rows.where(F.size("__lines") <= 1).select("doc_id", "block_id", (F.col("ord") * 100).alias("ord"), "text", language_of("text").alias("language"))
    each = rows.where(F.size("__lines") > 1).select("doc_id", F.col("block_id").alias("__block"), "ord", F.posexplode("__lines").alias("__i", "__t")).withColumn("language", language_of("__t"))
    w = Window.partitionBy("doc_id", "__block").orderBy("__i")
    opens = (F.coalesce(extract_section("__t"), F.lit("")) != "") | F.col("__t").rlike("^[-•·]")
    goes_on = F.col("language").isin("zh", "en") & (F.col("language") == F.lag("language").over(w)) & ~opens
    numbered = each.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("__n", F.sum("__new").over(w) - 1)
    held = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__t"))), lambda x: x["__t"]), " ")
    pieces = numbered.groupBy("doc_id", "__block", "ord", "__n").agg(held.alias("text"), F.first("language").alias("language"))
    return single.unionByName(pieces.select("doc_id", stable_id("seg", "__block", "__n", "text").alias("block_id"), (F.col("ord") * 100 + F.col("__n")).alias("ord"), "text", "language"))


def section_segments(blocks: DataFrame) -> DataFrame:
    """(doc_id, segment_id, section, page, start_ord, end_ord, blocks): unbroken ranges of one section on one page."""
    rows = runs(blocks, ["doc_id"], "ord", ["section", "page"], "segment_id")
    return rows.groupBy("doc_id", "segment_id", "section", "page").agg(F.min("ord").alias("start_ord"), F.max("ord").alias("end_ord"), F.count(F.lit(1)).alias("blocks"))


def transition_allowed(previous: Column, candidate: Column) -> Column:
    """Whether a document that is in section ``previous`` may go on in ``candidate``: into it, or forward, but not back to what it lies in."""
    p, c = section_parts(previous), section_parts(candidate)
    begins = lambda a, b: F.slice(b, 1, F.size(a)) == a
    by_number = F.when(begins(p, c), True).when(begins(c, p), False).otherwise(c > p)
    return F.when(F.coalesce(candidate, F.lit("")) == "", False).when(previous.isNull() | (previous == candidate) | p.isNull() | c.isNull(), True).otherwise(by_number)
