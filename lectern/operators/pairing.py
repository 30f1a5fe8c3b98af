"""Pairing: candidates, one-to-one assignment, leftovers, following rows, parallel runs, units of a row.

Candidates are joined on document and page with the pages of one side spread over
the band, so the join is an equi-join and never all pairs of a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from .storage import stored
from ..functions.text import HAN, LATIN, clean_alignment, clean_chinese, clean_english, count_of, history_cell, normalize_for_similarity, references, stable_id, structural_cell, table_cells

BAND = 2
#: Classes whose blocks are not paired in the ordinary way, and those that may stand in one language.
UNPAIRED_CLASSES = ["regulatory_matrix", "organization_chart_or_structure", "table_of_contents", "approval_table", "document_metadata"]
SINGLE_CLASSES = ["definition_table", "regulatory_references", "regulatory_matrix", "procedure_reference"]
CONFIRMED, UNCERTAIN = 0.82, 0.68


def candidates(source: DataFrame, target: DataFrame, band: int = BAND) -> DataFrame:
    """Pairs of structs a, b of blocks of one document at most ``band`` pages apart."""
    left = source.select("doc_id", F.struct(*source.columns).alias("a"), F.explode(F.sequence(F.col("page") - band, F.col("page") + band)).alias("__page"))
    right = target.select("doc_id", F.struct(*target.columns).alias("b"), F.col("page").alias("__page"))
    return left.join(right, ["doc_id", "__page"]).select("doc_id", "a", "b")


def allowed(a: Column, b: Column) -> Column:
    """Whether two full blocks may be paired at all."""
    fine = lambda x: ~x["ignored"] & ~x["content_class"].isin(*UNPAIRED_CLASSES, "reference_table")
    history = (a["content_class"] == "change_history") | (b["content_class"] == "change_history")
    revision = ~history | F.coalesce(a["revision_id"] == b["revision_id"], F.lit(False))
    heading = (a["block_type"] != "heading") | b["block_type"].isin("heading", "paragraph")
    tables = F.coalesce((a["table_id"] == b["table_id"]) | (a["table_id"] == "") | (b["table_id"] == ""), F.lit(True))
    return fine(a) & fine(b) & (F.abs(a["page"] - b["page"]) <= BAND) & revision & heading & tables


def prepared(blocks: DataFrame, reading: Column | str, source: bool) -> DataFrame:
    """Blocks with what scoring reads of them, worked out once a block: ``reading`` (a source block's translation, a target's own text), its normal form and tokens, and entities."""
    rows = blocks.withColumn("reading", F.coalesce(F.col(reading) if isinstance(reading, str) else reading, F.lit("")))
    found = S.entity_set("text", "reading") if source else S.entity_set("reading")
    return rows.withColumns({"norm": normalize_for_similarity("reading"), "bag": S.token_bag("reading"), "found": found})


def scored(pairs: DataFrame, semantic: Column | None = None) -> DataFrame:
    """Adds the six components of the pair score and their weighted sum, for pairs of ``prepared`` blocks.

    Meaning is the full semantic similarity unless another column is given for it.
    """
    a, b = F.col("a"), F.col("b")
    if semantic is None:
        semantic = S.semantic_of(a["norm"], b["norm"], S.bag_recall(a["bag"], b["bag"]), S.token_set_udf(), S.sequence_udf())
    parts = {
        "semantic": semantic,
        "entities": S.set_similarity(a["found"], b["found"]),
        "page": S.page_score(a["page"], b["page"]),
        "section": S.section_score(a["section"], b["section"]),
        "length": S.length_score(a["reading"], b["reading"]),
        "layout": S.layout_score(a, b),
    }
    return pairs.withColumns({f"{k}_score": v for k, v in parts.items()}).withColumn("score", S.weighted_score({k: F.col(f"{k}_score") for k in parts}))


def assign(ranked: DataFrame, by: list[str], left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs, best score first, ties by the ids.

    Under a total order the sequential choice equals taking, again and again, all
    pairs that are the best of both their sides; each round drops the rows used.
    Rounds are cut off from one another, since each reads the one before.
    """
    order = [F.col(score).desc(), F.col(left), F.col(right)]
    rest, done = ranked, None
    while True:
        best = rest.withColumns({"__l": F.row_number().over(Window.partitionBy(*by, left).orderBy(*order)), "__r": F.row_number().over(Window.partitionBy(*by, right).orderBy(*order))})
        taken = stored(best.where("__l = 1 and __r = 1").drop("__l", "__r"))
        if taken.isEmpty():
            break
        done = taken if done is None else done.unionByName(taken)
        rest = stored(rest.join(taken.select(*by, left), [*by, left], "left_anti").join(taken.select(*by, right), [*by, right], "left_anti"))
    return done if done is not None else ranked.limit(0)


def leftovers(blocks: DataFrame, used: DataFrame) -> DataFrame:
    """Blocks without a pair, with their status; classes that need no translation need no review."""
    rest = blocks.join(used.select("block_id"), "block_id", "left_anti")
    free = F.col("ignored") | F.col("content_class").isin(*UNPAIRED_CLASSES, *SINGLE_CLASSES)
    status = F.when(F.col("language") == "zh", "missing_english").when((F.col("language") == "en") & F.col("content_class").isin(*SINGLE_CLASSES), "unpaired").when(F.col("language") == "en", "missing_chinese").otherwise("unpaired")
    return rest.select("doc_id", "ord", "block_id", status.alias("pair_status"), (~free).alias("needs_manual_review"))


def following(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """Source rows paired with the target row that comes next, neutral rows passed over, with the positional score."""
    w = Window.partitionBy(by).orderBy("ord")
    named = blocks.where("language <> 'unknown'")
    nxt = named.withColumns({"b_ord": F.lead("ord").over(w), "b_language": F.lead("language").over(w), "b_page": F.lead("page").over(w)})
    pairs = nxt.where("language = 'zh' and b_language = 'en' and b_page - page <= 1")
    skipped = F.col("b_ord") - F.col("ord") > 1
    score = 0.78 - F.when(skipped, 0.14).otherwise(0.0) + F.when(F.col("page") == F.col("b_page"), 0.06).otherwise(0.0)
    return pairs.select(by, F.col("ord").alias("a_ord"), "b_ord", F.bround(F.least(score, F.lit(0.98)), 2).alias("score"), skipped.alias("skipped_neutral"))


def parallel_runs(blocks: DataFrame, by: str = "doc_id", least: int = 2, most: int = 8) -> DataFrame:
    """Runs of source rows followed by as many target rows on the same page, zipped by position."""
    from .layout import runs

    marked = runs(blocks, [by], "ord", ["language", "page"])
    size = marked.groupBy(by, "run_id").agg(F.count(F.lit(1)).alias("n"), F.first("language").alias("language"), F.first("page").alias("page"))
    w = Window.partitionBy(by).orderBy("run_id")
    fit = size.withColumns({"n2": F.lead("n").over(w), "l2": F.lead("language").over(w), "p2": F.lead("page").over(w)}).where(f"language = 'zh' and l2 = 'en' and n = n2 and n between {least} and {most} and page = p2").select(by, "run_id")
    numbered = marked.withColumn("i", F.row_number().over(Window.partitionBy(by, "run_id").orderBy("ord")))
    left = fit.join(numbered, [by, "run_id"]).select(by, "run_id", "i", F.col("ord").alias("a_ord"))
    right = numbered.select(by, (F.col("run_id") - 1).alias("run_id"), "i", F.col("ord").alias("b_ord"))
    return left.join(right, [by, "run_id", "i"]).select(by, "a_ord", "b_ord")


def nearby(blocks: DataFrame, targets: DataFrame, reach: int = 1, most: int = 8) -> DataFrame:
    """Up to ``most`` blocks within ``reach`` pages of each target (doc_id, block_id, page), in order, the target itself left out."""
    spread = targets.select("doc_id", F.col("block_id").alias("target_id"), F.explode(F.sequence(F.col("page") - reach, F.col("page") + reach)).alias("page"))
    met = spread.join(blocks.select("doc_id", "page", "ord", "block_id"), ["doc_id", "page"]).where("block_id <> target_id")
    w = Window.partitionBy("target_id").orderBy("ord")
    return met.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("target_id", "n", "block_id")


UNIT = "struct<chinese:string,english:string>"


def split_label(c: Column) -> Column:
    """(chinese, english) of one mixed label: Han, then a Latin rest of three words and more; or a compact label without a gap; null otherwise."""
    sequence = r"(?U)^(.*[㐀-鿿][^A-Za-z]{0,8})\s+([A-Za-z][A-Za-z0-9'’/(),&;:.\-\s]+)$"
    compact = r"(?U)^\s*(?:\d+(?:\.\d+)*\s*)?([㐀-鿿、/（）()]+)([A-Za-z][A-Za-z0-9'’/(),&;:.\-\s]*)\s*$"
    spaced = r"(?U)^\s*(?:\d+(?:\.\d+)*\s*)?([㐀-鿿、/]+)\s*[/-]?\s*([A-Za-z][A-Za-z ]*)$"
    made = None
    for pattern, least in ((sequence, 3), (compact, 1), (spaced, 1)):
        english = F.regexp_extract(c, pattern, 2)
        fits = (english != "") & (F.regexp_count(english, F.lit("[A-Za-z]+")) >= least)
        unit = F.struct(clean_chinese(F.regexp_extract(c, pattern, 1)).alias("chinese"), clean_english(english).alias("english"))
        made = F.when(fits, unit) if made is None else made.when(fits, unit)
    return made


def eligible(b: Column | None = None) -> Column:
    """Whether a block's text can be held against a translation: not furniture, not a bare number, four characters at least."""
    c = (lambda name: F.col(name)) if b is None else (lambda name: b[name])
    text = F.trim(c("text"))
    return ~c("ignored") & ~c("content_class").isin(*UNPAIRED_CLASSES, "reference_table") & ~c("block_type").isin("header", "footer", "reference_table") & (F.length(text) >= 4) & ~text.rlike(r"(?U)^[\d\s./():-]+$")


def reference_mapping(chinese: Column, english: Column) -> Column:
    """Whether a pair only maps standards: two references, or one beside a short side without a sentence end."""
    found = F.size(references(english))
    return (found >= 2) | ((found >= 1) & (F.length(chinese) < 120) & ~chinese.rlike("[。；;]"))


def short_label(chinese: Column, english: Column) -> Column:
    return (count_of(chinese, HAN) <= 18) & (F.regexp_count(english, F.lit("[A-Za-z]+")) <= 10) & ~chinese.rlike("[。；;！？!?]")


def translation_of_unit(translation: Column, units: Column, index: Column) -> Column:
    """The part of a row's translation that belongs to a unit: the i-th of as many parts as there are units; the whole for a single unit; else empty."""
    whole = clean_alignment(translation)
    parts = F.filter(F.transform(F.split(whole, r"(?U)\s*\|\s*|\n+"), clean_english), lambda x: x != "")
    return F.when(F.size(parts) == units, F.get(parts, index)).when(units == 1, whole).otherwise("")


def alignment_units(text: Column, content_class: Column) -> Column:
    """Units (chinese, english) of a row's cells: a fold that holds the last cell of one language until one of the other comes."""
    zero = F.struct(F.lit(None).cast("string").alias("zh"), F.lit(None).cast("string").alias("en"), F.array().cast(f"array<{UNIT}>").alias("out"))
    cells = F.when(F.size(table_cells(text)) > 0, table_cells(text)).otherwise(F.array(text))
    plain = F.filter(cells, lambda x: ~F.when(content_class == "change_history", history_cell(x)).otherwise(structural_cell(x)))
    marked = F.transform(plain, lambda x: F.struct(x.alias("t"), count_of(x, HAN).alias("h"), count_of(x, LATIN).alias("l"), split_label(x).alias("u")))

    def step(s: Column, x: Column) -> Column:
        none = F.lit(None).cast("string")
        mixed = (x["h"] > 0) & (x["l"] > 0) & x["u"].isNotNull()
        only_zh, only_en = (x["h"] > 0) & (x["l"] == 0), (x["l"] > 0) & (x["h"] == 0)
        close_zh, close_en = only_zh & s["en"].isNotNull(), only_en & s["zh"].isNotNull()
        add = lambda a, b: F.array_append(s["out"], F.struct(a.alias("chinese"), b.alias("english")))
        out = F.when(mixed, F.array_append(s["out"], x["u"])).when(close_zh, add(clean_chinese(x["t"]), clean_english(s["en"]))).when(close_en, add(clean_chinese(s["zh"]), clean_english(x["t"]))).otherwise(s["out"])
        zh = F.when(mixed | close_en, none).when(only_zh & ~close_zh, x["t"]).otherwise(s["zh"])
        en = F.when(mixed | close_zh, none).when(only_en & ~close_en, x["t"]).otherwise(s["en"])
        return F.struct(zh.alias("zh"), en.alias("en"), out.alias("out"))

    return F.aggregate(marked, zero, step, lambda s: s["out"])


def best_lines(lines: DataFrame, items: list[tuple], floors: dict, least: float = 65.0) -> DataFrame:
    """(item_id, doc_id, pos, score): for each part of the lines, every item's line of the greatest token-set ratio, from ``least`` on; ties go to the first.

    Every line (doc_id, pos, line) meets every item (item_id, text). Common words give the ratios with the common words exactly; they begin both texts,
    so the remaining one needs only the rest, is bounded by characters counted by bucket, and is scored only where it may reach an item's best so far. ``floors`` are scores known to be met by some line; the items are the bounded side.
    """

    def run(batches):
        best = {i: (max(least, floors.get(k, least)), None) for i, (k, _) in enumerate(items)}
        words = [set(t.split()) for _, t in items]
        ids = {w: n for n, w in enumerate(sorted(set().union(*words)))}
        sizes = np.zeros((len(ids), len(items)), dtype=np.int32)
        for i, ws in enumerate(words):
            for w in ws:
                sizes[ids[w], i] = len(w) + 1
        joined = lambda ws: " ".join(sorted(ws))
        counts = lambda t: np.bincount(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) & 127, minlength=128)
        item_counts = np.array([counts(joined(ws)) for ws in words], dtype=np.int32).reshape(len(items), 128)
        nx = item_counts.sum(1)

        def offer(i, score, place):
            if score > best[i][0] or score == best[i][0] and (best[i][1] is None or place < best[i][1]):
                best[i] = (score, place)

        for batch in batches:
            first: dict[str, tuple] = {}
            for d, p, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pos", "line")), strict=True):
                place = (d is None, d or 0, p)
                if t not in first or place < first[t]:
                    first[t] = place
            every = [t for t in first if t.split()]
            for start in range(0, len(every), 2000):
                texts = every[start : start + 2000]
                sets = [set(t.split()) for t in texts]
                hy = np.array([counts(joined(ws)) for ws in sets], dtype=np.int32)
                ny = hy.sum(1)
                common = np.array([sizes[[ids[w] for w in ws if w in ids]].sum(0) for ws in sets])
                for i in range(len(items)):
                    if not nx[i]:
                        continue
                    nb = np.maximum(common[:, i] - 1, 0)
                    known = np.where((nb == nx[i]) | (nb == ny), 100.0, 200.0 * nb / (nb + np.minimum(nx[i], ny)))
                    bound = np.maximum(known, 200.0 * np.minimum(nx[i], ny) / (nx[i] + ny))
                    at = np.flatnonzero(bound >= best[i][0] - 1e-6)
                    bound = np.maximum(known[at], 200.0 * np.minimum(hy[at], item_counts[i]).sum(1) / (nx[i] + ny[at]))
                    for j in np.argsort(-bound, kind="stable"):
                        if bound[j] < best[i][0] - 1e-6:
                            break
                        n, score = at[j], known[at[j]]
                        if score < 100:
                            left, right = joined(words[i] - sets[n]), joined(sets[n] - words[i])
                            score = max(score, 200.0 * (common[n, i] + S.lcs(left, right)) / (nx[i] + ny[n]))
                        offer(i, float(score), first[texts[n]])
        met = [(items[i][0], None if p[0] else p[1], p[2], s) for i, (s, p) in best.items() if p]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*met) if met else [()] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["item_id", "doc_id", "pos", "score"])

    return lines.select("doc_id", "pos", "line").mapInArrow(run, "item_id long, doc_id long, pos int, score double")
