"""Detection of cited references, with spans, versions and provisions, and their roll-up.

Positions come from splitting a text at its matches and adding up lengths, so no
UDF is needed. A catalogue's patterns are literals, compiled once a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, squeeze

SPAN = "struct<start:int,end:int,hit:string>"


def spans(c: Column | str, pattern: str) -> Column:
    """(start, end, hit) of every match, in code points."""
    c = col(c)
    gaps, hits = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), hits, lambda g, h: F.struct(F.length(g).alias("skip"), F.length(h).alias("n"), h.alias("hit")))

    def step(s: Column, x: Column) -> Column:
        start, end = s["at"] + x["skip"], s["at"] + x["skip"] + x["n"]
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))).alias("out"))

    return F.aggregate(pairs, zero, step, lambda s: s["out"])


def version(c: Column, pattern: str | None) -> Column:
    if pattern is None:
        return F.lit("unknown")
    found = F.trim(F.regexp_extract(c, pattern, 1))
    return F.when(found == "", "unknown").otherwise(found)


def mentions(blocks: DataFrame, catalogue, flags: str = "(?iU)") -> DataFrame:
    """(block columns, name, kind, start, end, hit, version, confidence) of every match of every (name, kind, pattern, version pattern); of one name and span one.

    The catalogue is unrolled into one array per block and exploded once, so a block is scanned where it lies.
    """
    none = F.array().cast("array<struct<name:string,kind:string,start:int,end:int,hit:string,version:string,confidence:double>>")

    def of(name: str, kind: str, pattern: str, vpattern: str | None) -> Column:
        def made(x: Column) -> Column:
            sure = F.when(F.lower(x["hit"]).contains(name.lower()), 0.98).otherwise(0.94)
            known = version(x["hit"], vpattern and flags + vpattern)
            return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), known.alias("version"), sure.alias("confidence"))

        return F.when(F.col("text").rlike(flags + pattern), F.transform(spans("text", flags + pattern), made)).otherwise(none)

    parts = [of(*entry) for entry in catalogue]
    rows = blocks.withColumn("__m", F.explode(F.concat(*parts))).select("*", "__m.*").drop("__m")
    return rows.dropDuplicates(["doc_id", "ord", "name", "start", "end"])


def detected(found: DataFrame, priority: Column | None = None) -> DataFrame:
    """(name, mentions, documents, version, confidence, citation, doc_id, ord): a row a reference, with the best evidence.

    Best: priority, then a known version, then confidence, then the earliest place. Only a struct per name is kept while aggregating.
    """
    rank = F.struct(priority if priority is not None else F.lit(1), F.col("version") != "unknown", "confidence", -F.col("doc_id"), -F.col("ord"), -F.col("start"))
    best = F.max_by(F.struct("hit", "version", "confidence", "doc_id", "ord"), rank).alias("best")
    rows = found.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("doc_id").alias("documents"), best)
    return rows.select("name", "mentions", "documents", "best.version", "best.confidence", F.col("best.hit").alias("citation"), "best.doc_id", "best.ord")


def provisions(blocks: DataFrame, patterns) -> DataFrame:
    """(doc_id, ord, start, end, hit) of provision matches: of overlapping ones the earliest and longest, and each wording once a block."""
    every = F.concat(*(spans("text", f"(?iU){p}") for p in patterns))
    rows = blocks.select("doc_id", "ord", F.explode(every).alias("s")).select("doc_id", "ord", "s.*")
    w = Window.partitionBy("doc_id", "ord").orderBy("start", F.col("end").desc())
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    outer = rows.withColumn("reach", reach).where("reach is null or end > reach").drop("reach")
    first = Window.partitionBy("doc_id", "ord", F.lower(squeeze("hit"))).orderBy("start")
    return outer.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def expanded(c: Column | str) -> Column:
    """`Articles 5, 6 and 7` as three provisions; anything else as itself."""
    t = squeeze(c)
    head = F.lower(F.regexp_extract(t, r"(?i)^(Article|Annex|Section|Clause)(?:s|es)?\s+(.+)$", 1))
    tail = F.regexp_extract(t, r"(?i)^(?:Article|Annex|Section|Clause)(?:s|es)?\s+(.+)$", 1)
    roman = F.regexp_extract_all(tail, F.lit(r"(?i)\b[IVXLCDM]+\b"), F.lit(0))
    number = F.regexp_extract_all(tail, F.lit(r"\d+(?:\.\d+)*[A-Za-z]?(?:\([A-Za-z0-9]+\))*"), F.lit(0))
    tokens = F.when(head == "annex", roman).otherwise(number)
    return F.when(head == "", F.array(t)).otherwise(F.transform(tokens, lambda x: F.concat(F.initcap(head), F.lit(" "), x)))


def nearest(found: DataFrame, cited: DataFrame) -> DataFrame:
    """(doc_id, ord, name, hit, provision): each provision with the mentions of its block at the least distance; ties go to all."""
    both = found.alias("m").join(cited.alias("p"), ["doc_id", "ord"])
    distance = F.greatest(F.lit(0), F.col("p.start") - F.col("m.end"), F.col("m.start") - F.col("p.end"))
    rows = both.select("doc_id", "ord", "m.name", "m.hit", F.col("p.start").alias("at"), F.col("p.hit").alias("cited"), distance.alias("distance"))
    least = F.min("distance").over(Window.partitionBy("doc_id", "ord", "at"))
    kept = rows.withColumn("least", least).where("distance = least")
    return kept.select("doc_id", "ord", "name", "hit", F.explode(expanded("cited")).alias("provision"))
