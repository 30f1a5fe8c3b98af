"""Checks of pairs and terms: references, wording, modals, negation, length, terminology."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalogs import MODALS, STANDARD_TERMS, STRONG_MODALS
from ..functions.text import HAN_PLAIN, count_of, english_candidate, references, stable_id

#: Words by which a negation shows on either side.
NEGATION_SOURCE = "不|不得|禁止|无须|不应"
NEGATION_TARGET = r"(?i)\b(no|not|non|without|shall not|must not|prohibit|forbid)\b"
STOP_PARTS = ["公司", "文件", "以及", "进行", "应当"]


def reference_mismatches(pairs: DataFrame) -> DataFrame:
    """Confirmed, checkable pairs of two blocks whose sets of lettered ids differ."""
    kept = lambda c: F.array_sort(F.filter(references(c), lambda r: r.rlike(r"\p{L}")))
    rows = pairs.where("pair_status = 'confirmed' and should_check_translation").where(F.size(F.array_distinct("source_block_ids")) > 1)
    rows = rows.withColumns({"refs_zh": kept("chinese_text"), "refs_en": kept("english_text")})
    differ = (F.size(F.array_except("refs_zh", "refs_en")) > 0) | (F.size(F.array_except("refs_en", "refs_zh")) > 0)
    return rows.where(differ).select(stable_id("TF", "pair_id", F.lit("reference")).alias("finding_id"), "pair_id", "refs_zh", "refs_en", F.lit("Major").alias("severity"), F.lit(0.9).alias("confidence"))


def rule_issues(pairs: DataFrame) -> DataFrame:
    """(pair_id, issue_type, subject, severity) of the wording rules, of pairs with both sides."""
    rows = pairs.where("coalesce(chinese_text, '') <> '' and coalesce(english_text, '') <> ''")
    zh, en = F.col("chinese_text"), F.lower("english_text")
    words = F.size(F.filter(F.split("english_text", r"\s+"), lambda w: w != ""))
    han = count_of(zh, HAN_PLAIN)
    issue = lambda when, kind, subject, severity: F.when(when, F.struct(F.lit(kind).alias("issue_type"), F.lit(subject).alias("subject"), F.lit(severity).alias("severity")))
    rules = [issue(zh.contains(t) & ~en.contains(s.lower()), "inconsistent terminology", t, "Minor") for t, s in STANDARD_TERMS.items()]
    rules += [issue(zh.contains(m) & ~reduce(lambda a, b: a | b, [en.contains(x) for x in xs]), "incorrect modal verb", m, "Major" if m in STRONG_MODALS else "Minor") for m, xs in MODALS.items()]
    rules += [
        issue(zh.rlike(NEGATION_SOURCE) & ~F.col("english_text").rlike(NEGATION_TARGET), "missing information", "negation", "Major"),
        issue(words < F.greatest(F.lit(3.0), han * 0.12), "missing information", "short", "Major"),
        issue(words > F.greatest(F.lit(30.0), han * 2.2), "extra information", "long", "Minor"),
    ]
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return rows.select("pair_id", F.inline(found))


def term_uses(pairs: DataFrame, terms: DataFrame, key: str = "pair_id") -> DataFrame:
    """(term, preferred, pair key, candidate) of confirmed pairs that hold a catalogue term. The catalogue is a few rows and is broadcast."""
    found = pairs.join(F.broadcast(terms), F.col("source_text").contains(F.col("term")))
    return found.select("term", "preferred", key, english_candidate("preferred", "target_text").alias("candidate"))


def terminology(uses: DataFrame, key: str = "pair_id") -> DataFrame:
    """(term, preferred, frequency, variants, alternatives, is_issue): counted per variant first, so a frequent term is small before it is gathered."""
    counted = uses.groupBy("term", "preferred", "candidate").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.groupBy("term", "preferred").agg(F.sum("n").alias("frequency"), F.count("candidate").alias("variants"), F.count_if(F.lower("candidate") != F.lower("preferred")).alias("alternatives"))
    return rows.withColumn("is_issue", (F.col("variants") > 1) | (F.col("alternatives") > 0))


def repeated_terms(blocks: DataFrame, pattern: str = "[一-鿿]{3,10}", stops: list[str] | None = None, short: int = 4, least: int = 3) -> DataFrame:
    """(term, uses) of script runs met ``least`` times; short runs that hold a stop part are passed over."""
    stop = "|".join(STOP_PARTS if stops is None else stops)
    rows = blocks.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("term"))
    if stop:
        rows = rows.where((F.length("term") > short) | ~F.col("term").rlike(stop))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= least)


def provenance(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """(claim_id, failures) of AI claims (claim_id, target, selected, pair_ids, quote, claimed, supported): every gate that a claim fails.

    Gates: the target is the selected one; every named pair exists; the quote stands in one of them; no provision beyond the supported ones.
    """
    named = claims.select("claim_id", "quote", F.explode_outer("pair_ids").alias("pair_id"))
    met = named.join(pairs.select("pair_id", "text"), "pair_id", "left")
    per = met.groupBy("claim_id").agg(F.bool_or(F.col("text").isNull()).alias("unknown"), F.bool_or(F.coalesce(F.lower("text").contains(F.lower("quote")), F.lit(False))).alias("quoted"))
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    gates = [(key("target") != key("selected"), "target"), (F.col("unknown"), "evidence"), (~F.col("quoted"), "quote"), (F.size(F.array_except("claimed", "supported")) > 0, "provision")]
    failed = F.filter(F.array(*(F.when(c, n) for c, n in gates)), lambda x: x.isNotNull())
    return claims.join(per, "claim_id").select("claim_id", F.array_join(failed, ",").alias("failures"))


def audit(sent: DataFrame, answered: DataFrame) -> DataFrame:
    """(section, missing, unknown, repeated): how an answer's block ids differ from those sent."""
    counted = answered.groupBy("section", "block_id").agg(F.count(F.lit(1)).alias("n"))
    both = sent.withColumn("was_sent", F.lit(True)).join(counted, ["section", "block_id"], "full")
    return both.groupBy("section").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("was_sent").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"))


def term_table(spark: SparkSession, terms: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(terms.items()), "term string, preferred string")
