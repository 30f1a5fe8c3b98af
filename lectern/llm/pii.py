"""Personal data by weak supervision, in SQL functions alone.

Base spans (e-mail, ip, card, phone) come from fixed patterns and are always
reported. Wider patterns propose candidates that overlap no base span: written-out
e-mail addresses, numbers of seven digits and more, apart from base spans and from
neighbours of a known shape, titled names. Five labelers (shape, gazetteer, words
before, borders, size) vote 1, 0 or -1 on each candidate. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is and gives
every pattern a probability; with these as soft labels a naive Bayes classifier of
span features is fitted, and the candidates it accepts are added.

Positions are found by splitting a text at its matches and summing lengths, so
they count code points. Patterns start only where a match may start and use
possessive repeats where that cannot change a match; lengths are summed in blocks;
base spans are kept from number candidates run of digits by run of digits, as every
run lies wholly inside or outside of a match. So very long texts and texts of many
matches cost time about in proportion and no deep recursion.

Rows: a null text counts as empty; a null doc_id is carried along; repeated rows
are scanned alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, plain, text_column

KINDS = ["email", "ip", "card", "phone"]
#: Least probability at which a candidate becomes a span, and rounds of expectation-maximisation.
ACCEPT, ROUNDS = 0.9, 20
#: Characters before a candidate that labelers see.
BEFORE = 24

#: The contract's patterns. The heads keep a failed run from being tried again at each of its characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Shapes of personal numbers. A run of digits ends before a blank or bracket that one of them follows, so neighbours are judged apart.
_ALONE = r"(?<!(?<![0-9])00[1-9][0-9]{1,2} )"
_SHAPE = (
    r"(?:(?:1[ .-])?(?:\([0-9]{3}\)[ .-]{0,2}[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-]{1,2}[0-9]{3}[ .-][0-9]{4}|[0-9]{3} [0-9]{3}[.-][0-9]{4}|[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4})"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:[3-6][0-9]|2[2-7])[0-9]{2}(?:[ -][0-9]{4}){3}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}"
    rf"|{_ALONE}(?:1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}|(?!000|666|9)[0-9]{{9}}|(?:[3-6][0-9]|2[2-7])[0-9]{{11,17}}))(?![0-9]|[.-][0-9])"
)
#: What ends a candidate does not go on into an e-mail address.
_NO_EMAIL = r"(?![A-Za-z0-9._%+-]*+@[A-Za-z0-9-])"
CANDIDATES = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+-]))(?<!@)[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]++)++{_NO_EMAIL}",
    "number": rf"{_SHAPE}|\(?[0-9](?:(?!(?:[\x20()][\x20().-]?|[.-][\x20(]){_SHAPE})[\x20().-]{{0,2}}[0-9])++",
    "name": rf"(?<![A-Za-z0-9_@.-])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]++(?: [A-Z][a-z]++)?+{_NO_EMAIL}",
}
LABELERS = 5
LEAST_DIGITS = 7
SPAN = "struct<start:int,end:int,m:string,left:string,right:string>"
#: Lengths that are summed one by one; sums of blocks are summed in turn.
BLOCK = 256


def _sql_text(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` stands for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _sums(lengths: str) -> str:
    """SQL of the running sums of an array of int."""
    inner = f"transform(sequence(0, cast((size(l) - 1) div {BLOCK} AS int)), k -> aggregate(slice(l, k * {BLOCK} + 1, {BLOCK}), array(0), (a, y) -> array_append(a, element_at(a, -1) + y)))"
    before = "aggregate(w, array(0), (a, x) -> array_append(a, element_at(a, -1) + element_at(x, -1)))"
    joined = f"flatten(transform(w, (x, k) -> transform(slice(x, 2, {BLOCK}), y -> y + o[k])))"
    return _let(lengths, "l", _let(inner, "w", _let(before, "o", joined)))


def spans_of(text: str, pattern: str) -> Column:
    """Array of (start, end, m, left, right) of the leftmost non-overlapping matches in a column."""
    p = _sql_text(pattern)
    ends = _sums("transform(v.m, (m, i) -> length(v.g[i]) + length(m))")
    span = f"named_struct('start', e[i] - length(m), 'end', e[i], 'm', m, 'left', lower(right(v.g[i], {BEFORE})), 'right', left(v.g[i + 1], 4))"
    return F.expr(_let(f"named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1))", "v", _let(ends, "e", f"transform(v.m, (m, i) -> {span})")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether digits (at most 19 are looked at) pass the check sum."""
    n = F.least(F.length(digits), F.lit(19))

    def one(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(d)

    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(m, "[.]"), lambda x: F.when(F.length(part(x)) > 3, False).otherwise(F.coalesce(F.try_to_number(F.nullif(part(x), F.lit("")), F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


RUN = "[0-9]+"


def _covered(text: str, kind: str) -> Column:
    """For each run of digits of a text, whether it lies in a base span of a kind."""
    runs = lambda x: F.size(F.regexp_extract_all(x, F.lit(RUN), F.lit(0)))

    def flags(v: Column) -> Column:
        inside = lambda i: F.array_repeat(_passes(kind, v["m"][i]), runs(v["m"][i]))
        return F.flatten(F.transform(v["g"], lambda g, i: F.concat(F.array_repeat(F.lit(False), runs(g)), F.when(i < F.size(v["m"]), inside(i)).otherwise(F.array().cast("array<boolean>")))))

    matches = F.struct(F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0)).alias("m"), F.split(text, BASE[kind], -1).alias("g"))
    return F.transform(F.array(matches), flags)[0]


def _masked(text: str) -> Column:
    """The text with '#' for every digit in a base span; ``base`` names the kinds that it has."""
    has = lambda k: F.exists("base", lambda b: b["kind"] == k)
    flags = [F.when(has(k), _covered(text, k)).alias(k) for k in KINDS]
    parts = F.struct(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("m"), F.split(text, RUN, -1).alias("g"), *flags)

    def joined(v: Column) -> Column:
        taken = lambda i: F.coalesce(*(F.nullif(F.get(v[k], i), F.lit(False)) for k in KINDS), F.lit(False))
        run = lambda i: F.when(taken(i), F.repeat(F.lit("#"), F.length(v["m"][i]))).otherwise(v["m"][i])
        return F.array_join(F.transform(v["g"], lambda g, i: F.concat(g, F.when(i < F.size(v["m"]), run(i)).otherwise(""))), "")

    return F.transform(F.array(parts), joined)[0]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, c: Column) -> Column:
    """The labelers' votes on a candidate."""
    m, left, right = c["m"], c["left"], c["right"]
    d = _digits(m)
    n = F.length(d)
    border_bad = left.rlike("[a-z0-9_=/#@.]$") | right.rlike("^[A-Za-z0-9_@]")
    border = _vote(~border_bad & (left.rlike(r"\s$") | (left == "")), border_bad)
    if kind == "number":
        return F.array(
            _vote(m.rlike(r"^(1[ .-])?(\([0-9]{3}\)|\(?[0-9]{3}\)?[ .-]{1,2})[ .-]{0,2}[0-9]{3}[ .-][0-9]{4}$") | m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") | (n.between(13, 19) & luhn(d)), m.rlike(r"^[0-9]{4}[-.][0-9]{1,2}[-.][0-9]{1,2}$") | (n > 19)),
            _vote((n.between(13, 16) & d.rlike("^(4|5[1-5]|3[47]|6011)")) | (n.between(10, 11) & d.rlike("^1?[2-9][0-9]{2}[2-9]")), d.rlike(r"([0-9])\1{5}") | d.rlike("^0{3}")),
            _vote(left.rlike(r"(tel|phone|call|mobile|cell|fax|ssn|social|card|account|acct|passport|contact)[^a-z]*$"), left.rlike(r"(version|page|order|item|isbn|ref|build|figure|section|token|key)[^a-z]*$")),
            border,
            _vote(n.between(9, 16), (n < 7) | (n > 19)),
        )
    if kind == "email":
        return F.array(
            _vote(m.rlike(r"(?i)[\[(]dot[\])]|\."), F.length(m) > 80),
            _vote(m.rlike(r"(?i)(com|org|net|edu|gov|io|de|fr|es|uk)$"), m.rlike(r"[0-9]$")),
            _vote(left.rlike(r"(mail|contact|write|address|reach)[^a-z]*$"), left.rlike(r"(version|figure)[^a-z]*$")),
            border,
            _vote(F.length(m).between(8, 60), F.length(m) > 80),
        )
    return F.array(
        _vote(m.rlike(r"[A-Z][a-z]+ [A-Z][a-z]+$"), m.rlike(r"[A-Z][a-z]$")),
        _vote(m.rlike(r"^(Mr|Mrs|Ms|Dr|Prof)\."), F.lit(False)),
        _vote(left.rlike(r"(dear|by|from|with|patient|signed|name)[^a-z]*$"), F.lit(False)),
        border,
        _vote(F.length(m).between(7, 40), F.length(m) > 60),
    )


def features(kind: str, c: Column) -> Column:
    """Names of the span features that the final classifier reads; their number is fixed by these buckets."""
    m, left, right = c["m"], c["left"], c["right"]
    bucket = lambda name, x, top: F.concat(F.lit(f"{kind}:{name}="), F.least(x, F.lit(top)).cast("string"))
    last = F.regexp_extract(left, r"([a-z]{2,10})[^a-z]{0,4}$", 1)
    known = F.when(last.isin("tel", "phone", "call", "mobile", "cell", "fax", "ssn", "card", "account", "acct", "passport", "contact", "mail", "email", "dear", "by", "from", "version", "page", "order", "item", "isbn", "ref", "token", "key"), last).otherwise("")
    return F.array(
        bucket("size", F.length(m), 24),
        bucket("digits", F.length(_digits(m)), 20),
        bucket("marks", F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), 6),
        F.concat(F.lit(f"{kind}:before="), known),
        F.concat(F.lit(f"{kind}:first="), F.regexp_extract(m, "^[^A-Za-z]", 0)),
        F.concat(F.lit(f"{kind}:l="), F.when(left.rlike(r"\s$"), "blank").when(left.rlike("[a-z]$"), "letter").when(left == "", "none").otherwise("mark")),
        F.concat(F.lit(f"{kind}:r="), F.when(right.rlike(r"^\s"), "blank").when(right.rlike("^[A-Za-z]"), "letter").when(right == "", "none").otherwise("mark")),
    )


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates): the spans of the fixed patterns, and the candidates with votes and features."""
    rows = plain(docs, "doc_id", "text").select("doc_id", text_column().alias("t"))
    rows = rows.select("doc_id", "t", F.contains("t", F.lit("@")).alias("at"), F.col("t").rlike("[0-9]").alias("digit"), F.col("t").rlike(r"[\[(](?:at|AT)[\])]").alias("spelt"), F.col("t").rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\b").alias("titled"))
    when = {"email": "at", "ip": "digit", "card": "digit", "phone": "digit"}
    none = F.array().cast(f"array<{SPAN}>")
    for kind in KINDS:
        rows = rows.withColumn(f"b_{kind}", F.when(F.col(when[kind]), spans_of("t", BASE[kind])).otherwise(none))
    for kind, flag in (("email", "spelt"), ("name", "titled")):
        rows = rows.withColumn(f"c_{kind}", F.when(F.col(flag), spans_of("t", CANDIDATES[kind])).otherwise(none))

    def base(i: int, kind: str) -> Column:
        good = F.filter(f"b_{kind}", lambda c: _passes(kind, c["m"]))
        return F.transform(good, lambda c: F.struct(c["start"].alias("start"), F.lit(i).alias("rank"), c["end"].alias("end"), F.lit(kind).alias("kind")))

    rows = rows.withColumn("base", F.sort_array(F.concat(*(base(i, k) for i, k in enumerate(KINDS)))))
    rows = rows.withColumn("masked", F.when((F.size("base") > 0) & F.col("digit"), _masked("t")).otherwise(F.col("t")))
    rows = rows.withColumn("c_number", F.when(F.col("digit"), spans_of("masked", CANDIDATES["number"])).otherwise(none))

    def proposed(kind: str) -> Column:
        fit = F.filter(f"c_{kind}", lambda c: F.length(_digits(c["m"])) >= LEAST_DIGITS) if kind == "number" else F.col(f"c_{kind}")
        return F.transform(fit, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(kind).alias("kind"), votes(kind, c).alias("votes"), features(kind, c).alias("features")))

    return rows.select("doc_id", "base", F.concat(*(proposed(k) for k in CANDIDATES)).alias("candidates"))


def posteriors(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, votes, q) of (kind, votes, n): the probability of each vote pattern, by expectation-maximisation from the majority's view.

    A kind has at most 3**LABELERS patterns, so each fold is over a bounded array.
    """
    rate = lambda side, j, v: f"(aggregate(zip_with(p, q, (a, b) -> IF(a.votes[{j}] = {v}, a.n * {side}, 0D)), 0.5D, (x, y) -> x + y) / (aggregate(zip_with(p, q, (a, b) -> a.n * {side}), 1.5D, (x, y) -> x + y)))"
    yes, no = "b", "(1 - b)"
    ratios = ", ".join(f"ln({rate(yes, j, v)} / {rate(no, j, v)})" for j in range(LABELERS) for v in (-1, 0, 1))
    prior = f"ln((aggregate(zip_with(p, q, (a, b) -> a.n * {yes}), 0.5D, (x, y) -> x + y)) / (aggregate(zip_with(p, q, (a, b) -> a.n * {no}), 0.5D, (x, y) -> x + y)))"
    step = f"transform(array(array({ratios}, {prior})), w -> transform(p, a -> 1 / (1 + exp(-(w[{3 * LABELERS}] + " + " + ".join(f"w[{3 * j + 1} + a.votes[{j}]]" for j in range(LABELERS)) + ")))))[0]"
    held = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
    fold = f"aggregate(sequence(1, {rounds}), transform(p, a -> 1 / (1 + exp(-cast(aggregate(a.votes, 0, (x, y) -> x + y) AS double)))), (q, i) -> {step})"
    return held.select("kind", F.explode(F.expr(f"zip_with(p, {fold}, (a, b) -> named_struct('votes', a.votes, 'q', b))")).alias("x")).select("kind", "x.votes", "x.q")


def fit(candidates: DataFrame) -> dict[str, float]:
    """Log-odds of the features, and of each kind under 'kind=': a naive Bayes classifier fitted to the posteriors.

    The features are a fixed set of buckets, so what comes to the driver is bounded.
    """
    rows = candidates.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    counted = rows.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).cast("double").alias("n"))
    patterns = counted.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    soft = counted.join(posteriors(patterns), ["kind", "votes"])
    every = soft.select("kind", "n", "q", F.explode(F.concat("features", F.array(F.concat(F.lit("kind="), F.col("kind"))))).alias("feature"))
    sums = every.groupBy("kind", "feature").agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")).collect()
    total = {r["kind"]: (r["yes"], r["no"]) for r in sums if r["feature"] == f"kind={r['kind']}"}
    out = {}
    for r in sums:
        yes, no = total[r["kind"]]
        if r["feature"].startswith("kind="):
            out[r["feature"]] = math.log((yes + 1) / (no + 1))
        else:
            out[r["feature"]] = math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1))
    return out


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every document; nothing is shuffled but counts."""
    rows = cut(tagged(docs))
    model = fit(rows)
    if model:
        weights = F.create_map(*(F.lit(x) for pair in sorted(model.items()) for x in pair))
    else:
        weights = F.expr("cast(map() AS map<string, double>)")
    score = lambda c: F.aggregate(c["features"], F.coalesce(F.try_element_at(weights, F.concat(F.lit("kind="), c["kind"])), F.lit(0.0)), lambda a, f: a + F.coalesce(F.try_element_at(weights, f), F.lit(0.0)))
    added = F.transform(F.filter("candidates", lambda c: score(c) >= math.log(ACCEPT / (1 - ACCEPT))), lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
    rows = rows.select("doc_id", "base", added.alias("added"))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
