"""Properties of operators that SQL does not state."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import similarity as S
from lectern.functions import text as T
from lectern.operators import ai, layout, pairing, report
from lectern.plans import registry
from lectern.operators.pair_blocks import pair_blocks
from lectern.sources import docx


def test_indel_ratio_against_table():
    def slow(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return 200.0 * m[-1][-1] / (len(a) + len(b)) if a or b else 100.0

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc é") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert S.indel_ratio(a, b) == pytest.approx(slow(a, b))


def test_partial_ratio():
    assert S.partial_ratio("abc", "xxabcxx") == 100.0
    assert S.partial_ratio("", "x") == 0.0


def test_assignment_equals_sequential_choice(spark):
    rng = random.Random(3)
    rows = [(d, f"a{i}", f"b{j}", rng.randint(0, 5)) for d in range(12) for i in range(4) for j in range(4) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "doc_id int, a string, b string, score int")
    got = {tuple(r) for r in pairing.assign(df, ["doc_id"], "a", "b", "score").select("doc_id", "a", "b").collect()}
    want, used = set(), set()
    for d, a, b, _ in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if (d, a) not in used and (d, b) not in used:
            used |= {(d, a), (d, b)}
            want.add((d, a, b))
    assert got == want


def test_chunks_never_exceed(spark):
    rows = [(1, i, n) for i, n in enumerate([50, 60, 30, 90, 10])]
    got = layout.packed_chunks(spark.createDataFrame(rows, "doc_id int, ord int, size int"), 300).orderBy("ord").collect()
    assert [r.chunk for r in got] == [1, 1, 2, 2, 3]


def test_near_duplicates(spark):
    rows = [(1, 1, 0, "paragraph", "The quick brown fox jumps over it"), (1, 1, 1, "paragraph", "The quick brown fox jumps over it."), (1, 1, 2, "table_row", "The quick brown fox jumps over it!"), (1, 2, 3, "paragraph", "The quick brown fox jumps over it")]
    got = {r.ord: r.outcome for r in layout.near_duplicates(spark.createDataFrame(rows, "doc_id long, page int, ord int, block_type string, text string")).collect()}
    assert got == {0: "ignored", 1: "dropped", 2: "kept", 3: "kept"}


def test_references_on_nulls(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    rows = df.select(T.normalize_text("t").alias("n"), T.extract_section("t").alias("s"), T.stable_id("x", "t").alias("i")).collect()
    assert rows[0].n is None and rows[0].s is None and rows[0].i == rows[1].i


def test_docx_scan(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, n="": f"<w:p><w:pPr>{n}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    num = lambda lvl: f'<w:numPr><w:ilvl w:val="{lvl}"/><w:numId w:val="7"/></w:numPr>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("First", num(0)) + p("Child", num(1)) + p("Second", num(0)) + "<w:p><w:r><w:lastRenderedPageBreak/></w:r></w:p>" + f"<w:tbl><w:tr>{cell('a')}{cell('a')}{cell('b')}</w:tr></w:tbl>"
    level = lambda i, t: f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="{t}"/></w:lvl>'
    numbering = f'<w:numbering {w}><w:abstractNum w:abstractNumId="0">{level(0, "%1.0")}{level(1, "%1.%2")}</w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", numbering)
    files = spark.createDataFrame([("a.docx", bytearray(raw.getvalue())), ("b.docx", bytearray(b"no archive"))], "path string, content binary")
    rows = docx.scan(files).orderBy("ord").collect()
    assert [(r.kind, r.text, r.label, r.raw_page) for r in rows] == [("paragraph", "First", "1.0", 1), ("paragraph", "Child", "1.1", 1), ("paragraph", "Second", "2.0", 1), ("table_row", "a | b", None, 2)]


def test_docx_merges_breaks_and_styles(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="", lead="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r>{lead}<w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t, props="", inner="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t)}{inner}</w:tc>"
    nested = f"<w:tbl><w:tr>{cell('inner')}</w:tr></w:tbl>"
    table = f"<w:tbl><w:tr>{cell('top', '<w:vMerge w:val=\"restart\"/>')}{cell('x', '<w:gridSpan w:val=\"2\"/>', nested)}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('y')}{cell('z')}</w:tr></w:tbl>"
    body = p("Kept", "Sub") + p("After", "", "<w:lastRenderedPageBreak/>") + "<w:p><w:r><w:t>Split</w:t><w:lastRenderedPageBreak/><w:t>here</w:t></w:r></w:p>" + p("Plain", "Loop") + table
    styles = f'<w:styles {w}><w:style w:styleId="Sub"><w:name w:val="own"/><w:basedOn w:val="Base"/></w:style><w:style w:styleId="Base"><w:name w:val="Heading 1"/></w:style><w:style w:styleId="Loop"><w:name w:val="a"/><w:basedOn w:val="Loop"/></w:style></w:styles>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
    rows = docx.scan(spark.createDataFrame([("a.docx", bytearray(raw.getvalue()))], "path string, content binary")).orderBy("ord").collect()
    assert [(r.text, r.raw_page, r.heading_style) for r in rows] == [("Kept", 1, True), ("After", 2, False), ("Splithere", 2, False), ("Plain", 3, False), ("top | x", 3, False), ("top | y | z", 3, False)]


BLOCKS = "doc_id long, ord int, block_id string, page int, section string, text string, language string, content_class string, block_type string, ignored boolean, revision_id string, effective_date string, table_id string, row_index int, col_index int, y0 double, y1 double"


def test_pairing_in_stages(spark):
    def block(i, page, text, language, kind="paragraph", content="bilingual_prose"):
        return (1, i, f"b{i}", page, "4.1", text, language, content, kind, False, None, None, None, None, None, None, None)

    zh, en = "质量管理体系文件应当受控并保持最新状态。", "The documents of the quality management system shall be controlled and kept up to date at all times"
    rows = [
        block(0, 1, "杂项 Other small words", "mixed"), block(1, 1, zh, "zh"), block(2, 1, zh, "zh"), block(3, 1, en, "en"), block(4, 1, en + " by the owner.", "en"),
        block(20, 3, "供应商评价记录应当保存五年。", "zh"), block(40, 4, "Records of supplier evaluation shall be kept for five years.", "en"),
        block(60, 8, "孤立的一段文字没有对应。", "zh"), block(70, 12, "A lonely line of text.", "en"), block(71, 12, "ISO list", "en", content="regulatory_references"), block(72, 12, "", "en"), block(73, 12, "nothing", "unknown"),
    ]
    said = [(1, "b1", en), (1, "b2", en + " by the owner."), (1, "b20", "Records of supplier evaluation shall be kept for five years.")]
    got = pair_blocks(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame(said, "doc_id long, block_id string, translation string")).orderBy("position").collect()
    assert [(r.source_block_ids, r.method, r.status) for r in got] == [
        (["b0"], "translated_chinese_similarity", "uncertain"), (["b1", "b2", "b3", "b4"], "consecutive_paragraph_group", "confirmed"), (["b20", "b40"], "translated_chinese_similarity", "confirmed"),
        (["b60"], "translated_chinese_similarity", "missing_english"), (["b70"], "translated_chinese_similarity", "missing_chinese"), (["b71"], "translated_chinese_similarity", "unpaired"), (["b73"], "translated_chinese_similarity", "unpaired"),
    ]
    assert got[0].chinese_text == "杂项" and got[0].english_text == "Other small words" and got[0].score == 0.74
    assert got[2].semantic == pytest.approx(1.0) and got[2].should_check and not got[5].should_check
    empty = pair_blocks(spark.createDataFrame([], BLOCKS), spark.createDataFrame([], "doc_id long, block_id string, translation string"))
    assert empty.count() == 0 and set(empty.columns) == set(got[0].asDict())


def test_bags_and_table_history(spark):
    rows = spark.createDataFrame([("a b a 7.1.2 a", "a a c 7.1.2"), ("", "x"), ("x", "")], "l string, r string")
    for r in rows.select(S.token_recall("l", "r").alias("x"), S.bag_recall(S.token_bag("l"), S.token_bag("r")).alias("y")).collect():
        assert r.x == r.y
    tables = [(1, "h", 0, ["A", "new", "2020-01-02"]), (1, "h", 1, ["B", "more", ""]), (1, "n", 0, ["A", "new", "2020-01-02"]), (1, "n", 1, ["bb", "", ""]), (1, "m", 0, ["QSP0401 8.2.1", "1", "2", "3", "4", "5"])]
    got = {r.table_id: r.content_class for r in layout.table_class(spark.createDataFrame(tables, "doc_id long, table_id string, row_index int, cells array<string>")).collect()}
    assert got == {"h": "change_history", "n": "bilingual_prose", "m": "regulatory_matrix"}


def test_ranges_and_choices_that_fail(spark):
    blocks = spark.createDataFrame([(1, "a"), (3, "b")], "page int, name string")
    assert report.page_range(blocks, 2).count() == 1
    for bad in (lambda: report.page_range(blocks, 3, 2), lambda: report.page_range(blocks, 4, 5), lambda: report.selected(blocks, "c")):
        with pytest.raises(ValueError):
            bad()


def test_ai_boundary(spark):
    asked = spark.createDataFrame([("k1", "{}"), ("k2", "{}")], "key string, payload string")
    cache = spark.createDataFrame([("k1", '{"items": []}')], "key string, answer string")
    got = {r.key: (r.answer, r.source) for r in ai.answers(asked, lambda _: "not json", cache).collect()}
    assert got == {"k1": ('{"items": []}', "cache"), "k2": (None, "call")}
    rows = ai.parsed(spark.createDataFrame([("a", "```json\n{\"items\": [{\"x\": 1}]}\n```"), ("b", None)], "key string, answer string"), "struct<x:int>").orderBy("key").collect()
    assert rows[0].item.x == 1 and rows[0].violation is None and rows[1].violation == "no answer"


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "doc_id long, page int, ord int, block_type string, text string")
    assert layout.mark_furniture(empty).count() == 0
    assert layout.near_duplicates(empty).count() == 0
    assert layout.gated_sections(empty.select("doc_id", "ord", F.col("text").alias("candidate")), layout.staged_gate).count() == 0


def test_sinks(spark, tmp_path):
    from lectern.sources import sinks

    df = spark.createDataFrame([(1, ["a", "b"])], "id int, tags array<string>")
    for form in sinks.FORMATS:
        path = sinks.write_tables({"t": df}, str(tmp_path / form), form)["t"]
        back = spark.read.option("header", "true").format(form).load(path)
        assert back.count() == 1 and set(back.columns) == {"id", "tags"}
    with pytest.raises(ValueError):
        sinks.write_tables({}, str(tmp_path), "xls")


def test_best_lines_against_all_pairs(spark):
    words = [f"{a}{b}" for a in ("con", "doc", "pro", "re", "sup") for b in ("trol", "ument", "cess", "view", "plier", "cord")]
    items = [(i, " ".join(words[(i * 7 + j * (i + 1)) % 30] for j in range(5 + 5 * i))) for i in range(5)] + [(9, ""), (10, "zzz qqq")]
    edited = [" ".join(w if j % 8 else w[::-1] for j, w in enumerate(t.split())) for _, t in items]
    reordered = [" ".join(sorted(t.split(), key=lambda w: w[::-1])) for _, t in items]
    lines = [(n, n % 3, t) for n, t in enumerate(edited + reordered[:3] + [" ".join(words[n % 30 : n % 30 + 9]) for n in range(60)] + [reordered[4], reordered[4], "", "controls documents processes reviewed"])]
    df = spark.createDataFrame(lines, "doc_id long, pos int, line string").repartition(3)
    want = {}
    for k, t in items:
        score, d, p = max((S.token_set_ratio(t, x), -d, -p) for d, p, x in lines)
        if score >= 65:
            want[k] = (-d, -p, score)
    got = {}
    for r in pairing.best_lines(df, items, {0: want[0][2]}).collect():
        got[r.item_id] = max(got.get(r.item_id, (0, 0, 0)), (r.score, -r.doc_id, -r.pos))
    assert {k: (-d, -p, s) for k, (s, d, p) in got.items()} == want and set(want) == {0, 1, 2, 3, 4, 10}


def test_fuzzy_best_without_shared_windows(spark, tmp_path):
    item = " ".join(f"Word{i}x" for i in range(24))
    texts = {1: "nothing alike stands in this line of more than thirty characters", 2: " ".join("other" if i % 8 == 7 else w for i, w in enumerate(item.lower().split()))}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.QUERIES["q_fuzzy_best"](spark, str(tmp_path)).collect()
    assert [(r.item_id, r.doc_id, r.pos, r.score) for r in got] == [(7, 2, 0, S.token_set_ratio(item.lower(), texts[2]))] and got[0].score > 90
