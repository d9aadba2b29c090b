"""Chunkers on policy, article, code and table fixtures: nothing lost, limits kept, blocks whole."""

import re

import pytest
from pyspark.sql import functions as F

from vellumine.operators import chunking as C
from vellumine.operators import structure as T

POLICY = "\n".join(
    ["# 报销制度", "总则说明。", "## 第一章 总则", "### 1.1 目的", "规范报销。", "### 1.2 范围", "全体员工。", "### 1.3 附则", "解释权归财务。",
     "## 第二章 差旅", "### 2.1 标准", "| 职级 | 住宿 |", "|---|---|", "| 8-9级 | 300 |", "| 经理 | 500 |", "### 2.2 交通", "高铁二等座。" * 60, "### 2.3 补充", "略。"]
)
ARTICLES = "# 隐私政策\n\n## 第一章 总则\n第一条 短条款甲。\n第二条 短条款乙。\n第三条 " + "长条款内容需要切开。" * 300 + "\n## 第二章 附则\n第四条 收尾。"
CODE = "# API\n## 用户接口\n" + "说明文字。" * 300 + "\nGET /users\n```\n## not a heading\n\nGET /x\n```\n| 参数 | 类型 |\n|---|---|\n| id | int |\nPOST /users\n创建用户。\n## 其他\n完。"


def squeeze(text):
    return re.sub(r"\s+", "", text)


def texts(chunks):
    return [c["text"] if not isinstance(c, str) else c for c in chunks]


@pytest.mark.parametrize("fn", [C.policy_chunks, C.article_chunks, C.hybrid_chunks, C.technical_chunks, C.hr_chunks, C.project_chunks, C.secondary_split, C.naive_merge])
@pytest.mark.parametrize("doc", [POLICY, ARTICLES, CODE], ids=["policy", "articles", "code"])
def test_nothing_lost(one, fn, doc):
    joined = squeeze("".join(texts(one(fn, doc))))
    assert sorted(joined) == sorted(squeeze(doc))


LEVELS = "# 制度\n导言一句。\n## 小节\n正文在前\n| 职级 | 元 |\n|---|---|\n| 8-9级 | 300 |\n| 实习生 | 90 |\n尾注在后\n## 末节\n收尾。"


@pytest.mark.parametrize("fn", [C.expense_chunks, C.expense_chunks_legacy, C.product_chunks, C.qa_pairs, C.table_chunks])
@pytest.mark.parametrize("doc", [POLICY, ARTICLES, CODE, LEVELS, "前言\nQ1: 能报吗\nA1: 能\n问题：多久\n30天"], ids=["policy", "articles", "code", "levels", "qa"])
def test_every_line_is_kept(one, fn, doc):
    """Chunkers that repeat headings or context still hold every line; a question loses its own mark only."""
    found = one(fn, doc)
    joined = squeeze("".join(c["question"] + c["answer"] if fn is C.qa_pairs else c["text"] for c in found))
    for line in doc.split("\n"):
        bare = re.sub(r"^(#+|Q\d+[:：]|A\d+[:：]|问题[:：])\s*", "", line)
        assert squeeze(bare) in joined, line


def test_shield_character_survives(one):
    doc = "# a\n## b\nx" + chr(0xE000) + "y" + chr(0xE001) + "0\n| p | q |\n|---|---|\n| 1 | 2 |"
    assert any("x" + chr(0xE000) + "y" + chr(0xE001) + "0" in t for t in texts(one(C.technical_chunks, doc)))


def test_policy_boundaries(one):
    found = one(C.policy_chunks, POLICY)
    assert [(c["kind"], c["chapter_index"]) for c in found] == [("chapter", 1), ("chapter_section", 2), ("section", 2)]
    assert found[1]["has_table"] and found[2]["hierarchy_path"] == ["第二章 差旅", "2.2 交通", "2.3 补充"]


def test_articles(one):
    found = one(C.article_chunks, ARTICLES)
    merged = next(c for c in found if c["articles"] == ["一", "二"])
    assert "第一条" in merged["text"] and merged["chapter"].endswith("总则")
    assert all(len(c["text"]) <= 1500 for c in found if c["kind"].endswith("split"))


def test_code_block_is_whole(one):
    blocks = [c["text"] for c in one(C.technical_chunks, CODE) if "not a heading" in c["text"]]
    assert len(blocks) == 1 and "```\n## not a heading\n\nGET /x\n```" in blocks[0]


def test_force_split(one):
    text = "句子内容。" * 900 + "x" * 4100
    pieces = one(C.force_split, text)
    assert all(len(p) <= 2000 for p in pieces) and "".join(pieces) == text


def test_expense_levels(one):
    doc = "# 差旅\n引言。\n## 住宿\n标准如下\n| 职级 | 元 |\n|---|---|\n| 8-9级 | 300 |\n| 经理 | 500 |\n| 总监 | 800 |\n尾注"
    found = [c for c in one(C.expense_chunks, doc) if c["kind"] == "table"]
    assert [c["level"] for c in found] == ["普通员工/8-9级", "经理/10-11级", "总监及以上/12级"]
    assert "| 经理 | 500 |" in found[1]["text"] and "800" not in found[1]["text"]


def test_expense_legacy(one):
    found = one(C.expense_chunks_legacy, "# 报销\n" + "\n\n".join("段落内容说明文字。" * 20 for _ in range(10)))
    assert len(found) > 1 and all(c["text"].startswith("## 报销") for c in found)


def test_product_overlap(one):
    doc = "# P\n## 功能\n### 细节\n" + "\n\n".join(f"第{i}段" + "内容" * 200 for i in range(12))
    found = texts(one(C.product_chunks, doc))
    assert "第2段" in found[0] and any("第3段" in a and "第3段" in b for a, b in zip(found, found[1:]))


def test_naive_and_small_documents(one):
    assert one(C.naive_merge, "第一段。\n\n第二段。") == ["第一段。\n\n第二段。"]
    assert texts(one(lambda t: C.merge_small(F.array(F.struct(t.alias("text"), F.length(t).alias("size"))), 10), "ab")) == ["ab"]


def test_qa_tables_and_headings(one):
    pairs = one(C.qa_pairs, "Q1: 能报吗\nA1: 能\nQ2: 多久\n30天")
    assert [(p["question"], p["answer"]) for p in pairs] == [("能报吗", "能"), ("多久", "30天")]
    found = one(C.table_chunks, "前文\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n后文")
    assert [c["kind"] for c in found] == ["text", "table", "text"]
    found = one(lambda t: C.heading_sections(t, C.HEADING_MARKS["laws"]), "序\n第一条 甲\n内容\n第二条 乙")
    assert [s["title"] for s in found] == ["", "第一条 甲", "第二条 乙"]


def test_tables(one):
    text = "x\n| a | b |\n|---|---|\n| 1 | 2 |\ny\n甲  乙  丙\n1  2  3\n完"
    found = one(T.extract_tables, text)
    assert [t["rows"] for t in found["tables"]] == [[["a", "b"], ["1", "2"]], [["甲", "乙", "丙"], ["1", "2", "3"]]]
    assert "[TABLE_T1_001]" in found["text"] and "[TABLE_T1_002]" in found["text"]


def test_structure_units(spark):
    doc = "前言\n第一章 总则\n第一条 甲\n内容\n| a | b |\n|---|---|\n| 1 | 2 |\n第二条 乙\n第二章 附则\n第三条 丙"
    df = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    units = T.structure_units(df).orderBy("pos").collect()
    assert [(u["kind"], u["chapter"]) for u in units] == [
        ("text", "未分类"), ("article", "第一章 总则"), ("table", "第一章 总则"), ("article", "第一章 总则"), ("article", "第二章 附则")
    ]
    merged = T.document_units(T.structure_units(df)).select(T.merge_short_units(F.col("units"))).first()[0]
    assert len(merged) == 5


def test_semantic_groups(one):
    v = lambda x, y: F.array(F.lit(x), F.lit(y))
    unit = lambda c, vec: F.struct(F.lit("t").alias("text"), F.lit(c).alias("chapter"), vec.alias("vector"))
    units = F.array(unit("a", v(1.0, 0.0)), unit("a", v(1.0, 0.0)), unit("a", v(0.0, 1.0)), unit("b", v(0.0, 1.0)))
    found = one(lambda _: C.semantic_groups(units, 0.8), "x")
    assert [(g["start"], g["members"], g["similarity"]) for g in found] == [(1, 2, 1.0), (3, 1, 1.0), (4, 1, 1.0)]


def test_chapter_numbers(one):
    assert [one(T.chapter_number, t) for t in ("第三章 x", "第12章", "二、y", "无")] == [3, 12, 2, 1]


def test_position_chunks(spark):
    body = "财务部\n（一）会计核算岗位\n" + "核算内容。" * 60 + "\n（二）出纳岗位\n" + "出纳内容。" * 60
    df = spark.createDataFrame([(1, body, "财务部考核.txt")], "doc_id long, text string, filename string")
    rows = T.position_chunks(df).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["position"]) for r in rows] == [("财务_001", "会计核算"), ("财务_002", "出纳")]
    assert "出纳内容" not in rows[0]["chunk_content"] and "出纳内容" in rows[1]["chunk_content"]


def test_dispatch_falls_back(spark):
    df = spark.createDataFrame([(1, "a。b", "nonsense"), (2, " ", "char"), (3, POLICY, "policy")], "doc_id long, text string, strategy string")
    rows = C.dispatch(df).collect()
    assert {(r["doc_id"], r["used_strategy"], r["error"]) for r in rows if r["doc_id"] < 3} == {(1, "naive", None), (2, "char", "empty document")}
    assert sum(r["doc_id"] == 3 for r in rows) == 3


def test_dispatch_of_custom_and_secondary(spark):
    df = spark.createDataFrame([(1, "a##b\nc##d", "custom"), (2, "x" * 2500, "secondary")], "doc_id long, text string, strategy string")
    rows = C.dispatch(df, delimiters=["##"], children=["\n"]).collect()
    assert [r["content"] for r in rows if r["doc_id"] == 1] == ["a", "b", "c", "d"]
    assert [len(r["content"]) for r in rows if r["doc_id"] == 2] == [2000, 500] and {r["used_strategy"] for r in rows} == {"custom", "secondary"}
