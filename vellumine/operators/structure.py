"""Document structure: units, tables, positions, layout elements, chunk tables and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions import rules as R
from vellumine.functions.text import clean_light, let, strip
from vellumine.operators.chunking import NUMERALS, TABLE_BLOCK, group_pieces, join_text
from vellumine.operators.scale import sliced_row_number

CHAPTER_LINE = f"(?:第[{NUMERALS}]+章|#{{1,2}}\\s)"
ARTICLE_LINE = f"第[{NUMERALS}]+条"
DEFAULT_CHAPTER = "未分类"
# Possessive throughout, so a long line without columns is read once.
ASCII_CELL = "[^\\s|]++(?: [^\\s|]++)*+"
ASCII_ROW = f"[ \\t]*+{ASCII_CELL}(?:[ \\t]{{2,}}+{ASCII_CELL}){{2,}}+[ \\t]*+"


# --- tables ---------------------------------------------------------------------------------


def _cells(line: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(line, sep), strip), lambda c: c != "")


def markdown_tables(text: Column) -> Column:
    """array<struct<raw, rows>>: every Markdown table as header and data rows of trimmed cells."""
    raw = F.regexp_extract_all(text, F.lit(TABLE_BLOCK), 0)

    def parse(t: Column) -> Column:
        ls = F.filter(F.split(t, "\\n"), lambda x: strip(x) != "")
        body = F.filter(ls, lambda x, i: i != 1)
        rows = F.filter(F.transform(body, lambda x: _cells(x, "\\|")), lambda r: F.size(r) > 0)
        return F.struct(t.alias("raw"), rows.alias("rows"))

    return F.transform(raw, parse)


def ascii_tables(text: Column) -> Column:
    """array<struct<raw, rows>>: at least two lines of at least three columns parted by wide gaps."""
    raw = F.regexp_extract_all(text, F.lit(f"(?m)(?:^{ASCII_ROW}(?:\\n|\\z)){{2,}}"), 0)

    def parse(t: Column) -> Column:
        ls = F.filter(F.split(t, "\\n"), lambda x: strip(x) != "")
        return F.struct(t.alias("raw"), F.transform(ls, lambda x: _cells(x, "[ \\t]{2,}")).alias("rows"))

    return F.transform(raw, parse)


def extract_tables(text: Column) -> Column:
    """struct<text, tables>: tables replaced by ``[TABLE_T1_nnn]`` lines, in order of kind and place."""
    table_type = "array<struct<raw:string,rows:array<array<string>>>>"

    def swap(acc: Column, t: Column) -> Column:
        n = F.size(acc["tables"]) + 1
        mark = F.format_string("T1_%03d", n)
        return F.struct(
            F.replace(acc["text"], t["raw"], F.concat(F.lit("\n[TABLE_"), mark, F.lit("]\n"))).alias("text"),
            F.array_append(acc["tables"], F.struct(mark.alias("table_id"), t["rows"].alias("rows"))).alias("tables"),
        )

    def run(body: Column, found: Column, tables: Column) -> Column:
        start = F.struct(body.alias("text"), tables.alias("tables"))
        return F.aggregate(found.cast(table_type), start, swap)

    none = F.array().cast("array<struct<table_id:string,rows:array<array<string>>>>")
    return let(
        run(text, markdown_tables(text), none), lambda first: run(first["text"], ascii_tables(first["text"]), first["tables"])
    )


# --- structure units ------------------------------------------------------------------------


def structure_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per unit (chapter text, article or table), chapter filled forward within the document.

    The document is cut once at chapter, article and table-mark lines; the running chapter is a
    window over the document's own units, never over a larger group.
    """
    heads = f"[ \\t]*(?:{CHAPTER_LINE}|{ARTICLE_LINE}|\\[TABLE_)|(?<=\\])(?=\\n)"
    parts = F.split(F.col("_t.text"), f"\\n(?={heads})|(?<=\\[TABLE_T1_\\d{{3}}\\])\\n")
    cut = docs.select(key, extract_tables(F.col(text)).alias("_t")).select(
        key, F.col("_t.tables").alias("_tables"), F.posexplode(parts).alias("pos", "_part")
    )
    first = strip(F.substring_index("_part", "\n", 1))
    kinds = cut.withColumn("_part", strip("_part")).where(F.col("_part") != "").withColumn("_first", first)
    kinds = kinds.withColumn(
        "kind",
        F.when(F.col("_first").rlike(f"^{CHAPTER_LINE}"), "chapter")
        .when(F.col("_first").rlike(f"^{ARTICLE_LINE}"), "article")
        .when(F.col("_first").rlike("^\\[TABLE_"), "table")
        .otherwise("text"),
    )
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    chapter = F.last(F.when(F.col("kind") == "chapter", F.col("_first")), ignorenulls=True).over(upto)
    table_id = F.regexp_extract("_first", "\\[TABLE_(T\\d+_\\d+)\\]", 1)
    units = kinds.withColumn("chapter", F.coalesce(chapter, F.lit(DEFAULT_CHAPTER))).select(
        key,
        "pos",
        "kind",
        "chapter",
        F.when(F.col("kind") == "article", F.col("_first")).otherwise("").alias("subtitle"),
        F.when(F.col("kind") == "chapter", strip(F.regexp_replace("_part", "^[^\\n]*\\n?", "")))
        .when(F.col("kind") == "table", F.lit("[表格]"))
        .otherwise(F.col("_part"))
        .alias("content"),
        F.when(F.col("kind") == "table", F.filter("_tables", lambda t: t["table_id"] == table_id))
        .otherwise(F.filter("_tables", lambda t: F.lit(False)))
        .alias("tables"),
    )
    return units.where(F.col("content") != "").withColumn(
        "char_count", F.when(F.col("kind") == "table", 0).otherwise(F.length("content"))
    )


def document_units(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """Units of each document as one ordered array: bounded by the document they came from."""
    packed = F.struct(
        "pos", F.col("content").alias("text"), "chapter", "subtitle", F.col("char_count").alias("size"),
        (F.size("tables") > 0).alias("has_table"),
    )
    return units.groupBy(key).agg(F.array_sort(F.collect_list(packed)).alias("units"))


def merge_short_units(units: Column, min_chars: int = 100) -> Column:
    """Adjacent units of one chapter and subtitle merged while the current one is short and table-free."""

    def opens(acc: Column, u: Column) -> Column:
        last = acc["last"]
        same = (u["chapter"] == last["chapter"]) & (u["subtitle"] == last["subtitle"])
        return ~(same & (acc["size"] < min_chars) & ~u["has_table"] & ~last["has_table"])

    def fuse(g: Column) -> Column:
        joined = join_text(g, "\n")
        return let(F.get(g, F.lit(0)), lambda h: h.withField("text", joined).withField("size", F.length(joined)))

    return F.transform(group_pieces(units, opens, join_cost=1), fuse)


def chapter_number(name: Column) -> Column:
    """Chapter number from Chinese or Arabic numerals, 1 when none is found."""
    digits = "一二三四五六七八九十"
    numerals = F.create_map(*[F.lit(x) for i, c in enumerate(digits) for x in (c, i + 1)])
    inside = F.regexp_extract(name, "第([一二三四五六七八九十百千\\d]+)章", 1)
    leading = F.regexp_extract(name, "^([一二三四五六七八九十])[、．.]", 1)
    as_int = F.when(inside.rlike("^[0-9]+$"), inside.cast("int"))
    return F.coalesce(numerals[inside], as_int, numerals[leading], F.lit(1))


def global_chunk_ids(chunks: DataFrame, chapter: Column, slice_by: Column, order: Sequence[str]) -> DataFrame:
    """``CH{chapter}_{n}`` with one corpus-wide counter.

    The counter is exact and not a single-task window: chunks are numbered inside slices of the
    ordering and shifted by the running slice size.
    """
    numbered = sliced_row_number(chunks.withColumn("_all", F.lit(0)), ["_all"], slice_by, [F.col(c) for c in order], "_n")
    return numbered.withColumn(
        "chunk_id", F.format_string("CH%d_%03d", chapter_number(chapter), F.col("_n"))
    ).drop("_n", "_all")


# --- positions ------------------------------------------------------------------------------


def position_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "filename") -> DataFrame:
    """One chunk per position of an assessment document, with its attributes attached."""
    body = F.col(text)
    info = docs.withColumn("_info", R.department_type(body, F.col(name)))
    rows = info.select(
        key, text, "_info", F.posexplode(R.positions(body, F.col("_info.department"))).alias("_i", "_p")
    )
    quoted = F.concat(F.lit("\\Q"), F.col("_p.name"), F.lit("\\E"))
    number = "[（(][一二三四五六七八九十]+[）)]"
    headed = F.concat(
        F.lit(f"(?s)(?:{number}\\s*"), quoted, F.lit("(?:岗位|职位)?|\\n\\s*"), quoted,
        F.lit(f"(?:岗位|职位)?[:：]).*?(?=\\n\\s*{number}|\\z)"),
    )
    section = F.call_function("regexp_extract", body, headed, F.lit(0))
    place = F.call_function("locate", F.col("_p.name"), body)
    window = F.when(
        place > 0, F.substr(body, F.greatest(place - 200, F.lit(1)), F.lit(1700))
    ).otherwise(F.left(body, F.lit(1500)))
    content = F.when(F.length(section) >= 200, section).otherwise(window)
    return rows.select(
        key,
        F.format_string("%s_%03d", F.col("_info.department"), F.col("_i") + 1).alias("chunk_id"),
        F.col("_info.department").alias("doc_source"),
        F.col("_p.name").alias("position"),
        F.col("_p.level").alias("position_level"),
        R.assessment_type(body).alias("assessment_type"),
        F.lit("个人").alias("assessment_scope"),
        F.lit("100%").alias("weight_total"),
        R.evaluator(body).alias("evaluator"),
        R.assessment_frequency(body).alias("frequency"),
        R.grade_scale(body).alias("grade_scale"),
        clean_light(content).alias("chunk_content"),
    )


# --- layout elements ------------------------------------------------------------------------


def bbox_area(bbox: Column) -> Column:
    return (bbox[2] - bbox[0]) * (bbox[3] - bbox[1])


def classify_element(content: Column, bbox: Column) -> Column:
    """``title`` or ``text``: a tall short block with a heading shape or capitals is a title."""
    bare = strip(content)
    tall = ((bbox[3] - bbox[1]) > 20) & (F.length(bare) < 100)
    heading = bare.rlike("^第.*章|^.*[节条款项目]")
    upper = (content == F.upper(content)) & (content != F.lower(content))
    some_upper = content.rlike("\\p{Lu}") & (F.length(bare) < 50)
    return F.when(tall & (heading | upper | some_upper), "title").otherwise("text")


def clean_elements(elements: DataFrame, min_area: float = 100) -> DataFrame:
    """Drop tiny elements and blank text; type the text blocks."""
    kept = elements.where(bbox_area(F.col("bbox")) >= min_area)
    kept = kept.where(F.col("type").isin("image", "table") | (strip(F.coalesce("content", F.lit(""))) != ""))
    typed = F.when(F.col("type").isin("image", "table"), F.col("type")).otherwise(
        classify_element(F.col("content"), F.col("bbox"))
    )
    return kept.withColumn("type", typed)


def reading_order(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``pos``: place of the element by page, then top, then left."""
    w = Window.partitionBy(key).orderBy("page_num", F.col("bbox")[1], F.col("bbox")[0], "id")
    return elements.withColumn("pos", F.row_number().over(w))


def pack_elements_by_section(elements: DataFrame, sections: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Group number grows at each element that holds a section keyword."""
    starts = R.any_of(F.col("content"), sections).cast("int")
    w = Window.partitionBy(key).orderBy("pos")
    running = F.sum(starts).over(w)
    # A leading keyword opens group 0, not a group after an empty one.
    return elements.withColumn("_g", running).withColumn(
        "chunk_no", (F.col("_g") - F.min("_g").over(Window.partitionBy(key))).cast("bigint")
    ).drop("_g")


def pack_elements_by_page(elements: DataFrame, max_pages: int = 1, key: str = "doc_id", page: str = "page_num") -> DataFrame:
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(page))
    return elements.withColumn("chunk_no", F.floor((rank - 1) / max_pages).cast("bigint"))


def pack_elements_by_size(elements: DataFrame, max_size: int = 2000, key: str = "doc_id") -> DataFrame:
    """Ordered elements of a document packed up to ``max_size``; an oversize element stands alone."""
    unit = F.struct("pos", F.length("content").alias("size"), F.col("content").alias("text"), "type", "page_num")
    docs = elements.groupBy(key).agg(F.array_sort(F.collect_list(unit)).alias("_units"))
    groups = group_pieces(F.col("_units"), lambda acc, u: acc["size"] + u["size"] > max_size)
    return docs.select(key, F.posexplode(groups).alias("chunk_no", "_g")).select(
        key, F.col("chunk_no").cast("bigint"), F.explode("_g").alias("_u")
    ).select(key, "chunk_no", "_u.pos", "_u.type", "_u.page_num", F.col("_u.text").alias("content"))


def standard_chunks(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of packed elements with assembled Markdown content; id is ``{type}_{i}``."""
    piece = F.when(F.col("type") == "title", F.concat(F.lit("## "), "content")).when(
        F.col("type") == "image", F.concat(F.lit("![图片]("), F.coalesce("content", F.lit("")), F.lit(")"))
    ).otherwise(F.col("content"))
    row = F.struct("pos", piece.alias("piece"), "type", "page_num")
    chunks = packed.groupBy(key, "chunk_no").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return chunks.select(
        key,
        F.concat_ws("_", F.col("_rows")[0]["type"], F.col("chunk_no").cast("string")).alias("chunk_id"),
        F.col("_rows")[0]["type"].alias("type"),
        F.col("_rows")[0]["page_num"].alias("page"),
        strip(F.array_join(F.transform("_rows", lambda r: r["piece"]), "\n\n")).alias("content"),
    )


# --- chunk tables ---------------------------------------------------------------------------


def merge_selected(chunks: DataFrame, selected: Column, key: str = "doc_id") -> DataFrame:
    """Selected chunks of a document become one: lowest number, contents joined by a blank line."""
    chosen = chunks.where(selected)
    merged = chosen.groupBy(key).agg(
        F.min("num").alias("num"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("num", "content"))), lambda r: r["content"]), "\n\n"
        ).alias("content"),
    )
    return chunks.where(~selected).select(key, "num", "content").unionByName(merged)


def chunk_statistics(chunks: DataFrame, kind: str = "kind", level: str = "level") -> DataFrame:
    """Counts and mean size by type and by exploded level tag, in one pass."""
    labels = F.array_union(
        F.array(F.struct(F.lit("type").alias("dimension"), F.col(kind).alias("label"))),
        F.transform(
            F.filter(F.split(level, ","), lambda x: x != ""),
            lambda x: F.struct(F.lit("level").alias("dimension"), x.alias("label")),
        ),
    )
    rows = chunks.select("length", F.explode(labels).alias("_l")).select("_l.*", "length")
    return rows.groupBy("dimension", "label").agg(
        F.count(F.lit(1)).alias("chunks"), F.round(F.avg("length"), 6).alias("mean_length")
    )


def chunk_violations(chunks: DataFrame, threshold: float = 0.8, id_pattern: str = "^CH\\d+_\\d{3,}$") -> DataFrame:
    """One row per broken rule. Expects chunk_id, chapter, content, articles, tables (arrays) and
    char_count, article_count, avg_similarity, has_table, chunking_reason."""
    strong = F.col("avg_similarity") >= threshold
    checks = {
        "missing_id": F.col("chunk_id").isNull() | (F.col("chunk_id") == ""),
        "blank_chapter": F.coalesce(strip(F.col("chapter")), F.lit("")) == "",
        "blank_content": F.coalesce(strip(F.col("content")), F.lit("")) == "",
        "char_count": F.abs(F.length("content") - F.col("char_count")) > 10,
        "article_count": F.size("articles") != F.col("article_count"),
        "has_table": (F.size("tables") > 0) != F.col("has_table"),
        "similarity_range": ~F.col("avg_similarity").between(0, 1),
        "reason": F.coalesce(F.col("chunking_reason"), F.lit("")).startswith("强") != strong,
        "id_pattern": ~F.col("chunk_id").rlike(id_pattern),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), rule) for rule, test in checks.items()]))
    single = chunks.select("chunk_id", F.explode(broken).alias("rule"))
    repeated = chunks.groupBy("chunk_id").count().where("count > 1").select("chunk_id", F.lit("duplicate_id").alias("rule"))
    return single.unionByName(repeated)
