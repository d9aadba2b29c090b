"""File sources: documents, catalogues, chunk files and evaluation sets as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions.text import html_to_text

# Encodings tried in order.
ENCODINGS = ("utf-8", "gbk", "gb2312", "utf-16", "latin1")


def scan_documents(spark: SparkSession, folder: str, extensions: Sequence[str]) -> DataFrame:
    """(path, name, size, modified) of matching files below ``folder``, each path once, sorted.

    The content column is never selected, so files are listed, not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    rows = files.where(ext.isin(*[e.lower().lstrip(".") for e in extensions])).dropDuplicates(["path"])
    return rows.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    ).orderBy("path")


def list_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Local listing of Markdown files: id is the stem, size in KB, sorted by name."""
    rows = scan_documents(spark, folder, ["md"])
    return rows.select(F.regexp_replace("name", "\\.[^.]+$", "").alias("id"), "name", F.round(F.col("size") / 1024, 2).alias("size_kb")).orderBy("name")


def read_text(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content): one row per UTF-8 text or Markdown file, with file metadata."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return with_metadata(reader.text(path, wholetext=True).withColumnRenamed("value", "content"))


def with_metadata(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds path, name, format, size, modification time and content length."""
    meta = F.col("_metadata")
    return df.select(
        meta["file_path"].alias("path"), meta["file_name"].alias("name"),
        F.lower(F.regexp_extract(meta["file_name"], "\\.([^.]+)$", 1)).alias("format"),
        meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified"),
        content, F.length(content).alias("content_length"),
    )


def read_text_any_encoding(spark: SparkSession, path: str, glob: str = "*.txt", encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """(path, content, encoding): the first encoding that decodes wins."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)

    def decode(raw: bytes) -> tuple[str | None, str | None]:
        for name in encodings:
            try:
                return raw.decode(name), name
            except UnicodeDecodeError:
                continue
        return None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [decode(bytes(raw)) for raw in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "content": [t for t, _ in found], "encoding": [e for _, e in found]})

    return files.select("path", "content").mapInPandas(run, "path string, content string, encoding string")


def _parsed(rows: DataFrame, parse: Callable[[str], str]) -> DataFrame:
    """(path, content, error): a file that can't be parsed is a row with its error, and no content."""

    def one(value: str) -> tuple[str | None, str | None]:
        try:
            return parse(value), None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(v) for v in batch["value"]]
            yield pd.DataFrame({"path": batch["path"], "content": [c for c, _ in found], "error": [e for _, e in found]})

    return rows.mapInPandas(run, "path string, content string, error string")


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, error): every non-empty row re-joined with commas, rows with newlines.

    A CSV file is read whole as one row: it is one document, as large as its text.
    """
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def parse(value: str) -> str:
        import csv
        import io

        return "\n".join(",".join(r) for r in csv.reader(io.StringIO(value)) if any(c.strip() for c in r))

    return _parsed(rows, parse)


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, error): JSON files in a canonical two-space layout."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def parse(value: str) -> str:
        import json

        return json.dumps(json.loads(value), ensure_ascii=False, indent=2)

    return _parsed(rows, parse)


def read_html_text(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), html_to_text(F.col("value")).alias("content"))


def read_xml_outline(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, error): an indented outline of tags and texts, depth first, tail text kept."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def outline(xml: str) -> str:
        import xml.etree.ElementTree as et

        out: list[str] = []
        stack = [(et.fromstring(xml), 0, False)]
        while stack:
            node, depth, done = stack.pop()
            pad = "  " * depth
            if done:
                if node.tail and node.tail.strip():
                    out.append(pad + node.tail.strip())
                continue
            out.append(f"{pad}{node.tag}:")
            if node.text and node.text.strip():
                out.append(f"{pad}  {node.text.strip()}")
            stack.append((node, depth, True))
            stack += [(child, depth + 1, False) for child in reversed(node)]
        return "\n".join(out)

    return _parsed(rows, outline)


# --- catalogues -----------------------------------------------------------------------------

DOCUMENT = "struct<id:string,name:string,size:bigint,status:string,upload_time:string,chunk_count:int,category:string,tags:array<string>,file_path:string>"
VERSION = "struct<version_id:string,document_id:string,version:string,created_at:string,changes:string,file_path:string>"
HISTORY = "struct<history_id:string,action:string,document_id:string,document_name:string,user_id:string,timestamp:string,details:string>"
CHUNK = (
    "struct<id:string,document_id:string,num:int,content:string,text:string,length:int,embedding_status:string,embedding_dimension:int,"
    "document_name:string,document:string,hierarchy_path:array<string>,section_title:string,has_table:boolean,char_length:int>"
)
CASE = (
    "struct<id:string,category:string,query:string,description:string,expected_keywords:array<string>,expected_topics:array<string>,"
    "difficulty:string,ground_truth:string>"
)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue map id -> record as rows, upload time parsed."""
    rows = _json(spark, path, f"map<string,{DOCUMENT}>").select(F.explode("j").alias("key", "d")).select("d.*")
    return rows.withColumn("upload_time", F.col("upload_time").cast("timestamp_ntz"))


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, f"map<string,array<{VERSION}>>").select(F.explode("j").alias("key", "vs")).select(F.explode("vs").alias("v"))
    return rows.select("v.*").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, f"array<{HISTORY}>").select(F.explode("j").alias("h")).select("h.*")
    return rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def backfill(df: DataFrame) -> DataFrame:
    """Old rows name their columns text and document."""
    rows = df.withColumn("content", F.coalesce("content", "text")).withColumn("document_name", F.coalesce("document_name", "document"))
    return rows.drop("text", "document")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files flattened, old names back-filled, empty contents dropped."""
    rows = _json(spark, path, f"struct<document_id:string,chunks:array<{CHUNK}>>").select("j.document_id", F.explode("j.chunks").alias("c"))
    flat = rows.select(F.coalesce("c.document_id", "document_id").alias("document_id"), *[F.col(f"c.{f}").alias(f) for f in _fields(CHUNK) if f != "document_id"])
    return backfill(flat).where(F.coalesce(F.trim("content"), F.lit("")) != "")


def _fields(struct: str) -> list[str]:
    import re

    return re.findall(r"(\w+):", struct)


def truth_array(col: Column) -> Column:
    """Ground truth as array: the field holds a text or a JSON list."""
    return F.when(col.rlike("^\\s*\\["), F.from_json(col, "array<string>")).when(col.isNotNull(), F.array(col)).otherwise(F.array().cast("array<string>"))


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of both arrays of a dataset file."""
    schema = f"struct<retrieval_test_cases:array<{CASE}>,retrieval_test_cases_part2:array<{CASE}>>"
    none = F.array().cast(f"array<{CASE}>")
    rows = _json(spark, path, schema).select(
        F.explode(F.concat(F.coalesce("j.retrieval_test_cases", none), F.coalesce("j.retrieval_test_cases_part2", none))).alias("c")
    )
    return rows.select("c.*").withColumn("ground_truth", truth_array(F.col("ground_truth")))
