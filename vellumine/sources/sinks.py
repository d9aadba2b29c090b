"""Sinks: chunk tables, Markdown and JSON documents, log exports, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMOTED = ("hierarchy_path", "section_title", "has_table", "char_length")


def promote_metadata(chunks: DataFrame, metadata: str = "metadata") -> DataFrame:
    """The four common metadata keys as columns of their own; ``metadata`` is a struct or string map."""
    kind = chunks.schema[metadata].dataType
    have = set(kind.names) if kind.typeName() == "struct" else set(PROMOTED)
    return chunks.select("*", *[(F.col(metadata)[k] if k in have else F.lit(None)).alias(k) for k in PROMOTED])


def write_chunks(chunks: DataFrame, path: str, key: str = "doc_id", buckets: int = 64, fmt: str = "parquet") -> None:
    """Chunk table partitioned by a hash bucket of the document, so a delete or rebuild touches few
    files and no document becomes a folder of its own."""
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    chunks.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").format(fmt).save(path)


def markdown_documents(chunks: DataFrame, key: str = "doc_id", order: str = "num") -> DataFrame:
    """(key, markdown): titles become second-level headings, the rest stays, in chunk order."""
    line = F.when(F.col("type") == "title", F.concat(F.lit("## "), "content")).otherwise(F.col("content"))
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("_r"))
    return rows.select(key, F.array_join(F.transform("_r", lambda r: r["line"]), "\n\n").alias("markdown"))


def json_documents(chunks: DataFrame, key: str = "doc_id", order: str = "num") -> DataFrame:
    """(key, json): the chunks of a document as one JSON array."""
    cols = [c for c in chunks.columns if c not in (key, order)]
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("_r"))
    return rows.select(key, F.to_json("_r").alias("json"))


def export_logs(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """JSON lines or CSV with a header, one file per partition."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def split_good_bad(rows: DataFrame, good: Column, good_path: str, bad_path: str) -> None:
    rows.where(good).write.mode("append").parquet(good_path)
    rows.where(~F.coalesce(good, F.lit(False))).write.mode("append").parquet(bad_path)


def write_report(report: DataFrame, path: str, title: str, max_rows: int = 1000) -> str:
    """JSON of an aggregated report, and its Markdown table; only the aggregate reaches the driver."""
    report.write.mode("overwrite").json(f"{path}/json")
    rows = report.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"report has over {max_rows} rows; aggregate it first")
    head = "| " + " | ".join(report.columns) + " |\n|" + "---|" * len(report.columns)
    body = "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)
    text = f"# {title}\n\n{head}\n{body}\n"
    report.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
    return text
