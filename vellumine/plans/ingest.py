"""Batch ingest: documents to cleaned, labelled, chunked and encoded rows, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions import rules as R
from vellumine.functions import text as X
from vellumine.functions import vectors as V
from vellumine.operators import chunking as C


def ingest(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", preset: str = "minimal", strategy: str = "char",
    title: str | None = None, keep: Sequence[str] = (), limit: int = C.HARD_LIMIT, **category_tables,
) -> DataFrame:
    """Chunk rows of every document: clean, label, split, enforce the hard length limit.

    No shuffle: all steps work on the document's own row.
    """
    cleaned = docs.withColumn(text, X.clean(F.col(text), preset))
    label = R.document_category(F.col(text), None if title is None else F.col(title), **category_tables)
    named = cleaned.withColumn("category", label["category"])
    chunks = C.to_rows(named, C.STRATEGIES[strategy](F.col(text)), key, ["category", *keep])
    return C.enforce_limit(chunks, limit)


def with_vectors(chunks: DataFrame, encode=None, content: str = "content") -> DataFrame:
    """Chunk rows with an embedding; ``encode`` maps a text Column to a vector Column."""

    def stand_in(t: Column) -> Column:
        return V.hashed_text_vector(t)

    return chunks.withColumn("embedding", (encode or stand_in)(F.col(content)))


def build_report(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: documents, built and failed documents, chunks, vectors and the success rate."""
    n = F.count(F.lit(1)).alias("n")
    built = chunks.groupBy(key).agg(n.alias("chunks")).withColumn("built", F.lit(1))
    coded = vectors.groupBy(key).agg(n.alias("vectors"))
    rows = docs.select(key).join(built, key, "left").join(coded, key, "left")
    return rows.agg(
        F.count(F.lit(1)).alias("documents"), F.count("built").alias("built"),
        (F.count(F.lit(1)) - F.count("built")).alias("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("vectors"), F.lit(0)).alias("vectors"), F.round(F.count("built") / F.count(F.lit(1)), 4).alias("rate"),
    )
