"""Line dedup in native DataFrame functions.

A text is split at ``\\n``; a line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of
``least_chars`` code points or more found in ``least_docs`` documents or more lose all their lines, except in the largest
doc_id that holds them. The other lines stay in their order.

Steps: lines with long keys are exploded once to (document, position, two 64-bit hashes of the key) and written to the shared
folder, without their text. Documents are counted per hash: ``count_distinct`` first shuffles by hash *and* document and counts
on the map side, so a line that a third of all documents hold is no hot key. Keys over the threshold, one row each, meet the
lines again; only the side with many rows of a key is large there, which adaptive execution splits. Positions to drop come back
as one array per document, taken from its own lines, and the text is put together again by position inside its row.

Defined cases: a null or empty text is one empty line. Rows that repeat an id are one document for counts and each keeps its
own lines; rows without an id count as one document below all others. If all lines go, the text is empty. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.session import cut_lineage, shared_folder

#: White space at the ends of a line.
ENDS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def long_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, ``version`` (hash of the row's text), ``pos`` and two hashes of each line with a long key."""
    # the outer form infers no filter on the array's size, which would split each text twice
    lines = rows.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode_outer(lines_of(F.col("text"))).alias("pos", "line"))
    cut = lines.select("doc_id", "version", "pos", F.btrim("line", F.lit(ENDS)).alias("line")).where(F.char_length("line") >= least_chars)
    keyed = cut.select("doc_id", "version", "pos", F.translate("line", string.ascii_uppercase, string.ascii_lowercase).alias("key"))
    return keyed.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """doc_id, ``n_lines`` before dropping, ``n_dropped``, and the ``text`` of the lines that stay; one row per row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = long_lines(rows, least_chars)
    folder = shared_folder(spark, "line-hashes")
    found.write.parquet(folder)
    held = spark.read.schema(found.schema).parquet(folder)
    counts = held.groupBy("h1", "h2").agg(
        F.count_distinct("doc_id").alias("ids"), F.max("doc_id").alias("keeper"), F.max(F.col("doc_id").isNull().cast("int")).alias("blank")
    )
    # cut off from the counts' own shuffle: a join splits hot keys only where both sides are shuffled for it
    common = cut_lineage(counts.where(F.col("ids") + F.col("blank") >= least_docs).select("h1", "h2", "keeper"))
    gone = held.join(common, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("gone")).withColumnRenamed("doc_id", "gone_id")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("version"))
    split = rows.join(gone, same, "left").select("doc_id", "text", "gone", lines_of(F.col("text")).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    return split.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(text).alias("text"),
    )
