"""Registered queries of the numbered operators, each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import binary, bpe, compression, digest, extract, langid, linededup, mixing, periodic, quality, simhash, toxicity, whiten
from vellumine.llm.common import WORD, id_bucket
from vellumine.session import read_table, shared_folder


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.coded_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    found = langid.identify(docs, langid.learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.digests(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality_rules(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(id_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    found = toxicity.severity(docs, toxicity.learn(docs, labels.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", "severity", "grade", "predicted")


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read_table(spark, sf_dir, "pages"))


def op10_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-shards")
    binary.write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return binary.read_documents(spark, folder)


def looped(docs: DataFrame) -> DataFrame:
    """The documents, where those with a crc32 of the id that ends in 0 repeat a stretch of their words up to their end."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(crc % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})")))
    found = docs.select("doc_id", "text", F.floor(crc / 10).cast("long").alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    a = F.col("g") % F.col("n")
    placed = found.withColumn("a", F.when(F.col("n") > 0, a.cast("int"))).withColumn(
        "p", F.when(F.col("n") > 0, (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    )
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get(F.col("words"), place(i))), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(looped(read_table(spark, sf_dir, "documents")))
    ratio = lambda x, y: y["length"] * x["period"] - x["length"] * y["period"]  # noqa: E731  below 0: x repeats more often
    order = lambda x, y: F.coalesce(
        *[F.when(d < 0, -1).when(d > 0, 1) for d in (ratio(x, y), x["start"] - y["start"], x["period"] - y["period"])], F.lit(0)
    )
    best = F.get(F.array_sort("runs", order), 0)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start"), F.col("best.length"), F.col("best.period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op13_line_dedup": """
        WITH lines AS (
            SELECT doc_id, pos, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (
                SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
                FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
            )
        ), common AS (
            SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), judged AS (
            SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN common USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
}

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_simhash, op3_bpe, op4_language, op5_digest, op6_quality, op7_compression, op8_toxicity, op9_extract,
        op10_binary, op11_periodic_runs, op12_whiten, op13_line_dedup,
    )
}
