"""Incremental document ingest: new and changed documents are cleaned, chunked, encoded and appended as versions.

Tables under one folder, each partitioned by micro-batch: ``chunks``, ``vectors`` and ``digests``. A document's newest digest
names its live batch; rows of its older batches are superseded and no longer read, and a document whose text is null is a
tombstone. ``compact`` copies what is live to a new folder, in which the stream can go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumine.plans.ingest import ingest, with_vectors

DIGESTS = "doc_id bigint, digest string, batch bigint"


def read_document_stream(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def newest(digests: DataFrame) -> DataFrame:
    """(doc_id, digest, batch) of each document's newest version; a map-side aggregate over a narrow table."""
    last = digests.groupBy("doc_id").agg(F.max_by("digest", "batch").alias("digest"), F.max("batch").alias("batch"))
    return last


def start_ingest(
    docs: DataFrame, out: str, state: str, *, strategy: str = "char", preset: str = "minimal", encode: Callable[[Column], Column] | None = None,
    version: str | None = None,
) -> StreamingQuery:
    """Run all available documents once and stop; rerunning picks up only what is new.

    A document whose newest stored digest is the same is skipped; one that goes back to an older text is taken again. Of several
    texts of a document in one micro-batch the one with the greatest ``version`` (a column) stays, or of the greatest digest. A
    batch compares with digests of earlier batches alone, so one that is run again after a failure sees nothing of its own
    first run and overwrites it. ``encode`` also writes vectors of the chunks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marked = batch.withColumn("digest", F.sha2("text", 256))
        order = F.struct(*([F.col(version)] if version else []), F.col("digest"))
        rows = F.struct(*marked.columns)
        fresh = marked.groupBy("doc_id").agg(F.max_by(rows, order).alias("r")).select("r.*")
        if batch_id > 0:
            seen = newest(spark.read.schema(DIGESTS).parquet(f"{out}/digests").where(F.col("batch") < batch_id)).select("doc_id", F.col("digest").alias("_old"))
            fresh = fresh.join(seen, "doc_id", "left").where(F.col("_old").isNull() | ~F.col("digest").eqNullSafe(F.col("_old"))).drop("_old")
        chunks = ingest(fresh.where("text IS NOT NULL"), strategy=strategy, preset=preset, keep=["digest"])
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={batch_id}")
        if encode is not None:
            stored = spark.read.schema(chunks.schema).parquet(f"{out}/chunks/batch={batch_id}")
            with_vectors(stored, encode).select("doc_id", "num", "embedding").write.mode("overwrite").parquet(f"{out}/vectors/batch={batch_id}")
        fresh.select("doc_id", "digest").write.mode("overwrite").parquet(f"{out}/digests/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def read_live(spark: SparkSession, out: str, table: str = "chunks") -> DataFrame:
    """Rows of every document's newest version. Only superseded versions, few beside the rows, meet them in an anti join."""
    digests = spark.read.schema(DIGESTS).parquet(f"{out}/digests")
    last = newest(digests).select("doc_id", F.col("batch").alias("_last"), F.col("digest").alias("_digest"))
    old = digests.join(last, "doc_id").where((F.col("batch") < F.col("_last")) | F.col("_digest").isNull()).select("doc_id", "batch")
    return spark.read.parquet(f"{out}/{table}").join(old, ["doc_id", "batch"], "left_anti")


def compact(spark: SparkSession, out: str, target: str, tables: tuple[str, ...] = ("chunks",)) -> None:
    """Copy what is live to ``target`` as one batch, the newest; tombstones go. ``out`` stays as it is, so a failed copy is
    made again, and a stream started with ``target`` and the same state goes on there."""
    digests = spark.read.schema(DIGESTS).parquet(f"{out}/digests")
    last = digests.agg(F.max("batch")).first()[0]
    for table in tables:
        read_live(spark, out, table).drop("batch").write.mode("overwrite").parquet(f"{target}/{table}/batch={last}")
    live = newest(digests).where("digest IS NOT NULL").select("doc_id", "digest")
    live.write.mode("overwrite").parquet(f"{target}/digests/batch={last}")
