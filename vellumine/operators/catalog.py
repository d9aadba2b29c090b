"""Document catalogue: status, versions, reconciliation with storage, integrity, job ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.operators.scale import top_k


def list_documents(docs: DataFrame, status: str | None = None) -> DataFrame:
    return docs if status is None else docs.where(F.col("status") == status)


def refresh_status(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Status and chunk count from the chunk and vector tables: indexed, split or pending; errors stay."""
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    rows = docs.drop("chunk_count").join(n(chunks, "chunk_count"), key, "left").join(n(vectors, "vector_count"), key, "left")
    rows = rows.fillna(0, ["chunk_count", "vector_count"])
    state = (
        F.when(F.col("status") == "error", "error")
        .when((F.col("chunk_count") > 0) & (F.col("vector_count") >= F.col("chunk_count")), "indexed")
        .when(F.col("chunk_count") > 0, "split")
        .otherwise("pending")
    )
    return rows.withColumn("status", state)


def delete_documents(docs: DataFrame, doomed: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(doomed.select(key), key, "left_anti")


def deletion_count(docs: DataFrame, doomed: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(doomed.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def version_key(version: Column) -> Column:
    """Sortable struct of an ``a.b.c`` version."""
    parts = F.split(version, "\\.")
    return F.struct(*[F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)).alias(n) for i, n in enumerate(("major", "minor", "patch"))])


def bump_version(version: Column) -> Column:
    parts = F.split(version, "\\.")
    return F.concat_ws(".", parts[0], parts[1], (parts[2].cast("int") + 1).cast("string"))


def latest_versions(versions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The highest version of each document: an aggregate, not a sort of its history."""
    cols = [c for c in versions.columns if c != key]
    best = versions.groupBy(key).agg(F.max_by(F.struct(*cols), version_key(F.col("version"))).alias("_v"))
    return best.select(key, "_v.*")


def update_versions(versions: DataFrame, updates: DataFrame, key: str = "doc_id") -> DataFrame:
    """Version rows with one patch bump per updated document appended; ``updates`` has key, created_at, changes."""
    latest = latest_versions(versions, key).select(key, "version")
    new = updates.join(latest, key, "left").withColumn(
        "version", F.when(F.col("version").isNull(), "1.0.0").otherwise(bump_version(F.col("version")))
    )
    return versions.unionByName(new, allowMissingColumns=True)


def rollback(docs: DataFrame, versions: DataFrame, target: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with the file of the asked version; ``target`` has key and version."""
    wanted = versions.join(target.select(key, "version"), [key, "version"]).select(key, F.col("version").alias("_v"), F.col("file_path").alias("_p"))
    rows = docs.join(wanted, key, "left")
    return rows.withColumn("version", F.coalesce("_v", "version")).withColumn("file_path", F.coalesce("_p", "file_path")).drop("_v", "_p")


def reconcile(files: DataFrame, docs: DataFrame, on: str = "name") -> DataFrame:
    """(name, doc_id, action): added, removed, updated or unchanged, by one full outer join.

    Empty files are skipped; the id of a file is the digest of its name.
    """
    left = files.where(F.col("size") > 0).select(on, F.col("size").alias("f_size"), F.col("mtime").alias("f_mtime"))
    right = docs.select(on, F.col("size").alias("d_size"), F.col("mtime").alias("d_mtime"))
    both = left.join(right, on, "full_outer")
    changed = (F.col("f_size") != F.col("d_size")) | (F.col("f_mtime") > F.col("d_mtime"))
    action = (
        F.when(F.col("d_size").isNull(), "added").when(F.col("f_size").isNull(), "removed").when(changed, "updated").otherwise("unchanged")
    )
    return both.select(on, F.md5(F.col(on).cast("binary")).alias("doc_id"), action.alias("action"))


def orphans(docs: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """Documents without a path or whose file is missing."""
    gone = docs.where(F.col(path).isNotNull()).join(files.select(path).distinct(), path, "left_anti")
    return docs.where(F.col(path).isNull()).unionByName(gone)


def integrity(docs: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Six checks, counts and a status per document: healthy, warning, error or pending."""
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    rows = (
        docs.join(files.select(key, F.lit(True).alias("has_file"), F.col("size").alias("file_size")), key, "left")
        .join(n(chunks, "chunks"), key, "left")
        .join(n(vectors, "vectors"), key, "left")
        .fillna(0, ["chunks", "vectors", "file_size"])
        .fillna(False, ["has_file"])
    )
    checked = rows.select(
        key,
        "chunks",
        "vectors",
        F.col("has_file").alias("file_exists"),
        (F.col("file_size") == F.col("size")).alias("size_matches"),
        (F.col("chunks") > 0).alias("has_chunks"),
        (F.col("vectors") > 0).alias("has_vectors"),
        (F.col("chunks") == F.col("vectors")).alias("counts_match"),
        (F.coalesce("chunk_count", F.lit(0)) == F.col("chunks")).alias("catalog_matches"),
        "status",
    )
    health = (
        F.when(~F.col("file_exists"), "error")
        .when(F.col("status") == "pending", "pending")
        .when(F.col("size_matches") & F.col("has_chunks") & F.col("has_vectors") & F.col("counts_match") & F.col("catalog_matches"), "healthy")
        .otherwise("warning")
    )
    return checked.withColumn("health", health)


def integrity_summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("health").agg(F.count(F.lit(1)).alias("documents"))


def status_tally(docs: DataFrame, status: str = "status") -> DataFrame:
    c = F.col(status)
    return docs.agg(
        F.count_if(c == "indexed").alias("success"), F.count_if(c == "split").alias("processing"),
        F.count_if(c == "pending").alias("pending"), F.count_if(c == "error").alias("error"),
    )


def recent_history(history: DataFrame, n: int = 1000, ts: str = "timestamp", key: str = "history_id") -> DataFrame:
    """Newest ``n`` rows: a partial top-n per task, then a merge of at most ``n`` rows each."""
    return history.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def keep_recent(rows: DataFrame, n: int, ts: str, key: str) -> DataFrame:
    """Retention by count. The cut-off is found on (ts, key) only, so wide rows are not sorted."""
    edge = rows.select(ts, key).orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)
    cut = edge.agg(F.min(F.struct(ts, key)).alias("m")).select(F.col("m").alias("_cut"))
    return rows.join(F.broadcast(cut), F.struct(ts, key) >= F.col("_cut"), "left_semi")


def keep_days(rows: DataFrame, days: int, ts: str, now: Column | None = None) -> DataFrame:
    """Retention by age, from ``now`` or the newest row."""
    if now is None:
        newest = rows.agg(F.max(ts)).first()[0]
        now = F.lit(newest).cast(rows.schema[ts].dataType)
    return rows.where(F.col(ts) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def intake(rows: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Batch update intake: rows with id and content are pending, others carry an error."""
    problem = F.when(F.col(key).isNull(), "missing id").when(F.coalesce(F.trim(F.col(content)), F.lit("")) == "", "missing content")
    return rows.withColumn("error", problem).withColumn("status", F.when(problem.isNull(), "pending").otherwise("error"))


def upload_check(files: DataFrame, name: str = "name", size: str = "size", extensions=S.UPLOAD_EXTENSIONS, limit: int = S.UPLOAD_MAX_BYTES) -> DataFrame:
    """accepted or error with a message, by extension and size."""
    ext = F.lower(F.regexp_extract(F.col(name), "\\.([^.]+)$", 1))
    problem = F.when(~ext.isin(*extensions), F.concat(F.lit("unsupported file type: "), ext)).when(F.col(size) > limit, "file too large")
    return files.withColumn("message", problem).withColumn("status", F.when(problem.isNull(), "accepted").otherwise("error"))


# Steps of a document job in order.
JOB_STEPS = ["file_saved", "parsed", "chunked", "vectorized"]


def recovery_actions(ledger: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Unfinished jobs with the action to take: complete, roll back or manual.

    All steps done but not closed: complete. Some steps done: roll back if the document is
    still known, else manual. Nothing done: roll back.
    """
    open_jobs = ledger.where(F.col("status").isin("pending", "in_progress", "failed"))
    known = docs.select(key, F.lit(True).alias("_known"))
    rows = open_jobs.join(known, key, "left")
    done = F.size(F.array_intersect("completed_steps", F.array(*[F.lit(s) for s in JOB_STEPS])))
    action = F.when(done == len(JOB_STEPS), "complete").when((done > 0) & F.col("_known").isNull(), "manual").otherwise("rollback")
    return rows.withColumn("action", action).drop("_known")


def purge_ledger(ledger: DataFrame, days: int, now: Column) -> DataFrame:
    """Drop finished jobs older than ``days``."""
    final = F.col("status").isin("completed", "rolled_back")
    return ledger.where(~(final & (F.col("updated_at") < now - F.expr(f"INTERVAL {int(days)} DAYS"))))


def version_history(versions: DataFrame, key: str = "doc_id", keep: int = 10) -> DataFrame:
    """Last ``keep`` versions per document, newest first."""
    k = version_key(F.col("version"))
    return top_k(versions, [key], [k.desc()], keep, "age")

