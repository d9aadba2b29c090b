"""Catalogue queries: documents as the catalogue, vectors and labels as its derived tables, orders
and line items as versions and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.functions.text import similarity_band
from vellumine.operators import catalog as G
from vellumine.workload.registry import query, table


def _id():
    return F.col("doc_id")


def catalogue(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return d.select(
        "doc_id", F.concat("source", F.lit("_"), _id().cast("string"), F.lit(".md")).alias("name"), F.col("n_chars").alias("size"), (_id() % 100).alias("mtime"),
        F.when(_id() % 17 == 0, "error").otherwise("pending").alias("status"), (F.col("n_chars") / 450).cast("bigint").alias("chunk_count"),
        F.when(_id() % 13 != 0, F.concat(F.lit("/data/"), _id().cast("string"))).alias("file_path"), F.lit("1.0.0").alias("version"),
    )


CATALOG = """cat AS (SELECT doc_id, source || '_' || doc_id || '.md' AS name, n_chars AS size, doc_id % 100 AS mtime, CASE WHEN doc_id % 17 = 0 THEN 'error' ELSE 'pending' END AS status,
  trunc(n_chars / 450)::BIGINT AS chunk_count, CASE WHEN doc_id % 13 <> 0 THEN '/data/' || doc_id END AS file_path FROM documents),
  chunks AS (SELECT doc_id, unnest(range(trunc(n_chars / 450)::BIGINT)) AS c FROM documents), vecs AS (SELECT vec_id // 2 AS doc_id FROM embeddings),
  files AS (SELECT source || '_' || doc_id || '.md' AS name, doc_id, CASE WHEN doc_id % 19 = 0 THEN 0 ELSE n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END END AS size, doc_id % 100 + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS mtime,
    '/data/' || doc_id AS file_path FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT url, page_id + 1000000, length(html), 1, url FROM pages)"""


def chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 450).cast("int").alias("n"))
    return d.where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("c"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("doc_id"))


def files(spark, sf):
    d = table(spark, sf, "documents").where(_id() % 5 != 0)
    stored = d.select(
        F.concat("source", F.lit("_"), _id().cast("string"), F.lit(".md")).alias("name"), "doc_id",
        F.when(_id() % 19 == 0, 0).otherwise(F.col("n_chars") + (_id() % 7 == 0).cast("int")).alias("size"), (_id() % 100 + (_id() % 11 == 0).cast("int")).alias("mtime"),
        F.concat(F.lit("/data/"), _id().cast("string")).alias("file_path"),
    )
    p = table(spark, sf, "pages")
    other = p.select(F.col("url").alias("name"), (F.col("page_id") + 1000000).alias("doc_id"), F.length("html").cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime"), F.col("url").alias("file_path"))
    return stored.unionByName(other)


@query("list_by_status", f"WITH {CATALOG} SELECT doc_id, name FROM cat WHERE status = 'error'")
def _list(spark, sf):
    return G.list_documents(catalogue(spark, sf), "error").select("doc_id", "name")


@query(
    "refresh_status",
    f"""WITH {CATALOG}, c AS (SELECT doc_id, count(*) AS chunk_count FROM chunks GROUP BY 1), v AS (SELECT doc_id, count(*) AS vector_count FROM vecs GROUP BY 1),
        j AS (SELECT doc_id, status, coalesce(c.chunk_count, 0) AS chunk_count, coalesce(vector_count, 0) AS vector_count FROM cat LEFT JOIN c USING (doc_id) LEFT JOIN v USING (doc_id))
        SELECT doc_id, chunk_count, CASE WHEN status = 'error' THEN 'error' WHEN chunk_count > 0 AND vector_count >= chunk_count THEN 'indexed' WHEN chunk_count > 0 THEN 'split' ELSE 'pending' END AS status FROM j""",
)
def _refresh(spark, sf):
    return G.refresh_status(catalogue(spark, sf), chunks(spark, sf), vectors(spark, sf)).select("doc_id", "chunk_count", "status")


@query("status_tally", f"WITH {CATALOG} SELECT 0 AS success, 0 AS processing, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'error') AS error FROM cat")
def _tally(spark, sf):
    return G.status_tally(catalogue(spark, sf))


@query("delete_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _delete(spark, sf):
    return G.delete_documents(catalogue(spark, sf), table(spark, sf, "labels").where("toxic = 1")).select("doc_id")


@query("deletion_count", "SELECT count(*) AS deleted FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _deleted(spark, sf):
    return G.deletion_count(catalogue(spark, sf), table(spark, sf, "labels").where("toxic = 1"))


def versions(spark, sf):
    """Line items of an order as versions of a document."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("1.0."), F.col("l_linenumber").cast("string")).alias("version")).agg(
        F.max("l_shipdate").alias("created_at"), F.concat(F.lit("/v/"), F.max("l_partkey").cast("string")).alias("file_path")
    )


VERSIONS = "v AS (SELECT l_orderkey AS doc_id, l_linenumber AS patch, '1.0.' || l_linenumber AS version, max(l_shipdate) AS created_at, '/v/' || max(l_partkey) AS file_path FROM lineitem GROUP BY ALL)"


@query("latest_version", f"WITH {VERSIONS} SELECT doc_id, arg_max(version, patch) AS version, arg_max(file_path, patch) AS file_path FROM v GROUP BY doc_id")
def _latest(spark, sf):
    return G.latest_versions(versions(spark, sf)).select("doc_id", "version", "file_path")


@query(
    "update_versions",
    f"""WITH {VERSIONS}, u AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT doc_id, max(patch) AS patch FROM v GROUP BY 1)
        SELECT doc_id, version FROM v UNION ALL SELECT u.doc_id, coalesce('1.0.' || (patch + 1), '1.0.0') FROM u LEFT JOIN l USING (doc_id)""",
)
def _update(spark, sf):
    updates = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("created_at"))
    return G.update_versions(versions(spark, sf), updates).select("doc_id", "version")


@query("rollback_version", f"WITH {VERSIONS} SELECT o_orderkey AS doc_id, coalesce(v.version, 'none') AS version FROM orders LEFT JOIN v ON v.doc_id = o_orderkey AND v.patch = 2")
def _rollback(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("none").alias("version"), F.lit("/current").alias("file_path"))
    target = docs.select("doc_id", F.lit("1.0.2").alias("version"))
    return G.rollback(docs, versions(spark, sf), target).select("doc_id", "version")


@query("version_history", f"WITH {VERSIONS} SELECT doc_id, version, age FROM (SELECT doc_id, version, row_number() OVER (PARTITION BY doc_id ORDER BY patch DESC) AS age FROM v) WHERE age <= 2")
def _history(spark, sf):
    return G.version_history(versions(spark, sf), keep=2).select("doc_id", "version", F.col("age").cast("bigint").alias("age"))


@query(
    "reconcile",
    f"""WITH {CATALOG} SELECT name, md5(name) AS doc_id, CASE WHEN c.size IS NULL THEN 'added' WHEN f.size IS NULL THEN 'removed' WHEN f.size <> c.size OR f.mtime > c.mtime THEN 'updated' ELSE 'unchanged' END AS action
        FROM (SELECT * FROM files WHERE size > 0) f FULL JOIN cat c USING (name)""",
)
def _reconcile(spark, sf):
    return G.reconcile(files(spark, sf), catalogue(spark, sf))


@query("orphans", f"WITH {CATALOG} SELECT doc_id FROM cat WHERE file_path IS NULL OR file_path NOT IN (SELECT file_path FROM files)")
def _orphans(spark, sf):
    return G.orphans(catalogue(spark, sf), files(spark, sf)).select("doc_id")


INTEGRITY = f"""{CATALOG}, c AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1), v AS (SELECT doc_id, count(*) AS n FROM vecs GROUP BY 1),
  i AS (SELECT cat.doc_id, coalesce(c.n, 0) AS chunks, coalesce(v.n, 0) AS vectors, f.doc_id IS NOT NULL AS file_exists, coalesce(f.size, 0) = cat.size AS size_matches,
    coalesce(c.n, 0) > 0 AS has_chunks, coalesce(v.n, 0) > 0 AS has_vectors, coalesce(c.n, 0) = coalesce(v.n, 0) AS counts_match, chunk_count = coalesce(c.n, 0) AS catalog_matches, status
    FROM (SELECT doc_id, size, chunk_count, CASE WHEN doc_id % 17 = 0 THEN 'pending' ELSE 'indexed' END AS status FROM cat) cat LEFT JOIN files f USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN v USING (doc_id)),
  h AS (SELECT *, CASE WHEN NOT file_exists THEN 'error' WHEN status = 'pending' THEN 'pending' WHEN size_matches AND has_chunks AND has_vectors AND counts_match AND catalog_matches THEN 'healthy' ELSE 'warning' END AS health FROM i)"""


def _checked(spark, sf):
    docs = catalogue(spark, sf).withColumn("status", F.when(_id() % 17 == 0, "pending").otherwise("indexed"))
    return G.integrity(docs, files(spark, sf), chunks(spark, sf), vectors(spark, sf))


@query("integrity", f"WITH {INTEGRITY} SELECT * FROM h")
def _integrity(spark, sf):
    return _checked(spark, sf)


@query("integrity_summary", f"WITH {INTEGRITY} SELECT health, count(*) AS documents FROM h GROUP BY 1")
def _summary(spark, sf):
    return G.integrity_summary(_checked(spark, sf))


@query("recent_history", "SELECT event_id AS history_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def _recent(spark, sf):
    h = table(spark, sf, "events").select(F.col("event_id").alias("history_id"), F.col("ts").alias("timestamp"))
    return G.recent_history(h, 100).select("history_id")


@query(
    "update_intake",
    """SELECT rid, CASE WHEN doc_id IS NULL OR trim(coalesce(content, '')) = '' THEN 'error' ELSE 'pending' END AS status,
         CASE WHEN doc_id IS NULL THEN 'missing id' WHEN trim(coalesce(content, '')) = '' THEN 'missing content' END AS error
       FROM (SELECT doc_id AS rid, CASE WHEN doc_id % 10 <> 0 THEN doc_id END AS doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS content FROM documents)""",
)
def _intake(spark, sf):
    rows = table(spark, sf, "documents").select(
        _id().alias("rid"), F.when(_id() % 10 != 0, _id()).alias("doc_id"), F.when(_id() % 9 == 0, " ").otherwise(F.col("text")).alias("content")
    )
    return G.intake(rows).select("rid", "status", "error")


@query(
    "upload_check",
    """WITH f AS (SELECT doc_id, source || CASE doc_id % 3 WHEN 0 THEN '.MD' WHEN 1 THEN '.exe' ELSE '.txt' END AS name, n_chars * 40000 AS size FROM documents),
       e AS (SELECT *, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS ext FROM f)
       SELECT doc_id, CASE WHEN ext NOT IN ('txt', 'pdf', 'docx', 'md', 'html', 'doc') THEN 'unsupported file type: ' || ext WHEN size > 52428800 THEN 'file too large' END AS message,
         CASE WHEN ext NOT IN ('txt', 'pdf', 'docx', 'md', 'html', 'doc') OR size > 52428800 THEN 'error' ELSE 'accepted' END AS status FROM e""",
)
def _upload(spark, sf):
    ext = F.when(_id() % 3 == 0, ".MD").when(_id() % 3 == 1, ".exe").otherwise(".txt")
    f = table(spark, sf, "documents").select("doc_id", F.concat("source", ext).alias("name"), (F.col("n_chars") * 40000).alias("size"))
    return G.upload_check(f).select("doc_id", "message", "status")


@query("similarity_bands", "SELECT CASE WHEN v >= 0.8 THEN 'score-high' WHEN v >= 0.7 THEN 'similarity-score' WHEN v >= 0.6 THEN 'score-middle' ELSE 'score-low' END AS band, count(*) AS events FROM (SELECT value / 100 AS v FROM events) GROUP BY 1")
def _bands(spark, sf):
    return table(spark, sf, "events").groupBy(similarity_band(F.col("value") / 100).alias("band")).agg(F.count(F.lit(1)).alias("events"))
