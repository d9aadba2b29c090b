"""File sources, sinks, and streams against their batch twins."""

import json

from pyspark.sql import functions as F

from vellumine.operators import catalog as G
from vellumine.operators import logbook as L
from vellumine.sources import files, sinks
from vellumine.streaming import ingest as SI
from vellumine.streaming import rules as SR

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# 标题\n正文", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("报销制度".encode("gbk"))
    (tmp_path / "c.csv").write_text("a,b\n\n1,2\n")
    (tmp_path / "d.json").write_text('{"k":[1]}')
    (tmp_path / "e.html").write_text("<html><body><p>甲&amp;乙</p><script>x</script><a href='q'>丙</a></body></html>", encoding="utf-8")
    (tmp_path / "f.xml").write_text("<r>t<a>1</a>tail</r>")
    p = str(tmp_path)
    assert [r["name"] for r in files.scan_documents(spark, p, [".md", "txt"]).collect()] == ["a.md", "b.txt"]
    assert files.list_markdown(spark, p).first()["id"] == "a"
    row = files.read_text(spark, p, "*.md").first()
    assert (row["content"], row["format"], row["content_length"]) == ("# 标题\n正文", "md", 7)
    row = files.read_text_any_encoding(spark, p).first()
    assert (row["content"], row["encoding"]) == ("报销制度", "gbk")
    assert files.read_csv_text(spark, f"{p}/c.csv").first()["content"] == "a,b\n1,2"
    assert files.read_json_text(spark, f"{p}/d.json").first()["content"] == '{\n  "k": [\n    1\n  ]\n}'
    assert files.read_html_text(spark, f"{p}/e.html").first()["content"] == "甲&乙\n丙" or "甲&乙" in files.read_html_text(spark, f"{p}/e.html").first()["content"]
    assert files.read_xml_outline(spark, f"{p}/f.xml").first()["content"] == "r:\n  t\n  a:\n    1\n  tail"
    (tmp_path / "bad.json").write_text('{"k": [')
    bad = files.read_json_text(spark, f"{p}/*.json").where("content IS NULL").collect()
    assert len(bad) == 1 and bad[0]["path"].endswith("bad.json") and "JSONDecodeError" in bad[0]["error"]


def test_catalogue_sources(spark, tmp_path):
    doc = {"d1": {"id": "d1", "name": "a.md", "size": 3, "status": "indexed", "upload_time": "2024-01-02T03:04:05", "tags": ["x"]}}
    (tmp_path / "documents.json").write_text(json.dumps(doc))
    chunks = {"document_id": "d1", "chunks": [{"id": "1", "num": 1, "text": "旧"}, {"id": "2", "num": 2, "content": " "}]}
    (tmp_path / "chunks.json").write_text(json.dumps(chunks))
    case = {"id": "c", "query": "q", "expected_keywords": ["k"], "ground_truth": "t"}
    (tmp_path / "cases.json").write_text(json.dumps({"retrieval_test_cases": [case], "retrieval_test_cases_part2": [{**case, "ground_truth": ["a", "b"]}]}))
    assert str(files.read_documents(spark, f"{tmp_path}/documents.json").first()["upload_time"]) == "2024-01-02 03:04:05"
    assert [(r["document_id"], r["content"]) for r in files.read_chunks(spark, f"{tmp_path}/chunks.json").collect()] == [("d1", "旧")]
    assert sorted(len(r["ground_truth"]) for r in files.read_eval_cases(spark, f"{tmp_path}/cases.json").collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, "title", "甲"), (1, 2, "text", "乙"), (2, 1, "text", "丙")], "doc_id long, num long, type string, content string")
    assert {r["doc_id"]: r["markdown"] for r in sinks.markdown_documents(chunks).collect()} == {1: "## 甲\n\n乙", 2: "丙"}
    sinks.write_chunks(chunks, f"{tmp_path}/chunks", buckets=4)
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == 3
    sinks.export_logs(chunks, f"{tmp_path}/csv", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3
    text = sinks.write_report(chunks.groupBy("type").count(), f"{tmp_path}/report", "R")
    assert text.startswith("# R\n\n| type | count |")


def test_recovery(spark):
    ledger = spark.createDataFrame(
        [("t1", 1, "in_progress", G.JOB_STEPS), ("t2", 9, "failed", ["parsed"]), ("t3", 1, "failed", ["parsed"]), ("t4", 1, "completed", [])],
        "id string, doc_id long, status string, completed_steps array<string>",
    )
    docs = spark.createDataFrame([(1,)], "doc_id long")
    found = {r["id"]: r["action"] for r in G.recovery_actions(ledger, docs).collect()}
    assert found == {"t1": "complete", "t2": "manual", "t3": "rollback"}


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def stream(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    batch.repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/events")
    return batch, spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/events")


def test_streams_match_batch(spark, tmp_path):
    batch, live = stream(spark, tmp_path)
    mine = run_stream(SR.rate_limits(live, 7200, 2), "rates").select("id", "calls", "limited")
    assert mine.exceptAll(L.rate_limit(batch, 7200, 2).select(F.col("event_id").alias("id"), "calls", "limited")).count() == 0
    assert mine.count() == batch.count()
    mine = run_stream(SR.token_buckets(live, 21600, 2), "buckets").select("id", "allowed")
    assert mine.exceptAll(L.token_buckets(batch, 21600, 2).select(F.col("event_id").alias("id"), "allowed")).count() == 0
    mine = run_stream(SR.metric_windows(live), "windows", "complete").select("event_type", "window_start", "samples")
    assert mine.exceptAll(L.sliding_metrics(batch, "24 hours", "12 hours").select("event_type", "window_start", "samples")).count() == 0
    mine = run_stream(SR.sessions(live, "10 hours"), "sess", "complete").select("user_id", "events")
    assert mine.exceptAll(L.sessions(batch, 36000).select("user_id", "events")).count() == 0
    assert run_stream(SR.alerts(live, {"error": 10.0}), "alerts").count() == batch.where("event_type = 'error' AND value > 10").count()
    hits = run_stream(SR.reuse_hits(live, "user_id", 1800), "reuse").where("hit").count()
    assert hits == L.reuse_statistics(batch, "user_id", 1800).first()["hits"]


def test_incremental_ingest(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    docs.where("doc_id < 50").write.parquet(source)
    SI.start_ingest(SI.read_document_stream(spark, source), out, state).awaitTermination()
    first = spark.read.parquet(f"{out}/chunks")
    assert first.select("doc_id").distinct().count() == 50
    n = first.count()
    docs.where("doc_id < 60").write.mode("append").parquet(source)
    SI.start_ingest(SI.read_document_stream(spark, source), out, state).awaitTermination()
    second = spark.read.parquet(f"{out}/chunks")
    assert second.select("doc_id").distinct().count() == 60
    assert second.where("doc_id < 50").count() == n


def test_replayed_batch_equals_a_single_run(spark, tmp_path):
    """A batch that was written but not committed is run again without losing rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    docs.write.parquet(source)
    SI.start_ingest(SI.read_document_stream(spark, source), out, state).awaitTermination()
    once = spark.read.parquet(f"{out}/chunks").count()
    for name in ("0", ".0.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    SI.start_ingest(SI.read_document_stream(spark, source), out, state).awaitTermination()
    assert once > 40 and spark.read.parquet(f"{out}/chunks").count() == once
