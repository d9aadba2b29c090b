"""Changed, restored and deleted documents: only the newest text is read."""

from pyspark.sql import functions as F

from vellumine.functions import vectors as V
from vellumine.streaming import ingest as SI

SCHEMA = "doc_id long, text string, n long"


def run(spark, folder, out, state, **options):
    docs = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    SI.start_ingest(docs, out, state, encode=V.hashed_text_vector, version="n", **options).awaitTermination()


def put(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{k}")


def live(spark, out):
    chunks = SI.read_live(spark, out)
    texts = {}
    for r in chunks.orderBy("doc_id", "num").collect():
        texts[r["doc_id"]] = texts.get(r["doc_id"], "") + r["content"]
    vectors = SI.read_live(spark, out, "vectors")
    assert sorted((r["doc_id"], r["num"]) for r in vectors.collect()) == sorted((r["doc_id"], r["num"]) for r in chunks.collect())
    return texts


def test_only_the_newest_text_is_read(spark, tmp_path):
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    put(spark, folder, 0, [(1, "first text", 0), (2, "stays", 0), (3, "goes", 0), (4, "old", 0), (4, "newer", 1)])
    run(spark, folder, out, state)
    assert live(spark, out) == {1: "first text", 2: "stays", 3: "goes", 4: "newer"}
    put(spark, folder, 1, [(1, "second text", 0), (2, "stays", 0), (3, None, 0)])
    run(spark, folder, out, state)
    assert live(spark, out) == {1: "second text", 2: "stays", 4: "newer"}
    put(spark, folder, 2, [(1, "first text", 0), (3, "back", 0)])
    run(spark, folder, out, state)
    assert live(spark, out) == {1: "first text", 2: "stays", 3: "back", 4: "newer"}
    assert spark.read.parquet(f"{out}/chunks").where("doc_id = 2").count() == 1
    before = live(spark, out)
    (tmp_path / "state" / "commits" / "2").unlink()  # the last batch was written, not committed: it runs again
    (tmp_path / "state" / "commits" / ".2.crc").unlink(missing_ok=True)
    run(spark, folder, out, state)
    assert live(spark, out) == before
    assert SI.read_live(spark, out).count() == SI.read_live(spark, out).dropDuplicates(["doc_id", "num"]).count()
    target = f"{tmp_path}/target"
    SI.compact(spark, out, target, ("chunks", "vectors"))
    assert live(spark, target) == before and spark.read.parquet(f"{target}/chunks").count() == SI.read_live(spark, out).count()
    put(spark, folder, 3, [(1, "third", 0), (2, "stays", 0)])
    run(spark, folder, target, state)
    assert live(spark, target) == {**before, 1: "third"}
    assert spark.read.parquet(f"{target}/chunks").where(F.col("doc_id") == 2).count() == 1
