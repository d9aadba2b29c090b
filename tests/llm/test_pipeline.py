"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import FOLDER, slow_base  # noqa: I001
from test_similar import slow_first
from vellumine.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        made[name] = (docs, out)
        docs = out
    before, after = made["quality classifier"]
    assert after.columns == before.columns
    scores = {r["doc_id"]: r["predicted"] for r in quality.score_quality(before, labels).collect()}
    assert {r["doc_id"] for r in after.collect()} == {i for i, p in scores.items() if p}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    clean = [i for i in scores if truth.get(i) == 1]
    assert sum(scores[i] for i in clean) >= 0.97 * len(clean)

    before, after = made["quality rules"]
    kept = {r["doc_id"] for r in after.collect()}
    for r in before.collect():
        n, _, _, _, repeated = slow_base(r["text"])
        if n < 50 or 100 * repeated > 50 * n:
            assert r["doc_id"] not in kept
    sound = [r["doc_id"] for r in before.collect() if truth.get(r["doc_id"]) == 1 and len(WORD.findall(r["text"])) >= 50]
    assert sum(i in kept for i in sound) >= 0.97 * len(sound)

    before, after = made["near duplicates"]
    assert {r["doc_id"] for r in after.collect()} == slow_first([(r["doc_id"], r["text"]) for r in before.collect()])

    before, after = made["source mix"]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(before).collect()}
    assert {r["doc_id"]: len(WORD.findall(r["text"])) for r in after.collect()} == {i: t for i, t in taken.items() if t}
    assert after.columns == before.columns

    before, after = made["bpe"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter()
    for r in before.collect():
        ids = t.encode(r["text"], add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        wanted[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, after.collect())) == wanted
    assert Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == wanted


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
