"""Model hooks, table-function chunkers and redaction of nested data."""

import json
import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from vellumine.functions import chunker as CH
from vellumine.functions import models
from vellumine.functions import rules as R
from vellumine.operators import knn as N
from vellumine.operators import retrieval as RT


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    loads, calls = tmp_path / "loads", tmp_path / "calls"
    loads.mkdir(), calls.mkdir()

    def load():
        (loads / f"{os.getpid()}-{uuid.uuid4().hex}").touch()

        def encode(texts):
            for t in texts:
                (calls / uuid.uuid4().hex).write_text(t)
            return np.array([[len(t), t.count("a")] for t in texts], float)

        return encode

    texts = [(i, f"text {'a' * (i % 25)}") for i in range(400)] + [(1000 + i, "one text of many copies") for i in range(300)] + [(5000, None), (5001, "")]
    df = spark.createDataFrame(texts, "doc_id int, text string").repartition(16)
    found = {r["doc_id"]: r["embedding"] for r in N.encode_texts(df, "doc_id", "text", models.text_encoder(load, batch_size=7)).collect()}
    assert found == {i: None if t is None else [float(len(t)), float(t.count("a"))] for i, t in texts}
    assert len(list(calls.iterdir())) == 27  # each different text once
    names = [p.name.split("-")[0] for p in loads.iterdir()]
    assert len(names) == len(set(names)) <= 16


def test_pair_scorer(spark):
    hits = spark.createDataFrame([(1, d, r, q, c) for d, r, q, c in [(10, 1, "a b", "x"), (11, 2, "a b", "a and b"), (12, 3, "a b", None)]], "query_id int, doc_id int, rank int, query string, content string")
    scorer = models.pair_scorer(lambda: lambda qs, cs: [sum(w in c for w in q.split()) for q, c in zip(qs, cs)])
    ranked = RT.model_rerank(hits, scorer, 3).collect()
    assert [r["doc_id"] for r in sorted(ranked, key=lambda r: r["new_rank"])][0] == 11 and len(ranked) == 3


def test_chunker_from_sql(spark):
    class Halves(CH.Chunker):
        def split(self, text):
            return [text[: len(text) // 2], "  ", text[len(text) // 2 :]]

    CH.register_chunker(spark, "halves", Halves)
    docs = spark.createDataFrame([(1, "abcd"), (2, None), (3, ""), (4, "xy"), (4, "pq")], "doc_id long, text string")
    docs.createOrReplaceTempView("some_docs")
    rows = spark.sql("SELECT doc_id, num, content FROM halves(TABLE(some_docs) PARTITION BY doc_id) WHERE doc_id < 4 ORDER BY num").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "ab"), (1, 2, "cd")]
    assert sorted(r["content"] for r in CH.chunk_table(spark, "halves", docs).where("doc_id = 4").collect()) == ["p", "q", "x", "y"]


def slow_redact(x, depth):
    if depth == 0:
        return "******" if isinstance(x, (dict, list)) else x
    if isinstance(x, list):
        return [slow_redact(v, depth - 1) for v in x]
    if not isinstance(x, dict):
        return x
    out = {}
    for k, v in x.items():
        if any(s in k.lower() for s in ("password", "token", "secret", "api_key")) and not isinstance(v, dict):
            out[k] = "******" if not isinstance(v, str) else "*" * len(v) if len(v) <= 8 else v[:4] + "*" * (len(v) - 8) + v[-4:]
        else:
            out[k] = slow_redact(v, depth - 1)
    return out


def test_nested_redaction(spark):
    cases = [
        {"a": {"b": [{"password": "abcdefghijkl", "n": [1, [{"Token": "short"}]]}], "secret": {"x": "stays", "token": 12}}, "api_key": None, "d": 1.5},
        [{"token": ["list", "goes"]}, "plain", [], {}], {"k \"q\"\n": {"my_password": "pä\"ss\nword long"}}, 3, "text", None, {"a": {"b": {"c": {"d": {"token": "deep one that goes"}}}}},
    ]
    texts = [json.dumps(c) for c in cases] + ["no json, password=hunter2hunter2", "{broken", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = [r["r"] for r in df.select("i", R.redact_json(F.col("text"), depth=4).alias("r")).orderBy("i").collect()]
    for case, got in zip(cases, out):
        assert json.loads(got) == slow_redact(case, 4)
    assert out[len(cases) + 1 :] == ["{broken", "", None]
