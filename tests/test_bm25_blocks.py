"""BM25 in blocks: words as Spark splits them, hits as a plain count gives them, few rows between tasks."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from vellumine.functions import tokens as K
from vellumine.functions import vectors as V
from vellumine.operators import retrieval as RT

STOP = ["the", "of", "的"]


def test_words_are_those_of_the_split(spark):
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + [0xFF0C, 0xFF01, 0xE000, 0x1F600, 0x20000]
    rng = random.Random(1)
    texts = ["ab" + chr(c) + "cd" + chr(c) + "e" for c in points] + ["".join(chr(rng.choice(points)) for _ in range(200)) for _ in range(200)] + ["", " ", "a", "\U0001f600"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", K.search_tokens(F.col("t"), STOP).alias("w")).collect()
    word = re.compile(K.SEARCH_WORD)
    assert all(r["w"] == [w for w in word.findall(texts[r["n"]]) if w not in STOP] for r in rows) and len(rows) == len(texts)


def made(n):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + STOP + ["x", "über", "中文"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(n)]
    return {f"c{i}": t for i, t in enumerate(texts + [texts[0]] * 5 + ["", "the of", None])}


def asked():
    return {q: [f"w{q}", f"w{2 * q}", "über", "none"] + [f"w{q}"] * (q % 2) for q in range(20)}


def frames(spark, texts):
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, content string").repartition(3)
    return chunks, spark.createDataFrame(list(asked().items()), "query_id int, terms array<string>")


def plain(texts, k):
    kept = {c: [w for w in t.split(" ") if len(w) > 1 and w not in STOP] for c, t in texts.items() if t is not None}
    kept = {c: w for c, w in kept.items() if w}
    n, mean = len(kept), sum(map(len, kept.values())) / len(kept)
    df = Counter(w for ws in kept.values() for w in set(ws))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = set()
    for q, terms in asked().items():
        score = Counter()
        for c, ws in kept.items():
            tf = Counter(ws)
            for t in terms:
                if tf[t]:
                    score[c] += (floor if idf[t] < 0 else idf[t]) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ws) / mean))
        best = sorted(((-round(s, 9), c) for c, s in score.items() if s > 0))[:k]
        out |= {(q, c, r + 1) for r, (_, c) in enumerate(best)}
    return out


def test_hits_are_those_of_a_plain_count(spark):
    texts = made(300)
    chunks, queries = frames(spark, texts)
    want = plain(texts, 7)
    run = lambda: {(r["query_id"], r["chunk_id"], r["rank"]) for r in RT.bm25(chunks, queries, 7, key="chunk_id", text="content", stop=STOP).collect()}
    assert run() == want
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_tokens_never_become_rows(spark):
    chunks, queries = frames(spark, made(50))
    plan = RT.bm25(chunks, queries, 7, key="chunk_id", text="content", stop=STOP)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate [query_id" not in plan.split("MapInArrow", 1)[0]


def test_words_that_return_stay_known():
    known = V._Buckets()
    for i in range(V.KNOWN_WORDS):
        known[f"w{i}"]
    known["new"]
    assert len(known) == 1 and len(known.older) == V.KNOWN_WORDS
    known.older["w5"] = -1
    assert known["w5"] == -1
