"""Patterns of marks and white space tell plain letters first, and no run is read twice."""

import random
import re
import time

from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions import text as X
from vellumine.operators import chunking as C

MARKS = ["。；！？\n", ".!?\n", "。！？；.!?", "z-]^", "\U0001f600x"]


def test_pieces_and_letters(spark):
    rng = random.Random(3)
    texts = ["", "\n", "a", "\n\n", "a\nb"] + ["".join(rng.choices("ab z-]^.!?。；\n \t\u0085  　​中\U0001f600é", k=rng.randint(0, 40))) for _ in range(800)]
    pieces = [C.split_pieces(F.col("t"), m).alias(f"p{i}") for i, m in enumerate(MARKS)]
    marks = F.regexp_replace("t", f"{X.inside(S.ESTIMATE_MARKS)}+", "").alias("rest")
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", *pieces, X.letter_count(F.col("t")).alias("letters"), X.filled(F.col("t")).alias("filled"), marks).collect()
    for r in rows:
        t = texts[r["n"]]
        for i, m in enumerate(MARKS):
            body = "".join(re.escape(c) for c in m)
            assert r[f"p{i}"] == re.findall(f"[^{body}]*[{body}]|[^{body}]+", t), (t, m)
        bare = [c for c in t if c not in S.ANY_SPACE]
        assert r["letters"] == len(bare) and r["filled"] == bool(bare)
        assert r["rest"] == "".join(c for c in t if c not in S.ESTIMATE_MARKS)


def test_pieces_of_a_long_text(spark):
    """67.5 million characters: 2 s, and 13 s when each was told range by range and up to three times."""
    d = spark.range(1).select(F.repeat(F.lit("Ein langer Satz ohne Ende, "), 2_500_000).alias("t")).cache()
    assert d.select(F.length("t")).first()[0] == 67_500_000
    start = time.time()
    assert d.select(F.size(C.split_pieces(F.col("t"), "。；！？\n"))).first()[0] == 1
    took = time.time() - start
    d.unpersist()
    assert took < 8, took
