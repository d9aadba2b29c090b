"""Windows of a long text take time in proportion to it; token estimates count words as they are defined."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions import tokens as K
from vellumine.operators import chunking as C


def test_windows_of_a_long_text(spark):
    d = spark.range(1).select(F.repeat(F.lit("Ein schöner Satz. "), 900_000).alias("text"))
    start = time.time()
    r = d.select(F.size(C.fixed_windows(F.col("text"))).alias("n")).first()
    assert r["n"] == 36_000 and time.time() - start < 40


@pytest.mark.parametrize("size,overlap", [(500, 50), (10, 0), (7, 5), (9, 8)])
def test_windows_are_substrings(spark, size, overlap):
    rng = random.Random(1)
    texts = ["", " ", "a", None] + ["".join(rng.choices("ab \n中\U0001f600", k=n)) for n in (size - overlap, size, size + 1, 99, 1003)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", C.fixed_windows(F.col("t"), size, overlap).alias("w")).collect()
    for r in rows:
        t = texts[r["n"]]
        if t is None:
            assert r["w"] is None
            continue
        want = [(s, t[s : s + size]) for s in range(0, len(t), size - overlap)]
        assert [(w["start"], w["text"]) for w in r["w"]] == [w for w in want if w[1].strip()]


def test_estimates_count_words(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("aZé1.,-  \n 　中文第\U00020000", k=rng.randint(0, 60))) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", K.estimate_tokens(F.col("t")).alias("e")).collect()
    cjk = re.compile(f"[{S.CJK_BASIC}]")
    for r in rows:
        t = texts[r["n"]]
        words = [w for w in re.split("[" + "".join(S.ANY_SPACE) + "]+", t) if any(c.isalpha() for c in w)]
        only = [w for w in words if cjk.search(w) and not re.search("[A-Za-z]", w)]
        marks = sum(t.count(c) for c in S.ESTIMATE_MARKS)
        assert r["e"] == int(len(cjk.findall(t)) / 1.5 + (len(words) - len(only)) * 1.3 + marks * 0.5)
