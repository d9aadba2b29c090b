"""Texts that contain an item, wherever words and lines break."""

import time

from vellumine.plans import evaluate as E


def test_containing(spark):
    items = ["alpha beta gamma delta", "beta  gamma", "x", "one two three", "two words", "", None, "tail of\nthe line here"]
    texts = ["zalpha beta gamma deltaz", "alpha beta\ngamma delta", "a beta  gamma b", "xyz", "one two threefold", "at one two\tthree", "two wordsmith", None, "",
             "detail of\nthe line herein", "alpha beta gamma delta"]
    found = E.containing(
        spark.createDataFrame(list(enumerate(items)), "query_id int, query string"), spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    ).collect()
    want = {(i, d) for i, q in enumerate(items) for d, t in enumerate(texts) if q and t and q in t}
    assert sorted(map(tuple, found)) == sorted(want)


def test_containing_in_long_texts(spark):
    """Runs of a text are made in time linear in its words, and no run carries its text along."""
    n = 60_000
    long = " ".join(f"w{i}" for i in range(n))
    items = spark.createDataFrame([(0, f"w{n - 6} w{n - 5} w{n - 4} w{n - 3} w{n - 2}"), (1, "w0 w1 w3 w4 w5"), (2, "9 w10 w1")], "query_id int, query string")
    E.containing(items, spark.createDataFrame([(1, "a b")], "doc_id int, text string")).collect()  # plans and compiles
    start = time.time()
    found = E.containing(items, spark.createDataFrame([(5, long), (6, "w0 w1 w2"), (None, long)], "doc_id int, text string")).collect()
    assert time.time() - start < 15
    assert sorted(map(tuple, found), key=repr) == [(0, 5), (0, None), (2, 5), (2, None)]
