"""Chunkers read a text a bounded number of times, however many spaces or articles it has."""

import time

from vellumine.functions import text as X
from vellumine.operators import chunking as C


def test_strip_passes_runs_of_spaces_once(one):
    long = "a" + " " * 300_000 + "b"
    one(lambda t: X.strip(t), "a")  # starts the session
    start = time.time()
    assert one(lambda t: X.strip(t), " \u3000\n" + long + "\t\u0085") == long
    assert time.time() - start < 10
    assert [one(lambda t: X.filled(t), t) for t in ("", " \u3000\n", " \u200b", " a ", "\n\nb")] == [False, False, True, True, True]


def test_chapter_of_many_articles(one):
    n = 6000
    one(lambda t: C.article_chunks(t), "第1条 甲")  # plans and compiles
    doc = "第1章 " + "总则" + "".join(f"\n第{i}条 " + "内容" * 10 for i in range(1, n + 1))
    start = time.time()
    chunks = one(lambda t: C.article_chunks(t), doc)
    assert time.time() - start < 10
    assert [a for c in chunks for a in c["articles"]] == [str(i) for i in range(1, n + 1)]
    assert {c["chapter"] for c in chunks} == {"第1章 总则"}
