"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from vellumine.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def slow_runs(words, least=24, times=3):
    """Every lag's maximal matched stretches; of those long enough the ones whose lag is the smallest period."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(least, times * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        while len(words) < rng.randrange(1, 400):
            q, letters = rng.choice([1, 1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 24, 31, 33, 40]), rng.choice(["a", "ab", "abc", "abcdefgh"])
            unit = [rng.choice(letters) for _ in range(q)]
            words += (unit * 20)[: rng.choice([q, 23, 24, 25, 2 * q, 3 * q - 1, 3 * q, 3 * q + 1, 5 * q])]
            words += [rng.choice("abxy") for _ in range(rng.choice([0, 0, 1, 4]))]
        yield words


@pytest.mark.parametrize("seed", range(4))
def test_brute_force(seed):
    for words in texts(seed, 60):
        ids = periodic.numbered([w.encode() for w in words])
        assert periodic.find_runs(ids) == slow_runs(words)


def test_other_limits():
    for words in texts(9, 30):
        ids = periodic.numbered([w.encode() for w in words])
        for least, times in ((10, 3), (31, 4), (1, 3)):
            assert periodic.find_runs(ids, least, times) == slow_runs(words, least, times)
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(50, np.int64), 24, 2)


def test_work_grows_with_the_text():
    """One word a million times, and a period of 1 000 words: pairs are neighbours only."""
    n = 1_000_000
    assert periodic.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    again = np.tile(np.random.default_rng(1).permutation(1000), 100)
    assert periodic.find_runs(again) == [(0, 100_000, 1000)]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = slow_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return doc_id, len(runs), *shown, digest(listed), digest(" ".join(slow_kept(words, runs)))


def test_query(spark):
    found = queries.op11_periodic_runs(spark, FOLDER)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert found.columns == names
    docs = [r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if len(r["text"] or "") < 4000]
    wanted = {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in docs}
    rows = {r["doc_id"]: tuple(r) for r in found.collect()}
    assert {i: rows[i] for i in wanted} == wanted
    assert sum(w[1] > 0 for w in wanted.values()) > 5


def test_awkward_rows(spark, tmp_path):
    rows = [(None, "a b", "x"), (None, "a " * 30, "x"), (1, None, "x"), (2, "", "x"), (2, " \n\t", "x"), (3, "é é " * 24, "x"), (3, "é é " * 24, "x"), (10, "w " * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[7])
    wanted = [(None, *expected(1, t)[1:]) if i is None else expected(i, t) for i, t, _ in rows]
    assert zlib.crc32(b"1") % 10  # stands for an id that plants nothing
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)
    assert queries.periodic.collapse_runs(docs.where("false")).count() == 0
