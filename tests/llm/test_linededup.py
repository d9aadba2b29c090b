"""Line dedup against brute force."""

import hashlib
from collections import defaultdict

from vellumine.llm import linededup, queries

FOLDER = "/root/testdata/sf0.01"
ENDS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(ENDS))


def slow(rows, least_chars=40, least_docs=5):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key_of(line)].add(-1 if i is None else i)
    common = {k: max(ids) for k, ids in held.items() if len(k) >= least_chars and len(ids) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if common.get(key_of(x), i) in (i, -1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    wanted = [(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in slow(rows)]
    found = sorted(map(tuple, queries.op13_line_dedup(spark, FOLDER).collect()), key=repr)
    assert found == sorted(wanted, key=repr)
    assert sum(r[2] for r in found) > 0


def test_awkward_rows(spark):
    long, other, fancy = "This line is one of more than forty letters", "Another line that is longer than forty letters", "ÉÀ" * 20
    rows = [(i, f"{long}\n own {i}\n\t{other.upper()} ") for i in range(4)]
    rows += [(None, long), (None, f"{other}\n{other}"), (9, f"{long}\r\n{long.upper()}\n"), (9, f"x\n{long}"), (10, None), (11, ""), (12, "\n\n"), (3, rows[3][1])]
    rows += [(20 + i, fancy) for i in range(5)] + [(30 + i, fancy.lower()) for i in range(4)] + [(40 + i, "short") for i in range(9)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, pos string, keeper int").repartition(4)
    assert sorted(map(tuple, linededup.dedup_lines(docs).collect()), key=repr) == slow(rows)
    assert sorted(map(tuple, linededup.dedup_lines(docs, 3, 2).collect()), key=repr) == slow(rows, 3, 2)
    assert linededup.dedup_lines(docs.where("false")).count() == 0


def test_long_text_of_common_lines(spark):
    """Places are taken from the row's own array: work grows with the lines."""
    rows = [(i, "\n".join(f"line number {k} with more than forty letters in it" for k in range(20_000))) for i in range(5)]
    found = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_dropped"], len(r["text"])) for r in found) == [(i, 20_000, 0) for i in range(4)] + [(4, 0, len(rows[4][1]))]


def test_plan(spark):
    """No Python on the path, and the split lines are a column that the lambda reads."""
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "split(" not in plan.split("array_join", 1)[1].split("\n", 1)[0]
