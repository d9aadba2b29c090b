"""Queries over documents against their SQL on odd rows that the given tables don't hold."""

import hashlib
import random

import duckdb
import pytest

from check_queries import rows_of
from vellumine.workload import load

QUERIES, ORACLES = load()
LONG = "w " * 80
#: Spaces of all kinds, blank lines, marks of headings within long lines, windows of spaces only, letters that change with case.
ODD = [
    None, "", " ", "\n", "\n\n", "\t", "\r\n", "a\r\n\r\nb", "# ", "# x\n\ny", "####### " + LONG, " # " + LONG, f"x\n\t## {LONG}", f"x\n####### {LONG}\n#\t{LONG}",
    f"x\n#\u000b{LONG}", f"x\n#　{LONG}", "a" * 450 + "\n", "a" * 450 + "\t", "a" * 450 + " ", "\n" * 1000, " " * 1000, "\u00a0" * 500 + "b", "\u3000", "\u2028", "a" + "\n" * 1000 + "b", ".!?", "\u0085",
    "\U0001f600" * 600, "x" * 201, "İstanbul Σας ΟΔΟΣ ẞ",
]
PARTS = ["a", " ", "\n", "\n\n", "\t", "# ", "## ", ". ", "\r", "word ", "　", "\u0085", "\x1f", "é", "İ", "Σ", "w " * 30, "w " * 60, "\u000b"]
READINGS = ["readability", "vectors_by_document", "heading_sections"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(300)]
    # 32 sentences of 1 337 characters: 0.653125, whose product with 100 000 is below a half.
    texts.append("\n\n" + "x" * 39 + ("." + "x" * 41) * 30 + "." + "x" * 66)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", READINGS)
def test_matches_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    df, cur = QUERIES[name](spark, odd), con.execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_rounded_as_in_sql(spark):
    from vellumine.workload.registry import rounded

    values = [0.501875, 0.653125, -0.501875, 0.1234565, 1.000005, 2.5e-6, 0.0, 1e9 + 0.123456]
    ours = [r["v"] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded("x", 5).alias("v")).collect()]
    theirs = duckdb.connect().execute("SELECT round(x, 5) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()
    assert ours == [v for (v,) in theirs]


def test_scores_at_the_threshold(spark, tmp_path):
    """Hits that score 0.7 itself count as in SQL, whose sum of rounded terms may be just below; letters are lower-cased one by one."""
    words: dict[int, str] = {}
    for i in range(500):
        words.setdefault(int(hashlib.md5(f"w{i}".encode()).hexdigest()[:8], 16) % 64, f"w{i}")
    said = lambda counts: " ".join(" ".join([words[b]] * n) for b, n in enumerate(counts) if n)
    pairs = [([2, 2, 0], [0, 7, 1]), ([0, 0, 0, 2, 2], [0, 0, 0, 1, 7]), ([0] * 5 + [5, 5, 0], [0] * 5 + [7, 0, 1]), ([0] * 8 + [0, 1, 1, 0, 0], [0] * 8 + [6, 5, 9, 7, 3])]
    texts = [(i, said(d)) for i, (_, d) in enumerate(pairs)] + [(10, "ΟΔΟΣ İl"), (11, "οδοσ il"), (12, "ΟΔΟΣ eine"), (13, None), (14, "")]
    asked = [(i, said(q)) for i, (q, _) in enumerate(pairs)] + [(10, "οδοσ il"), (11, "ΟΔΟΣ"), (12, None), (13, " ")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df, cur = QUERIES["enhancement_metrics"](spark, str(tmp_path)), con.execute(ORACLES["enhancement_metrics"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
