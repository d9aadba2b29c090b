"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of 5-word shingles."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from vellumine.llm import mixing, similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_first(rows):
    """Smallest id of each component of texts with similarity 0.8 or more."""
    sets = {i: slow_shingles(t) for i, t in rows}
    root, at = {i: i for i in sets}, defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        both = Counter(j for s in sets[i] for j in at[s])
        for j, n in both.items():
            if 10 * n >= 8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            at[s].append(i)
    return {i for i in sets if find(i) == i}


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == slow_first([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("chunk_rows", [similar.CHUNK_ROWS, 4])
def test_every_degree_of_likeness(spark, monkeypatch, chunk_rows):
    """Texts with more and more words replaced: the verdict turns at 0.8, in one row and in pairs of chunks."""
    monkeypatch.setattr(similar, "CHUNK_ROWS", chunk_rows)
    rng = random.Random(3)
    rows = [(0, None), (1, " \n"), (2, ""), (3, "one two"), (4, "One  two"), (5, "one three")]
    for _ in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(20, 300))]
        for changed in range(0, len(base) // 15 + 2):
            words = list(base)
            for i in rng.sample(range(len(words)), changed):
                words[i] = f"x{rng.randrange(900)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == slow_first(rows)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("false"), "").count() == 0


def test_stages_after_it(spark):
    """The chain on its own input: what the stage keeps, and the words that the mix and the codes make of it."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).cache()
        if name == "near duplicates":
            assert {r["doc_id"] for r in docs.collect()} == slow_first([(r["doc_id"], r["text"]) for r in before.collect()])
        if name == "source mix":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(before).collect()}
            assert {r["doc_id"]: len(WORD.findall(r["text"])) for r in docs.collect()} == {i: t for i, t in taken.items() if t}
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, docs.collect()))
